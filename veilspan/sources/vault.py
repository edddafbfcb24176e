"""Masking vaults: everything needed to undo a masking run, and rule presets."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.masking import rules_column
from ..schemas import RULES, VAULT


def vault_rows(masked: DataFrame, session: Column, timestamp: Column, text: str = "text", *keep: str) -> DataFrame:
    """Vault entries of masked documents; a document without records leaves none."""
    stats = F.struct(F.size("records").alias("total_masked"), F.length(text).alias("text_length"), F.length("masked_text").alias("masked_length"))
    # a filter on what is known to be pure is pushed below the masking, which is then done twice; the addend is zero
    counted = masked.withColumn("_entries", F.size("records") + F.floor(F.rand(0)))
    return counted.where("_entries > 0").select(
        *keep, session.alias("session_id"), timestamp.alias("timestamp"), F.col(text).alias("original_text"),
        "masked_text", "masking_rules", "records", stats.alias("stats"))


def write_vault(vault: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """JSON lines are compressed: an entry repeats its rules, its field names and, in every record, its text."""
    writer = vault.write.mode(mode).format(format)
    (writer.option("compression", "gzip") if format == "json" else writer).save(path)


def read_vault(spark: SparkSession, path: str, format: str = "json", extra: str = "") -> DataFrame:
    """``format='json'`` reads indented single-document files as well as JSON lines."""
    reader = spark.read.schema(VAULT + (", " + extra if extra else ""))
    if format == "json":
        reader = reader.option("multiLine", True)
    return reader.format(format).load(path)


def vault_records(vault: DataFrame, *keep: str) -> DataFrame:
    return vault.select(*keep, F.posexplode("records").alias("ord", "r")).select(*keep, "ord", "r.*")


def write_preset(spark: SparkSession, name: str, rules: dict[str, Any], path: str, mode: str = "append") -> None:
    one = spark.range(1).select(F.lit(name).alias("name"), F.to_json(rules_column(rules)).alias("rules"))
    one.write.mode(mode).json(path)


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, rules string").json(path).select("name", F.from_json("rules", RULES).alias("rules"))
