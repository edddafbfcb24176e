"""Text documents by processing stage, input inventories and label summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.clocks import duration_label

STAGES = ["original", "corrected", "masked"]


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file that is not empty; files are documents, so each is bounded by its own size."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_stages(df: DataFrame, path: str, key: str = "doc_id", mode: str = "errorifexists", **columns: str) -> None:
    """Long table ``(key, stage, text)`` partitioned by stage; empty texts are not written.

    ``columns``: stage name -> column, e.g. ``original="text", masked="masked_text"``.
    """
    stages = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(c).alias("text")) for s, c in columns.items()]))
    rows = df.select(key, stages.alias("s")).select(key, "s.stage", "s.text").where(F.coalesce("text", F.lit("")) != "")
    rows.write.mode(mode).partitionBy("stage").parquet(path)


def read_stage(spark: SparkSession, path: str, stage: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if stage is None else rows.where(F.col("stage") == stage)


def input_inventory(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Name, size and type of input files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]+)\z", 1).alias("name"), F.col("length").alias("bytes"),
        (F.col("length") / (1024.0 * 1024.0)).alias("size_mb"), F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1)).alias("type"))


def processing_estimate(inventory: DataFrame, parallel: bool = False) -> DataFrame:
    seconds: Column = F.sum("size_mb") * L.SECONDS_PER_MB / (2 if parallel else 1)
    return inventory.agg(F.count("*").alias("files"), F.sum("size_mb").alias("total_mb"), seconds.alias("seconds")).withColumn(
        "estimate", duration_label(F.col("seconds")))


def write_label_summary(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    summary.write.mode(mode).option("header", True).csv(path)
