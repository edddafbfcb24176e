"""Transcript metadata and whole-run results as nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RUN, TRANSCRIPT


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def transcript_sentences(transcripts: DataFrame, *keep: str) -> DataFrame:
    """Sentence rows; older files have none."""
    return transcripts.select(*keep, F.posexplode("sentences").alias("pos", "s")).select(*keep, "pos", "s.*")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run results; the metrics stored as text are cast, unreadable ones become null."""
    runs = spark.read.schema(RUN).option("multiLine", True).json(path)
    for side in ("before", "after"):
        for field in ("rms", "rms_db", "dynamic_range"):
            runs = runs.withColumn(f"{side}_{field}", F.col(f"audio_enhancement.{side}.{field}").try_cast("double"))
    return runs


def run_chunks(runs: DataFrame, *keep: str) -> DataFrame:
    return runs.select(*keep, F.explode("speech_to_text.chunks").alias("c")).select(*keep, "c.*")
