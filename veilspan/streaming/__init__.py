"""The same operators on unbounded tables.

Detection and masking are row-local, so ``detect.detect_default`` and ``masking.mask`` run on
``readStream`` frames as they are; this module adds the windowed and keyed parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.detect import detect_default
from ..operators.masking import mask
from ..operators.summaries import label_histogram  # noqa: F401  (batch counterpart)


def document_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def masked_stream(docs: DataFrame, text: str = "text", **rules) -> DataFrame:
    return mask(detect_default(docs, text), text, **rules)


def with_vault(masked: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """A masked row as one or two rows: ``part = 'masked'`` without the original, and ``part = 'vault'`` to undo it.

    A document without records has no vault row; its masked text is its text.
    """
    fields = ("original_text", "masked_text", "masking_rules", "records")
    kinds = [masked.select(F.col(text).alias("original_text"), *fields[1:]).schema[n].dataType for n in fields]

    def part(name: str, *values: Column) -> Column:
        return F.struct(F.lit(name).alias("part"), *[v.cast(k).alias(n) for n, v, k in zip(fields, values, kinds, strict=True)])

    none = F.lit(None)
    public = part("masked", none, F.col("masked_text"), none, none)
    private = F.when(F.size("records") > 0, part("vault", F.col(text), F.col("masked_text"), F.col("masking_rules"), F.col("records")))
    return masked.select(*keys, F.explode(F.array(public, private)).alias("row")).where("row IS NOT NULL").select(*keys, "row.*")


def write_with_vault(masked: DataFrame, path: str, state: str, *keys: str, text: str = "text") -> DataStreamWriter:
    """Writer of a masked stream and its vault: one sink, split by ``part``.

    Both parts of a batch are committed at once by the sink's log, so a stream that stops between
    two files, or repeats a batch after a restart, leaves neither half a pair nor a second one.
    Read both with ``masked_part`` and ``vault_part``; each part is a folder with rights of its own.
    """
    rows = with_vault(masked, *keys, text=text)
    return (rows.writeStream.format("parquet").partitionBy("part").option("path", path).option("checkpointLocation", state))


def masked_part(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("part = 'masked'").drop("part", "original_text", "masking_rules", "records")


def vault_part(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("part = 'vault'").drop("part")


def restored(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Every streamed document with its original text: from the vault, or as it is where nothing was masked."""
    vault = vault_part(spark, path).select(*keys, F.col("original_text").alias("_original"))
    return masked_part(spark, path).join(vault, list(keys), "left").select(*keys, F.coalesce("_original", "masked_text").alias("text"), "masked_text")


def label_counts(spans: DataFrame, ts: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Span counts per label and tumbling or sliding window of event time."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (spans.withWatermark(ts, late).groupBy(window.alias("w"), "label").agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "label", "n"))


def activity_sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """Bursts of events of a key separated by a pause of at least ``gap``."""
    merged = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("s"))
    return merged.agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_deliveries(docs: DataFrame, ts: str = "ts", key: str = "doc_id", late: str = "10 minutes") -> DataFrame:
    """Suppress re-delivered documents within the watermark."""
    return docs.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
