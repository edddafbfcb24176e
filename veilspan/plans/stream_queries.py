"""Streams over the table files, run to completion with ``availableNow``.

Results go to a Parquet sink in the shared folder and are read back, so nothing passes through
the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .. import streaming as St
from ..operators.detect import detect_default
from ..session import shared_folder, table
from . import detection_queries as DQ
from .registry import query


def _stream(spark, folder: str, name: str) -> DataFrame:
    schema = table(spark, folder, name).schema
    # one file, or a folder of files of any name; a pattern, since a stream takes a plain path for a folder
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("stm1_detect_stream", DQ._bank_documents_sql())
def stm1(spark, folder):
    docs = _stream(spark, folder, "documents").select("doc_id", "text")
    found = run_to_end(detect_default(docs).select("doc_id", "spans"))
    return DQ.flat(found, "spans", "doc_id")


@query("stm1_masked_stream", None)
def stm1_masked(spark, folder):
    docs = _stream(spark, folder, "documents").select("doc_id", "text")
    return run_to_end(St.masked_stream(docs).select("doc_id", "masked_text"))


@query("stm1_vault_stream", "SELECT doc_id, text FROM documents")
def stm1_vault(spark, folder):
    docs = _stream(spark, folder, "documents").select("doc_id", "text")
    base = f"{shared_folder(spark)}/vault-{uuid.uuid4().hex}"
    St.write_with_vault(St.masked_stream(docs), f"{base}/out", f"{base}/state", "doc_id").trigger(availableNow=True).start().awaitTermination()
    return St.restored(spark, f"{base}/out", "doc_id").select("doc_id", "text")


def _timed(spark, folder):
    return _stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# the last windows stay open until the watermark passes them, so both sides leave them out
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def _epoch(column: str):
    return F.unix_seconds(F.col(column)).alias(column)


@query("stm2_tumbling_counts", f"SELECT CAST(epoch(b) AS BIGINT) AS window_start, event_type AS label, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') AS b, event_type FROM events) WHERE b + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY ALL")
def stm2(spark, folder):
    out = run_to_end(St.label_counts(_timed(spark, folder).withColumnRenamed("event_type", "label"), "ts", "1 hour"))
    return out.select(_epoch("window_start"), "label", "n")


@query("stm2_sliding_counts", f"""SELECT CAST(epoch(b) AS BIGINT) AS window_start, event_type AS label, count(*) AS n FROM (
    SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2024-01-01') - to_minutes(30 * j) AS b, event_type FROM events, (VALUES (0), (1)) v(j)) WHERE b + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY ALL""")
def stm2_sliding(spark, folder):
    out = run_to_end(St.label_counts(_timed(spark, folder).withColumnRenamed("event_type", "label"), "ts", "1 hour", "30 minutes"))
    return out.select(_epoch("window_start"), "label", "n")


@query("stm3_activity_sessions", f"""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM s)
    SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n FROM r GROUP BY user_id, run HAVING max(ts) + INTERVAL 1 HOUR <= {_CLOSED}""")
def stm3(spark, folder):
    out = run_to_end(St.activity_sessions(_timed(spark, folder), gap="1 hour"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("stm4_first_deliveries", "SELECT DISTINCT doc_id FROM documents")
def stm4(spark, folder):
    docs = _stream(spark, folder, "documents").select("doc_id")
    twice = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("copy")))
    return run_to_end(St.first_deliveries(twice)).select("doc_id")


