"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is run to completion into a no-op sink, after an unmeasured run of it on the smallest
of the given tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions.text import normalize_text
from veilspan.operators import detect, masking, summaries
from veilspan.plans import registry
from veilspan.session import local_session, table

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
#: Each query runs here once, unmeasured, so that compiling its code is not part of the figures.
WARM = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a scan that has fewer splits than there are cores.

    Text work is bound by the processor, so a single small file should not run as one task.
    Tables with enough splits are left alone; only for local runs over small files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


HEADLINE = {
    "normalize": lambda s, d: documents(s, d).select("doc_id", normalize_text(F.col("text"))),
    "pattern_bank": lambda s, d: detect.bank_spans(documents(s, d)).select("doc_id", "spans"),
    "detect_default": lambda s, d: detect.detect_default(documents(s, d)).select("doc_id", "spans"),
    "detect_all_and_mask": lambda s, d: masking.mask(detect.detect_all(documents(s, d))).select("doc_id", "masked_text", "records"),
    "label_summary": lambda s, d: summaries.summarize_by_label(
        detect.explode_spans(detect.detect_default(documents(s, d)), "spans", "doc_id"), ("doc_id", "start")),
    "overlap_merge": lambda s, d: registry.QUERIES["ovl5_merge_by_priority"](s, d),
    "timed_sentences": lambda s, d: registry.QUERIES["trx1_timed_sentences"](s, d),
    "stitch_exact": lambda s, d: registry.QUERIES["trx6_stitch_exact"](s, d),
    "merge_short": lambda s, d: registry.QUERIES["seg2_merge_short"](s, d),
    "span_scores": lambda s, d: registry.QUERIES["agg14_span_scores"](s, d),
    "recording_levels": lambda s, d: registry.QUERIES["sig1_recording_levels"](s, d),
}


def main() -> None:
    registry.load_all()
    registry.Tables.layout = staticmethod(spread)
    spark = local_session(CPUS, "veilspan-bench")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, build in HEADLINE.items():
        if os.path.isdir(WARM):
            build(spark, WARM).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        build(spark, FOLDER).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    rows = table(spark, FOLDER, "documents").count()
    line = {
        "metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(FOLDER.rstrip("/")), "cores": CPUS, "documents": rows,
        "documents_per_second_detect_mask": round(rows / took["detect_all_and_mask"], 1),
    }
    print(json.dumps(line))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
