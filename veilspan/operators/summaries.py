"""Summaries over spans, runs and chunks.

Every group here is small in number but may be huge in size (a dozen labels over all spans), so
all of them are partial aggregates; lists are kept per document or cut to the wanted length
before they are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.text import percent_label, position_label, strip
from ..plans.ordered import positions, running
from ..session import written


def _shown_label() -> Column:
    return strip(F.coalesce(F.nullif(F.col("label_adjusted"), F.lit("")), F.col("label"), F.lit("")))


def summarize_by_label(spans: DataFrame, order: Sequence[str] = ("doc_id", "ord"), by: Sequence[str] = (),
                       samples: int = 5) -> DataFrame:
    """Per label: count and the first distinct sample texts, most frequent label first.

    Texts collapse per (label, text) before ranking, and the rank filter is applied on both
    sides of the shuffle, so a label with billions of spans sends a few rows per task.
    """
    keys = [*by, "label"]
    rows = spans.select(*by, _shown_label().alias("label"), strip(F.coalesce("text", F.lit(""))).alias("t"),
                        F.struct(*order).alias("at"))
    rows = rows.where((F.col("label") != "") & ~F.upper("label").startswith("LABEL_"))
    # written, so that the spans are found once for the counts and the samples
    texts = written(rows.groupBy(*keys, "t").agg(F.count("*").alias("n"), F.min("at").alias("at")))
    first = Window.partitionBy(*keys).orderBy("at")
    top = (texts.where("t != ''").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= samples)
           .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "t"))).alias("picked")))
    counts = texts.groupBy(*keys).agg(F.sum("n").alias("count"))
    return (counts.join(top, keys, "left")
            .select(*keys, "count", F.coalesce(F.array_join(F.transform("picked", lambda p: p["t"]), " | "), F.lit("")).alias("examples"))
            .orderBy(*by, F.desc("count"), "label"))


def totals(spans: DataFrame) -> DataFrame:
    """Total, per source and per label in one pass."""
    return (spans.select("source", "label").groupingSets([[], ["source"], ["label"]], "source", "label")
            .agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))
            .select(F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "source").otherwise("label").alias("kind"),
                    F.when(F.col("gid") == 1, F.col("source")).when(F.col("gid") == 2, F.col("label")).alias("name"), "n"))


def by_category(spans: Column) -> Column:
    """One document's spans grouped by ``label (subtype)``: ``array<struct<category,items>>``."""
    def category(s: Column) -> Column:
        return F.concat(s["label"], F.when(F.coalesce(s["subtype"], F.lit("")) != "", F.concat(F.lit(" ("), s["subtype"], F.lit(")"))).otherwise(""))

    return F.transform(F.array_distinct(F.transform(spans, category)), lambda c: F.struct(
        c.alias("category"),
        F.transform(F.filter(spans, lambda s: category(s) == c), lambda s: F.struct(
            s["text"].alias("text"), position_label(s["start"], s["end"]).alias("position"), s["source"].alias("source"),
            percent_label(s["score"]).alias("confidence"))).alias("items")))


def source_share(spans: DataFrame) -> DataFrame:
    # the window holds one row per source, after counting
    counts = spans.groupBy("source").agg(F.count("*").alias("n"))
    return counts.select("source", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))) * 100).alias("share"))


def label_histogram(spans: DataFrame) -> DataFrame:
    return spans.groupBy(F.coalesce(F.nullif(F.col("label_adjusted"), F.lit("")), F.col("label")).alias("label")).agg(F.count("*").alias("n"))


def run_history(runs: DataFrame) -> DataFrame:
    """One row over all runs: ``success``, ``processing_time``, ``audio_duration``, ``transcript_length``."""
    sums = runs.agg(F.count("*").alias("files"), F.count_if("success").alias("succeeded"), F.sum("processing_time").alias("total_time"),
                    F.sum("audio_duration").alias("total_audio"), F.sum("transcript_length").alias("total_chars"))
    speed = F.coalesce(F.try_divide("total_audio", "total_time"), F.lit(0.0))
    return sums.select(
        "files", (F.try_divide("succeeded", "files") * 100).alias("success_percent"), "total_time", "total_audio", "total_chars",
        F.coalesce(F.try_divide("total_chars", "files"), F.lit(0.0)).alias("average_chars"), speed.alias("speed"), (speed * 3600).alias("throughput"))


def run_rows(runs: DataFrame, *keep: str) -> DataFrame:
    return runs.select(*keep, "success", "processing_time", "audio_duration", "transcript_length", F.when(
        F.col("processing_time") > 0, F.col("audio_duration") / F.col("processing_time")).otherwise(0.0).alias("speed"))


def chunk_stats(results: DataFrame, *keys: str) -> DataFrame:
    """Per recording: chunks, successes, failures, retries, rate, verdicts."""
    ok = F.col("success")
    return results.groupBy(*keys).agg(
        F.count("*").alias("total_chunks"), F.count_if(ok).alias("success_chunks"), F.count_if(~ok).alias("failed_chunks"),
        F.sum("retry_count").alias("retry_count"), F.sum("duration").alias("total_duration"),
        (F.count_if(ok) / F.count("*")).alias("success_rate"), ((F.count_if(ok) / F.count("*")) > 0.5).alias("mostly_ok"),
        (F.count_if(ok) > 0).alias("any_ok"))


def chunk_details(results: DataFrame, *keys: str) -> DataFrame:
    return results.select(*keys, "chunk_index", "success", F.when(F.col("success"), F.length("text")).otherwise(0).alias("text_length"), "retry_count")


def mode_table(results: DataFrame) -> DataFrame:
    """Test runs per mode: ``mode, success, duration`` rows to totals, rate and time per chunk."""
    return results.groupBy("mode").agg(
        F.count_if("success").alias("success_count"), F.count("*").alias("total_chunks"), F.count_if(~F.col("success")).alias("fail_count"),
        F.sum("duration").alias("total_time"), (F.sum("duration") / F.count("*")).alias("time_per_chunk"),
        (F.count_if("success") / F.count("*") * 100).alias("success_rate"))


def best_mode(modes: DataFrame) -> DataFrame:
    """The fastest mode among those without failures."""
    return modes.where("success_count = total_chunks").agg(F.min_by("mode", F.struct("total_time", "mode")).alias("mode"), F.min("total_time").alias("total_time"))


def remaining_time(results: DataFrame, keys: Sequence[str], order: str = "chunk_index") -> DataFrame:
    """After each finished chunk: average positive duration so far times the chunks still open."""
    numbered = positions(results, keys, [order], "_pos").withColumn("_d", F.greatest("duration", F.lit(0.0)))
    summed = running(numbered, keys, [order], {"_spent": ("sum", "_d")})
    total = results.groupBy(*keys).agg(F.count("*").alias("_total"))
    done = F.col("_pos") + 1
    return summed.join(total, list(keys)).withColumn(
        "eta_seconds", F.floor((F.col("_total") - done) * (F.col("_spent") / done))).drop("_pos", "_d", "_spent", "_total")


def time_estimates(chunks: Column, delay: float = 1.0) -> Column:
    return chunks * (L.SECONDS_PER_CHUNK + delay)


def parallel_saving(elapsed: Column) -> Column:
    """What the two-worker mode is said to save: the doubled time less the elapsed one."""
    return elapsed * 2 - elapsed


def latest(runs: DataFrame, order: str, n: int = 5) -> DataFrame:
    return runs.orderBy(F.desc(order)).limit(n)
