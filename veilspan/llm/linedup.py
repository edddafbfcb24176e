"""Boilerplate lines by distinct-site spread.

A line that stands on many sites is boilerplate.  Every line is reduced to a 128-bit hash; per
hash, a HyperLogLog sketch of its sites is built before the shuffle and merged after it, so the
shuffle carries one small sketch per line and task however often a line occurs.  A sketch is
only an estimate: lines whose estimate is near the threshold get an exact count of distinct
sites, all others are decided by the estimate.  Boilerplate lines are then removed from every
document.  Everything is built from column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.session import written

#: log2 of the registers of a sketch: 256 registers, standard error 6.5 %, exact to about 30 sites.
LOG_REGISTERS = 8
#: An estimate within this share of the threshold (about four standard errors) is counted exactly.
NEAR = 0.27


def line_key(line: Column) -> Column:
    """128-bit key of a line without the blanks around it; null for a blank line."""
    bare = F.trim(line, F.lit(" \t\n\r\x0b\x0c"))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b")))


def line_spread(docs: DataFrame, *, text: str = "text", site: str = "source") -> DataFrame:
    """``(line, n, sketch)`` per line key: occurrences and a sketch of the distinct sites.

    Null sites are not counted; blank lines are left out.
    """
    lines = docs.select(F.col(site).cast("string").alias("site"),
                        F.explode(F.transform(F.split(F.col(text).cast("string"), "\n"), line_key)).alias("line"))
    return lines.where("line is not null").groupBy("line").agg(
        F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch"))


def boilerplate(docs: DataFrame, min_sites: int, *, text: str = "text", site: str = "source") -> DataFrame:
    """Keys of the lines that stand on at least ``min_sites`` distinct sites."""
    spread = line_spread(docs, text=text, site=site).where(F.col("n") >= min_sites)
    estimate = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0))
    found = written(spread.select("line", estimate.alias("sites")).where(estimate >= min_sites * (1 - NEAR)))
    near = found.where(F.col("sites") <= min_sites * (1 + NEAR)).select("line")
    pairs = docs.select(F.col(site).cast("string").alias("site"),
                        F.explode(F.transform(F.split(F.col(text).cast("string"), "\n"), line_key)).alias("line"))
    exact = (pairs.join(near, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one"))
             .groupBy("line").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites))
    return found.where(F.col("sites") > min_sites * (1 + NEAR)).select("line").unionByName(exact.select("line"))


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, *, text: str = "text", site: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``; adds ``n_lines`` and ``n_removed``.

    Lines are the parts between ``\\n``; a removed line goes with one line break.  Blank lines are
    kept.  A null text stays null with 0 lines; an empty one has one (blank) line.  Repeated rows
    are cleaned each.  Input columns of the added names are replaced; an empty table
    stays empty.

    Which lines of a text go depends on the text alone, so the removal is found once per distinct
    text and joined back by a 128-bit hash of it.
    """
    plain = docs.drop("n_lines", "n_removed", "_text", "_gone")
    whole = F.col(text).cast("string")
    hashed = F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit("text"), whole).alias("b"))
    bad = written(boilerplate(docs, min_sites, text=text, site=site))
    lines = plain.where(whole.isNotNull()).select(
        hashed.alias("_text"), F.posexplode(F.transform(F.split(whole, "\n"), line_key)).alias("_at", "line"))
    hits = lines.join(bad, "line", "left_semi").groupBy("_text", "_at").agg(F.lit(1).alias("_one"))
    # written, so that the join's two sides are dealt alike and Spark can split a text with many copies
    gone = written(hits.groupBy("_text").agg(F.collect_list("_at").alias("_gone")))
    joined = plain.withColumn("_text", F.when(whole.isNotNull(), hashed)).join(gone, "_text", "left")
    parts = F.split(whole, "\n")
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone")))
    clean = F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")
    return joined.select(
        *[c for c in plain.columns if c != text],
        F.when(F.col("_gone").isNull(), whole).otherwise(clean).alias(text),
        F.when(whole.isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"))
