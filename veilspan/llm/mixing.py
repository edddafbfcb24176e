"""Mixing sources to target weights by Poisson replication.

A document of a source whose mean repetition rate is ``r`` appears ``k`` times, where ``k`` is
drawn from a Poisson distribution of mean ``r`` by inverting its distribution function at a
hash of the seed and the document's id.  The draw needs no shared state: any executor, and any
retry, finds the same ``k``.  Copies are then dealt over the cluster by a second hash, so their
order is a uniform global shuffle.  Everything is built from column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.session import written

from .common import fraction, known_small

#: A larger mean is drawn as a sum of independent draws of at most this mean.
MEAN_PER_DRAW = 32.0


def target_rates(docs: DataFrame, weights: dict[str, float] | None = None, *, alpha: float = 0.5,
                 epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """``(source, bytes, rate)``: the mean repetition rate that gives each source its target share.

    Shares are ``weights`` (normalised over the sources that occur; a source without a weight has
    rate 0), or, without weights, proportional to ``bytes ** alpha`` (1: as found, 0: all equal).
    The mix has ``epochs`` times the bytes of the input.  A source without any text has rate 1,
    since repetition cannot change its share.  Null is a source of its own.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")).alias("bytes"))
    if weights is None:
        share = F.pow(F.col("bytes").cast("double"), F.lit(float(alpha)))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(share)
    shares = sizes.select("*", F.when(F.col("bytes") > 0, share).otherwise(0.0).alias("_share"))
    # the window holds one row per source, after counting
    every = Window.partitionBy(F.lit(1))
    both = shares.withColumns({"_bytes": F.sum("bytes").over(every), "_shares": F.sum("_share").over(every)})
    rate = F.when(F.col("bytes") == 0, 1.0).when(F.col("_shares") == 0, 0.0).otherwise(
        F.lit(float(epochs)) * F.col("_bytes") * F.col("_share") / F.col("_shares") / F.col("bytes"))
    return both.select("source", "bytes", rate.alias("rate"))


def distribution(mean: Column) -> Column:
    """``P(X <= k)`` for k = 0, 1, ... of a Poisson variable, until the rest is below 2**-52."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    step = lambda a, k: F.struct(
        (a["p"] * mean / k).alias("p"),
        F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * mean / k)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]


def replicate(docs: DataFrame, rates: DataFrame, *, seed: int = 0, key: str = "doc_id", source: str = "source",
              partitions: int | None = None) -> DataFrame:
    """Every document as often as its draw says, globally shuffled.

    Adds ``copy`` (0, 1, ...), ``copies``, ``rate`` and ``order_key`` (sorting by it gives the
    shuffled order) to the columns of ``docs``; input columns of these names are replaced.
    Documents of a source that ``rates`` lacks have rate 0.  Rows with equal ids (null is an id)
    get equal draws.  Null and empty texts are replicated like any other; an empty
    table gives an empty result.
    """
    draws = F.greatest(F.ceil(F.col("rate") / MEAN_PER_DRAW), F.lit(1)).cast("int")
    # written, so that counting its rows and joining them do not measure the documents twice
    table = written(rates.select(F.col("source").alias("_source"), "rate", draws.alias("_draws"),
                                 distribution(F.col("rate") / draws).alias("_cdf")))
    plain = docs.drop("copy", "copies", "rate", "order_key")
    # at most one row per source; a large side of sources is joined by a shuffle, with skew handled there
    joined = plain.join(known_small(table, 10_000), F.col(source).eqNullSafe(F.col("_source")))
    points = F.transform(F.sequence(F.lit(1), F.col("_draws")), lambda i: fraction(F.col(key), i, seed=seed))
    one = lambda u: F.size(F.filter("_cdf", lambda c: c <= u))
    copies = F.aggregate(F.transform(points, one), F.lit(0), lambda a, x: a + x)
    counted = joined.withColumn("copies", copies).drop("_cdf", "_draws", "_source").where("copies > 0")
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    keyed = each.withColumn("order_key", fraction(F.col(key), F.col("copy"), seed=seed + 1))
    dealt = keyed.repartition(partitions, "order_key") if partitions else keyed.repartition("order_key")
    return dealt.sortWithinPartitions("order_key")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, alpha: float = 0.5, epochs: float = 1.0,
        seed: int = 0, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``replicate`` with the rates of ``target_rates``."""
    rates = target_rates(docs, weights, alpha=alpha, epochs=epochs, source=source, text=text)
    return replicate(docs, rates, seed=seed, key=key, source=source)
