"""Ordered computations per key that never put a whole key in one task.

A recording, conversation or user may hold a large share of all rows.  Each helper therefore
cuts a key into blocks of its order column, works inside the blocks, combines the few
per-block results along the key, and joins them back on (key, block).  Window partitions
hold one block of one key, or one row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BLOCK = "_block"
ROWS_PER_BLOCK = 4096
SECOND_LEVEL = 4096


def with_block(df: DataFrame, order: str | Column, width: float = ROWS_PER_BLOCK) -> DataFrame:
    col = F.col(order) if isinstance(order, str) else order
    return df.withColumn(BLOCK, F.floor(col / F.lit(width)).cast("long"))


def _prefix(blocks: DataFrame, keys: Sequence[str], columns: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Exclusive running aggregates over the per-block rows, in two levels."""
    far = F.floor(F.col(BLOCK) / SECOND_LEVEL).alias("_far")
    blocks = blocks.select("*", far)
    inner = Window.partitionBy(*keys, "_far").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(*keys, "_far").agg(*[f(F.col(c)).alias(c) for c, f in columns.items()])
    before = totals.select(*keys, "_far", *[f(F.col(c)).over(outer).alias(f"_far_{c}") for c, f in columns.items()])
    near = blocks.select(*keys, "_far", BLOCK, *[f(F.col(c)).over(inner).alias(f"_near_{c}") for c, f in columns.items()])
    both = near.join(before, [*keys, "_far"])
    return both.select(*keys, BLOCK, *[
        f"_near_{c}" for c in columns], *[f"_far_{c}" for c in columns])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], specs: dict[str, tuple[str, str]],
            inclusive: bool = True, width: float = ROWS_PER_BLOCK, block_on: str | Column | None = None) -> DataFrame:
    """Running ``sum``, ``max`` or ``min`` per key in ``order``.

    ``specs``: output column -> (kind, input column).  ``block_on`` (default: the first order
    column) must be numeric and non-decreasing along the order; ``width`` is its span per block.
    Rows before the first get null unless ``inclusive``.
    """
    kinds = {"sum": F.sum, "max": F.max, "min": F.min}
    first = order[0] if block_on is None else block_on
    blocked = with_block(df, first, width)
    parts = {out: kinds[kind] for out, (kind, _) in specs.items()}
    totals = blocked.groupBy(*keys, BLOCK).agg(*[parts[o](F.col(c)).alias(o) for o, (_, c) in specs.items()])
    carried = _prefix(totals, keys, parts)
    upto = Window.currentRow if inclusive else -1
    w = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    local = blocked.select("*", *[parts[o](F.col(c)).over(w).alias(f"_local_{o}") for o, (_, c) in specs.items()])
    joined = local.join(carried, [*keys, BLOCK])

    def combine(out: str, kind: str) -> Column:
        a, b, c = F.col(f"_local_{out}"), F.col(f"_near_{out}"), F.col(f"_far_{out}")
        if kind == "sum":
            total = F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) + F.coalesce(c, F.lit(0))
            return F.when(F.coalesce(a, b, c).isNotNull(), total)
        return (F.greatest if kind == "max" else F.least)(a, b, c)

    done = joined.select("*", *[combine(o, k).alias(o) for o, (k, _) in specs.items()])
    return done.drop(BLOCK, *[f"_{p}_{o}" for o in specs for p in ("local", "near", "far")])


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "pos",
              width: float = ROWS_PER_BLOCK, block_on: str | Column | None = None) -> DataFrame:
    """Dense 0-based position per key in ``order``."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    counted = running(ones, keys, order, {out: ("sum", "_one")}, True, width, block_on)
    return counted.withColumn(out, F.col(out) - 1).drop("_one")


def neighbours(df: DataFrame, keys: Sequence[str], pos: str, columns: Sequence[str], offset: int,
               prefix: str) -> DataFrame:
    """Columns of the row ``offset`` positions away, by equality on (key, position)."""
    other = df.select(*keys, (F.col(pos) - offset).alias(pos), *[F.col(c).alias(prefix + c) for c in columns])
    return df.join(other, [*keys, pos], "left")


def per_key(df: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``values`` (one row per key); null is a key like others."""
    named = values.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in values.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return df.join(named, same).drop(*[f"_key_{k}" for k in keys])


def _sketch(values: DataFrame, keys: Sequence[str], k: int, *more: Column) -> DataFrame:
    """One mergeable sketch of ``_v`` per key; null without a number."""
    number = F.when(~F.isnan("_v"), F.col("_v"))
    made = values.groupBy(*keys).agg(F.kll_sketch_agg_double(number, F.lit(k)).alias("_made"), F.count(number).alias("_numbers"), *more)
    return made.withColumn("_sketch", F.when(F.col("_numbers") > 0, F.col("_made"))).drop("_made", "_numbers")


def _bracketed(values: DataFrame, keys: Sequence[str], p: float, k: int, slack: float) -> tuple[DataFrame, bool]:
    """Counts of the values around rank ``p`` of each key, and whether both ranks are among them for every key.

    Rows: keys, ``_lo``, ``_hi`` (ranks), ``_frac``, ``_base`` (rows of the key before), ``_v``, ``_m``.
    """
    spot = (F.col("_n") - 1) * F.lit(p)
    # ranks of a sketch must be constants; keys with no more rows than the sketch are taken whole
    low, high, known = p - slack - 2 / k, p + slack + 2 / k, (F.col("_n") > k) & F.col("_sketch").isNotNull()
    at = lambda rank: F.when(known, F.kll_sketch_get_quantile_double("_sketch", F.lit(rank)))
    bounds = _sketch(values, keys, k, F.count("*").alias("_n")).select(
        *keys, F.floor(spot).alias("_lo"), F.ceil(spot).alias("_hi"), (spot - F.floor(spot)).alias("_frac"),
        F.coalesce(at(low) if low > 0 else F.lit(None), F.lit(float("-inf"))).alias("_from"),
        F.coalesce(at(high) if high < 1 else F.lit(None), F.lit(float("nan"))).alias("_to"))
    # a sketch is random: both passes below must see the same bounds
    cut = per_key(values, written(bounds), keys)
    side = F.when(F.col("_v") < F.col("_from"), -1).when(F.col("_v") > F.col("_to"), 1).otherwise(0)
    sides = cut.withColumn("_side", side).where("_side < 1").withColumn("_v", F.when(F.col("_side") == 0, F.col("_v")))
    counts = written(sides.groupBy(*keys, "_lo", "_hi", "_frac", "_side", "_v").agg(F.count("*").alias("_m")))
    inside = F.sum(F.when(F.col("_side") == 0, F.col("_m")).otherwise(0))
    totals = counts.groupBy(*keys, "_lo", "_hi").agg(F.sum(F.when(F.col("_side") < 0, F.col("_m")).otherwise(0)).alias("_base"), inside.alias("_in"))
    missed = totals.where((F.col("_base") > F.col("_lo")) | (F.col("_base") + F.col("_in") <= F.col("_hi")))
    kept = per_key(counts.where("_side = 0").drop("_side"), totals.select(*keys, "_base"), keys)
    return kept, missed.isEmpty()


def _narrowed(left: DataFrame, keys: Sequence[str], k: int, cuts: int) -> DataFrame:
    """Of the counted values those in the stretches, between sketched cuts, that hold the two ranks."""
    ranks = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    points = written(_sketch(left, keys, k).select(*keys, F.kll_sketch_get_quantile_double("_sketch", ranks).alias("_cuts")))
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.lit(0))
    cut = per_key(left, points, keys).withColumn("_part", part).drop("_cuts")
    sums = cut.groupBy(*keys, "_part", "_lo", "_hi", "_base").agg(F.sum("_m").alias("_in"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_start", F.col("_base") + F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
    near = sums.where((F.col("_start") <= F.col("_hi")) & (F.col("_start") + F.col("_in") > F.col("_lo")))
    first = near.withColumn("_base", F.min("_start").over(Window.partitionBy(*keys))).select(*keys, "_part", "_base")
    return per_key(cut.drop("_base"), first, [*keys, "_part"]).drop("_part")


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, p: float, out: str = "quantile",
                   per_bucket: int = 65536, k: int = 1024, cuts: int = 64) -> DataFrame:
    """Linearly interpolated quantile per key; exact, in two passes over ``df``.

    The first pass makes a mergeable sketch of ``k`` per key, which brackets the two ranks around ``p``; the
    second counts the rows below the bracket and every value inside it.  The counts prove the bracket; should
    one have missed, all are widened fourfold.  Values that share a magnitude or lie hundreds of them
    apart make no difference, as only their order counts.  While a key has more than ``per_bucket`` values in
    its bracket, sketches cut it into ``cuts`` stretches and the one or two that hold the ranks go on.

    Nulls are no values; a key without any has no row.  NaN is larger than every number, as in Spark's order.
    """
    keys = list(keys)
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    # three times the rank error that such a sketch keeps within in 99 of 100 cases
    slack, sure = 3 * 2.296 / k ** 0.9723, False
    while not sure:
        left, sure = _bracketed(values, keys, p, k, slack)
        slack *= 4
    sizes = left.groupBy(*keys).agg(F.count("*").alias("n"))
    while (sizes.agg(F.max("n")).first()[0] or 0) > max(per_bucket, 2):
        left = written(_narrowed(left, keys, k, cuts))
        sizes = left.groupBy(*keys).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = left.withColumn("_last", F.col("_base") + F.sum("_m").over(w) - 1).withColumn("_first", F.col("_last") - F.col("_m") + 1)
    at = lambda r: F.max(F.when(F.col(r).between(F.col("_first"), F.col("_last")), F.col("_v")))
    picked = ranked.groupBy(*keys).agg(at("_lo").alias("_a"), at("_hi").alias("_b"), F.max("_frac").alias("_f"))
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")
    return picked.select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias(out))


def documents_from_lines(lines: DataFrame, keys: Sequence[str], pos: str, line: str, out: str = "text") -> DataFrame:
    """Concatenate lines (each carrying its own separator), one text per key.

    The ordered line rows are the form for keys of any length; a text is a single value, so a
    task holds one text at a time, like any row.
    """
    grouped = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(pos, line))).alias("_lines"))
    return grouped.select(*keys, F.array_join(F.transform("_lines", lambda x: x[line]), "").alias(out))
