"""Sharding by minimax contiguous partition.

Equal texts form atomic groups.  The groups stand in the order of a hash of their text, and the
shards are consecutive stretches of that order.  The smallest capacity for which the groups fit
into the given number of shards is found by binary search; a capacity is checked by filling
shards greedily; the cuts are those of the greedy filling at the smallest capacity.

The order may have more groups than the driver could hold, so prefix sums are kept for a bounded
number of stretches only.  The same search over them gives a lower bound (cuts anywhere) and an
upper bound (cuts between stretches only) of the capacity; only the stretches in which a cut
could fall at a capacity between the two are divided further, until those hold single groups and
the bounds meet.  Each round is one aggregation; the number of rounds grows with the logarithm
of the number of groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.session import written

#: Added to the bytes of every text: the cost of a row without its text.
ROW_BYTES = 16
#: Groups stand on 2**POSITION_BITS places of the hash order; groups on one place stay together.
POSITION_BITS = 56
#: Most stretches that are known at one time, and most groups that the driver takes at once.
STRETCHES = 1 << 16
#: Rows of a shard are numbered in so many blocks.
BLOCKS = 1024


def measured(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Adds ``size`` (UTF-8 bytes plus ``ROW_BYTES``), ``text_crc32`` and ``place`` to ``docs``.

    A null text has the bytes and place of an empty one, so null and empty texts are one group.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    digits = POSITION_BITS // 4
    return docs.drop("size", "text_crc32", "place").select(
        "*", (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"),
        F.conv(F.substring(F.md5(whole), 1, digits), 16, 10).cast("long").alias("place"))


def _greedy(ends: np.ndarray, solid: np.ndarray, capacity: int, shards: int, anywhere: bool) -> tuple[bool, list[int]]:
    """Fill shards greedily; ``ends``: bytes up to the end of each stretch.

    With ``anywhere`` a cut may fall inside a stretch that is not solid (may hold several groups).
    Returns whether everything fits, and the bytes up to each cut.
    """
    total, at, cuts = int(ends[-1]), 0, []
    for _ in range(shards):
        if at >= total:
            break
        reach = min(at + capacity, total)
        k = int(np.searchsorted(ends, reach, side="right"))  # stretches that end within reach
        whole = int(ends[k - 1]) if k else 0
        if anywhere and whole < reach and not solid[k]:
            whole = reach
        if whole <= at:
            return False, cuts
        at = whole
        cuts.append(at)
    return at >= total, cuts


def _smallest(ends: np.ndarray, solid: np.ndarray, shards: int, anywhere: bool, low: int) -> int:
    high = int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if _greedy(ends, solid, middle, shards, anywhere)[0]:
            high = middle
        else:
            low = middle + 1
    return low


def contiguous_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Places at which shards 1, 2, ... begin, and the capacity of the largest shard.

    ``groups``: ``(place, bytes)`` with distinct places and positive bytes.  Fewer cuts than
    ``shards - 1`` come back when fewer shards hold everything.
    """
    facts = groups.agg(F.sum("bytes"), F.max("bytes"), F.count("*")).first()
    if not facts[0] or shards < 2:
        return [], int(facts[0] or 0)
    total, largest = int(facts[0]), int(facts[1])
    # stretch i holds the places from edges[i] up to edges[i + 1] and all its groups agree above levels[i] bits
    edges, levels = np.array([0, 1 << POSITION_BITS], dtype=object), np.array([POSITION_BITS])
    sums, solid = np.array([total], dtype=np.int64), np.array([facts[2] == 1])
    split = np.array([True])
    while True:
        edges, levels, sums, solid = _divided(groups, edges, levels, sums, solid, split)
        ends = np.cumsum(sums)
        low = max(-(-total // shards), largest)
        low = _smallest(ends, solid, shards, True, low)
        high = _smallest(ends, solid, shards, False, low)
        # at any capacity between the bounds, cut j lies between these two places
        split = np.zeros(len(sums), dtype=bool)
        below = above = 0
        for _ in range(shards - 1):
            k = int(np.searchsorted(ends, below + low, side="right"))
            below = max(below, int(ends[k - 1]) if k else 0)
            above = min(above + high, total)
            split[int(np.searchsorted(ends, below, side="left")):int(np.searchsorted(ends, above, side="left")) + 1] = True
        split &= ~solid & (sums > 0)
        if low == high:
            fits, cuts = _greedy(ends, solid, high, shards, False)
            # the greedy cut may lie inside a stretch that is not solid; then look closer
            exact = _greedy(ends, solid, high, shards, True)[1]
            if fits and cuts == exact:
                at = np.searchsorted(ends, np.array(cuts[:-1], dtype=np.int64), side="left")
                return [int(edges[i + 1]) for i in at], high
        if not split.any():
            raise AssertionError("no stretch is left to divide")


def _divided(groups: DataFrame, edges: np.ndarray, levels: np.ndarray, sums: np.ndarray, solid: np.ndarray, split: np.ndarray):
    """Divide the marked stretches: into their groups when those are few, else evenly in places."""
    marked = np.flatnonzero(split)
    wanted = None
    for level in sorted({int(levels[i]) for i in marked}):
        part = groups
        if level < POSITION_BITS:
            # as many rows as stretches, which are bounded
            cells = [(int(edges[i]) >> level,) for i in marked if levels[i] == level]
            known = groups.sparkSession.createDataFrame(cells, "cell long")
            part = groups.withColumn("cell", F.shiftright("place", level)).join(F.broadcast(known), "cell", "left_semi").drop("cell")
        wanted = part if wanted is None else wanted.unionByName(part)
    few = wanted.limit(STRETCHES + 1).count() <= STRETCHES
    # cells are powers of two wide and shrink, so no cell reaches over an earlier edge
    widest, most = max(int(levels[i]) for i in marked), max(STRETCHES, 16 * len(marked))
    bits = 0
    while not few and len(marked) << (widest - bits) > most:
        bits += 1
    cell = F.shiftleft(F.shiftright("place", bits), bits)
    parts = wanted.groupBy(cell.alias("first")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    rows = sorted(tuple(r) for r in parts.select("first", "bytes", "n").collect())
    out: list[tuple[int, int, int, bool]] = []
    at = 0
    for i in range(len(sums)):
        if not split[i]:
            out.append((edges[i], int(levels[i]), int(sums[i]), bool(solid[i])))
            continue
        start = edges[i]
        while at < len(rows) and rows[at][0] < edges[i + 1]:
            first, size, n = rows[at]
            out.append((int(first), min(bits, int(levels[i])), int(size), n == 1))
            at += 1
        if out[-1][0] < start:
            raise AssertionError("a marked stretch holds no group")
    new_edges, new_levels, new_sums, new_solid = zip(*out, strict=True)
    return (np.array([*new_edges, edges[-1]], dtype=object), np.array(new_levels), np.array(new_sums, dtype=np.int64), np.array(new_solid))


def plan(groups: DataFrame, shards: int) -> tuple[dict[int, int], list[int], int]:
    """Shards of single large groups (by place), cuts for all others, and the first shard of those.

    A group with at least the mean bytes of a shard takes a shard of its own, the largest first:
    it would decide the capacity alone and leave the last shards empty.  The rest is cut evenly.
    """
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: dict[int, int] = {}
    for place, size in groups.orderBy(F.desc("bytes"), "place").limit(shards - 1).select("place", "bytes").collect():
        left = shards - len(alone)
        if left < 2 or size * left < total:
            break
        alone[int(place)] = len(alone)
        total -= size
    rest = groups.where(~F.col("place").isin(list(alone))) if alone else groups
    cuts, _ = contiguous_cuts(rest, shards - len(alone))
    return alone, cuts, len(alone)


def _stretch(cuts: list[int], first: int, place: Column) -> Column:
    """``first`` plus the number of cuts up to ``place``, by halving."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    below, above = _stretch(cuts[:half], first, place), _stretch(cuts[half + 1:], first + half + 1, place)
    return F.when(place < cuts[half], below).otherwise(above)


def assign(docs: DataFrame, shards: int = 40, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Rows of equal text share a shard; within a shard slots are 0, 1, ... without a gap.  Sizes of
    shards are as near equal as the order of groups allows.  Repeated rows get slots of their own,
    null keys are numbered like others, an empty table gives an empty result.  Input columns of
    the added names are replaced.

    Slots are numbered within blocks of a shard and the blocks are then counted through, so no
    task holds a shard; the blocks are dealt by a hash of the key and the text's checksum.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    added = ("size", "text_crc32", "place", "shard", "slot", "_block", "_before", "_in_block")
    plain = docs.drop(*added)
    groups = written(measured(plain, text=text).groupBy("place").agg(F.sum("size").alias("bytes")))
    alone, cuts, first = plan(groups, shards)
    place = F.col("place")
    shard = _stretch(cuts, first, place)
    for where, number in alone.items():
        shard = F.when(place == where, number).otherwise(shard)
    dealt = measured(plain, text=text).withColumn("shard", shard.cast("int"))
    blocked = dealt.withColumn("_block", F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(BLOCKS)).cast("int"))
    # the rows are narrow here unless the caller asks for the text
    inner = Window.partitionBy("shard", "_block").orderBy(key, "text_crc32", "size")
    numbered = blocked.withColumn("_in_block", F.row_number().over(inner) - 1)
    counts = blocked.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    outer = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = written(counts.select("shard", "_block", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_before")))
    # at most shards * BLOCKS rows, so the size of this side has a proven bound
    known = F.broadcast(before) if shards * BLOCKS <= 1 << 20 else before
    joined = numbered.join(known, ["shard", "_block"])
    return joined.select(*plain.columns, "size", "text_crc32", "shard", (F.col("_before") + F.col("_in_block")).cast("long").alias("slot"))
