"""Greedy chains: which rows does a left-to-right scan with jumps land on?

Greedy segmentation and stitching share one shape: from an accepted position the scan jumps to
the next accepted one, and the jump depends only on rows near the current one.  Finding the
landed-on rows of a key looks sequential, but jumps compose: inside a block of positions every
entry leads to one exit, and only rows that a jump from another block lands on can be entries.
Blocks are solved in parallel, their few (entry, exit) pairs form a shorter chain that is
solved the same way, and each block is then walked from its own entry.

Inside a block the jumps are an array.  Applying it to itself doubles their reach, so a few
rounds give the exit of every position, and a path grows by its own image under the jumps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import positions

#: Positions of a key in one block.
WIDTH = 1024
#: A jump out of the rows of a key.
NOWHERE = -1


def _inside(jumps: Column, base: Column, at: Column) -> Column:
    return (at >= base) & (at < base + F.size(jumps))


def _follow(jumps: Column, base: Column, at: Column) -> Column:
    """Where the jumps of a block lead from ``at``; a place outside the block stays."""
    return F.when(_inside(jumps, base, at), F.get(jumps, (at - base).cast("int"))).otherwise(at)


def _doubled(jumps: Column, base: Column) -> Column:
    return F.transform(jumps, lambda to: _follow(jumps, base, to))


def exits(jumps: Column, base: Column, width: int = WIDTH) -> Column:
    """For every position of a block the first place outside it that its jumps lead to.

    ``jumps``: targets of the positions ``base``, ``base + 1``, ...; at most ``width`` of them.
    """
    rounds = F.sequence(F.lit(1), F.lit(width.bit_length()))
    return F.aggregate(rounds, jumps, lambda now, _: _doubled(now, base))


def path(jumps: Column, base: Column, entry: Column, width: int = WIDTH) -> Column:
    """The positions of a block that its jumps visit from ``entry``, in no particular order."""
    start = F.struct(F.array(entry).alias("seen"), jumps.alias("jumps"))

    def step(acc: Column, _: Column) -> Column:
        further = F.transform(acc["seen"], lambda at: _follow(acc["jumps"], base, at))
        return F.struct(F.concat(acc["seen"], F.filter(further, lambda at: _inside(jumps, base, at))).alias("seen"),
                        _doubled(acc["jumps"], base).alias("jumps"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(width.bit_length())), start, step, lambda acc: acc["seen"])


def landed(jumps: DataFrame, keys: Sequence[str], width: int = WIDTH) -> DataFrame:
    """Rows ``(keys, pos)`` visited from position 0 by following ``nxt``.

    ``jumps``: one row per (keys, pos), positions dense from 0, with ``nxt > pos``; a ``nxt`` that
    is no row ends the chain.  Every level shortens a key's chain to the places where it enters
    a block; there are as many levels as it takes until no key has more than ``width`` left.
    """
    keys = list(keys)
    return _visited(cut_lineage(jumps.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("nxt").cast("long").alias("nxt"))), keys, width)


def _visited(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    def block(column: str) -> Column:
        return F.floor(F.col(column) / width).cast("long")

    last = rows.agg(F.max("pos")).first()[0] or 0
    gathered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "nxt"))), lambda r: r["nxt"])
    blocks = rows.groupBy(*keys, block("pos").alias("blk")).agg(gathered.alias("jumps")).withColumn("base", F.col("blk") * width)
    if last < width:
        entries = blocks.withColumn("entry", F.lit(0).cast("long"))
    else:
        blocks = cut_lineage(blocks)
        crossing = rows.where((block("nxt") != block("pos")) & (F.col("nxt") >= 0)).select(*keys, F.col("nxt").alias("pos"))
        doors = crossing.unionByName(rows.where("pos = 0").select(*keys, "pos")).distinct()
        by_block = doors.groupBy(*keys, block("pos").alias("blk")).agg(F.collect_list("pos").alias("doors"))
        led = by_block.join(blocks.withColumn("jumps", exits(F.col("jumps"), F.col("base"), width)), [*keys, "blk"])
        # a place after the last row is in no block or beyond the positions of its block
        real = F.filter("doors", lambda at: _inside(F.col("jumps"), F.col("base"), at))
        pairs = led.select(*keys, F.explode(F.transform(real, lambda at: F.struct(
            at.alias("pos"), _follow(F.col("jumps"), F.col("base"), at).alias("nxt")))).alias("p")).select(*keys, "p.*")
        numbered = cut_lineage(positions(pairs, keys, ["pos"], "id", width))
        targets = numbered.select(*keys, F.col("pos").alias("nxt"), F.col("id").alias("next_id"))
        shorter = numbered.join(targets, [*keys, "nxt"], "left").select(
            *keys, F.col("id").alias("pos"), F.coalesce("next_id", F.lit(NOWHERE)).cast("long").alias("nxt"))
        reached = _visited(cut_lineage(shorter), keys, width).withColumnRenamed("pos", "id")
        # a chain enters a block once
        entered = reached.join(numbered.select(*keys, "id", F.col("pos").alias("entry")), [*keys, "id"]).select(
            *keys, block("entry").alias("blk"), "entry")
        entries = blocks.join(entered, [*keys, "blk"])
    seen = path(F.col("jumps"), F.col("base"), F.col("entry"), width)
    return entries.select(*keys, F.explode(seen).alias("pos"))
