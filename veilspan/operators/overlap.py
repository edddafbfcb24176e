"""Overlap resolution on span arrays.

Each rule is a fold over the sorted array of one document; the number of spans is bounded by
the document's own text, so no rule needs a shuffle or a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.arrays import change, final_label, lookup, no_spans, overlaps, sort_stable
from ..plans.ordered import running
from ..schemas import SPAN

#: Characters of a document whose spans one task sweeps together.
POSITIONS_PER_BLOCK = 4096

def _length(s: Column) -> Column:
    return s["end"] - s["start"]


def _by_start_longest(s: Column) -> list[Column]:
    return [s["start"], -_length(s)]


def prune_contained(spans: Column) -> Column:
    """Drop spans inside an earlier-starting or longer one; array order breaks ties.

    Sorted by start, a span is contained in a kept one iff it does not reach past the furthest
    end so far.
    """
    start = F.struct(F.lit(-1).alias("reach"), no_spans().alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["end"] > acc["reach"], F.struct(
            s["end"].alias("reach"), F.array_append(acc["kept"], s).alias("kept"))).otherwise(acc)

    return F.aggregate(sort_stable(spans, _by_start_longest), start, step, lambda acc: acc["kept"])


def prune_contained_rows(spans: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """The same rule over a span table, as one window."""
    w = (Window.partitionBy(*keys).orderBy(F.col("start"), (F.col("end") - F.col("start")).desc(), F.col(order))
         .rowsBetween(Window.unboundedPreceding, -1))
    return (spans.withColumn("_reach", F.max("end").over(w))
            .where(F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_reach"))


def greedy_longest(spans: Column) -> Column:
    """Left to right, longest first at equal start; anything overlapping the last kept span goes."""
    start = F.struct(F.lit(-1).alias("last"), no_spans().alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["start"] >= acc["last"], F.struct(
            s["end"].alias("last"), F.array_append(acc["kept"], s).alias("kept"))).otherwise(acc)

    return F.aggregate(sort_stable(spans, _by_start_longest), start, step, lambda acc: acc["kept"])


def strict_label(label: Column) -> Column:
    """One of the standard labels or null."""
    trimmed = F.trim(label)
    known = F.coalesce(lookup(L.STRICT_ALIASES, trimmed), trimmed)
    return F.when(trimmed.isin(L.LABELS), trimmed).when(known.isin(L.LABELS), known)


def verdict_priority(label: Column) -> Column:
    return F.coalesce(lookup(L.VERDICT_PRIORITY, label), F.lit(0))


def best_per_range(spans: Column) -> Column:
    """One span per (start, end): highest label priority, first on ties; keeps first-seen order."""
    ranked = sort_stable(spans, lambda s: [s["start"], s["end"], -verdict_priority(s["label_adjusted"])])
    # after the sort the winner of every range comes first
    start = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), no_spans().alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        return F.when((s["start"] == acc["s"]) & (s["end"] == acc["e"]), acc).otherwise(F.struct(
            s["start"].alias("s"), s["end"].alias("e"), F.array_append(acc["kept"], s).alias("kept")))

    return F.aggregate(ranked, start, step, lambda acc: acc["kept"])


def _against_last(ordered: Column, item: str, wins: Callable[[Column, Column], Column]) -> Column:
    """Left-to-right fold for items sorted by start: an overlapping item replaces or yields.

    Kept items are disjoint and start no later than the current one, so only the last of them
    can overlap it; the rules need to look no further back.
    """
    begin = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(None).cast(item).alias("last"))

    def step(acc: Column, c: Column) -> Column:
        a, b = _interval(c), _interval(acc["last"])
        return (F.when(acc["last"].isNull(), F.struct(acc["done"].alias("done"), c.alias("last")))
                .when(~overlaps(a, b), F.struct(F.array_append(acc["done"], acc["last"]).alias("done"), c.alias("last")))
                .when(wins(c, acc["last"]), F.struct(acc["done"].alias("done"), c.alias("last")))
                .otherwise(acc))

    return F.aggregate(ordered, begin, step, lambda acc: F.when(
        acc["last"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["last"])))


_RANKED = f"struct<span:{SPAN},rank:int>"


def _interval(item: Column) -> Column:
    return item["span"]


def _ranked(spans: Column, rank: Callable[[Column], Column]) -> Column:
    return F.transform(spans, lambda s: F.struct(s.alias("span"), rank(s).cast("int").alias("rank"))).cast(f"array<{_RANKED}>")


def _unranked(items: Column) -> Column:
    return F.transform(items, lambda r: r["span"])


def resolve_partial(spans: Column) -> Column:
    """Priority times ``log1p(length)`` against the overlapping kept span; the winner takes its place."""
    def weight(r: Column) -> Column:
        return r["rank"] * F.log1p(_length(r["span"]))

    ordered = sort_stable(_ranked(spans, lambda s: verdict_priority(s["label_adjusted"])),
                          lambda r: [r["span"]["start"], r["span"]["end"]])
    return _unranked(_against_last(ordered, _RANKED, lambda c, k: weight(c) > weight(k)))


def resolve_verdicts(spans: Column, length: Column) -> Column:
    """Clean, one span per range, then resolve partial overlaps."""
    relabelled = F.transform(spans, lambda s: change(s, label_adjusted=strict_label(final_label(s))))
    valid = F.filter(relabelled, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= length)
                     & s["label_adjusted"].isNotNull())
    return resolve_partial(best_per_range(valid))


def merge_priority(label: Column, subtype: Column) -> Column:
    """Exact (label, subtype) entry, then the label's general entry, then the default."""
    exact = {f"{lab}\x00{sub or ''}": p for (lab, sub), p in L.MERGE_PRIORITY.items()}
    general = {lab: p for (lab, sub), p in L.MERGE_PRIORITY.items() if sub is None}
    key = F.concat(label, F.lit("\x00"), F.coalesce(subtype, F.lit("")))
    return F.coalesce(lookup(exact, key), lookup(general, label), F.lit(L.DEFAULT_PRIORITY))


def interval_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    inter = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    union = (a_end - a_start) + (b_end - b_start) - inter
    return F.when(union == 0, 0.0).otherwise(inter / union)


def merge_by_priority(spans: Column) -> Column:
    """Higher priority wins; near-identical spans of one label compare by score."""
    filled = F.transform(spans, lambda s: change(
        s, label_adjusted=F.coalesce(s["label_adjusted"], s["label"]), score=F.coalesce(s["score"], F.lit(0.0))))
    ordered = sort_stable(_ranked(filled, lambda s: merge_priority(final_label(s), s["subtype"])),
                          lambda r: [r["span"]["start"], -r["rank"], -_length(r["span"])])

    def wins(c: Column, k: Column) -> Column:
        a, b = c["span"], k["span"]
        near = (a["label_adjusted"] == b["label_adjusted"]) & (interval_iou(a["start"], a["end"], b["start"], b["end"]) >= 0.7)
        return F.when(near, a["score"] > b["score"]).otherwise(c["rank"] > k["rank"])

    return _unranked(_against_last(ordered, _RANKED, wins))


def merge_source_first(spans: Column, primary_source: str = "ner") -> Column:
    """Spans of the primary source replace overlapping others; otherwise the kept span stays."""
    ordered = sort_stable(_ranked(spans, lambda s: F.when(s["source"] == primary_source, 0).otherwise(1)),
                          lambda r: [r["span"]["start"], r["rank"], -_length(r["span"])])
    return _unranked(_against_last(ordered, _RANKED, lambda c, k: c["rank"] < k["rank"]))


def uncovered(spans: Column, cover: Column) -> Column:
    """Spans none of whose characters is covered by ``cover``."""
    return F.filter(spans, lambda s: ~F.exists(cover, lambda c: overlaps(s, c)))


def uncovered_rows(spans: DataFrame, cover: DataFrame, *keys: str) -> DataFrame:
    """Anti join on overlap over span tables, as a sweep over both sides together.

    Bounds are integers.  A cover span overlaps a span exactly if, of the cover spans that start before the
    span's end, one ends after its start.  So at the end of every span the furthest end of the
    cover so far decides, which is one running maximum per document, in blocks of positions: no
    pair is made, and no document is one task.  Spans without a length, on either side, overlap
    what reaches over their place.  Rows with a null bound or key overlap nothing.
    """
    names = spans.columns
    whole = F.lit(True)
    for name in (*keys, "start", "end"):
        whole = whole & F.col(name).isNotNull()
    asked = spans.where(whole).withColumn("_span", F.struct(*names)).select(
        *keys, F.col("end").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_far"), "_span")
    given = cover.where(whole).select(*keys, F.col("start").alias("_at"), F.lit(1).alias("_kind"), F.col("end").cast("long").alias("_far"),
                         F.lit(None).cast(asked.schema["_span"].dataType).alias("_span"))
    # a cover span that starts at a span's end is not before it
    swept = running(asked.unionByName(given), keys, ["_at", "_kind"], {"_reach": ("max", "_far")}, width=POSITIONS_PER_BLOCK)
    free = swept.where((F.col("_kind") == 0) & F.coalesce(F.col("_reach") <= F.col("_span.start"), F.lit(True)))
    return free.select("_span.*").unionByName(spans.where(~whole))
