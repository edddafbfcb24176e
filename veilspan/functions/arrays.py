"""Helpers for arrays of structs kept on a document row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SPAN_FIELDS, SPANS


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it appears.

    Inside lambdas Spark evaluates an expression at every mention, so anything costlier than a
    column reference is bound to a lambda variable first.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def each(df: DataFrame, items: str | Column, *keep: str, name: str = "s", position: str | None = None) -> DataFrame:
    """One row per array element.

    A plain ``explode`` of a computed column makes the optimizer add a size filter and push it,
    with the whole computation inlined, down to the scan.  The outer form does not.
    """
    spread = F.posexplode_outer(items).alias(position, name) if position else F.explode_outer(items).alias(name)
    return df.select(*keep, spread).where(F.col(name).isNotNull())


#: Elements that a scan handles before it starts a new part, and characters of a block of a cut text.
PART, TEXT_BLOCK = 512, 1024


def scan(items: Column, state: Column, step: Callable[[Column, Column], Column],
         emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """Left-to-right pass: ``emit(state before, x)`` for every element, nulls left out.

    Appending copies an array, so elements are collected in parts of ``PART``: the time grows with
    the elements (and the square of their parts only), not with the square of the elements.
    """
    empty, parts = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["state"], x).alias("state"), F.array_append(acc["out"], emit(acc["state"], x)).alias("out"))

    def across(whole: Column) -> Column:
        def part(acc: Column, at: Column) -> Column:
            begin = F.struct(acc["state"].alias("state"), empty.alias("out"))
            return bind(F.aggregate(F.slice(whole, at, F.lit(PART)), begin, one), lambda done: F.struct(
                done["state"].alias("state"), F.array_append(acc["parts"], done["out"]).alias("parts")))

        starts = F.sequence(F.lit(1), F.size(whole), F.lit(PART))
        return F.aggregate(starts, F.struct(state.alias("state"), parts.alias("parts")), part, lambda acc: F.flatten(acc["parts"]))

    return F.filter(bind(items, lambda whole: F.when(F.size(whole) > 0, across(whole)).when(whole.isNotNull(), empty)), lambda x: x.isNotNull())


def sliced(text: Column, bounds: Column) -> Column:
    """``text[start:end]`` for every ``struct<start,end>`` of an array; empty where the end is not after the start.

    A long text is first cut into blocks, so a slice touches only the blocks that it lies in.
    """
    def plain(b: Column) -> Column:
        return F.substring(text, b["start"] + 1, F.greatest(b["end"] - b["start"], F.lit(0)))

    def from_blocks(blocks: Column) -> Column:
        def one(b: Column) -> Column:
            first, last = F.floor(b["start"] / TEXT_BLOCK).cast("int"), F.floor((b["end"] - 1) / TEXT_BLOCK).cast("int")
            into = b["start"] - first * TEXT_BLOCK
            inside = F.substring(F.get(blocks, first), into + 1, b["end"] - b["start"])
            ahead = F.substring(F.get(blocks, first), into + 1, F.lit(TEXT_BLOCK))
            between = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            behind = F.coalesce(F.substring(F.get(blocks, last), F.lit(1), b["end"] - last * TEXT_BLOCK), F.lit(""))
            piece = F.when(first == last, F.coalesce(inside, F.lit(""))).otherwise(F.concat(F.coalesce(ahead, F.lit("")), between, behind))
            return F.when(b["end"] > b["start"], piece).otherwise("")
        return F.transform(bounds, one)

    starts = F.sequence(F.lit(0), F.length(text), F.lit(TEXT_BLOCK))
    blocks = F.transform(starts, lambda at: F.substring(text, at + 1, F.lit(TEXT_BLOCK)))
    many = (F.length(text) > 4 * TEXT_BLOCK) & (F.size(bounds) > 16)
    return F.when(many, bind(blocks, from_blocks)).otherwise(F.transform(bounds, plain))


def make_span(**values: Column) -> Column:
    """A span struct with every field of the span schema (missing ones null)."""
    return F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in SPAN_FIELDS])


def change(span: Column, **values: Column) -> Column:
    return make_span(**{n: values.get(n, span[n]) for n, _ in SPAN_FIELDS})


def no_spans() -> Column:
    return F.array().cast(SPANS)


def sort_stable(items: Column, keys: Callable[[Column], list[Column]]) -> Column:
    """Sort by ``keys``; equal keys keep their order.

    The keys and the old position lead a wrapper struct, so the natural struct order decides
    and no per-comparison lambda runs.
    """
    wrapped = F.transform(items, lambda x, i: F.struct(
        *[k.alias(f"k{n}") for n, k in enumerate(keys(x))], i.alias("position"), x.alias("item")))
    return F.transform(F.sort_array(wrapped), lambda w: w["item"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["end"] > b["start"]) & (a["start"] < b["end"])


def final_label(span: Column) -> Column:
    """``label_adjusted`` when it is set and not empty, else ``label``."""
    return F.coalesce(F.nullif(span["label_adjusted"], F.lit("")), span["label"])


def lookup(mapping: dict[str, str | int | float], key: Column) -> Column:
    """Value of a small fixed table, null for unknown keys (a map literal, so no join)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)
