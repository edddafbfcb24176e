"""Spans -> masked text, reversible records and statistics."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.arrays import bind, final_label, sliced, sort_stable
from ..schemas import RECORD, RULES
from . import overlap


def span_label(span: Column) -> Column:
    return F.coalesce(final_label(span), F.lit(L.UNKNOWN_LABEL))


def rules_column(rules: dict[str, Any]) -> Column:
    """Masking rules as a struct column (for the vault and for per-row rules)."""
    def text_map(name: str) -> Column:
        items = rules.get(name)
        if not items:
            return F.lit(None).cast("map<string,string>")
        return F.create_map(*[F.lit(x) for kv in items.items() for x in kv])

    def text(name: str) -> Column:
        return F.lit(rules.get(name)).cast("string")

    return F.struct(
        text("mode").alias("mode"), text("simple_rule").alias("simple_rule"),
        text_map("label_rules").alias("label_rules"), text_map("entity_rules").alias("entity_rules"),
        text("default").alias("default")).cast(RULES)


def choose_mask(rules: Column, original: Column, label: Column) -> Column:
    """simple: one text; advanced: by label; custom: by exact text, then label; else the default."""
    default = F.coalesce(rules["default"], F.lit(L.MASK_DEFAULT))
    by_label = F.coalesce(F.element_at(rules["label_rules"], label), default)
    by_text = F.coalesce(F.element_at(rules["entity_rules"], original), by_label)
    mode = F.coalesce(rules["mode"], F.lit("simple"))
    return (F.when(mode == "simple", F.coalesce(rules["simple_rule"], F.lit(L.MASK_DEFAULT)))
            .when(mode == "advanced", by_label).when(mode == "custom", by_text).otherwise(default))


def records(text: Column, spans: Column, rules: Column, session: Column) -> Column:
    """Replacement records in the order they are applied: by end, descending, stable."""
    def record(item: Column, i: Column) -> Column:
        s, original = item["s"], item["original"]
        label = span_label(s)
        return F.struct(
            F.concat(session, F.lit("_"), F.lpad(i.cast("string"), F.greatest(F.lit(4), F.length(i.cast("string"))), F.lit("0"))).alias("entity_id"),
            original.alias("original_text"), choose_mask(rules, original, label).alias("masked_text"),
            label.alias("label"), s["subtype"].alias("subtype"), s["start"].alias("start"), s["end"].alias("end"),
            F.struct(F.coalesce(s["source"], F.lit("unknown")).alias("source"),
                     F.coalesce(s["score"], F.lit(0.0)).alias("confidence")).alias("metadata"))

    def numbered(ordered: Column) -> Column:
        with_original = F.zip_with(ordered, sliced(text, ordered), lambda s, t: F.struct(s.alias("s"), t.alias("original")))
        return F.transform(with_original, record)

    return bind(sort_stable(spans, lambda s: [-s["end"]]), numbered).cast(f"array<{RECORD}>")


def _one_by_one(text: Column, recs: Column) -> Column:
    """Right-to-left replacement, so earlier offsets stay valid; nested spans are replaced as given."""
    return F.aggregate(recs, text, lambda t, r: F.concat(
        F.substring(t, F.lit(1), r["start"]), r["masked_text"],
        F.substring(t, r["end"] + 1, F.length(t))))


def apply_records(text: Column, recs: Column) -> Column:
    """The text with every record's stretch replaced.

    Records whose stretches do not overlap are gaps and masks in turn, cut out of the text once;
    only nested or overlapping ones are replaced one after the other.
    """
    def pieces(ordered: Column) -> Column:
        past = F.transform(ordered, lambda r, i: F.struct(
            F.when(i == 0, 0).otherwise(F.get(ordered, i - 1)["end"]).alias("start"), r["start"].alias("end")))
        gaps = F.concat(past, F.array(F.struct(F.element_at(ordered, -1)["end"].alias("start"), F.length(text).alias("end"))))
        masks = F.concat(F.transform(ordered, lambda r: r["masked_text"]), F.array(F.lit("")))
        return F.array_join(F.zip_with(sliced(text, gaps), masks, lambda g, m: F.concat(g, m)), "")

    def apart(ordered: Column) -> Column:
        # a mask that is null makes the whole text null, as replacing it does
        return ~F.exists(F.transform(ordered, lambda r, i: r["masked_text"].isNull() | (r["start"] > r["end"]) | (
            (i > 0) & (r["start"] < F.get(ordered, i - 1)["end"]))), lambda bad: bad)

    def apply(given: Column) -> Column:
        return bind(F.reverse(given), lambda ordered: F.when(apart(ordered), pieces(ordered)).otherwise(_one_by_one(text, given)))

    return F.when(F.size(recs) == 0, text).when(recs.isNotNull(), bind(recs, apply))


def label_counts(recs: Column) -> Column:
    return F.map_from_entries(bind(F.transform(recs, lambda r: r["label"]), lambda labels: F.transform(
        F.array_distinct(labels), lambda lab: F.struct(lab, F.size(F.filter(labels, lambda x: x == lab))))))


def mask(df: DataFrame, text: str = "text", spans: str = "spans", rules: dict[str, Any] | Column | None = None,
         session: Column | str | None = None, resolve: bool = False) -> DataFrame:
    """Add ``records``, ``masked_text`` and ``mask_stats``.

    ``resolve=True`` first merges overlapping spans by priority; without it nested spans are
    replaced exactly as given.
    """
    chosen = L.DEFAULT_RULES if rules is None else rules
    rule_col = rules_column(chosen) if isinstance(chosen, dict) else chosen
    session_col = F.lit("session") if session is None else (F.col(session) if isinstance(session, str) else session)
    used = overlap.merge_by_priority(F.col(spans)) if resolve else F.col(spans)
    body = F.col(text)
    return (
        df.withColumn("masking_rules", rule_col)
        .withColumn("records", records(body, used, F.col("masking_rules"), session_col))
        .withColumn("masked_text", apply_records(body, F.col("records")))
        .withColumn("mask_stats", F.struct(
            F.size("records").alias("total"), label_counts(F.col("records")).alias("by_label"),
            F.length(body).alias("text_length"), F.length("masked_text").alias("masked_length"))))


def mask_with_tables(spans: DataFrame, entity_rules: DataFrame, label_rules: DataFrame,
                     default: str = L.MASK_DEFAULT) -> DataFrame:
    """Masks for a span table from rule tables of any size: exact text, then label, then default.

    ``entity_rules(text, mask)``, ``label_rules(label, mask)``.  Spark broadcasts a rule table
    only while it is under the session's size threshold and shuffles otherwise.
    """
    by_text = entity_rules.select(F.col("text").alias("_text"), F.col("mask").alias("_text_mask")).dropDuplicates(["_text"])
    by_label = label_rules.select(F.col("label").alias("_label"), F.col("mask").alias("_label_mask")).dropDuplicates(["_label"])
    label = F.coalesce(F.nullif(F.col("label_adjusted"), F.lit("")), F.col("label"), F.lit(L.UNKNOWN_LABEL))
    return (
        spans.join(by_text, F.col("text") == F.col("_text"), "left")
        .join(by_label, label == F.col("_label"), "left")
        .withColumn("mask", F.coalesce("_text_mask", "_label_mask", F.lit(default)))
        .drop("_text", "_text_mask", "_label", "_label_mask"))


def restore(masked: DataFrame, vault: DataFrame, *keys: str) -> DataFrame:
    """Original text, rules and statistics of masked documents from the vault."""
    kept = vault.select(*keys, F.col("original_text").alias("original"), F.col("masked_text").alias("masked"),
                        F.col("masking_rules").alias("rules_used"), "stats")
    return masked.select(*keys).join(kept, list(keys))


def highlight(text: Column, spans: Column, colours: dict[str, str] | None = None) -> Column:
    """Wrap every span in markup with its label's colour.

    Gaps and spans are emitted left to right; where spans overlap, the later gap is empty and
    the overlapped text appears once per span.
    """
    palette = L.HIGHLIGHT_COLOURS if colours is None else colours
    colour_map = F.create_map(*[F.lit(x) for kv in palette.items() for x in kv])

    def opening(s: Column) -> Column:
        label = final_label(s)
        tip = F.concat(label, F.when(F.coalesce(s["subtype"], F.lit("")) != "", F.concat(F.lit(" / "), s["subtype"])).otherwise(""))
        return F.concat(
            F.lit('<span style="background:'), F.coalesce(F.element_at(colour_map, label), F.lit(L.HIGHLIGHT_OTHER)),
            F.lit('33; padding:2px 2px; border-radius:3px;" title="'), tip, F.lit('">'))

    def pieces(ordered: Column) -> Column:
        gaps = F.transform(ordered, lambda s, i: F.struct(
            F.when(i == 0, 0).otherwise(F.get(ordered, i - 1)["end"]).alias("start"), s["start"].alias("end")))
        inner = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        rest = F.substring(text, F.element_at(ordered, -1)["end"] + 1, F.length(text))
        opened = F.zip_with(sliced(text, gaps), F.transform(ordered, opening), lambda g, o: F.concat(g, o))
        wrapped = F.zip_with(opened, sliced(text, inner), lambda o, t: F.concat(o, t, F.lit("</span>")))
        # a null part makes the whole null
        return F.when(F.exists(wrapped, lambda w: w.isNull()), F.lit(None)).otherwise(F.concat(F.array_join(wrapped, ""), rest))

    ordered = sort_stable(spans, lambda s: [s["start"]])
    return bind(ordered, lambda items: F.when(F.size(items) == 0, text).when(items.isNotNull(), pieces(items)))


def rule_builder(spans: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """Inputs for writing rules: the distinct labels, and each distinct text with its first label."""
    label = F.coalesce(F.nullif(F.col("label_adjusted"), F.lit("")), F.col("label"), F.lit(L.UNKNOWN_LABEL))
    labels = spans.select(label.alias("label")).distinct().orderBy("label")
    texts = (spans.where(F.coalesce(F.col("text"), F.lit("")) != "")
             .groupBy("text").agg(F.min_by(label, F.struct(*order)).alias("label")))
    return labels, texts


def search_texts(texts: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring search over span texts."""
    return texts.where(F.contains(F.lower("text"), F.lower(F.lit(query))))
