"""Stored answers of external models joined back to their texts: entity recognition and review verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.arrays import bind, change, each, final_label, lookup, make_span, no_spans
from ..functions.checks import clip_confidence
from ..functions.finditer import char_slice
from ..functions.text import context_slice, redact, strip
from .overlap import resolve_verdicts, strict_label

# --- labels ------------------------------------------------------------------------------


def normalize_label(label: Column) -> Column:
    """Alias to standard label; unknown labels pass through."""
    return F.coalesce(lookup(L.LABEL_ALIASES, label), label)


def ner_label(tag: Column) -> Column:
    """Entity tag to ``struct<label,subtype>``, null when the tag is not personal data."""
    pairs = [x for tag_, (lab, sub) in L.NER_TAGS.items()
             for x in (F.lit(tag_), F.struct(F.lit(lab).alias("label"), F.lit(sub).alias("subtype")))]
    return F.element_at(F.create_map(*pairs), tag)


# --- entity recognition ------------------------------------------------------------------


def _find(text: Column, needle: Column, start: Column) -> Column:
    """0-based ``text.find(needle, start)``; -1 when absent."""
    return F.when(F.length(needle) == 0, F.when(start <= F.length(text), start).otherwise(F.lit(-1))).otherwise(
        F.position(needle, text, start + 1) - 1)


def _morpheme_offsets(sentence: Column, morphemes: Column) -> Column:
    """``array<struct<id,start,end>>`` of the morphemes found left to right in the sentence."""
    kind = "array<struct<id:int,start:int,end:int>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        lemma = F.coalesce(m["lemma"], F.lit(""))

        def placed(p: Column) -> Column:
            return F.when(p >= 0, F.struct((p + F.length(lemma)).alias("at"), F.array_append(acc["out"], F.struct(
                m["id"].alias("id"), p.alias("start"), (p + F.length(lemma)).alias("end"))).alias("out"))).otherwise(acc)

        return bind(_find(sentence, lemma, acc["at"]), placed)

    return F.aggregate(F.coalesce(morphemes, F.array().cast("array<struct<id:int,lemma:string>>")), begin, step, lambda a: a["out"])


def ner_spans(text: Column, sentences: Column, source: str = "ner") -> Column:
    """Entities of a parsed response placed in the text.

    Offsets come from the entity's first and last morpheme; when either is missing the entity's
    text is searched from the previous sentence's end.  Sentences not found in the text are skipped.
    """
    begin = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def of_sentence(s: Column, base: Column, cursor: Column) -> Column:
        morphemes = F.transform(_morpheme_offsets(s["text"], s["morp"]), lambda m: F.struct(
            m["id"].alias("id"), (m["start"] + base).alias("start"), (m["end"] + base).alias("end")))

        def entity(e: Column, morphs: Column) -> Column:
            first = F.try_element_at(F.filter(morphs, lambda m: m["id"] == F.coalesce(e["begin"], F.lit(0))), F.lit(-1))["start"]
            last = F.try_element_at(F.filter(morphs, lambda m: m["id"] == F.coalesce(e["end"], F.lit(0))), F.lit(-1))["end"]
            found = _find(text, F.coalesce(e["text"], F.lit("")), cursor)
            placed = first.isNotNull() & last.isNotNull()
            hit = F.when(placed, F.struct(first.alias("s"), last.alias("e"))).when(
                found >= 0, F.struct(found.alias("s"), (found + F.length(e["text"])).alias("e")))
            kind = ner_label(e["type"])
            return make_span(start=hit["s"], end=hit["e"], text=e["text"], label=kind["label"], label_adjusted=kind["label"],
                             subtype=kind["subtype"], score=F.lit(L.NER_SCORE), source=F.lit(source), keyword=e["type"])

        known = F.filter(s["NE"], lambda e: ner_label(e["type"]).isNotNull())
        return F.filter(bind(morphemes, lambda ms: F.transform(known, lambda e: entity(e, ms))),
                        lambda x: x["start"].isNotNull())

    def step(acc: Column, s: Column) -> Column:
        def placed(p: Column) -> Column:
            return F.when(p >= 0, F.struct(
                (p + F.length(s["text"])).alias("at"),
                F.concat(acc["out"], F.coalesce(of_sentence(s, p, acc["at"]), no_spans())).alias("out"))).otherwise(acc)

        return bind(_find(text, s["text"], acc["at"]), placed)

    return F.coalesce(F.aggregate(sentences, begin, step, lambda a: a["out"]), no_spans())


# --- review payloads ----------------------------------------------------------------------


def coverage(text: Column, spans: Column) -> Column:
    """Share of the text inside spans; overlaps count twice."""
    n = F.length(text)
    covered = F.aggregate(spans, F.lit(0), lambda a, s: a + F.greatest(
        F.least(n, s["end"]) - F.greatest(F.lit(0), s["start"]), F.lit(0)))
    return covered / F.greatest(n, F.lit(1))


def needs_windows(text: Column, spans: Column, below: float = L.VERDICT_COVERAGE) -> Column:
    return coverage(text, spans) < below


def review_windows(df: DataFrame, *keep: str, text: str = "text", size: int = L.VERDICT_WINDOW,
                   step: int = L.VERDICT_STEP) -> DataFrame:
    """Redacted windows of the text: ``win_id``, ``offset``, ``context``."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))
    cut = df.where(F.length(text) > 0).select(
        *keep, text, F.explode(starts).alias("offset")).select(
        *keep, "offset", F.substring(F.col(text), F.col("offset") + 1, F.lit(size)).alias("_raw"))
    return cut.select(*keep, F.concat(F.lit("win-"), F.col("offset").cast("string")).alias("win_id"), "offset",
                      redact(F.col("_raw")).alias("context"))


def review_items(df: DataFrame, *keep: str, text: str = "text", spans: str = "spans") -> DataFrame:
    """Redacted review items, one row per valid span; ``id`` is the span's position."""
    rows = each(df, spans, *keep, text, position="ord").where(
        (F.col("s.start") >= 0) & (F.col("s.start") < F.col("s.end")) & (F.col("s.end") <= F.length(text)))
    raw = rows.select(*keep, F.col("ord").cast("string").alias("id"), char_slice(F.col(text), F.col("s.start"), F.col("s.end")).alias("_span"),
                      context_slice(F.col(text), F.col("s.start"), F.col("s.end")).alias("_context"),
                      final_label(F.col("s")).alias("proposed_label"), F.col("s.subtype").alias("proposed_subtype"))
    return raw.select(*keep, "id", redact(F.col("_span")).alias("span_text"), "proposed_label", "proposed_subtype",
                      redact(F.col("_context")).alias("context"))


# --- verdicts -----------------------------------------------------------------------------


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def checked_decision(d: Column) -> Column:
    """A decision with trimmed id, boolean keep, standard label and clipped confidence."""
    keep = F.lower(F.coalesce(d["keep"], F.lit("")))
    return F.struct(
        strip(F.coalesce(d["id"], F.lit(""))).alias("id"),
        (~keep.isin("", "false", "0", "0.0", "null", "[]", "{}")).alias("keep"),
        strict_label(d["label"]).alias("label"), _blank_to_null(d["subtype"]).alias("subtype"),
        _blank_to_null(strip(d["reason"])).alias("reason"), clip_confidence(d["confidence"]).alias("confidence"))


def checked_additions(text: Column, additions: Column, windows_used: Column) -> Column:
    """Additions turned into spans of the whole text; anything malformed is dropped.

    Window ids are ``win-<offset>``, so the window is known from the id: it must be one of the
    text's windows and contain the relative range.
    """
    n = F.length(text)

    def parsed(a: Column) -> Column:
        offset = F.regexp_extract(strip(F.coalesce(a["win_id"], F.lit(""))), r"\Awin-(0|[1-9][0-9]*)\z", 1).try_cast("int")
        return F.struct(a.alias("a"), offset.alias("offset"), a["start_rel"].try_cast("int").alias("s"),
                        a["end_rel"].try_cast("int").alias("e"), strict_label(a["label"]).alias("label"))

    def valid(p: Column) -> Column:
        window = F.least(F.lit(L.VERDICT_WINDOW), n - p["offset"])
        return (windows_used & p["offset"].isNotNull() & (p["offset"] % L.VERDICT_STEP == 0) & (p["offset"] < n)
                & (p["s"] >= 0) & (p["s"] < p["e"]) & (p["e"] <= window)
                & (p["e"] - p["s"] <= L.VERDICT_MAX_ADDITION) & p["label"].isNotNull())

    good = F.filter(F.transform(additions, parsed), lambda p: F.coalesce(valid(p), F.lit(False)))
    return F.transform(good, lambda p: make_span(
        start=p["offset"] + p["s"], end=p["offset"] + p["e"], label=p["label"], label_adjusted=p["label"],
        text=char_slice(text, p["offset"] + p["s"], p["offset"] + p["e"]),
        subtype=_blank_to_null(p["a"]["subtype"]), source=F.lit("gpt-add")))


def decided_spans(spans: Column, decisions: Column) -> Column:
    """Spans kept by a decision, relabelled, in decision order."""
    def apply(d: Column) -> Column:
        index = F.when(d["id"].rlike(r"\A(0|[1-9][0-9]*)\z"), d["id"]).try_cast("int")
        s = F.get(spans, index)
        label = F.coalesce(d["label"], strict_label(final_label(s)))
        return F.when(d["keep"] & s.isNotNull() & label.isNotNull(), change(
            s, label_adjusted=label, subtype=d["subtype"],
            source=F.concat(F.coalesce(_blank_to_null(s["source"]), F.lit("regex")), F.lit("+gpt"))))

    checked = F.transform(decisions, checked_decision)
    return F.filter(F.transform(checked, apply), lambda s: s.isNotNull())


def apply_verdicts(text: Column, spans: Column, response: Column) -> Column:
    """Spans after review: kept and relabelled ones plus additions, overlaps resolved.

    No response, or a response that keeps and adds nothing, leaves the original spans.
    """
    decisions = F.coalesce(response["decisions"], F.array().cast(
        "array<struct<id:string,keep:string,label:string,subtype:string,reason:string,confidence:string>>"))
    additions = F.coalesce(response["additions"], F.array().cast(
        "array<struct<win_id:string,start_rel:string,end_rel:string,label:string,subtype:string,reason:string,confidence:string>>"))
    reviewed = F.concat(decided_spans(spans, decisions), checked_additions(text, additions, needs_windows(text, spans)))
    chosen = bind(reviewed, lambda r: F.when(F.size(r) > 0, r).otherwise(spans))
    return resolve_verdicts(F.when(response.isNull(), spans).otherwise(chosen), F.length(text))


def reviewed_by_people(spans: DataFrame, review: DataFrame, *keys: str) -> DataFrame:
    """Reviewer choices: ``review(keys, ord, include, new_label)``; unreviewed spans stay as they are."""
    joined = spans.join(review.select(*keys, "ord", "include", "new_label"), [*keys, "ord"], "left")
    return (joined.where(F.coalesce("include", F.lit(True)))
            .withColumn("label_adjusted", F.coalesce("new_label", "label_adjusted", "label")).drop("include", "new_label"))
