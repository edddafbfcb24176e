"""Transcript correction rules, stored analysis applied to text, and review rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.arrays import sort_stable
from ..functions.text import (break_sentences, double_particle_log, fix_double_particles, tidy_spacing)


def apply_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Doubled particles, spacing around full stops, whitespace: ``rule_text`` and ``rule_log``."""
    return df.withColumns({"rule_log": double_particle_log(F.col(text)),
                           "rule_text": tidy_spacing(fix_double_particles(F.col(text)))})


def substitute(text: Column, issues: Column) -> Column:
    """Suggested replacements of an analysis, all occurrences, in order.

    ``issues``: ``array<struct<text,suggested_correction>>``; empty entries are skipped.
    """
    def usable(i: Column) -> Column:
        return (F.coalesce(i["text"], F.lit("")) != "") & (F.coalesce(i["suggested_correction"], F.lit("")) != "")

    return F.aggregate(F.filter(F.coalesce(issues, F.array().cast("array<struct<text:string,suggested_correction:string>>")), usable),
                       text, lambda t, i: F.replace(t, i["text"], i["suggested_correction"]))


def with_context(text: Column, issues: Column) -> Column:
    return break_sentences(substitute(text, issues))


def fix_sound_alikes(text: Column) -> Column:
    """Opt-in: replace frequent mishearings when their context words occur in the text."""
    out = text
    for wrong, right, context in L.SOUND_ALIKES:
        out = F.when(F.contains(out, F.lit(wrong)) & out.rlike(context), F.replace(out, F.lit(wrong), F.lit(right))).otherwise(out)
    return out


def confidence_band(confidence: Column) -> Column:
    return (F.when(confidence >= L.AUTO_CONFIDENCE, "auto").when(confidence >= L.REVIEW_CONFIDENCE, "review")
            .otherwise("ignore"))


def processing_gates(text: Column) -> Column:
    """Which optional steps a text gets: sentence batches when long, context analysis unless short."""
    return F.struct((F.length(text) > L.LONG_TEXT).alias("batched"), (F.length(text) > L.CONTEXT_TEXT).alias("analysed"))


def review_rows(df: DataFrame, *keep: str, response: str = "response") -> DataFrame:
    """One row per suspicious part of a stored correction response, with defaults and a colour."""
    parts = F.explode(F.col(f"{response}.suspicious_parts"))
    return df.select(*keep, parts.alias("p")).select(
        *keep, F.coalesce("p.start_char", F.lit(0)).alias("start"), F.coalesce("p.end_char", F.lit(0)).alias("end"),
        F.col("p.text").alias("text"), F.coalesce("p.reason", F.lit("")).alias("reason"),
        F.coalesce("p.linguistic_type", F.lit("")).alias("linguistic_type"),
        F.coalesce("p.suggestions", F.array().cast("array<string>")).alias("suggestions"),
        F.coalesce("p.confidence", F.lit(0.5)).alias("confidence"),
        F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in L.REVIEW_COLOURS.items() for x in kv]),
                                F.col("p.linguistic_type")), F.lit(L.REVIEW_OTHER)).alias("colour"))


def needs_review(response: Column) -> Column:
    return F.coalesce(F.size(response["suspicious_parts"]) > 0, F.lit(False))


def correct(df: DataFrame, text: str = "text", response: str | None = None, analysis: str | None = None) -> DataFrame:
    """Rules, then a stored correction response and analysis where there is one.

    Adds ``corrected_text``, ``auto_corrections`` and ``needs_review``; without a response the
    rules alone apply.
    """
    ruled = apply_rules(df, text)
    if response is None:
        return ruled.select(*df.columns, F.col("rule_text").alias("corrected_text"), F.col("rule_log").alias("auto_corrections"),
                            F.lit(False).alias("needs_review"))
    answer = F.col(response)
    body = F.coalesce(answer["corrected_text"], F.col("rule_text"))
    if analysis is not None:
        used = answer.isNotNull() & F.col(analysis).isNotNull() & processing_gates(F.col(text))["analysed"]
        body = F.when(used, with_context(body, F.col(analysis)["semantic_issues"])).otherwise(body)
    log = F.concat(F.col("rule_log"), F.coalesce(answer["auto_corrections"], F.array().cast(
        "array<struct<type:string,original:string,corrected:string,confidence:double,position:int>>")))
    return ruled.select(*df.columns, body.alias("corrected_text"), log.alias("auto_corrections"), needs_review(answer).alias("needs_review"))


def correction_summary(log: Column) -> Column:
    """``문장부호 2개, 중복 조사 1개``: one entry per type in first-seen order."""
    types = F.transform(log, lambda c: F.coalesce(c["type"], F.lit(L.UNKNOWN_LABEL)))
    names = F.create_map(*[F.lit(x) for kv in L.CORRECTION_NAMES.items() for x in kv])
    entries = F.transform(F.array_distinct(types), lambda t: F.concat(
        F.coalesce(F.element_at(names, t), t), F.lit(" "), F.size(F.filter(types, lambda x: x == t)).cast("string"), F.lit("개")))
    return F.when(F.size(log) == 0, F.lit(L.NO_CORRECTIONS)).otherwise(F.array_join(entries, ", "))


def apply_choices(text: Column, choices: Column) -> Column:
    """Chosen suggestions, first occurrence of each, applied from right to left.

    ``choices``: ``array<struct<original,replacement>>``; positions refer to the given text.
    """
    placed = F.filter(F.transform(choices, lambda c: F.struct(
        (F.position(c["original"], text) - 1).alias("at"), c["original"].alias("original"), c["replacement"].alias("replacement"))),
        lambda p: p["at"] >= 0)
    ordered = F.reverse(sort_stable(placed, lambda p: [p["at"], p["original"], p["replacement"]]))
    return F.aggregate(ordered, text, lambda t, p: F.concat(
        F.substring(t, F.lit(1), p["at"]), p["replacement"], F.substring(t, p["at"] + F.length(p["original"]) + 1, F.length(t))))


def scorecard(df: DataFrame, before: str = "text", after: str = "corrected", expected: str = "expected") -> DataFrame:
    """Share of expected (wrong -> right) pairs a correction achieved, over the whole table.

    ``expected``: ``array<struct<wrong,right>>``.  A pair whose wrong form is in the original
    passes when the right form is in the result and the wrong one is gone.
    """
    rows = df.select(F.col(before).alias("b"), F.col(after).alias("a"), F.explode(expected).alias("x")).where(F.contains("b", F.col("x.wrong")))
    passed = F.contains(F.col("a"), F.col("x.right")) & ~F.contains(F.col("a"), F.col("x.wrong"))
    return rows.agg(F.count("*").alias("pairs"), F.count_if(passed).alias("passed"),
                    (F.try_divide(F.count_if(passed), F.count("*")) * 100).alias("score"))
