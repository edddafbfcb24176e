"""Normalisation, redaction, sentence splitting and other scalar text functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import lexicon as L
from . import scanner
from .arrays import bind
from .finditer import FENCE, char_slice, fence_free, find_all, replace_all, split_on, unicode_regex

# Characters that NFKC leaves alone wherever they stand; any other character sends the row to
# the one Python function of the package.
_STABLE = r"\x00-\x9F\u00c0-\u00ff\u2013-\u2015\u2018-\u201d\u4e00-\u9fff\uac00-\ud7a3"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode NFKC.  Rows made only of stable characters never reach Python."""
    # one run from end to end: a search for another character starts anew at every place, which takes many times longer
    return F.coalesce(_nfkc(F.when(~text.rlike(rf"\A[{_STABLE}]*+\z"), text)), text)


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both sides."""
    edge = unicode_regex(r"\s")

    def trimmed(t: Column) -> Column:
        loose = F.substring(t, F.lit(1), F.lit(1)).rlike(edge) | F.right(t, F.lit(1)).rlike(edge)
        return F.when(loose, F.regexp_replace(t, unicode_regex(r"\A\s+|\s+\z"), "")).otherwise(t)

    return bind(text, trimmed)


def squeeze(text: Column) -> Column:
    """Collapse every whitespace run to one space and trim."""
    return strip(replace_all(text, r"\s+", " "))


def ascii_confusables(text: Column) -> Column:
    return bind(text, lambda t: F.when(t.rlike(f"[{L.CONFUSABLE_FROM}]"), F.translate(
        t, L.CONFUSABLE_FROM, L.CONFUSABLE_TO)).otherwise(t))


def drop_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, r"[\u200B-\u200D\uFEFF]", "")


def tighten_separators(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(" . "), F.lit(".")), F.lit(" : "), F.lit(":"))


def collapse_blanks(text: Column) -> Column:
    return strip(F.regexp_replace(text, "[ \t]{2,}", " "))


def normalize_text(text: Column, use_nfkc: bool = True) -> Column:
    base = nfkc(text) if use_nfkc else text
    return collapse_blanks(tighten_separators(drop_zero_width(ascii_confusables(base))))


def _redact_one(text: Column, pattern: str, fence: Column) -> Column:
    # the text is an expression here: mention it once, so that the chain stays linear
    pieces = F.split(F.regexp_replace(text, F.lit(unicode_regex(pattern)), F.concat(fence, F.lit("$0"), fence)), fence, -1)
    blanked = F.transform(
        pieces, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, r"[\p{L}\p{N}]", "X")).otherwise(p))
    return F.array_join(blanked, "")


def redact(text: Column) -> Column:
    """Length-preserving redaction: letters and digits of every hit become ``X``; all else stays."""
    return scanner.redaction(text)


def context_slice(text: Column, start: Column, end: Column, reach: int = L.CONTEXT_SLICE) -> Column:
    left = F.greatest(start - reach, F.lit(0))
    return char_slice(text, left, F.least(end + reach, F.length(text)))


def _clean(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def _or_whole(parts: Column, text: Column) -> Column:
    return bind(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text)))


def sentences(text: Column) -> Column:
    """Split after ``. ! ?`` followed by whitespace; blank text stays one piece."""
    return _or_whole(_clean(split_on(text, r"(?<=[.!?])\s+")), text)


def terminated_sentences(text: Column) -> Column:
    """Sentences with their terminator; an unterminated tail is dropped if any terminator exists."""
    # \\G keeps the search from trying every position of a long unterminated tail
    found = F.regexp_extract_all(text, F.lit(r"\G" + unicode_regex(r"([^.!?]*+[.!?]++)\s*")), F.lit(1))
    return _or_whole(_clean(found), text)


def bare_sentences(text: Column) -> Column:
    """Sentences without their terminators."""
    return _clean(F.split(text, "[.!?]+", -1))


def sentence_batches(text: Column, size: int = L.SENTENCES_PER_BATCH) -> Column:
    """Texts of ``size`` consecutive terminated sentences (raw, unterminated tail dropped)."""
    found = F.regexp_extract_all(text, F.lit(r"\G[^.!?]*+[.!?]++"), F.lit(0))


    def batches(all_: Column) -> Column:
        starts = F.when(F.size(all_) > 0, F.sequence(F.lit(1), F.size(all_), F.lit(size)))
        return F.transform(starts, lambda i: F.array_join(F.slice(all_, i, F.lit(size)), ""))

    return F.coalesce(bind(found, batches), F.array().cast("array<string>"))


def ensure_terminator(text: Column) -> Column:
    return bind(strip(text), lambda t: F.when((t == "") | t.rlike(r"[.!?]\z"), t).otherwise(F.concat(t, F.lit("."))))


def join_pieces(texts: Column) -> Column:
    """Terminate every piece, join with spaces, collapse whitespace."""
    return squeeze(F.array_join(F.transform(texts, ensure_terminator), " "))


def tidy_punctuation(text: Column) -> Column:
    out = squeeze(text)
    for mark in (".", ",", "?", "!"):
        out = F.replace(out, F.lit(" " + mark), F.lit(mark))
    return out


def break_sentences(text: Column) -> Column:
    """Newline after a sentence end that is followed by Hangul."""
    return F.regexp_replace(text, unicode_regex(r"([.!?])\s*(?=[가-힣])"), "$1\n")


def tidy_spacing(text: Column) -> Column:
    spaced = F.regexp_replace(text, unicode_regex(r"([가-힣])\s*\.\s*([가-힣])"), "$1. $2")
    return squeeze(spaced)


def words(text: Column) -> Column:
    return F.filter(split_on(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def line_count(text: Column) -> Column:
    """Number of lines; a trailing line break does not open another line."""
    breaks = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1)
    return bind(breaks, lambda b: F.when(F.element_at(b, -1) == "", F.size(b) - 1).otherwise(F.size(b)))


def preservation_rate(before: Column, after: Column) -> Column:
    return (1 - F.try_divide(F.abs(F.length(after) - F.length(before)), F.length(before))) * 100


def position_label(start: Column, end: Column) -> Column:
    return F.concat_ws("-", start, end)


def percent_label(score: Column) -> Column:
    return F.format_string("%s%%", F.bround(score * 100, 0).cast("long"))


def preview(text: Column, limit: int = 50) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def mark_terms(text: Column, terms: Column, before: str = "**🟨 [", after: str = "]**") -> Column:
    """Wrap every occurrence of every term, term after term."""
    return F.aggregate(terms, text, lambda t, term: F.replace(
        t, term, F.concat(F.lit(before), term, F.lit(after))))


def estimated_length(duration_ms: Column) -> Column:
    return F.floor((duration_ms / 1000.0) * (200.0 / 60.0))


def fix_double_particles(text: Column) -> Column:
    out = text
    for doubled, single in L.DOUBLE_PARTICLES:
        out = F.replace(out, F.lit(doubled), F.lit(single))
    return out


def _log_entries(current: Column, doubled: str, single: str) -> Column:
    return F.transform(bind(current, lambda t: find_all(t, doubled)), lambda m: F.struct(
        F.lit("duplicate").alias("type"), F.lit(doubled).alias("original"), F.lit(single).alias("corrected"),
        F.lit(1.0).alias("confidence"), m["start"].alias("position")))


def double_particle_log(text: Column) -> Column:
    """What :func:`fix_double_particles` changes; positions are in the text edited so far."""
    logs, current = [], text
    for doubled, single in L.DOUBLE_PARTICLES:
        logs.append(_log_entries(current, doubled, single))
        current = F.replace(current, F.lit(doubled), F.lit(single))
    return F.concat(*logs)
