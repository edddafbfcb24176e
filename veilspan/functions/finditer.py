"""Every match of a pattern with code-point offsets, as one native expression.

``regexp_replace`` fences each match with a private-use character in a single regex pass; a
plain-character ``split`` then yields ``gap, match, gap, ..., gap`` and a scan of the pieces in
parts turns lengths into offsets, in time linear in the matches.  Spark's ``length``/``substring`` count code points, so offsets do
too.  The text is scanned by the regex once and by a byte search once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind, scan

FENCE = "\ue000"
STAND_IN = "\ue001"

# whitespace and word characters of the common Unicode notation
_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = r"\p{L}\p{N}_"
_OUTSIDE = {
    "d": r"\p{Nd}",
    "s": f"[{_SPACE}]",
    "S": f"[^{_SPACE}]",
    "w": f"[{_WORD}]",
    "b": f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))",
}
_INSIDE = {"d": r"\p{Nd}", "s": _SPACE, "w": _WORD}

MATCH = "array<struct<start:int,end:int,text:string>>"


def unicode_regex(pattern: str) -> str:
    r"""Spell ``\d \s \S \w \b`` out so that Java gives them their Unicode meaning."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1]
            out.append((_INSIDE if in_class else _OUTSIDE).get(nxt, c + nxt))
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        out.append(c)
        i += 1
    return "".join(out)


def contains_match(text: Column, pattern: str) -> Column:
    return text.rlike(unicode_regex(pattern))


def full_match(text: Column, pattern: str) -> Column:
    return text.rlike(r"\A(?:" + unicode_regex(pattern) + r")\z")


def replace_all(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, unicode_regex(pattern), replacement)


def split_on(text: Column, pattern: str) -> Column:
    return F.split(text, unicode_regex(pattern), -1)


def fence_free(text: Column) -> Column:
    """The text with any literal fence character swapped for its neighbour (same length)."""
    return F.when(F.contains(text, F.lit(FENCE)), F.translate(text, FENCE, STAND_IN)).otherwise(text)


def fenced(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    flags = "(?i)" if ignore_case else ""
    return F.regexp_replace(fence_free(text), flags + unicode_regex(pattern), FENCE + "$0" + FENCE)


def fenced_matches(marked: Column) -> Column:
    """Offsets and texts of the fenced parts of ``marked`` (null in, empty out)."""
    state = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"))

    def step(acc: Column, piece: Column) -> Column:
        return F.struct((acc["at"] + F.length(piece)).alias("at"), (~acc["hit"]).alias("hit"))

    def emit(acc: Column, piece: Column) -> Column:
        return F.when(acc["hit"], F.struct(
            acc["at"].alias("start"), (acc["at"] + F.length(piece)).alias("end"), piece.alias("text")))

    def found(m: Column) -> Column:
        # most texts have no match: they are done with a byte search
        return F.when(F.contains(m, F.lit(FENCE)), scan(F.split(m, FENCE, -1), state, step, emit, "struct<start:int,end:int,text:string>"))

    return F.coalesce(bind(marked, found), F.array().cast(MATCH))


def marked_text(text: Column, pattern: str, gate: Column | None = None, ignore_case: bool = False,
                first: str | None = None) -> Column:
    """``text`` with its matches fenced.

    ``gate`` is a cheap necessary condition: rows where it is false skip the regex.  ``first`` is
    a class that every match starts with; testing it ahead of look-arounds makes the scan over
    ordinary prose several times faster.
    """
    marked = fenced(text, pattern if first is None else f"(?={first}){pattern}", ignore_case)
    return marked if gate is None else F.when(gate, marked)


def matches_of(text: Column, marked: Column) -> Column:
    """``array<struct<start,end,text>>`` of the matches fenced in ``marked``."""
    # a fence character of the text itself was swapped before the scan: then the texts are taken from the text
    return bind(fenced_matches(marked), lambda m: F.when(
        (F.size(m) > 0) & F.contains(text, F.lit(FENCE)), with_text(text, m)).otherwise(m))


def find_all(text: Column, pattern: str, gate: Column | None = None, ignore_case: bool = False,
             first: str | None = None) -> Column:
    """``array<struct<start,end,text>>`` of all leftmost non-overlapping matches (see ``marked_text``)."""
    return matches_of(text, marked_text(text, pattern, gate, ignore_case, first))


def with_text(text: Column, spans: Column) -> Column:
    """The spans with the text between their bounds."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text")))


def find_literal(text: Column, needle: Column) -> Column:
    """Like :func:`find_all` for a literal (possibly per-row) needle."""
    quoted = F.concat(F.lit("\\Q"), needle, F.lit("\\E"))
    marked = F.regexp_replace(fence_free(text), quoted, F.lit(FENCE + "$0" + FENCE))
    return F.transform(fenced_matches(marked), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def char_slice(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` for 0-based code-point offsets with ``start >= 0``."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
