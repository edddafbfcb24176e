"""The detectors as one pass over a text, for Arrow batches.

A bank of patterns over a text with a dozen identifiers takes longer in column expressions than the regular
expressions themselves: every match passes through several interpreted folds.  Here a text is looked at once for
runs of digits and of Hangul; nearly every pattern can start at such a run only, and is tried there.  Rules,
order and results are those of the column expressions in ``operators.detect`` and ``operators.overlap``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import lexicon as L
from ..schemas import SPAN_FIELDS, SPANS

#: Texts that are Python strings at a time.
TEXTS = 256

_BANK = {name: (i, pattern) for i, (name, pattern, _, _) in enumerate(L.PATTERN_BANK)}
#: The pattern engine here takes look-behinds of one length only: one for each.
_LABEL_BEFORE = r"(?<!\b[A-Za-z0-9]{1,63}[.\-])"
_RE = {name: re.compile(p.replace(_LABEL_BEFORE, "".join(_LABEL_BEFORE.replace("1,63", str(n)) for n in range(1, 64))))
       for name, (_, p) in _BANK.items()}
_DIGITS, _HANGUL, _HOST = re.compile(r"\d+"), re.compile("[가-힣]+"), re.compile(r"://|www\.|(?<=[A-Za-z0-9\-])\.[A-Za-z]{2}")
_ACCOUNT = re.compile(r"\d{2,6}(?:[\s\-]\d{1,6}){2,5}")
_ACCOUNT_WORDS = tuple(L.BANK_WORDS.removeprefix("(?:").removesuffix(")").split("|")) + ("계좌", "입금", "출금")
_BANK_WORD, _SEPARATOR = re.compile(L.BANK_WORDS), re.compile(r"[\s\-]")

# --- span kinds: what two spans may have in common, by number ---------------------------

_KINDS: list[tuple] = []
_NUMBERS: dict[tuple, int] = {}


def _kind(label: str, adjusted: str | None = None, subtype: str | None = None, score: float | None = None,
          source: str | None = None, keyword: str | None = None) -> int:
    values = (label, adjusted, subtype, score, source, keyword)
    if values not in _NUMBERS:
        _NUMBERS[values] = len(_KINDS)
        _KINDS.append(values)
    return _NUMBERS[values]


_RAW = [_kind(label, None, subtype) for _, _, label, subtype in L.PATTERN_BANK]
_PLAIN = [_kind(label, label, subtype) for _, _, label, subtype in L.PATTERN_BANK]
_NUMBERED = [label == "번호" for _, _, label, _ in L.PATTERN_BANK]
_TERMS = [(word, _kind(label, label, None, L.DOMAIN_SCORE, "keyword-domain")) for label, words in L.DOMAIN_KEYWORDS for word in words]
_LATIN_TERMS = [(word, kind) for word, kind in _TERMS if word.isascii()]
_NAME, _NAME_FIRST, _NAME_KIND = re.compile(L.NAME), {s[0] for s in L.SURNAMES}, _kind("이름", "이름", L.NAME_SUBTYPE, L.NAME_SCORE, "morph")
_TITLES = set(L.TITLES)

# --- checks -----------------------------------------------------------------------------


def _digits(text: str) -> list[int]:
    return [unicodedata.decimal(c) for c in text if c.isdecimal()]


def _weighted(digits: list[int], weights: list[int]) -> int:
    return sum(d * w for d, w in zip(digits, weights))


def _resident_ok(text: str) -> bool:
    d = _digits(text)
    return len(d) == 13 and (11 - _weighted(d, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]) % 11) % 10 == d[12]


def _business_ok(text: str) -> bool:
    d = _digits(text)
    return len(d) == 10 and (10 - (_weighted(d, [1, 3, 7, 1, 3, 7, 1, 3, 5]) + d[8] * 5 // 10) % 10) % 10 == d[9]


def _luhn_ok(text: str) -> bool:
    d = _digits(text)
    return len(d) >= 12 and sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 == len(d) % 2 else x for i, x in enumerate(d)) % 10 == 0


def _email_ok(address: str, allow: tuple[str, ...], deny: tuple[str, ...]) -> bool:
    domain = address[address.rindex("@") + 1:].lower()
    return not domain.endswith(deny) and (not allow or domain.endswith(allow))


def _no_email(text: str) -> bool:
    return "@" not in text or _RE["email"].fullmatch(text) is None


# --- the pattern bank -------------------------------------------------------------------


def _numbers(t: str, hits: list[tuple]) -> None:
    """Matches of the patterns that start with a run of digits, or right before one."""
    runs = [m.span() for m in _DIGITS.finditer(t)]
    resident, passport, business, card, phone, ipv4, postcode, date, time = (
        (_BANK[n][0], _RE[n].match) for n in ("resident", "passport", "business", "card", "phone", "ipv4", "postcode", "date", "time"))
    done, size = [0] * len(L.PATTERN_BANK), len(t)

    def tried(pattern: tuple, at: int, ok: Callable[[str], bool] | None = None) -> None:
        kind, match = pattern
        if at >= done[kind] and (m := match(t, at)):
            done[kind] = end = m.end()
            if ok is None or ok(m[0]):
                hits.append((at, at - end, kind, end))

    for a, b in runs:
        n, after = b - a, t[b] if b < size else ""
        if n == 6 or n == 13:
            tried(resident, a, _resident_ok)
        if n == 8 and a and t[a - 1] in "MSmsſ":
            tried(passport, a - 1)
        if n == 3 or n == 5 or n == 10:
            tried(business, a, _business_ok)
        if n == 4:
            tried(card, a, _luhn_ok)
            if after and after in "-./":
                tried(date, a)
        if t[a] == "0":
            tried(phone, a)
        if n <= 3 and after == ".":
            tried(ipv4, a, _no_email)
        if n <= 2 and after and after in ":.":
            tried(time, a)
        if n >= 5:
            kind = postcode[0]
            for at in range(a, b - 4, 5):
                start, end = at, at + 5
                if at == a and a > done[kind] and t[a - 1] in "([":
                    start -= 1
                if end == b and after and after in ")]":
                    end += 1
                done[kind] = end
                hits.append((start, start - end, kind, end))


def _accounts(t: str, hits: list[tuple]) -> None:
    """The digits of an account are looked for first; a bank's word may stand right before them."""
    kind, done = _BANK["account"][0], 0
    for m in _ACCOUNT.finditer(t):
        start, at = m.start(), len(t[done:m.start()].rstrip()) + done
        if at > done and t[at - 1] in ":()":
            at = len(t[done:at - 1].rstrip()) + done
        words = [len(w) for w in _ACCOUNT_WORDS if t.endswith(w, done, at)]
        if words:
            start = at - max(words)
        done = m.end()
        if len(_SEPARATOR.findall(t, start, done)) >= 2 or _BANK_WORD.search(t, max(start - 15, 0), start):
            hits.append((start, start - done, kind, done))


def _bank(t: str, allow: tuple[str, ...], deny: tuple[str, ...]) -> list[tuple[int, int, int]]:
    """``(start, end, pattern)`` of the whole bank after its validators, contained ones pruned."""
    hits: list[tuple] = []
    if _DIGITS.search(t):
        _numbers(t, hits)
        _accounts(t, hits)

    def found(name: str, ok: Callable[[str], bool]) -> None:
        kind = _BANK[name][0]
        hits.extend((m.start(), m.start() - m.end(), kind, m.end()) for m in _RE[name].finditer(t) if ok(m[0]))

    if "@" in t:
        found("email", lambda x: _email_ok(x, allow, deny))
    if ("." in t or "://" in t) and _HOST.search(t):
        found("url", _no_email)
    if "시" in t or "도" in t:
        found("address", lambda x: True)
    # by start, the longest first, then in the order of the bank
    hits.sort()
    kept, reach = [], -1
    for start, _, kind, end in hits:
        if end > reach:
            kept.append((start, end, kind))
            reach = end
    return kept


def _raw_bank(t: str, allow: tuple[str, ...], deny: tuple[str, ...]) -> list[tuple[int, int, int]]:
    return [(start, end, _RAW[kind]) for start, end, kind in _bank(t, allow, deny)]


# --- number refinement, keywords and names ----------------------------------------------

_NEAR_PHONE, _NEAR_IP, _FIVE = re.compile(L.NEAR_PHONE), re.compile(L.NEAR_IP), re.compile(r"\b\d{5}\b")


def _vote(context: str) -> tuple[str, float, str] | None:
    """Subtype, score and keyword as ``detect.keyword_vote`` finds them."""
    best, most, keyword = "", 0, ""
    for subtype, words in L.CONTEXT_KEYWORDS:
        hits = [w for w in words if w in context]
        if hits and not keyword:
            keyword = hits[0]
        if len(hits) > most:
            best, most = subtype, len(hits)
    return (best, min(1.0, 0.6 + 0.1 * most), keyword) if most else None


def _refined(t: str, start: int, end: int, subtype: str) -> int:
    if _NEAR_PHONE.search(t[max(start - 2, 0):end + 2]):
        return _kind("번호", "번호", "전화번호", 0.95)
    if _NEAR_IP.search(snippet := t[start:end]):
        return _kind("번호", "번호", "IP", 0.90)
    if _FIVE.fullmatch(snippet.replace(" ", "")):
        return _kind("번호", "번호", "우편번호", 0.85)
    if vote := _vote(t[max(start - L.CONTEXT_REACH, 0):end + L.CONTEXT_REACH]):
        return _kind("번호", "금융" if vote[0] == "계좌번호" else "번호", vote[0], vote[1], None, vote[2])
    return _kind("번호", "번호", subtype)


def _domain(t: str) -> list[tuple[int, int, int]]:
    out = []
    for word, kind in _LATIN_TERMS if t.isascii() else _TERMS:
        at = t.find(word)
        while at >= 0:
            out.append((at, at + len(word), kind))
            at = t.find(word, at + len(word))
    return out


def _default(t: str, allow: tuple[str, ...], deny: tuple[str, ...]) -> list[tuple[int, int, int]]:
    spans = [(start, end, _refined(t, start, end, L.PATTERN_BANK[kind][3]) if _NUMBERED[kind] else _PLAIN[kind])
             for start, end, kind in _bank(t, allow, deny)]
    return spans + _domain(t)


def _names(t: str) -> list[tuple[int, int, int]]:
    if t.isascii():
        return []
    out, done = [], 0
    # a word starts where a run of Hangul starts, or not within it
    for run in _HANGUL.finditer(t):
        at = run.start()
        if at >= done and t[at] in _NAME_FIRST and (m := _NAME.match(t, at)):
            done = end = m.end()
            if not (at and t[at - 1].isalnum()) and not t[end:end + 1].isalnum() and m[0] not in _TITLES:
                out.append((at, end, _NAME_KIND))
    return out


# --- the merge by priority --------------------------------------------------------------


def _priority(label: str, subtype: str | None) -> int:
    return L.MERGE_PRIORITY.get((label, subtype or None), L.MERGE_PRIORITY.get((label, None), L.DEFAULT_PRIORITY))


_EVIDENCE: dict[int, tuple[int, int, str, float]] = {}


def _evidence(kind: int) -> tuple[int, int, str, float]:
    """A kind with the defaults of the merge: its number, its priority, its final label and its score."""
    if kind not in _EVIDENCE:
        label, adjusted, subtype, score, source, keyword = _KINDS[kind]
        final, score = adjusted or label, score or 0.0
        _EVIDENCE[kind] = (_kind(label, final, subtype, score, source or "regex", keyword), _priority(final, subtype), final, score)
    return _EVIDENCE[kind]


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """As ``overlap.merge_by_priority``."""
    given = [(start, end, _evidence(kind)) for start, end, kind in spans]
    given.sort(key=lambda s: (s[0], -s[2][1], s[0] - s[1]))
    kept: list[tuple] = []
    for start, end, e in given:
        if kept and kept[-1][1] > start and kept[-1][0] < end:
            was_start, was_end, was = kept[-1]
            shared = min(end, was_end) - max(start, was_start)
            near = e[2] == was[2] and shared / (end - start + was_end - was_start - shared) >= 0.7
            if e[3] > was[3] if near else e[1] > was[1]:
                kept[-1] = (start, end, e)
        else:
            kept.append((start, end, e))
    return [(start, end, e[0]) for start, end, e in kept]


def _all(t: str, allow: tuple[str, ...], deny: tuple[str, ...]) -> list[tuple[int, int, int]]:
    return _merged(_default(t, allow, deny) + _names(t))


# --- normalisation ----------------------------------------------------------------------

_CONFUSABLE = str.maketrans(L.CONFUSABLE_FROM, L.CONFUSABLE_TO)
_ZERO_WIDTH, _BLANKS = re.compile("[​-‍﻿]"), re.compile("[ \t]{2,}")


def normalized(t: str, use_nfkc: bool = True) -> str:
    """As ``text.normalize_text``."""
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t) if use_nfkc else t
        t = _ZERO_WIDTH.sub("", t.translate(_CONFUSABLE))
    return _BLANKS.sub(" ", t.replace(" . ", ".").replace(" : ", ":")).strip()


# --- redaction --------------------------------------------------------------------------

_REDACTED = {name: re.compile(pattern) for name, pattern in L.REDACTION_BANK}
#: The lengths of the runs of digits that a pattern can start with; it takes whole runs.
_RUNS = {"phone": None, "resident": (6, 13), "card": (4,)}
_LETTER, _FOUR_DIGITS, _TWO_HANGUL = re.compile(r"[^\W_]"), re.compile(r"\d{4}"), re.compile("[가-힣]{2}")


def _blanked(m: re.Match) -> str:
    return _LETTER.sub("X", m[0])


def _blanked_at(t: str, runs: list[tuple[int, int]], name: str) -> str:
    match, sizes, parts, done = _REDACTED[name].match, _RUNS[name], [], 0
    for a, b in runs:
        if (b - a in sizes if sizes else t[a] == "0") and a >= done and (m := match(t, a)):
            parts += (t[done:a], _blanked(m))
            done = m.end()
    return "".join(parts) + t[done:] if parts else t


def redacted(t: str) -> str:
    """Letters and digits of every hit become ``X``, pattern after pattern.

    A pattern is tried where the text holds what it needs.  Redaction only turns letters and digits into X, which
    completes none of these, so all are asked of the text as it was given.
    """
    number, url = _FOUR_DIGITS.search(t) is not None, "://" in t or "www." in t
    runs = [m.span() for m in _DIGITS.finditer(t)] if number else []
    asked = {"digits": number, "email": "@" in t, "url": url, "name": not t.isascii() and _TWO_HANGUL.search(t) is not None}
    for name, pattern in _REDACTED.items():
        if name in _RUNS:
            t = _blanked_at(t, runs, name) if number else t
        elif asked[name]:
            t = pattern.sub(_blanked, t)
    return t


# --- Arrow ------------------------------------------------------------------------------


def _spans(per_text: list[list[tuple[int, int, int]]], cut: list[str]) -> pa.Array:
    """Span arrays, one for each text; ``cut`` holds the texts of all spans."""
    flat = list(chain.from_iterable(per_text))
    kinds = pa.array([s[2] for s in flat], pa.int32())
    common = {name: pa.array([k[i] for k in _KINDS], pa.float64() if name == "score" else pa.string()).take(kinds)
              for i, name in enumerate(("label", "label_adjusted", "subtype", "score", "source", "keyword"))}
    columns = {"start": pa.array([s[0] for s in flat], pa.int32()), "end": pa.array([s[1] for s in flat], pa.int32()),
               "text": pa.array(cut, pa.string()), **common}
    ends = [0]
    for spans in per_text:
        ends.append(ends[-1] + len(spans))
    names = [name for name, _ in SPAN_FIELDS]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([columns[n] for n in names], names))


def _scanned(texts: pa.Array, scan: Callable[[str], list], prepare: Callable[[str], str] | None) -> pa.Array:
    parts = []
    # an empty batch has a type too
    for at in range(0, max(len(texts), 1), TEXTS):
        given = texts.slice(at, TEXTS).to_pylist()
        given = given if prepare is None else [t if t is None else prepare(t) for t in given]
        found = [[] if t is None else scan(t) for t in given]
        spans = _spans(found, [t[start:end] for t, mine in zip(given, found) for start, end, _ in mine])
        parts.append(spans if prepare is None else pa.StructArray.from_arrays([pa.array(given, pa.string()), spans], ["text", "spans"]))
    return pa.concat_arrays(parts)


def _column(text: Column, scan: Callable[..., list], allow: Iterable[str], deny: Iterable[str],
            prepare: Callable[[str], str] | None = None) -> Column:
    lists = tuple(allow), tuple(deny)

    def scanned(texts: pa.Array) -> pa.Array:
        return _scanned(texts, lambda t: scan(t, *lists), prepare)

    kind = SPANS if prepare is None else f"struct<text:string,spans:{SPANS}>"
    # not to be pushed below another step, and so made twice, where a filter asks for it
    return F.arrow_udf(scanned, kind).asNondeterministic()(F.make_valid_utf8(text))


def bank(text: Column, allow: Iterable[str] = (), deny: Iterable[str] = ()) -> Column:
    """Spans of the whole pattern bank with validators, contained spans pruned; null has none."""
    return _column(text, _raw_bank, allow, deny)


def default(text: Column, allow: Iterable[str] = (), deny: Iterable[str] = ()) -> Column:
    """Spans of the bank with refined numbers, then those of the domain keywords."""
    return _column(text, _default, allow, deny)


def everything(text: Column, use_nfkc: bool = True) -> Column:
    """``struct<text,spans>``: the normalised text, and the spans of every detector merged by priority."""
    return _column(text, _all, (), (), lambda t: normalized(t, use_nfkc))


@F.arrow_udf(StringType())
def _redacted_texts(texts: pa.Array) -> pa.Array:
    parts = [pa.array([t if t is None else redacted(t) for t in texts.slice(at, TEXTS).to_pylist()], pa.string())
             for at in range(0, max(len(texts), 1), TEXTS)]
    return pa.concat_arrays(parts)


def redaction(text: Column) -> Column:
    """``redacted`` for a column."""
    return _redacted_texts.asNondeterministic()(F.make_valid_utf8(text))
