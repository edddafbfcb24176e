"""Checksum and plausibility tests for candidate spans."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as L
from .arrays import bind
from .finditer import char_slice, contains_match, full_match, unicode_regex


# every decimal digit of any script and its value
_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def digits_of(text: Column) -> Column:
    only = F.regexp_replace(text, r"[^\p{Nd}]", "")
    ascii_only = F.when(only.rlike("[^0-9]"), F.translate(only, "".join(_DIGITS), _VALUES)).otherwise(only)
    return F.transform(F.filter(F.split(ascii_only, ""), lambda c: c != ""), lambda c: c.try_cast("int"))


def _weighted(digits: Column, weights: list[int]) -> Column:
    pairs = F.zip_with(F.slice(digits, 1, len(weights)), F.array(*[F.lit(w) for w in weights]), lambda d, w: d * w)
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + x)


def luhn_ok(text: Column) -> Column:
    def doubled(x: Column) -> Column:
        return F.when(x > 4, x * 2 - 9).otherwise(x * 2)

    def ok(d: Column) -> Column:
        parts = F.transform(d, lambda x, i: F.when(i % 2 == F.size(d) % 2, doubled(x)).otherwise(x))
        return (F.size(d) >= 12) & (F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0)

    return bind(digits_of(text), ok)


def resident_ok(text: Column) -> Column:
    def ok(d: Column) -> Column:
        check = (11 - _weighted(d, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]) % 11) % 10
        return F.when(F.size(d) == 13, check == F.get(d, F.lit(12))).otherwise(False)

    return bind(digits_of(text), ok)


def business_ok(text: Column) -> Column:
    def ok(d: Column) -> Column:
        total = _weighted(d, [1, 3, 7, 1, 3, 7, 1, 3, 5]) + F.floor(F.get(d, F.lit(8)) * 5 / 10)
        return F.when(F.size(d) == 10, (10 - total % 10) % 10 == F.get(d, F.lit(9))).otherwise(False)

    return bind(digits_of(text), ok)


def email_allowed(address: Column, allow: Iterable[str] = (), deny: Iterable[str] = ()) -> Column:
    """Deny wins over allow; both compare by domain suffix.  Empty lists mean no restriction."""
    domain = F.lower(F.regexp_extract(address, r"@([A-Za-z0-9.-]+)\z", 1))
    ok = domain != ""
    deny, allow = list(deny), list(allow)
    if deny:
        ok = ok & ~F.exists(F.array(*[F.lit(d) for d in deny]), lambda d: F.endswith(domain, d))
    if allow:
        ok = ok & F.exists(F.array(*[F.lit(a) for a in allow]), lambda a: F.endswith(domain, a))
    return ok


def account_ok(text: Column, start: Column, hit: Column) -> Column:
    """At least two separators, or a bank word within the 15 characters to the left."""
    left = char_slice(text, F.greatest(start - 15, F.lit(0)), start)
    seps = F.regexp_count(hit, F.lit(unicode_regex(r"[\s\-]")))
    return (seps >= 2) | contains_match(left, L.BANK_WORDS)


def is_email(text: Column) -> Column:
    return full_match(text, L.EMAIL)


def bounds_ok(start: Column, end: Column, length: Column) -> Column:
    return (start >= 0) & (start < end) & (end <= length)


def clip_confidence(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))
