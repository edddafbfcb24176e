"""A Korean corpus built from table keys.

The driver tables hold no Hangul, so identifiers of known position are composed from ``orders``
keys.  A sentence is a list of pieces, each an SQL expression over the key ``k`` that both
engines evaluate alike; the expected spans follow from the lengths of the pieces, without any
pattern matching.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pad(expr: str, n: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {n}, '0')"


def pick(key: str, *options: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options))
    return f"(CASE {key} % {len(options)} {cases} END)"


def _digit(s: str, i: int) -> str:
    return f"CAST(substr({s}, {i}, 1) AS INT)"


def _mixed(factor: int, modulus: int) -> str:
    return f"((k * {factor} + 17) % {modulus})"


@dataclass(frozen=True)
class Piece:
    sql: str
    label: str | None = None
    subtype: str | None = None
    when: str = "1 = 1"


# identifiers -----------------------------------------------------------------------------

_R6 = _pad(_mixed(7919, 1000000), 6)
_R6B = _pad(_mixed(104729, 1000000), 6)
_RW = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]
_RSUM = " + ".join(f"{_digit(_R6 if i < 6 else _R6B, i % 6 + 1)} * {w}" for i, w in enumerate(_RW))
RESIDENT_CHECK = f"((11 - (({_RSUM}) % 11)) % 10)"


def resident(sep: str, wrong: str = "0") -> str:
    """Check digit moved by ``wrong``."""
    return f"({_R6} || {sep} || {_R6B} || CAST(({RESIDENT_CHECK} + {wrong}) % 10 AS STRING))"


# a leading 2 keeps business numbers from also being telephone numbers
_B9 = f"('2' || {_pad(_mixed(7907, 100000000), 8)})"
_BW = [1, 3, 7, 1, 3, 7, 1, 3, 5]
_BSUM = " + ".join(f"{_digit(_B9, i + 1)} * {w}" for i, w in enumerate(_BW))
_BTOTAL = f"({_BSUM} + CAST(floor({_digit(_B9, 9)} * 5 / 10) AS INT))"
BUSINESS_CHECK = f"((10 - ({_BTOTAL} % 10)) % 10)"


def business(sep: str, wrong: str = "0") -> str:
    return (f"(substr({_B9}, 1, 3) || {sep} || substr({_B9}, 4, 2) || {sep} || substr({_B9}, 6, 4) || "
            f"CAST(({BUSINESS_CHECK} + {wrong}) % 10 AS STRING))")


_C15 = f"('4' || {_pad(_mixed(7901, 100000000), 8)} || {_pad(_mixed(6997, 1000000), 6)})"
_CSUM = " + ".join(
    (f"(CASE WHEN {_digit(_C15, i)} > 4 THEN {_digit(_C15, i)} * 2 - 9 ELSE {_digit(_C15, i)} * 2 END)" if i % 2 else _digit(_C15, i))
    for i in range(1, 16))
CARD_CHECK = f"((10 - (({_CSUM}) % 10)) % 10)"


def card(sep: str, wrong: str = "0") -> str:
    return (f"(substr({_C15}, 1, 4) || {sep} || substr({_C15}, 5, 4) || {sep} || substr({_C15}, 9, 4) || {sep} || "
            f"substr({_C15}, 13, 3) || CAST(({CARD_CHECK} + {wrong}) % 10 AS STRING))")


ACCOUNT = f"('1' || {_pad(_mixed(31, 1000), 3)} || '-' || {_pad(_mixed(37, 1000), 3)} || '-' || {_pad(_mixed(7919, 1000000), 6)})"
LICENCE = f"({_pad(_mixed(3, 100), 2)} || '-' || {_pad(_mixed(7877, 1000000), 6)} || '-' || {_pad(_mixed(11, 100), 2)})"
PASSPORT = f"({pick('k', 'M', 'S', 'm')} || {_pad(_mixed(7873, 100000000), 8)})"
EMAIL = "('user' || CAST(k AS STRING) || '@mail' || CAST(k % 7 AS STRING) || '.co.kr')"
HOST = "('https://intra' || CAST(k % 9 AS STRING) || '.example.co.kr/m/' || CAST(k AS STRING))"
PLAIN_NAME = f"({pick('k', '김', '남궁', '이', '제갈', '박', '최')} || {pick('k', '민수', '지영', '서준', '하')} || {pick('k', '씨', '님', '')})"
NAME = (f"({pick('k', '김', '남궁', '이', '제갈', '박', '최')} || {pick('k', '', '', '', '·', '')} || "
        f"{pick('k', '민수', '지영', '서준', '하')} || {pick('k', '씨', '님', '')})")


def phone(sep: str) -> str:
    return (f"({pick('k', '010', '02', '031', '070', '011')} || {sep} || {_pad(_mixed(41, 10000), 4)} || {sep} || "
            f"{_pad(_mixed(7919, 10000), 4)})")


def mobile(sep: str) -> str:
    """Eleven digits, so never mistaken for a ten-digit business number."""
    return f"({pick('k', '010', '031', '070', '011')} || {sep} || {_pad(_mixed(41, 10000), 4)} || {sep} || {_pad(_mixed(7919, 10000), 4)})"


ADDRESS = (f"({pick('k', '서울시', '부산광역시', '세종특별자치시', '경기도', '서울특별시')} || ' ' || "
           f"{pick('k', '마포구', '해운대구', '강남구')} || ' ' || {pick('k', '상암동', '우동', '역삼동', '신사동')} || ' ' || "
           f"CAST(1 + k % 900 AS STRING) || {pick('k', '', '-12', '-3, 101호', ' (04524)')})")
DATE = (f"(CAST(1990 + k % 40 AS STRING) || {pick('k', '-', '.', '/')} || CAST(1 + k % 12 AS STRING) || "
        f"{pick('k', '-', '.', '/')} || {_pad('1 + k % 28', 2)})")


# sentences -------------------------------------------------------------------------------


def text_sql(pieces: list[Piece]) -> str:
    return " || ".join(p.sql for p in pieces)


def dealt(keys: DataFrame) -> DataFrame:
    """Keys dealt over all cores before they become texts: a small file of keys is a single split, and so a single task."""
    cores = keys.sparkSession.sparkContext.defaultParallelism
    return keys.repartition(max(4 * cores, keys.rdd.getNumPartitions()))


def sentences(orders: DataFrame, pieces: list[Piece]) -> DataFrame:
    """``(doc_id, text)``, one sentence per order."""
    keyed = dealt(orders.select(F.col("o_orderkey").alias("k")))
    return keyed.select(F.col("k").alias("doc_id"), F.expr(text_sql(pieces)).alias("text"))


def expected_sql(pieces: list[Piece], columns: str = "doc_id, span_start, span_end, span_text, label, subtype",
                 where: str = "1 = 1") -> str:
    """DuckDB query of the spans the pieces declare."""
    cols = ", ".join(f"{p.sql} AS s{i}" for i, p in enumerate(pieces))
    parts = []
    for i, p in enumerate(pieces):
        if p.label is None:
            continue
        before = " + ".join(f"length(s{j})" for j in range(i)) or "0"
        subtype = "CAST(NULL AS VARCHAR)" if p.subtype is None else f"'{p.subtype}'"
        parts.append(
            f"SELECT k AS doc_id, CAST({before} AS BIGINT) AS span_start, CAST({before} + length(s{i}) AS BIGINT) AS span_end, "
            f"s{i} AS span_text, '{p.label}' AS label, {subtype} AS subtype FROM pieces WHERE {p.when}")
    union = " UNION ALL ".join(parts)
    return f"WITH pieces AS MATERIALIZED (SELECT k, {cols} FROM (SELECT o_orderkey AS k FROM orders)), spans AS ({union}) SELECT {columns} FROM spans WHERE {where}"
