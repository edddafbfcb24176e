"""Quality rules learned as a decision list.

Texts are reduced to a few statistics.  From labelled statistics, sequential covering learns one
rule after another: a conjunction of thresholds is grown on one part of the labelled rows until
it covers hardly any good text, pruned on the other part, kept if it is precise there, and the
rows that it covers are set aside.  The result is an ordered list that reads like hand-written
filters and runs as a chain of Spark conditional expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, text_bytes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: Labelled rows that the rules are learned from, at most.
SAMPLE_ROWS = 20_000
#: Share of bad rows that a rule must reach on the rows it was not grown on, and rows it must cover there.
MIN_PRECISION = 0.9
MIN_COVERED = 3
MAX_RULES = 16
MAX_CONDITIONS = 4

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim", "n_lines"]
_UPPER = bytes(range(65, 91))


def _repeated(words: list[bytes]) -> int:
    """Words in windows of ``WINDOW`` words that stand twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.uint64)
    if len(ids) == len(words):
        return 0
    # two windows are equal when their numbers are: each doubling numbers pairs of half-windows exactly
    size = 1
    while size < WINDOW:
        pairs = codes[:-size] * np.uint64(len(words) + 1) + codes[size:]
        _, codes = np.unique(pairs, return_inverse=True)
        codes = codes.astype(np.uint64)
        size *= 2
    counts = np.bincount(codes.astype(np.int64))
    again = counts[codes.astype(np.int64)] > 1
    if not again.any():
        return 0
    step = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    step[at] += 1
    step[at + WINDOW] -= 1
    return int((np.cumsum(step)[:-1] > 0).sum())


def measure(body: bytes | None) -> tuple[int, ...]:
    """The ``STATISTICS`` of a text in UTF-8; all 0 for null and empty."""
    if not body:
        return (0,) * len(STATISTICS)
    words = body.split()
    lines = body.split(b"\n")
    seen: set[bytes] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    blanks = len(body) - len(body.translate(None, b" \t\n\r\x0b\x0c"))
    continued = 0 if body.isascii() else len(body) - len(body.decode("utf-8", "replace"))
    return (len(words), len(body) - blanks - continued, len(body) - len(body.translate(None, SYMBOLS)), dup, _repeated(words),
            len(body) - len(body.translate(None, _UPPER)), body.count(b"!"), len(lines))


_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(s, pa.int64()) for s in STATISTICS]])


def statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the ``STATISTICS`` of every row of ``docs``, over whole texts.

    Words are runs of anything but ASCII white space.  ``word_chars`` counts code points in words,
    ``n_symbols`` the characters of ``SYMBOLS``, ``n_dup_lines`` lines with a word that equal an
    earlier line, ``n_repeat_words`` words in windows of 8 words that stand twice or more.
    """
    def rows(columns: list) -> Iterator[tuple]:
        for doc, body in zip(*columns, strict=True):
            yield doc, *measure(body)

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return narrow.mapInArrow(batches(rows, _SCHEMA), "doc_id long, " + ", ".join(f"{s} long" for s in STATISTICS))


#: What rules may test, as SQL over the statistics: plain counts and shares that do not depend on length.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "exclaim_per_word": "n_exclaim / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def base_failed() -> Column:
    """Too short, or more than 30 % of the words repeated."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    mask = np.ones(n, dtype=bool)
    for c in rule:
        mask &= x[c.feature] >= c.threshold if c.above else x[c.feature] <= c.threshold
    return mask


def _candidates(values: np.ndarray) -> np.ndarray:
    """Thresholds: midpoints between neighbouring quantiles of the distinct values."""
    distinct = np.unique(values)
    if len(distinct) > 128:
        distinct = np.unique(np.quantile(distinct, np.linspace(0, 1, 129)))
    return (distinct[1:] + distinct[:-1]) / 2


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition with the largest information gain until no good row is covered."""
    rule: tuple[Condition, ...] = ()
    live = np.ones(len(bad), dtype=bool)
    while len(rule) < MAX_CONDITIONS and (live & ~bad).any():
        p, n = (live & bad).sum(), (live & ~bad).sum()
        best, gain = None, 1e-9
        for name, values in x.items():
            v, y = values[live], bad[live]
            order = np.argsort(v, kind="stable")
            v, hits = v[order], np.concatenate([[0], np.cumsum(y[order])])
            cuts = _candidates(v)
            k = np.searchsorted(v, cuts, side="right")
            for above in (True, False):
                pos = hits[-1] - hits[k] if above else hits[k]
                neg = (len(v) - k if above else k) - pos
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - np.log2(p / (p + n))), 0.0)
                if len(g) and g.max() > gain:
                    i = int(g.argmax())
                    best, gain = Condition(name, above, float(cuts[i])), float(g[i])
        if best is None:
            break
        rule += (best,)
        live &= _covers((best,), x, len(bad))
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop final conditions while that raises (bad - good) / covered on rows not grown on."""
    def worth(r: Rule) -> float:
        mask = _covers(r, x, len(bad))
        p, n = (mask & bad).sum(), (mask & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 0) -> list[Rule]:
    """An ordered list of rules for bad rows; empty when nothing precise can be said."""
    rules: list[Rule] = []
    live = np.arange(len(bad))
    rng = np.random.default_rng(seed)
    for _ in range(MAX_RULES):
        if not bad[live].any():
            break
        mixed = rng.permutation(live)
        grown, held = mixed[: 2 * len(mixed) // 3], mixed[2 * len(mixed) // 3:]
        take = lambda at: {k: v[at] for k, v in x.items()}
        rule = _grow(take(grown), bad[grown])
        if not rule:
            break
        rule = _prune(rule, take(held), bad[held])
        mask = _covers(rule, take(held), len(held))
        covered, right = int(mask.sum()), int((mask & bad[held]).sum())
        if covered < MIN_COVERED or right < MIN_PRECISION * covered:
            break
        rules.append(rule)
        live = live[~_covers(rule, take(live), len(live))]
    return rules


def fit(stats: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", seed: int = 0) -> list[Rule]:
    """Rules from the first ``SAMPLE_ROWS`` labelled rows, in the order of a hash.

    Label 0 is bad.  Null ids and labels are left out, as are rows that the base rule rejects
    anyway; of contradicting labels of an id the bad one holds.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(
        F.min(F.col(label).cast("int")).alias("_y"))
    joined = stats.where(~base_failed()).join(known, "doc_id")
    values = [F.expr(sql).alias(name) for name, sql in FEATURES.items()]
    rows = (joined.select("doc_id", "_y", *values).dropDuplicates(["doc_id"])
            .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(SAMPLE_ROWS).collect())
    bad = np.array([r["_y"] == 0 for r in rows], dtype=bool)
    return learn({name: np.array([r[name] for r in rows], dtype=float) for name in FEATURES}, bad, seed)


def fired(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that holds for a row of statistics; 0 if none does."""
    chain = None
    for number, rule in enumerate(rules, 1):
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        chain = F.when(test, number) if chain is None else chain.when(test, number)
    return F.lit(0) if chain is None else chain.otherwise(0)


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``base_failed``, ``rule`` (0: none) and ``kept`` to rows of statistics.

    Every row gets a verdict: one without words fails the base rule.
    """
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", fired(rules)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0))
