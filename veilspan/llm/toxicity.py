"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a logistic score, and the document's score
is their noisy-or: one minus the chance that no sentence is toxic.  Only documents are labelled;
the sentence weights are those that explain the document labels best, so the model also says
which sentences offend.

A sentence is described by its distinct words and by their first 3 to 6 letters, so that
inflected and compounded forms of a word share a feature.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.session import written

from .common import batches, once, shared, text_bytes

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
PREFIXES = (3, 4, 5, 6)

#: Bounds of the training sample: rows of each label, bytes of a text, features of the model.
SAMPLE_ROWS = {1: 4000, 0: 6000}
SAMPLE_TEXT_BYTES = 20_000
MAX_FEATURES = 20_000
#: A feature must stand in so many toxic sample texts, with such evidence (likelihood ratio), to be used.
MIN_TEXTS = 3
MIN_EVIDENCE = 15.0


def sentences(text: str) -> list[tuple[int, int]]:
    """Bounds of the parts between sentence ends that hold a letter."""
    found, at = [], 0
    for m in SENTENCE.finditer(text):
        if WORD.search(text, at, m.start()):
            found.append((at, m.start()))
        at = m.end()
    if WORD.search(text, at):
        found.append((at, len(text)))
    return found


def features(word: str) -> list[str]:
    """The word itself and its proper prefixes, marked with ``*``."""
    return [word, *[word[:k] + "*" for k in PREFIXES if k < len(word)]]


@dataclass
class Model:
    """Weights of features and the bias of a sentence."""

    bias: float
    weights: dict[str, float]

    def word_weight(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))


def _softplus(z):
    return np.logaddexp(0.0, z)


def _evidence(a: int, n1: int, b: int, n0: int) -> float:
    """Likelihood ratio of a feature in ``a`` of ``n1`` toxic and ``b`` of ``n0`` other texts."""
    def side(k: int, n: int, p: float) -> float:
        return (k * math.log(k / n / p) if k else 0.0) + ((n - k) * math.log((1 - k / n) / (1 - p)) if k < n else 0.0)

    p = (a + b) / (n1 + n0)
    return 2 * (side(a, n1, p) + side(b, n0, p)) if 0 < p < 1 else 0.0


def fit(rows: list[tuple[str, int]], other_weight: float = 1.0, *, rounds: int = 300, ridge: float = 0.02) -> Model:
    """Fit on ``(text, label)``; ``other_weight`` is what an unlabelled-toxic row counts.

    Without rows of both labels nothing can be learned and every sentence gets the same tiny score.
    """
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    if not n1 or not n0:
        return Model(-12.0, {})
    toxic, other = Counter(), Counter()
    for text, y in rows:
        words = set(WORD.findall(text.lower()))
        (toxic if y else other).update({f for w in words for f in features(w)})
    scored = []
    for f, a in toxic.items():
        b = other.get(f, 0)
        if a >= MIN_TEXTS and a * n0 > b * n1:
            strength = _evidence(a, n1, b, n0)
            if strength >= MIN_EVIDENCE:
                scored.append((-strength, f))
    index = {f: i for i, (_, f) in enumerate(sorted(scored)[:MAX_FEATURES])}
    # sentences without any feature differ only by their number
    cells_s, cells_f, bag, plain = [], [], [], np.zeros(len(rows))
    for d, (text, _) in enumerate(rows):
        low = text.lower()
        for a, b in sentences(low):
            used = [index[f] for w in set(WORD.findall(low, a, b)) for f in features(w) if f in index]
            if used:
                cells_s += [len(bag)] * len(used)
                cells_f += used
                bag.append(d)
            else:
                plain[d] += 1
    s, f, bag = np.array(cells_s, dtype=np.int64), np.array(cells_f, dtype=np.int64), np.array(bag, dtype=np.int64)
    y = np.array([label for _, label in rows])
    cost = np.where(y == 1, 1.0, other_weight)
    w, bias = np.full(len(index), 0.5), -math.log(20.0 * max(1.0, float(np.mean(plain) + 1)))
    theta = np.concatenate([w, [bias]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, bias = theta[:-1], theta[-1]
        z = bias + np.bincount(s, weights=w[f], minlength=len(bag)) if len(bag) else np.zeros(0)
        total = plain * _softplus(bias) + np.bincount(bag, weights=_softplus(z), minlength=len(rows))
        # d loss / d total: 1 for other rows, -(1 - P) / P for toxic ones, P = 1 - exp(-total)
        slope = cost * np.where(y == 1, -1.0 / np.expm1(np.maximum(total, 1e-12)), 1.0)
        each = slope[bag] / (1.0 + np.exp(-z))
        grad = np.concatenate([
            np.bincount(f, weights=each[s], minlength=len(index)) + ridge * w,
            [each.sum() + (slope * plain).sum() / (1.0 + math.exp(-bias))]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta[-1] = min(theta[-1], -2.0)
    return Model(float(theta[-1]), {name: float(theta[i]) for name, i in index.items()})


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
          seed: int = 0) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs``.

    The sample is the first ``SAMPLE_ROWS`` ids of each label in the order of a hash; ids without
    a text of 1 to ``SAMPLE_TEXT_BYTES`` bytes are passed over and the next ones take their place.
    The other label counts by its share of all labels.  Null ids and labels are left out; of
    contradicting labels of an id the toxic one holds; of repeated rows of an id the smallest text.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_id")).agg(
        F.max(F.col(label).cast("int")).alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    body = F.col(text).cast("string")
    fitting = docs.where(F.octet_length(body).between(1, SAMPLE_TEXT_BYTES))
    usable = written(known.join(fitting.select(F.col(key).alias("_id")), "_id", "left_semi"))
    order = F.xxhash64(F.lit(seed), "_id")
    parts = [usable.where(F.col("_y") == y).orderBy(order, "_id").limit(n) for y, n in SAMPLE_ROWS.items()]
    # at most the sum of SAMPLE_ROWS ids: a proven bound
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    found = fitting.select(F.col(key).alias("_id"), body.alias("_text")).join(chosen, "_id").groupBy("_id").agg(
        F.min("_text").alias("_text"), F.first("_y").alias("_y"))
    rows = [(r["_text"], r["_y"]) for r in found.select("_id", "_text", "_y").orderBy("_id").collect()]
    in_sample = Counter(y for _, y in rows)
    share = (counts.get(0, 0) / max(1, in_sample[0])) / (counts.get(1, 0) / max(1, in_sample[1])) if counts.get(1) else 1.0
    return fit(rows, max(share, 1e-6))


def held_out(key: str = "doc_id") -> Column:
    """A fifth of the ids, by a checksum, whose labels are kept for testing; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scorer(model: Model, locate: float | None = None):
    """``text -> (score, sentences, [(start, end, score)])`` with a memory of word weights."""
    base = math.log1p(math.exp(model.bias))
    known: dict[str, float] = {}

    def weight(word: str) -> float:
        w = known.get(word)
        if w is None:
            if len(known) >= 300_000:
                known.clear()
            w = known[word] = model.word_weight(word)
        return w

    def score(text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        if not text:
            return 0.0, 0, []
        low = text.lower()
        hot = {w for w in set(WORD.findall(low)) if weight(w)}
        if not hot:
            n = sum(1 for part in SENTENCE.split(low) if WORD.search(part))
            return -math.expm1(-n * base), n, []
        total, n, offending = 0.0, 0, []
        same = len(low) == len(text)  # lower-casing may lengthen a text; then offsets are of the lower-cased one
        for a, b in sentences(low):
            n += 1
            words = hot.intersection(WORD.findall(low, a, b))
            z = model.bias + sum(known.get(w) or weight(w) for w in words) if words else model.bias
            total += max(z, 0.0) + math.log1p(math.exp(-abs(z)))
            if locate is not None and words:
                p = 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z))))
                if p >= locate:
                    offending.append((a, b, p) if same else (a, min(b, len(text)), p))
        return -math.expm1(-total), n, offending

    return score


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("score", pa.float64()), ("n_sentences", pa.int64()),
    ("offending", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])
SCORED = "doc_id long, score double, n_sentences long, offending array<struct<start: long, end: long, score: double>>"


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", locate: float = 0.5) -> DataFrame:
    """``(doc_id, score, n_sentences, offending)`` of every row of ``docs``.

    ``offending`` lists the bounds (code points) and scores of sentences that score at least
    ``locate``.  Null, empty and wordless texts have no sentences and score 0.  Repeated rows are
    scored each; other columns are ignored; an empty table gives an empty result.  The model has at most ``MAX_FEATURES`` weights.
    """
    judging = once(shared(docs.sparkSession, model), lambda m: scorer(m, locate))

    def rows(columns: list) -> Iterator[tuple]:
        judge = judging()
        for doc, body in zip(*columns, strict=True):
            value, n, found = judge(body.decode("utf-8", "replace") if body else None)
            yield doc, value, n, [{"start": a, "end": b, "score": p} for a, b, p in found]

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return narrow.mapInArrow(batches(rows, _SCHEMA), SCORED)


def reject(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged with all columns.

    Null and empty texts score 0 and stay; repeated rows are judged each; an empty table stays empty.
    """
    judging = once(shared(docs.sparkSession, model), scorer)
    at = docs.columns.index(text)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = judging()
        for whole in stream:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                keep = [judge(body)[0] < threshold for body in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
