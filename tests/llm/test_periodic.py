import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from veilspan.llm import periodic, queries


def brute(words):
    """All runs by trying every period at every place."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        x = 0
        while x + q < n:
            s = x
            while x + q < n and words[x] == words[x + q]:
                x += 1
            length = x + q - s
            if x > s and length >= max(6, 4 * q):
                part = words[s:s + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.add((s, length, q))
            x = max(x, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng):
    letters, n = rng.randint(1, 4), rng.randint(0, 70)
    words = [f"w{rng.randrange(letters)}" for _ in range(n)]
    for _ in range(rng.randint(0, 2) if n else 0):
        s, p = rng.randrange(n), rng.randint(1, 9)
        for i in range(s, min(n, s + p * rng.randint(2, 8))):
            words[i] = words[s + (i - s) % p]
    return words


def test_random_texts_against_brute_force():
    rng = random.Random(13)
    for _ in range(1500):
        part = [some_words(rng) for _ in range(rng.randint(1, 5))]
        made = list(periodic._documents([" ".join(w).encode() if w else None for w in part]))
        for words, (n, runs, text) in zip(part, made, strict=True):
            found = [(r["start"], r["length"], r["period"]) for r in runs]
            assert n == len(words) and found == brute(words), words
            assert text.decode() == collapsed(words, found)


def test_long_repeats():
    for n, period in ((100_000, 1), (100_000, 13), (65_536, 16_384), (65_535, 16_384)):
        found = periodic.find_runs(np.arange(n, dtype=np.int64) % period)
        assert [x.tolist() for x in found] == ([[0], [n], [period]] if n >= 4 * period else [[], [], []])


def test_wavelet_tree():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = periodic.WaveletTree(values)
        lo = rng.integers(0, n, 200)
        hi = lo + 1 + rng.integers(0, n, 200) % (n - lo)
        x = rng.integers(0, n, 200)
        assert tree.below(lo, hi, x).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(lo, hi, x)]
        k = rng.integers(0, n, 200) % (hi - lo)
        assert tree.smallest(lo, hi, k).tolist() == [sorted(values[a:b])[v] for a, b, v in zip(lo, hi, k)]


def planted(doc, text):
    words = (text or "").encode().split()
    h, n = (zlib.crc32(str(doc).encode()) if doc is not None else 1), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return [w.decode() for w in words]


def expected(doc, text):
    words = planted(doc, text)
    runs = brute(words)
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), start, length, period, 1000 * length // period if runs else None,
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(collapsed(words, runs)))


def test_query_against_brute_force(spark, folder):
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, folder).collect())
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    # brute force takes the square of a text's words
    short = [r for r in rows if len(r["text"].split()) <= 1500]
    assert len(got) == len(rows) and len(short) > 0.9 * len(rows) and sum(r[1] > 0 for r in got) > 5
    mine = {r["doc_id"] for r in short}
    assert [r for r in got if r[0] in mine] == sorted(expected(r["doc_id"], r["text"]) for r in short)


def test_odd_rows(spark, tmp_path, odd, docs_of):
    shorter = odd.where("text is null or length(text) < 1000")
    found = periodic.runs(shorter.withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("z")).withColumn("collapsed", F.lit(2)))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"] and found.count() == shorter.count()
    assert all(r["runs"] == [] for r in found.collect())
    assert [r["collapsed"] for r in found.where("doc_id in (1, 2, 3)").collect()] == ["", "", ""]
    long = {r["doc_id"]: r for r in periodic.runs(odd.where("doc_id in (6, 7, 9)")).collect()}
    assert [tuple(x) for x in long[6]["runs"]] == [(0, 60_000, 977)] == [tuple(x) for x in long[7]["runs"]]
    assert long[6]["collapsed"] == " ".join(f"w{i}" for i in range(977)) and long[9]["n_words"] == 1
    assert periodic.runs(odd.limit(0)).count() == 0
    # the query's own repeats on nulls, blanks and short texts
    rows = [(i, t) for i in range(40) for t in (None, "", " \n ", "a", "a b c a b c", "가 나 가 나 가 나 가 나 x")] + [(None, None), (None, "a a a a a a a")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(got, key=key) == sorted((expected(*r) for r in rows), key=key)
