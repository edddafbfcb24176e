import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import components, neardup


def shingle_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)}


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {(a, b) for at in by.values() for k, b in enumerate(at) for a in at[:k]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def family(seed, copies, edits, size=120):
    rng = random.Random(seed)
    base = [f"{seed}w{rng.randint(0, 5000)}" for _ in range(size)]
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(size)] = f"e{rng.randint(0, 10**9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("chunk", [256, 8])
def test_components_against_brute_force(docs_of, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK_NODES", chunk)
    texts = family(1, 120, 5) + family(2, 40, 2) + [t for s in range(3, 40) for t in family(s, 3, 3)] + ["Short one", "short ONE", "a b c d e", "A b C d e"]
    rng = random.Random(2)
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(1000 + i, t.upper()) for i, t in enumerate(texts[:20])]
    out = neardup.groups(docs_of(rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_on_the_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.groups(docs).collect()}
    assert out == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_pruning_bounds():
    needed = neardup.least_matches(0.85, 1e-6)
    assert len(needed) == 6 and needed == sorted(needed)
    rng = np.random.default_rng(1)
    agree = rng.random((200_000, 144)) < 0.85
    lost = np.zeros(len(agree), dtype=bool)
    for step, least in enumerate(needed):
        lost |= agree[:, : (step + 1) * 24].sum(axis=1) < least
    assert lost.mean() < 1e-3
    assert neardup.band_miss(0.85) < 2e-5


def test_components(spark):
    rng = random.Random(3)
    links = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [(f"z{rng.randint(0, 40)}", f"z{rng.randint(0, 40)}") for _ in range(25)] + [("h", f"h{i}") for i in range(200)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in components.labels(spark.createDataFrame(links, "a string, b string")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}
    assert components.labels(spark.createDataFrame([], "a string, b string")).count() == 0


def test_odd_rows(odd, spark):
    out = neardup.groups(odd.withColumn("node", F.lit("z"))).collect()
    assert len(out) == odd.count()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True)
    assert by[4] == (1, 4, True) and by[5] == (1, 4, False) and by[6][1] == by[7][1] == 6 and by[8] == (2, 8, True)
    assert neardup.groups(odd.limit(0)).count() == 0
    unnamed = spark.createDataFrame([(None, "one two three four five six seven"), (None, "one two three four five six seven!")], odd.schema.fieldNames()[:2] and "doc_id long, text string")
    assert {r["component_id"] for r in neardup.groups(unnamed).collect()} == {None}


def test_keep_one(odd, spark, tmp_path):
    odd.write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    kept = neardup.keep_one(table)
    assert kept.columns == odd.columns
    # 5 and its repeat are copies of 4, 7 of 6, the row without an id of 8; rows without words stay
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 9]


def test_pipeline_stage_links_from_four_fifths(docs_of, spark, folder):
    import corpus_pipeline

    texts = [t for s in range(50, 110) for t in family(s, 3, 4)]
    # four new words change 20 shingles: 180 of 220 and 160 of 200 are shared, 0.82 and exactly 0.8
    for size in (204, 184):
        pair = [[f"b{size}x{i}" for i in range(size)] for _ in range(2)]
        pair[1][20:160:40] = ["new", "other", "third", "last"]
        texts += [" ".join(p) for p in pair]
    rows = list(enumerate(texts))
    at = {percent: {d for d, (_, least) in brute(rows, percent).items() if d == least} for percent in (80, 85)}
    assert at[80] < at[85]
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs_of(rows), folder).collect()} == at[80]


def test_layouts():
    assert neardup.layout(0.85) == (24, 6) and neardup.layout(0.8) == (32, 5)
    assert neardup.band_miss(0.8, *neardup.layout(0.8)) < 1e-5 < 6e-4 < neardup.band_miss(0.8)
    needed = neardup.least_matches(0.8, 1e-6, total=160)
    assert len(needed) == 7 and needed == sorted(needed)
