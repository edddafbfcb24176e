import hashlib
import math
import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from veilspan.llm import centroids, queries
from veilspan.session import written

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=8, rounds=10, dims=64):
    """``[(key, cluster, distance)]``, centroids and inertia, by Python's integers."""
    kept = [(key, [math.floor(1024 * x) for x in v]) for key, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda key: hashlib.sha256(f"3:{'' if key is None else key}".encode()).hexdigest()
    center = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(center))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        center = [[sum(xs) // len(groups[n]) for xs in zip(*groups[n])] if n in groups else c for n, c in enumerate(center)]
    out = [(key, nearest(v)[1], nearest(v)[0]) for key, v in kept]
    return out, center, [sum(d for _, c, d in out if c == n) for n in range(len(center))]


def of(spark, rows):
    return spark.createDataFrame([(a, b, 0) for a, b in rows], SCHEMA)


def by_key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def check(spark, rows, **how):
    table, found = centroids.fit(of(spark, rows), **how)
    out, center, inertia = plain([(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b]) for a, b in rows],
                                 how.get("k", 8), how.get("rounds", 10), how.get("dims", 64))
    assert by_key(centroids.assign(table, found).collect()) == by_key(out)
    assert found.centroids == center and found.inertia == inertia
    return table


def test_against_plain_integers(spark):
    rng = random.Random(12)
    check(spark, [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(300)], dims=6, k=5, rounds=4)


def test_blocks_follow_the_data(spark, monkeypatch):
    rng = random.Random(5)
    few = [[rng.randrange(3) / 8 for _ in range(8)] for _ in range(4)]
    repeated = check(spark, [(i, rng.choice(few)) for i in range(200)], dims=8, k=3, rounds=3)
    assert {r["width"] for r in repeated.collect()} == {8}
    pairs = [[x for _ in range(4) for x in rng.choice(((0.5, 0.25), (0.125, 0.75), (0.375, 0.0)))] for _ in range(600)]
    monkeypatch.setattr(centroids, "SMALL", 0.1)
    assert {r["width"] for r in check(spark.newSession(), list(enumerate(pairs)), dims=8, k=3, rounds=2).collect()} <= {2, 4}


def test_encoding_loses_nothing():
    rng = np.random.default_rng(4)
    for dims, high in ((1, 3), (5, 2), (7, 1000), (64, 4)):
        whole = rng.integers(-high, high, (500, dims))
        width, dictionaries, codes = centroids.encoded(whole)
        assert np.array_equal(np.concatenate([d[codes[:, b]] for b, d in enumerate(dictionaries)], axis=1), whole)
        assert sum(d.shape[1] for d in dictionaries) == dims and all(d.shape[1] <= width for d in dictionaries)


def test_many_chunks_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(centroids, "CHUNK", 16)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(100)]
    table = written(centroids.chunks(of(spark, rows).coalesce(1), key="vec_id", vector="embedding", dims=3, scale=1024))
    assert max(len(r["keys"]) for r in table.collect()) <= 16 and sum(len(r["keys"]) for r in table.collect()) == 100


def test_ties_and_empty_clusters(spark):
    # two equal first centroids: the second gets no vector and stays
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [4.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0])]
    for k in (1, 2, 4, 8):
        check(spark, rows, dims=2, k=k, rounds=3)


def test_odd_rows(spark):
    bad = float("nan"), float("inf"), -float("inf"), None
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, 2.0, 3.0]), *((10 + i, [x, 1.0]) for i, x in enumerate(bad)),
            (None, [0.5, -0.5]), (None, [0.25, -0.0]), (5, [-0.0005, 0.0005]), (6, [1.0, 1.0]), (6, [1.0, 1.0])]
    check(spark, rows, dims=2, k=3, rounds=2)
    table, found = centroids.fit(of(spark, rows).limit(0))
    assert found.centroids == [] and centroids.assign(table, found).collect() == [] and found.table(spark).count() == 0
    clashing = of(spark, rows).withColumn("cluster", F.lit("z")).withColumn("keys", F.lit(1)).withColumn("x", F.lit(2))
    table, found = centroids.fit(clashing, dims=2, k=3, rounds=2)
    assert by_key(centroids.assign(table, found).collect()) == by_key(plain(rows, 3, 2, 2)[0])


def test_components_that_would_overflow(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.fit(of(spark, [(1, [2.0e5, 0.0]), (2, [0.0, 0.0])]), dims=2, k=2, rounds=1)
    with pytest.raises(ValueError, match="64 bits"):
        centroids.fit(of(spark, []), dims=200)


def test_query_of_an_empty_table(spark, tmp_path):
    of(spark, []).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op12_centroids(spark, str(tmp_path)).count() == 0


def test_query_against_plain_integers(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    out, center, inertia = plain(rows)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in center]
    assert by_key(queries.op12_centroids(spark, folder).collect()) == by_key(
        (key, c, d, inertia[c], sum(inertia), digest[c]) for key, c, d in out)
    assert oracle.compare(queries.op12_centroids(spark, folder), oracle.connect(folder), queries.ORACLES["op12_centroids"]) is None
