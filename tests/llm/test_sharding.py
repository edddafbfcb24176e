import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import sharding


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                used, at = used + 1, 0
            at += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("n,shards,stretches", [(1, 3, 64), (5, 5, 64), (400, 7, 64), (3000, 9, 64), (3000, 40, 1 << 16)])
def test_cuts_are_minimax(spark, monkeypatch, n, shards, stretches):
    monkeypatch.setattr(sharding, "STRETCHES", stretches)
    rng = random.Random(n)
    places = rng.sample(range(1 << sharding.POSITION_BITS), n)
    rows = sorted((p, rng.choice([1, 5, 50, 400])) for p in places)
    cuts, capacity = sharding.contiguous_cuts(spark.createDataFrame(rows, "place long, bytes long"), shards)
    assert capacity == brute_capacity([b for _, b in rows], shards)
    sums = Counter()
    for p, b in rows:
        sums[int(np.searchsorted(cuts, p, side="right"))] += b
    assert max(sums.values()) <= capacity and len(sums) <= shards


def test_assignment(docs_of):
    rng = random.Random(8)
    texts = ["t%d " % i * rng.randint(1, 60) for i in range(800)]
    rows = [(i, texts[i % 800] if i < 1600 else "hot " * 30) for i in range(2600)]
    out = sharding.assign(docs_of(rows).withColumn("shard", F.lit("z")), 8).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(2600))
    homes, slots, sums = defaultdict(set), defaultdict(list), Counter()
    for r in out:
        homes[r["text"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        sums[r["shard"]] += r["size"]
        assert r["size"] == len(r["text"].encode()) + 16
    assert all(len(v) == 1 for v in homes.values())
    assert set(slots) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    hot = next(iter(homes["hot " * 30]))
    rest = [v for k, v in sums.items() if k != hot]
    assert max(rest) - min(rest) < 0.2 * max(rest)


def test_odd_rows(odd):
    out = sharding.assign(odd, 3).collect()
    assert len(out) == odd.count()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 16
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r["shard"] for r in out if not r["text"]}) == 1
    assert sharding.assign(odd.limit(0), 3).count() == 0
    assert {r["shard"] for r in sharding.assign(odd, 1).collect()} == {0}
