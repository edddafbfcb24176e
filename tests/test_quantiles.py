"""Exact quantiles by sketched brackets, against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.plans import ordered


def keys_and_values():
    rng = random.Random(11)
    return {
        "magnitudes": [rng.choice([-1, 1]) * 10 ** rng.uniform(-150, 150) for _ in range(20_000)],
        "crowded": [1.0 + i * 1e-12 for i in range(9_000)] + [1e300],
        "one heavy value": [5.0] * 15_000 + [rng.random() * 10 for _ in range(5_000)],
        "all equal": [2.0] * 700,
        "edges": [float("-inf"), -0.0, 0.0, 1.0, float("inf")],
        "pair": [3.0, 4.0],
        "single": [7.0],
        None: [float(i) for i in range(50)],
    }


@pytest.mark.parametrize("per_bucket", [4, 65536])
def test_quantiles_equal_numpy(spark, per_bucket):
    made = keys_and_values()
    rows = [(k, v) for k, vs in made.items() for v in vs] + [("pair", None), ("nulls", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for p in (0.0, 0.2, 0.5, 1.0):
        got = {r.k: r.q for r in ordered.exact_quantile(df, ["k"], "v", p, "q", per_bucket=per_bucket).collect()}
        assert set(got) == set(made)
        for k, vs in made.items():
            vs = sorted(vs)
            spot = (len(vs) - 1) * p
            a, b = vs[int(np.floor(spot))], vs[int(np.ceil(spot))]
            # an infinity and a number have no value between them
            want = a if a == b else a + (b - a) * (spot - int(spot))
            assert got[k] == want or (np.isnan(got[k]) and np.isnan(want)), (k, p)


def test_a_missed_bracket_is_widened(spark):
    df = spark.range(40_000).select(F.lit("a").alias("k"), ((F.col("id") * 7919) % 40_000).cast("double").alias("v"))
    # a bracket without any room around the rank misses
    values = df.select("k", F.col("v").alias("_v"))
    assert not all(ordered._bracketed(values, ["k"], 0.2, 8, -2 / 8)[1] for _ in range(5))
    assert ordered.exact_quantile(df, ["k"], "v", 0.2, k=8).collect() == [("a", 7999.8)]


def test_not_a_number_and_no_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", nan), ("a", nan), ("b", 1.0), ("b", nan), ("b", 3.0)], "k string, v double")
    got = {r.k: r.quantile for r in ordered.exact_quantile(df, ["k"], "v", 0.5).collect()}
    assert np.isnan(got["a"]) and got["b"] == 3.0
    assert ordered.exact_quantile(df.limit(0), ["k"], "v", 0.5).collect() == []
