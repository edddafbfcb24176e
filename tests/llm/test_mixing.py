import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspan.llm import mixing


@pytest.mark.parametrize("mean", [0.01, 0.7, 3.0, 30.0])
def test_distribution_is_poisson(spark, mean):
    cdf = spark.range(1).select(mixing.distribution(F.lit(mean)).alias("c")).first()["c"]
    total = 0.0
    for k, c in enumerate(cdf):
        total += math.exp(k * math.log(mean) - math.lgamma(k + 1) - mean)
        assert c == pytest.approx(total, abs=1e-12)
    assert cdf[-1] == pytest.approx(1, abs=1e-12)


def test_mean_copies_meet_the_rate(spark, docs_of):
    docs = docs_of([(i, "t", "a" if i % 3 else "b") for i in range(3000)])
    rates = spark.createDataFrame([("a", 2.5), ("b", 70.0)], "source string, rate double")
    out = mixing.replicate(docs, rates, seed=3).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in out}
    assert abs(n["a"] / 2000 - 2.5) < 5 * math.sqrt(2.5 / 2000)
    assert abs(n["b"] / 1000 - 70) < 5 * math.sqrt(70 / 1000)


def test_draws_do_not_depend_on_the_layout(spark, docs_of):
    docs = docs_of([(i, f"t{i}", f"s{i % 4}") for i in range(200)])
    pick = lambda df: Counter((r["doc_id"], r["copy"], r["order_key"]) for r in mixing.mix(df, epochs=2.0, seed=1).collect())
    assert pick(docs) == pick(docs.repartition(7))


def test_weights_set_the_shares(docs_of):
    docs = docs_of([(i, "x" * 10, "a" if i < 900 else "b") for i in range(1000)])
    rates = {r["source"]: r["rate"] for r in mixing.target_rates(docs, {"a": 1.0, "b": 3.0}, epochs=2.0).collect()}
    assert rates["a"] == pytest.approx(2 * 10000 * 0.25 / 9000)
    assert rates["b"] == pytest.approx(2 * 10000 * 0.75 / 1000)
    assert sorted(r["rate"] for r in mixing.target_rates(docs, {"a": 1.0}).collect()) == pytest.approx([0.0, 10000 / 9000])


def test_odd_rows(odd):
    out = mixing.mix(odd.withColumn("copy", F.lit("x")), alpha=1.0, epochs=3.0, seed=2)
    assert set(odd.columns) < set(out.columns)
    rows = out.collect()
    assert {r["source"] for r in rows} <= {"src0", None}
    for (_, text), copies in Counter((r["doc_id"], r["text"]) for r in rows).items():
        assert copies >= 1
    assert mixing.mix(odd.limit(0)).count() == 0


def test_a_source_without_text_keeps_rate_one(docs_of):
    rates = {r["source"]: r["rate"] for r in mixing.target_rates(docs_of([(1, None, "e"), (2, "abc", "f")])).collect()}
    assert rates["e"] == 1.0
