import random

from pyspark.sql import functions as F

from veilspan.llm import toxicity


def corpus(n, seed=1):
    rng = random.Random(seed)
    calm = ["".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.25)
        parts = [[rng.choice(calm) for _ in range(rng.randint(4, 10))] for _ in range(rng.randint(2, 10))]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                rng.choice(parts).insert(1, rng.choice(["vile", "zorkfe" + rng.choice(["lo", "man", "tik", "as"]), "quixot" + rng.choice(["al", "em"])]))
        rows.append((i, ". ".join(" ".join(p).capitalize() for p in parts) + ".", toxic))
    return rows


def test_held_out_accuracy_and_location(spark, docs_of):
    rows = corpus(1500)
    docs = docs_of([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 900], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score(docs.where("doc_id >= 900"), model).collect()}
    right = sum((out[i]["score"] >= 0.5) == bool(y) for i, _, y in rows[900:])
    assert right / 600 > 0.97
    for i, text, y in rows[900:]:
        assert 0 <= out[i]["score"] <= 1
        for s in out[i]["offending"]:
            if y:
                assert any(w in text[s["start"]:s["end"]].lower() for w in ("vile", "zorkfe", "quixot"))
    kept = {r["doc_id"] for r in toxicity.reject(docs, model).collect()}
    assert kept == {r["doc_id"] for r in toxicity.score(docs, model).where("score < 0.5").collect()}


def test_score_is_the_noisy_or_of_sentences():
    model = toxicity.Model(-3.0, {"bad": 4.0, "wor*": 1.0, "worse": 2.0})
    value, n, found = toxicity.scorer(model, 0.5)("Fine words. Bad bad one! 123.\nWorse")
    sig = lambda z: 1 / (1 + 2.718281828459045**-z)
    # "words" shares the prefix with "worse"
    assert n == 3 and abs(value - (1 - (1 - sig(-2)) * (1 - sig(1)) * (1 - sig(0)))) < 1e-12
    assert [(a, b) for a, b, _ in found] == [(11, 23), (30, 35)]


def test_nothing_to_learn_from(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).where("score >= 0.5").count() == 0
    one_sided = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None), (77, 1)], "doc_id long, toxic int")
    assert toxicity.train(odd, one_sided).weights == {}


def test_odd_rows(odd):
    model = toxicity.Model(-3.0, {"one": 9.0})
    out = toxicity.score(odd.withColumn("score", F.lit("z")), model).collect()
    assert len(out) == odd.count()
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[1] == by[2] == by[3] == 0.0 and by[4] > 0.9 and by[8] > 0.9 and by[9] < 0.5
    assert toxicity.score(odd.limit(0), model).count() == 0 and toxicity.reject(odd.limit(0), model).count() == 0
    assert {r["doc_id"] for r in toxicity.reject(odd, model).collect()} == {1, 2, 3, 6, 7, 9, None}


def test_long_texts_leave_their_place_in_the_sample_to_others(spark, docs_of, monkeypatch):
    rows = corpus(300)
    long = " calm" * 5000
    docs = docs_of([(i, long if i % 3 == 0 else t) for i, t, _ in rows] + [(1, "zz")])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", {1: 20, 0: 50})
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, weight: seen.append(rows))
    toxicity.train(docs, labels)
    assert sum(y for _, y in seen[0]) == 20 and len(seen[0]) == 70 and all(len(t) <= toxicity.SAMPLE_TEXT_BYTES for t, _ in seen[0])


def test_extra_columns_stay(odd):
    model = toxicity.Model(-3.0, {"one": 9.0})
    clashing = odd.withColumn("score", F.lit("z")).withColumn("offending", F.lit(1))
    assert toxicity.reject(clashing, model).columns == clashing.columns
