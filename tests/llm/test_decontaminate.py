import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspan.llm import decontaminate

ITEMS = "item_id long, text string"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    wins = []
    for item, text in items:
        ws = words(text)
        k = min(window, len(ws))
        wins += [(item, ws[i:i + k]) for i in range(len(ws) - k + 1)] if ws else []
    out = {}
    for doc, text in docs:
        ws, hit, named = words(text), set(), set()
        for item, w in wins:
            for i in range(len(ws) - len(w) + 1):
                if ws[i:i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    named.add(str(item))
        out[doc] = (len(ws), len(hit), sorted(named))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_against_brute_force(spark, docs_of, block_bytes):
    rng = random.Random(11)
    for trial in range(4):
        letters = "aAbé" if trial % 2 else "abcde"
        some = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(letters) for _ in range(n))  # noqa: E731,B023
        items = [(i, some(rng.choice([0, 1, 2, 3, 5, 10, 12, 25]))) for i in range(14)]
        docs = [(i, some(rng.choice([0, 4, 30, 90])) + " " + rng.choice(items)[1]) for i in range(50)]
        if trial > 1:
            items = [x for x in items if len(words(x[1])) != 1]
        window = 4 if trial else 10
        found = decontaminate.report(docs_of(docs), spark.createDataFrame(items, ITEMS), window=window, block_bytes=block_bytes).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in found} == brute(docs, items, window)


def test_removal(spark, docs_of):
    item = " ".join(f"q{i}" for i in range(15))
    filler = " ".join(f"f{i}" for i in range(40))
    docs = docs_of([(1, f"{filler}. {item.upper()}! {filler}"), (2, item), (3, filler), (4, None), (5, ""), (6, "short one here")])
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "...")], ITEMS)
    # a hit on a short item counts by default
    assert 6 not in {r["doc_id"] for r in decontaminate.remove(docs, bench).collect()}
    out = {r["doc_id"]: r for r in decontaminate.remove(docs, bench, min_span=10).collect()}
    assert out[1]["text"] == f"{filler}. ! {filler}" and out[1]["n_chars"] == len(out[1]["text"])
    assert 2 not in out and out[3]["text"] == filler and out[4]["text"] is None and out[5]["text"] == "" and out[6]["text"] == "short one here"


def test_pipeline_stage_removes_short_items(spark, docs_of, tmp_path):
    import corpus_pipeline

    long = " ".join(f"q{i}" for i in range(12))
    short, filler = "What is the capital of Peru", " ".join(f"f{i}" for i in range(40))
    spark.createDataFrame([(1, short), (2, long)], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = docs_of([(1, short), (2, f"{filler}. {short}? {filler}"), (3, f"{filler} the capital of Peru {filler}"), (4, f"{long}\n{short.upper()}! {filler}"),
                    (5, f"{short}; {short}, {' '.join(filler.split()[:6])}"), (6, None), (7, "")])
    out = {r["doc_id"]: r for r in corpus_pipeline.remove_benchmark(spark, docs, str(tmp_path)).collect()}
    assert {d: r["text"] for d, r in out.items()} == {
        2: f"{filler}. ? {filler}", 3: f"{filler} the capital of Peru {filler}", 4: f"! {filler}", 6: None, 7: ""}
    assert out[2]["n_chars"] == len(out[2]["text"])


def test_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four five six"), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], ITEMS)
    out = decontaminate.report(odd.withColumn("items", F.lit("z")), bench).collect()
    assert len(out) == odd.count()
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0 and by[8]["items"] == ["1"]
    assert by[6]["n_hit"] == 62 * 11 and by[6]["items"] == []
    assert decontaminate.report(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.report(odd.limit(0), bench).count() == 0
    assert decontaminate.remove(odd, bench.limit(0)).count() == odd.count()


def test_digest(spark):
    one = spark.createDataFrame([(["1", "10", "2"],), ([],)], "items array<string>").select(decontaminate.digest("items").alias("d")).collect()
    assert [r["d"] for r in one] == [hashlib.sha256(b"1,10,2").hexdigest(), hashlib.sha256(b"").hexdigest()]
