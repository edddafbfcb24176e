import random
import re

import numpy as np
from pyspark.sql import functions as F

from veilspan.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    wins = {}
    for i in range(len(ws) - 7):
        wins.setdefault(tuple(ws[i:i + 8]), []).append(i)
    hit = {p for at in wins.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_statistics_against_brute_force(spark, folder, docs_of):
    rng = random.Random(12)
    texts = ["".join(rng.choice(["a ", "b ", "é", "\n", "\t", "#", "a b\n", "\x85", " ", "<| "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows += [(100_000 + i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: tuple(r[s] for s in rules.STATISTICS[:5]) for r in rules.statistics(docs_of(rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_learned_list_separates_and_reads_as_conditions(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x = {k: rng.random(n) for k in rules.FEATURES}
    bad = ((x["symbols_per_char"] > 0.8) & (x["mean_word"] < 0.5)) | (x["dup_line_share"] > 0.95)
    found = rules.learn(x, bad)
    mask = np.zeros(n, dtype=bool)
    for rule in found:
        mask |= rules._covers(rule, x, n)
    assert (mask == bad).mean() > 0.97 and 2 <= len(found) <= 8
    assert " ".join(str(c) for r in found for c in r).startswith(("symbols_per_char >= 0.79", "symbols_per_char >= 0.80", "dup_line_share >= 0.9", "mean_word <= "))


def test_no_rule_without_precision():
    rng = np.random.default_rng(4)
    x = {k: rng.random(600) for k in rules.FEATURES}
    assert rules.learn(x, rng.random(600) < 0.2) == []
    assert rules.learn(x, np.zeros(600, dtype=bool)) == []
    assert rules.learn({k: v[:0] for k, v in x.items()}, np.zeros(0, dtype=bool)) == []


def test_rules_run_as_conditional_expressions(spark, docs_of):
    stats = rules.statistics(docs_of([(1, "word " * 7 + " ".join(f"w{i}" for i in range(30))), (2, "#a " + " ".join(f"#w{i}" for i in range(30))), (3, "few")]))
    listed = [(rules.Condition("symbols_per_char", True, 0.1),), (rules.Condition("n_words", False, 31.0),)]
    out = {r["doc_id"]: (r["base_failed"], r["rule"], r["kept"]) for r in rules.judge(stats, listed).collect()}
    assert out == {1: (False, 0, True), 2: (False, 1, False), 3: (True, 2, False)}
    assert {r["rule"] for r in rules.judge(stats, []).collect()} == {0}


def test_labels_are_learned_on_documents(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    stats = rules.statistics(docs).cache()
    learned = rules.fit(stats, labels.where("doc_id % 2 = 0"))
    tested = rules.judge(stats, learned).join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "quality").collect()
    right = sum(r["kept"] == bool(r["quality"]) for r in tested)
    assert right / len(tested) > 0.85


def test_odd_rows(spark, odd):
    stats = rules.statistics(odd.withColumn("n_words", F.lit("z")))
    rows = stats.collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (1, 2):
            assert all(r[s] == 0 for s in rules.STATISTICS)
    labels = spark.createDataFrame([(6, 1), (6, 0), (None, 0), (7, None)], "doc_id long, quality int")
    learned = rules.fit(stats, labels)
    assert rules.judge(stats, learned).count() == len(rows)
    assert rules.statistics(odd.limit(0)).count() == 0 and rules.fit(stats.limit(0), labels) == []
