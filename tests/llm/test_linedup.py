import random

from pyspark.sql import functions as F

from veilspan.llm import linedup


def brute(rows, k):
    sites = {}
    for _, text, site in rows:
        for line in (text or "").split("\n") if text is not None else []:
            if line.strip():
                sites.setdefault(line.strip(), set()).add(site)
    bad = {x for x, s in sites.items() if len(s - {None}) >= k}
    return sorted((d, None if t is None else "\n".join(x for x in t.split("\n") if x.strip() not in bad)) for d, t, _ in rows)


def test_against_brute_force(docs_of):
    rng = random.Random(4)
    pool = [f"line {i}" for i in range(60)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool[: rng.choice([5, 62])]) + rng.choice(["", " "]) for _ in range(rng.randint(1, 12))),
             f"s{rng.randint(0, 40)}") for i in range(300)]
    for k in (3, 8, 25):
        out = linedup.remove_boilerplate(docs_of(rows), k).collect()
        assert sorted((r["doc_id"], r["text"]) for r in out) == brute(rows, k)


def test_estimates_near_the_threshold_are_counted(docs_of):
    rows = [(i, "common\nown %d" % i, f"s{i}") for i in range(200)]
    assert {r["text"] for r in linedup.remove_boilerplate(docs_of(rows), 200).collect()} == {f"own {i}" for i in range(200)}
    assert all(r["n_removed"] == 0 for r in linedup.remove_boilerplate(docs_of(rows), 201).collect())


def test_odd_rows(odd):
    out = linedup.remove_boilerplate(odd.withColumn("n_lines", F.lit("x")), 1).collect()
    assert len(out) == odd.count()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[1]["text"] is None and by[1]["n_lines"] == 0
    assert by[2]["text"] == "" and by[2]["n_lines"] == 1 and by[2]["n_removed"] == 0
    assert by[4]["text"] == "" and by[9]["text"] == ""
    assert by[8]["text"] == "one two three four five six" or by[8]["n_removed"] == 1  # a null site counts for nothing itself
    assert linedup.remove_boilerplate(odd.limit(0), 2).count() == 0
