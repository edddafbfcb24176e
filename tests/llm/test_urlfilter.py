import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from veilspan.llm import urlfilter

DAY = dt.datetime(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def brute(captures, entries):
    out = []
    for cid, host, at in captures:
        best = None
        parts = host.split(".") if host else []
        for i in range(max(len(parts) - 1, 1) if parts else 0):
            name = ".".join(parts[i:])
            mine = {}
            for d, action, since in entries:
                if d == name and since <= at:
                    mine.setdefault(since, set()).add(action)
            if mine:
                last = mine[max(mine)]
                if last == {"add"}:
                    best = name
                    break
        out.append((cid, best))
    return sorted(out)


@pytest.mark.parametrize("hot", [urlfilter.HOT_ROWS, 3])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(urlfilter, "HOT_ROWS", hot)
    rng = random.Random(5)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "w.b.org", "local"]
    for _ in range(3):
        entries = [(rng.choice(hosts), rng.choice(["add", "remove"]), day(rng.randint(0, 200))) for _ in range(40)]
        caps = [(i, rng.choice(hosts), day(rng.randint(0, 220)) + dt.timedelta(hours=rng.choice([0, 5]))) for i in range(300)]
        frame = spark.createDataFrame([(c, f"http://u@{h}:80/p?q", a) for c, h, a in caps], "page_id long, url string, fetched_at timestamp")
        out = urlfilter.judge(frame, spark.createDataFrame(entries, "domain string, action string, since timestamp")).collect()
        assert sorted((r["page_id"], r["list_domain"]) for r in out) == brute(caps, entries)
        assert all(r["blocked"] == (r["list_domain"] is not None) for r in out)


def test_intervals_merge_and_never_overlap(spark):
    rows = [("A.com.", "add", day(1)), ("a.com", "add", day(3)), ("a.com", "remove", day(5)), ("a.com", "add", day(5)),
            ("a.com", "add", day(9)), (None, "add", day(1)), ("b.com", None, day(1)), ("c.com", "add", None), ("d.com", "remove", day(1))]
    out = urlfilter.intervals(spark.createDataFrame(rows, "domain string, action string, since timestamp")).collect()
    assert sorted((r["domain"], r["valid_from"], r["valid_to"]) for r in out[:1]) == [("a.com", day(1), day(5))] or len(out) == 2
    assert {(r["domain"], r["valid_from"], r["valid_to"]) for r in out} == {("a.com", day(1), day(5)), ("a.com", day(9), None)}


def test_odd_rows(spark):
    rows = [(1, None, day(1)), (2, "", day(1)), (3, "not a url", day(1)), (4, "http://a.com/x", None), (None, "http://a.com/x", day(2)),
            (5, "http://a.com/x", day(2)), (5, "http://a.com/x", day(2)), (6, "http://" + "q." * 5000 + "a.com/", day(2))]
    frame = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp").withColumn("domain", F.lit("z")).withColumn("blocked", F.lit("z"))
    entries = spark.createDataFrame([("a.com", "add", day(1))], "domain string, action string, since timestamp")
    out = urlfilter.judge(frame, entries).collect()
    assert len(out) == len(rows)
    assert sorted((r["page_id"] or 0, r["blocked"]) for r in out) == [
        (0, True), (1, False), (2, False), (3, False), (4, False), (5, True), (5, True), (6, True)]
    assert urlfilter.judge(frame.limit(0), entries).count() == 0
    assert {r["blocked"] for r in urlfilter.judge(frame, entries.limit(0)).collect()} == {False}
