"""Long texts and hot keys: results as before, in time that grows with their size; streams that restart."""

import glob
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veilspan import streaming
from veilspan.functions import arrays, finditer
from veilspan.operators import detect, masking, overlap, transcripts
from veilspan.functions.checks import email_allowed
from veilspan.sources import responses


def timed(build):
    build()  # compiled once
    start = time.time()
    out = build()
    return out, time.time() - start


def test_many_matches_in_one_text(spark):
    words = [f"w{i % 61}é" if i % 5 else "x" for i in range(40_000)]
    for text in (" ".join(words), " ".join(w for w in words if "x" not in w), "", "no match"[:0]):
        df = spark.createDataFrame([(text,)], "text string")
        got, took = timed(lambda: df.select(finditer.find_all(F.col("text"), r"w\d+").alias("m")).first()["m"])
        assert [(m["start"], m["end"], m["text"]) for m in got] == [(*m.span(), m[0]) for m in re.finditer(r"w\d+", text)]
        assert took < 40


def test_slices_of_long_texts(spark):
    rng = random.Random(3)
    for size in (10, 5000, 9001):
        text = "".join(rng.choice("aé가😀") for _ in range(size))
        bounds = [(s, s + rng.choice([-2, 0, 1, 7, 1024, 3000])) for s in (rng.randrange(size) for _ in range(60))]
        df = spark.createDataFrame([(text, bounds)], "text string, b array<struct<start:int,end:int>>")
        assert df.select(arrays.sliced(F.col("text"), F.col("b")).alias("x")).first()["x"] == [text[s:e] if e > s else "" for s, e in bounds]


def spans_of(spark, text, bounds):
    df = spark.createDataFrame([(text, bounds)], "text string, s array<struct<start:int,end:int>>")
    return df.select("text", F.transform("s", lambda s: arrays.make_span(start=s["start"], end=s["end"], label=F.lit("이름"))).alias("spans"))


def test_masking_many_spans(spark):
    rng = random.Random(4)
    for trial in range(12):
        size = rng.choice([30, 6000])
        text = "".join(rng.choice("ab가😀 ") for _ in range(size))
        cuts = sorted(rng.sample(range(size), 24))
        bounds = list(zip(cuts[::2], cuts[1::2])) if trial % 3 else [(s, min(size, s + rng.randint(0, 9))) for s in cuts]
        got = masking.mask(spans_of(spark, text, bounds)).first()
        want = text
        for s, e in sorted(bounds, key=lambda b: -b[1]):
            want = want[:s] + got["records"][0]["masked_text"] + want[e:]
        assert got["masked_text"] == want
        assert sorted((r["start"], r["end"], r["original_text"]) for r in got["records"]) == sorted((s, e, text[s:e]) for s, e in bounds)
    text = "가나다라마바사아자차 " * 8000
    df = spans_of(spark, text, [(i * 11, i * 11 + 4) for i in range(8000)])
    got, took = timed(lambda: masking.mask(df).select("masked_text", F.size("records").alias("n")).first())
    assert got["n"] == 8000 and got["masked_text"] == "".join(f"{masked}마바사아자차 " for masked in [got["masked_text"].split("마")[0]] * 8000)
    assert took < 30


def test_overlap_anti_join_sweeps(spark):
    rng = random.Random(5)
    some = lambda n: [(rng.choice([1, 1, 1, 2, 3, None]), s, s + rng.choice([0, 1, 4, 30, 9000])) for s in (rng.randrange(20_000) for _ in range(n))]
    spans, cover = some(400) + [(1, None, 4), (1, 5, None)], some(60) + [(1, None, 9), (2, 3, None)]
    ddl = "doc_id long, start int, end int"
    out = overlap.uncovered_rows(spark.createDataFrame(spans, ddl), spark.createDataFrame(cover, ddl), "doc_id").collect()
    hit = lambda a, b: None not in (*a, *b) and a[0] == b[0] and a[1] < b[2] and b[1] < a[2]
    assert sorted(map(str, out)) == sorted(f"Row(doc_id={a[0]}, start={a[1]}, end={a[2]})" for a in spans if not any(hit(a, b) for b in cover))


def test_swallowed_different_chunks_take_logarithmic_rounds(spark, monkeypatch):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000)).strip()
    # every chunk ends in the first one's tail, so nothing of it is left, and no two neighbours are equal
    chunks = [base, *[f"{'x' * (1 + i % 37)}{base[-40 - i % 20:]}" for i in range(500)], "the end of the recording is here"]
    rounds = []
    cut = transcripts.cut_lineage
    monkeypatch.setattr(transcripts, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(chunks)], "rec_id string, chunk_index long, text string")
    out = [r["text"] for r in transcripts.stitched(df).orderBy("chunk_index").collect()]
    assert out == [base, *[""] * 500, chunks[-1]]
    assert len(rounds) <= 12


def test_list_tables_equal_literal_lists(spark):
    rng = random.Random(7)
    part = lambda: ".".join(rng.choice(["a", "mail", "kr", "co", "x5"]) for _ in range(rng.randint(1, 4)))
    mails = [(i, rng.choice([f"u@{part()}", f"U@{part().upper()}", "u@", "none", None])) for i in range(300)]
    df = spark.createDataFrame(mails, "i int, text string")
    for allow, deny in (([], []), (["kr", "x5.co"], []), ([], ["l", "a.kr"]), (["kr", "a", "mail.kr"], ["co.kr", "a"])):
        frame = lambda xs: spark.createDataFrame([(x,) for x in [*xs, *xs[:1]]], "suffix string")
        got = detect.email_allowed_rows(df, frame(allow), frame(deny)).select("i", F.coalesce("allowed", F.lit(False)).alias("ok"))
        want = df.select("i", F.coalesce(email_allowed(F.col("text"), allow, deny), F.lit(False)).alias("ok"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_quarantine_keeps_every_row(spark):
    raws = ['{"result":0}', "{", None, "  ", "[1]", '{"result":"x"}', '```json\n{"result":3}\n```', '{"other":1}', "null"]
    df = spark.createDataFrame(list(enumerate(raws)), "k int, raw string")
    good, bad = responses.quarantined(responses.parsed_or_raw(df, "raw", responses.ASR_RESPONSE, fences=True))
    assert {r["k"]: r["parsed"]["result"] for r in good.collect()} == {0: 0, 6: 3, 7: None}
    assert {r["k"]: (r["problem"], r["corrupt"]) for r in bad.collect()} == {
        1: ("broken", "{"), 2: ("missing", None), 3: ("missing", "  "), 4: ("broken", "[1]"), 5: ("broken", '{"result":"x"}'), 8: ("broken", "null")}


@pytest.mark.parametrize("lost", ["commit", "sink"])
def test_a_restarted_stream_restores_every_text(spark, tmp_path, lost):
    texts = [f"문의 user{i}@example.com 또는 010-1234-{i:04d}" if i % 3 else f"plain {i}" for i in range(40)]
    for n in range(4):
        spark.createDataFrame([(i, texts[i]) for i in range(n * 10, n * 10 + 10)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    docs = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")

    def run():
        streaming.write_with_vault(streaming.masked_stream(docs), f"{tmp_path}/out", f"{tmp_path}/state", "doc_id").trigger(availableNow=True).start().awaitTermination()

    run()
    # as if the stream had stopped after the files of the last batch, before or after the sink's log took them
    last = max(int(os.path.basename(p)) for p in glob.glob(f"{tmp_path}/state/commits/[0-9]*"))
    for folder in ["state/commits", "out/_spark_metadata"] if lost == "sink" else ["state/commits"]:
        os.remove(f"{tmp_path}/{folder}/{last}")
        os.remove(f"{tmp_path}/{folder}/.{last}.crc")
    run()
    out = streaming.restored(spark, f"{tmp_path}/out", "doc_id").collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == list(enumerate(texts))
    assert all(r["masked_text"] != r["text"] for r in out if r["doc_id"] % 3)
    assert streaming.masked_part(spark, f"{tmp_path}/out").columns == ["doc_id", "masked_text"]
    assert streaming.vault_part(spark, f"{tmp_path}/out").count() == sum(1 for i in range(40) if i % 3)
