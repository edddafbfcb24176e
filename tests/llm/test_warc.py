import glob
import gzip
import hashlib
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from veilspan.llm import warc


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("z"))


def test_round_trip(spark):
    rng = random.Random(6)
    tricky = ["", "\n", "\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc", "é" * 40_000, "x" * 16_384, "a\r", "\n\n\n" * 9000]
    bodies = tricky + ["".join(rng.choice("ab\r\nçé<>") for _ in range(rng.choice([3, 999, 5000, 40_000]))) for _ in range(40)]
    rows = [(i, rng.choice([None, "http://a b/\r\nX: y", "https://é.example/"]), b) for i, b in enumerate(bodies)]
    folder = tempfile.mkdtemp() + "/w"
    warc.write(frame(spark, rows).repartition(3), folder)
    out = {r["page_id"]: r for r in warc.read_pages(spark, folder).collect()}
    assert {k: bytes(r["payload"]).decode() for k, r in out.items()} == dict(enumerate(bodies))
    records = warc.read_records(spark, folder)
    assert records.where("segment > 1").count() > 10
    assert records.where(F.octet_length("content") > warc.SEGMENT_BYTES).count() == 0


def test_the_files_are_plain_warc(spark):
    folder = tempfile.mkdtemp() + "/w"
    warc.write(frame(spark, [(7, "http://a/", "body")]).coalesce(1), folder)
    raw = b"".join(gzip.open(p).read() for p in glob.glob(folder + "/*.gz"))
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    assert raw.startswith(b"WARC/1.1\r\n") and fields[b"WARC-Type"] == b"response"
    content = rest[: int(fields[b"Content-Length"])]
    assert rest[len(content):] == b"\r\n\r\n" and warc.payload_of(content) == b"body"


def test_revisits(spark):
    big, other = "p" * 1000, "q" * 999
    rows = [(1, "u", big), (2, "u", big), (9, "u", big), (9, "u", big), (None, "u", big), (3, "u", other), (4, "u", other),
            (5, "u", None), (6, None, ""), (8, "u", "é" * 500), (7, "u", "é" * 500)]
    folder = tempfile.mkdtemp() + "/w"
    warc.write(frame(spark, rows), folder)
    out = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.inventory(spark, folder).collect()), key=str)
    sha = {r["page_id"]: r["payload_digest"] for r in warc.inventory(spark, folder).collect()}
    assert out == sorted([(0, 1000, "revisit", 9), (1, 1000, "revisit", 9), (2, 1000, "revisit", 9), (9, 1000, "response", None), (9, 1000, "response", None),
                          (3, 999, "response", None), (4, 999, "response", None), (5, 0, "response", None), (6, 0, "response", None),
                          (7, 1000, "revisit", 8), (8, 1000, "response", None)], key=str)
    assert sha[1] == hashlib.sha1(big.encode()).hexdigest() and sha[5] == hashlib.sha1(b"").hexdigest()


def test_lost_segments_and_wrong_lengths_are_errors(spark):
    folder = tempfile.mkdtemp()
    warc.write(frame(spark, [(1, "u", "z" * 50_000)]).coalesce(1), folder + "/w")
    raw = b"".join(gzip.open(p).read() for p in glob.glob(folder + "/w/*.gz"))
    records = [b"WARC/1.1" + r for r in raw.split(b"WARC/1.1")[1:]]
    assert len(records) == 4

    def read(parts, name):
        os.makedirs(f"{folder}/{name}")
        with gzip.open(f"{folder}/{name}/x.warc.gz", "wb") as f:
            f.write(b"".join(parts))
        return warc.read_pages(spark, f"{folder}/{name}").count()

    assert read(records[::-1], "turned") == 1
    for name, parts in {"gap": records[:1] + records[2:], "tail": records[:3],
                        "total": [r.replace(b"Total-Length: 5", b"Total-Length: 6") for r in records]}.items():
        with pytest.raises(Exception, match="whole record"):
            read(parts, name)


def test_a_file_that_ends_inside_a_record_is_an_error(spark):
    folder = tempfile.mkdtemp()
    pages = [(i, "u", f"{i}" * size) for i, size in enumerate((50, 500, 5000, 40_000, 700))]
    warc.write(frame(spark, pages).coalesce(1), folder + "/w")
    raw = b"".join(gzip.open(p).read() for p in glob.glob(folder + "/w/*.gz"))

    def read(part, name):
        os.makedirs(f"{folder}/{name}")
        # a whole file before and after, so that the end of a file is also met between files
        for at, body in (("a", part), ("b", raw.replace(b"WARC-Page-ID: ", b"WARC-Page-ID: 9"))):
            with gzip.open(f"{folder}/{name}/{at}.warc.gz", "wb") as f:
                f.write(body)
        return warc.read_pages(spark, f"{folder}/{name}").count()

    assert read(raw, "whole") == 10 and read(raw[:-2], "last_line_end") == 10
    heads = raw.rindex(b"WARC/1.1")
    for name, size in (("in_content", len(raw) - 150), ("last_byte", len(raw) - 5), ("line_ends", len(raw) - 4), ("in_head", heads + 40), ("in_segments", raw.index(b"continuation") + 3000)):
        with pytest.raises(Exception, match="ends inside a record|whole record"):
            read(raw[:size], name)


def test_identifiers_follow_from_the_page(spark):
    big = "".join(f"<p>{i}</p>" for i in range(4000))
    rows = [(1, "http://a/", big), (2, "http://b/", big), (2, "http://b/", big), (2, None, big), (3, "http://c/", big + "x"), (3, "http://c/", big + "x"), (3, "http://c/", big + "y")]
    folder = tempfile.mkdtemp()
    ids = []
    for name, parts in (("one", 1), ("four", 4)):
        warc.write(frame(spark, rows).repartition(parts), f"{folder}/{name}")
        records = warc.read_records(spark, f"{folder}/{name}").collect()
        ids.append(sorted(r["record_id"] for r in records))
        assert sorted((r["page_id"], r["record_type"], bytes(r["payload"] or b"")) for r in warc.read_pages(spark, f"{folder}/{name}").collect()) == sorted(
            (i, "revisit" if i == 1 else "response", b"" if i == 1 else b.encode()) for i, _, b in rows)
    assert ids[0] == ids[1]
    raw = b"".join(gzip.open(p).read() for p in glob.glob(f"{folder}/one/*.gz"))
    assert raw.count(b"WARC-Refers-To: ") == 1 and raw.split(b"WARC-Refers-To: ")[1].split(b"\r\n")[0].decode() in ids[0]


def test_empty_table(spark):
    folder = tempfile.mkdtemp() + "/w"
    warc.write(frame(spark, [(1, "u", "z")]).limit(0), folder)
    assert warc.inventory(spark, folder).count() == 0
