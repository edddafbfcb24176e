import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from veilspan.llm import bytebpe, queries


@pytest.fixture(scope="module")
def codec():
    return bytebpe.codec()


@pytest.fixture(scope="module")
def library(codec):
    ranks = {t: i for i, t in enumerate(bytebpe.read_ranks(bytebpe.default_path()))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_letters_are_their_bytes():
    raw = bytes(range(256)) * 2
    assert bytebpe.to_bytes(bytebpe.to_letters(raw)) == raw and bytebpe.to_letters(b"") == ""


def test_random_texts_as_the_library_encodes_them(codec, library):
    rng = random.Random(11)
    inside = codec.open()
    texts = [""]
    for _ in range(3000):
        top = rng.choice([0x80, 0x250, 0x3000, 0xD800, 0x110000])
        chars = [c for c in (rng.randrange(top) for _ in range(rng.randint(0, 40))) if not 0xD800 <= c < 0xE000]
        texts.append("".join(map(chr, chars)).replace("b", "\n ").replace("c", "'s"))
    ids, places = inside.encode(texts)
    for text, s, e in zip(texts, places, places[1:]):
        assert ids[s:e].tolist() == library.encode_ordinary(text)
        assert inside.decode(ids[s:e].tolist()) == text.encode()


def test_characters_newer_than_the_library(codec, library):
    inside = codec.open()
    letters, numbers = (eval(f'"{r[:10]}"') if r else "" for r in codec.newer)  # noqa: S307 - the first character of a range
    for text in (f"a{letters}b {letters}{letters} 1{numbers}2", f" {numbers}", f"{letters} {numbers}\n"):
        assert inside.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_a_token_that_merges_do_not_reach():
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abc", b"xyz"]
    ranks = {t: i for i, t in enumerate(tokens)}
    library = tiktoken.Encoding("few", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    inside = bytebpe.Codec(tokens, r"\S+|\s+").open()
    for text in ("xyz", "xyzz", "abc", "abcab bcabc", "aabbcc"):
        assert inside.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_a_small_memory_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 10)
    inside = bytebpe.Codec(bytebpe.read_ranks(bytebpe.default_path()), public_tokenizers.PATTERN).open()
    for text in ("the first text", "another one, the first", "", "x" * 5000):
        assert inside.encode([text])[0].tolist() == library.encode_ordinary(text)
        assert inside.size <= 10 + len(text)


def test_vocabulary_without_a_byte_is_refused():
    with pytest.raises(ValueError, match="lacks 1 single"):
        bytebpe.serialise([bytes([b]) for b in range(255)])


def test_query_against_the_library(spark, folder, library):
    got = {r["doc_id"]: r for r in queries.op11_byte_bpe(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"])
        row = got[r["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_odd_rows(spark, odd, codec, library):
    clashing = odd.withColumn("ids", F.lit("z")).withColumn("body", F.lit("z"))
    encoded = bytebpe.encode(clashing, codec)
    assert encoded.columns == ["doc_id", "ids"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    expected = sorted(((r["doc_id"], library.encode_ordinary(r["text"] or "")) for r in odd.collect()), key=key)
    assert sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=key) == expected
    back = bytebpe.decode(encoded.withColumn("body", F.lit("z")), codec)
    assert back.columns == ["doc_id", "ids", "body"]
    assert sorted((bytes(r["body"]).decode() for r in back.collect())) == sorted(r["text"] or "" for r in odd.collect())
    assert bytebpe.decode(bytebpe.encode(odd.limit(0), codec), codec).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["body"] for r in bytebpe.decode(none, codec).orderBy("doc_id").collect()] == [None, b""]


def test_bytes_that_are_no_utf8(spark, codec, library):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert bytebpe.encode(docs, codec).first()["ids"] == library.encode_ordinary("a�b")
