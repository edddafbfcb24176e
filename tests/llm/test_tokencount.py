import random

from pyspark.sql import functions as F

from veilspan.llm import tokencount


def greedy(word, pieces):
    n = at = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in pieces:
                at, n = end, n + 1
                break
        else:
            return 1
    return n


def test_against_plain_greedy_matching():
    rng = random.Random(9)
    for trial in range(300):
        letters = b"ab" if trial % 2 else b"abc"
        pieces = {bytes(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 14))}
        automaton = tokencount.Automaton(sorted(pieces))
        for _ in range(40):
            word = bytes(rng.choice(letters) for _ in range(rng.randint(0, 20)))
            assert automaton.count(word) == (greedy(word, pieces) if word else 0), (pieces, word)


def test_public_vocabulary_on_documents(spark, folder):
    pieces = set(tokencount.read_vocabulary())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tokencount.token_counts(docs).collect()}
    for r in docs.collect():
        words = r["text"].encode().split()
        assert got[r["doc_id"]] == (len(words), sum(greedy(b" " + w, pieces) for w in words))


def test_odd_rows(odd):
    out = tokencount.token_counts(odd.withColumn("n_tokens", F.lit("z")), [b" one", b"x", b"xxx"]).collect()
    assert len(out) == odd.count()
    by = {r["doc_id"]: r for r in out}
    assert [by[i]["n_tokens"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert by[9]["n_tokens"] == 1  # the blank before the word is no piece: unknown
    assert tokencount.token_counts(odd, [b" ", b"x", b"xxx"]).where("doc_id = 9").first()["n_tokens"] == 1 + 100_000
    assert tokencount.token_counts(odd.limit(0), [b"a"]).count() == 0
