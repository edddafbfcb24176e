"""Findings of the third round: work that must grow no faster than its input."""

import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from veilspan import lexicon as L
from veilspan.functions import text as text_functions
from veilspan.functions.finditer import marked_text
from veilspan.operators import detect, tokens as tokens_operator, transcripts
from veilspan.plans import corpus as C, stream_queries, transcript_queries
from veilspan.plans.corpus import Piece
from veilspan.plans.masking_queries import docs_with_spans
from veilspan.sources import tokens


def timed(run):
    start = time.perf_counter()
    return run(), time.perf_counter() - start


def test_hosts_are_found_fast_between_numbers(spark):
    bank = {name: (name, pattern, label, subtype) for name, pattern, label, subtype in L.PATTERN_BANK}
    line = "번호 1188-372-124402, 801010-1234567 a-b.co.kr/x 2024.01.02 -x.kr x.y-z.com a_b.kr http://h w.1 "
    want = ["a-b.co.kr/x", "x.kr", "x.y-z.com", "http://h"]
    df = spark.createDataFrame([(line,), (line * 50,)], "text string")
    found = df.select(F.transform(detect.pattern_spans(F.col("text"), *bank["url"]), lambda s: s["text"]))
    assert [r[0] for r in found.collect()] == [want, want * 50]
    many = spark.createDataFrame([(line * 40_000,)], "text string")
    scan = lambda pattern, first=None: many.select(F.md5(marked_text(F.col("text"), pattern, first=first))).collect()
    # every run of letters and digits, behind a look-around: what any scan of the text costs
    scan(L.URL, detect._FIRST.get("url"))
    _, base = timed(lambda: scan(r"\b[A-Za-z0-9]+\b"))
    _, took = timed(lambda: scan(L.URL, detect._FIRST.get("url")))
    assert took < 4 * base + 1, (took, base)


def test_sentences_are_dealt_over_all_cores(spark):
    orders = spark.range(100).coalesce(1).select(F.col("id").alias("o_orderkey"))
    docs = C.sentences(orders, [Piece("'번호 '"), Piece(C.phone("'-'"), "번호")])
    assert docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert docs.count() == 100


@pytest.mark.parametrize("as_folder", [True, False])
def test_streams_read_a_table_that_is_a_folder(spark, tmp_path, as_folder):
    docs = spark.createDataFrame([(1, "메일 user1@example.com"), (2, "plain")], "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/in")
    made = next((tmp_path / "in").glob("*.parquet"))
    (tmp_path / "t").mkdir()
    target = tmp_path / "t" / "documents.parquet"
    if as_folder:
        target.mkdir()
        target = target / "part-0.parquet"
    target.write_bytes(made.read_bytes())
    got = stream_queries.stm1_vault(spark, str(tmp_path / "t")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, "메일 user1@example.com"), (2, "plain")]


def test_lines_of_a_split_are_counted_in_blocks(spark, monkeypatch):
    """Several files, splits and blocks; sentences over their bounds, and numbers that skip where blank lines follow each other."""
    monkeypatch.setattr(tokens, "LINES_PER_BLOCK", 4)
    widths, run = [], tokens.running
    monkeypatch.setattr(tokens, "running", lambda *a, **kw: widths.append((list(a[1]), kw["width"])) or run(*a, **kw))
    rng, rows, want = random.Random(8), [], {}
    for path in "ab":
        gap, nth = 0, 0
        for at in (0, 100, 250):
            for _ in range(rng.randint(0, 30)):
                line = rng.choice(["", f"w{nth}\tB-X", f"v{nth}", f"u{nth}\tO\tmore"])
                rows.append((path, at, nth, line))
                nth += 1
                if line:
                    cut = line.split("\t")
                    want.setdefault((path, gap), []).append((cut[0], cut[1] if len(cut) > 1 else "O"))
                else:
                    gap += 1
    rng.shuffle(rows)
    got = tokens.sentences_from_lines(spark.createDataFrame(rows, "path string, at long, nth long, line string")).collect()
    assert {(r["path"], r["sent"]): list(zip(r["tokens"], r["tags"])) for r in got} == want
    # the path is no key of what counts the lines
    assert (["_split"], 4) in widths


def test_redaction_looks_for_what_a_text_can_hold(spark):
    rng = random.Random(9)
    parts = ["김민수", "010-1234-5678", "이", "a@b.co", "http://x", "www.q.kr", "801010-1234567", "1234 5678 9012 3456", " ", "word", "가", "X", "12", "३४५६", "@"]
    rows = [(None,), ("",)] + [("".join(rng.choice(parts) for _ in range(rng.randint(1, 7))),) for _ in range(400)]
    df = spark.createDataFrame(rows, "text string")

    def in_turn(t):
        for _, pattern in L.REDACTION_BANK:
            t = text_functions._redact_one(t, pattern, F.lit("\ue000"))
        return t

    assert df.where(~in_turn(F.col("text")).eqNullSafe(text_functions.redact(F.col("text")))).isEmpty()
    # a plain text is passed on after the looks alone
    plain = spark.createDataFrame([("plain words without anything to hide, " * 20_000,)], "text string").select(F.explode(F.array_repeat("text", 8)).alias("text"))
    spent = lambda done: plain.select(F.md5(done(F.col("text")))).collect()
    spent(text_functions.redact), spent(in_turn)
    assert timed(lambda: spent(text_functions.redact))[1] < 0.6 * timed(lambda: spent(in_turn))[1]


def test_keys_of_masked_sentences_are_dealt(spark, folder):
    assert docs_with_spans(spark, folder).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_windows_of_a_text_take_linear_time(spark, tmp_path):
    def windows(texts, size, step):
        spark.createDataFrame(texts, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return transcript_queries.overlapped(spark, str(tmp_path), size, step)

    texts = [(1, "가b😀\n" * 77), (2, "x"), (3, ""), (4, None), (5, "".join(random.Random(1).choice("ab 가😀") for _ in range(900)))]
    for size, step in ((30, 24), (50, 20), (20, 20)):
        want = []
        for key, text in texts:
            for i in range(-(-len(text or "") // step)):
                at = (i - 1 if i % 7 == 5 else i) * step
                want.append((key, i, "  " if i % 11 == 9 else text[at:at + size], i % 13 != 6))
        assert sorted(map(tuple, windows(texts, size, step).collect())) == sorted(want)
    spent = lambda n: timed(lambda df=windows([(1, "ab cd가 " * n)], 300, 240): df.agg(F.sum(F.length("text"))).collect())[1]
    spent(20_000)
    assert spent(600_000) < 8 * spent(150_000) + 1


def test_next_texts_take_one_exchange(spark, monkeypatch):
    monkeypatch.setattr(transcripts, "ROWS_PER_BLOCK", 4)
    rows = [(key, pos, f"{key}{pos}") for key, n in (("a", 13), ("b", 4), ("c", 1), ("d", 5)) for pos in range(n)]
    df = transcripts._with_next(spark.createDataFrame(rows[::-1], "rec_id string, pos long, text string"))
    have = {(key, pos) for key, pos, _ in rows}
    assert sorted(map(tuple, df.collect()), key=str) == sorted(((k, p, t, f"{k}{p + 1}" if (k, p + 1) in have else None) for k, p, t in rows), key=str)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def fuzzy_rule(prev, cur):
    p, c = prev.split(), cur.split()
    for n in range(min(10, len(p) // 2), 2, -1) if len(p) >= 3 and len(c) >= 3 else ():
        for s in range(min(10, len(c) - n + 1)):
            if sum(a == b for a, b in zip(p[-n:], c[s:s + n])) / n >= 0.7:
                return " ".join(c[s + n:])
    return cur


def test_fuzzy_runs_are_looked_for_where_words_are_shared(spark):
    rng, rows = random.Random(11), []
    for _ in range(1500):
        words = rng.choice([["a", "b"], ["a", "b", "c", "가", "나"], [f"w{i}" for i in range(14)]])
        prev, cur = ([rng.choice(words) for _ in range(rng.randint(1, 25))] for _ in "ab")
        again = [w if rng.random() < 0.8 else "z" for w in prev[-rng.randint(1, 11):]]
        rows.append((" ".join(prev), " ".join(rng.choice([cur, [*cur[:rng.randint(0, 9)], *again, *cur]]))))
    df = spark.createDataFrame(rows, "prev string, cur string")
    cut = lambda d: d.select("prev", "cur", transcripts._cut_fuzzy(F.col("prev"), F.col("cur")).alias("got"))
    assert [r["got"] for r in cut(df).collect()] == [fuzzy_rule(*r) for r in rows]
    # two shared words are no run
    line = [f"w{i}" for i in range(40)]
    pair = [(" ".join(line), " ".join(["w39", "w35", *(f"v{i}" for i in range(40))]))]
    many = spark.createDataFrame(pair, "prev string, cur string").select("*", F.explode(F.array_repeat(F.lit(0), 30_000))).drop("col").cache()
    many.count()
    base = lambda: many.select(F.sum(F.size(text_functions.words(F.col("prev"))) + F.size(text_functions.words(F.col("cur"))))).collect()
    full = lambda: cut(many).select(F.sum(F.length("got"))).collect()
    base(), full()
    took, least = timed(full)[1], timed(base)[1]
    assert took < 3 * least + 0.2, (took, least)


def prefix_rule(prev, cur):
    for n in range(min(50, len(prev) // 2), 5, -1):
        if cur.startswith(prev[-n:]):
            return cur[n:].strip()
    p, c = prev.split(), cur.split()
    for j in range(1, min(len(p), len(c), 5) + 1):
        if p[-j:] == c[:j]:
            return " ".join(c[j:])
    return cur


def test_prefixes_are_tried_where_they_can_start(spark, monkeypatch):
    rng, rows = random.Random(12), []
    for _ in range(1500):
        letters = rng.choice(["a", "ab", "ab 가", "abcdefgh 😀"])
        prev, cur = ("".join(rng.choice(letters) for _ in range(rng.randint(1, 130))).strip() or "a" for _ in "ab")
        rows.append((prev, (prev[-rng.randint(1, 60):].strip() + cur) if rng.random() < 0.5 else cur))
    df = spark.createDataFrame(rows, "prev string, cur string")
    got = df.select(transcripts.cut_prefix(F.col("prev"), F.col("cur"))).collect()
    assert [r[0] for r in got] == [prefix_rule(*r) for r in rows]
    # rows and lines are written, so that no pass makes them again
    kept, written = [], transcripts.written
    monkeypatch.setattr(transcripts, "written", lambda d: kept.append(d.columns) or written(d))
    chunks = spark.createDataFrame([("r", 0, True, "first words come here"), ("r", 1, False, None), ("r", 2, True, "come here at last")],
                                   "rec_id string, chunk_index long, success boolean, text string")
    assert transcripts.merged_transcript(chunks).first()["text"] == "first words come here [...]. at last"
    assert sum("row" in c for c in kept) >= 2 and sum("piece" in c for c in kept) >= 2


def test_the_tail_is_searched_only_between_its_first_and_last_place(spark):
    rows = [("xx", "x"), ("axxa", "xx"), ("xxxxx", "xx"), ("가xx나xx", "xx"), ("😀ab", "😀ab")]
    got = spark.createDataFrame(rows, "t string, p string").select(transcripts._between(F.col("t"), F.col("p"))).collect()
    assert [r[0] for r in got] == [[1, 2], [2], [1, 2, 3, 4], [2, 3, 4, 5], [1]]


def spans_rule(tags):
    kind = lambda t: t[2:] if t and t[:2] in ("B-", "I-") else ""
    out = []
    for i, t in enumerate(tags):
        if not kind(t):
            continue
        if t.startswith("B-") or i == 0 or kind(tags[i - 1]) != kind(t):
            out.append([i, i + 1, kind(t)])
        else:
            out[-1][1] = i + 1
    return [tuple(x) for x in out]


def test_spans_of_a_batch_are_found_at_once(spark):
    rng = random.Random(13)
    tag = lambda: rng.choice(["B-가", "I-가", "B-x", "I-x", "O", "O", "", None, "B-", "I-", "x", "BI-x"])
    rows = [(1, None), (2, [])] + [(i, [tag() for _ in range(rng.choice([0, 1, 2, 9, 30]))]) for i in range(3, 400)]
    df = spark.createDataFrame(rows, "k long, tags array<string>").repartition(3)
    got = {r["k"]: r["s"] and [tuple(x) for x in r["s"]] for r in df.select("k", tokens_operator.bio_spans(F.col("tags")).alias("s")).collect()}
    assert got == {k: None if tags is None else spans_rule(tags) for k, tags in rows}
    # rows of unequal length, and tokens without a gold tag
    other = {k: None if tags is None or k % 50 == 0 else [rng.choice([t, tag()]) for t in tags][:len(tags) - (k % 7 == 0)] for k, tags in rows}
    both = spark.createDataFrame([(tags, other[k]) for k, tags in rows], "gold array<string>, predicted array<string>")
    pairs = [[(g, p) for g, p in zip(tags, [*other[k], None]) if g is not None] for k, tags in rows if tags is not None and other[k] is not None]
    g, p = ([set(spans_rule([x[n] for x in row])) for row in pairs] for n in (0, 1))
    hit, gold, pred = sum(len(a & b) for a, b in zip(g, p)), sum(map(len, g)), sum(map(len, p))
    score = tokens_operator.span_scores(both).first()
    assert score["precision"] == pytest.approx(hit / pred) and score["recall"] == pytest.approx(hit / gold)
    assert score["accuracy"] == pytest.approx(sum(a == b for row in pairs for a, b in row) / sum(map(len, pairs)))
    many = spark.createDataFrame([(["B-가", "I-가", "O", "B-x"] * 1_000,)], "tags array<string>").select("tags", F.explode(F.array_repeat(F.lit(0), 800))).drop("col").cache()
    many.count()
    base = lambda: many.select(F.sum(F.size(F.filter("tags", lambda t: t.startswith("B-"))))).collect()
    full = lambda: many.select(F.sum(F.size(tokens_operator.bio_spans(F.col("tags"))))).collect()
    base(), full()
    took, least = timed(full)[1], timed(base)[1]
    assert took < 3 * least + 0.2, (took, least)


def test_label_ids_are_looked_up_once_per_word(spark):
    rng = random.Random(14)
    ids = {"O": 0, "B-가": 1, "I-가": 2, "B-x": 3}
    rows = [(None, ["O"]), ([], [])]
    for _ in range(200):
        tags = [rng.choice([*ids, "I-x", " B-가 ", "", None, "B-B-x"]) for _ in range(rng.randint(0, 8))]
        rows.append(([rng.choice([None, *range(len(tags) + 2)]) for _ in range(rng.randint(0, 12))], tags))

    def rule(words, tags):
        out = []
        for i, w in enumerate(words):
            tag = ((tags[w] if w is not None and w < len(tags) else None) or "O").strip(" ")
            if i and w == words[i - 1] and tag.startswith("B-"):
                tag = tag.replace("B-", "I-")
            out.append(-100 if w is None else ids.get(tag, 0))
        return out

    table = tokens_operator.label_ids(F.array(*[F.lit(x) for x in ids]))
    aligned = lambda df: df.select(tokens_operator.align_labels(F.col("words"), F.col("tags"), table).alias("y"))
    df = spark.createDataFrame(rows, "words array<int>, tags array<string>")
    assert [r["y"] for r in aligned(df).collect()] == [None if words is None else rule(words, tags) for words, tags in rows]
    # pieces cost no lookup of their own
    many = spark.createDataFrame([([i // 20 for i in range(20_000)], ["B-가", "O"] * 500)], "words array<int>, tags array<string>").select(
        "words", "tags", F.explode(F.array_repeat(F.lit(0), 120))).drop("col").cache()
    many.count()
    base = lambda: many.select(F.sum(F.size(F.filter("words", lambda w: w % 7 == 3)))).collect()
    full = lambda: aligned(many).select(F.sum(F.size(F.col("y")))).collect()
    base(), full()
    took, least = timed(full)[1], timed(base)[1]
    assert took < 5 * least + 0.2, (took, least)


def test_stable_texts_are_told_in_one_run(spark):
    rng = random.Random(15)
    rows = [(None,), ("",), ("가" * 300_000,), ("가" * 300_000 + "①",)]
    rows += [("".join(rng.choice("ab가é—\n①ﬁ\u0301가😀🅐Å") for _ in range(rng.randint(1, 6))),) for _ in range(300)]
    rows += [("".join(rng.choice("ab 가é—\n一") for _ in range(9)),) for _ in range(100)]
    got = spark.createDataFrame(rows, "text string").select(text_functions.nfkc(F.col("text"))).collect()
    assert [r[0] for r in got] == [t and unicodedata.normalize("NFKC", t) for t, in rows]
    many = spark.createDataFrame([("plain words and 한글 in a line, " * 20_000,)], "text string").select(F.explode(F.array_repeat("text", 40)).alias("text")).cache()
    many.count()
    base = lambda: many.select(F.sum(F.length(F.regexp_replace("text", "[a-z ]+", "")))).collect()
    full = lambda: many.select(F.sum(F.length(text_functions.nfkc(F.col("text"))))).collect()
    base(), full()
    took, least = timed(full)[1], timed(base)[1]
    assert took < 2 * least + 0.15, (took, least)
