"""Operators against plain-Python statements of their rules, on random and hand-made inputs."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from veilspan import lexicon as L
from veilspan.functions import finditer, text as T
from veilspan.functions.arrays import make_span
from veilspan.operators import corrections, detect, masking, overlap, segments, transcripts
from veilspan.plans import chain, ordered

ALPHABET = (list("0123456789") * 3 + list("-. :()[]@/,") * 2 + list("가나다라시도구동로길김이박씨님은행 abMSms.co")
            + ["010", "-1234", "801010-1234567", "hong@a.com", "https://x.y", "서울시", "우리은행", "😀", "１", "é", "\x1c", "M12345678", "20:30", "2025-08-15", "ſ"])


@pytest.fixture(scope="module")
def noisy(spark):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 50)))) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "id long, text string").repartition(8).cache()


# the host rule as stated, which only a backtracking engine without Java's recursion can run on any text
STATED_URL = (r"(?:(?:https?://|www\.)[^\s<>\"']+|\b(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}(?:/[^\s<>\"']*)?)")


def test_long_hosts_do_not_exhaust_the_stack(spark):
    texts = ["a." * 200_000 + "com", "abcdefgh." * 110_000, "1bcdefgh." * 3_000, "a-" * 20_000 + ".com", "x" + "a." * 100_000 + ".b.org", "(" + "-." * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(6)
    rows = {r.id: r.n for r in df.select("id", F.transform(finditer.find_all(F.col("text"), L.URL), lambda m: m["end"] - m["start"]).alias("n")).collect()}
    assert rows[0] == [400_003] and rows[1] == [110_000 * 9 - 1] and rows[2] == [] and rows[3] == [40_004] and rows[4] == [5] and rows[5] == []


def test_hosts_equal_finditer(spark):
    rnd = random.Random(8)
    words = ["a", "b1", "1", "co", "com", "x-", "-y", "é", "_", "가"]
    texts = ["".join(rnd.choice(words + [".", ".", ".", "-", "..", "/", " ", "http://", "www."]) for _ in range(rnd.randint(1, 16))) for _ in range(20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(8)
    for r in df.select("id", finditer.find_all(F.col("text"), L.URL).alias("m")).collect():
        assert [m.text for m in r.m] == [m.group() for m in re.finditer(STATED_URL, texts[r.id])], texts[r.id]


def test_redaction_keeps_private_use_characters(spark):
    texts = ["a\ue000b", "\ue000\ue001 010-1234-5678\ue000 hong@a.com", "\ue000" * 3 + "12345" + "\ue001", "".join(map(chr, range(0xE000, 0xE008))) + "9999", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.t for r in df.select("id", T.redact(F.col("text")).alias("t")).collect()}
    assert got[0] == "a\ue000b" and got[1] == "\ue000\ue001 XXX-XXXX-XXXX\ue000 XXXX@X.XXX"
    assert got[2] == "\ue000" * 3 + "XXXXX" + "\ue001" and got[3] == texts[3][:-4] + "XXXX" and got[4] is None and got[5] == ""


def test_matches_and_offsets_equal_finditer(noisy):
    rows, df = noisy
    bank = [(f"a_{n}", p, False, detect._FIRST.get(n)) for n, p, _, _ in L.PATTERN_BANK]
    bank += [(f"b_{n}", p, True, detect._FIRST.get(n)) for n, p, _, _ in L.SUPPLEMENTARY_BANK]
    bank += [("name", L.NAME, False, None), ("short", L.SHORT_NAME, False, None)]
    cols = [F.transform(finditer.find_all(F.col("text"), p, None, ic, first), lambda m: F.concat_ws(":", m["start"], m["end"], m["text"])).alias(n)
            for n, p, ic, first in bank]
    for row in df.select("id", "text", *cols).collect():
        for n, p, ic, _ in bank:
            stated = STATED_URL if p == L.URL else p
            want = [f"{m.start()}:{m.end()}:{m.group()}" for m in re.finditer(stated, row.text, re.I if ic else 0)]
            assert row[n] == want, (n, row.text)


def test_gates_are_necessary_conditions(noisy):
    _, df = noisy
    for entry in L.PATTERN_BANK:
        gated = detect.pattern_spans(F.col("text"), *entry, guarded=False)
        free = finditer.find_all(F.col("text"), entry[1])
        assert df.where(F.size(gated) != F.size(free)).count() == 0, entry[0]


def test_fence_characters_in_the_text_do_no_harm(spark):
    df = spark.createDataFrame([("a\ue000 12345\ue001b 54321",)], "text string")
    got = df.select(finditer.find_all(F.col("text"), r"\d{5}").alias("m")).first().m
    assert [(m.start, m.end, m.text) for m in got] == [(3, 8, "12345"), (11, 16, "54321")]


def test_nfkc_gate_only_skips_stable_text():
    stable = re.compile("[" + T._STABLE + "]")
    for cp in list(range(0x20, 0x3000)) + list(range(0xAC00, 0xAD00)) + list(range(0xF900, 0xFFEF)):
        c = chr(cp)
        if stable.match(c):
            assert unicodedata.normalize("NFKC", c) == c
            assert unicodedata.combining(c) == 0


SAMPLE = ("홍길동(32세)입니다. 연락처 010-1234-5678, 이메일 hong@example.com, 주소 서울시 마포구 상암동 123-45. "
          "계좌 1002-345-678901(우리은행). 2025-08-18에 만남. 번호 01012345678.")


def spans_of(spark, text, fn):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(s.text, s.label_adjusted or s.label, s.subtype) for s in fn(df).first().spans]


def test_pattern_order_decides_labels(spark):
    got = spans_of(spark, SAMPLE, detect.detect_default)
    # a separated phone number is also an account, which comes first; without separators it stays a phone
    assert ("010-1234-5678", "금융", "계좌번호") in got
    assert ("01012345678", "번호", "전화번호") in got
    assert ("hong@example.com", "계정", "이메일") in got
    assert not any(t.startswith("2025") and sub == "날짜" for t, _, sub in got)  # a particle follows


def test_email_before_a_full_stop_is_not_found(spark):
    assert spans_of(spark, "메일 a@b.com. 끝", detect.bank_spans) == [("b.com", "URL", "URL")]


def random_spans(rnd):
    out = []
    for i in range(rnd.randint(0, 12)):
        s = rnd.randint(0, 20)
        out.append((s, s + rnd.randint(1, 8), str(i), rnd.choice(L.LABELS), rnd.choice([None, "계좌번호", "이메일"]), rnd.randint(0, 100) / 100, rnd.choice(["ner", "regex"])))
    return out


def touches(a, b):
    return a[1] > b[0] and a[0] < b[1]


def spec_merge(spans):
    def prio(s):
        table = L.MERGE_PRIORITY
        return table.get((s[3], s[4]), table.get((s[3], None), L.DEFAULT_PRIORITY))

    kept = []
    for c in sorted(spans, key=lambda s: (s[0], -prio(s), -(s[1] - s[0]))):
        beaten, ok = [], True
        for k in kept:
            if touches(c, k):
                inter = min(c[1], k[1]) - max(c[0], k[0])
                near = c[3] == k[3] and inter / (c[1] - c[0] + k[1] - k[0] - inter) >= 0.7
                better = c[5] > k[5] if near else prio(c) > prio(k)
                ok &= better
                beaten.append(k)
        if ok:
            kept = [k for k in kept if k not in beaten] + [c]
    return sorted(kept, key=lambda s: s[0])


def spec_source_first(spans):
    kept = []
    for c in sorted(spans, key=lambda s: (s[0], s[6] != "ner", -(s[1] - s[0]))):
        first = next((k for k in kept if touches(c, k)), None)
        if first is None:
            kept.append(c)
        elif c[6] == "ner" and first[6] != "ner":
            kept.remove(first)
            kept.append(c)
    return sorted(kept, key=lambda s: s[0])


@pytest.mark.parametrize("fold, spec", [(overlap.merge_by_priority, spec_merge), (overlap.merge_source_first, spec_source_first)])
def test_overlap_folds(spark, fold, spec):
    rnd = random.Random(5)
    rows = [(i, random_spans(rnd)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, raw array<struct<s:int,e:int,t:string,l:string,sub:string,sc:double,src:string>>")
    spans = F.transform("raw", lambda r: make_span(start=r["s"], end=r["e"], text=r["t"], label=r["l"], subtype=r["sub"], score=r["sc"], source=r["src"]))
    for row in df.withColumn("out", fold(spans)).collect():
        assert [s.text for s in row.out] == [s[2] for s in spec(rows[row.id][1])]


def test_mask_and_restore_round_trip(spark):
    df = detect.detect_all(spark.createDataFrame([(1, SAMPLE)], "doc_id long, text string"))
    row = masking.mask(df).first()
    assert row.mask_stats.total == len(row.records) and "hong@example.com" not in row.masked_text
    text = row.masked_text
    for r in reversed(row.records):  # undo in reverse order of application
        text = text[:r.start] + r.original_text + text[r.start + len(r.masked_text):]
    assert text == row.text


def test_masking_example_with_given_entities(spark):
    text = "김철수님의 번호는 010-1234-5678이고 주소는 서울시 강남구입니다."
    where = [("이름", "김철수"), ("번호", "010-1234-5678"), ("주소", "서울시 강남구")]
    spans = F.array(*[make_span(start=F.lit(text.index(t)), end=F.lit(text.index(t) + len(t)), text=F.lit(t), label_adjusted=F.lit(lab)) for lab, t in where])
    df = spark.createDataFrame([(text,)], "text string").withColumn("spans", spans)
    assert masking.mask(df).first().masked_text == "[이름]님의 번호는 [전화번호]이고 주소는 [주소]입니다."


def test_nested_keywords_are_masked_as_given_or_resolved(spark):
    df = detect.detect_default(spark.createDataFrame([("성폭력 기록",)], "text string"))
    as_given, resolved = masking.mask(df).first(), masking.mask(df, resolve=True).first()
    assert len(as_given.records) == 3 and resolved.masked_text == "[개인정보] [개인정보]"


def test_chain_over_several_levels(spark):
    rnd = random.Random(7)
    jumps, want = [], set()
    for key in range(4):
        n = rnd.randint(1, 400)
        nxt = [p + rnd.randint(1, 9) for p in range(n)]
        jumps += [(key, p, nxt[p]) for p in range(n)]
        p = 0
        while p < n:
            want.add((key, p))
            p = nxt[p]
    df = spark.createDataFrame(jumps, "rec_id long, pos long, nxt long")
    assert {tuple(r) for r in chain.landed(df, ["rec_id"], width=4).collect()} == want


def test_running_aggregates_cross_blocks(spark):
    rows = [(k, i, (i * 37 + k) % 11) for k in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    out = ordered.running(df, ["k"], ["i"], {"s": ("sum", "v"), "m": ("max", "v")}, width=7)
    for r in out.collect():
        seen = [v for k, i, v in rows if k == r.k and i <= r.i]
        assert (r.s, r.m) == (sum(seen), max(seen))


def test_a_recording_of_any_length_is_one_text(spark):
    df = spark.createDataFrame([(1, f"문장{i}.", float(i)) for i in range(12_000)], "rec_id long, text string, start_time double")
    rows = transcripts.plain_text(df.repartition(5)).collect()
    assert [r.text for r in rows] == [" ".join(f"문장{i}." for i in range(12_000))]


def test_stamps_and_subtitles(spark):
    df = spark.createDataFrame([(1, "가", 0.0, 1.5), (1, "나", 3725.25, None)], "rec_id long, text string, start_time double, end_time double")
    assert transcripts.stamped_text(df).first().text == "[00:00] 가\n\n[62:05] 나\n"
    assert transcripts.subtitles(df).first().text == (
        "1\n00:00:00,000 --> 00:00:01,500\n가\n\n2\n01:02:05,250 --> 01:02:08,250\n나\n")


def test_swallowed_chunks_keep_the_older_comparison_text(spark):
    a = "오늘은 날씨가 아주 좋아서 밖에 나가서 한참을 걸었습니다 그리고"
    rows = [(1, 0, a), (1, 1, a), (1, 2, a), (1, 3, a[-20:] + " 집에 와서 책을 읽었습니다 정말로")]
    df = spark.createDataFrame(rows, "rec_id long, chunk_index long, text string")
    got = {r.chunk_index: (r.text, r.removed) for r in transcripts.stitched(df).collect()}
    assert got[1] == ("", True) and got[2] == ("", True) and got[3][0].startswith("집에 와서")


def test_merge_short_on_one_recording(spark):
    rows = [(1, 0, 1000), (1, 1500, 2500), (1, 5000, 6000), (1, 6200, 30000)]
    df = spark.createDataFrame(rows, "rec_id long, start_ms long, end_ms long")
    got = [(r.start_ms, r.end_ms, r.is_merged) for r in segments.merge_short(df).orderBy("start_ms").collect()]
    assert got == [(0, 2500, True), (5000, 6000, False), (6200, 21200, False), (21200, 30000, False)]


def test_rules_and_summary(spark):
    df = spark.createDataFrame([("밥을를 먹고  물은는 . 나는",)], "text string")
    row = corrections.apply_rules(df).select("rule_text", corrections.correction_summary(F.col("rule_log")).alias("s")).first()
    assert row.rule_text == "밥를 먹고 물는. 나는" and row.s == "중복 조사 2개"


def test_terminated_sentences_drop_the_tail(spark):
    df = spark.createDataFrame([("하나. 둘! 꼬리",), ("끝이 없다",)], "text string")
    got = [r[0] for r in df.select(T.terminated_sentences(F.col("text"))).collect()]
    assert got == [["하나.", "둘!"], ["끝이 없다"]]


def test_exact_quantile_on_crowded_values(spark):
    rnd = random.Random(21)
    rows = [(k, v) for k, values in {
        "spread": [rnd.random() for _ in range(5000)], "crowded": [1e9, -1e9] + [rnd.random() * 1e-6 for _ in range(6000)],
        "tied": [3.0] * 4000 + [7.0], "one": [5.0], "few": [1.0, 2.0, 4.0]}.items() for v in values] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for p in (0.0, 0.2, 0.5, 0.999, 1.0):
        got = {r.k: r.quantile for r in ordered.exact_quantile(df, ["k"], "v", p, per_bucket=16).collect()}
        for k in ("spread", "crowded", "tied", "one", "few"):
            vs = sorted(v for n, v in rows if n == k and v is not None)
            spot = (len(vs) - 1) * p
            lo = int(spot)
            want = vs[lo] + (vs[min(lo + 1, len(vs) - 1)] - vs[lo]) * (spot - lo)
            assert got[k] == pytest.approx(want, rel=1e-9, abs=1e-12), (k, p)


def test_equal_chunks_take_the_same_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(transcripts, "cut_lineage", lambda df, keep=transcripts.cut_lineage: (cuts.append(1), keep(df))[1])
    rounds = []
    for n in (2, 600):
        cuts.clear()
        rows = [(0, i, "aaaa bbbb cccc dddd eeee ffff") for i in range(n)] + [(0, n, "other words come here at last")]
        out = transcripts.stitched(spark.createDataFrame(rows, "rec_id long, chunk_index long, text string"), transcripts.cut_prefix)
        assert out.where("NOT removed").count() >= 2
        rounds.append(len(cuts))
    assert rounds[0] == rounds[1]
