"""The detectors of a text in one pass give what the column expressions give."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from veilspan import lexicon as L
from veilspan.functions import text as text_functions
from veilspan.functions.text import normalize_text
from veilspan.operators import detect, overlap

PARTS = [
    "김민수씨", "남궁-하", "이 ", "서준", "담당", "엄마", "010-1234-5678", "01012345678", "02 123 4567", "a@b.co", "user.x@mail.kr", "@", "http://x.y/z", "www.a.kr",
    "www.foo@bar.com", "801010-1234567", "000017-0000175", "0000170000175", "4000 0001 7000 0170", "국민은행 : ", "계좌", "(", ")", "[", "]", ":", " ", "  ", "\t", "\n",
    "-", ".", "/", "1", "12", "123", "12345", "123456", "200-00-00177", "2000000177", "M12345678", "ſ12345678", "1.2.3.4", "256.1.1.1", "2024-01-02", "23:59", "9.30",
    "서울특별시 마포구 상암동 12-3, 101호 (04524)", "경기도", "역삼동", "a.b.c", "x-y.co.kr", "a.1.b.com", "-x.kr", "a_b.kr", "가나다", "시", "우울", "과수면", "ADHD", "전화",
    "은행", "여권", "IP", "서버", "우편번호", "３４５６", "३४५६७", "①", "ﬁ", "​", "　", "\xa0", "", "😀", "漢", "_", "·", "。", "＠", "é", "<", "a-" * 40]


def bank(df, lists):
    body = F.col("text")
    hits = detect._bank(body, L.PATTERN_BANK, {}, lambda name: detect._guard(name, body, *lists))
    return df.withColumn("spans", overlap.prune_contained(hits))


def default(df, lists=((), ())):
    body = F.col("text")
    return bank(df, lists).withColumn("spans", F.concat(detect.refine_numbers(body, F.col("spans")), detect.domain_spans(body)))


def everything(df, use_nfkc):
    body = F.col("text")
    found = default(df.withColumn("text", normalize_text(body, use_nfkc)))
    return found.withColumn("spans", overlap.merge_by_priority(F.concat(detect.as_evidence(body, F.col("spans")), detect.name_spans(body))))


CASES = {
    "bank": (lambda df: bank(df, ((), ())), detect.bank_spans),
    "lists": (lambda df: bank(df, (["kr", "co"], ["mail.kr"])), lambda df: detect.bank_spans(df, allow=["kr", "co"], deny=["mail.kr"])),
    "default": (default, detect.detect_default),
    "all": (lambda df: everything(df, True), detect.detect_all),
    "as given": (lambda df: everything(df, False), lambda df: detect.detect_all(df, use_nfkc=False)),
}


@pytest.mark.parametrize("case", CASES)
def test_one_pass_gives_what_the_expressions_give(spark, case):
    rng = random.Random(case)
    texts = [None, "", " ", *["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 12))) for _ in range(400)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    want, got = (CASES[case][i](df).select("id", "text", "spans").collect() for i in (0, 1))
    assert sorted(got) == sorted(want) and sum(len(r["spans"]) for r in got) > 300


@pytest.mark.parametrize("run", [detect.bank_spans, detect.detect_default, detect.detect_all])
def test_a_text_passes_through_no_folds(spark, run):
    """One evaluation a text, whatever asks for its spans, and no fold of an array."""
    df = run(spark.createDataFrame([(1, "메일 a@b.co")], "id long, text string"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.where(F.size("spans") > 0).select("id", F.explode_outer("spans")).explain()
    assert out.getvalue().count("ArrowEvalPython") == 1 and "aggregate(" not in out.getvalue()
    assert df.where(F.size("spans") > 0).count() == 1


def test_empty_batches_and_long_texts(spark):
    line = "번호 1188-372-124402, 801010-1234567 우리시 김민수 a-b.co.kr/x 2024.01.02 x@y.kr 과수면, "
    df = spark.createDataFrame([(line * 3_000,)], "text string")
    assert detect.detect_all(df.where("text = ''")).count() == 0
    one, many = (detect.detect_all(x).select(F.size("spans")).first()[0] for x in (df.select(F.substring("text", 1, len(line) - 1).alias("text")), df))
    assert one > 4 and many == 3_000 * one


def test_redaction_is_one_evaluation_a_text(spark):
    """No pattern is a fold of its own, and a text may hold every private-use character."""
    fences = "".join([chr(0xE000 + i) for i in range(8)] + [chr(0xF0000 + i) for i in range(24)])
    texts = [(None,), ("",), (fences + "김민수 1234_5 a_b@c.kr",), ("01012345678 801010-1234567, http://가.나/다_1?x=é",), ("plain_1 ①②③④⑤",)]
    df = spark.createDataFrame(texts, "text string").select("text", text_functions.redact(F.col("text")).alias("shown"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    assert out.getvalue().count("ArrowEvalPython") == 1 and "regexp_replace(" not in out.getvalue()
    assert {r["text"]: r["shown"] for r in df.collect()} == {
        None: None, "": "", fences + "김민수 1234_5 a_b@c.kr": fences + "XXX XXXX_5 X_X@X.XX",
        "01012345678 801010-1234567, http://가.나/다_1?x=é": "XXXXXXXXXXX XXXXXX-XXXXXXX, XXXX://X.X/X_X?X=X", "plain_1 ①②③④⑤": "plain_1 ①②③④⑤"}
