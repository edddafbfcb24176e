"""Pattern bank, validators, names, keywords and label lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import checks
from ..functions.arrays import each, lookup, make_span
from ..operators import detect as D, external as X
from . import corpus as C
from . import sqltext as S
from .corpus import Piece
from .registry import Tables, query

_BANK = {name: (name, pattern, label, subtype) for name, pattern, label, subtype in L.PATTERN_BANK}


def flat(df, spans: str, *keep: str, extra: tuple[str, ...] = ()):
    """Span rows with the column names the SQL side uses."""
    return each(df, spans, *keep).select(*keep, F.col("s.start").cast("long").alias("span_start"), F.col("s.end").cast("long").alias("span_end"),
                       F.col("s.text").alias("span_text"), "s.label", "s.subtype", *[F.col(f"s.{c}").alias(c) for c in extra])


def _pattern_query(name: str, pieces: list[Piece], query_name: str):
    """One bank pattern with its validator over a sentence per order."""

    @query(query_name, C.expected_sql(pieces))
    def run(spark, folder):
        docs = C.sentences(Tables(spark, folder).orders, pieces)
        return flat(docs.withColumn("spans", D.pattern_spans(F.col("text"), *_BANK[name])), "spans", "doc_id")

    return run


def _bank(name: str) -> tuple[str, str]:
    return _BANK[name][2], _BANK[name][3]


_SEP3 = C.pick("k", "-", " ", "")
_WRONG = "(CASE WHEN k % 4 = 0 THEN 1 + k % 9 ELSE 0 END)"
_BEFORE_DIGITS = C.pick("k", "고객 번호 ", "😀 번호:", "번호 7")  # a digit right before spoils it
_AFTER_DIGITS = C.pick("k", "이고 ", ".", " 입니다", ", ", "9")
_CLEAN = "k % 3 <> 2 AND k % 5 <> 4"

_pattern_query("resident", [Piece(_BEFORE_DIGITS), Piece(C.resident(_SEP3, _WRONG), *_bank("resident"), f"k % 4 <> 0 AND {_CLEAN}"), Piece(_AFTER_DIGITS)], "pat1_resident")
_pattern_query("passport", [Piece(C.pick("k", "여권 ", "(", "번호")), Piece(C.PASSPORT, *_bank("passport"), "k % 3 <> 2 AND k % 4 <> 0"), Piece(C.pick("k", "번", " 확인", ")", "."))], "pat2_passport")
_pattern_query("business", [Piece(_BEFORE_DIGITS), Piece(C.business(_SEP3, _WRONG), *_bank("business"), f"k % 4 <> 0 AND {_CLEAN}"), Piece(_AFTER_DIGITS)], "pat3_business")
_pattern_query("card", [Piece(C.pick("k", "카드 ", "카드:", "카드 7")), Piece(C.card(C.pick("k", "-", " ", "-", ""), C.pick("k", "0", "0", "3", "0", "0").replace("'", "")), *_bank("card"),
                                                                          "k % 3 <> 2 AND k % 4 <> 3 AND k % 5 <> 2"), Piece(C.pick("k", " 결제", "로"))], "pat4_card")
_pattern_query("account", [Piece(C.pick("k", "내 ", "우리", "", "송금 ")),
                           Piece(C.pick("k", "계좌 ", "은행 ", "입금: ", "") + " || (CASE WHEN k % 5 = 0 THEN substr(" + C.ACCOUNT + ", 1, 8) ELSE " + C.ACCOUNT + " END)", *_bank("account"), "k % 5 <> 0"),
                           Piece(C.pick("k", "(예금)", " 로", ""))], "pat5_account")
_pattern_query("phone", [Piece(C.pick("k", "연락처 ", "전화:", "번호 1")), Piece(C.phone(C.pick("k", "-", ".", " ", "")), *_bank("phone"), "k % 3 <> 2 AND k % 4 <> 3"), Piece(C.pick("k", "입니다", ".", "", "0"))], "pat6_phone")
_pattern_query("address", [Piece(C.pick("k", "주소: ", "(", "")), Piece(C.ADDRESS, *_bank("address")), Piece(C.pick("k", ". ", "!", ";"))], "pat11_address")
_pattern_query("date", [Piece(C.pick("k", "날짜 ", "", "(")), Piece(C.DATE, *_bank("date"), "k % 4 <> 0"), Piece(C.pick("k", "에", " 예약", ".", ""))], "pat12_date")


# patterns RE2 can state on the real documents: map other letters and digits to a word character first
_WORDED = "regexp_replace(regexp_replace({}, '[^\\P{{L}}A-Za-z]', '_', 'g'), '[^\\P{{N}}0-9]', '_', 'g')"


def _document_pattern(name: str, re2: str, query_name: str, where: str = "true", source: str = "documents", key: str = "doc_id", column: str = "text"):
    inner = S.matches("worded", re2, f"{key}, worded", f"(SELECT {key}, {_WORDED.format(column)} AS worded FROM {source})")
    label, subtype = _bank(name)
    sql = (f"SELECT {key}, span_start, span_end, substr(t.{column}, span_start + 1, span_end - span_start) AS span_text, '{label}' AS label, '{subtype}' AS subtype "
           f"FROM ({inner}) JOIN {source} t USING ({key}) WHERE {where}")

    @query(query_name, sql)
    def run(spark, folder):
        rows = getattr(Tables(spark, folder), source).select(key, F.col(column).alias("body"))
        return flat(rows.withColumn("spans", D.pattern_spans(F.col("body"), *_BANK[name])), "spans", key)


_EMAIL_TOKEN = "[A-Za-z0-9._%+-]*@[A-Za-z0-9._%+@-]*"  # runs of address characters around an @
_EMAIL_OK = "regexp_full_match(span_text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')"
_IP = "\\b(?:(?:25[0-5]|2[0-4]\\d|1?\\d{1,2})\\.){3}(?:25[0-5]|2[0-4]\\d|1?\\d{1,2})\\b"
_URL = "(?:(?:https?://|www\\.)[^\\s<>\"'']+|\\b(?:[A-Za-z0-9\\-]+\\.)+[A-Za-z]{2,}(?:/[^\\s<>\"'']*)?)"
_TIME = "\\b(?:[01]?\\d|2[0-3])[:.][0-5]\\d\\b"
_document_pattern("email", _EMAIL_TOKEN, "pat7_email", _EMAIL_OK)
_document_pattern("email", _EMAIL_TOKEN, "pat7_email_pages", _EMAIL_OK, "pages", "page_id", "html")
_document_pattern("ipv4", _IP, "pat8_ipv4")
_document_pattern("url", _URL, "pat9_url")
_document_pattern("url", _URL, "pat9_url_pages", "true", "pages", "page_id", "html")
_document_pattern("postcode", "(?:\\(|\\[)?\\d{5}(?:\\)|\\])?", "pat10_postcode")
_document_pattern("time", _TIME, "pat13_time")
_document_pattern("time", _TIME, "pat13_time_pages", "true", "pages", "page_id", "html")

# --- supplementary bank -------------------------------------------------------------------

_SUP = {name: (label, subtype) for name, _, label, subtype in L.SUPPLEMENTARY_BANK}
_S = C.pick("k", "-", " ")
_SUPPLEMENTARY = [
    Piece("'주민 '"), Piece(C.resident(_SEP3), *_SUP["resident"]), Piece("', '"), Piece("'국민' || " + C.pick("k", "", " ", "  ") + " || " + C.ACCOUNT, *_SUP["account"]),
    Piece("', 카드 '"), Piece(C.card(_S, "1"), *_SUP["card"]), Piece("', 면허 '"), Piece(C.LICENCE, *_SUP["licence"]), Piece("', 여권 '"),
    Piece(C.PASSPORT, *_SUP["passport"]), Piece("', 사업자 '"), Piece(C.business(_S, "1"), *_SUP["business"]), Piece("', 서버 '"),
    Piece("(CAST(k % 999 AS STRING) || '.0.' || CAST(k % 300 AS STRING) || '.1')", *_SUP["ip"]), Piece(C.pick("k", " 끝", "")),
]


@query("pat14_20_supplementary", C.expected_sql(_SUPPLEMENTARY))
def supplementary(spark, folder):
    docs = C.sentences(Tables(spark, folder).orders, _SUPPLEMENTARY)
    return flat(docs.withColumn("spans", D.supplementary_spans(F.col("text"))), "spans", "doc_id")


# --- names --------------------------------------------------------------------------------

_NAMES = [Piece(C.pick("k", "담당 ", "(", "")), Piece(C.NAME, "이름", L.NAME_SUBTYPE, "k % 4 <> 0"), Piece(C.pick("k", "께서", " 확인", ".", ""))]


@query("pat21_names", C.expected_sql(_NAMES))
def names(spark, folder):
    docs = C.sentences(Tables(spark, folder).orders, _NAMES)
    return flat(docs.withColumn("spans", D.name_spans(F.col("text"))), "spans", "doc_id")


_SHORT = [Piece(C.pick("k", "담당 ", "(", "")), Piece(C.pick("k", "김", "이", "박", "나") + " || " + C.pick("k", "민", "지영", "서준이"), "이름", None, "k % 5 <> 0"),
          Piece(C.pick("k", "께서는", " 확인", ".", "", ", "))]


@query("pat22_short_names", C.expected_sql(_SHORT))
def short_names(spark, folder):
    docs = C.sentences(Tables(spark, folder).orders, _SHORT)
    return flat(docs.withColumn("spans", D.short_name_spans(F.col("text"))), "spans", "doc_id")


_AFTER = " 김민수 www.a1.kr/ 010-2345-6789 801010-1234567 1234-5678-9012-3456 hong@a1.com 끝"
_AFTER_HITS = [("name", "김민수"), ("url", "www.a1.kr/"), ("phone", "010-2345-6789"), ("resident", "801010-1234567"), ("card", "1234-5678-9012-3456"), ("email", "hong@a1.com")]
_AFTER_DIGITS = ["2345", "6789", "801010", "1234567", "1234", "5678", "9012", "3456"]


def _after_hits() -> str:
    rows, at = [f"('{n}', {_AFTER.index(x)}, '{x}')" for n, x in _AFTER_HITS], 0
    for x in _AFTER_DIGITS:
        at = _AFTER.index(x, at)
        rows.append(f"('digits', {at}, '{x}')")
        at += len(x)
    return f"SELECT k, p, 3 + length(CAST(1000 + k * 7 AS STRING)) + o, x FROM t, (VALUES {', '.join(rows)}) v(p, o, x)"


@query("pat23_redaction_hits", f"""
    WITH t AS (SELECT o_orderkey AS k FROM orders)
    SELECT k AS doc_id, 'digits' AS pattern, CAST(3 AS BIGINT) AS span_start, CAST(1000 + k * 7 AS STRING) AS span_text FROM t UNION ALL {_after_hits()}""")
def redaction_hits(spark, folder):
    pieces = [Piece("'번호 '"), Piece("CAST(1000 + k * 7 AS STRING)"), Piece(f"'{_AFTER}'")]
    from ..functions.finditer import find_all
    docs = C.sentences(Tables(spark, folder).orders, pieces)
    hits = F.array(*[F.struct(F.lit(n).alias("n"), find_all(F.col("text"), p).alias("m")) for n, p in L.REDACTION_BANK])
    rows = docs.select("doc_id", F.explode(hits).alias("h")).select("doc_id", F.col("h.n").alias("pattern"), F.explode("h.m").alias("m"))
    return rows.select("doc_id", "pattern", F.col("m.start").cast("long").alias("span_start"), F.col("m.text").alias("span_text"))


# --- domain keywords ----------------------------------------------------------------------

_TERMS = [(w, lab) for lab, ws in L.DOMAIN_KEYWORDS for w in ws]
_WORDS = ["성폭력", "과수면", "ADHD", "상담기록", "가정폭력", "게임중독", "불안", "자살시도", "케이스노트"]
_DOMAIN = [Piece("'최근 '"), Piece(C.pick("k", *_WORDS)), Piece("' 및 '"), Piece(C.pick("(k + 4)", *_WORDS[::-1])), Piece("'과 우울우울.'")]
_VALUES = ", ".join(f"('{w}', '{lab}')" for w, lab in _TERMS)


@query("pat24_domain_keywords", f"""
    WITH t AS (SELECT k AS doc_id, {C.text_sql(_DOMAIN)} AS text FROM (SELECT o_orderkey AS k FROM orders)),
    hits AS (SELECT doc_id, word, label, string_split(text, word) AS g FROM t, (VALUES {_VALUES}) v(word, label) WHERE contains(text, word)),
    each AS (SELECT *, unnest(range(1, len(g))) AS i FROM hits)
    SELECT doc_id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(word) AS BIGINT) AS span_start,
           CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + i * length(word) AS BIGINT) AS span_end, word AS span_text, label, CAST(NULL AS VARCHAR) AS subtype FROM each""")
def domain(spark, folder):
    docs = C.sentences(Tables(spark, folder).orders, _DOMAIN)
    return flat(docs.withColumn("spans", D.domain_spans(F.col("text"))), "spans", "doc_id")


# --- validators ---------------------------------------------------------------------------

_LUHN_SQL = """(length(d) >= 12 AND (list_sum(list_transform(range(0, length(d)), lambda i: CASE WHEN i % 2 = length(d) % 2
    THEN CASE WHEN CAST(d[i + 1] AS INT) > 4 THEN CAST(d[i + 1] AS INT) * 2 - 9 ELSE CAST(d[i + 1] AS INT) * 2 END ELSE CAST(d[i + 1] AS INT) END)) % 10) = 0)"""


@query("val1_luhn", f"SELECT k, {_LUHN_SQL} AS ok FROM (SELECT l_orderkey * 100 + l_linenumber AS k, CAST(l_orderkey * 7919 + 1000000000000 + l_partkey AS STRING) || CAST(l_suppkey AS STRING) AS d FROM lineitem)")
def val1(spark, folder):
    rows = Tables(spark, folder).lineitem.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("k"), F.concat(
        (F.col("l_orderkey") * 7919 + 1000000000000 + F.col("l_partkey")).cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("d"))
    return rows.select("k", checks.luhn_ok(F.col("d")).alias("ok"))


def _wsum(weights, d="d"):
    return " + ".join(f"CAST(substr({d}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights))


@query("val2_resident", f"SELECT k, ((11 - (({_wsum([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])}) % 11)) % 10) = CAST(substr(d, 13, 1) AS INT) AS ok FROM (SELECT l_orderkey * 100 + l_linenumber AS k, CAST(1000000000000 + l_orderkey * 7919 + l_partkey AS STRING) AS d FROM lineitem)")
def val2(spark, folder):
    rows = Tables(spark, folder).lineitem.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("k"), (F.lit(1000000000000) + F.col("l_orderkey") * 7919 + F.col("l_partkey")).cast("string").alias("d"))
    return rows.select("k", checks.resident_ok(F.col("d")).alias("ok"))


@query("val3_business", f"SELECT k, ((10 - (({_wsum([1, 3, 7, 1, 3, 7, 1, 3, 5])} + CAST(floor(CAST(substr(d, 9, 1) AS INT) * 5 / 10) AS INT)) % 10)) % 10) = CAST(substr(d, 10, 1) AS INT) AS ok FROM (SELECT l_orderkey * 100 + l_linenumber AS k, CAST(1000000000 + l_orderkey * 7919 + l_partkey AS STRING) AS d FROM lineitem)")
def val3(spark, folder):
    rows = Tables(spark, folder).lineitem.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("k"), (F.lit(1000000000) + F.col("l_orderkey") * 7919 + F.col("l_partkey")).cast("string").alias("d"))
    return rows.select("k", checks.business_ok(F.col("d")).alias("ok"))


_ALLOW, _DENY = ["kr", "example.com"], ["mail3.co.kr", "5.example.com"]
_MAILED = [Piece("'메일 '"), Piece("('user' || CAST(k AS STRING) || '@Mail' || CAST(k % 7 AS STRING) || " + C.pick("k", ".co.kr", ".example.com", ".org") + ")", *_bank("email"),
                             "k % 3 <> 2 AND NOT (k % 3 = 0 AND k % 7 = 3) AND NOT (k % 3 = 1 AND k % 7 = 5)"), Piece("' 로'")]


@query("val4_email_domains", C.expected_sql(_MAILED))
def val4(spark, folder):
    docs = C.sentences(Tables(spark, folder).orders, _MAILED)
    return flat(docs.withColumn("spans", D.pattern_spans(F.col("text"), *_BANK["email"], allow=_ALLOW, deny=_DENY)), "spans", "doc_id")


@query("val5_account_guard", "SELECT l_orderkey * 100 + l_linenumber AS k, (l_linenumber % 3 = 0 OR l_partkey % 2 = 0) AS ok FROM lineitem")
def val5(spark, folder):
    rows = Tables(spark, folder).lineitem.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("k"),
        F.when(F.col("l_linenumber") % 3 == 0, "12-34-56").otherwise("1234-56").alias("hit"),
        F.when(F.col("l_partkey") % 2 == 0, "앞 농협 12345678 ").otherwise("농협 1234567890123 12 ").alias("left"))
    text = F.concat("left", "hit")
    return rows.select("k", checks.account_ok(text, F.length("left"), F.col("hit")).alias("ok"))


@query("val6_url_not_email", "SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS ok FROM orders")
def val6(spark, folder):
    k = F.col("o_orderkey")
    hit = F.when(k % 2 == 0, F.concat(F.lit("a"), k.cast("string"), F.lit(".co.kr/b@c.kr"))).otherwise(F.concat(F.lit("a"), k.cast("string"), F.lit("@b.co.kr")))
    return Tables(spark, folder).orders.select(k.alias("k"), hit.alias("hit")).select("k", (~checks.is_email(F.col("hit"))).alias("ok"))


@query("val7_bounds", "SELECT event_id, s FROM (SELECT event_id, CAST(floor(value) AS BIGINT) % 7 - 2 AS s, user_id % 6 AS e FROM events) WHERE s >= 0 AND s < e AND e <= 4")
def val7(spark, folder):
    e = Tables(spark, folder).events.select("event_id", (F.floor("value").cast("long") % 7 - 2).alias("s"), (F.col("user_id") % 6).alias("e"))
    return e.where(checks.bounds_ok(F.col("s"), F.col("e"), F.lit(4))).select("event_id", "s")


_PRED = "array(named_struct('label', CASE k % 3 WHEN 0 THEN 'LABEL_1' WHEN 1 THEN 'PS_NAME' ELSE 'label_2' END, 'start', 0, 'end', 2, 'score', 0.5D), named_struct('label', 'B-OGG_ECONOMY', 'start', 3, 'end', 4, 'score', 0.25D))"


@query("val10_anonymous_labels", """
    SELECT k, 'PS_NAME' AS label, substr(CAST(k * 7919 + 100000 AS STRING), 1, 2) AS span_text, CAST(0.5 AS DOUBLE) AS score FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 3 = 1
    UNION ALL SELECT k, 'B-OGG_ECONOMY', substr(CAST(k * 7919 + 100000 AS STRING), 4, 1), CAST(0.25 AS DOUBLE) FROM (SELECT o_orderkey AS k FROM orders)""")
def val10(spark, folder):
    rows = Tables(spark, folder).orders.select(F.col("o_orderkey").alias("k")).select("k", F.expr("CAST(k * 7919 + 100000 AS STRING)").alias("text"), F.expr(_PRED).alias("p"))
    spans = rows.select("k", F.explode(D.model_spans(F.col("text"), F.col("p"))).alias("s"))
    return spans.select("k", "s.label", F.col("s.text").alias("span_text"), "s.score")


# --- label lookups ------------------------------------------------------------------------

_ALIAS_KEYS = [*L.LABEL_ALIASES, "미정"]
_ALIAS_CASE = "CASE k % " + str(len(_ALIAS_KEYS)) + " " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_ALIAS_KEYS)) + " END"
_ALIAS_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in L.LABEL_ALIASES.items())


def _keyed(spark, folder, case: str):
    return Tables(spark, folder).orders.select(F.col("o_orderkey").alias("k")).select("k", F.expr(case).alias("raw"))


@query("join1_label_aliases", f"SELECT k, coalesce(v.b, raw) AS label FROM (SELECT o_orderkey AS k, {_ALIAS_CASE.replace('k %', 'o_orderkey %')} AS raw FROM orders) LEFT JOIN (VALUES {_ALIAS_VALUES}) v(a, b) ON raw = a")
def join1(spark, folder):
    return _keyed(spark, folder, _ALIAS_CASE).select("k", X.normalize_label(F.col("raw")).alias("label"))


_STRICT_KEYS = [*L.STRICT_ALIASES, *L.LABELS, "미정", " 회사 "]
_STRICT_CASE = "CASE k % " + str(len(_STRICT_KEYS)) + " " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_STRICT_KEYS)) + " END"
_STRICT_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in [*L.STRICT_ALIASES.items(), *[(x, x) for x in L.LABELS]])


@query("join2_strict_aliases", f"SELECT k, v.b AS label FROM (SELECT o_orderkey AS k, {_STRICT_CASE.replace('k %', 'o_orderkey %')} AS raw FROM orders) JOIN (VALUES {_STRICT_VALUES}) v(a, b) ON trim(raw) = a")
def join2(spark, folder):
    from ..operators.overlap import strict_label
    return _keyed(spark, folder, _STRICT_CASE).select("k", strict_label(F.col("raw")).alias("label")).where("label IS NOT NULL")


_NER_KEYS = [*L.NER_TAGS, "XX_NONE"]
_NER_CASE = "CASE k % " + str(len(_NER_KEYS)) + " " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_NER_KEYS)) + " END"
_NER_VALUES = ", ".join(f"('{t}', '{a}', '{b}')" for t, (a, b) in L.NER_TAGS.items())


@query("join3_entity_tags", f"SELECT k, v.b AS label, v.c AS subtype FROM (SELECT o_orderkey AS k, {_NER_CASE.replace('k %', 'o_orderkey %')} AS raw FROM orders) JOIN (VALUES {_NER_VALUES}) v(a, b, c) ON raw = a")
def join3(spark, folder):
    rows = _keyed(spark, folder, _NER_CASE).select("k", X.ner_label(F.col("raw")).alias("t")).where("t IS NOT NULL")
    return rows.select("k", "t.label", "t.subtype")


_MODEL_KEYS = [p + t for t in L.MODEL_TAGS for p in ("B-", "I-", "")] + ["B-NONE"]
_MODEL_CASE = "CASE k % " + str(len(_MODEL_KEYS)) + " " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_MODEL_KEYS)) + " END"
_MODEL_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in L.MODEL_TAGS.items())


@query("join4_model_tags", f"SELECT k, v.b AS label FROM (SELECT o_orderkey AS k, {_MODEL_CASE.replace('k %', 'o_orderkey %')} AS raw FROM orders) JOIN (VALUES {_MODEL_VALUES}) v(a, b) ON CASE WHEN raw LIKE '_-%' THEN substr(raw, 3) ELSE raw END = a")
def join4(spark, folder):
    return _keyed(spark, folder, _MODEL_CASE).select("k", D.tag_label(F.col("raw")).alias("label")).where("label IS NOT NULL")


@query("ovl7_priorities", "SELECT k, CAST(coalesce(e.p, g.p, 50) AS BIGINT) AS priority FROM (SELECT o_orderkey AS k, "
       + "CASE o_orderkey % 14 " + " ".join(f"WHEN {i} THEN '{lab}'" for i, lab in enumerate([*L.LABELS, "기타", "인명"])) + " END AS lab, "
       + "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(["주민등록번호", "계좌번호", "이메일", "전화번호", "여권번호", "운전면허", "IP", "다른"])) + " END AS sub FROM orders) "
       + "LEFT JOIN (VALUES " + ", ".join(f"('{a}', {p}, '{b}')" for (a, b), p in L.MERGE_PRIORITY.items() if b) + ") e(a, p, b) ON lab = e.a AND sub = e.b "
       + "LEFT JOIN (VALUES " + ", ".join(f"('{a}', {p})" for (a, b), p in L.MERGE_PRIORITY.items() if b is None) + ") g(a, p) ON lab = g.a")
def ovl7(spark, folder):
    from ..operators.overlap import merge_priority
    k = F.col("o_orderkey")
    labels = dict(enumerate([*L.LABELS, "기타", "인명"]))
    subs = dict(enumerate(["주민등록번호", "계좌번호", "이메일", "전화번호", "여권번호", "운전면허", "IP", "다른"]))
    rows = Tables(spark, folder).orders.select(k.alias("k"), lookup(labels, (k % 14).cast("int")).alias("lab"), lookup(subs, (k % 9).cast("int")).alias("sub"))
    return rows.select("k", merge_priority(F.col("lab"), F.col("sub")).cast("long").alias("priority"))


# --- number refinement --------------------------------------------------------------------

_REFINE = [
    Piece(C.pick("k", "연락처는 ", "우리은행 계좌 송금 ", "면허증 번호 ", "그냥 ", "서버 내부 ", "휴대폰 ")),
    Piece("(CASE WHEN k % 6 = 5 THEN " + C.phone("''").replace("k % 5", "4") + " ELSE " + C.business("''") + " END)"), Piece("' 입니다.'"),
]
_START = {"sub": ["전화번호", "계좌번호", "운전면허", "사업자등록번호", "IP", "전화번호"], "lab": ["번호", "금융", "번호", "번호", "번호", "번호"],
          "score": [0.7, 1.0, 0.7, None, 0.8, 0.95], "kw": ["연락처", "계좌", "면허증", None, "서버", None]}


def _case(values) -> str:
    return "CASE k % 6 " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else repr(v)) for i, v in enumerate(values)) + " END"


@query("lab1_number_refinement", C.expected_sql([_REFINE[0], Piece(_REFINE[1].sql, "번호", "x"), _REFINE[2]], (
    "doc_id, span_start, span_end, span_text, (" + _case(_START["lab"]).replace("k %", "doc_id %") + ") AS label_adjusted, (" + _case(_START["sub"]).replace("k %", "doc_id %")
    + ") AS subtype, CAST((" + _case(_START["score"]).replace("k %", "doc_id %") + ") AS DOUBLE) AS score, (" + _case(_START["kw"]).replace("k %", "doc_id %") + ") AS keyword, label")))
def lab1(spark, folder):
    docs = D.bank_spans(C.sentences(Tables(spark, folder).orders, _REFINE))
    return flat(docs.withColumn("spans", D.refine_numbers(F.col("text"), F.col("spans"))), "spans", "doc_id", extra=("label_adjusted", "score", "keyword"))


_VOTES = [Piece(C.pick("k", "전화 통화 은행 ", "국민 농협 여권 ", "우편번호 ", "", "IP ")), Piece("'X'"), Piece(C.pick("(k + 1)", " 계좌 입금", " 문자 콜 전화", ""))]
_KW = ", ".join(f"({r}, {i}, '{sub}', '{w}')" for r, (sub, ws) in enumerate(L.CONTEXT_KEYWORDS) for i, w in enumerate(ws))


@query("lab2_keyword_vote", f"""
    WITH t AS (SELECT k AS doc_id, {C.text_sql(_VOTES)} AS ctx FROM (SELECT o_orderkey AS k FROM orders)),
    hits AS (SELECT doc_id, r, i, sub, w FROM t, (VALUES {_KW}) v(r, i, sub, w) WHERE contains(ctx, w)),
    votes AS (SELECT doc_id, r, sub, count(*) AS n FROM hits GROUP BY ALL),
    best AS (SELECT doc_id, arg_max(sub, n * 100 - r) AS subtype, max(n) AS n FROM votes GROUP BY doc_id)
    SELECT doc_id, subtype, round(CAST(least(1.0, 0.6 + 0.1 * n) AS DOUBLE), 6) AS score, (SELECT arg_min(w, r * 100 + i) FROM hits h WHERE h.doc_id = best.doc_id) AS keyword FROM best""")
def lab2(spark, folder):
    docs = C.sentences(Tables(spark, folder).orders, _VOTES)
    rows = docs.select("doc_id", D.keyword_vote(F.col("text")).alias("v")).where("v IS NOT NULL")
    return rows.select("doc_id", "v.subtype", F.round("v.score", 6).alias("score"), "v.keyword")


_REACH = [Piece("'계좌' || repeat('.', CAST(k % 30 AS INT))"), Piece(C.business("''"), "번호", "x"), Piece("repeat('-', CAST(k % 31 AS INT)) || '여권'")]


@query("join11_keyword_proximity", "SELECT o_orderkey AS doc_id, o_orderkey % 30 <= 22 AS bank_near, o_orderkey % 31 <= 22 AS passport_near FROM orders")
def join11(spark, folder):
    docs = C.sentences(Tables(spark, folder).orders, _REACH)
    span = F.struct((F.lit(2) + F.col("doc_id") % 30).cast("int").alias("start"), (F.lit(12) + F.col("doc_id") % 30).cast("int").alias("end"))
    ctx = docs.select("doc_id", D.span_context(F.col("text"), span).alias("ctx"))
    return ctx.select("doc_id", F.contains("ctx", F.lit("계좌")).alias("bank_near"), F.contains("ctx", F.lit("여권")).alias("passport_near"))


_NEAR = [Piece("'은행 계좌' || repeat('.', CAST(k % 30 AS INT))"), Piece(C.business("''"), "번호", "x"), Piece("repeat('-', CAST(k % 31 AS INT)) || '여권 전화 문자 콜'")]


@query("join11_votes_near_spans", f"""
    WITH t AS (SELECT k AS doc_id, {C.text_sql(_NEAR)} AS text, CAST(5 + k % 30 AS BIGINT) AS s FROM (SELECT o_orderkey AS k FROM orders)),
    c AS (SELECT doc_id, substr(text, greatest(s - {L.CONTEXT_REACH}, 0) + 1, s + 10 + {L.CONTEXT_REACH} - greatest(s - {L.CONTEXT_REACH}, 0)) AS ctx FROM t),
    hits AS (SELECT doc_id, r, i, sub, w FROM c, (VALUES {_KW}) v(r, i, sub, w) WHERE contains(ctx, w)),
    votes AS (SELECT doc_id, r, sub, count(*) AS n FROM hits GROUP BY ALL),
    best AS (SELECT doc_id, arg_max(sub, n * 100 - r) AS subtype, max(n) AS n FROM votes GROUP BY doc_id),
    word AS (SELECT doc_id, arg_min(w, r * 100 + i) AS keyword FROM hits GROUP BY doc_id)
    SELECT doc_id, subtype, CASE WHEN n > 0 THEN round(CAST(least(1.0, 0.6 + 0.1 * n) AS DOUBLE), 6) END AS score, keyword FROM c LEFT JOIN best USING (doc_id) LEFT JOIN word USING (doc_id)""")
def join11_votes(spark, folder):
    docs = C.sentences(Tables(spark, folder).orders, _NEAR)
    start = (F.lit(5) + F.col("doc_id") % 30).cast("int")
    span = F.struct(start.alias("start"), (start + 10).alias("end"))
    rows = docs.select("doc_id", D.keyword_vote(D.span_context(F.col("text"), span)).alias("v"))
    return rows.select("doc_id", "v.subtype", F.round("v.score", 6).alias("score"), "v.keyword")


# --- whole detectors ----------------------------------------------------------------------

# The name rule also takes 전화, 주민 and 주소 for names.  A separated business number with a right
# check digit keeps its label, since it precedes the account pattern.  The time is followed by a
# particle, so its word boundary fails.
MIXED = [
    Piece("'담당 '"), Piece(C.PLAIN_NAME, "이름", L.NAME_SUBTYPE), Piece("' '"), Piece("'전화'", "이름", L.NAME_SUBTYPE), Piece("' '"),
    Piece(C.mobile("''"), "번호", "전화번호"), Piece("', 메일 '"), Piece(C.EMAIL, "계정", "이메일"), Piece("', '"), Piece("'주민'", "이름", L.NAME_SUBTYPE), Piece("' '"),
    Piece(C.resident("'-'"), "신원", "주민등록번호"), Piece("', 카드 '"), Piece(C.card("' '"), "금융", "카드번호"), Piece("', '"),
    Piece("'계좌 ' || " + C.ACCOUNT, "금융", "계좌번호"), Piece("', 내부망 '"), Piece(C.HOST, "URL", "URL"), Piece("' , '"), Piece("'주소'", "이름", L.NAME_SUBTYPE), Piece("': '"),
    Piece(C.ADDRESS, "주소", "주소"), Piece("'. 여권 '"), Piece(C.PASSPORT, "신원", "여권번호"), Piece("' 번호 '"), Piece(C.business("'-'"), "번호", "사업자등록번호"),
    Piece("'; 23:5' || CAST(k % 10 AS STRING) || '에 '"), Piece("'불안'", "정신건강", None), Piece("' 지수'"),
]
# the nearest keyword decides the business number's finer subtype
_REFINED = "doc_id, span_start, span_end, span_text, label, CASE WHEN subtype = '사업자등록번호' THEN '여권번호' ELSE subtype END AS subtype"


def mixed_docs(spark, folder):
    return C.sentences(Tables(spark, folder).orders, MIXED)


_BANK_ONLY = [p if p.label not in ("이름", "정신건강") else Piece(p.sql) for p in MIXED]


@query("lab3_bank_mixed", C.expected_sql(_BANK_ONLY))
def lab3_mixed(spark, folder):
    return flat(D.bank_spans(mixed_docs(spark, folder)), "spans", "doc_id")


def _bank_documents_sql() -> str:
    """The bank on the real documents, which hold no checksummed identifiers with look-arounds."""
    worded = f"(SELECT doc_id, {_WORDED.format('text')} AS worded FROM documents)"
    parts = []
    for rank, (name, re2, where) in enumerate([
            ("account", "[0-9]{2,6}(?:[\\s\\-][0-9]{1,6}){2,5}", "true"), ("email", _EMAIL_TOKEN, _EMAIL_OK), ("ipv4", _IP, "true"), ("url", _URL, "true"),
            ("postcode", "(?:\\(|\\[)?\\d{5}(?:\\)|\\])?", "true"), ("date", "\\b(?:\\d{4}[-./]\\d{1,2}[-./]\\d{1,2})\\b", "true"), ("time", _TIME, "true")]):
        label, subtype = _bank(name)
        parts.append(f"SELECT doc_id, span_start, span_end, '{label}' AS label, '{subtype}' AS subtype, {rank} AS r FROM ({S.matches('worded', re2, 'doc_id', worded)}) WHERE {where}")
    return f"""
    WITH hits AS ({' UNION ALL '.join(parts)}),
    reach AS (SELECT *, max(span_end) OVER (PARTITION BY doc_id ORDER BY span_start, span_start - span_end, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM hits)
    SELECT doc_id, span_start, span_end, substr(text, span_start + 1, span_end - span_start) AS span_text, label, subtype
    FROM reach JOIN documents USING (doc_id) WHERE m IS NULL OR span_end > m"""


@query("lab3_bank_documents", _bank_documents_sql())
def lab3_documents(spark, folder):
    return flat(D.bank_spans(Tables(spark, folder).documents.select("doc_id", "text")), "spans", "doc_id")


_DEFAULT = [p if p.label != "이름" else Piece(p.sql) for p in MIXED]


@query("lab4_default_detector", C.expected_sql(_DEFAULT, _REFINED))
def lab4(spark, folder):
    return flat(D.detect_default(mixed_docs(spark, folder)), "spans", "doc_id")


@query("lab6_all_detectors", C.expected_sql(MIXED, _REFINED))
def lab6(spark, folder):
    return flat(D.detect_all(mixed_docs(spark, folder)), "spans", "doc_id")


@query("lab6_all_detectors_documents")
def lab6_documents(spark, folder):
    return flat(D.detect_all(Tables(spark, folder).documents.select("doc_id", "text")), "spans", "doc_id", extra=("label_adjusted", "score", "source"))


# the model names an organisation, a group without a name and an address that the bank knows better; a reviewer adds one span
_MODEL = [Piece("'저기 '"), Piece("'한빛복지관'", "소속"), Piece("' 메일 '"), Piece(C.EMAIL, "계정", "이메일"), Piece("' 글 '"), Piece("'비밀일기'", "상담이력"), Piece("' 끝'")]


@query("lab6_with_model_and_verdicts", C.expected_sql(_MODEL))
def lab6_model(spark, folder):
    docs = C.sentences(Tables(spark, folder).orders, _MODEL)
    org, word = F.position(F.lit("한빛복지관"), F.col("text")) - 1, F.position(F.lit("비밀일기"), F.col("text")) - 1
    mail = F.position(F.lit("user"), F.col("text")) - 1
    guess = lambda label, start, size, score: F.struct(F.lit(label).alias("label"), start.alias("start"), (start + size).alias("end"), F.lit(score).alias("score"))
    rows = docs.withColumns({
        "model": F.array(guess("소속", org, 5, 0.8), guess("LABEL_3", org, 2, 0.99), guess("이름", mail, 6, 0.99)),
        "review": F.array(make_span(start=word, end=word + 4, text=F.lit("비밀일기"), label=F.lit("상담이력"), label_adjusted=F.lit("상담이력"), score=F.lit(0.7), source=F.lit("regex+gpt")))})
    return flat(D.detect_all(rows, predictions="model", verdicts="review"), "spans", "doc_id")


@query("val4_src15_domain_tables", """WITH mail AS (SELECT c_custkey, 'mail' || (c_custkey % 97) || '.example' || c_nationkey || '.org' AS d FROM customer),
    allow AS (SELECT 'example' || n_nationkey || '.org' AS suffix FROM nation WHERE n_nationkey % 2 = 0),
    deny AS (SELECT 'mail' || (s_suppkey % 97) || '.example' || s_nationkey || '.org' AS suffix FROM supplier)
    SELECT c_custkey, EXISTS (SELECT 1 FROM allow WHERE ends_with(d, suffix)) AND NOT EXISTS (SELECT 1 FROM deny WHERE ends_with(d, suffix)) AS allowed FROM mail""")
def val4_tables(spark, folder):
    t = Tables(spark, folder)
    host = lambda key, nation: F.concat(F.lit("mail"), (F.col(key) % 97).cast("string"), F.lit(".example"), F.col(nation).cast("string"), F.lit(".org"))
    mails = t.customer.select("c_custkey", F.concat(F.lit("someone@"), F.upper(host("c_custkey", "c_nationkey"))).alias("text"))
    allow = t.nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("example"), F.col("n_nationkey").cast("string"), F.lit(".org")).alias("suffix"))
    deny = t.supplier.select(host("s_suppkey", "s_nationkey").alias("suffix"))
    return D.email_allowed_rows(mails, allow, deny).select("c_custkey", "allowed")
