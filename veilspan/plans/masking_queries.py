"""Masking modes, records, restore, highlight and rule building."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.arrays import make_span
from ..operators import detect as D, endtoend, masking as M
from ..session import shared_folder
from ..sources import vault as V
from . import corpus as C
from .corpus import Piece
from .registry import Tables, query

# a sentence whose four spans are known; labels by position
_PIECES = [Piece("'담당 '"), Piece(C.NAME, "이름"), Piece("'의 번호는 '"), Piece(C.phone("'-'"), "번호"), Piece("', 메일 '"), Piece(C.EMAIL, "계정"), Piece("' 상태 '"),
           Piece(C.pick("k", "불안", "우울"), "정신건강"), Piece("'.'")]
_COLS = ", ".join(f"{p.sql} AS s{i}" for i, p in enumerate(_PIECES))
_SRC = f"(SELECT k, {_COLS} FROM (SELECT o_orderkey AS k FROM orders))"
_ENTITY_RULES = {"불안": "기분", "user7@mail0.co.kr": "메일"}
RULES = {
    "simple": {"mode": "simple", "simple_rule": "[가림]"},
    "simple_default": {"mode": "simple"},
    "advanced": L.DEFAULT_RULES,
    "custom": {"mode": "custom", "entity_rules": _ENTITY_RULES, "label_rules": {"이름": "아무개", "번호": "000"}, "default": "[기타정보]"},
    "unknown": {"mode": "other", "default": "[?]"},
}


def docs_with_spans(spark, folder):
    """The sentences with their spans placed by piece lengths."""
    keyed = C.dealt(Tables(spark, folder).orders.select(F.col("o_orderkey").alias("k")))
    parts = keyed.select("k", *[F.expr(p.sql).alias(f"s{i}") for i, p in enumerate(_PIECES)])
    spans = []
    for i, p in enumerate(_PIECES):
        if p.label:
            start = sum((F.length(f"s{j}") for j in range(1, i)), F.length("s0"))
            spans.append(make_span(start=start, end=start + F.length(f"s{i}"), text=F.col(f"s{i}"), label=F.lit(p.label), score=F.lit(0.5)))
    return parts.select(F.col("k").alias("doc_id"), F.concat(*[f"s{i}" for i in range(len(_PIECES))]).alias("text"), F.array(*spans).alias("spans"))


def _mask_sql(rules: dict, piece: int) -> str:
    label, text = _PIECES[piece].label, f"s{piece}"
    default = rules.get("default", L.MASK_DEFAULT)
    by_label = rules.get("label_rules", {}).get(label, default)
    if rules["mode"] == "simple":
        return f"'{rules.get('simple_rule', L.MASK_DEFAULT)}'"
    if rules["mode"] == "advanced":
        return f"'{by_label}'"
    if rules["mode"] == "custom":
        return "CASE " + " ".join(f"WHEN {text} = '{a}' THEN '{b}'" for a, b in rules["entity_rules"].items()) + f" ELSE '{by_label}' END"
    return f"'{default}'"


def _masked_sql(rules: dict) -> str:
    return " || ".join(_mask_sql(rules, i) if p.label else f"s{i}" for i, p in enumerate(_PIECES))


_MODES = {"mask1_simple": "simple", "mask1_simple_default": "simple_default", "mask2_advanced": "advanced", "mask3_custom": "custom", "mask4_unknown_mode": "unknown"}


def _mode_query(name: str, mode: str):
    @query(name, f"SELECT k AS doc_id, {_masked_sql(RULES[mode])} AS masked_text FROM {_SRC}")
    def run(spark, folder):
        return M.mask(docs_with_spans(spark, folder), rules=RULES[mode]).select("doc_id", "masked_text")


for _name, _mode in _MODES.items():
    _mode_query(_name, _mode)

_ANY = "[A-Za-z0-9._%+-]*@[A-Za-z0-9._%+@-]*"


@query("mask5_documents", f"""
    SELECT doc_id, CASE WHEN contains(text, '@') THEN list_aggregate(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(
        CASE WHEN regexp_full_match(m[i], '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') THEN '[이메일]' ELSE m[i] END, '')), 'string_agg', '') ELSE text END AS masked_text
    FROM (SELECT doc_id, text, regexp_split_to_array(text, '{_ANY}') AS g, regexp_extract_all(text, '{_ANY}') AS m FROM documents)""")
def mask5(spark, folder):
    docs = Tables(spark, folder).documents.select("doc_id", "text")
    email = next(e for e in L.PATTERN_BANK if e[0] == "email")
    found = docs.withColumn("spans", D.pattern_spans(F.col("text"), *email))
    return M.mask(found).select("doc_id", "masked_text")


def _records_sql() -> str:
    rows = []
    order = [i for i, p in enumerate(_PIECES) if p.label][::-1]
    for n, i in enumerate(order):
        start = " + ".join(f"length(s{j})" for j in range(i))
        rows.append(f"SELECT k AS doc_id, 'd' || CAST(k AS STRING) || '_{n:04d}' AS entity_id, s{i} AS original_text, {_mask_sql(RULES['advanced'], i)} AS masked_text, "
                    f"'{_PIECES[i].label}' AS label, CAST({start} AS BIGINT) AS span_start, 'unknown' AS source, CAST(0.5 AS DOUBLE) AS confidence FROM {_SRC}")
    return " UNION ALL ".join(rows)


@query("mask6_records", _records_sql())
def mask6(spark, folder):
    masked = M.mask(docs_with_spans(spark, folder), session=F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    rows = V.vault_records(masked, "doc_id")
    return rows.select("doc_id", "entity_id", "original_text", "masked_text", "label", F.col("start").cast("long").alias("span_start"), "metadata.source", "metadata.confidence")


@query("mask7_stats", f"SELECT k AS doc_id, CAST(4 AS BIGINT) AS total, CAST(1 AS BIGINT) AS names, CAST(length({' || '.join(f's{i}' for i in range(len(_PIECES)))}) AS BIGINT) AS text_length, CAST(length({_masked_sql(RULES['advanced'])}) AS BIGINT) AS masked_length FROM {_SRC}")
def mask7(spark, folder):
    s = M.mask(docs_with_spans(spark, folder)).select("doc_id", "mask_stats")
    return s.select("doc_id", F.col("mask_stats.total").cast("long").alias("total"), F.element_at("mask_stats.by_label", "이름").cast("long").alias("names"),
                    F.col("mask_stats.text_length").cast("long").alias("text_length"), F.col("mask_stats.masked_length").cast("long").alias("masked_length"))


@query("mask8_restore", "SELECT doc_id, text AS original FROM documents WHERE contains(text, '@') AND regexp_matches(text, '(^|[^A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}($|[^A-Za-z0-9._%+@-])')")
def mask8(spark, folder):
    docs = Tables(spark, folder).documents.select("doc_id", "text")
    email = next(e for e in L.PATTERN_BANK if e[0] == "email")
    masked = M.mask(docs.withColumn("spans", D.pattern_spans(F.col("text"), *email)))
    vault = V.vault_rows(masked, F.concat(F.lit("s"), F.col("doc_id").cast("string")), F.lit("2025-01-01T00:00:00"), "text", "doc_id")
    path = f"{shared_folder(spark)}/vault-{uuid.uuid4().hex}"
    V.write_vault(vault, path)
    stored = V.read_vault(spark, path, "parquet", "doc_id long")
    return M.restore(masked.where(F.size("records") > 0), stored, "doc_id").select("doc_id", "original")


@query("mask9_default_rules", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '[개인정보]')" for a, b in L.DEFAULT_RULES["label_rules"].items())
       + ", ('정신건강', '[개인정보]', '[개인정보]')) v(label, mask, fallback) WHERE EXISTS (SELECT 1 FROM orders)")
def mask9(spark, folder):
    rules = M.rules_column(L.DEFAULT_RULES)
    labels = [*L.DEFAULT_RULES["label_rules"], "정신건강"]
    rows = Tables(spark, folder).orders.select(F.get(F.array(*[F.lit(x) for x in labels]), (F.col("o_orderkey") % len(labels)).cast("int")).alias("label"))
    return rows.groupBy("label").agg(F.first(M.choose_mask(rules, F.lit(""), F.col("label"))).alias("mask"), F.first(rules["default"]).alias("fallback"))


_ROWS_SQL = " UNION ALL ".join(f"SELECT k, {i} AS ord, s{i} AS t, '{p.label}' AS label FROM {_SRC}" for i, p in enumerate(_PIECES) if p.label)


@query("mask10_labels", f"SELECT DISTINCT label FROM ({_ROWS_SQL})")
def mask10_labels(spark, folder):
    return M.rule_builder(D.explode_spans(docs_with_spans(spark, folder), "spans", "doc_id"), "doc_id", "ord")[0]


@query("mask10_texts", f"SELECT t AS text, arg_min(label, k * 10 + ord) AS label FROM ({_ROWS_SQL}) GROUP BY t")
def mask10_texts(spark, folder):
    return M.rule_builder(D.explode_spans(docs_with_spans(spark, folder), "spans", "doc_id"), "doc_id", "ord")[1]


@query("val12_search_texts", f"SELECT DISTINCT t AS text FROM ({_ROWS_SQL}) WHERE contains(lower(t), 'mail3.co')")
def val12(spark, folder):
    texts = M.rule_builder(D.explode_spans(docs_with_spans(spark, folder), "spans", "doc_id"), "doc_id", "ord")[1]
    return M.search_texts(texts, "MAIL3.co").select("text")


@query("join12_rule_tables", f"""SELECT k AS doc_id, t AS text, coalesce(e.mask, CASE label WHEN '이름' THEN '[이름]' WHEN '번호' THEN '[전화번호]' END, '[MASKED]') AS mask
    FROM ({_ROWS_SQL}) LEFT JOIN (SELECT DISTINCT 'user' || CAST(c_custkey AS STRING) || '@mail' || CAST(c_custkey % 7 AS STRING) || '.co.kr' AS e_text, 'c' || CAST(c_custkey AS STRING) AS mask FROM customer) e ON t = e_text""")
def join12(spark, folder):
    t = Tables(spark, folder)
    key = F.col("c_custkey").cast("string")
    entity = t.customer.select(F.concat(F.lit("user"), key, F.lit("@mail"), (F.col("c_custkey") % 7).cast("string"), F.lit(".co.kr")).alias("text"), F.concat(F.lit("c"), key).alias("mask"))
    labels = spark.createDataFrame([("이름", "[이름]"), ("번호", "[전화번호]")], "label string, mask string")
    rows = D.explode_spans(docs_with_spans(spark, folder), "spans", "doc_id")
    return M.mask_with_tables(rows, entity, labels).select("doc_id", "text", "mask")


def _tag(i: int) -> str:
    p = _PIECES[i]
    return f"'<span style=\"background:{L.HIGHLIGHT_COLOURS[p.label]}33; padding:2px 2px; border-radius:3px;\" title=\"{p.label}\">' || s{i} || '</span>'"


@query("str22_highlight", f"SELECT k AS doc_id, {' || '.join(_tag(i) if p.label else f's{i}' for i, p in enumerate(_PIECES))} AS out_text FROM {_SRC}")
def str22(spark, folder):
    return docs_with_spans(spark, folder).select("doc_id", M.highlight(F.col("text"), F.col("spans")).alias("out_text"))


# --- the whole way: correct, detect, mask -------------------------------------------------------

_E1 = [Piece("'연락 '"), Piece(C.resident("'-'"), "신원", "주민등록번호"), Piece("', 메일 '"), Piece(C.EMAIL, "계정", "이메일"), Piece("' 끝입니다.'")]
_E1_MASKED = " || ".join(f"'{L.DEFAULT_RULES['label_rules'].get(p.label, L.MASK_DEFAULT)}'" if p.label else p.sql for p in _E1)
_E1_TEXT = " || ".join(p.sql for p in _E1)


@query("e1_correct_detect_mask", f"""SELECT k AS doc_id, k % 5 > 1 AS success, CASE WHEN k % 5 > 1 THEN {_E1_TEXT} END AS corrected_text, CASE WHEN k % 5 > 1 THEN {_E1_MASKED} END AS masked_text,
    CASE WHEN k % 5 > 1 THEN 2 ELSE 0 END AS entities, CASE k % 5 WHEN 0 THEN 'API Error Code: 5' WHEN 1 THEN 'no text' ELSE '' END AS errors FROM (SELECT o_orderkey AS k FROM orders)""")
def e1(spark, folder):
    k = F.col("k")
    rows = Tables(spark, folder).orders.select(F.col("o_orderkey").alias("k")).select(
        k.alias("doc_id"), F.when(k % 5 == 1, "  ").when(k % 5 > 1, F.replace(F.expr(_E1_TEXT), F.lit("연락 "), F.lit("연락   "))).alias("text"),
        F.when(k % 5 == 0, "API Error Code: 5").alias("asr_error"))
    done = endtoend.process(rows, error="asr_error")
    return done.select("doc_id", "success", "corrected_text", "masked_text", F.size("records").alias("entities"), F.array_join("errors", ";").alias("errors"))
