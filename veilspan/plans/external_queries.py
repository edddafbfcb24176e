"""Stored model answers: entity responses, speech responses, review verdicts, corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.arrays import each, make_span
from ..operators import corrections as K, detect as D, external as X
from ..sources import responses as R
from . import corpus as C
from .corpus import Piece
from .detection_queries import flat
from .masking_queries import _PIECES, _SRC, docs_with_spans
from .registry import Tables, query

_K = "(SELECT o_orderkey AS k FROM orders)"


def _keys(spark, folder):
    return Tables(spark, folder).orders.select(F.col("o_orderkey").alias("k"))


# --- entity responses -------------------------------------------------------------------------

# two sentences; the second entity has no morphemes, so its text is searched
_TEXT = "'고객 ' || {name} || ' 님은 ' || {org} || ' 직원입니다. 나이는 ' || {age} || '세.'"
_NAME, _ORG, _AGE = "('김' || CAST(k % 97 AS STRING))", "('회사' || CAST(k % 89 AS STRING))", "CAST(20 + k % 60 AS STRING)"
_BODY = _TEXT.format(name=_NAME, org=_ORG, age=_AGE)
_JSON = ("'{\"sentence\":[{\"id\":\"0\",\"text\":\"고객 ' || " + _NAME + " || ' 님은 ' || " + _ORG + " || ' 직원입니다.\",\"morp\":[{\"id\":0,\"lemma\":\"고객\"},{\"id\":1,\"lemma\":\"' || " + _NAME
         + " || '\"},{\"id\":2,\"lemma\":\"님\"},{\"id\":3,\"lemma\":\"없음\"},{\"id\":4,\"lemma\":\"' || " + _ORG + " || '\"}],\"NE\":[{\"type\":\"PS_NAME\",\"text\":\"' || " + _NAME
         + " || '\",\"begin\":1,\"end\":1},{\"type\":\"OGG_ECONOMY\",\"text\":\"' || " + _ORG + " || '\",\"begin\":4,\"end\":4},{\"type\":\"ZZ\",\"text\":\"x\",\"begin\":0,\"end\":0}]},"
         + "{\"id\":\"1\",\"text\":\"나이는 ' || " + _AGE + " || '세.\",\"morp\":[],\"NE\":[{\"type\":\"QT_AGE\",\"text\":\"' || " + _AGE + " || '\",\"begin\":0,\"end\":0}]}]}'")
_NER_SQL = f"""WITH t AS (SELECT k, {_BODY} AS body, {_NAME} AS name, {_ORG} AS org, {_AGE} AS age FROM {_K}),
    ent AS (SELECT k AS doc_id, 3 AS s, name AS x, '이름' AS label, '인명' AS subtype, body FROM t
      UNION ALL SELECT k, 3 + length(name) + 4, org, '소속', '기업', body FROM t
      UNION ALL SELECT k, instr(substr(body, 3 + length(name) + 4 + length(org) + 1), age) - 1 + 3 + length(name) + 4 + length(org), age, '신원', '나이', body FROM t)
    SELECT doc_id, CAST(s AS BIGINT) AS span_start, CAST(s + length(x) AS BIGINT) AS span_end, x AS span_text, label, subtype FROM ent"""


def _answered(spark, folder):
    return _keys(spark, folder).select(F.col("k").alias("doc_id"), F.expr(_BODY).alias("text"), F.expr(_JSON).alias("raw")).withColumn("r", R.parse_ner(F.col("raw")))


@query("join5_entity_offsets", _NER_SQL)
def join5(spark, folder):
    rows = _answered(spark, folder)
    return flat(rows.withColumn("spans", X.ner_spans(F.col("text"), F.col("r.sentence"))), "spans", "doc_id")


@query("src8_entity_response", f"SELECT k AS doc_id, CAST(2 AS BIGINT) AS sentences, CAST(3 AS BIGINT) AS first_entities, {_NAME} AS first_text FROM {_K}")
def src8(spark, folder):
    r = _answered(spark, folder).select("doc_id", "r")
    return r.select("doc_id", F.size("r.sentence").cast("long").alias("sentences"), F.size(F.get("r.sentence", F.lit(0))["NE"]).cast("long").alias("first_entities"),
                    F.get(F.get("r.sentence", F.lit(0))["NE"], F.lit(0))["text"].alias("first_text"))


# primary spans cover the card; the other supplementary hits remain
_LAB5 = [Piece("'주민 '"), Piece(C.resident("'-'"), "신원", "주민등록번호"), Piece("', 카드 '"), Piece(C.card("'-'"), "금융", "금액"), Piece("', 여권 '"),
         Piece(C.PASSPORT, "신원", "여권번호"), Piece("' 끝'")]


@query("lab5_primary_and_supplementary", C.expected_sql(_LAB5))
def lab5(spark, folder):
    start = "length(" + _LAB5[0].sql + " || " + _LAB5[1].sql + " || " + _LAB5[2].sql + ")"
    rows = _keys(spark, folder).select(F.col("k").alias("doc_id"), F.expr(C.text_sql(_LAB5)).alias("text"), F.expr(start).alias("s"), F.expr(_LAB5[3].sql).alias("v"))
    primary = F.array(make_span(start=F.col("s"), end=F.col("s") + F.length("v"), text=F.col("v"), label=F.lit("금융"), subtype=F.lit("금액"), source=F.lit("ner"), score=F.lit(0.95)))
    rows = rows.withColumn("primary", primary)
    return flat(rows.withColumn("spans", D.primary_and_supplementary(F.col("text"), F.col("primary"))), "spans", "doc_id")


# --- speech responses -------------------------------------------------------------------------

_ASR = """CASE k % 5 WHEN 0 THEN '{"result":0,"return_object":{"recognized":"가' || CAST(k AS STRING) || '"}}' WHEN 1 THEN '{"result":0,"return_object":{"recognized":"","result":"나' || CAST(k AS STRING) || '"}}'
    WHEN 2 THEN '{"result":0,"return_object":{"text":"다"}}' WHEN 3 THEN '{"result":-1,"reason":"r' || CAST(k AS STRING) || '"}' ELSE '{"result":7}' END"""


@query("src9_speech_response", f"""SELECT k, k % 5 < 3 AS success, CASE k % 5 WHEN 0 THEN '가' || CAST(k AS STRING) WHEN 1 THEN '나' || CAST(k AS STRING) WHEN 2 THEN '다' ELSE '' END AS text,
    CASE k % 5 WHEN 3 THEN 'API Error Code: -1 - Reason: r' || CAST(k AS STRING) WHEN 4 THEN 'API Error Code: 7' END AS error FROM {_K}""")
def src9(spark, folder):
    r = _keys(spark, folder).select("k", R.parse_asr(F.expr(_ASR)).alias("r"))
    return r.select("k", "r.success", "r.text", "r.error")


# --- verdicts ---------------------------------------------------------------------------------

_VERDICT = """CASE k % 5 WHEN 0 THEN '{"decisions":[{"id":" 0 ","keep":true,"label":"조직","reason":" r ","confidence":1.7},{"id":"1","keep":false,"label":"번호"}],"additions":[]}'
    WHEN 1 THEN '```json
{"decisions":[{"id":"2","keep":true,"label":null,"confidence":"0.4"}],"additions":[]}
```' WHEN 2 THEN '{"decisions":[{"id":"9","keep":true,"label":"번호"}]}' WHEN 3 THEN 'not json' ELSE NULL END"""


@query("src10_fenced_json", f"SELECT k, CAST(CASE k % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS decisions FROM {_K} WHERE k % 5 < 3")
def src10(spark, folder):
    r = _keys(spark, folder).select("k", R.parse_verdicts(F.expr(_VERDICT)).alias("r"))
    return r.where("r.decisions IS NOT NULL").select("k", F.size("r.decisions").cast("long").alias("decisions"))


@query("src10_parsed_decisions", f"""SELECT k, CAST(0 AS BIGINT) AS ord, ' 0 ' AS id, 'true' AS keep, '조직' AS label, ' r ' AS reason, '1.7' AS confidence FROM {_K} WHERE k % 5 = 0
    UNION ALL SELECT k, 1, '1', 'false', '번호', NULL, NULL FROM {_K} WHERE k % 5 = 0 UNION ALL SELECT k, 0, '2', 'true', NULL, NULL, '0.4' FROM {_K} WHERE k % 5 = 1
    UNION ALL SELECT k, 0, '9', 'true', '번호', NULL, NULL FROM {_K} WHERE k % 5 = 2 UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, NULL FROM {_K} WHERE k % 5 > 2""")
def src10_parsed(spark, folder):
    r = _keys(spark, folder).select("k", R.parse_verdicts(F.expr(_VERDICT)).alias("r")).select("k", F.posexplode_outer("r.decisions").alias("ord", "d"))
    return r.select("k", F.col("ord").cast("long").alias("ord"), "d.id", "d.keep", "d.label", "d.reason", "d.confidence")


@query("val8_decisions", f"""SELECT k, '0' AS id, true AS keep, '소속' AS label, 'r' AS reason, 1.0::DOUBLE AS confidence FROM {_K} WHERE k % 5 = 0
    UNION ALL SELECT k, '1', false, '번호', NULL, NULL FROM {_K} WHERE k % 5 = 0 UNION ALL SELECT k, '2', true, NULL, NULL, 0.4 FROM {_K} WHERE k % 5 = 1
    UNION ALL SELECT k, '9', true, '번호', NULL, NULL FROM {_K} WHERE k % 5 = 2""")
def val8(spark, folder):
    r = _keys(spark, folder).select("k", R.parse_verdicts(F.expr(_VERDICT)).alias("r")).select("k", F.explode("r.decisions").alias("d"))
    return r.select("k", X.checked_decision(F.col("d")).alias("c")).select("k", "c.id", "c.keep", "c.label", "c.reason", "c.confidence")


def _start(i: int) -> str:
    return " + ".join(f"length(s{j})" for j in range(i))


_SPANS = [i for i, p in enumerate(_PIECES) if p.label]


def _kept(piece: int, where: str, label: str, source: str) -> str:
    return f"SELECT k AS doc_id, CAST({_start(piece)} AS BIGINT) AS span_start, s{piece} AS span_text, '{label}' AS label_adjusted, {source} AS source FROM {_SRC} WHERE {where}"


_FALLBACK = " UNION ALL ".join(_kept(i, "k % 5 >= 2", _PIECES[i].label, "NULL") for i in _SPANS)


@query("join7_lab11_verdicts", f"{_kept(_SPANS[0], 'k % 5 = 0', '소속', chr(39) + 'regex+gpt' + chr(39))} UNION ALL {_kept(_SPANS[2], 'k % 5 = 1', '계정', chr(39) + 'regex+gpt' + chr(39))} UNION ALL {_FALLBACK}")
def lab11(spark, folder):
    rows = docs_with_spans(spark, folder).withColumn("r", F.expr(_VERDICT.replace("k %", "doc_id %"))).withColumn("r", R.parse_verdicts(F.col("r")))
    out = each(rows.withColumn("after", X.apply_verdicts(F.col("text"), F.col("spans"), F.col("r"))), "after", "doc_id")
    return out.select("doc_id", F.col("s.start").cast("long").alias("span_start"), F.col("s.text").alias("span_text"), "s.label_adjusted", "s.source")


_ADD = """'{"additions":[{"win_id":"win-400","start_rel":' || CAST(doc_id % 50 AS STRING) || ',"end_rel":' || CAST(doc_id % 50 + 5 + doc_id % 140 AS STRING) || ',"label":"회사"},
  {"win_id":" win-0 ","start_rel":1,"end_rel":4,"label":"이름"},{"win_id":"win-0","start_rel":-1,"end_rel":4,"label":"이름"},{"win_id":"win-7","start_rel":1,"end_rel":4,"label":"이름"},
  {"win_id":"win-0","start_rel":5,"end_rel":9,"label":"모름"},{"win_id":"win-0","start_rel":"x","end_rel":9,"label":"이름"}]}'"""


@query("val9_join8_additions", """SELECT doc_id, CAST(400 + doc_id % 50 AS BIGINT) AS span_start, CAST(400 + doc_id % 50 + 5 + doc_id % 140 AS BIGINT) AS span_end, substr(text, 400 + doc_id % 50 + 1, 5 + doc_id % 140) AS span_text, '소속' AS label, CAST(NULL AS VARCHAR) AS subtype
    FROM documents WHERE length(text) > 400 AND 400 + doc_id % 50 + 5 + doc_id % 140 <= least(1000, length(text)) AND 5 + doc_id % 140 <= 128
    UNION ALL SELECT doc_id, 1, 4, substr(text, 2, 3), '이름', NULL FROM documents WHERE length(text) >= 4""")
def val9(spark, folder):
    rows = Tables(spark, folder).documents.select("doc_id", "text", R.parse_verdicts(F.expr(_ADD)).alias("r"))
    return flat(rows.withColumn("spans", X.checked_additions(F.col("text"), F.col("r.additions"), F.lit(True))), "spans", "doc_id")


# --- review payloads --------------------------------------------------------------------------


# a tail without spans makes the coverage of two texts in three small
_TAIL = "repeat('가', CAST(k % 3 * 500 AS INT))"
_SHARE = f"({' + '.join(f'length(s{i})' for i in _SPANS)}) / CAST(length({' || '.join(f's{i}' for i in range(len(_PIECES)))} || {_TAIL}) AS DOUBLE)"


@query("lab8_coverage", f"SELECT k AS doc_id, round({_SHARE}, 6) AS covered, {_SHARE} < {L.VERDICT_COVERAGE} AS windows FROM {_SRC}")
def lab8(spark, folder):
    rows = docs_with_spans(spark, folder).withColumn("text", F.concat("text", F.expr(_TAIL.replace("k %", "doc_id %"))))
    return rows.select("doc_id", F.round(X.coverage(F.col("text"), F.col("spans")), 6).alias("covered"), X.needs_windows(F.col("text"), F.col("spans")).alias("windows"))


# without decisions an addition counts where little is covered; elsewhere the spans stay as they are
_ADDED = '{"decisions":[],"additions":[{"win_id":"win-0","start_rel":0,"end_rel":2,"label":"이름"}]}'


@query("lab11_additions_where_uncovered", f"SELECT k AS doc_id, CAST(0 AS BIGINT) AS span_start, '담당' AS span_text, '이름' AS label_adjusted FROM {_SRC} WHERE {_SHARE} < {L.VERDICT_COVERAGE} UNION ALL "
       + " UNION ALL ".join(f"SELECT k, CAST({_start(i)} AS BIGINT), s{i}, '{_PIECES[i].label}' FROM {_SRC} WHERE {_SHARE} >= {L.VERDICT_COVERAGE}" for i in _SPANS))
def lab11_additions(spark, folder):
    rows = docs_with_spans(spark, folder).withColumn("text", F.concat("text", F.expr(_TAIL.replace("k %", "doc_id %")))).withColumn("r", R.parse_verdicts(F.lit(_ADDED)))
    out = each(rows.withColumn("after", X.apply_verdicts(F.col("text"), F.col("spans"), F.col("r"))), "after", "doc_id")
    return out.select("doc_id", F.col("s.start").cast("long").alias("span_start"), F.col("s.text").alias("span_text"), F.coalesce("s.label_adjusted", "s.label").alias("label_adjusted"))


_LEN_ONLY = "SELECT doc_id, 'win-' || CAST(o AS VARCHAR) AS win_id, CAST(o AS BIGINT) AS at_char, CAST(least(600, length(text) - o) AS BIGINT) AS size, regexp_replace(substr(text, o + 1, 600), '[\\p{L}\\p{N}]', 'X', 'g') AS shape FROM (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS o FROM documents)"


@query("lab9_review_windows", _LEN_ONLY)
def lab9(spark, folder):
    w = X.review_windows(Tables(spark, folder).documents.select("doc_id", "text"), "doc_id")
    return w.select("doc_id", "win_id", F.col("offset").cast("long").alias("at_char"), F.length("context").cast("long").alias("size"),
                    F.regexp_replace("context", r"[\p{L}\p{N}]", "X").alias("shape"))


_LETTERS = "'[\\p{L}\\p{N}]', 'X', 'g'"
_SURNAME = L.REDACTION_NAME.removesuffix("[가-힣]{1,2}")


def _redacted(i: int) -> str:
    """A span as a reviewer sees it: numbers and addresses blanked whole, names as far as the name pattern reaches."""
    if i == 1:
        return f"regexp_replace(regexp_replace(s{i}, '{_SURNAME}[가-힣]{{2}}', 'XXX', 'g'), '{_SURNAME}[가-힣]', 'XX', 'g')"
    return f"s{i}" if _PIECES[i].label == "정신건강" else f"regexp_replace(s{i}, {_LETTERS})"


@query("lab10_review_items", " UNION ALL ".join(
    f"SELECT k AS doc_id, '{n}' AS id, {_redacted(i)} AS span_text, '{_PIECES[i].label}' AS proposed_label FROM {_SRC}" for n, i in enumerate(_SPANS)))
def lab10(spark, folder):
    return X.review_items(docs_with_spans(spark, folder), "doc_id").select("doc_id", "id", "span_text", "proposed_label")


# the whole text as a reviewer sees it: the name pattern may reach over the particle after a short name; the tail is
# plain and cuts the contexts of two texts in three
_SEEN = " || ".join(["s0", _redacted(1).replace("s1", "(s1 || s2)"), *[_redacted(i) if i in _SPANS else f"s{i}" for i in range(3, len(_PIECES))], _TAIL])


def _context(i: int) -> str:
    """The text up to the context's reach after a span; before it there is less than that."""
    return f"substr({_SEEN}, 1, CAST({_start(i)} + length(s{i}) + {L.CONTEXT_SLICE} AS BIGINT))"


@query("lab10_review_contexts", " UNION ALL ".join(
    f"SELECT k AS doc_id, '{n}' AS id, {_redacted(i)} AS span_text, '{_PIECES[i].label}' AS proposed_label, CAST(NULL AS VARCHAR) AS proposed_subtype, "
    f"{_context(i)} AS context FROM {_SRC}" for n, i in enumerate(_SPANS)))
def lab10_contexts(spark, folder):
    rows = docs_with_spans(spark, folder).withColumn("text", F.concat("text", F.expr(_TAIL.replace("k %", "doc_id %"))))
    return X.review_items(rows, "doc_id")


# --- people's review --------------------------------------------------------------------------

_ROWS = " UNION ALL ".join(f"SELECT k AS doc_id, {n} AS ord, s{i} AS t, '{_PIECES[i].label}' AS label FROM {_SRC}" for n, i in enumerate(_SPANS))


@query("val11_reviewer_choices", f"SELECT doc_id, CAST(ord AS BIGINT) AS ord, CASE WHEN doc_id % 4 = ord AND doc_id % 3 = 1 THEN '소속' ELSE label END AS label_adjusted FROM ({_ROWS}) WHERE NOT (doc_id % 4 = ord AND doc_id % 3 = 0)")
def val11(spark, folder):
    rows = D.explode_spans(docs_with_spans(spark, folder), "spans", "doc_id")
    k = F.col("k")
    review = _keys(spark, folder).select(k.alias("doc_id"), (k % 4).cast("int").alias("ord"), (k % 3 != 0).alias("include"), F.when(k % 3 == 1, "소속").alias("new_label"))
    return X.reviewed_by_people(rows, review, "doc_id").select("doc_id", F.col("ord").cast("long").alias("ord"), "label_adjusted")


@query("val11_reviewer_labels", """SELECT doc_id, coalesce(quality, 1) = 1 AS include FROM documents LEFT JOIN labels USING (doc_id)""")
def val11_labels(spark, folder):
    t = Tables(spark, folder)
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", (F.coalesce("quality", F.lit(1)) == 1).alias("include"))


# --- proper nouns -----------------------------------------------------------------------------

# tokens: 담당(NNG) 김(NNP) 민수(NNP) 확인(NNG) 서울대학교(NNP)
_TOK = [("'담당'", "NNG"), ("'김'", "NNP"), ("substr('민수지영서준', CAST(k % 3 * 2 + 1 AS INT), 2)", "NNP"), ("'확인'", "NNG"), ("'서울대학교'", "NNP")]


@query("lab7_proper_noun_runs", f"SELECT k AS doc_id, CAST(3 AS BIGINT) AS span_start, CAST(7 AS BIGINT) AS span_end, '김 ' || {_TOK[2][0]} AS span_text FROM {_K}")
def lab7(spark, folder):
    rows = _keys(spark, folder).select(F.col("k").alias("doc_id"), F.concat_ws(" ", *[F.expr(x) for x, _ in _TOK]).alias("text"))
    spots = [(0, 2), (3, 4), (5, 7), (8, 10), (11, 16)]
    tokens = F.array(*[F.struct(F.substring("text", s + 1, e - s).alias("text"), F.lit(pos).alias("pos"), F.lit(s).alias("start"), F.lit(e).alias("end")) for (s, e), (_, pos) in zip(spots, _TOK, strict=True)])
    rows = rows.withColumn("tokens", tokens)
    out = rows.withColumn("spans", D.proper_noun_spans(F.col("text"), F.col("tokens")))
    return flat(out, "spans", "doc_id").select("doc_id", "span_start", "span_end", "span_text")


# --- corrections ------------------------------------------------------------------------------


@query("lab12_substitutions", "SELECT doc_id, replace(replace(text, 'the', 'THE'), 'and', '&') AS out_text FROM documents")
def lab12(spark, folder):
    issues = F.array(*[F.struct(F.lit(a).alias("text"), F.lit(b).alias("suggested_correction")) for a, b in [("the", "THE"), ("", "x"), ("and", "&"), ("of", "")]])
    return Tables(spark, folder).documents.select("doc_id", K.substitute(F.col("text"), issues).alias("out_text"))


@query("lab13_confidence_bands", "SELECT event_id, CASE WHEN value / 100.0::DOUBLE >= 0.7 THEN 'auto' WHEN value / 100.0::DOUBLE >= 0.3 THEN 'review' ELSE 'ignore' END AS band FROM events")
def lab13(spark, folder):
    e = Tables(spark, folder).events
    return e.select("event_id", K.confidence_band(F.col("value") / 100.0).alias("band"))


_HEARD = "CASE k % 4 WHEN 0 THEN '보드게임 하다가 제가 잤' WHEN 1 THEN '제가 잤' WHEN 2 THEN '초아 친구는' ELSE '한이 없어요' END || CAST(k AS STRING)"


@query("lab14_sound_alikes", f"SELECT k, CASE k % 4 WHEN 0 THEN '보드게임 하다가 제가 졌' WHEN 1 THEN '제가 잤' WHEN 2 THEN '좋아 친구는' ELSE '한 번도 없어요' END || CAST(k AS STRING) AS out_text FROM {_K}")
def lab14(spark, folder):
    rows = _keys(spark, folder).select("k", F.expr(_HEARD).alias("text"))
    return rows.select("k", K.fix_sound_alikes(F.col("text")).alias("out_text"))


_SUSPECT = """'{"corrected_text":"x","suspicious_parts":[{"text":"a' || CAST(k AS STRING) || '","start_char":' || CAST(k AS STRING) || ',"linguistic_type":"phonetic","suggestions":["b","c"],"confidence":0.6},{"text":"z","end_char":' || CAST(k + 1 AS STRING) || ',"reason":"r' || CAST(k AS STRING) || '"}]}'"""


@query("lab15_review_rows", f"SELECT k, CAST(k AS BIGINT) AS start, CAST(0 AS BIGINT) AS end_char, 'a' || CAST(k AS STRING) AS text, '' AS reason, 'phonetic' AS linguistic_type, '#FF6B6B' AS colour, 0.6::DOUBLE AS confidence, 'b|c' AS suggestions FROM {_K} "
       f"UNION ALL SELECT k, 0, k + 1, 'z', 'r' || CAST(k AS STRING), '', '#FFA07A', 0.5, '' FROM {_K}")
def lab15(spark, folder):
    rows = _keys(spark, folder).select("k", R.parse_correction(F.expr(_SUSPECT)).alias("response"))
    return K.review_rows(rows, "k").select("k", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_char"), "text", "reason", "linguistic_type", "colour",
                                           "confidence", F.array_join("suggestions", "|").alias("suggestions"))


@query("join13_user_choices", f"SELECT k, '나나 ' || CAST(k AS STRING) || ' 가 다라라 가' AS out_text FROM {_K}")
def join13(spark, folder):
    rows = _keys(spark, folder).select("k", F.concat(F.lit("가 "), F.col("k").cast("string"), F.lit(" 가 다라 가")).alias("text"))
    choices = F.array(*[F.struct(F.lit(a).alias("original"), F.lit(b).alias("replacement")) for a, b in [("다라", "다라라"), ("가", "나나"), ("없음", "x")]])
    return rows.select("k", K.apply_choices(F.col("text"), choices).alias("out_text"))


@query("agg15_scorecard", f"SELECT count(*) * 2 AS pairs, count(*) + count(*) FILTER (k % 2 = 0) AS passed, round((count(*) + count(*) FILTER (k % 2 = 0)) / (count(*) * 2.0::DOUBLE) * 100, 6) AS score FROM {_K}")
def agg15(spark, folder):
    k = F.col("k")
    rows = _keys(spark, folder).select(F.lit("제가 잤어요 초아요").alias("text"), F.when(k % 2 == 0, "제가 졌어요 좋아요").otherwise("제가 졌어요 초아요").alias("corrected"),
                                       F.array(*[F.struct(F.lit(a).alias("wrong"), F.lit(b).alias("right")) for a, b in [("잤", "졌"), ("초아", "좋아"), ("없", "있")]]).alias("expected"))
    return K.scorecard(rows).select("pairs", "passed", F.round("score", 6).alias("score"))


@query("agg6_correction_summary", f"SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN '자동 수정 없음' WHEN k % 3 = 1 THEN '중복 조사 1개' ELSE '중복 조사 2개, 문장부호 1개, other 1개' END AS summary FROM {_K}")
def agg6(spark, folder):
    def entry(t):
        return F.struct(F.lit(t).alias("type"))

    k = F.col("k")
    log = F.when(k % 3 == 0, F.array().cast("array<struct<type:string>>")).when(k % 3 == 1, F.array(entry("duplicate"))).otherwise(
        F.array(entry("duplicate"), entry("punctuation"), entry("duplicate"), entry("other")))
    return _keys(spark, folder).select(k.alias("doc_id"), log.alias("log")).select("doc_id", K.correction_summary(F.col("log")).alias("summary"))


@query("correct_with_response", f"SELECT k, CASE k % 3 WHEN 0 THEN '나는 밥를 먹었다. 그래서 간다' WHEN 1 THEN '고친 글.' || chr(10) || '끝 ' || CAST(k AS STRING) ELSE '고친 글. 긑 ' || CAST(k AS STRING) END AS corrected_text FROM {_K}")
def correct(spark, folder):
    k = F.col("k")
    long_text = F.when(k % 3 == 2, "짧은 글").otherwise(F.lit("나는 밥을를 먹었다 . 그래서   간다"))
    base = _keys(spark, folder).select("k", F.when(k % 3 == 1, F.repeat(long_text, 5)).otherwise(long_text).alias("text"),
                                       F.when(k % 3 > 0, F.concat(F.lit('{"corrected_text":"고친 글. 긑 '), k.cast("string"), F.lit('"}'))).alias("raw"))
    rows = base.withColumns({"response": R.parse_correction(F.col("raw")), "analysis": R.parse_analysis(F.lit('{"semantic_issues":[{"text":"긑","suggested_correction":"끝"}]}'))})
    return K.correct(rows, "text", "response", "analysis").select("k", "corrected_text")


