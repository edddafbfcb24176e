"""Text functions over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import clocks, text as T
from ..functions.finditer import find_all
from ..operators import corrections, transcripts
from . import corpus as C
from . import sqltext as S
from .registry import Tables, query

# a text with full-width digits, odd dashes, ideographic blanks and zero-width characters
_ZW = "​"
_DIRTY = (f"replace(replace(replace(replace(text, ' the ', ' ： '), ' of ', ' . '), 'ing', '－１２　—'), 'er', 'e{_ZW}r')")
_CONF = (L.CONFUSABLE_FROM, L.CONFUSABLE_TO)


def _dirty(t):
    return t.documents.select("doc_id", F.expr(_DIRTY).alias("text"))


def _sql(column: str, source: str = f"(SELECT doc_id, {_DIRTY} AS text FROM documents)") -> str:
    return f"SELECT doc_id, {column} AS out_text FROM {source}"


_FULLWIDTH = "translate(CAST(k * 7919 AS STRING), '0123456789', '０１２３４５６７８９')"


@query("str1_nfkc", "SELECT o_orderkey AS doc_id, '번호 ' || CAST(o_orderkey * 7919 AS STRING) || ' (주) fin' AS out_text FROM orders")
def str1(spark, folder):
    rows = Tables(spark, folder).orders.select(F.col("o_orderkey").alias("k"))
    rows = rows.select(F.col("k").alias("doc_id"), F.expr(f"'번호 ' || {_FULLWIDTH} || ' ㈜ ﬁn'").alias("text"))
    return rows.select("doc_id", T.nfkc(F.col("text")).alias("out_text"))


@query("str1_nfkc_documents", "SELECT doc_id, nfc_normalize(text) AS out_text FROM documents")
def str1_documents(spark, folder):
    return Tables(spark, folder).documents.select("doc_id", T.nfkc(F.col("text")).alias("out_text"))


_TR = f"translate(text, '{_CONF[0]}', '{_CONF[1]}')"


@query("str2_confusables", _sql(_TR))
def str2(spark, folder):
    return _dirty(Tables(spark, folder)).select("doc_id", T.ascii_confusables(F.col("text")).alias("out_text"))


_ZWSQL = r"regexp_replace({}, '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g')"


@query("str3_zero_width", _sql(_ZWSQL.format("text")))
def str3(spark, folder):
    return _dirty(Tables(spark, folder)).select("doc_id", T.drop_zero_width(F.col("text")).alias("out_text"))


_TIGHT = "replace(replace({}, ' . ', '.'), ' : ', ':')"


@query("str4_tight_separators", _sql(_TIGHT.format(_TR)))
def str4(spark, folder):
    rows = _dirty(Tables(spark, folder)).select("doc_id", T.ascii_confusables(F.col("text")).alias("text"))
    return rows.select("doc_id", T.tighten_separators(F.col("text")).alias("out_text"))


_WIDE = "'  ' || replace(text, ' a ', '  \t a ') || ' 　'"


@query("str5_collapse_blanks", _sql(S.strip("regexp_replace(text, '[ \\t]{2,}', ' ', 'g')"), f"(SELECT doc_id, {_WIDE} AS text FROM documents)"))
def str5(spark, folder):
    rows = Tables(spark, folder).documents.select("doc_id", F.expr(_WIDE).alias("text"))
    return rows.select("doc_id", T.collapse_blanks(F.col("text")).alias("out_text"))


# the dirty text's compatibility characters have single-character equivalents
_NFKC = "translate(text, '：－１２　', ':-12 ')"


@query("str6_normalize", _sql(S.strip("regexp_replace(" + _TIGHT.format(_ZWSQL.format(f"translate({_NFKC}, '{_CONF[0]}', '{_CONF[1]}')")) + ", '[ \\t]{2,}', ' ', 'g')")))
def str6(spark, folder):
    return _dirty(Tables(spark, folder)).select("doc_id", T.normalize_text(F.col("text")).alias("out_text"))


# redaction: blanks with known outcome from the pieces' lengths
_REDACT = [
    C.Piece("'연락 '"), C.Piece(C.phone("'-'")), C.Piece("', 주민 '"), C.Piece(C.resident("'-'")), C.Piece("' 및 '"),
    C.Piece(C.card("' '")), C.Piece("' 메일 '"), C.Piece(C.EMAIL), C.Piece("' 링크 '"), C.Piece(C.HOST), C.Piece("' 번호 '"),
    C.Piece("CAST(1000 + k AS STRING)"), C.Piece("' 중 '"), C.Piece("CAST(k % 1000 AS STRING)"), C.Piece("' 대 '"), C.Piece("'김민수'"), C.Piece("' 끝'"),
]
_X = "regexp_replace({}, '[\\p{{L}}\\p{{N}}]', 'X', 'g')"
_HIDDEN = {1, 3, 5, 7, 9, 11, 15}


@query("str7_redact", "SELECT k AS doc_id, " + " || ".join(
    _X.format(p.sql) if i in _HIDDEN else p.sql for i, p in enumerate(_REDACT)) + " AS out_text FROM (SELECT o_orderkey AS k FROM orders)")
def str7(spark, folder):
    return C.sentences(Tables(spark, folder).orders, _REDACT).select("doc_id", T.redact(F.col("text")).alias("out_text"))


@query("str8_context_slice", """
    SELECT doc_id, substr(text, CAST(greatest(s - 120, 0) + 1 AS BIGINT), CAST(least(e + 120, length(text)) - greatest(s - 120, 0) AS BIGINT)) AS out_text
    FROM (SELECT doc_id, text, (doc_id * 37) % (length(text) + 1) AS s, (doc_id * 37) % (length(text) + 1) + 9 AS e FROM documents)""")
def str8(spark, folder):
    rows = Tables(spark, folder).documents.select("doc_id", "text", ((F.col("doc_id") * 37) % (F.length("text") + 1)).cast("int").alias("s"))
    return rows.select("doc_id", T.context_slice(F.col("text"), F.col("s"), F.col("s") + 9).alias("out_text"))


def _pieces_query(name: str, source: str, sql_list: str, fn, keys=("conv_id", "turn")):
    cols = ", ".join(keys)
    sql = (f"SELECT {cols}, CAST(i - 1 AS BIGINT) AS seq, p[i] AS piece FROM (SELECT {cols}, {sql_list} AS p, unnest(range(1, len(p) + 1)) AS i FROM {source})")

    @query(name, sql)
    def run(spark, folder):
        rows = getattr(Tables(spark, folder), source)
        return rows.select(*keys, F.posexplode(fn(F.col("text"))).alias("seq", "piece")).withColumn("seq", F.col("seq").cast("long"))

    return run


def _stripped(lst: str) -> str:
    return f"list_filter(list_transform({lst}, lambda x: {S.strip('x')}), lambda x: x <> '')"


def _or_whole(lst: str) -> str:
    return f"(CASE WHEN len({lst}) > 0 THEN {lst} ELSE [text] END)"


# no look-behind in RE2: a sentence is everything up to terminators followed by whitespace
_A = _or_whole(_stripped(f"string_split(regexp_replace(text, '([.!?])[{S.SPACES}]+', '\\1' || chr(1), 'g'), chr(1))"))
_pieces_query("str9_sentences", "conversations", _A, T.sentences)
_pieces_query("str9_sentences_documents", "documents", _A, T.sentences, ("doc_id",))
_B = _or_whole(_stripped("regexp_extract_all(text, '[^.!?]*[.!?]+')"))
_pieces_query("str10_terminated_sentences", "conversations", _B, T.terminated_sentences)
_pieces_query("str11_bare_sentences", "conversations", _stripped("regexp_split_to_array(text, '[.!?]+')"), T.bare_sentences)
_BATCHED = """SELECT doc_id, CAST(i - 1 AS BIGINT) AS seq, list_aggregate(r[(i - 1) * 10 + 1:(i - 1) * 10 + 10], 'string_agg', '') AS piece
    FROM (SELECT doc_id, r, unnest(range(1, CAST(ceil(len(r) / 10.0) AS BIGINT) + 1)) AS i
          FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]*[.!?]+') AS r FROM documents))"""


@query("trx10_sentence_batches", _BATCHED)
def trx10(spark, folder):
    rows = Tables(spark, folder).documents.select("doc_id", F.posexplode(T.sentence_batches(F.col("text"))).alias("seq", "piece"))
    return rows.withColumn("seq", F.col("seq").cast("long"))


_PARTICLE = [C.Piece("'고객을를 '"), C.Piece(C.pick("k", "사람이가 ", "물은는 ", "차과와 ", "")), C.Piece("CAST(k AS STRING)"), C.Piece(C.pick("k", " 이것이가", "을를을를", ""))]
_TEXT = C.text_sql(_PARTICLE)


@query("str12_double_particles", f"""
    WITH t AS (SELECT o_orderkey AS k FROM orders), s AS (SELECT k, {_TEXT} AS t0 FROM t),
    steps AS (SELECT k, 0 AS n, t0 AS cur, '을를' AS d, '를' AS r FROM s
      UNION ALL SELECT k, 1, replace(t0, '을를', '를'), '이가', '가' FROM s
      UNION ALL SELECT k, 2, replace(replace(t0, '을를', '를'), '이가', '가'), '은는', '는' FROM s
      UNION ALL SELECT k, 3, replace(replace(replace(t0, '을를', '를'), '이가', '가'), '은는', '는'), '과와', '와' FROM s)
    SELECT k AS doc_id, d AS original, r AS corrected,
           CAST(list_sum(list_transform(string_split(cur, d)[1:i], lambda x: length(x))) + (i - 1) * length(d) AS BIGINT) AS at_char
    FROM (SELECT *, unnest(range(1, len(string_split(cur, d)))) AS i FROM steps)""")
def str12(spark, folder):
    rows = C.sentences(Tables(spark, folder).orders, _PARTICLE)
    log = rows.select("doc_id", F.explode(T.double_particle_log(F.col("text"))).alias("c"))
    return log.select("doc_id", "c.original", "c.corrected", F.col("c.position").cast("long").alias("at_char"))


_SPACED = "'그는 ' || CAST(k AS STRING) || '번 갔다 . 나는   ' || '안 갔다.그래서\n끝 '"


@query("str13_tidy_spacing", "SELECT o_orderkey AS doc_id, '그는 ' || CAST(o_orderkey AS STRING) || '번 갔다. 나는 안 갔다. 그래서 끝' AS out_text FROM orders")
def str13(spark, folder):
    rows = Tables(spark, folder).orders.select(F.col("o_orderkey").alias("k")).select("k", F.expr(_SPACED).alias("text"))
    return rows.select(F.col("k").alias("doc_id"), T.tidy_spacing(F.col("text")).alias("out_text"))


@query("str14_break_sentences", "SELECT o_orderkey AS doc_id, '네.\n그는 ' || CAST(o_orderkey AS STRING) || '번 갔다!\n나는? No. 안 갔다.\n끝' AS out_text FROM orders".replace("No. 안", "No.\n안"))
def str14(spark, folder):
    rows = Tables(spark, folder).orders.select(F.col("o_orderkey").alias("k")).select(
        "k", F.expr("'네.  그는 ' || CAST(k AS STRING) || '번 갔다!나는? No. 안 갔다. 끝'").alias("text"))
    return rows.select(F.col("k").alias("doc_id"), T.break_sentences(F.col("text")).alias("out_text"))


_LINES = _stripped("string_split(text, chr(10))")


@query("str15_join_pieces", f"""
    SELECT doc_id, {S.squeeze("list_aggregate(list_transform(p, lambda x: CASE WHEN x = '' OR regexp_matches(x, '[.!?]$') THEN x ELSE x || '.' END), 'string_agg', ' ')")} AS out_text
    FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {S.strip('x')}) AS p FROM documents)""")
def str15(spark, folder):
    return Tables(spark, folder).documents.select("doc_id", T.join_pieces(F.split("text", "\n", -1)).alias("out_text"))


_MARKED = "replace(replace(text, ', ', ' , '), '. ', ' ! ? . ')"


@query("str16_tidy_punctuation", f"""SELECT doc_id, replace(replace(replace(replace({S.squeeze(_MARKED)}, ' .', '.'), ' ,', ','), ' ?', '?'), ' !', '!') AS out_text FROM documents""")
def str16(spark, folder):
    rows = Tables(spark, folder).documents.select("doc_id", F.expr(_MARKED).alias("text"))
    return rows.select("doc_id", T.tidy_punctuation(F.col("text")).alias("out_text"))


@query("str17_minute_clock", "SELECT event_id, printf('[%02d:%02d]', CAST(floor(s / 60) AS BIGINT), CAST(floor(s % 60) AS BIGINT)) AS clock FROM (SELECT event_id, value * 97.0 AS s FROM events)")
def str17(spark, folder):
    return Tables(spark, folder).events.select("event_id", clocks.minute_clock(F.col("value") * 97.0).alias("clock"))


@query("str18_subtitle_clock", """SELECT event_id, printf('%02d:%02d:%02d,%03d', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s % 3600) / 60) AS BIGINT),
    CAST(floor(s % 60) AS BIGINT), CAST(floor((s % 1) * 1000) AS BIGINT)) AS clock FROM (SELECT event_id, value * 97.0 AS s FROM events)""")
def str18(spark, folder):
    return Tables(spark, folder).events.select("event_id", clocks.subtitle_clock(F.col("value") * 97.0).alias("clock"))


@query("str19_counts", f"""SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(list_filter(regexp_split_to_array(text, '[{S.SPACES}]+'), lambda w: w <> '')) AS BIGINT) AS words,
    CAST(len(string_split(text, chr(10))) - CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS BIGINT) AS lines FROM documents""")
def str19(spark, folder):
    t = F.col("text")
    return Tables(spark, folder).documents.select(
        "doc_id", F.length(t).cast("long").alias("chars"), T.word_count(t).cast("long").alias("words"), T.line_count(t).cast("long").alias("lines"))


@query("str20_preservation", f"SELECT doc_id, round((1 - abs(length({S.squeeze('text')}) - length(text)) / CAST(length(text) AS DOUBLE)) * 100, 6) AS rate FROM documents")
def str20(spark, folder):
    rows = Tables(spark, folder).documents.select("doc_id", "text", T.squeeze(F.col("text")).alias("after"))
    return rows.select("doc_id", F.round(T.preservation_rate(F.col("text"), F.col("after")), 6).alias("rate"))


@query("str21_renderings", "SELECT event_id, CAST(event_id AS STRING) || '-' || CAST(event_id + user_id AS STRING) AS place, CAST(event_id % 101 AS STRING) || '%' AS share FROM events")
def str21(spark, folder):
    return Tables(spark, folder).events.select(
        "event_id", T.position_label(F.col("event_id"), F.col("event_id") + F.col("user_id")).alias("place"),
        T.percent_label(F.col("event_id") % 101 / 100.0).alias("share"))


@query("str23_estimated_length", "SELECT event_id, CAST(floor((CAST(value * 1000 AS BIGINT) / 1000.0::DOUBLE) * (200.0::DOUBLE / 60.0::DOUBLE)) AS BIGINT) AS chars FROM events")
def str23(spark, folder):
    return Tables(spark, folder).events.select("event_id", T.estimated_length(F.round(F.col("value") * 1000).cast("long")).alias("chars"))


@query("str24_preview", "SELECT conv_id, turn, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS short, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS longer FROM conversations")
def str24(spark, folder):
    t = F.col("text")
    return Tables(spark, folder).conversations.select("conv_id", "turn", T.preview(t).alias("short"), T.preview(t, 200).alias("longer"))


@query("str25_mark_terms", "SELECT doc_id, replace(replace(text, 'the', '**🟨 [the]**'), 'an', '**🟨 [an]**') AS out_text FROM documents")
def str25(spark, folder):
    terms = F.array(F.lit("the"), F.lit("an"))
    return Tables(spark, folder).documents.select("doc_id", T.mark_terms(F.col("text"), terms).alias("out_text"))


@query("find1_words_with_offsets", S.matches("text", "[A-Z][a-z]{3,}", "doc_id", "documents"))
def find1(spark, folder):
    rows = Tables(spark, folder).documents.select("doc_id", F.explode(find_all(F.col("text"), "[A-Z][a-z]{3,}")).alias("m"))
    return rows.select("doc_id", F.col("m.start").cast("long").alias("span_start"), F.col("m.end").cast("long").alias("span_end"), F.col("m.text").alias("span_text"))


@query("trx3_even_times", f"""
    SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS seq, p[i] AS piece, round((i - 1) * (60.0 / len(p)), 6) AS start_time, round(i * (60.0 / len(p)), 6) AS end_time
    FROM (SELECT conv_id, turn, {_stripped("regexp_split_to_array(text, '[.!?]+')")} AS p, unnest(range(1, len(p) + 1)) AS i FROM conversations)""")
def trx3(spark, folder):
    rows = Tables(spark, folder).conversations.select("conv_id", "turn", F.posexplode(transcripts.share_evenly(F.col("text"))).alias("seq", "s"))
    return rows.select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), F.col("s.text").alias("piece"),
                       F.round("s.start_time", 6).alias("start_time"), F.round("s.end_time", 6).alias("end_time"))


@query("lab16_text_gates", "SELECT doc_id, length(text) > 500 AS batched, length(text) > 50 AS analysed FROM documents")
def lab16(spark, folder):
    return Tables(spark, folder).documents.select("doc_id", corrections.processing_gates(F.col("text")).alias("g")).select("doc_id", "g.batched", "g.analysed")
