"""Readers and writers, exercised by writing table data and reading it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import lexicon as L
from ..operators import masking as M, summaries as A
from ..session import shared_folder
from ..sources import documents as Docs, responses, tokens as Tok, transcripts as Tr, vault as V
from .masking_queries import _PIECES, _SRC, _masked_sql, docs_with_spans
from .registry import Tables, query
from .summary_queries import _ROWS, _SUMMARY, span_rows
from .token_queries import _TAGS, sentences


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_BODY = " || ".join(f"s{i}" for i in range(len(_PIECES)))
_MASKED = _masked_sql(L.DEFAULT_RULES)


@query("src1_stage_texts", f"SELECT k AS doc_id, 'original' AS stage, {_BODY} AS text FROM {_SRC} UNION ALL SELECT k, 'masked', {_MASKED} FROM {_SRC}")
def src1(spark, folder):
    path = _fresh(spark, "stages")
    Docs.write_stages(M.mask(docs_with_spans(spark, folder)), path, original="text", masked="masked_text")
    return Docs.read_stage(spark, path).select("doc_id", F.col("stage").cast("string").alias("stage"), "text")


@query("src2_src3_vault", f"SELECT 's' || CAST(k AS STRING) AS session_id, {_BODY} AS original_text, {_MASKED} AS masked_text, CAST(4 AS BIGINT) AS total_masked, '[이름]' AS name_rule FROM {_SRC}")
def src2(spark, folder):
    masked = M.mask(docs_with_spans(spark, folder))
    path = _fresh(spark, "vault")
    V.write_vault(V.vault_rows(masked, F.concat(F.lit("s"), F.col("doc_id").cast("string")), F.lit("2025-01-01T00:00:00")), path, "json")
    # JSON lines: one document per line
    stored = spark.read.schema(V.VAULT).json(path)
    return stored.select("session_id", "original_text", "masked_text", F.col("stats.total_masked").cast("long").alias("total_masked"), F.element_at("masking_rules.label_rules", "이름").alias("name_rule"))


@query("src4_transcript_meta", "SELECT conv_id, turn AS pos, text, turn * 2.5::DOUBLE AS start_time FROM conversations")
def src4(spark, folder):
    c = Tables(spark, folder).conversations
    one = F.struct("text", (F.col("turn") * 2.5).alias("start_time"), (F.col("turn") * 2.5 + 2).alias("end_time"))
    meta = c.select(F.concat_ws("/", "conv_id", "turn").alias("original_audio"), F.lit("20250101_000000").alias("timestamp"), F.lit(1.5).alias("processing_time"), F.array(one).alias("sentences"))
    path = _fresh(spark, "meta")
    Tr.write_json(meta, path)
    rows = Tr.transcript_sentences(spark.read.schema(Tr.TRANSCRIPT).json(path), "original_audio")
    part = F.split("original_audio", "/")
    return rows.select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("pos"), "text", "start_time")


@query("src5_run_results", f"SELECT 'r' || CAST(k AS STRING) AS session_id, k / 8.0::DOUBLE AS before_rms, {_MASKED} AS masked_text, CAST(4 AS BIGINT) AS entities FROM {_SRC}")
def src5(spark, folder):
    m = M.mask(docs_with_spans(spark, folder))
    side = F.struct((F.col("doc_id") / 8.0).cast("string").alias("rms"), F.lit("n/a").alias("rms_db"))
    runs = m.select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("session_id"), F.struct(side.alias("before"), side.alias("after")).alias("audio_enhancement"),
                    F.struct(F.size("spans").alias("total_entities"), F.col("spans").alias("entities")).alias("pii_detection"), F.struct("masked_text").alias("masking"))
    path = _fresh(spark, "runs")
    Tr.write_json(runs, path)
    back = spark.read.schema(Tr.RUN).json(path)
    return back.select("session_id", F.col("audio_enhancement.before.rms").try_cast("double").alias("before_rms"), "masking.masked_text", F.size("pii_detection.entities").cast("long").alias("entities"))


@query("src6_bio_files", f"WITH {_TAGS} SELECT string_agg(w, ' ' ORDER BY i) AS tokens, string_agg(g, ' ' ORDER BY i) AS tags FROM tag GROUP BY doc_id")
def src6(spark, folder):
    path = _fresh(spark, "bio")
    rows = sentences(spark, folder).where(F.size("tokens") > 0)
    Tok.bio_lines(rows, "tokens", "gold").write.option("compression", "gzip").text(path)
    back = Tok.read_bio(spark, path)
    return back.select(F.array_join("tokens", " ").alias("tokens"), F.array_join("tags", " ").alias("tags"))


_SHAPES = """CASE k % 4 WHEN 0 THEN '{"labels":["B-A","O","B-A","I-' || CAST(k AS STRING) || '"]}' WHEN 1 THEN '{"O":0,"Z":1,"B-' || CAST(k AS STRING) || '":2}'
    WHEN 2 THEN '["x","' || CAST(k AS STRING) || '"]' ELSE 'O' || chr(10) || ' B-q ' || chr(10) || chr(10) || CAST(k AS STRING) END"""


@query("src7_label_schemas", """SELECT k, CASE k % 4 WHEN 0 THEN 'B-A,O,I-' || CAST(k AS STRING) WHEN 1 THEN 'O,Z,B-' || CAST(k AS STRING) WHEN 2 THEN 'O,x,' || CAST(k AS STRING) ELSE 'O,B-q,' || CAST(k AS STRING) END AS labels FROM (SELECT o_orderkey AS k FROM orders)""")
def src7(spark, folder):
    rows = Tables(spark, folder).orders.select(F.col("o_orderkey").alias("k")).select("k", F.expr(_SHAPES).alias("content"))
    return rows.select("k", F.array_join(Tok.schema_labels(F.col("content")), ",").alias("labels"))


@query("src11_label_summary_csv", f"WITH src AS (SELECT label, t, k * 10 + ord AS o FROM ({_ROWS})), {_SUMMARY}")
def src11(spark, folder):
    path = _fresh(spark, "summary")
    Docs.write_label_summary(A.summarize_by_label(span_rows(spark, folder)), path)
    return spark.read.option("header", True).schema("label string, count long, examples string").csv(path)


@query("src12_rule_presets", f"SELECT 'standard' AS name, 'advanced' AS mode, label, mask FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, b in L.DEFAULT_RULES['label_rules'].items())}) v(label, mask) JOIN (SELECT DISTINCT lab FROM (SELECT ['이름','번호','주소','계정','금융','URL','신원','소속'][o_orderkey % 8 + 1] AS lab FROM orders)) ON lab = label")
def src12(spark, folder):
    path = _fresh(spark, "presets")
    V.write_preset(spark, "standard", L.DEFAULT_RULES, path)
    used = Tables(spark, folder).orders.select(F.get(F.array(*[F.lit(x) for x in L.DEFAULT_RULES["label_rules"]]), (F.col("o_orderkey") % 8).cast("int")).alias("label")).distinct()
    rules = V.read_presets(spark, path).select("name", "rules.mode", F.explode("rules.label_rules").alias("label", "mask"))
    return rules.join(used, "label").select("name", "mode", "label", "mask")


@query("src13_input_inventory")
def src13(spark, folder):
    return Docs.processing_estimate(Docs.input_inventory(spark, folder), parallel=True)


@query("src13_rows_of_listed_files", "SELECT 'parquet' AS type, count(*) AS listed_rows, sum(length(text)) AS listed_chars FROM documents")
def src13_rows(spark, folder):
    files = Docs.input_inventory(spark, f"{folder}/documents.parquet").where("bytes > 0").select("name", "type")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return files.join(rows, "name").groupBy("type").agg(F.sum("n").alias("listed_rows"), F.sum("chars").alias("listed_chars"))


@query("src14_isolated_failures", """SELECT k, CASE WHEN k % 3 = 0 THEN '가' END AS text, CASE k % 3 WHEN 1 THEN 'API Error Code: None' WHEN 2 THEN 'API Error Code: 5' END AS error FROM (SELECT o_orderkey AS k FROM orders)""")
def src14(spark, folder):
    k = F.col("k")
    rows = Tables(spark, folder).orders.select(F.col("o_orderkey").alias("k")).select("k", responses.parse_asr(
        F.when(k % 3 == 0, '{"result":0,"return_object":{"text":"가"}}').when(k % 3 == 1, "broken {").otherwise('{"result":5}')).alias("r"))
    return rows.select("k", F.nullif("r.text", F.lit("")).alias("text"), "r.error")


@query("src15_domain_lists", "SELECT k, k % 3 <> 0 AS allowed FROM (SELECT o_orderkey AS k FROM orders)")
def src15(spark, folder):
    from ..functions.checks import email_allowed
    k = F.col("k")
    mail = F.concat(F.lit("a@"), F.when(k % 3 == 0, "mail.BAD.kr").when(k % 3 == 1, "x.good.kr").otherwise("good.kr"))
    return Tables(spark, folder).orders.select(F.col("o_orderkey").alias("k")).select("k", email_allowed(mail, allow=["good.kr", "bad.kr"], deny=["bad.kr"]).alias("allowed"))


# every seventh answer is cut off, every eleventh is blank, every thirteenth has a list where a number belongs
_ANSWER = """CASE WHEN k % 7 = 0 THEN '{"result":0,"return_object":{"text":"가' WHEN k % 11 = 0 THEN ' ' WHEN k % 13 = 0 THEN '{"result":[1],"k":' || CAST(k AS STRING) || '}'
    ELSE '{"result":0,"return_object":{"text":"t' || CAST(k AS STRING) || '"}}' END"""


@query("src14_quarantine", f"""SELECT k, CASE WHEN k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 THEN 't' || CAST(k AS STRING) END AS text,
    CASE WHEN k % 7 = 0 OR k % 13 = 0 AND k % 11 <> 0 THEN 'broken' WHEN k % 11 = 0 THEN 'missing' END AS problem,
    CASE WHEN k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0 THEN {_ANSWER} END AS corrupt FROM (SELECT o_orderkey AS k FROM orders)""")
def src14_quarantine(spark, folder):
    rows = Tables(spark, folder).orders.select(F.col("o_orderkey").alias("k")).select("k", F.expr(_ANSWER).alias("raw"))
    good, bad = responses.quarantined(responses.parsed_or_raw(rows, "raw", responses.ASR_RESPONSE))
    kept = good.select("k", F.col("parsed.return_object.text").alias("text"), F.lit(None).cast("string").alias("problem"), F.lit(None).cast("string").alias("corrupt"))
    return kept.unionByName(bad.select("k", F.lit(None).cast("string").alias("text"), "problem", "corrupt"))
