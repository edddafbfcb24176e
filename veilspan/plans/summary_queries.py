"""Summaries of spans, runs and chunks; sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as L
from ..operators import detect as D, summaries as A
from .detection_queries import _bank_documents_sql
from .masking_queries import _PIECES, _SRC, docs_with_spans
from .overlap_queries import _OUT, SPANS_SQL, spans_of_orders
from .registry import Tables, query

_SPAN_IDX = [i for i, p in enumerate(_PIECES) if p.label]
_ROWS = " UNION ALL ".join(f"SELECT k, {n} AS ord, s{i} AS t, '{_PIECES[i].label}' AS label FROM {_SRC}" for n, i in enumerate(_SPAN_IDX))


def span_rows(spark, folder):
    return D.explode_spans(docs_with_spans(spark, folder), "spans", "doc_id")


_SUMMARY = """firsts AS (SELECT label, t, min(o) AS o, count(*) AS n FROM src GROUP BY label, t), ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o) AS r FROM firsts)
    SELECT label, CAST(sum(n) AS BIGINT) AS count, string_agg(t, ' | ' ORDER BY r) FILTER (r <= 5) AS examples FROM ranked GROUP BY label"""


@query("agg1_label_summary", f"WITH src AS (SELECT label, t, k * 10 + ord AS o FROM ({_ROWS})), {_SUMMARY}")
def agg1(spark, folder):
    return A.summarize_by_label(span_rows(spark, folder))


@query("agg1_label_summary_documents", f"WITH src AS (SELECT label, span_text AS t, doc_id * 1000000 + span_start AS o FROM ({_bank_documents_sql()})), {_SUMMARY}")
def agg1_documents(spark, folder):
    docs = D.bank_spans(Tables(spark, folder).documents.select("doc_id", "text"))
    return A.summarize_by_label(D.explode_spans(docs, "spans", "doc_id"), ("doc_id", "start"))


@query("agg2_totals", f"WITH {SPANS_SQL} SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM base UNION ALL SELECT 'source', src, count(*) FROM base GROUP BY src UNION ALL SELECT 'label', lab, count(*) FROM base GROUP BY lab")
def agg2(spark, folder):
    return A.totals(D.explode_spans(spans_of_orders(spark, folder), "spans", "doc_id"))


@query("agg3_by_category", f"""WITH {SPANS_SQL} SELECT doc_id, lab || coalesce(' (' || sub || ')', '') AS category, count(*) AS n,
    string_agg(t || ' ' || CAST(s AS VARCHAR) || '-' || CAST(e AS VARCHAR) || ' ' || src || ' ' || CAST(CAST(round(score * 100) AS BIGINT) AS VARCHAR) || '%', ';' ORDER BY i) AS items FROM base GROUP BY ALL""")
def agg3(spark, folder):
    rows = spans_of_orders(spark, folder).select("doc_id", A.by_category(F.col("spans")).alias("cats")).select("doc_id", F.explode_outer("cats").alias("c")).where("c IS NOT NULL")
    items = F.array_join(F.transform("c.items", lambda x: F.concat_ws(" ", x["text"], x["position"], x["source"], x["confidence"])), ";")
    return rows.select("doc_id", "c.category", F.size("c.items").cast("long").alias("n"), items.alias("items"))


@query("agg4_source_share", f"WITH {SPANS_SQL} SELECT src AS source, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM base GROUP BY src")
def agg4(spark, folder):
    out = A.source_share(D.explode_spans(spans_of_orders(spark, folder), "spans", "doc_id"))
    return out.select("source", "n", F.round("share", 6).alias("share"))


@query("agg5_label_histogram", f"WITH {SPANS_SQL} SELECT lab AS label, count(*) AS n FROM base GROUP BY lab")
def agg5(spark, folder):
    return A.label_histogram(D.explode_spans(spans_of_orders(spark, folder), "spans", "doc_id"))


# --- run history: one run per order ------------------------------------------------------------

_RUN = "SELECT o_orderkey AS run, o_orderkey % 6 <> 5 AS success, CASE WHEN o_orderkey % 50 = 0 THEN 0.0 ELSE CAST(o_totalprice AS DOUBLE) END AS processing_time, CAST(o_custkey AS DOUBLE) AS audio_duration, o_orderkey % 977 AS transcript_length, o_orderdate AS ts FROM orders"


def runs(spark, folder):
    k = F.col("o_orderkey")
    return Tables(spark, folder).orders.select(
        k.alias("run"), (k % 6 != 5).alias("success"), F.when(k % 50 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("processing_time"),
        F.col("o_custkey").cast("double").alias("audio_duration"), (k % 977).alias("transcript_length"), F.col("o_orderdate").alias("ts"))


@query("agg7_run_history", f"""SELECT count(*) AS files, round(count(*) FILTER (success) * 100.0::DOUBLE / count(*), 6) AS success_percent, round(sum(processing_time), 2) AS total_time, round(sum(audio_duration), 2) AS total_audio,
    CAST(sum(transcript_length) AS BIGINT) AS total_chars, round(sum(transcript_length) / count(*)::DOUBLE, 6) AS average_chars, round(sum(audio_duration) / sum(processing_time), 8) AS speed, round(sum(audio_duration) / sum(processing_time) * 3600, 4) AS throughput FROM ({_RUN})""")
def agg7(spark, folder):
    r = A.run_history(runs(spark, folder))
    return r.select("files", F.round("success_percent", 6).alias("success_percent"), F.round("total_time", 2).alias("total_time"), F.round("total_audio", 2).alias("total_audio"), "total_chars",
                    F.round("average_chars", 6).alias("average_chars"), F.round("speed", 8).alias("speed"), F.round("throughput", 4).alias("throughput"))


@query("agg8_run_rows", f"SELECT run, success, processing_time, audio_duration, transcript_length, round(CASE WHEN processing_time > 0 THEN audio_duration / processing_time ELSE 0.0 END, 9) AS speed FROM ({_RUN})")
def agg8(spark, folder):
    return A.run_rows(runs(spark, folder), "run").withColumn("speed", F.round("speed", 9))


_RES = "SELECT conv_id, turn AS chunk_index, (conv_id + turn) % 5 <> 4 AS success, text, (conv_id * 7 + turn) % 3 AS retry_count, ((conv_id * 31 + turn * 17) % 97) / 8.0::DOUBLE - 1 AS duration, conv_id % 4 AS mode FROM conversations"


def chunk_rows(spark, folder):
    c, t = F.col("conv_id"), F.col("turn")
    return Tables(spark, folder).conversations.select(
        "conv_id", t.alias("chunk_index"), ((c + t) % 5 != 4).alias("success"), "text", ((c * 7 + t) % 3).alias("retry_count"),
        (((c * 31 + t * 17) % 97) / 8.0 - 1).alias("duration"), (c % 4).cast("string").alias("mode"))


@query("agg9_chunk_stats", f"""SELECT conv_id, count(*) AS total_chunks, count(*) FILTER (success) AS success_chunks, count(*) FILTER (NOT success) AS failed_chunks, CAST(sum(retry_count) AS BIGINT) AS retry_count,
    round(sum(duration), 6) AS total_duration, round(count(*) FILTER (success) / count(*)::DOUBLE, 6) AS success_rate FROM ({_RES}) GROUP BY conv_id""")
def agg9(spark, folder):
    s = A.chunk_stats(chunk_rows(spark, folder), "conv_id").drop("mostly_ok", "any_ok")
    return s.withColumns({"success_rate": F.round("success_rate", 6), "total_duration": F.round("total_duration", 6)})


@query("agg9_chunk_details", f"SELECT conv_id, chunk_index, success, CAST(CASE WHEN success THEN length(text) ELSE 0 END AS BIGINT) AS text_length, retry_count FROM ({_RES})")
def agg9_details(spark, folder):
    return A.chunk_details(chunk_rows(spark, folder), "conv_id").withColumn("text_length", F.col("text_length").cast("long"))


_MODES = f"SELECT CAST(mode AS VARCHAR) AS mode, count(*) FILTER (success OR mode = 1) AS success_count, count(*) AS total_chunks, sum(duration) AS total_time FROM ({_RES}) GROUP BY mode"


def mode_rows(spark, folder):
    return chunk_rows(spark, folder).withColumn("success", F.col("success") | (F.col("mode") == "1"))


@query("agg10_best_mode", f"SELECT arg_min(mode, total_time) AS mode, round(min(total_time), 6) AS total_time FROM ({_MODES}) WHERE success_count = total_chunks")
def agg10(spark, folder):
    return A.best_mode(A.mode_table(mode_rows(spark, folder))).withColumn("total_time", F.round("total_time", 6))


@query("agg11_mode_table", f"SELECT mode, success_count, total_chunks, total_chunks - success_count AS fail_count, round(total_time, 6) AS total_time, round(total_time / total_chunks, 6) AS time_per_chunk, round(success_count * 100.0::DOUBLE / total_chunks, 6) AS success_rate FROM ({_MODES})")
def agg11(spark, folder):
    t = A.mode_table(mode_rows(spark, folder))
    return t.withColumns({c: F.round(c, 6) for c in ("total_time", "time_per_chunk", "success_rate")})


@query("agg12_remaining_time", f"""SELECT conv_id, chunk_index, CAST(floor((n - r) * (spent / r)) AS BIGINT) AS eta_seconds FROM (
    SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY conv_id) AS n, sum(greatest(duration, 0)) OVER w AS spent FROM ({_RES}) WINDOW w AS (PARTITION BY conv_id ORDER BY chunk_index))""")
def agg12(spark, folder):
    return A.remaining_time(chunk_rows(spark, folder), ["conv_id"]).select("conv_id", "chunk_index", "eta_seconds")


@query("agg16_time_estimates", "SELECT conv_id, count(*) * 3.5::DOUBLE AS seconds, count(*) * 1.5::DOUBLE AS saved FROM conversations GROUP BY conv_id")
def agg16(spark, folder):
    c = Tables(spark, folder).conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    return c.select("conv_id", A.time_estimates(F.col("n")).alias("seconds"), A.parallel_saving(F.col("n") * 1.5).alias("saved"))


# --- sorts, limits, sets -------------------------------------------------------------------------


@query("sort1_mixed_directions", f"WITH {SPANS_SQL} SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY s, score DESC, s - e, i) AS place FROM base")
def sort1(spark, folder):
    from ..functions.arrays import sort_stable
    ordered = sort_stable(F.col("spans"), lambda s: [s["start"], -s["score"], s["start"] - s["end"]])
    rows = spans_of_orders(spark, folder).withColumn("o", ordered).select("doc_id", F.posexplode_outer("o").alias("p", "s")).where("s IS NOT NULL")
    return rows.select("doc_id", F.col("s.text").cast("long").alias("i"), (F.col("p") + 1).cast("long").alias("place"))


@query("sort2_top_of_counter", f"WITH {SPANS_SQL}, c AS (SELECT doc_id, lab, count(*) AS n, min(i) AS f FROM base GROUP BY ALL) SELECT doc_id, arg_max(lab, n * 100 - f) AS label, max(n) AS n FROM c GROUP BY doc_id")
def sort2(spark, folder):
    rows = D.explode_spans(spans_of_orders(spark, folder), "spans", "doc_id")
    counts = rows.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.min("ord").alias("f"))
    best = counts.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("f")).alias("f"), "label")).alias("b"))
    return best.select("doc_id", "b.label", "b.n")


@query("sort3_first_k", f"WITH {SPANS_SQL} SELECT {_OUT} FROM base WHERE i < 3")
def sort3(spark, folder):
    from .detection_queries import flat
    return flat(spans_of_orders(spark, folder).withColumn("spans", F.slice("spans", 1, 3)), "spans", "doc_id")


@query("sort5_latest_runs", f"SELECT run, success FROM ({_RUN}) ORDER BY ts DESC, run DESC LIMIT 5")
def sort5(spark, folder):
    newest = runs(spark, folder).withColumn("at", F.struct("ts", "run"))
    return A.latest(newest, "at").select("run", "success")


@query("set1_union_all", f"WITH {SPANS_SQL} SELECT doc_id, t AS span_text, src AS source, CASE WHEN src = 'ner' THEN score END AS score FROM base")
def set1(spark, folder):
    rows = D.explode_spans(spans_of_orders(spark, folder), "spans", "doc_id").withColumnRenamed("text", "span_text")
    a = rows.where("source = 'ner'").select("doc_id", "span_text", "source", "score")
    b = rows.where("source = 'regex'").select("doc_id", "span_text", "source")
    return a.unionByName(b, allowMissingColumns=True)


@query("set2_except", "SELECT DISTINCT event_type AS tag FROM events EXCEPT SELECT 'click'")
def set2(spark, folder):
    from ..operators.tokens import missing_labels
    data = Tables(spark, folder).events.select(F.col("event_type").alias("tag"))
    return missing_labels(data, spark.createDataFrame([("click",)], "tag string"))


@query("set3_distinct_first_seen", f"SELECT t AS text, min(k * 10 + ord) AS first_seen FROM ({_ROWS}) GROUP BY t")
def set3(spark, folder):
    return span_rows(spark, folder).groupBy("text").agg(F.min(F.col("doc_id") * 10 + F.col("ord")).alias("first_seen"))


#: All standard labels, and four that are none.
_ANY_LABEL = [*L.LABELS, "기타", "이름 ", "", "url"]


@query("set4_standard_labels", f"WITH given AS (SELECT o_orderkey AS run, ({_ANY_LABEL})[o_orderkey % {len(_ANY_LABEL)} + 1] AS label FROM orders) SELECT run, label, label IN {tuple(L.LABELS)} AS standard FROM given")
def set4(spark, folder):
    k = F.col("o_orderkey")
    label = F.element_at(F.array(*[F.lit(x) for x in _ANY_LABEL]), (k % len(_ANY_LABEL) + 1).cast("int"))
    rows = Tables(spark, folder).orders.select(k.alias("run"), label.alias("label"))
    return rows.withColumn("standard", F.col("label").isin(L.LABELS))
