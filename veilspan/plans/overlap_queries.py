"""Overlap resolution over span sets derived from order keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.arrays import make_span
from ..operators import overlap as O
from .detection_queries import flat
from .registry import Tables, query

_LABELS = L.LABELS
_SUBTYPES = ["계좌번호", "이메일", "전화번호", "IP"]


def spans_of_orders(spark, folder):
    """Up to 12 spans per order at scattered positions, as ``(doc_id, spans)``."""
    k = F.col("k")

    def mix(i, a, b, m):
        return (k * a + i * b) % 1000003 % m

    def span(i):
        start = mix(i, 7919, 104729, 21).cast("int")
        return make_span(
            start=start, end=start + 1 + mix(i, 7907, 15485863, 8).cast("int"), text=i.cast("string"),
            label=F.get(F.array(*[F.lit(x) for x in _LABELS]), mix(i, 6997, 32452843, 12).cast("int")),
            subtype=F.when(i % 3 == 0, F.get(F.array(*[F.lit(x) for x in _SUBTYPES]), (i % 4).cast("int"))),
            score=mix(i, 7793, 49979687, 101) / 100.0, source=F.when(mix(i, 31, 67867967, 3) == 0, "ner").otherwise("regex"))

    rows = Tables(spark, folder).orders.select(F.col("o_orderkey").alias("k")).where(F.col("k") % 13 > 0)
    return rows.select(k.alias("doc_id"), F.transform(F.sequence(F.lit(0).cast("long"), k % 13 - 1), span).alias("spans"))


def _mix(a, b, m):
    return f"((k * {a} + i * {b}) % 1000003 % {m})"


SPANS_SQL = f"""base AS (
    SELECT k AS doc_id, i, CAST(i AS VARCHAR) AS t, {_mix(7919, 104729, 21)} AS s, {_mix(7919, 104729, 21)} + 1 + {_mix(7907, 15485863, 8)} AS e,
           {_LABELS}[{_mix(6997, 32452843, 12)} + 1] AS lab, CASE WHEN i % 3 = 0 THEN {_SUBTYPES}[(i % 4) + 1] END AS sub,
           CAST({_mix(7793, 49979687, 101)} AS DOUBLE) / 100.0 AS score, CASE WHEN {_mix(31, 67867967, 3)} = 0 THEN 'ner' ELSE 'regex' END AS src
    FROM (SELECT o_orderkey AS k, unnest(range(0, o_orderkey % 13)) AS i FROM orders))"""
_OUT = "doc_id, CAST(s AS BIGINT) AS span_start, CAST(e AS BIGINT) AS span_end, t AS span_text, lab AS label, sub AS subtype"


def _run(name: str, sql: str, fn):
    @query(name, sql)
    def run(spark, folder):
        rows = spans_of_orders(spark, folder)
        return flat(rows.withColumn("spans", fn(F.col("spans"))), "spans", "doc_id")


_run("ovl1_prune_contained", f"""WITH {SPANS_SQL} SELECT {_OUT} FROM (
    SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, s - e, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM base) WHERE reach IS NULL OR e > reach""", O.prune_contained)


@query("ovl1_prune_contained_rows", f"""WITH {SPANS_SQL} SELECT {_OUT} FROM base a WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.s <= a.s AND b.e >= a.e AND (b.s, b.s - b.e, b.i) < (a.s, a.s - a.e, a.i))""")
def ovl1_rows(spark, folder):
    rows = flat(spans_of_orders(spark, folder), "spans", "doc_id")
    table = rows.select("doc_id", F.col("span_start").alias("start"), F.col("span_end").alias("end"), F.col("span_text").cast("int").alias("ord"), "span_text", "label", "subtype")
    kept = O.prune_contained_rows(table, "doc_id")
    return kept.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "span_text", "label", "subtype")


def _walk(order: str, state0: str, step: str, columns: str = "") -> str:
    """Recursive scan of each document's spans in ``order`` carrying ``st``."""
    return f"""WITH RECURSIVE {SPANS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS n FROM base {columns}),
    walk AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, {state0} AS st FROM ranked
             UNION ALL SELECT r.doc_id, r.n, {step} FROM walk w JOIN ranked r ON r.doc_id = w.doc_id AND r.n = w.n + 1),
    last AS (SELECT doc_id, st FROM walk QUALIFY n = max(n) OVER (PARTITION BY doc_id))"""


_run("ovl2_greedy_longest", _walk("s, s - e, i", "{'le': CAST(-1 AS BIGINT), 'kept': CAST([] AS BIGINT[])}",
     "CASE WHEN r.s >= w.st.le THEN {'le': r.e, 'kept': list_append(w.st.kept, r.i)} ELSE w.st END")
     + f" SELECT {_OUT} FROM last JOIN base USING (doc_id) WHERE list_contains(st.kept, i)", O.greedy_longest)


def _relabelled(spans):
    return F.transform(spans, lambda s: make_span(**{n: s[n] for n in ("start", "end", "text", "label", "subtype", "score")}, label_adjusted=s["label"]))


_PRIO = "CASE lab " + " ".join(f"WHEN '{a}' THEN {p}" for a, p in L.VERDICT_PRIORITY.items()) + " END"
_run("ovl3_best_per_range", f"""WITH {SPANS_SQL} SELECT {_OUT} FROM base QUALIFY row_number() OVER (PARTITION BY doc_id, s, e ORDER BY {_PRIO} DESC, i) = 1""",
     lambda spans: O.best_per_range(_relabelled(spans)))

_STRUCT = "CAST([] AS STRUCT(i BIGINT, s BIGINT, e BIGINT, w DOUBLE, lab VARCHAR, src VARCHAR, score DOUBLE)[])"
_CUR = "{'i': r.i, 's': r.s, 'e': r.e, 'w': CAST(r.w AS DOUBLE), 'lab': r.lab, 'src': r.src, 'score': r.score}"
_FIRST = "list_position(list_transform(w.st, lambda k: r.e > k.s AND r.s < k.e), true)"
_BEST = f"(SELECT *, {_PRIO} * ln(1 + e - s) AS w FROM base QUALIFY row_number() OVER (PARTITION BY doc_id, s, e ORDER BY {_PRIO} DESC, i) = 1)"


def _listed(order: str, step: str, source: str) -> str:
    return _walk(order, _STRUCT, step).replace("AS n FROM base )", f"AS n FROM {source})") + \
        f" SELECT {_OUT} FROM (SELECT doc_id, unnest(st).i AS i FROM last) JOIN base USING (doc_id, i)"


_run("ovl4_resolve_partial", _listed("s, e", f"""CASE WHEN coalesce({_FIRST}, 0) = 0 THEN list_append(w.st, {_CUR})
     WHEN r.w > w.st[{_FIRST}].w THEN list_concat(w.st[1:{_FIRST} - 1], [{_CUR}], w.st[{_FIRST} + 1:]) ELSE w.st END""", _BEST),
     lambda spans: O.resolve_verdicts(spans, F.lit(100)))

_MERGE = "coalesce(CASE " + " ".join(f"WHEN lab = '{a}' AND sub = '{b}' THEN {p}" for (a, b), p in L.MERGE_PRIORITY.items() if b) + " END, CASE lab " + \
    " ".join(f"WHEN '{a}' THEN {p}" for (a, b), p in L.MERGE_PRIORITY.items() if b is None) + " END, 50)"
_INTER = "greatest(least(r.e, k.e) - greatest(r.s, k.s), 0)"
_OVER = "(r.e > k.s AND r.s < k.e)"
_run("ovl5_merge_by_priority", _listed("s, -w, s - e, i", f"""CASE WHEN len(list_filter(w.st, lambda k: {_OVER} AND NOT CASE
        WHEN r.lab = k.lab AND CAST({_INTER} AS DOUBLE) / ((r.e - r.s) + (k.e - k.s) - {_INTER}) >= 0.7 THEN r.score > k.score ELSE r.w > k.w END)) > 0 THEN w.st
     ELSE list_append(list_filter(w.st, lambda k: NOT {_OVER}), {_CUR}) END""", f"(SELECT *, {_MERGE} AS w FROM base)"), O.merge_by_priority)

_run("ovl6_source_first", _listed("s, src <> 'ner', s - e, i", f"""CASE WHEN coalesce({_FIRST}, 0) = 0 THEN list_append(w.st, {_CUR})
     WHEN r.src = 'ner' AND w.st[{_FIRST}].src <> 'ner' THEN list_append(list_concat(w.st[1:{_FIRST} - 1], w.st[{_FIRST} + 1:]), {_CUR}) ELSE w.st END""",
     "(SELECT *, 0.0 AS w FROM base)"), O.merge_source_first)


@query("ovl8_iou", f"""WITH {SPANS_SQL}, next AS (SELECT doc_id, i, s, e, lead(s) OVER w AS s2, lead(e) OVER w AS e2 FROM base WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT doc_id, i, round(CAST(greatest(least(e, e2) - greatest(s, s2), 0) AS DOUBLE)
    / ((e - s) + (e2 - s2) - greatest(least(e, e2) - greatest(s, s2), 0)), 6) AS iou FROM next WHERE s2 IS NOT NULL""")
def ovl8(spark, folder):
    rows = spans_of_orders(spark, folder)
    pairs = F.transform(F.filter(F.col("spans"), lambda s, i: i > 0), lambda b, i: F.struct(i.cast("long").alias("i"), F.get(F.col("spans"), i).alias("a"), b.alias("b")))
    p = rows.select("doc_id", F.explode(pairs).alias("p"))
    iou = O.interval_iou(F.col("p.a.start"), F.col("p.a.end"), F.col("p.b.start"), F.col("p.b.end"))
    return p.select("doc_id", "p.i", F.round(iou, 6).alias("iou"))


_UNCOVERED = f"""WITH {SPANS_SQL} SELECT {_OUT} FROM base a WHERE src = 'regex' AND NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.src = 'ner' AND b.s < a.e AND a.s < b.e)"""


def _of_source(name):
    return lambda s: s["source"] == name


_run("join6_uncovered", _UNCOVERED, lambda spans: O.uncovered(F.filter(spans, _of_source("regex")), F.filter(spans, _of_source("ner"))))


@query("join6_uncovered_rows", _UNCOVERED)
def join6_rows(spark, folder):
    from ..operators.detect import explode_spans
    rows = explode_spans(spans_of_orders(spark, folder), "spans", "doc_id")
    left = O.uncovered_rows(rows.where("source = 'regex'"), rows.where("source = 'ner'"), "doc_id")
    return left.select("doc_id", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), F.col("text").alias("span_text"), "label", "subtype")
