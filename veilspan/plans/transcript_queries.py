"""Sentence times, stitching and transcript documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import bind, each
from ..operators import transcripts as X
from ..plans.ordered import running
from . import sqltext as S
from .registry import Tables, query
from .text_queries import _A, _B

# --- conversations as recordings: every turn a chunk of 60 ms per character -------------------


def chunks(spark, folder):
    c = Tables(spark, folder).conversations.select(
        F.col("conv_id").alias("rec_id"), F.col("turn").alias("chunk_index"), (F.length("text") * 60).cast("long").alias("d"))
    laid = running(c, ["rec_id"], ["chunk_index"], {"end_ms": ("sum", "d")})
    return laid.select("rec_id", "chunk_index", (F.col("end_ms") - F.col("d")).alias("start_ms"), "end_ms", (F.col("chunk_index") % 3 != 1).alias("is_merged"))


def results(spark, folder):
    c = Tables(spark, folder).conversations
    return c.select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("chunk_index"), ((F.col("conv_id") + F.col("turn")) % 5 != 4).alias("success"), "text")


_BASE = """chunk AS (SELECT conv_id AS rec_id, turn AS chunk_index, text, (conv_id + turn) % 5 <> 4 AS success, turn % 3 <> 1 AS is_merged,
      CAST(sum(length(text) * 60) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end_ms, length(text) * 60 AS d FROM conversations),
    timed AS (SELECT *, (end_ms - d) / 1000.0::DOUBLE AS s0, end_ms / 1000.0::DOUBLE AS e0 FROM chunk)"""


def _shares(parts: str, clip: bool, total: str) -> str:
    """Sentence rows with proportional times."""
    end = "s0 + before * rate + length(p[i]) * rate"
    return f"""cutup AS (SELECT *, {parts} AS p FROM timed WHERE success AND text <> ''),
    rated AS (SELECT *, (e0 - s0) / CAST({total} AS DOUBLE) AS rate FROM cutup),
    each AS (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM rated WHERE is_merged AND len(p) > 1),
    sent AS (SELECT rec_id, chunk_index, i - 1 AS part, trim(p[i]) AS text, s0 + before * rate AS start_time, {f"least({end}, e0)" if clip else end} AS end_time
             FROM (SELECT *, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0) AS before FROM each)
             UNION ALL SELECT rec_id, chunk_index, 0, {S.strip('text')}, s0, e0 FROM rated WHERE NOT (is_merged AND len(p) > 1))"""


_TRX1 = f"WITH {_BASE}, {_shares(_A, True, 'list_sum(list_transform(p, lambda x: length(x)))')}"
# the small offset keeps values off the rounding ties
_ROUNDED = "round(start_time + 0.00001, 4) AS start_time, round(end_time + 0.00001, 4) AS end_time"


def _joined(spark, folder):
    # chunks and results come from the same table: rename one side's columns
    c = chunks(spark, folder)
    return X.matched_results(results(spark, folder), c.select(*[F.col(x).alias(x) for x in c.columns]))


def _sentence_rows(spark, folder, share):
    rows = _joined(spark, folder).select("rec_id", "chunk_index", F.posexplode(share(
        F.col("text"), F.col("start_ms") / 1000.0, F.col("end_ms") / 1000.0, F.col("is_merged"))).alias("part", "s"))
    return rows.select("rec_id", "chunk_index", F.col("part").cast("long").alias("part"), F.col("s.text").alias("text"),
                       F.round(F.col("s.start_time") + 0.00001, 4).alias("start_time"), F.round(F.col("s.end_time") + 0.00001, 4).alias("end_time"))


@query("trx1_share_by_characters", f"{_TRX1} SELECT rec_id, chunk_index, part, text, {_ROUNDED} FROM sent")
def trx1(spark, folder):
    return _sentence_rows(spark, folder, X.share_by_characters)


@query("trx2_share_of_whole", f"WITH {_BASE}, {_shares(_B, False, 'length(text)')} SELECT rec_id, chunk_index, part, text, {_ROUNDED} FROM sent")
def trx2(spark, folder):
    return _sentence_rows(spark, folder, X.share_of_whole)


@query("trx1_timed_sentences", f"""{_TRX1}, seen AS (SELECT *, max(end_time) OVER (PARTITION BY rec_id ORDER BY start_time, chunk_index, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m,
      count(*) OVER (PARTITION BY rec_id) AS n FROM sent)
    SELECT rec_id, chunk_index, part, text, round(CASE WHEN n > 1 THEN greatest(start_time, coalesce(m, start_time)) ELSE start_time END + 0.00001, 4) AS start_time, round(end_time + 0.00001, 4) AS end_time
    FROM seen WHERE n = 1 OR greatest(start_time, coalesce(m, start_time)) < end_time - 1e-9""")
def timed(spark, folder):
    c = chunks(spark, folder)
    t = X.timed_sentences(results(spark, folder), c.select(*[F.col(x).alias(x) for x in c.columns]))
    return t.select("rec_id", "chunk_index", F.col("part").cast("long").alias("part"), "text",
                    F.round(F.col("start_time") + 0.00001, 4).alias("start_time"), F.round(F.col("end_time") + 0.00001, 4).alias("end_time"))


@query("join9_results_to_chunks", f"WITH {_BASE} SELECT rec_id, chunk_index, end_ms FROM timed WHERE success AND text <> '' AND (chunk_index * 7 + rec_id) % 5 <> 3")
def join9(spark, folder):
    # some chunks are missing anywhere in a recording; all results are kept
    c = chunks(spark, folder).where("(chunk_index * 7 + rec_id) % 5 <> 3")
    return X.matched_results(results(spark, folder), c.select(*[F.col(x).alias(x) for x in c.columns])).select("rec_id", "chunk_index", "end_ms")


# --- overlap repair over user events ------------------------------------------------------------

_SPAN = "SELECT user_id AS rec_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE - 1704067200 AS s, epoch_us(ts) / 1000000.0::DOUBLE - 1704067200 + value * 900 AS e FROM events"


@query("trx4_repair_overlaps", f"""WITH r AS (SELECT *, max(e) OVER (PARTITION BY rec_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, count(*) OVER (PARTITION BY rec_id) AS n FROM ({_SPAN}))
    SELECT rec_id, event_id, round(greatest(s, coalesce(m, s)), 4) AS start_time, round(e, 4) AS end_time FROM r WHERE n = 1 OR greatest(s, coalesce(m, s)) < e""")
def trx4(spark, folder):
    e = Tables(spark, folder).events
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0 - 1704067200
    rows = e.select(F.col("user_id").alias("rec_id"), "event_id", s.alias("start_time"), (s + F.col("value") * 900).alias("end_time"))
    fixed = X.repair_overlaps(rows, ["start_time", "event_id"], 86400.0)
    return fixed.select("rec_id", "event_id", F.round("start_time", 4).alias("start_time"), F.round("end_time", 4).alias("end_time"))


# --- documents from sentence rows ----------------------------------------------------------------

_LINES = "SELECT conv_id AS rec_id, turn AS pos, text, turn * 41.5::DOUBLE AS s, turn * 41.5::DOUBLE + 7.25 AS e FROM conversations"


def lines(spark, folder):
    c = Tables(spark, folder).conversations
    s = F.col("turn") * 41.5
    return c.select(F.col("conv_id").alias("rec_id"), "text", s.alias("start_time"), F.when(F.col("turn") % 4 != 3, s + 7.25).alias("end_time"))


@query("trx7_plain_text", f"SELECT rec_id, string_agg(text, ' ' ORDER BY pos) AS text FROM ({_LINES}) WHERE text <> '' GROUP BY rec_id")
def trx7(spark, folder):
    return X.plain_text(lines(spark, folder))


_STAMP = "printf('[%02d:%02d] ', CAST(floor(s / 60) AS BIGINT), CAST(floor(s % 60) AS BIGINT)) || text || chr(10)"


@query("trx8_stamped_text", f"SELECT rec_id, string_agg({_STAMP}, chr(10) ORDER BY pos) AS text FROM ({_LINES}) GROUP BY rec_id")
def trx8(spark, folder):
    return X.stamped_text(lines(spark, folder))


def _clock(x: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', CAST(floor({x} / 3600) AS BIGINT), CAST(floor(({x} % 3600) / 60) AS BIGINT), CAST(floor({x} % 60) AS BIGINT), CAST(floor(({x} % 1) * 1000) AS BIGINT))"


@query("trx9_subtitles", f"""SELECT rec_id, string_agg(CAST(n AS VARCHAR) || chr(10) || {_clock('s')} || ' --> ' || {_clock('e1')} || chr(10) || text || chr(10), chr(10) ORDER BY pos) AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY pos) AS n, CASE WHEN pos % 4 = 3 THEN s + 3 ELSE e END AS e1 FROM ({_LINES})) GROUP BY rec_id""")
def trx9(spark, folder):
    return X.subtitles(lines(spark, folder))


@query("trx11_edit_status", """SELECT conv_id * 100 + turn AS rec_id, text AS original_transcript, CASE WHEN turn % 3 = 0 AND text <> trim(text) || ' x' THEN trim(text) || ' x' END AS edited_transcript, turn % 3 = 0 AS was_edited FROM conversations""")
def trx11(spark, folder):
    c = Tables(spark, folder).conversations
    rec = (F.col("conv_id") * 100 + F.col("turn")).alias("rec_id")
    edited = F.when(F.col("turn") % 3 == 0, F.concat(F.trim("text"), F.lit(" x"))).otherwise(F.col("text"))
    edits = c.where("turn % 3 < 2").select(rec, edited.alias("edited_text"))
    return X.edit_status(c.select(rec, "text"), edits)


# --- stitching: documents recognised in overlapping windows ---------------------------------------


def overlapped(spark, folder, size: int, step: int):
    """Windows of a document as chunks; some repeat the one before, some are blank."""
    d = Tables(spark, folder).documents.where(F.length("text") > 0)
    # one pass cuts a text into steps, from which the windows are joined; a window cut from the text would count from its start
    steps = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    most = -(-size // step)

    def window(cells: Column, i: Column) -> Column:
        at = F.when(i % 7 == 5, i - 1).otherwise(i)
        whole = F.left(F.array_join(F.slice(cells, at + 1, F.lit(most)), ""), F.lit(size))
        return F.struct(i.alias("i"), F.when(i % 11 == 9, "  ").otherwise(whole).alias("text"))

    windows = bind(steps, lambda cells: F.transform(cells, lambda _, i: window(cells, i)))
    w = each(d.select(F.col("doc_id").alias("rec_id"), windows.alias("w")), "w", "rec_id", name="w")
    i = F.col("w.i")
    return w.select("rec_id", i.cast("long").alias("chunk_index"), F.col("w.text").alias("text"), (i % 13 != 6).alias("success"))


def _overlapped_sql(size: int, step: int) -> str:
    return f"""raw AS (SELECT doc_id AS rec_id, text AS body, unnest(range(0, length(text), {step})) AS o FROM documents WHERE length(text) > 0),
    win AS (SELECT rec_id, o // {step} AS i, CASE WHEN (o // {step}) % 11 = 9 THEN '  ' ELSE substr(body, CASE WHEN (o // {step}) % 7 = 5 THEN o - {step} ELSE o END + 1, {size}) END AS t, (o // {step}) % 13 <> 6 AS success FROM raw)"""


def _stitch_sql(size: int, step: int, cut: str) -> str:
    """Scan the chunks of a recording carrying the last accepted full text."""
    return f"""WITH RECURSIVE {_overlapped_sql(size, step)},
    txt AS (SELECT rec_id, i, {S.strip('t')} AS t FROM win),
    num AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY i) AS n FROM txt WHERE t <> ''),
    walk AS (SELECT rec_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS i, '' AS prev, '' AS added FROM num WHERE n = 1
      UNION ALL SELECT rec_id, n, i, CASE WHEN added <> '' THEN t ELSE prev END, added FROM (
        SELECT r.rec_id, r.n, r.i, r.t, w.prev, CASE WHEN w.prev = '' THEN r.t ELSE {cut} END AS added FROM walk w JOIN num r ON r.rec_id = w.rec_id AND r.n = w.n + 1))"""


_LONGEST = "least(100, length(w.prev) // 2, length(r.t) // 2)"
_K = f"(list_filter(range({_LONGEST}, 10, -1), lambda k: instr(substr(r.t, 1, 49 + k), right(w.prev, k)) > 0)[1])"
_CUT_B = f"(CASE WHEN instr(substr(r.t, 1, 149), right(w.prev, 11)) = 0 OR {_K} IS NULL THEN r.t ELSE {S.strip(f'substr(r.t, instr(r.t, right(w.prev, {_K})) + {_K})')} END)"


@query("trx6_stitch_exact", _stitch_sql(300, 240, _CUT_B) + " SELECT rec_id, i AS chunk_index, added AS text, added = '' AS removed FROM walk WHERE n > 0")
def trx6(spark, folder):
    return X.stitched(overlapped(spark, folder, 300, 240)).select("rec_id", "chunk_index", "text", "removed")




def _words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '[{S.SPACES}]+'), lambda x: x <> '')"


def _fuzzy_sql(size: int, step: int) -> str:
    """As the exact scan, with the word grid when no exact tail is found."""
    return f"""WITH RECURSIVE {_overlapped_sql(size, step)},
    txt AS (SELECT rec_id, i, {S.strip('t')} AS t FROM win),
    num AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY i) AS n, {_words('t')} AS ws FROM txt WHERE t <> ''),
    walk AS (SELECT rec_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS i, '' AS prev, CAST([] AS VARCHAR[]) AS pw, '' AS added FROM num WHERE n = 1
      UNION ALL SELECT rec_id, n, i, CASE WHEN added <> '' THEN t ELSE prev END, CASE WHEN added <> '' THEN ws ELSE pw END, added FROM (
        SELECT *, CASE WHEN prev = '' THEN t WHEN k IS NOT NULL THEN {S.strip('substr(t, instr(t, right(prev, k)) + k)')}
                       WHEN drop_n IS NULL THEN t ELSE coalesce(array_to_string(ws[drop_n + 1:], ' '), '') END AS added FROM (
          SELECT *, CASE WHEN len(pw) >= 3 AND len(ws) >= 3 AND k IS NULL THEN list_filter(flatten(list_transform(range(least(10, len(pw) // 2), 2, -1), lambda m: list_transform(range(0, least(10, len(ws) - m + 1)), lambda s:
              CASE WHEN len(list_filter(range(1, m + 1), lambda j: pw[len(pw) - m + j] = ws[s + j])) / CAST(m AS DOUBLE) >= 0.7 THEN s + m END))), lambda x: x IS NOT NULL)[1] END AS drop_n FROM (
            SELECT r.rec_id, r.n, r.i, r.t, r.ws, w.prev, w.pw, CASE WHEN instr(substr(r.t, 1, 149), right(w.prev, 11)) = 0 THEN NULL ELSE {_K} END AS k FROM walk w JOIN num r ON r.rec_id = w.rec_id AND r.n = w.n + 1))))
    SELECT rec_id, i AS chunk_index, CASE WHEN added = '' THEN '[중복 제거됨]' ELSE added END AS text, added = '' AS removed FROM walk WHERE n > 0"""


@query("trx12_stitch_fuzzy", _fuzzy_sql(300, 240))
def trx12(spark, folder):
    return X.stitched_with_markers(overlapped(spark, folder, 300, 240)).select("rec_id", "chunk_index", "text", "removed")


_KA = "(list_filter(range(least(50, length(prev) // 2), 5, -1), lambda k: starts_with(t, right(prev, k)))[1])"
_JA = "(list_filter(range(1, least(len(pw), len(ws), 5) + 1), lambda j: pw[len(pw) - j + 1:] = ws[1:j])[1])"


@query("trx5_merged_transcript", f"""WITH RECURSIVE {_overlapped_sql(300, 270)},
    num AS (SELECT rec_id, i, success, {S.strip('t')} AS t, row_number() OVER (PARTITION BY rec_id ORDER BY i) AS n, count(*) OVER (PARTITION BY rec_id) AS total, {_words('t')} AS ws FROM win),
    walk AS (SELECT rec_id, CAST(0 AS BIGINT) AS n, '' AS prev, CAST([] AS VARCHAR[]) AS pw, CAST(NULL AS VARCHAR) AS piece, false AS gap FROM num WHERE n = 1
      UNION ALL SELECT rec_id, n, CASE WHEN ok AND added <> '' THEN t ELSE prev END, CASE WHEN ok AND added <> '' THEN ws ELSE pw END,
             CASE WHEN NOT ok AND n > 1 AND n < total THEN '[...]' WHEN ok AND added <> '' THEN added END, NOT ok FROM (
        SELECT *, CASE WHEN prev = '' THEN t WHEN {_KA} IS NOT NULL THEN {S.strip(f'substr(t, {_KA} + 1)')} WHEN {_JA} IS NOT NULL THEN coalesce(array_to_string(ws[{_JA} + 1:], ' '), '') ELSE t END AS added FROM (
          SELECT r.rec_id, r.n, r.total, r.t, r.ws, r.success AS ok, w.prev, w.pw FROM walk w JOIN num r ON r.rec_id = w.rec_id AND r.n = w.n + 1))),
    piece AS (SELECT *, lead(piece) OVER o AS nxt, lead(gap) OVER o AS nxt_gap FROM walk WHERE piece IS NOT NULL WINDOW o AS (PARTITION BY rec_id ORDER BY n)),
    dotted AS (SELECT rec_id, n, CASE WHEN nxt IS NOT NULL AND NOT nxt_gap AND NOT regexp_matches(piece, '[.!?]$') AND NOT regexp_matches(nxt, '^\\p{{Lu}}') THEN piece || '.' ELSE piece END AS piece FROM piece)
    SELECT rec_id, replace(replace(replace(replace({S.squeeze("string_agg(piece, ' ' ORDER BY n)")}, ' .', '.'), ' ,', ','), ' ?', '?'), ' !', '!') AS text FROM dotted GROUP BY rec_id""")
def trx5(spark, folder):
    return X.merged_transcript(overlapped(spark, folder, 300, 270))


@query("sort4_chunk_order", "SELECT rec_id, i AS chunk_index, row_number() OVER (PARTITION BY rec_id ORDER BY i) - 1 AS pos FROM (SELECT doc_id AS rec_id, unnest(range(0, length(text), 500)) // 500 AS i FROM documents WHERE length(text) > 0)")
def sort4(spark, folder):
    from .ordered import positions
    w = overlapped(spark, folder, 500, 500).select("rec_id", "chunk_index")
    return positions(w, ["rec_id"], ["chunk_index"]).orderBy("rec_id", "pos")


_ATTEMPTS = "SELECT conv_id AS rec_id, turn AS chunk_index, a AS attempt, a >= turn % 3 AS success, text || CAST(a AS VARCHAR) AS text FROM conversations, (VALUES (0), (1), (2)) v(a) WHERE a <= turn % 3"


@query("val13_last_attempts", f"SELECT rec_id, chunk_index, arg_max(success, attempt) AS success, arg_max(text, attempt) AS text, count(*) - 1 AS retry_count FROM ({_ATTEMPTS}) GROUP BY ALL")
def val13_attempts(spark, folder):
    c = Tables(spark, folder).conversations
    a = c.select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("chunk_index"), "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turn") % 3)).alias("attempt"))
    rows = a.select("rec_id", "chunk_index", "attempt", (F.col("attempt") >= F.col("chunk_index") % 3).alias("success"), F.concat("text", F.col("attempt").cast("string")).alias("text"))
    return X.last_attempts(rows)


@query("val13_success_verdicts", "SELECT conv_id, avg(CASE WHEN (conv_id + turn) % 5 <> 4 THEN 1.0 ELSE 0.0 END) > 0.5 AS mostly_ok, bool_or((conv_id + turn) % 5 <> 4) AS any_ok FROM conversations GROUP BY conv_id")
def val13(spark, folder):
    from ..operators.summaries import chunk_stats
    rows = results(spark, folder).withColumns({"retry_count": F.lit(0), "duration": F.lit(1.0)}).withColumnRenamed("rec_id", "conv_id")
    return chunk_stats(rows, "conv_id").select("conv_id", "mostly_ok", "any_ok")
