"""Segmentation of utterances and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as G
from .registry import Tables, query

# --- utterances: one recording per user, event times compressed to speech pace ---------------

_T0 = "2024-01-01 00:00:00"
_DUR = "(CASE WHEN event_id % 41 = 0 THEN 24000 + event_id % 9000 ELSE 200 + (event_id * 7919) % 4000 END)"
_EPOCH_SQL = f"(epoch_us(ts) - epoch_us(TIMESTAMP '{_T0}'))"


def utterances(spark, folder):
    e = Tables(spark, folder).events
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(_T0).cast("timestamp"))
    start = F.floor(micros / 20000000).cast("long")
    return e.select(F.col("user_id").alias("rec_id"), start.alias("start_ms"), (start + F.expr(_DUR)).cast("long").alias("end_ms"))


UTT_SQL = f"""utt AS (SELECT user_id AS rec_id, CAST(floor({_EPOCH_SQL} / 20000000) AS BIGINT) AS start_ms,
    CAST(floor({_EPOCH_SQL} / 20000000) AS BIGINT) + {_DUR} AS end_ms FROM events),
    num AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms) - 1 AS pos, count(*) OVER (PARTITION BY rec_id) AS n FROM utt)"""


def recordings(spark, folder):
    return utterances(spark, folder).groupBy("rec_id").agg((F.max("end_ms") + 500).alias("duration_ms"))


REC_SQL = "rec AS (SELECT rec_id, max(end_ms) + 500 AS duration_ms FROM utt GROUP BY rec_id)"

# one step per utterance: extend the open group or start a new one
_MERGE = f"""WITH RECURSIVE {UTT_SQL},
    walk AS (SELECT rec_id, pos, start_ms AS gs, end_ms AS ge, pos AS head, CAST(1 AS BIGINT) AS cnt, end_ms - start_ms < 3000 AS open FROM num WHERE pos = 0
      UNION ALL SELECT r.rec_id, r.pos,
        CASE WHEN w.open AND r.start_ms - w.ge < 2000 AND r.end_ms - w.gs < 20000 THEN w.gs ELSE r.start_ms END, r.end_ms,
        CASE WHEN w.open AND r.start_ms - w.ge < 2000 AND r.end_ms - w.gs < 20000 THEN w.head ELSE r.pos END,
        CASE WHEN w.open AND r.start_ms - w.ge < 2000 AND r.end_ms - w.gs < 20000 THEN w.cnt + 1 ELSE 1 END,
        CASE WHEN w.open AND r.start_ms - w.ge < 2000 AND r.end_ms - w.gs < 20000 THEN r.end_ms - w.gs < 8000 ELSE r.end_ms - r.start_ms < 3000 END
      FROM walk w JOIN num r ON r.rec_id = w.rec_id AND r.pos = w.pos + 1),
    grp AS (SELECT rec_id, head, any_value(gs) AS gs, arg_max(ge, pos) AS ge, max(cnt) AS cnt FROM walk GROUP BY rec_id, head),
    cut AS (SELECT rec_id, head, cnt, CASE WHEN cnt = 1 AND ge - gs > 20000 THEN unnest(range(gs, ge, 15000)) ELSE gs END AS s, gs, ge FROM grp)"""
_MERGE = _MERGE.replace("CASE WHEN cnt = 1 AND ge - gs > 20000 THEN unnest(range(gs, ge, 15000)) ELSE gs END AS s",
                        "unnest(CASE WHEN cnt = 1 AND ge - gs > 20000 THEN range(gs, ge, 15000) ELSE [gs] END) AS s")


@query("seg2_merge_short", _MERGE + """ SELECT rec_id, s AS start_ms, CASE WHEN cnt = 1 AND ge - gs > 20000 THEN least(s + 15000, ge) ELSE ge END AS end_ms,
    cnt > 1 AS is_merged, CASE WHEN cnt > 1 THEN cnt ELSE 0 END AS members, CASE WHEN cnt > 1 THEN head ELSE -1 END AS first_member, ranges
    FROM cut JOIN (SELECT w.rec_id, w.head, string_agg(r.start_ms || '-' || r.end_ms, ',' ORDER BY r.pos) AS ranges FROM walk w JOIN num r ON r.rec_id = w.rec_id AND r.pos = w.pos GROUP BY w.rec_id, w.head) USING (rec_id, head)""")
def seg2(spark, folder):
    out = G.merge_short(utterances(spark, folder))
    return out.select("rec_id", "start_ms", "end_ms", "is_merged", F.coalesce(F.size("merged_indices"), F.lit(0)).cast("long").alias("members"),
                      F.coalesce(F.get("merged_indices", F.lit(0)), F.lit(-1)).cast("long").alias("first_member"),
                      F.array_join(F.transform("original_ranges", lambda x: F.concat_ws("-", x["start_ms"], x["end_ms"])), ",").alias("ranges"))


# --- back-to-back pieces ----------------------------------------------------------------------

_PIECE = "(CASE WHEN event_id % 37 = 0 THEN 16001 + event_id % 9000 ELSE 300 + (event_id * 7919) % 4700 END)"


def pieces(spark, folder):
    e = Tables(spark, folder).events.select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("idx"), F.expr(_PIECE).cast("long").alias("duration_ms"))
    laid = G.laid_end_to_end(e)
    return laid.select("rec_id", "idx", "start_ms", "end_ms", "duration_ms")


PIECES_SQL = f"""piece AS (SELECT user_id AS rec_id, event_id AS idx, CAST({_PIECE} AS BIGINT) AS duration_ms FROM events),
    laid AS (SELECT *, CAST(sum(duration_ms) OVER w AS BIGINT) AS end_ms, CAST(sum(duration_ms) OVER w AS BIGINT) - duration_ms AS start_ms,
      row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY rec_id) AS n FROM piece WINDOW w AS (PARTITION BY rec_id ORDER BY idx))"""


@query("seg8_cumulative_position", f"WITH {PIECES_SQL} SELECT rec_id, idx, start_ms, end_ms FROM laid")
def seg8(spark, folder):
    return pieces(spark, folder).select("rec_id", "idx", "start_ms", "end_ms")


_FITS = "(w.open AND w.ge - w.gs < 8000 AND (w.ge - w.gs) + r.duration_ms <= 15000)"
_JOINED = f"""WITH RECURSIVE {PIECES_SQL},
    chars AS (SELECT *, CAST(floor((duration_ms / 1000.0::DOUBLE) * (200.0::DOUBLE / 60.0::DOUBLE)) AS BIGINT) AS c FROM laid),
    walk AS (SELECT rec_id, pos, pos AS head, start_ms AS gs, end_ms AS ge, c, duration_ms < 3000 AND pos < n - 1 AS open, duration_ms < 3000 AND pos < n - 1 AS merged FROM chars WHERE pos = 0
      UNION ALL SELECT r.rec_id, r.pos, CASE WHEN {_FITS} THEN w.head ELSE r.pos END, CASE WHEN {_FITS} THEN w.gs ELSE r.start_ms END, r.end_ms,
        CASE WHEN {_FITS} THEN w.c + r.c ELSE r.c END, CASE WHEN {_FITS} THEN true ELSE r.duration_ms < 3000 AND r.pos < r.n - 1 END,
        CASE WHEN {_FITS} THEN true ELSE r.duration_ms < 3000 AND r.pos < r.n - 1 END
      FROM walk w JOIN chars r ON r.rec_id = w.rec_id AND r.pos = w.pos + 1),
    grp AS (SELECT rec_id, head, any_value(gs) AS gs, max(ge) AS ge, arg_max(c, pos) AS c, bool_or(merged) AS merged, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS members FROM walk GROUP BY rec_id, head)
    SELECT rec_id, CAST(head AS DOUBLE) AS chunk_index, gs AS start_ms, ge AS end_ms, c AS text_length, merged AS is_merged, CASE WHEN merged THEN members END AS merged_indices FROM grp WHERE merged OR ge - gs <= 15000
    UNION ALL SELECT rec_id, head + h * 0.5, CASE WHEN h = 0 THEN gs ELSE gs + (ge - gs) // 2 END, CASE WHEN h = 0 THEN gs + (ge - gs) // 2 ELSE ge END, c // 2, false, NULL
    FROM grp, (VALUES (0), (1)) v(h) WHERE NOT merged AND ge - gs > 15000"""


@query("seg3_join_pieces", _JOINED)
def seg3(spark, folder):
    from ..functions.text import estimated_length
    p = pieces(spark, folder).withColumn("text_length", estimated_length(F.col("duration_ms")))
    return G.join_pieces(p).withColumn("merged_indices", F.array_join("merged_indices", ","))


_CHUNKS = f"""WITH RECURSIVE {UTT_SQL}, {REC_SQL},
    gaps AS (SELECT rec_id, list(end_ms ORDER BY pos) FILTER (pos < n - 1) AS g FROM num GROUP BY rec_id),
    src AS (SELECT rec_id, duration_ms AS d, coalesce(g, []) AS g FROM rec JOIN gaps USING (rec_id)),
    walk AS (SELECT rec_id, CAST(-1 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS s, CAST(NULL AS BIGINT) AS start_ms, CAST(NULL AS BIGINT) AS end_ms, d > 0 AS go FROM src
      UNION ALL SELECT rec_id, idx + 1, actual - 3000, s, least(actual + 3000, d), actual - 3000 < d - 5000 FROM (
        SELECT *, CASE WHEN near - s < 5000 AND near < d THEN ideal ELSE near END AS actual FROM (
          SELECT w.*, d, least(w.s + 15000, d) AS ideal, coalesce(list_filter(g, lambda x: abs(x - least(w.s + 15000, d)) < 2000)[1], least(w.s + 15000, d)) AS near
          FROM walk w JOIN src USING (rec_id) WHERE go)))
    SELECT rec_id, idx AS chunk_index, start_ms, end_ms, CAST(CASE WHEN end_ms < (SELECT d FROM src WHERE src.rec_id = walk.rec_id) THEN 3000 ELSE 0 END AS BIGINT) AS overlap_with_next FROM walk WHERE idx >= 0"""


@query("seg4_snapped_chunks", _CHUNKS)
def seg4(spark, folder):
    out = G.snapped_chunks(utterances(spark, folder), recordings(spark, folder))
    return out.select("rec_id", "chunk_index", "start_ms", "end_ms", F.col("overlap_with_next").cast("long").alias("overlap_with_next"))


_WINDOWS = "WITH {utt}, {rec} SELECT rec_id, s // {step} AS chunk_index, s AS start_ms, least(s + {step} + {lap}, duration_ms) AS end_ms FROM (SELECT *, unnest(range(0, duration_ms, {step})) AS s FROM rec)"


def _windows(step: int, lap: int) -> str:
    return _WINDOWS.format(utt=UTT_SQL, rec=REC_SQL, step=step, lap=lap)


@query("seg5_fixed_windows", _windows(15000, 3000))
def seg5(spark, folder):
    return G.fixed_windows(recordings(spark, folder))


@query("seg6_tumbling", _windows(8000, 0))
def seg6(spark, folder):
    return G.tumbling(recordings(spark, folder))


@query("seg6_test_chunks", _windows(10000, 0) + " WHERE s // 10000 < 5")
def seg6_test(spark, folder):
    return G.tumbling(recordings(spark, folder), 10000, 5)


@query("seg7_padding", f"WITH {UTT_SQL}, {REC_SQL} SELECT rec_id, start_ms, end_ms, greatest(start_ms - 200, 0) AS cut_start, least(end_ms + 200, duration_ms) AS cut_end FROM utt JOIN rec USING (rec_id)")
def seg7(spark, folder):
    return G.padded(utterances(spark, folder), recordings(spark, folder))


# --- silence: one 10 ms frame per embedding, quiet in places ------------------------------------

_GAIN = "(CASE WHEN (vec_id * 13 // 400) % 3 = 0 OR vec_id % 97 < 3 THEN 0.001 ELSE 1.0 END)"
FRAMES_SQL = f"frame AS (SELECT vec_id // 250 AS rec_id, vec_id % 250 AS frame_idx, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST({_GAIN} AS DOUBLE)) AS samples FROM embeddings)"


def frames(spark, folder):
    e = Tables(spark, folder).embeddings
    gain = F.expr(_GAIN.replace("vec_id * 13 // 400", "(vec_id * 13) div 400")).cast("double")
    return e.select(F.expr("vec_id div 250").alias("rec_id"), (F.col("vec_id") % 250).alias("frame_idx"),
                    F.transform("embedding", lambda x: x.cast("double") * gain).alias("samples"))


_SPEECH = f"""WITH {FRAMES_SQL},
    en AS (SELECT rec_id, frame_idx, len(samples) AS n, list_sum(list_transform(samples, lambda x: x * x)) AS ss FROM frame),
    win AS (SELECT rec_id, frame_idx * 10 AS t_ms, sqrt(sum(ss) OVER w / sum(n) OVER w) AS rms, count(*) OVER w AS have FROM en WINDOW w AS (PARTITION BY rec_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
    silent AS (SELECT rec_id, t_ms FROM win WHERE have = 30 AND rms <= 0.01),
    marked AS (SELECT *, CASE WHEN t_ms > lag(t_ms) OVER (PARTITION BY rec_id ORDER BY t_ms) + 300 THEN 1 ELSE 0 END AS fresh FROM silent),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY rec_id ORDER BY t_ms) AS run FROM marked),
    sil AS (SELECT rec_id, run, min(t_ms) AS s, max(t_ms) + 300 AS e FROM runs GROUP BY rec_id, run),
    len AS (SELECT rec_id, count(*) * 10 AS total FROM frame GROUP BY rec_id)
    SELECT rec_id, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms FROM (
      SELECT rec_id, coalesce(lag(e) OVER (PARTITION BY rec_id ORDER BY s), 0) AS start_ms, s AS end_ms FROM sil
      UNION ALL SELECT rec_id, coalesce((SELECT max(e) FROM sil WHERE sil.rec_id = len.rec_id), 0), total FROM len)
    WHERE start_ms <> end_ms"""


@query("seg1_speech_intervals", _SPEECH)
def seg1(spark, folder):
    return G.speech_intervals(frames(spark, folder))
