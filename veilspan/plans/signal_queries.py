"""Signal metrics over embeddings taken as sample frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signal as G
from ..plans.ordered import exact_quantile
from .registry import Tables, query
from .segment_queries import FRAMES_SQL, frames

_S = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings"
_SQ = "list_sum(list_transform({}, lambda x: x * x))"
_RMS = f"sqrt({_SQ.format('v')} / len(v))"
_DB = "20 * log10({} + 1e-10)"


def _rows(spark, folder):
    return Tables(spark, folder).embeddings.select("vec_id", F.col("embedding").alias("s"), "label")


@query("sig1_rms", f"SELECT vec_id, round({_RMS}, 9) AS rms, round({_DB.format(_RMS)}, 6) AS rms_db FROM ({_S})")
def sig1(spark, folder):
    return _rows(spark, folder).select("vec_id", F.round(G.rms(F.col("s")), 9).alias("rms"), F.round(G.decibels(G.rms(F.col("s"))), 6).alias("rms_db"))


_EN = f"{FRAMES_SQL}, en AS (SELECT rec_id, frame_idx, len(samples) AS n, {_SQ.format('samples')} AS ss FROM frame)"


@query("sig1_recording_levels", f"WITH {_EN} SELECT rec_id, round(sqrt(sum(ss) / sum(n)), 9) AS rms, round({_DB.format('sqrt(sum(ss) / sum(n))')}, 6) AS rms_db, round(max(p), 9) AS peak FROM en JOIN (SELECT rec_id, frame_idx, list_max(list_transform(samples, lambda x: abs(x))) AS p FROM frame) USING (rec_id, frame_idx) GROUP BY rec_id")
def sig1_recordings(spark, folder):
    r = G.recording_levels(frames(spark, folder))
    return r.select("rec_id", F.round("rms", 9).alias("rms"), F.round("rms_db", 6).alias("rms_db"), F.round("peak", 9).alias("peak"))


_N0 = "sqrt(sum(ss) FILTER (frame_idx < 50) / sum(n) FILTER (frame_idx < 50))"


@query("sig2_signal_to_noise", f"WITH {_EN} SELECT rec_id, round({_DB.format(_N0)}, 6) AS noise_level, round({_DB.format('sqrt(sum(ss) / sum(n))')}, 6) AS signal_level, round({_DB.format('sqrt(sum(ss) / sum(n))')} - {_DB.format(_N0)}, 6) AS snr FROM en GROUP BY rec_id")
def sig2(spark, folder):
    r = G.signal_to_noise(frames(spark, folder), 50)
    return r.select("rec_id", *[F.round(c, 6).alias(c) for c in ("noise_level", "signal_level", "snr")])


@query("sig3_quiet_noise", f"""WITH {_EN}, lv AS (SELECT *, sqrt(ss / n) AS lev FROM en), lim AS (SELECT rec_id, quantile_cont(lev, 0.2) AS q FROM lv GROUP BY rec_id),
    fl AS (SELECT lv.*, lev < q AS quiet, sum(CASE WHEN lev < q THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY frame_idx) AS run FROM lv JOIN lim USING (rec_id)),
    tot AS (SELECT rec_id, max(run) AS m, sum(ss) AS s1, sum(n) AS n1, sum(ss) FILTER (frame_idx < 50) AS s0, sum(n) FILTER (frame_idx < 50) AS n0 FROM fl GROUP BY rec_id),
    q AS (SELECT rec_id, run, count(*) AS len, sum(ss) AS ss, sum(n) AS n FROM fl WHERE quiet GROUP BY rec_id, run),
    pick AS (SELECT q.*, row_number() OVER (PARTITION BY rec_id ORDER BY run) AS r FROM q JOIN tot USING (rec_id) WHERE len >= 3 AND run < m),
    found AS (SELECT rec_id, sum(ss) AS ss, sum(n) AS n FROM pick WHERE r <= 3 GROUP BY rec_id)
    SELECT rec_id, round({_DB.format('sqrt(coalesce(ss, s0) / coalesce(n, n0))')}, 6) AS noise_level, round({_DB.format('sqrt(s1 / n1)')}, 6) AS signal_level, ss IS NOT NULL AS from_runs FROM tot LEFT JOIN found USING (rec_id)""")
def sig3(spark, folder):
    r = G.quiet_noise(frames(spark, folder), 3, 50)
    return r.select("rec_id", F.round("noise_level", 6).alias("noise_level"), F.round("signal_level", 6).alias("signal_level"), "from_runs")


_ABS = "list_transform(v, lambda x: abs(x))"


@query("sig4_dynamic_range", f"""SELECT vec_id, round(20 * log10(list_max(a) / (list_avg(list_filter(a, lambda x: x > q)) + 1e-10) + 1e-10), 6) AS dynamic_range
    FROM (SELECT vec_id, a, list_aggregate(a, 'quantile_cont', 0.1) AS q FROM (SELECT vec_id, {_ABS} AS a FROM ({_S})))""")
def sig4(spark, folder):
    return _rows(spark, folder).select("vec_id", F.round(G.dynamic_range(F.col("s")), 6).alias("dynamic_range"))


@query("sig5_quantiles", "SELECT user_id AS rec_id, round(quantile_cont(value, 0.2), 6) AS quantile FROM events GROUP BY user_id")
def sig5(spark, folder):
    e = Tables(spark, folder).events.select(F.col("user_id").alias("rec_id"), "value")
    return exact_quantile(e, ["rec_id"], "value", 0.2).withColumn("quantile", F.round("quantile", 6))


@query("sig5_array_quantile", f"SELECT vec_id, round(list_aggregate(v, 'quantile_cont', 0.2), 9) AS q FROM ({_S})")
def sig5_array(spark, folder):
    return _rows(spark, folder).select("vec_id", F.round(G.array_quantile(G.doubles(F.col("s")), 0.2), 9).alias("q"))


_ZCR = "len(list_filter(range(1, len({v})), lambda i: ({v}[i] < 0) <> ({v}[i + 1] < 0))) / CAST(len({v}) AS DOUBLE)"


@query("sig6_zero_crossings", f"SELECT vec_id, round({_ZCR.format(v='v')}, 9) AS zcr FROM ({_S})")
def sig6(spark, folder):
    return _rows(spark, folder).select("vec_id", F.round(G.zero_crossing_rate(F.col("s")), 9).alias("zcr"))


@query("sig6_recording_crossings", f"WITH {FRAMES_SQL}, whole AS (SELECT rec_id, flatten(list(samples ORDER BY frame_idx)) AS v FROM frame GROUP BY rec_id) SELECT rec_id, round({_ZCR.format(v='v')}, 9) AS zcr FROM whole")
def sig6_recordings(spark, folder):
    return G.frame_crossings(frames(spark, folder)).withColumn("zcr", F.round("zcr", 9))


_BA = """SELECT event_id, 0.05 + value / 1000 AS z0, 0.03 + (event_id % 70) / 1000.0::DOUBLE AS z1, -20 - value / 10 AS r0, -18 - (event_id % 9) AS r1, 20 + value / 9 AS d0, 25 + (event_id % 11) AS d1 FROM events"""


@query("sig7_improvement", f"""SELECT event_id, round(greatest(0, nr), 6) AS noise_reduction, round(sn, 6) AS snr_improvement, round(dr, 6) AS dynamic_range, round(nr * 0.4 + abs(sn) * 0.3 + dr * 0.3, 6) AS overall FROM (
    SELECT event_id, (1 - z1 / z0) * 100 AS nr, (r1 - r0) / abs(r0) * 100 AS sn, CASE WHEN abs(d0 - 40) > 0 THEN (1 - abs(d1 - 40) / abs(d0 - 40)) * 100 ELSE 0 END AS dr FROM ({_BA}))""")
def sig7(spark, folder):
    v, k = F.col("value"), F.col("event_id")
    before = F.struct((0.05 + v / 1000).alias("zcr"), (-20 - v / 10).alias("rms_db"), (20 + v / 9).alias("dynamic_range"))
    after = F.struct((0.03 + (k % 70) / 1000.0).alias("zcr"), (-18 - (k % 9)).cast("double").alias("rms_db"), (25 + (k % 11)).cast("double").alias("dynamic_range"))
    rows = Tables(spark, folder).events.select("event_id", G.improvement(before, after).alias("i"))
    return rows.select("event_id", *[F.round(f"i.{c}", 6).alias(c) for c in ("noise_reduction", "snr_improvement", "dynamic_range", "overall")])


@query("sig8_clarity", f"""SELECT event_id, round(nr, 6) AS noise_reduction, round(cl, 6) AS clarity, round((nr + abs(cl)) / 2, 6) AS overall FROM (
    SELECT event_id, greatest(0, (1 - z1 / z0) * 100) AS nr, CASE WHEN c0 > 0 THEN (c1 / c0 - 1) * 100 ELSE 0 END AS cl FROM (SELECT *, CAST(1200 + event_id % 900 AS DOUBLE) AS c1, CASE WHEN event_id % 17 = 0 THEN 0.0::DOUBLE ELSE 1500 + d0 END AS c0 FROM ({_BA})))""")
def sig8(spark, folder):
    v, k = F.col("value"), F.col("event_id")
    c0 = F.when(k % 17 == 0, 0.0).otherwise(1500 + 20 + v / 9)
    rows = Tables(spark, folder).events.select("event_id", G.clarity_improvement(0.05 + v / 1000, 0.03 + (k % 70) / 1000.0, c0, (1200 + k % 900).cast("double")).alias("i"))
    return rows.select("event_id", *[F.round(f"i.{c}", 6).alias(c) for c in ("noise_reduction", "clarity", "overall")])


_PEAK = f"list_max({_ABS})"
#: Samples in millionths, in their order and with their signs.
_MILLIONTHS = "array_to_string(list_transform({}, lambda w: CAST(round(w * 1000000) AS BIGINT)), ',') AS samples"


def _millionths(samples):
    return F.array_join(F.transform(samples, lambda w: F.round(w * 1000000).cast("long").cast("string")), ",").alias("samples")


@query("sig9_compressed", f"""SELECT vec_id, {_MILLIONTHS.format('list_transform(y, lambda x: CASE WHEN abs(x) > 0.5 THEN sign(x) * (0.5 + (abs(x) - 0.5) / 4) ELSE x END)')} FROM (
    SELECT vec_id, list_transform(v, lambda x: x * g * (CASE WHEN p * g > 0.95 THEN 0.95 / (p * g) ELSE 1 END)) AS y FROM (
      SELECT vec_id, v, {_PEAK} AS p, CASE WHEN label % 2 = 0 THEN 1 ELSE 4 END * 0.1 / {_RMS} AS g FROM ({_S})))""")
def sig9(spark, folder):
    s = F.col("s")
    rows = _rows(spark, folder).select("vec_id", s.alias("s"), (G.rms(s) / F.when(F.col("label") % 2 == 0, 1).otherwise(4)).alias("lv"), F.array_max(F.transform(G.doubles(s), F.abs)).alias("p"))
    return rows.select("vec_id", _millionths(G.compressed(F.col("s"), F.col("lv"), F.col("p"))))


@query("sig10_limited", f"""SELECT vec_id, {_MILLIONTHS.format('list_transform(y, lambda x: CASE WHEN abs(x) > 0.9 THEN sign(x) * (0.9 + tanh((abs(x) - 0.9) * 3) * 0.1) ELSE x END)')} FROM (
    SELECT vec_id, list_transform(v, lambda x: x * least(pow(10, (-6 - {_DB.format(_RMS)}) / 20), 0.95 / {_PEAK})) AS y FROM ({_S}))""".replace("lambda x: x * least", "lambda z: z * least"))
def sig10(spark, folder):
    s = F.col("s")
    rows = _rows(spark, folder).select("vec_id", s.alias("s"), G.decibels(G.rms(s)).alias("lv"), F.array_max(F.transform(G.doubles(s), F.abs)).alias("p"))
    return rows.select("vec_id", _millionths(G.limited(F.col("s"), F.col("lv"), F.col("p"), target=-6.0)))


@query("sig11_gate_threshold", "SELECT event_id, round(CASE WHEN -value < -40 THEN 0.15 WHEN -value < -30 THEN 0.20 ELSE 0.25 END * CASE WHEN event_id % 2 = 0 THEN 1.3 ELSE 1 END::DOUBLE, 6) AS threshold FROM events")
def sig11(spark, folder):
    return Tables(spark, folder).events.select("event_id", F.round(G.gate_threshold(-F.col("value"), F.col("event_id") % 2 == 0), 6).alias("threshold"))


@query("sig12_speech_band", "SELECT event_id, CASE WHEN c < 1500 THEN 200 WHEN c < 2000 THEN 300 ELSE 350 END AS low, CASE WHEN c < 1500 THEN 3000 WHEN c < 2000 THEN 3400 ELSE 4000 END AS high FROM (SELECT event_id, 1000 + value * 20 AS c FROM events)")
def sig12(spark, folder):
    return Tables(spark, folder).events.select("event_id", G.speech_band(1000 + F.col("value") * 20).alias("b")).select("event_id", "b.low", "b.high")


@query("sig13_mix_ratio", "SELECT event_id, round(CASE WHEN value > 1 THEN least(greatest(0.5 + (event_id % 50) / value * 0.3, 0.6), 0.85) ELSE 0.7 END, 6) AS ratio FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 0 ELSE value END AS value FROM events)")
def sig13(spark, folder):
    v = F.when((F.col("event_id") % 50 == 0) | (F.col("value") <= 1), 0.0).otherwise(F.col("value"))
    return Tables(spark, folder).events.select("event_id", F.round(G.mix_ratio((F.col("event_id") % 50).cast("double"), v), 6).alias("ratio"))
