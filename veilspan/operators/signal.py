"""Signal quality of sample arrays.

Array functions take one recording per row.  The ``frames`` operators take
``frames(rec_id, frame_idx, samples)`` and reduce per frame before they group, so a recording
of any length is a plain partial aggregate.  Samples are widened to double first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import exact_quantile, neighbours, positions, running

TINY = 1e-10
KEY = ["rec_id"]


def doubles(samples: Column) -> Column:
    return samples.cast("array<double>")


def energy(samples: Column) -> Column:
    return F.aggregate(doubles(samples), F.lit(0.0), lambda a, x: a + x * x)


def rms(samples: Column) -> Column:
    return F.sqrt(energy(samples) / F.size(samples))


def decibels(level: Column) -> Column:
    return F.log10(level + TINY) * 20


def array_quantile(values: Column, p: float) -> Column:
    """Linearly interpolated quantile of an array of doubles."""
    ordered = F.sort_array(values)

    def pick(v: Column) -> Column:
        spot = (F.size(v) - 1) * F.lit(p)
        low = F.floor(spot).cast("int")
        a, b = F.get(v, low), F.get(v, F.ceil(spot).cast("int"))
        return a + (b - a) * (spot - low)

    return F.get(F.transform(F.array(ordered), pick), F.lit(0))


def dynamic_range(samples: Column) -> Column:
    """dB between the peak and the mean magnitude above the tenth percentile."""
    def of(v: Column) -> Column:
        floor_ = array_quantile(v, 0.1)
        loud = F.get(F.transform(F.array(floor_), lambda q: F.filter(v, lambda x: x > q)), F.lit(0))
        mean = F.get(F.transform(F.array(loud), lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x) / F.size(w)), F.lit(0))
        return F.log10(F.array_max(v) / (mean + TINY) + TINY) * 20

    magnitudes = F.transform(doubles(samples), F.abs)
    return F.get(F.transform(F.array(magnitudes), of), F.lit(0))


def zero_crossing_rate(samples: Column) -> Column:
    signs = F.transform(doubles(samples), lambda x: x < 0)
    changes = F.zip_with(F.slice(signs, F.lit(1), F.size(signs) - 1), F.slice(signs, F.lit(2), F.size(signs) - 1),
                         lambda a, b: F.when(a != b, 1).otherwise(0))
    return F.aggregate(changes, F.lit(0), lambda a, x: a + x) / F.size(samples)


def metrics(samples: Column) -> Column:
    return F.struct(rms(samples).alias("rms"), decibels(rms(samples)).alias("rms_db"),
                    dynamic_range(samples).alias("dynamic_range"), zero_crossing_rate(samples).alias("zcr"))


def improvement(before: Column, after: Column, target: float = 40.0) -> Column:
    """Noise reduction, level and dynamic-range change in percent, and their weighted sum."""
    noise = (1 - after["zcr"] / before["zcr"]) * 100
    level = (after["rms_db"] - before["rms_db"]) / F.abs(before["rms_db"]) * 100
    was, now = F.abs(before["dynamic_range"] - target), F.abs(after["dynamic_range"] - target)
    spread = F.when(was > 0, (1 - now / was) * 100).otherwise(0.0)
    return F.struct(F.greatest(F.lit(0.0), noise).alias("noise_reduction"), level.alias("snr_improvement"),
                    spread.alias("dynamic_range"), (noise * 0.4 + F.abs(level) * 0.3 + spread * 0.3).alias("overall"))


def clarity_improvement(zcr_before: Column, zcr_after: Column, centroid_before: Column, centroid_after: Column) -> Column:
    noise = F.greatest(F.lit(0.0), (1 - zcr_after / zcr_before) * 100)
    clarity = F.when(centroid_before > 0, (centroid_after / centroid_before - 1) * 100).otherwise(0.0)
    return F.struct(noise.alias("noise_reduction"), clarity.alias("clarity"), ((noise + F.abs(clarity)) / 2).alias("overall"))


def compressed(samples: Column, level: Column, peak: Column, target: float = 0.1, ceiling: float = 0.95,
               knee: float = 0.5, ratio: float = 4.0) -> Column:
    """Level to ``target`` RMS, cap the peak, compress above the knee; ``level``/``peak`` of the recording."""
    gain = F.when(level > 0, F.lit(target) / level).otherwise(1.0)
    cap = F.when(peak * gain > ceiling, F.lit(ceiling) / (peak * gain)).otherwise(1.0)

    def shape(x: Column) -> Column:
        y = x * gain * cap
        return F.when(F.abs(y) > knee, F.signum(y) * (knee + (F.abs(y) - knee) / ratio)).otherwise(y)

    return F.transform(doubles(samples), shape)


def limited(samples: Column, loudness: Column, peak: Column, target: float = -20.0, ceiling: float = 0.95,
            knee: float = 0.9) -> Column:
    """Gain to the target loudness under a peak limit, soft above the knee."""
    gain = F.least(F.pow(F.lit(10.0), (F.lit(target) - loudness) / 20), F.lit(ceiling) / peak)

    def shape(x: Column) -> Column:
        y = x * gain
        return F.when(F.abs(y) > knee, F.signum(y) * (knee + F.tanh((F.abs(y) - knee) * 3) * 0.1)).otherwise(y)

    return F.transform(doubles(samples), shape)


def gate_threshold(noise_level: Column, aggressive: Column) -> Column:
    base = F.when(noise_level < -40, 0.15).when(noise_level < -30, 0.20).otherwise(0.25)
    return F.when(aggressive, base * 1.3).otherwise(base)


def speech_band(centroid: Column) -> Column:
    def band(low: int, high: int) -> Column:
        return F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))

    return F.when(centroid < 1500, band(200, 3000)).when(centroid < 2000, band(300, 3400)).otherwise(band(350, 4000))


def mix_ratio(filtered_rms: Column, original_rms: Column) -> Column:
    ratio = F.lit(0.5) + filtered_rms / original_rms * 0.3
    return F.when((filtered_rms > 0) & (original_rms > 0), F.least(F.greatest(ratio, F.lit(0.6)), F.lit(0.85))).otherwise(0.7)


# --- whole recordings from frames --------------------------------------------------------


def recording_levels(frames: DataFrame) -> DataFrame:
    per_frame = frames.select(*KEY, F.size("samples").alias("n"), energy(F.col("samples")).alias("ss"),
                              F.array_max(F.transform(doubles(F.col("samples")), F.abs)).alias("peak"))
    level = F.sqrt(F.sum("ss") / F.sum("n"))
    return per_frame.groupBy(*KEY).agg(level.alias("rms"), decibels(level).alias("rms_db"), F.max("peak").alias("peak"))


def signal_to_noise(frames: DataFrame, noise_frames: int) -> DataFrame:
    """Level of the recording over the level of its first ``noise_frames`` frames, in dB."""
    per_frame = frames.select(*KEY, "frame_idx", F.size("samples").alias("n"), energy(F.col("samples")).alias("ss"))
    early = F.col("frame_idx") < noise_frames
    noise = decibels(F.sqrt(F.sum(F.when(early, F.col("ss"))) / F.sum(F.when(early, F.col("n")))))
    level = decibels(F.sqrt(F.sum("ss") / F.sum("n")))
    return per_frame.groupBy(*KEY).agg(noise.alias("noise_level"), level.alias("signal_level"), (level - noise).alias("snr"))


def quiet_noise(frames: DataFrame, min_frames: int, noise_frames: int, runs_used: int = 3) -> DataFrame:
    """Noise level from the first quiet runs of a recording.

    Quiet frames are below the recording's 20th percentile of frame RMS; a run counts when it is
    long enough and closed by a louder frame.  Without one the first frames are the noise.
    """
    per_frame = frames.select(*KEY, "frame_idx", F.size("samples").alias("n"), energy(F.col("samples")).alias("ss")).withColumn(
        "level", F.sqrt(F.col("ss") / F.col("n")))
    limit = exact_quantile(per_frame, KEY, "level", 0.2, "limit")
    flagged = per_frame.join(limit, KEY).withColumn("loud", (F.col("level") >= F.col("limit")).cast("long"))
    # quiet frames between the same two loud ones form a run
    runs = running(flagged, KEY, ["frame_idx"], {"run": ("sum", "loud")}, width=65536)
    loud_total = flagged.groupBy(*KEY).agg(F.sum("loud").alias("loud_total"))
    quiet = runs.where("loud = 0").groupBy(*KEY, "run").agg(
        F.count("*").alias("len"), F.sum("ss").alias("ss"), F.sum("n").alias("n"))
    closed = quiet.join(loud_total, KEY).where((F.col("len") >= min_frames) & (F.col("run") < F.col("loud_total")))
    chosen = positions(closed, KEY, ["run"], "rank").where(F.col("rank") < runs_used)
    found = chosen.groupBy(*KEY).agg(F.sum("ss").alias("ss"), F.sum("n").alias("n"))
    early = F.col("frame_idx") < noise_frames
    base = per_frame.groupBy(*KEY).agg(
        F.sum(F.when(early, F.col("ss"))).alias("ss0"), F.sum(F.when(early, F.col("n"))).alias("n0"), F.sum("ss").alias("ss1"), F.sum("n").alias("n1"))
    noise = decibels(F.sqrt(F.coalesce("ss", "ss0") / F.coalesce("n", "n0")))
    level = decibels(F.sqrt(F.col("ss1") / F.col("n1")))
    return base.join(found, KEY, "left").select(
        *KEY, noise.alias("noise_level"), level.alias("signal_level"), (level - noise).alias("snr"), F.col("ss").isNotNull().alias("from_runs"))


def frame_crossings(frames: DataFrame) -> DataFrame:
    """Zero-crossing rate of whole recordings: crossings inside frames plus those between neighbours."""
    s = doubles(F.col("samples"))
    per_frame = frames.select(*KEY, "frame_idx", F.size("samples").alias("n"), (zero_crossing_rate(F.col("samples")) * F.size("samples")).alias("inside"),
                              (F.get(s, F.lit(0)) < 0).alias("first"), (F.get(s, F.size(s) - 1) < 0).alias("last"))
    linked = neighbours(per_frame, KEY, "frame_idx", ["first"], 1, "next_")
    between = F.when(F.col("next_first").isNotNull() & (F.col("last") != F.col("next_first")), 1).otherwise(0)
    return linked.groupBy(*KEY).agg((F.sum(F.col("inside") + between) / F.sum("n")).alias("zcr"))
