"""Frames -> speech intervals -> recognisable chunks.

Times are integer milliseconds.  ``utterances(rec_id, start_ms, end_ms)`` are sorted and
disjoint per recording, as silence detection yields them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..plans.chain import landed
from ..plans.ordered import BLOCK, neighbours, positions, running, with_block
from ..session import cut_lineage

TIME_BLOCK = 600_000  # ms of one recording handled together
KEY = ["rec_id"]


def _with_lookahead(df: DataFrame, at: str, reach: int, width: int = TIME_BLOCK) -> DataFrame:
    """Rows by time block, plus copies of the first ``reach`` of each block for the block before.

    A block is at least as wide as the look-ahead, which so never passes the next block.
    """
    width = max(width, reach)
    own = with_block(df, at, width).withColumn("_own", F.lit(True))
    copies = own.where((F.col(at) % width) <= reach).select(
        *[c for c in own.columns if c not in (BLOCK, "_own")], (F.col(BLOCK) - 1).alias(BLOCK), F.lit(False).alias("_own"))
    return own.unionByName(copies)


def _followers(df: DataFrame, reach: int) -> DataFrame:
    """Each interval with the array of intervals starting within ``reach`` ms of it."""
    w = Window.partitionBy(*KEY, BLOCK).orderBy("start_ms").rangeBetween(0, reach)
    near = F.collect_list(F.struct("pos", "start_ms", "end_ms")).over(w)
    both = _with_lookahead(df, "start_ms", reach).withColumn("_near", near)
    return both.where("_own").withColumn("_near", F.sort_array(F.filter("_near", lambda x: x["pos"] > F.col("pos")))).drop(
        BLOCK, "_own")


def _number(df: DataFrame) -> DataFrame:
    return positions(df, KEY, ["start_ms", "end_ms"], "pos", TIME_BLOCK)


def silent_frames(frames: DataFrame, threshold_db: float = L.SILENCE_DB, window_ms: int = L.SILENCE_MIN,
                  frame_ms: int = L.SILENCE_STEP) -> DataFrame:
    """Frames at which a silent stretch of ``window_ms`` starts.

    ``frames(rec_id, frame_idx, samples)``, frame_idx dense from 0 and ``frame_ms`` each; samples
    in [-1, 1].  Silent means the RMS of the whole stretch is at or below the threshold.
    """
    need = window_ms // frame_ms
    energy = frames.select(
        *KEY, "frame_idx", F.size("samples").alias("n"),
        F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("ss"))
    limit = 10.0 ** (threshold_db / 20.0)
    w = Window.partitionBy(*KEY, BLOCK).orderBy("frame_idx").rowsBetween(0, need - 1)
    over = _with_lookahead(energy, "frame_idx", need, 65536).select(
        *KEY, "frame_idx", "_own", F.sqrt(F.sum("ss").over(w) / F.sum("n").over(w)).alias("rms"), F.count("*").over(w).alias("have"))
    return over.where(F.col("_own") & (F.col("have") == need) & (F.col("rms") <= limit)).select(*KEY, "frame_idx", "rms")


def speech_intervals(frames: DataFrame, threshold_db: float = L.SILENCE_DB, window_ms: int = L.SILENCE_MIN,
                     frame_ms: int = L.SILENCE_STEP) -> DataFrame:
    """Non-silent intervals: the complement of the merged silent stretches."""
    silent = silent_frames(frames, threshold_db, window_ms, frame_ms).select(
        *KEY, (F.col("frame_idx") * frame_ms).alias("at"))
    length = frames.groupBy(*KEY).agg((F.count("*") * frame_ms).alias("total_ms"))
    marked = running(silent, KEY, ["at"], {"before": ("max", "at")}, inclusive=False, width=TIME_BLOCK)
    # a stretch starting more than one window after the previous one opens a new silence
    fresh = marked.withColumn("fresh", F.when(
        F.col("before").isNull() | (F.col("at") > F.col("before") + window_ms), 1).otherwise(0).cast("long"))
    runs = running(fresh, KEY, ["at"], {"run": ("sum", "fresh")}, width=TIME_BLOCK)
    silences = runs.groupBy(*KEY, "run").agg(F.min("at").alias("s"), (F.max("at") + window_ms).alias("e"))
    shifted = neighbours(silences, KEY, "run", ["e"], -1, "prev_")
    gaps = shifted.select(*KEY, F.coalesce("prev_e", F.lit(0)).cast("long").alias("start_ms"), F.col("s").cast("long").alias("end_ms"))
    ends = silences.groupBy(*KEY).agg(F.max("e").alias("start_ms"))
    tail = (length.join(ends, KEY, "left")
            .select(*KEY, F.coalesce("start_ms", F.lit(0)).cast("long").alias("start_ms"), F.col("total_ms").cast("long").alias("end_ms"))
            .where("start_ms != end_ms"))
    return gaps.where("NOT (start_ms = 0 AND end_ms = 0)").unionByName(tail)


def merge_short(utterances: DataFrame, short: int = L.MERGE_SHORT, gap: int = L.MERGE_GAP, limit: int = L.MERGE_LIMIT,
                enough: int = L.MERGE_ENOUGH, step: int = L.SPLIT_STEP) -> DataFrame:
    """Short utterances absorb the next ones; overlong ones are cut into ``step`` pieces.

    Absorbing stops at a pause of ``gap``, before ``limit``, or once ``enough`` is reached.
    ``original_ranges`` holds the utterances a chunk was made from, also where it is one or a piece of one.
    """
    numbered = _followers(_number(utterances.select(*KEY, "start_ms", "end_ms")), limit)
    start = F.struct(F.col("end_ms").alias("e"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def absorb(acc: Column, x: Column) -> Column:
        fits = (x["start_ms"] - acc["e"] < gap) & (x["end_ms"] - F.col("start_ms") < limit)
        grown = F.struct(x["end_ms"].alias("e"), (acc["n"] + 1).alias("n"),
                         (x["end_ms"] - F.col("start_ms") < enough).alias("open"))
        stop = F.struct(acc["e"].alias("e"), acc["n"].alias("n"), F.lit(False).alias("open"))
        return F.when(~acc["open"], acc).when(fits, grown).otherwise(stop)

    duration = F.col("end_ms") - F.col("start_ms")
    grouped = numbered.withColumn("g", F.when(duration < short, F.aggregate("_near", start, absorb)).otherwise(start))
    jumps = grouped.select(*KEY, "pos", (F.col("pos") + F.col("g.n") + 1).alias("nxt"))
    chosen = grouped.join(landed(jumps, KEY), [*KEY, "pos"])
    merged = F.col("g.n") > 0
    pieces = F.when(duration > limit, F.transform(
        F.sequence(F.col("start_ms"), F.col("end_ms") - 1, F.lit(step).cast("long")),
        lambda s: F.struct(s.alias("start_ms"), F.least(s + step, F.col("end_ms")).alias("end_ms")))).otherwise(
        F.array(F.struct(F.col("start_ms").alias("start_ms"), F.col("g.e").alias("end_ms"))))
    ranges = F.concat(F.array(F.struct("start_ms", "end_ms")), F.transform(
        F.slice("_near", F.lit(1), F.col("g.n")), lambda x: F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"))))
    out = chosen.select(
        *KEY, F.explode(pieces).alias("p"), merged.alias("is_merged"),
        F.when(merged, F.sequence("pos", F.col("pos") + F.col("g.n"))).alias("merged_indices"), ranges.alias("original_ranges"))
    flat = out.select(*KEY, "p.start_ms", "p.end_ms", "is_merged", "merged_indices", "original_ranges")
    return positions(flat, KEY, ["start_ms", "end_ms"], "chunk_index", TIME_BLOCK)


def join_pieces(pieces: DataFrame, short: float = L.JOIN_SHORT, enough: float = L.JOIN_ENOUGH,
                limit: float = L.JOIN_LIMIT) -> DataFrame:
    """Variant for back-to-back pieces: absorb until ``enough``, never past ``limit``; halve overlong ones.

    The second half of piece ``i`` gets index ``i + 0.5``.  Needs ``text_length`` per piece.
    """
    numbered = positions(pieces.select(*KEY, "start_ms", "end_ms", "text_length"), KEY, ["start_ms", "end_ms"], "pos", TIME_BLOCK)
    lengths = numbered.select(*KEY, "pos", "text_length")
    last = numbered.groupBy(*KEY).agg(F.max("pos").alias("last"))
    near = _followers(numbered, int(limit)).join(last, KEY)
    start = F.struct(F.col("end_ms").alias("e"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def absorb(acc: Column, x: Column) -> Column:
        have = acc["e"] - F.col("start_ms")
        fits = (have < enough) & (have + (x["end_ms"] - x["start_ms"]) <= limit)
        grown = F.struct(x["end_ms"].alias("e"), (acc["n"] + 1).alias("n"), F.lit(True).alias("open"))
        stop = F.struct(acc["e"].alias("e"), acc["n"].alias("n"), F.lit(False).alias("open"))
        return F.when(~acc["open"], acc).when(fits, grown).otherwise(stop)

    duration = F.col("end_ms") - F.col("start_ms")
    is_short = (duration < short) & (F.col("pos") < F.col("last"))
    grouped = near.withColumn("g", F.when(is_short, F.aggregate("_near", start, absorb)).otherwise(start)).withColumn("merged", is_short)
    jumps = grouped.select(*KEY, "pos", (F.col("pos") + F.col("g.n") + 1).alias("nxt"))
    chosen = grouped.join(landed(jumps, KEY), [*KEY, "pos"])
    # text estimates of the absorbed pieces, added up by position
    members = chosen.select(*KEY, F.col("pos").alias("head"), F.explode(F.sequence("pos", F.col("pos") + F.col("g.n"))).alias("pos"))
    texts = members.join(lengths, [*KEY, "pos"]).groupBy(*KEY, F.col("head").alias("pos")).agg(F.sum("text_length").alias("chars"))
    half = F.floor(duration / 2)

    def piece(index: Column, s: Column, e: Column, chars: Column) -> Column:
        return F.struct(index.cast("double").alias("chunk_index"), s.cast("long").alias("start_ms"),
                        e.cast("long").alias("end_ms"), chars.cast("long").alias("text_length"))

    cut = F.col("start_ms") + half
    out = F.when(~F.col("merged") & (duration > limit), F.array(
        piece(F.col("pos"), F.col("start_ms"), cut, F.floor(F.col("text_length") / 2)),
        piece(F.col("pos") + 0.5, cut, F.col("end_ms"), F.floor(F.col("text_length") / 2)))).otherwise(
        F.array(piece(F.col("pos"), F.col("start_ms"), F.col("g.e"), F.col("chars"))))
    return (chosen.join(texts, [*KEY, "pos"])
            .select(*KEY, F.explode(out).alias("p"), "merged",
                    F.when(F.col("merged"), F.sequence("pos", F.col("pos") + F.col("g.n"))).alias("merged_indices"))
            .select(*KEY, "p.*", F.col("merged").alias("is_merged"), "merged_indices"))


def snapped_chunks(utterances: DataFrame, recordings: DataFrame, ideal: int = L.CHUNK_IDEAL, snap: int = L.CHUNK_SNAP,
                   least: int = L.CHUNK_MIN, overlap: int = L.CHUNK_OVERLAP) -> DataFrame:
    """Overlapping chunks of about ``ideal`` ms that end at a pause when one is near.

    ``recordings(rec_id, duration_ms)``.  A chunk ends at the first pause less than ``snap``
    from its ideal end, and the next one starts ``overlap`` earlier.  So from one pause the
    scan reaches the next pause whose distance is near a multiple of ``ideal - overlap``; the
    chunks in between lie on that grid.
    """
    stride = ideal - overlap
    numbered = _number(utterances.select(*KEY, "start_ms", "end_ms"))
    last = numbered.groupBy(*KEY).agg(F.max("pos").alias("last"))
    # a pause starts where an utterance ends, the last one excepted; node 0 is the start of the recording
    pauses = numbered.join(last, KEY).where("pos < last").select(*KEY, (F.col("pos") + 1).alias("pos"), F.col("end_ms").alias("at"))
    origin = recordings.select(*KEY, F.lit(0).cast("long").alias("pos"), F.lit(overlap).cast("long").alias("at"))
    nodes = pauses.unionByName(origin)
    jumps = _next_pause(nodes, pauses, recordings, stride, snap)
    chosen = jumps.join(landed(jumps.select(*KEY, "pos", "nxt"), KEY), [*KEY, "pos"])
    final = pauses.join(recordings, KEY).where(F.abs(F.col("at") - F.col("duration_ms")) < snap).groupBy(*KEY).agg(F.min("at").alias("final_at"))
    ends = recordings.join(final, KEY, "left")
    total = F.col("duration_ms")
    first = F.col("at") - overlap
    grid = F.when(F.col("nxt") >= 0, F.col("steps")).otherwise(F.greatest(F.ceil((total - first) / stride), F.lit(1)).cast("long"))
    chunks = chosen.join(ends, KEY).select(
        *KEY, "duration_ms", "final_at", "next_at", "nxt", grid.alias("grid"), first.alias("first"),
        F.explode(F.sequence(F.lit(0).cast("long"), grid - 1)).alias("t"))
    begin = F.col("first") + F.col("t") * stride
    snapped = F.when((F.col("nxt") >= 0) & (F.col("t") == F.col("grid") - 1), F.col("next_at")).otherwise(begin + ideal)
    closing = F.when(F.col("final_at").isNotNull() & (F.col("final_at") - begin >= least), F.col("final_at")).otherwise(total)
    actual = F.when(begin + ideal > total, closing).otherwise(snapped)
    kept = chunks.where((total > 0) & ((begin == 0) | (begin < total - least))).select(
        *KEY, begin.cast("long").alias("start_ms"), F.least(actual + overlap, total).cast("long").alias("end_ms"), "duration_ms")
    done = kept.withColumn("overlap_with_next", F.when(F.col("end_ms") < total, overlap).otherwise(0)).drop("duration_ms")
    return positions(done, KEY, ["start_ms"], "chunk_index", TIME_BLOCK)


def _next_pause(nodes: DataFrame, pauses: DataFrame, recordings: DataFrame, stride: int, snap: int,
                per_round: int = 8) -> DataFrame:
    """For every node the first pause within ``snap`` of ``at + m * stride`` for the smallest m >= 1.

    Each round probes the next grid points of the nodes still open by equality on (recording, time
    cell), twice as many as the round before, so the rounds grow with the logarithm of the longest
    stretch without a pause.
    """
    cell = 2 * snap
    targets = pauses.select(*KEY, F.floor(F.col("at") / cell).alias("cell"), F.col("pos").alias("_pos"), F.col("at").alias("_at"))
    still_open = nodes.join(recordings.select(*KEY, "duration_ms"), KEY)
    solved, m0 = None, 1
    while True:
        m = F.explode(F.sequence(F.lit(m0).cast("long"), F.lit(m0 + per_round - 1).cast("long"))).alias("m")
        points = still_open.select("*", m).withColumn("point", F.col("at") + F.col("m") * stride)
        points = points.where(F.col("point") < F.col("duration_ms") + snap)
        # the open interval (point - snap, point + snap) touches at most two cells
        probes = points.select(*KEY, "pos", "m", "point", F.explode(F.array_distinct(F.array(
            F.floor((F.col("point") - snap) / cell), F.floor((F.col("point") + snap) / cell)))).alias("cell"))
        hits = probes.join(targets, [*KEY, "cell"]).where(F.abs(F.col("_at") - F.col("point")) < snap)
        best = hits.groupBy(*KEY, "pos").agg(F.min(F.struct("m", "_pos", "_at")).alias("b"))
        state = cut_lineage(still_open.join(best, [*KEY, "pos"], "left"))
        over = F.col("at") + (m0 + per_round) * stride >= F.col("duration_ms") + snap
        found = state.where(F.col("b").isNotNull() | over).select(
            *KEY, "pos", "at", F.coalesce("b._pos", F.lit(-1)).cast("long").alias("nxt"),
            F.col("b._at").alias("next_at"), F.col("b.m").alias("steps"))
        solved = found if solved is None else solved.unionByName(found)
        still_open = state.where(F.col("b").isNull() & ~over).drop("b")
        if still_open.isEmpty():
            return solved
        m0 += per_round
        per_round *= 2


def fixed_windows(recordings: DataFrame, step: int = L.CHUNK_IDEAL, overlap: int = L.CHUNK_OVERLAP) -> DataFrame:
    """Windows every ``step`` ms, ``overlap`` longer than the step, clipped to the recording."""
    return (recordings.where("duration_ms > 0")
            .select(*KEY, "duration_ms", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms") - 1, F.lit(step).cast("long"))).alias("chunk_index", "start_ms"))
            .select(*KEY, F.col("chunk_index").cast("long").alias("chunk_index"), "start_ms", F.least(F.col("start_ms") + step + overlap, F.col("duration_ms")).alias("end_ms")))


def tumbling(recordings: DataFrame, step: int = L.FALLBACK_STEP, count: int | None = None) -> DataFrame:
    """Back-to-back windows, all of them or the first ``count`` (test chunks)."""
    out = fixed_windows(recordings, step, 0)
    return out if count is None else out.where(F.col("chunk_index") < count)


def padded(chunks: DataFrame, recordings: DataFrame, padding: int = L.PADDING) -> DataFrame:
    """The stretch to cut out for each chunk: ``padding`` ms more on both sides, inside the recording."""
    return chunks.join(recordings.select(*KEY, "duration_ms"), KEY).select(
        *chunks.columns, F.greatest(F.col("start_ms") - padding, F.lit(0)).alias("cut_start"),
        F.least(F.col("end_ms") + padding, F.col("duration_ms")).alias("cut_end"))


def laid_end_to_end(pieces: DataFrame, order: str = "idx", duration: str = "duration_ms") -> DataFrame:
    """Start and end of pieces that follow each other without gaps."""
    summed = running(pieces, KEY, [order], {"end_ms": ("sum", duration)})
    return summed.withColumn("start_ms", F.col("end_ms") - F.col(duration))
