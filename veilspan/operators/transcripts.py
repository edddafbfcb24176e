"""Recognised chunks -> stitched, time-stamped transcripts and subtitles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.arrays import bind
from ..functions.clocks import minute_clock, subtitle_clock
from ..functions.text import bare_sentences, sentences, squeeze, strip, terminated_sentences, words
from ..plans.chain import landed
from ..plans.ordered import BLOCK, ROWS_PER_BLOCK, documents_from_lines, positions, running
from ..session import cut_lineage, discard, written

KEY = ["rec_id"]
SENTENCES = "array<struct<text:string,start_time:double,end_time:double>>"

# --- sentence times --------------------------------------------------------------------


def _spread(parts: Column, start: Column, per_char: Column, last: Column | None) -> Column:
    """Consecutive intervals proportional to each part's length, optionally clipped at ``last``."""
    begin = F.struct(start.cast("double").alias("at"), F.array().cast(SENTENCES).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        until = acc["at"] + F.length(part) * per_char
        shown = until if last is None else F.least(until, last)
        return F.struct(until.alias("at"), F.array_append(acc["out"], F.struct(
            strip(part).alias("text"), acc["at"].alias("start_time"), shown.alias("end_time"))).alias("out"))

    return F.aggregate(parts, begin, step, lambda acc: acc["out"])


def _whole(text: Column, start: Column, end: Column) -> Column:
    return F.array(F.struct(strip(text).alias("text"), start.cast("double").alias("start_time"),
                            end.cast("double").alias("end_time"))).cast(SENTENCES)


def share_by_characters(text: Column, start: Column, end: Column, merged: Column) -> Column:
    """Sentences of a merged chunk share its time by their characters; other chunks stay whole."""
    def share(parts: Column) -> Column:
        total = F.aggregate(parts, F.lit(0), lambda a, p: a + F.length(p))
        rate = F.when(total > 0, (end - start) / total).otherwise(F.lit(0.0))
        return bind(rate, lambda r: F.when(merged & (F.size(parts) > 1), _spread(parts, start, r, end)).otherwise(
            _whole(text, start, end)))

    return bind(sentences(text), share)


def share_of_whole(text: Column, start: Column, end: Column, merged: Column) -> Column:
    """Variant: terminated sentences, share relative to the whole text, no clipping."""
    rate = (end - start) / F.length(text)
    return bind(terminated_sentences(text), lambda parts: F.when(
        merged & (F.size(parts) > 1), _spread(parts, start, rate, None)).otherwise(_whole(text, start, end)))


def share_evenly(text: Column, duration: Column | None = None) -> Column:
    """Fallback: equal time per sentence over the recording's duration."""
    total = F.lit(L.FALLBACK_DURATION) if duration is None else F.coalesce(duration, F.lit(L.FALLBACK_DURATION))
    return bind(bare_sentences(text), lambda parts: F.transform(parts, lambda p, i: F.struct(
        p.alias("text"), (i * (total / F.size(parts))).alias("start_time"),
        ((i + 1) * (total / F.size(parts))).alias("end_time")))).cast(SENTENCES)


def matched_results(results: DataFrame, chunks: DataFrame, how: str = "inner") -> DataFrame:
    """Successful, non-empty results with their chunk; unmatched ones go unless ``how='left'``."""
    good = results.where(F.col("success") & (F.coalesce("text", F.lit("")) != ""))
    return good.join(chunks, [*KEY, "chunk_index"], how)


def timed_sentences(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sentence rows from results and chunks, overlaps repaired: the transcript of a recording.

    ``chunks(rec_id, chunk_index, start_ms, end_ms, is_merged)``.
    """
    rows = matched_results(results, chunks).select(
        *KEY, "chunk_index", F.posexplode(share_by_characters(
            F.col("text"), F.col("start_ms") / 1000.0, F.col("end_ms") / 1000.0, F.col("is_merged"))).alias("part", "s"))
    flat = rows.select(*KEY, "chunk_index", "part", "s.*")
    return repair_overlaps(flat, ["start_time", "chunk_index", "part"])


def repair_overlaps(rows: DataFrame, order: Sequence[str], seconds_per_block: float = 600.0) -> DataFrame:
    """Start each sentence no earlier than the previous kept end; drop the ones left without time.

    A dropped row never reaches past the running maximum of the ends, so the maximum over all
    earlier rows is the previous kept end.  A recording's only sentence is kept as it is.
    """
    seen = running(rows, KEY, list(order), {"reach": ("max", "end_time")}, inclusive=False, width=seconds_per_block)
    count = rows.groupBy(*KEY).agg(F.count("*").alias("_n"))
    moved = seen.join(count, KEY).withColumn(
        "start_time", F.when(F.col("_n") > 1, F.greatest("start_time", "reach")).otherwise(F.col("start_time")))
    return moved.where((F.col("_n") == 1) | (F.col("start_time") < F.col("end_time"))).drop("reach", "_n")


# --- stitching overlapping chunk texts --------------------------------------------------


def _between(text: Column, probe: Column) -> Column:
    """Places from the first to the last one where ``probe`` stands in ``text``, which holds it."""
    behind = F.position(F.reverse(probe), F.reverse(text))
    return F.sequence(F.position(probe, text), F.length(text) - F.length(probe) - behind + 2)


def _shared_tail(prev: Column, cur: Column, longest: Column, shortest: int, at_most: int) -> Column:
    """``struct<k, at>``: the longest suffix of ``prev`` found in ``cur`` within the first positions.

    The last ``shortest`` characters are looked for first; from every place where they stand,
    nearly always one, the match is extended to the left, by halving steps.  Of equally long ones
    the first place counts.
    """
    head = F.substring(cur, F.lit(1), F.lit(at_most) + longest)

    def search(w: Column) -> Column:
        tail, front, most = w["tail"], w["head"], w["most"]
        probe = F.right(tail, F.lit(shortest))
        spots = F.filter(_between(front, probe), lambda p: F.substring(front, p, F.lit(shortest)) == probe)

        def extended(p: Column) -> Column:
            room = F.least(most - shortest, p - 1)

            def step(done: Column, size: Column) -> Column:
                more = done + size
                same = F.substring(tail, most - shortest - more + 1, size) == F.substring(front, p - more, size)
                return F.when((more <= room) & same, more).otherwise(done)

            return F.aggregate(F.array(*[F.lit(1 << bit) for bit in range(6, -1, -1)]), F.lit(0), step)

        found = F.transform(spots, lambda p: bind(extended(p), lambda e: F.struct(-(e + shortest), p - e)))
        best = F.array_min(F.filter(found, lambda f: f["col2"] <= at_most + 1))
        return bind(best, lambda f: F.when(f.isNotNull(), F.struct((-f["col1"]).alias("k"), f["col2"].alias("at"))))

    asked = F.struct(F.right(prev, longest).alias("tail"), head.alias("head"), longest.alias("most"))
    return F.when((longest >= shortest) & F.contains(head, F.right(prev, F.lit(shortest))), bind(asked, search))


def _exact_tail(prev: Column, cur: Column) -> Column:
    longest = F.least(F.lit(100), F.floor(F.length(prev) / 2), F.floor(F.length(cur) / 2)).cast("int")
    return _shared_tail(prev, cur, longest, 11, 49)


def _after_tail(cur: Column, found: Column) -> Column:
    return strip(F.substring(cur, found["at"] + found["k"], F.length(cur)))


def cut_exact(prev: Column, cur: Column) -> Column:
    """Remove through the previous text's tail (11-100 characters) found near the start."""
    return bind(_exact_tail(prev, cur), lambda h: F.when(h.isNull(), cur).otherwise(_after_tail(cur, h)))


def _cut_fuzzy(prev: Column, cur: Column) -> Column:
    """Remove through a run of 3-10 words of which at least 70 % equal the previous tail."""
    pw, cw = words(prev), words(cur)

    def search(p: Column, c: Column) -> Column:
        most = F.least(F.lit(10), F.floor(F.size(p) / 2)).cast("int")
        lengths = F.when(most >= 3, F.sequence(most, F.lit(3), F.lit(-1)))
        # a run that ends before word ``end`` has its last word at ``ago`` 0; equal words of one run share that end
        tail, front = F.reverse(F.slice(p, -F.least(F.lit(10), F.size(p)), F.lit(10))), F.slice(c, 1, 19)

        def spots(f: Column, word: Column, ago: Column) -> Column:
            here = F.transform(f, lambda x, j: F.when(x == word, F.struct((j + ago + 1).alias("end"), ago.alias("ago"))))
            return F.filter(here, lambda h: h.isNotNull())

        def runs(hits: Column) -> Column:
            # 70 % of at least 3 words are at least 3 words
            ends = F.filter(F.array_distinct(F.transform(hits, lambda h: h["end"])), lambda k: (k <= F.size(c)) & (
                F.size(F.filter(hits, lambda h: h["end"] == k)) >= 3))

            def fits(k: Column, n: Column) -> Column:
                same = F.size(F.filter(hits, lambda h: (h["end"] == k) & (h["ago"] < n)))
                return (k - n).between(0, 9) & (same / n >= 0.7)

            # the longest run counts, of equally long ones the first
            return F.array_min(F.flatten(F.transform(ends, lambda k: F.transform(
                F.filter(lengths, lambda n: fits(k, n)), lambda n: F.struct((-n).alias("n"), k.alias("end"))))))["end"]

        def shared(w: Column) -> Column:
            known = F.filter(F.transform(w["tail"], lambda x, ago: F.when(F.array_contains(w["front"], x), F.struct(
                x.alias("word"), ago.alias("ago")))), lambda x: x.isNotNull())
            hits = bind(known, lambda ks: F.when(F.size(ks) >= 3, F.flatten(F.transform(ks, lambda x: spots(w["front"], x["word"], x["ago"])))))
            return bind(hits, lambda h: F.when(h.isNotNull(), runs(h)))

        drop = bind(F.struct(tail.alias("tail"), front.alias("front")), shared)
        rest = bind(drop, lambda d: F.when(
            d.isNotNull(), F.array_join(F.slice(c, d + 1, F.greatest(F.size(c) - d, F.lit(0))), " ")))
        return F.when((F.size(p) >= 3) & (F.size(c) >= 3), rest)

    return F.coalesce(bind(F.struct(pw.alias("p"), cw.alias("c")), lambda w: search(w["p"], w["c"])), cur)


def cut_fuzzy(prev: Column, cur: Column) -> Column:
    """Exact removal, else the fuzzy word overlap."""
    return bind(_exact_tail(prev, cur), lambda h: F.when(h.isNull(), _cut_fuzzy(prev, cur)).otherwise(_after_tail(cur, h)))


def cut_prefix(prev: Column, cur: Column) -> Column:
    """Remove a prefix equal to the previous tail (6-50 characters), else up to five shared words."""
    longest = F.least(F.lit(50), F.floor(F.length(prev) / 2)).cast("int")

    def sizes(w: Column) -> Column:
        # a tail that starts the text starts where the text's first six characters stand
        tail, front = w["tail"], w["front"]
        starts = F.when(F.contains(tail, front) & (F.length(front) == 6), _between(tail, front))
        return F.filter(F.transform(starts, lambda p: F.length(tail) - p + 1), lambda n: F.startswith(cur, F.right(tail, n)))

    asked = F.struct(F.right(prev, longest).alias("tail"), F.left(cur, F.lit(6)).alias("front"))
    k = F.get(F.when(longest >= 6, bind(asked, sizes)), F.lit(0))

    def by_words(p: Column, c: Column) -> Column:
        n = F.least(F.size(p), F.size(c), F.lit(5))
        shared = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)), lambda j: F.slice(p, -j, j) == F.slice(c, 1, j))
        return bind(F.get(shared, F.lit(0)), lambda j: F.when(j.isNull(), cur).otherwise(
            F.array_join(F.slice(c, j + 1, F.size(c)), " ")))

    worded = bind(F.struct(words(prev).alias("p"), words(cur).alias("c")), lambda w: by_words(w["p"], w["c"]))
    return bind(k, lambda n: F.when(n.isNotNull(), strip(F.substring(cur, n + 1, F.length(cur)))).otherwise(worded))


#: Followers that are tried at once after the next one was swallowed; four times as many in every further round.
FOLLOWERS = 2


def _with_next(texts: DataFrame) -> DataFrame:
    """``texts`` with the text of the next position, null at the last one.

    A block's first row is copied to the block before, so one exchange of the texts serves all.
    """
    block = F.floor(F.col("pos") / ROWS_PER_BLOCK)
    homes = F.when((F.col("pos") > 0) & (F.col("pos") % ROWS_PER_BLOCK == 0), F.array(block - 1, block)).otherwise(F.array(block))
    spread = texts.select("*", F.explode(homes).alias(BLOCK))
    w = Window.partitionBy(*KEY, BLOCK).orderBy("pos")
    return spread.withColumn("_cur", F.lead("text").over(w)).where(F.col(BLOCK) == block).drop(BLOCK)


def _accepted(texts: DataFrame, cut: Callable[[Column, Column], Column], tables: list[DataFrame] | None = None) -> DataFrame:
    """``(rec_id, pos, added)`` for chunks that keep some text after their overlap with the last accepted one is cut.

    ``texts(rec_id, pos, text)`` with dense positions.  Each chunk's jump is its first follower
    that is not swallowed whole; nearly always the next one.  The few chunks whose next one is
    swallowed try the next 2, 8, 32, ... followers at once, so the rounds grow with the logarithm
    of a run of swallowed chunks.  A text equal to a swallowed one before it is swallowed too, so
    a run of equal texts counts as one follower.  ``tables`` gets what is written on the way and the result reads.
    """
    tables = [] if tables is None else tables
    tried = _with_next(texts).withColumn("_cut", F.when(F.col("_cur").isNotNull(), cut(F.col("text"), F.col("_cur"))))
    ok = F.col("_cur").isNull() | (F.col("_cut") != "")
    differs = F.when(F.col("text") != F.col("_cur"), 1).otherwise(0).cast("long")
    # of the texts only those are kept that are asked for again
    first = written(tried.select(*KEY, "pos", "_cut", ok.alias("_ok"), differs.alias("_new"), F.when(~ok | (F.col("pos") == 0), F.col("text")).alias("text")))
    tables.append(first)
    jumps = first.where("_ok").select(*KEY, "pos", (F.col("pos") + 1).alias("nxt"), "_cut")
    still_open, width = first.where("NOT _ok").select(*KEY, "pos", "text"), FOLLOWERS
    if not still_open.isEmpty():
        last = first.groupBy(*KEY).agg(F.max("pos").alias("_last"))
        before = running(first.select(*KEY, "pos", "_ok", "_new"), KEY, ["pos"], {"run": ("sum", "_new")}, inclusive=False)
        runs = written(before.withColumn("run", F.coalesce("run", F.lit(0).cast("long"))))
        tables.append(runs)
        heads = cut_lineage(runs.groupBy(*KEY, "run").agg(F.min("pos").alias("_at")))
        followers = texts.select(*KEY, F.col("pos").alias("_at"), F.col("text").alias("_cur"))
        # the run of the next chunk is swallowed; the search goes on after it
        at_next = runs.where("NOT _ok").select(*KEY, "pos", (F.col("run") + F.col("_new") + 1).alias("run"))
        still_open = still_open.join(at_next, [*KEY, "pos"]).join(last, KEY)
    while not still_open.isEmpty():
        asked = still_open.select(*KEY, "pos", "text", "_last", F.explode(F.sequence("run", F.col("run") + (width - 1))).alias("run"))
        met = asked.join(heads, [*KEY, "run"], "left").join(followers, [*KEY, "_at"], "left")
        judged = met.withColumn("_cut", F.when(F.col("_cur").isNotNull(), cut(F.col("text"), F.col("_cur"))))
        # beyond the last run the chain ends
        hit = F.when(F.col("_at").isNull() | (F.col("_cut") != ""), F.struct("run", F.coalesce("_at", F.col("_last") + 1).alias("nxt"), "_cut"))
        state = cut_lineage(judged.groupBy(*KEY, "pos").agg(F.min(hit).alias("hit"), (F.max("run") + 1).alias("run"), F.max("_last").alias("_last")))
        jumps = jumps.unionByName(state.where("hit IS NOT NULL").select(*KEY, "pos", "hit.nxt", "hit._cut"))
        still_open = state.where("hit IS NULL").drop("hit").join(first.select(*KEY, "pos", "text"), [*KEY, "pos"])
        width *= 4
    visited = landed(jumps.drop("_cut"), KEY)
    later = jumps.where("_cut IS NOT NULL").join(visited, [*KEY, "pos"]).select(*KEY, F.col("nxt").alias("pos"), F.col("_cut").alias("added"))
    return later.unionByName(first.where("pos = 0").select(*KEY, "pos", F.col("text").alias("added")))


def stitched(results: DataFrame, cut: Callable[[Column, Column], Column] = cut_exact) -> DataFrame:
    """Text each chunk adds to the transcript: ``(rec_id, chunk_index, pos, text, removed)``.

    The comparison text is always the previous accepted chunk's full text.  ``removed`` marks
    chunks swallowed whole (their text is empty).
    """
    # written, so that the passes that only count do not make the texts again
    clean = written(results.select(*KEY, "chunk_index", strip(F.coalesce("text", F.lit(""))).alias("text")).where("text != ''"))
    numbered = written(positions(clean, KEY, ["chunk_index"], "pos"))
    added = _accepted(numbered.select(*KEY, "pos", "text"), cut)
    return numbered.join(added, [*KEY, "pos"], "left").select(
        *KEY, "chunk_index", "pos", F.coalesce("added", F.lit("")).alias("text"), F.col("added").isNull().alias("removed"))


def stitched_with_markers(results: DataFrame) -> DataFrame:
    """Fuzzy stitching; swallowed chunks stay visible as a marker."""
    return stitched(results, cut_fuzzy).withColumn(
        "text", F.when(F.col("removed"), F.lit(L.REMOVED_CHUNK)).otherwise(F.col("text")))


def merged_transcript(results: DataFrame) -> DataFrame:
    """One text per recording: prefix stitching, ``[...]`` for failed inner chunks, tidy punctuation.

    A text is shuffled when it is numbered, compared, accepted and gathered; all else goes by its numbers.
    """
    good = F.col("success") & (F.coalesce("text", F.lit("")) != "")
    # a blank text is no failure, and is not said
    made = written(results.select(*KEY, "chunk_index", (~good).alias("failed"), F.when(good, F.nullif(strip(F.col("text")), F.lit(""))).alias("text")))
    counts = made.withColumns({"_one": F.lit(1).cast("long"), "_said": F.col("text").isNotNull().cast("long")})
    # the chunk's place, and its place among those with a text, or that of the last one before it
    rows = written(running(counts, KEY, ["chunk_index"], {"row": ("sum", "_one"), "pos": ("sum", "_said")}).select(
        *KEY, (F.col("row") - 1).alias("row"), (F.col("pos") - 1).alias("pos"), "failed", "text"))
    discard(made)
    last = rows.groupBy(*KEY).agg(F.max("row").alias("last"))
    failed = written(rows.select(*KEY, "row", "pos", "failed").join(last, KEY).where("failed AND row > 0 AND row < last").select(
        *KEY, "pos", F.lit(True).alias("gap"), "row", F.lit(L.MISSING_CHUNK).alias("piece")))
    added = _accepted(rows.where("text IS NOT NULL").select(*KEY, "pos", "text"), cut_prefix, tables := [rows])
    kept = written(added.select(*KEY, "pos", F.lit(False).alias("gap"), F.lit(0).cast("long").alias("row"), F.col("added").alias("piece")))
    # gaps and pieces are written: nothing reads what led to them
    discard(*tables)
    piece = F.col("piece")
    pieces = kept.unionByName(failed).select(
        *KEY, "pos", "gap", "row", piece.rlike(r"[.!?]\z").alias("ends"), piece.rlike(r"\A\p{IsUppercase}").alias("upper"),
        F.regexp_replace(squeeze(piece), " ([.,?!])", "$1").alias("tidy"))

    def line(p: Column, after: Column, i: Column) -> Column:
        # a piece gets its full stop when the next recognised piece does not start in upper case
        open_end = after.isNotNull() & ~after["gap"] & ~p["ends"] & ~after["upper"]
        dotted = F.when(open_end, F.concat(p["tidy"], F.lit("."))).otherwise(p["tidy"])
        return bind(dotted, lambda t: F.when((i == 0) | t.rlike(r"\A[.,?!]"), t).otherwise(F.concat(F.lit(" "), t)))

    # a task holds the pieces of one text at a time, as in documents_from_lines
    gathered = pieces.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "gap", "row", "ends", "upper", "tidy"))).alias("p"))
    return gathered.select(*KEY, F.array_join(F.transform("p", lambda p, i: line(p, F.get("p", i + 1), i)), "").alias("text"))


# --- rendering --------------------------------------------------------------------------


def _numbered_sentences(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    return positions(rows, KEY, list(order), "pos", 600.0, order[0])


def plain_text(rows: DataFrame, order: Sequence[str] = ("start_time",)) -> DataFrame:
    kept = rows.where(F.coalesce("text", F.lit("")) != "")
    lines = _numbered_sentences(kept, order).withColumn(
        "line", F.concat(F.when(F.col("pos") > 0, " ").otherwise(""), F.col("text")))
    return documents_from_lines(lines, KEY, "pos", "line")


def stamped_text(rows: DataFrame, order: Sequence[str] = ("start_time",)) -> DataFrame:
    """``[MM:SS] text`` lines, each followed by an empty line."""
    lines = _numbered_sentences(rows, order).withColumn("line", F.concat(
        F.when(F.col("pos") > 0, "\n").otherwise(""), minute_clock(F.col("start_time")), F.lit(" "), F.col("text"), F.lit("\n")))
    return documents_from_lines(lines, KEY, "pos", "line")


def subtitles(rows: DataFrame, order: Sequence[str] = ("start_time",)) -> DataFrame:
    """SRT: index, clock range, text, empty line; a missing end is three seconds after the start."""
    end = F.coalesce(F.col("end_time"), F.col("start_time") + 3)
    lines = _numbered_sentences(rows, order).withColumn("line", F.concat(
        F.when(F.col("pos") > 0, "\n").otherwise(""), (F.col("pos") + 1).cast("string"), F.lit("\n"),
        subtitle_clock(F.col("start_time")), F.lit(" --> "), subtitle_clock(end), F.lit("\n"), F.col("text"), F.lit("\n")))
    return documents_from_lines(lines, KEY, "pos", "line")


def edit_status(transcripts: DataFrame, edits: DataFrame) -> DataFrame:
    """Was a transcript edited?  ``edits(rec_id, edited_text)`` may lack recordings."""
    both = transcripts.join(edits, KEY, "left")
    changed = F.col("edited_text").isNotNull() & (F.col("edited_text") != F.col("text"))
    return both.select(*KEY, F.col("text").alias("original_transcript"),
                       F.when(changed, F.col("edited_text")).alias("edited_transcript"), changed.alias("was_edited"))


def last_attempts(results: DataFrame) -> DataFrame:
    """The final attempt of every chunk, with the number of retries."""
    rest = [c for c in results.columns if c not in (*KEY, "chunk_index", "attempt")]
    return (results.groupBy(*KEY, "chunk_index")
            .agg(F.max_by(F.struct(*rest), "attempt").alias("r"), (F.count("*") - 1).alias("retry_count"))
            .select(*KEY, "chunk_index", "r.*", "retry_count"))
