"""BIO token files and label schemas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans.ordered import running
from ..session import written


#: Sentences of a split, or what the split holds of them; ``gap`` counts the blank lines before them in the split.
_PIECES = "path string, at long, gap long, tokens array<string>, tags array<string>"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits, in their order, to sentences; only the last sentence so far is held."""
    key, gap, last, held = None, 0, -1, []

    def made(gaps: np.ndarray, starts: np.ndarray, words: pa.StructArray) -> pa.RecordBatch:
        ends = pa.array(np.append(starts, len(words)), pa.int32())
        return pa.RecordBatch.from_arrays([
            pa.array([key[0]] * len(gaps), pa.string()), pa.array([key[1]] * len(gaps), pa.int64()), pa.array(gaps, pa.int64()),
            *[pa.ListArray.from_arrays(ends, words.field(i)) for i in (0, 1)]], ["path", "at", "gap", "tokens", "tags"])

    def closed() -> Iterator[pa.RecordBatch]:
        if held:
            yield made(np.array([last]), np.array([0]), pa.concat_arrays(held))
            held.clear()

    for batch in batches:
        paths, at = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        file = paths.indices.to_numpy()
        turns = (np.flatnonzero((file[1:] != file[:-1]) | (at[1:] != at[:-1])) + 1).tolist()
        for first, end in zip([0, *turns], [*turns, batch.num_rows]) if batch.num_rows else ():
            if (here := (paths.dictionary[int(file[first])].as_py(), int(at[first]))) != key:
                yield from closed()
                key, gap = here, 0
            blank = batch.column(2).slice(first, end - first).to_numpy(zero_copy_only=False)
            before = gap + np.cumsum(blank)
            at_words, gap = np.flatnonzero(~blank), int(before[-1])
            if not len(at_words):
                continue
            words = pa.StructArray.from_arrays([batch.column(i).slice(first, end - first).take(pa.array(at_words)) for i in (3, 4)], ["token", "tag"])
            gaps = before[at_words]
            starts = np.append(0, np.flatnonzero(gaps[1:] != gaps[:-1]) + 1)
            if held and gaps[0] != last:
                yield from closed()
            if held and len(starts) > 1:
                held.append(words.slice(0, starts[1]))
                yield from closed()
                words, gaps, starts = words.slice(starts[1]), gaps[starts[1]:], starts[1:] - starts[1]
            if len(starts) > 1:
                yield made(gaps[starts[:-1]], starts[:-1], words.slice(0, starts[-1]))
            held.append(words.slice(starts[-1]))
            last = int(gaps[-1])
    yield from closed()


def read_bio(spark: SparkSession, path: str) -> DataFrame:
    """``token<TAB>tag`` lines, blank line between sentences -> ``(path, sent, tokens, tags)``.

    Files are read in splits like any text file, and the lines of a split are put together where they are read.
    The sentence number is a running count of blank lines over splits; only sentences that lie in several splits
    are gathered by their number.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"))
    # one row per split
    splits = written(lines.groupBy("path", "at").agg(F.sum((F.col("line") == "").cast("long")).alias("_gaps")))
    earlier = running(splits, ["path"], ["at"], {"_before": ("sum", "_gaps")}, inclusive=False, width=1 << 32)
    places = written(earlier.select("path", "at", "_gaps", F.coalesce("_before", F.lit(0)).alias("_before"),
                                    (F.count("*").over(Window.partitionBy("path")) > 1).alias("_many")))
    parts = F.split("line", "\t", -1)
    words = lines.select("path", "at", (F.col("line") == "").alias("blank"), F.get(parts, F.lit(0)).alias("token"),
                         F.coalesce(F.get(parts, F.lit(1)), F.lit("O")).alias("tag"))
    # the first and the last sentence of a split of several may go on in another one
    edge = F.col("_many") & ((F.col("gap") == 0) | (F.col("gap") == F.col("_gaps")))
    placed = words.mapInArrow(_pieces, _PIECES).join(places, ["path", "at"]).select(
        "path", (F.col("_before") + F.col("gap")).alias("sent"), "at", "tokens", "tags", edge.alias("_edge"))
    whole = placed.where("NOT _edge").select("path", "sent", "tokens", "tags")
    if places.where("_many").isEmpty():
        return whole
    cut = placed.where("_edge").groupBy("path", "sent").agg(F.sort_array(F.collect_list(F.struct("at", "tokens", "tags"))).alias("p"))
    return whole.unionByName(cut.select("path", "sent", *[F.flatten(F.transform("p", lambda x: x[c])).alias(c) for c in ("tokens", "tags")]))


#: Lines of a split that one window holds.
LINES_PER_BLOCK = 16384


def sentences_from_lines(lines: DataFrame) -> DataFrame:
    """``lines(path, at, nth, line)``, ordered by (at, nth) within a path.

    Splits and files get short numbers, so that line rows carry no path through the shuffles, and a split is
    counted in blocks of lines: a task sorts and holds a block, not a split.
    """
    blank = lines.withColumn("_blank", (F.col("line") == "").cast("long"))
    # one row per split; written, so that its numbers stay
    splits = written(blank.groupBy("path", "at").agg(F.min("nth").alias("_first"), F.sum("_blank").alias("_gaps"))
                     .withColumn("_split", F.monotonically_increasing_id()))
    earlier = running(splits, ["path"], ["at"], {"_before": ("sum", "_gaps")}, inclusive=False, width=1 << 32)
    places = written(earlier.select("path", "at", "_split", F.min("_split").over(Window.partitionBy("path")).alias("_file"),
                                    F.coalesce("_before", F.lit(0)).alias("_before")))
    rows = blank.join(splits.select("path", "at", "_split", "_first"), ["path", "at"]).select(
        "_split", (F.col("nth") - F.col("_first")).alias("_row"), "line", "_blank")
    counted = running(rows, ["_split"], ["_row"], {"_inside": ("sum", "_blank")}, width=LINES_PER_BLOCK)
    parts = F.split("line", "\t", -1)
    tokens = counted.where("line != ''").join(places.select("_split", "_file", "at", "_before"), "_split").select(
        "_file", (F.col("_before") + F.coalesce("_inside", F.lit(0))).alias("_gap"), "at", "_row",
        F.get(parts, F.lit(0)).alias("token"), F.coalesce(F.get(parts, F.lit(1)), F.lit("O")).alias("tag"))
    rows = tokens.groupBy("_file", "_gap").agg(F.sort_array(F.collect_list(F.struct("at", "_row", "token", "tag"))).alias("t"))
    return rows.join(places.select("_file", "path").distinct(), "_file").select(
        "path", F.col("_gap").alias("sent"), F.transform("t", lambda x: x["token"]).alias("tokens"),
        F.transform("t", lambda x: x["tag"]).alias("tags"))


def bio_lines(sentences: DataFrame, tokens: str = "tokens", tags: str = "tags") -> DataFrame:
    """One text value per sentence, ready for a text sink (ends with the separating blank line)."""
    pairs = F.zip_with(tokens, tags, lambda a, b: F.concat_ws("\t", a, b))
    return sentences.select(F.concat(F.array_join(pairs, "\n"), F.lit("\n")).alias("value"))


def schema_labels(content: Column) -> Column:
    """Ordered labels from a schema file's content, ``O`` guaranteed.

    Accepts ``{"labels": [...]}``, ``{label: id}`` (sorted by id), ``[...]`` or one label per line.
    """
    named = F.from_json(content, "struct<labels:array<string>>")["labels"]
    by_id = F.from_json(content, "map<string,int>")
    listed = F.from_json(content, "array<string>")
    ordered = F.transform(F.sort_array(F.transform(F.map_entries(by_id), lambda e: F.struct(e["value"], e["key"]))), lambda e: e["key"])
    plain = F.filter(F.transform(F.split(content, "\r\n|\n|\r", -1), strip), lambda x: x != "")
    head = F.ltrim(content)
    labels = (F.when(named.isNotNull(), named).when(head.startswith("{"), ordered).when(head.startswith("["), listed).otherwise(plain))
    labels = F.coalesce(labels, F.array(F.lit("O")))
    return F.array_distinct(F.when(F.array_contains(labels, "O"), labels).otherwise(F.concat(F.array(F.lit("O")), labels)))


def read_schema(spark: SparkSession, path: str) -> DataFrame:
    """Label files are short lists, so each is read whole: ``(path, labels)``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", schema_labels(F.col("value")).alias("labels"))
