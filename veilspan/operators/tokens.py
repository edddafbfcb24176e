"""Token tables: label ids, sub-word alignment, BIO spans and scores.

A sentence keeps its tokens and tags as arrays on one row, so decoding is row-local.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.arrays import bind

IGNORED = -100
TAGGED = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("type", StringType())]))


def label_ids(labels: Column) -> Column:
    """Ordered labels to ``map<label,id>``."""
    return F.map_from_entries(F.transform(labels, lambda x, i: F.struct(x, i)))


def align_labels(word_ids: Column, tags: Column, ids: Column) -> Column:
    """Label id per sub-word: first piece keeps the tag, later pieces continue it, specials are ignored.

    The ids of a tag are looked up once per word, for its first and for its later pieces.
    """
    def both(table: Column, t: Column) -> Column:
        known = lambda name: F.coalesce(F.element_at(table, name), F.element_at(table, F.lit("O")))
        tag = F.trim(F.coalesce(F.nullif(t, F.lit("")), F.lit("O")))
        return bind(tag, lambda x: F.struct(known(x).alias("first"), known(
            F.when(x.startswith("B-"), F.replace(x, F.lit("B-"), F.lit("I-"))).otherwise(x)).alias("later")))

    def aligned(words: Column, of: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            # a word without a tag is outside
            mine = F.coalesce(F.get(of["tags"], w), of["outside"])
            again = F.coalesce(F.get(words, i - 1) == w, F.lit(False))
            return F.when(w.isNull(), F.lit(IGNORED)).when(again, mine["later"]).otherwise(mine["first"])

        return F.transform(words, one)

    # the ids are an expression here: made once, not once per piece
    found = bind(ids, lambda table: F.struct(
        F.transform(tags, lambda t: both(table, t)).alias("tags"), both(table, F.lit("O")).alias("outside")))
    return bind(F.struct(word_ids.alias("words"), found.alias("of")), lambda x: aligned(x["words"], x["of"]))


def _counted(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements and first element of every list of an array, and the list of every element; null has none."""
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)


@F.arrow_udf(TAGGED)
def _spans(tags: pa.Array) -> pa.Array:
    """``bio_spans`` of a batch of rows, over all their tokens at once."""
    sizes, begin, row = _counted(tags)
    coded = tags.flatten().dictionary_encode()
    texts = [x or "" for x in coded.dictionary.to_pylist()] + [""]
    names = [x[2:] if x.startswith(("B-", "I-")) else "" for x in texts]
    known = {name: n for n, name in enumerate(dict.fromkeys(["", *names]))}
    at = pc.fill_null(coded.indices, len(texts) - 1).to_numpy(zero_copy_only=False)
    kind, opens = np.array([known[n] for n in names])[at], np.array([x.startswith("B-") for x in texts])[at]
    # the tokens before the first and after the last one of a row have no type
    ahead, behind = np.zeros_like(kind), np.zeros_like(kind)
    ahead[1:], behind[:-1] = kind[:-1], kind[1:]
    ahead[begin[sizes > 0]] = behind[(begin + sizes - 1)[sizes > 0]] = 0
    starts = (kind > 0) & (opens | (ahead != kind))
    follows = np.append(starts[1:], False)
    first, last = np.flatnonzero(starts), np.flatnonzero((kind > 0) & ((behind != kind) | follows))
    inside = pa.StructArray.from_arrays([
        pa.array((first - begin[row[first]]).astype(np.int32)), pa.array((last - begin[row[first]] + 1).astype(np.int32)),
        pa.array(list(known), pa.string()).take(pa.array(kind[first]))], ["start", "end", "type"])
    bounds = np.append(0, np.cumsum(np.bincount(row[first], minlength=len(sizes))))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), inside, mask=pc.is_null(tags))


@F.arrow_udf(LongType())
def _equal(one: pa.Array, other: pa.Array) -> pa.Array:
    """Equal elements of two lists of one length; null equals nothing."""
    sizes, _, row = _counted(one)
    same = pc.fill_null(pc.equal(one.flatten(), other.flatten()), False).to_numpy(zero_copy_only=False)
    return pc.if_else(pc.is_null(one), None, pa.array(np.bincount(row[same], minlength=len(sizes)).astype(np.int64)))


def bio_spans(tags: Column) -> Column:
    """Entity spans over token positions: a span starts at ``B-`` or where the type changes.

    Starts and ends are picked independently by looking one token back and one ahead; the n-th
    start belongs to the n-th end.
    """
    return _spans(tags)


def span_scores(df: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Entity precision, recall, F1 and token accuracy over rows of gold and predicted tag arrays.

    Tokens whose gold tag is null (ignored sub-words) are left out first.  Row-local counts are
    summed, so nothing is shuffled but one row per task.
    """
    g, p = F.col(gold), F.col(predicted)
    pairs = F.filter(F.arrays_zip(g.alias("g"), p.alias("p")), lambda x: x["g"].isNotNull())
    # nearly always there is nothing to leave out
    whole = (F.size(g) == F.size(p)) & ~F.exists(g, lambda x: x.isNull())
    clean = df.select(F.when(whole, g).otherwise(F.transform(pairs, lambda x: x["g"])).alias("g"),
                      F.when(whole, p).otherwise(F.transform(pairs, lambda x: x["p"])).alias("p"))

    def names(spans: str) -> Column:
        # one string per span: Spark intersects arrays of strings by hashing, arrays of structs by comparing all
        return F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"], s["type"]))

    found = clean.select(F.size("g").alias("n"), bio_spans(F.col("g")).alias("gs"), bio_spans(F.col("p")).alias("ps"), _equal("g", "p").alias("same"))
    counted = found.select(
        F.size("gs").alias("gold"), F.size("ps").alias("pred"), F.size(F.array_intersect(names("gs"), names("ps"))).alias("hit"), "n", "same")
    sums = counted.agg(*[F.sum(c).alias(c) for c in ("gold", "pred", "hit", "n", "same")])
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide("hit", "pred"), zero), F.coalesce(F.try_divide("hit", "gold"), zero)
    return sums.select(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), zero).alias("f1"),
                       F.coalesce(F.try_divide("same", "n"), zero).alias("accuracy"))


def distinct_tags(sentences: DataFrame, tags: str = "tags") -> DataFrame:
    """Tags in use, ``O`` first, then sorted."""
    rows = sentences.select(F.explode(tags).alias("tag")).select(F.trim("tag").alias("tag")).where("tag != ''").distinct()
    return rows.orderBy(F.col("tag") != "O", "tag")


def extend_schema(schema_labels: Column, data_labels: Column) -> Column:
    """Schema labels in order, then the data's labels missing from it."""
    return F.array_distinct(F.concat(schema_labels, F.array_except(data_labels, schema_labels)))


def missing_labels(data: DataFrame, schema: DataFrame, column: str = "tag") -> DataFrame:
    return data.select(column).join(schema.select(column), column, "left_anti").distinct()


def hash_split(df: DataFrame, key: str, percent: int = 5, seed: int = 42) -> DataFrame:
    """``is_validation`` for about ``percent`` of the rows, fixed by the key alone."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed))))
    return df.withColumn("is_validation", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 < percent)
