"""A training corpus from raw documents, stage by stage.

Each stage takes all rows of the one before and returns the columns of ``documents``; the last
one adds the shard layout.  Between stages the rows stand in a Parquet table in the shared folder.

Extra columns pass every stage unchanged, whatever their names; only one with the name of a column
of the layout is called ``given_<name>`` in the result of the last stage.  Null and empty texts are not toxic, have no near-duplicates and no
benchmark words, and are mixed and sharded like others.  An empty table stays empty at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import decontaminate, mixing, neardup, sharding, toxicity
from veilspan.llm.common import table
from veilspan.session import written

SHARDS = 40
#: Columns of ``documents``, and those that the layout adds.
CORE = ("doc_id", "text", "lang", "source", "n_chars")
LAYOUT = ("size", "text_crc32", "law", "shard", "slot")
#: Prefix of an extra column whose name the layout uses.
GIVEN = "given_"


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with all extra columns in one struct, whose name no operator uses."""
    extra = [c for c in docs.columns if c not in CORE]
    if not extra:
        return docs
    return docs.select(*[c for c in docs.columns if c in CORE], F.struct(*extra).alias("pipeline_extra"))


def _unpacked(made: DataFrame, docs: DataFrame, added: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``docs`` in their order, then ``added``; an extra column of such a name is prefixed until it is free."""
    taken, columns = {*docs.columns, *added}, []
    for name in docs.columns:
        new = name
        while name in added and new in taken:
            new = GIVEN + new
        taken.add(new)
        columns.append((F.col(name) if name in CORE else F.col(f"pipeline_extra.`{name}`")).alias(new))
    return made.select(*columns, *added)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labels that are not held out, does not reject.

    Null, empty and wordless texts score 0 and stay; repeated rows are judged each.  Without
    labels of both kinds nothing can be learned and all rows stay.
    """
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return _unpacked(toxicity.reject(_packed(docs), toxicity.train(docs, labels)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 connect: the one with the smallest id.

    Of repeated rows one stays, also of rows with a null id; rows without words all stay.
    """
    return _unpacked(neardup.keep_one(_packed(docs), threshold=neardup.NEAR), docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, whole short items included; those that are mostly benchmark go.

    Null and empty texts and texts without a hit are unchanged; repeated rows are treated each.
    """
    return _unpacked(decontaminate.remove(_packed(docs), table(spark, sf_dir, "benchmark")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources get shares of the square root of their bytes.

    A null source is one of its own; rows with equal ids, null among them, are repeated equally often.
    """
    return _unpacked(mixing.mix(_packed(docs), alpha=0.5, epochs=1.0, seed=7), docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there.

    Null texts have the size of empty ones; repeated rows get places of their own.
    """
    dealt = sharding.assign(_packed(docs), SHARDS).withColumn("law", F.lit("bytes"))
    return _unpacked(dealt, docs, LAYOUT)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The model of the first stage is learned, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; nulls, odd texts and extra columns as stated at the top."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
