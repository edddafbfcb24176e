"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that may be broadcast as a set of keys; above it the same join shuffles.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column (null stays null)."""
    return F.col(column).cast("string").cast("binary")


def batches(rows: Callable[[list], Iterable[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lift ``rows(columns) -> tuples`` over Arrow batches, in blocks of bounded size."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                made = list(rows([c.to_pylist() for c in part.columns]))
                columns = list(zip(*made, strict=True)) if made else [()] * len(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def by_bytes(stream: Iterator[pa.RecordBatch], column: int, most: int = 1 << 22, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most ``rows`` rows and about ``most`` bytes in a column; a longer value is a part by itself."""
    for batch in stream:
        start = size = 0
        values = batch.column(column)
        width = 1 if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type) else 4
        lengths = (pc.binary_length(values) if width == 1 else pc.list_value_length(values)).fill_null(0).to_pylist()
        for at, length in enumerate(lengths):
            if at > start and (at - start == rows or size + length * width > most):
                yield batch.slice(start, at - start)
                start, size = at, 0
            size += length * width
        if batch.num_rows:
            yield batch.slice(start)


def shared(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast of a value whose class travels with it, so executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unpacked(packed: bytes) -> object:
    """The value of a ``shared`` broadcast, inside a task."""
    return pickle.loads(packed)


def known_small(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Hint a broadcast of ``keys`` only after its rows were counted and are few enough."""
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def once(packed: Broadcast, use: Callable = lambda value: value) -> Callable[[], object]:
    """A function that gives ``use(value of a shared broadcast)``; a task makes it at the first call and keeps it."""
    kept: list = []

    def get() -> object:
        if not kept:
            kept.append(use(unpacked(packed.value)))
        return kept[0]

    return get


def fraction(*parts: Column | str, seed: int) -> Column:
    """A hash of ``parts`` as a number in [0, 1): 52 bits of MD5, the same in every engine."""
    values = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *values))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
