"""Exact centroid clustering of integer vectors by subvector dictionaries.

Vectors are cut into blocks of a few dimensions.  A chunk of vectors keeps, without loss, one
dictionary of the distinct subvectors of each block, and per vector the codes of its subvectors.
In a round every distinct subvector is compared with the centroids once; a vector's squared
distance is the sum of the partial distances of its codes.  The sums of a cluster come from how
often each code stands in it.  All arithmetic is on integers, so results do not depend on order.

Chunks are bounded, lie in a written table and never meet: a round moves one small row per
cluster and dimension from each task, whatever the number of vectors, and a lost task is made
again from the table.  Wide blocks give fewer additions, narrow ones smaller dictionaries; a chunk
takes the widest blocks whose subvectors are still few, whole vectors where they repeat.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.session import written

from .common import shared, unpacked

#: Vectors in one chunk, at most.
CHUNK = 16_384
#: A block's dictionary is small if it has at most this share of the chunk's vectors.
SMALL = 0.25
#: Largest component after scaling; within it no squared distance of 64 dimensions leaves 64 bits.
LARGEST = 1 << 27


@dataclass
class Clusters:
    """Final centroids, and the sum of squared distances of each cluster's vectors."""

    centroids: list[list[int]]
    inertia: list[int]
    sizes: list[int]

    def table(self, spark) -> DataFrame:
        """``(cluster, size, centroid, cluster_inertia, inertia)``, one row per centroid."""
        rows = [(n, self.sizes[n], c, self.inertia[n], sum(self.inertia)) for n, c in enumerate(self.centroids)]
        return spark.createDataFrame(rows, "cluster int, size long, centroid array<bigint>, cluster_inertia long, inertia long")


def usable(vector: Column, dims: int) -> Column:
    """True for vectors of exactly ``dims`` components, none null, NaN or infinite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~odd, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """Each component as the integer ``floor(scale * x)``, with ``x`` as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def encoded(whole: np.ndarray) -> tuple[int, list[np.ndarray], np.ndarray]:
    """Block width, dictionaries and codes (a row of codes per vector) of the vectors of a chunk."""
    n, dims = whole.shape
    width = dims
    while True:
        found = []
        for at in range(0, dims, width):
            part = np.ascontiguousarray(whole[:, at:at + width])
            names, codes = np.unique(part.view([("", part.dtype)] * part.shape[1]).ravel(), return_inverse=True)
            if width > 1 and len(names) > max(SMALL * n, 1):
                break
            found.append((names.view(part.dtype).reshape(len(names), -1), codes.ravel()))
        else:
            codes = np.stack([c for _, c in found], axis=1)
            kind = np.uint16 if CHUNK <= 1 << 16 else np.uint32
            return width, [d for d, _ in found], codes.astype(kind)
        width = (width + 1) // 2


_CHUNK = pa.schema([("keys", pa.list_(pa.int64())), ("width", pa.int32()), ("sizes", pa.list_(pa.int32())),
                    ("dictionaries", pa.binary()), ("codes", pa.binary())])


def chunks(vectors: DataFrame, *, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """The usable vectors as encoded chunks: keys, block width, dictionary sizes, dictionaries and codes."""

    def made(keys: list, whole: np.ndarray) -> pa.RecordBatch:
        if np.abs(whole).max() >= LARGEST:
            raise ValueError(f"a component of {vector} is beyond {LARGEST // scale}: distances would not fit 64 bits")
        width, dictionaries, codes = encoded(whole)
        row = [keys, width, [len(d) for d in dictionaries], b"".join(d.tobytes() for d in dictionaries), codes.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, _CHUNK, strict=True)], schema=_CHUNK)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, size = [], [], 0
        for batch in stream:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                if size + part.num_rows > CHUNK:
                    yield made(keys, np.concatenate(held))
                    keys, held, size = [], [], 0
                keys += part.column(0).to_pylist()
                held.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                size += part.num_rows
        if size:
            yield made(keys, np.concatenate(held))

    kept = vectors.where(usable(F.col(vector), dims)).select(F.col(key).cast("long").alias("key"), integers(F.col(vector), scale).alias("x"))
    return kept.mapInArrow(run, "keys array<bigint>, width int, sizes array<int>, dictionaries binary, codes binary")


def _opened(row: dict, dims: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Dictionaries and codes of a chunk row."""
    values, out, at = np.frombuffer(row["dictionaries"], dtype=np.int64), [], 0
    for block, size in enumerate(row["sizes"]):
        width = min(row["width"], dims - block * row["width"])
        out.append(values[at:at + size * width].reshape(size, width))
        at += size * width
    kind = np.uint16 if CHUNK <= 1 << 16 else np.uint32
    return out, np.frombuffer(row["codes"], dtype=kind).reshape(-1, len(row["sizes"]))


def nearest(dictionaries: list[np.ndarray], codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smallest of equals) and squared distance of every vector."""
    total = np.zeros((len(codes), len(centroids)), dtype=np.int64)
    at = 0
    for block, names in enumerate(dictionaries):
        width = names.shape[1]
        partial = ((names[:, None, :] - centroids[None, :, at:at + width]) ** 2).sum(axis=2)
        total += partial[codes[:, block]]
        at += width
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def cluster_sums(dictionaries: list[np.ndarray], codes: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums of the vectors of each cluster, from how often each code stands there."""
    out = []
    for block, names in enumerate(dictionaries):
        often = np.bincount(cluster * len(names) + codes[:, block], minlength=k * len(names)).reshape(k, len(names))
        out.append(often @ names)
    return np.concatenate(out, axis=1)


def _round(table: DataFrame, centroids: list[list[int]], dims: int) -> tuple[list[int], list[int], dict]:
    """Sizes, inertia and componentwise sums of the clusters around the centroids."""
    packed = shared(table.sparkSession, np.array(centroids, dtype=np.int64))
    schema = pa.schema([("cluster", pa.int32()), ("what", pa.int32()), ("n", pa.decimal128(38, 0))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = unpacked(packed.value)
        # Python's integers: no bound on the vectors of a task
        held = np.zeros((len(center), dims + 2), dtype=object)
        for batch in stream:
            for row in batch.to_pylist():
                dictionaries, codes = _opened(row, dims)
                cluster, distance = nearest(dictionaries, codes, center)
                held[:, 0] += np.bincount(cluster, minlength=len(center)).astype(object)
                for c in range(len(center)):
                    held[c, 1] += sum(distance[cluster == c].tolist())
                held[:, 2:] += cluster_sums(dictionaries, codes, cluster, len(center)).astype(object)
        rows = [(c, w, decimal.Decimal(int(held[c, w]))) for c in range(len(center)) if held[c, 0] for w in range(dims + 2)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    parts = table.mapInArrow(run, "cluster int, what int, n decimal(38,0)")
    # one number per centroid and dimension reaches the driver
    found = {(r["cluster"], r["what"]): int(r["n"]) for r in parts.groupBy("cluster", "what").agg(F.sum("n").alias("n")).collect()}
    packed.unpersist()
    k = range(len(centroids))
    return [found.get((c, 0), 0) for c in k], [found.get((c, 1), 0) for c in k], found


def first_centroids(vectors: DataFrame, k: int, seed: int, *, key: str, vector: str, dims: int, scale: int) -> list[list[int]]:
    """The ``k`` usable vectors with the smallest SHA-256 of ``seed:key``, in that order; of equal keys the smaller vector first."""
    kept = vectors.where(usable(F.col(vector), dims)).select(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256).alias("h"),
        integers(F.col(vector), scale).alias("x"))
    return [list(r["x"]) for r in kept.orderBy("h", "x").limit(k).collect()]


def fit(vectors: DataFrame, *, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024,
        key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Clusters]:
    """The usable vectors as a written table of chunks, and the clusters after ``rounds`` rounds.

    A round gives every vector to the nearest centroid (of equals the smaller number) and moves
    every centroid with vectors to the componentwise floor of their mean; the others stay.
    Vectors that are null, of another length, or with a null or non-finite component are left out.
    With fewer than ``k`` usable vectors there are as many centroids as vectors.  Repeated rows
    count as often as they stand there, a null key is like an empty one.  Extra columns are ignored.
    A component of ``LARGEST / scale`` or more is an error.
    """
    if dims * (2 * LARGEST) ** 2 >= 1 << 63:
        raise ValueError(f"distances of {dims} dimensions may leave 64 bits")
    centroids = first_centroids(vectors, k, seed, key=key, vector=vector, dims=dims, scale=scale)
    table = written(chunks(vectors, key=key, vector=vector, dims=dims, scale=scale))
    if not centroids:
        return table, Clusters([], [], [])
    for _ in range(rounds):
        sizes, _, sums = _round(table, centroids, dims)
        centroids = [[sums[c, w] // sizes[c] for w in range(2, dims + 2)] if sizes[c] else centroids[c] for c in range(len(centroids))]
    sizes, inertia, _ = _round(table, centroids, dims)
    return table, Clusters(centroids, inertia, sizes)


def assign(table: DataFrame, clusters: Clusters, *, key: str = "vec_id") -> DataFrame:
    """``(key, cluster, distance)`` of every vector of the chunks of ``fit``; an empty table gives no rows."""
    fields = T.StructType([T.StructField(key, T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not clusters.centroids:
        return table.sparkSession.createDataFrame([], fields)
    packed, dims = shared(table.sparkSession, np.array(clusters.centroids, dtype=np.int64)), len(clusters.centroids[0])
    schema = pa.schema([(key, pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = unpacked(packed.value)
        for batch in stream:
            for row in batch.to_pylist():
                cluster, distance = nearest(*_opened(row, dims), center)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], type=pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(distance)], schema=schema)

    return table.mapInArrow(run, fields)
