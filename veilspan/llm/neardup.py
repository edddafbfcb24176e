"""MinHash near-duplicate detection with sequential Bayesian verification.

1. One pass over the texts gives, per document, the number of its distinct shingles, a 128-bit
   digest of the set, and a MinHash signature.  Documents with equal sets are one node.
2. Nodes whose signatures agree on a whole band meet in a bucket.  Buckets are cut into units of
   bounded size; a unit holds one chunk of a bucket, or two.
3. Inside a unit the signatures of candidates are compared batch by batch.  After each batch the
   posterior of the similarity (uniform prior) is known; a pair whose chance of reaching the
   threshold is below the chosen miss probability is dropped.  A pair that shares several bands
   counts in its first one only.
4. Nodes with a surviving pair go into the same unit again with their full shingle sets; pairs
   are verified exactly.  A unit returns a spanning forest of its links, never all pairs.
5. The links' connected components are the groups.

Memory: a task holds one unit.  Misses: only by banding (see ``band_miss``) and by step 3.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.session import written

from . import components
from .common import batches, known_small, text_bytes

SHINGLE = 5
BANDS, ROWS = 24, 6
#: Bands and rows for lower and lower thresholds; the first that misses few enough pairs is taken.
LAYOUTS = ((BANDS, ROWS), (32, 5), (48, 4))
#: Chance of a pair at the threshold to share no band, at most, while a layout has it.
BAND_MISS = 2e-5
#: Similarity from which documents are near-duplicates where nothing else is asked for.
NEAR = 0.8
#: Signature positions compared at a time.
BATCH = 24
#: Chance of dropping a pair at the threshold after a batch.
MISS = 1e-6
#: Nodes and shingles in one chunk of a bucket, on average.
CHUNK_NODES = 256
CHUNK_SHINGLES = 1 << 20
#: Bytes of distinct words beyond which a task forgets their numbers.
REMEMBERED = 2_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def band_miss(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that a pair of this similarity shares no band."""
    return (1 - similarity**rows) ** bands


def layout(threshold: float) -> tuple[int, int]:
    """Bands and rows of the signatures for a threshold; an error where every layout would miss more than ``BAND_MISS``."""
    for bands, rows in LAYOUTS:
        if band_miss(threshold, bands, rows) <= BAND_MISS:
            return bands, rows
    raise ValueError(f"no layout finds pairs of similarity {threshold}: {LAYOUTS[-1]} misses {band_miss(threshold, *LAYOUTS[-1]):.1%}")


def hashes(total: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of so many hash functions; the same everywhere."""
    rng = np.random.default_rng(20240229)
    multiply = rng.integers(0, 1 << 32, total, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return multiply, rng.integers(0, 1 << 32, total, dtype=np.uint64).astype(np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX2
    return h ^ (h >> np.uint64(31))


class Words:
    """64-bit numbers of words; a task remembers words of up to ``REMEMBERED`` bytes in all."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size = 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            if self.size > REMEMBERED:
                known.clear()
                self.size = 0
            for w in words:
                if w not in known:
                    known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
                    self.size += len(w)
            return np.array([known[w] for w in words], dtype=np.uint64)


def shingles(body: bytes | None, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit numbers of the word shingles of a text; none without words."""
    found = body.translate(_LOWER).split() if body else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = words.numbers(found)
    n = len(h) - SHINGLE + 1
    if n < 1:
        # the whole sequence is the one shingle; its length keeps it apart from full ones
        code = np.full(1, len(h), dtype=np.uint64)
        for x in h:
            code = _mixed(code * _MIX + x)
        return code
    code = h[:n]
    for k in range(1, SHINGLE):
        code = _mixed(code * _MIX + h[k:n + k])
    return np.unique(code)


def signature(codes: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash values, 32 bits each, of a set of shingle numbers, one for each of the hash ``functions``."""
    multiply, add = functions
    low = (codes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(add), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 1024):
        part = low[at:at + 1024]
        np.minimum(least, (multiply[:, None] * part[None, :] + add[:, None]).min(axis=1), out=least)
    return least


def _bands(sig: np.ndarray, bands: int, rows: int) -> list[int]:
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for column in sig.astype(np.uint64).reshape(bands, rows).T:
        h = _mixed(h * _MIX + column)
    return h.view(np.int64).tolist()


_SKETCH = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("fetch", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("signature", pa.binary()),
                     ("bands", pa.list_(pa.int64()))])
SKETCH = "row long, doc_id long, fetch long, n_shingles long, node binary, signature binary, bands array<long>"


def sketches(docs: DataFrame, *, threshold: float = 0.85, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: set size, digest of the set (null if empty), 16-bit signature, band keys.

    ``threshold`` decides the layout of signatures and bands.
    ``row`` names a column that tells rows apart; ``fetch`` finds the text again: the id, or a hash of the text where the id is null.
    """
    n_bands, n_rows = layout(threshold)
    functions, words = hashes(n_bands * n_rows), Words()

    def rows(columns: list) -> Iterator[tuple]:
        for row, doc, fetch, body in zip(*columns, strict=True):
            codes = shingles(body, words)
            if not len(codes):
                yield row, doc, fetch, 0, None, None, None
                continue
            sig = signature(codes, functions)
            yield (row, doc, fetch, len(codes), hashlib.blake2b(codes.tobytes(), digest_size=16).digest(),
                   (sig & np.uint32(0xFFFF)).astype(np.uint16).tobytes(), _bands(sig, n_bands, n_rows))

    number = F.lit(None).cast("long") if row is None else F.col(row)
    narrow = docs.select(number.alias("row"), F.col(key).cast("long").alias("doc_id"), _fetch(key, text), text_bytes(text).alias("text"))
    return narrow.mapInArrow(batches(rows, _SKETCH), SKETCH)


def _fetch(key: str, text: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.xxhash64(F.col(text).cast("string"))).alias("fetch")


def least_matches(threshold: float, miss: float, batch: int = BATCH, total: int = BANDS * ROWS) -> list[int]:
    """After each batch of ``n`` positions: the fewest agreements with which a pair stays.

    With a uniform prior, P(similarity >= t | m of n agree) = P(Binomial(n + 1, t) <= m).
    Signatures are compared by 16 bits, which can only add agreements.
    """
    out = []
    for n in [*range(batch, total, batch), total]:
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _pairs(n: int, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a unit: all of one chunk, or those between its two chunks."""
    if sides.any():
        a, b = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        return np.repeat(a, len(b)), np.tile(b, len(a))
    i, j = np.triu_indices(n, 1)
    return i, j


def _candidates(sides: list[int], band: int, sizes: list[int], bands: list[list[int]], signatures: list[bytes],
                needed: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit that meet here first and survive the sequential comparison of signatures."""
    size, keys = np.array(sizes), np.array(bands)
    sig = np.frombuffer(b"".join(signatures), dtype=np.uint16).reshape(len(sizes), -1)
    kept_i, kept_j = [], []
    i, j = _pairs(len(sizes), np.array(sides))
    for at in range(0, len(i), 1 << 17):
        a, b = i[at:at + (1 << 17)], j[at:at + (1 << 17)]
        ok = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
        a, b = a[ok], b[ok]
        for earlier in range(0, band, 4):
            ok = (keys[a, earlier:min(earlier + 4, band)] != keys[b, earlier:min(earlier + 4, band)]).all(axis=1)
            a, b = a[ok], b[ok]
            if not len(a):
                break
        agree = np.zeros(len(a), dtype=np.int64)
        for step, least in enumerate(needed):
            if not len(a):
                break
            cut = slice(step * BATCH, (step + 1) * BATCH)
            agree += (sig[a, cut] == sig[b, cut]).sum(axis=1)
            ok = agree >= least
            a, b, agree = a[ok], b[ok], agree[ok]
        kept_i.append(a)
        kept_j.append(b)
    return np.concatenate([*kept_i, np.zeros(0, dtype=np.int64)]), np.concatenate([*kept_j, np.zeros(0, dtype=np.int64)])


def by_unit(work: Callable[[list[tuple]], Iterable[tuple]], schema: pa.Schema) -> Callable:
    """Lift ``work(rows of one unit)`` over batches that are sorted by their first three columns."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, made = None, [], []
        for batch in stream:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:3] != unit:
                    if rows:
                        made += work(rows)
                    unit, rows = row[:3], []
                rows.append(row)
            if len(made) > 4096:
                yield _batch(made, schema)
                made = []
        if rows:
            made += work(rows)
        if made:
            yield _batch(made, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _grouped(df: DataFrame) -> DataFrame:
    return df.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def _forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[int]:
    """Smallest member of each member's component."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def _units(nodes: DataFrame) -> DataFrame:
    """``(key, x, y, side, band, node)``: chunks, and pairs of chunks, of every bucket of two nodes or more.

    A bucket is cut by a hash into as many chunks as its nodes and shingles ask for; the number of
    rows of a bucket of ``m`` chunks grows with ``m`` times its nodes, not with their square.
    """
    met = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    weight = F.ceil(F.greatest(F.count("*") / CHUNK_NODES, F.sum("n_shingles") / CHUNK_SHINGLES)).cast("int")
    # written, so that the join's two sides are dealt alike and Spark can split a bucket with many nodes
    buckets = written(met.groupBy("key").agg(F.count("*").alias("_n"), weight.alias("chunks")).where("_n > 1").drop("_n"))
    joined = met.join(buckets, "key").select(
        "node", "band", "key", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(
        F.least(o, F.col("chunk")).alias("x"), F.greatest(o, F.col("chunk")).alias("y")))
    each = joined.select("node", "band", "key", "chunk", F.explode(others).alias("u"))
    # with itself a chunk is one side only
    side = (F.col("chunk") != F.col("u.x")).cast("int")
    return each.select("key", F.col("u.x").alias("x"), F.col("u.y").alias("y"), side.alias("side"), "band", "node")


def links(docs: DataFrame, known: DataFrame, *, threshold: float = 0.85, miss: float = MISS, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """``(a, b)``: a spanning forest of the verified links between the nodes of ``known``.

    ``known``: ``sketches(docs)`` for this threshold as a written table.
    """
    # of equal sets, the smallest row stands for all; equal digests come with equal signatures
    nodes = written(known.where("node is not null").groupBy("node").agg(
        F.min("fetch").alias("fetch"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature"),
        F.max("bands").alias("bands")))
    needed = least_matches(threshold, miss, total=math.prod(layout(threshold)))
    place = ["key", "x", "y", "side", "band", "node"]

    def compare(rows: list[tuple]) -> Iterator[tuple]:
        _, _, _, sides, bands, _, size, sig, keys = zip(*rows, strict=True)
        a, b = _candidates(list(sides), bands[0], list(size), list(keys), list(sig), needed, threshold)
        # the pairs need not leave the unit: its nodes that have one are enough to find them again
        return [rows[at][:6] for at in sorted({*a.tolist(), *b.tolist()})]

    _place = pa.schema([("key", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("side", pa.int32()), ("band", pa.int32()), ("node", pa.binary())])
    facts = nodes.drop("fetch")
    met = _units(nodes).join(facts, "node").select(*place, "n_shingles", "signature", "bands")
    survivors = written(_grouped(met).mapInArrow(
        by_unit(compare, _place), "key long, x int, y int, side int, band int, node binary"))

    # full sets of the survivors only
    ids = written(survivors.select("node").distinct().join(nodes.select("node", "fetch"), "node").select("fetch").distinct())
    texts = docs.select(_fetch(key, text), text_bytes(text).alias("text")).join(known_small(ids), "fetch", "left_semi")
    schema = pa.schema([("node", pa.binary()), ("codes", pa.binary())])
    words = Words()

    def sets(columns: list) -> Iterator[tuple]:
        for _, body in zip(*columns, strict=True):
            codes = shingles(body, words)
            if len(codes):
                raw = codes.tobytes()
                yield hashlib.blake2b(raw, digest_size=16).digest(), raw

    full = texts.mapInArrow(batches(sets, schema), "node binary, codes binary").dropDuplicates(["node"])

    def verify(rows: list[tuple]) -> Iterator[tuple]:
        rows = sorted(rows, key=lambda r: r[5])
        _, _, _, sides, bands, name, size, sig, keys, codes = zip(*rows, strict=True)
        i, j = _candidates(list(sides), bands[0], list(size), list(keys), list(sig), needed, threshold)
        found = _verified([np.frombuffer(c, dtype=np.uint64) for c in codes], i, j, threshold)
        root = _forest(len(name), found)
        return [(name[r], name[x]) for x, r in enumerate(root) if r != x]

    again = survivors.join(facts, "node").join(full, "node").select(*place, "n_shingles", "signature", "bands", "codes")
    return _grouped(again).mapInArrow(by_unit(verify, pa.schema([("a", pa.binary()), ("b", pa.binary())])), "a binary, b binary")


def _verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """The pairs whose sets reach the threshold; pairs already joined by others need no look."""
    percent = round(100 * threshold)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # pairs of one first member are looked up in its set at once
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else []
    for s, e in zip(starts, [*starts[1:], len(i)], strict=True):
        a = int(i[s])
        mine = sets[a]
        for b in j[s:e].tolist():
            ra, rb = root(a), root(b)
            if ra == rb:
                continue
            other = sets[b]
            at = np.searchsorted(mine, other)
            at[at == len(mine)] = 0
            both = int((mine[at] == other).sum())
            if 100 * both >= percent * (len(mine) + len(other) - both):
                parent[max(ra, rb)] = min(ra, rb)
                yield a, b


def _rooted(docs: DataFrame, threshold: float, miss: float, key: str, text: str, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sketches of the rows, and ``(node, root, component_id)`` of their nodes, as written tables."""
    known = written(sketches(docs, threshold=threshold, key=key, text=text, row=row))
    roots = written(components.labels(links(docs, known, threshold=threshold, miss=miss, key=key, text=text)))
    nodes = known.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = written(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    # written, so that the join's two sides are dealt alike and Spark can split a large component
    smallest = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return known, written(rooted.join(smallest, "root").select("node", "root", "component_id"))


def groups(docs: DataFrame, *, threshold: float = 0.85, miss: float = MISS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs``.

    Rows are linked when their shingle sets have a similarity of ``threshold`` (in whole percent)
    or more; ``component_id`` is the smallest id that links reach.  A row without words is linked
    with nothing and is its own component.  Rows with a null id take part, but give a component
    no id unless all its ids are null.  Repeated rows have equal sets and so one component; other columns are ignored.
    An empty table gives an empty result.
    """
    known, named = _rooted(docs, threshold, miss, key, text)
    rows = known.select("doc_id", "n_shingles", "node").join(named.drop("root"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, *, threshold: float = NEAR, miss: float = MISS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each component: the one with the smallest id.

    Of repeated rows with that id one stays; of rows without words all do.  Rows are told apart by
    a number that is written with them, since a second scan after the loss of executors may deal
    the rows differently.  Extra columns stay as they are; an empty table gives an empty one.
    """
    numbered = written(docs.withColumn("_neardup_row", F.monotonically_increasing_id()))
    known, named = _rooted(numbered, threshold, miss, key, text, "_neardup_row")
    rows = known.where("node is not null").select("row", "doc_id", "node").join(named.select("node", "root"), "node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    kept = written(rows.groupBy("root").agg(first.alias("first")).select("first.row"))
    gone = written(rows.select("row").join(kept, "row", "left_anti"))
    return numbered.join(known_small(gone.withColumnRenamed("row", "_neardup_row")), "_neardup_row", "left_anti").select(*docs.columns)
