"""Periodic runs of words by internal pattern matching.

A run is a maximal stretch of words with smallest period ``q`` that holds at least four periods.
It holds a whole aligned block of ``2**k`` words with ``q < 2**k <= 2q`` and, on one side at least,
the same block one period away.  Occurrences of a block that overlap it form one arithmetic
progression with the block's period as difference, so the nearest occurrence on either side gives
the only candidate periods:

1. Prefix doubling names every stretch of ``2**k`` words and sorts the positions into a suffix
   array; the occurrences of a block are an interval of it.
2. A wavelet tree over the suffix array answers, for all blocks of a level at once, which is the
   next occurrence to the right and to the left of a block (range successor and predecessor).
3. Every candidate (block, period) is extended to both sides by comparing dyadic names, which
   gives the maximal stretch; stretches of four periods or more are runs.

Many documents are handled at once as one long sequence.  A word of another document is another
symbol, so nothing reaches across documents and doubling ends with the longest repeated block.
Memory is linear in the words handled at once, times the logarithm of the longest repeated block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, text_bytes

#: Fewest periods and fewest words of a run.
PERIODS, SHORTEST = 4, 6
#: Bytes of text handled at once, and texts; a longer text is handled by itself.
AT_ONCE, TEXTS = 1 << 20, 4096

RUN = "struct<start: bigint, length: bigint, period: bigint>"


class Names:
    """Names of the stretches of ``2**k`` words at every position, for all ``k`` at which stretches repeat.

    A name is the place of the first equal stretch in sorted order, so the occurrences of a block
    stand in ``order[name:name + how_often]`` of the last, finest order.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        self.names, self.counts = [], []
        keys = symbols
        while True:
            ordered = keys[order]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, n))
            name = np.empty(n, dtype=np.int32)
            name[order] = np.repeat(first, size)
            count = np.zeros(n, dtype=np.int32)
            count[first] = size
            self.names.append(name)
            self.counts.append(count)
            self.order = order.astype(np.int32)
            if size.max() == 1:
                break
            step = 1 << (len(self.names) - 1)
            following = np.zeros(n, dtype=np.int64)
            following[:max(n - step, 0)] = name[step:].astype(np.int64) + 1
            keys = name.astype(np.int64) * (n + 1) + following
            # only members of groups of two or more can change places
            loose = np.flatnonzero(np.repeat(size, size) > 1)
            members = order[loose]
            order = order.copy()
            order[loose] = members[np.argsort(keys[members], kind="stable")]

    def reach_right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from ``i`` and from ``j`` on."""
        n, done = len(self.order), np.zeros(len(i), dtype=np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name = self.names[level]
            a, b = i + done, j + done
            inside = np.flatnonzero(np.maximum(a, b) < n)
            same = inside[name[a[inside]] == name[b[inside]]]
            done[same] += 1 << level
        return done

    def reach_left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words before ``i`` and before ``j``."""
        done = np.zeros(len(i), dtype=np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, step = self.names[level], 1 << level
            a, b = i - done - step, j - done - step
            inside = np.flatnonzero(np.minimum(a, b) >= 0)
            same = inside[name[a[inside]] == name[b[inside]]]
            done[same] += step
        return done


class WaveletTree:
    """Range queries on a sequence of the numbers from 0 to n - 1, all queries at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(len(values) - 1).bit_length(), 1)
        self.zeros, self.total = [], []
        now = values
        for bit in range(self.bits - 1, -1, -1):
            zero = (now >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero, dtype=np.int32)]).astype(np.int32))
            self.total.append(int(self.zeros[-1][-1]))
            now = np.concatenate([now[zero], now[~zero]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values in ``[lo, hi)`` are smaller than ``x``, one of the numbers."""
        lo, hi = lo.copy(), hi.copy()
        out = np.zeros(len(lo), dtype=np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            zl, zh = self.zeros[level][lo], self.zeros[level][hi]
            one = (x >> bit) & 1 == 1
            out += np.where(one, zh - zl, 0)
            lo = np.where(one, self.total[level] + lo - zl, zl)
            hi = np.where(one, self.total[level] + hi - zh, zh)
        return out

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest value (from 0) in ``[lo, hi)``."""
        lo, hi, k = lo.copy(), hi.copy(), k.copy()
        out = np.zeros(len(lo), dtype=np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            zl, zh = self.zeros[level][lo], self.zeros[level][hi]
            one = k >= zh - zl
            k -= np.where(one, zh - zl, 0)
            out |= one.astype(np.int64) << bit
            lo = np.where(one, self.total[level] + lo - zl, zl)
            hi = np.where(one, self.total[level] + hi - zh, zh)
        return out


def find_runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs, by start and then period."""
    none = np.zeros(0, dtype=np.int64)
    if not len(symbols):
        return none, none, none
    names = Names(symbols)
    tree = WaveletTree(names.order)
    starts, periods = [none], [none]
    for level in range(1, len(names.names)):
        block = 1 << level
        i = np.arange(0, len(symbols) - block + 1, block, dtype=np.int64)
        lo = names.names[level][i].astype(np.int64)
        count = names.counts[level][lo].astype(np.int64)
        again = count > 1
        i, lo, hi = i[again], lo[again], (lo + count)[again]
        # the block itself is among its occurrences; its neighbours there are the nearest ones
        rank = tree.below(lo, hi, i)
        for side in (1, -1):
            has = (rank + 1 < hi - lo) if side > 0 else rank > 0
            other = tree.smallest(lo[has], hi[has], rank[has] + side)
            period = np.abs(other - i[has])
            fits = (period < block) & (2 * period >= block)
            starts.append(i[has][fits])
            periods.append(period[fits])
    i, q = np.concatenate(starts), np.concatenate(periods)
    # blocks of the same stretch extend to the same run
    right, left = names.reach_right(i, i + q), names.reach_left(i, i + q)
    start, length = i - left, left + right + q
    ok = length >= np.maximum(PERIODS * q, SHORTEST)
    found = np.unique(np.stack([start[ok], q[ok], length[ok]]), axis=1)
    return found[0], found[2], found[1]


def covered(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words of ``n`` that a run holds after its first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return np.cumsum(edges[:n]) > 0


def _documents(bodies: list[bytes | None]) -> Iterator[tuple]:
    """Words, runs and kept words of every text of a part."""
    words = [b.split() if b else [] for b in bodies]
    numbers: dict[bytes, int] = {}
    flat = [numbers.setdefault(w, len(numbers)) for ws in words for w in ws]
    sizes = np.array([len(ws) for ws in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    symbols = np.repeat(np.arange(len(words), dtype=np.int64), sizes) * (len(numbers) + 1) + np.array(flat, dtype=np.int64)
    start, length, period = find_runs(symbols)
    gone = covered(len(symbols), start, length, period)
    cut = np.searchsorted(start, np.concatenate([[0], ends]))
    for d, ws in enumerate(words):
        first = int(ends[d] - sizes[d])
        mine = slice(int(cut[d]), int(cut[d + 1]))
        runs = [{"start": s - first, "length": n, "period": q}
                for s, n, q in zip(start[mine].tolist(), length[mine].tolist(), period[mine].tolist(), strict=True)]
        if runs:
            drop = gone[first:first + len(ws)].tolist()
            ws = [w for w, g in zip(ws, drop, strict=True) if not g]
        yield int(sizes[d]), runs, b" ".join(ws)


def runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every row of ``docs``.

    Words are runs of bytes other than ASCII white space, numbered from 0.  ``runs`` has every
    maximal stretch with smallest period ``q`` and at least ``4q`` and six words, by start and then
    period.  ``collapsed`` is the text of the words that no run holds after its first period, joined
    by one blank.  Null, empty and blank texts have no words, no runs and an empty ``collapsed``;
    rows with a null id stay, repeated rows are handled each, an empty table gives an empty one,
    other columns are ignored.  A text is handled whole, in one task, in memory linear in its words.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.binary())])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(stream, 1, AT_ONCE, TEXTS):
            made = zip(*_documents(part.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, type=schema.field(k).type) for k, c in enumerate(made, 1))], schema=schema)

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    found = narrow.mapInArrow(work, f"doc_id long, n_words long, runs array<{RUN}>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def longest(runs: Column) -> Column:
    """The run of greatest length; of equals the smallest start, then period; null without runs."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"], r["period"])))
    return F.when(F.size(runs) > 0, F.struct(best["start"].alias("start"), (-best["n"]).alias("length"), best["period"].alias("period")))


def listed(runs: Column) -> Column:
    """``start,length,period`` and a line feed for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
