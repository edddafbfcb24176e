"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items form one suffix automaton; streaming the words of a document
through it gives, at every word, the longest piece of any item that ends there.  A window is
``WINDOW`` consecutive words of an item (a shorter item is one window).  Where the longest match
covers a window, its words are hit, and the state names the items that hold the window.
Documents stay where they are: only the automaton travels, in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, shared, text_bytes, unpacked

WINDOW = 10
#: Benchmark text in one automaton; a larger benchmark is taken in several blocks.
BLOCK_BYTES = 4 << 20

#: Lower-cases A-Z and blanks out every ASCII byte that is not a letter or digit.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words of letters, digits and non-ASCII characters; none for null."""
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over the words of ``(item, words)`` pairs."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.nxt: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[tuple[object, int, list[bytes]]] = []
        for item, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
            if words:
                ends.append((item, last, words))
        self._name(ends)

    def _state(self, length: int, nxt: dict[bytes, int], link: int) -> int:
        self.length.append(length)
        self.nxt.append(nxt)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of the strings of ``q`` up to one word longer than ``p``'s; made if ``q`` has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.nxt[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.nxt[p].get(word) == q:
            self.nxt[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.nxt[last]:
            return self._split(last, word, self.nxt[last][word])
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.nxt[p]:
            self.nxt[p][word] = new
            p = self.link[p]
        self.link[new] = self._split(p, word, self.nxt[p][word]) if p >= 0 else 0
        return new

    def _name(self, ends: list[tuple[object, int, list[bytes]]]) -> None:
        """Which windows and items a match in a state stands for."""
        n, window = len(self.length), self.window
        order = sorted(range(1, n), key=self.length.__getitem__)
        # home[v]: the state of the last `window` words of a match in v that is at least as long
        self.home = home = [-1] * n
        # shorts[v]: (length, item) of whole short items that end a match in v
        shorts: list[tuple[tuple[int, object], ...]] = [()] * n
        own: dict[int, list[tuple[int, object]]] = {}
        for item, state, words in ends:
            if len(words) < window:
                own.setdefault(state, []).append((len(words), item))
        for v in order:
            up = self.link[v]
            if self.length[v] >= window:
                home[v] = v if self.length[up] < window else home[up]
            shorts[v] = shorts[up] + tuple(own.get(v, ()))
        self.shorts = shorts
        self.items: dict[int, set] = {}
        for item, _, words in ends:
            at = 0
            for i, word in enumerate(words):
                at = self.nxt[at][word]
                if i + 1 >= window:
                    self.items.setdefault(home[at], set()).add(item)
        far = 1 << 60
        # least[v]: the shortest match in v that covers a window
        self.least = [min([window if home[v] >= 0 else far, *(k for k, _ in shorts[v])]) for v in range(n)]

    def spans(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Hit stretches ``[first, past]`` of words, in order and apart, and the items hit."""
        nxt, link, length, least = self.nxt, self.link, self.length, self.least
        found: list[list[int]] = []
        items: set = set()
        v = l = 0
        for i, word in enumerate(words):
            to = nxt[v].get(word)
            if to is None:
                if not v:
                    continue
                v = link[v]
                while v > 0 and word not in nxt[v]:
                    v = link[v]
                to = nxt[v].get(word)
                if to is None:
                    v = l = 0
                    continue
                l = length[v] + 1
            else:
                l += 1
            v = to
            if l >= least[v]:
                widest = 0
                if l >= self.window and self.home[v] >= 0:
                    widest = self.window
                    items |= self.items[self.home[v]]
                for k, item in self.shorts[v]:
                    if k <= l:
                        widest = max(widest, k)
                        items.add(item)
                if widest:
                    first = i + 1 - widest
                    while found and found[-1][1] >= first:
                        first = min(first, found.pop()[0])
                    found.append([first, i + 1])
        return found, items


def automata(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", window: int = WINDOW,
             block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast automata, one per block of about ``block_bytes`` of benchmark text.

    Items are dealt to blocks by a hash; one block is on the driver at a time.  Items without
    words make no window; rows that repeat an item add nothing; an item without id is hit but not named.
    """
    rows = benchmark.select(F.col(item).cast("string").alias("item"), text_bytes(text).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    made = []
    for block in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        items = [(r["item"], words_of(bytes(r["text"]))) for r in part.toLocalIterator()]
        made.append(shared(benchmark.sparkSession, Automaton(items, window)))
    return made


def _unpacker(blocks: int) -> Callable[[Broadcast], Automaton]:
    """A task keeps a single automaton; of several it holds one at a time."""
    kept: dict[int, Automaton] = {}

    def unpack(block: Broadcast) -> Automaton:
        if blocks > 1:
            return unpacked(block.load_from_path(block._path))
        if 0 not in kept:
            kept[0] = unpacked(block.value)
        return kept[0]

    return unpack


def _find(bodies: list[bytes | None], blocks: list, unpack: Callable[[Broadcast], Automaton]) -> list[tuple[list[bytes], list[list[int]], set]]:
    """Words, merged hit stretches and items of each text, over all blocks in turn."""
    found = [(words_of(b), [], set()) for b in bodies]
    for automaton in map(unpack, blocks):
        for words, spans, items in found:
            more, named = automaton.spans(words)
            spans += more
            items |= named
    if len(blocks) > 1:
        for _, spans, _ in found:
            spans.sort()
            merged: list[list[int]] = []
            for first, past in spans:
                if merged and merged[-1][1] >= first:
                    merged[-1][1] = max(merged[-1][1], past)
                else:
                    merged.append([first, past])
            spans[:] = merged
    return found


_REPORT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())])))])
REPORT = ("doc_id long, n_words long, n_hit long, items array<string>, "
          "spans array<struct<first: long, past: long>>")


def report(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: words, hit words, sorted ids of the items hit, and the hit stretches of words.

    Null and empty texts have no words; repeated rows are reported each; with an empty benchmark
    nothing is hit; other columns are ignored.
    """
    blocks = automata(benchmark, window=window, block_bytes=block_bytes)
    unpack = _unpacker(len(blocks))

    def rows(columns: list) -> Iterator[tuple]:
        for doc, (words, spans, items) in zip(columns[0], _find(columns[1], blocks, unpack), strict=True):
            yield (doc, len(words), sum(b - a for a, b in spans), sorted(i for i in items if i is not None),
                   [{"first": a, "past": b} for a, b in spans])

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return narrow.mapInArrow(batches(rows, _REPORT), REPORT)


def digest(items: Column | str) -> Column:
    """SHA-256 of the comma-joined item ids, which are sorted as strings."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def _cut(body: bytes, spans: list[list[int]]) -> bytes:
    """``body`` without the words of ``spans`` and what stands between those of one span."""
    bounds = [m.span() for m in _WORD.finditer(body)]
    at, kept = 0, []
    for first, past in spans:
        kept.append(body[at:bounds[first][0]])
        at = bounds[past - 1][1]
    return b"".join([*kept, body[at:]])


def remove(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW, min_span: int = 1,
           max_coverage: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without benchmark passages, in the columns of ``docs``.

    A hit stretch of at least ``min_span`` words is cut out of the text.  A hit is a window of an
    item or the whole of a shorter item, so by default every one goes; a larger ``min_span`` leaves
    short items.  A row goes altogether when more than ``max_coverage`` of its words are in such
    stretches.  Rows without them pass unchanged, null and empty texts included; repeated rows are
    treated each.  A column ``n_chars``, if there is one, follows the text.
    """
    blocks = automata(benchmark, window=window, block_bytes=block_bytes)
    unpack = _unpacker(len(blocks))
    names = docs.columns

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for whole in stream:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                bodies = batch.column(at).cast(pa.binary()).to_pylist()
                keep, texts = [], []
                for body, (words, spans, _) in zip(bodies, _find(bodies, blocks, unpack), strict=True):
                    long = [s for s in spans if s[1] - s[0] >= min_span]
                    cut = sum(b - a for a, b in long)
                    keep.append(cut <= max_coverage * len(words))
                    texts.append(_cut(body, long) if long and keep[-1] else body)
                columns = list(batch.columns)
                columns[at] = pa.array(texts, type=pa.binary()).cast(batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, type=pa.bool_()))

    cleaned = docs.withColumn(text, F.col(text).cast("string")).mapInArrow(run, docs.schema)
    if "n_chars" in names and text != "n_chars":
        cleaned = cleaned.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)).select(*names)
    return cleaned
