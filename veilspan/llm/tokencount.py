"""Greedy word-piece lengths by a linear longest-match automaton.

Words are cut greedily into the longest vocabulary pieces.  The plain way restarts after every
piece and may read a byte many times.  Here the vocabulary is a trie whose nodes have failure
links: when no edge continues a match, the link leads to the node of what is left over after the
pieces that the match already fixes, and the number of those pieces is stored with the link.  So
every byte is read once, and pieces are counted without being built.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, once, shared, text_bytes

#: A public byte-level vocabulary: pieces that begin with a blank begin a word.  A parameter: where
#: the file is absent, ``read_vocabulary`` raises ``FileNotFoundError`` unless another path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words whose counts a task remembers.
REMEMBERED = 200_000


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a ``base64 rank`` file."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Trie of the pieces with failure links and numbers of popped pieces."""

    def __init__(self, pieces: list[bytes]):
        edges: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                nxt = edges[node].get(byte)
                if nxt is None:
                    nxt = edges[node][byte] = len(edges)
                    edges.append({})
                    final.append(False)
                node = nxt
            final[node] = node != 0
        link = [-1] * len(edges)
        popped = [0] * len(edges)
        queue = [0]
        for node in queue:
            for byte, child in edges[node].items():
                if final[child]:
                    link[child], popped[child] = 0, 1
                else:
                    at, count = link[node], popped[node]
                    while at >= 0 and byte not in edges[at]:
                        at, count = link[at], count + popped[at]
                    if at >= 0:
                        link[child], popped[child] = edges[at][byte], count
                queue.append(child)
        self.edges, self.link, self.popped = edges, link, popped

    def count(self, word: bytes) -> int:
        """Number of greedy pieces of a word; 1 (an unknown piece) if it cannot be cut; 0 if empty."""
        edges, link, popped = self.edges, self.link, self.popped
        node = total = 0
        for byte in word:
            nxt = edges[node].get(byte)
            while nxt is None:
                if link[node] < 0:
                    return 1
                total += popped[node]
                node = link[node]
                nxt = edges[node].get(byte)
            node = nxt
        while node:
            if link[node] < 0:
                return 1
            total += popped[node]
            node = link[node]
        return total


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, pieces: list[bytes] | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` of every row of ``docs``.

    Words are runs of bytes other than ASCII white space; each is preceded by one blank, which
    marks the start of a word in the vocabulary, and cut greedily.  Null, empty and blank texts
    have 0 words and 0 tokens.  Repeated rows are counted each; other columns are ignored; an empty
    table gives an empty result.  The automaton is broadcast: its size is that of the vocabulary, a parameter, not of the data.
    """
    opened = once(shared(docs.sparkSession, Automaton(read_vocabulary() if pieces is None else pieces)))
    known: dict[bytes, int] = {}

    def rows(columns: list) -> Iterator[tuple]:
        automaton = opened()
        for doc, body in zip(*columns, strict=True):
            words = body.split() if body else []
            total = 0
            for word in words:
                n = known.get(word)
                if n is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    n = automaton.count(b" " + word)
                    if len(word) <= 64:
                        known[word] = n
                total += n
            yield doc, len(words), total

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return narrow.mapInArrow(batches(rows, _SCHEMA), "doc_id long, n_words long, n_tokens long")
