"""Byte-level BPE encoding and decoding by a sentencepiece model made from a rank file.

The model is serialised directly from the vocabulary, nothing is trained: every piece is the byte
string of a token with each byte written as one character (see ``to_letters``), its score is the
negative rank, and normalisation is the identity.  The merge rule "best score first, leftmost of
equals" is then that of byte-pair ranks, and piece numbers are the token ids.  Texts are cut into
pre-tokens by a pattern; every pre-token is encoded by itself.  Decoding maps the letters of the
pieces back to bytes.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, shared, text_bytes, unpacked

#: File of the default vocabulary in the folder of public tokenizers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of distinct words and pre-tokens beyond which a task forgets them and begins anew.
REMEMBERED = 4_000_000
TWO_BLANKS = re.compile(r"\s\s")
#: Numbers of units that the memory does not hold.
UNSEEN, IRREGULAR = -2, -1
#: Piece of the unknown token that a model must have; no byte is written with this character.
UNKNOWN = "⁇"


def default_path() -> str:
    """The default vocabulary; needs the installed package of public tokenizers, else give a path."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a ``base64 rank`` file in order of rank; ranks must run from 0 without a gap."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines if line.strip()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks have gaps")
    return [token for _, token in pairs]


def to_letters(raw: bytes) -> str:
    """Each byte as the character 256 places above it: letters only, so no rule for blanks applies."""
    return (np.frombuffer(raw, dtype=np.uint8).astype("<u2") + 256).tobytes().decode("utf-16-le")


def to_bytes(letters: str) -> bytes:
    """The inverse of ``to_letters``."""
    return letters.encode("utf-16-le")[::2]


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model with one piece per token, numbered by rank, and an unknown piece at the end."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    missing = set(range(256)) - {t[0] for t in tokens if len(t) == 1}
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
    model = proto.ModelProto()
    trainer, rules = model.trainer_spec, model.normalizer_spec
    trainer.model_type, trainer.vocab_size = proto.TrainerSpec.BPE, len(tokens) + 1
    trainer.unk_id, trainer.unk_piece = len(tokens), UNKNOWN
    trainer.bos_id = trainer.eos_id = trainer.pad_id = -1
    rules.name = "identity"
    rules.add_dummy_prefix = rules.remove_extra_whitespaces = rules.escape_whitespaces = False
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=to_letters(token), score=-float(rank))
    model.pieces.add(piece=UNKNOWN, score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    return model.SerializeToString()


def newer_characters() -> tuple[str, str]:
    """Letters and numbers of the pattern engine's Unicode tables that the public library's older tables lack.

    Both as character-class ranges.  The library itself is asked, so that texts are cut as it would cut them.
    """
    import regex
    import tiktoken

    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = []
    for kind in (r"\p{L}", r"\p{N}"):
        given = regex.findall(kind, everything)
        reader = tiktoken.Encoding("letters", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        seen = set(bytes(reader.encode_ordinary("".join(given))).decode())
        ranges = itertools.groupby(enumerate(ord(c) for c in given if c not in seen), lambda p: p[1] - p[0])
        out.append("".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in ([c for _, c in g] for _, g in ranges)))
    return out[0], out[1]


class Codec:
    """Encoder and decoder of one vocabulary; what it needs travels as plain values."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.model, self.pattern = serialise(tokens), pattern
        self.newer = newer_characters()
        self.by_words = pattern == default_pattern()
        self.whole = {token: rank for rank, token in enumerate(tokens)}
        self.pieces = None
        self._forget()

    def _forget(self) -> None:
        """Empty the memory: unit to number, and by number its ids in ``flat``."""
        self.known: dict[str | bytes, int] = {}
        self.first = self.count = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)
        self.size = 0

    def open(self) -> Codec:
        """Make the parts that cannot travel; once in a task."""
        import regex
        import sentencepiece

        if self.pieces is None:
            self.pieces = sentencepiece.SentencePieceProcessor(model_proto=self.model)
            letters, numbers = self.newer
            self.plain = regex.compile(self.pattern)
            places = [int(x, 16) for x in regex.findall(r"U([0-9a-f]{8})", letters + numbers)]
            self.odd = {chr(c) for first, last in zip(places[::2], places[1::2], strict=True) for c in range(first, last + 1)}
            careful = self.pattern
            for kind, ranges in ((r"\p{L}", letters), (r"\p{N}", numbers)):
                careful = careful.replace(kind, f"[{kind}--[{ranges}]]") if ranges else careful
            self.careful = regex.compile(careful, regex.V1)
        return self

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text; together they are the text."""
        if text.isascii() or self.odd.isdisjoint(set(text)):
            return self.plain.findall(text)
        return self.careful.findall(text)

    def _units(self, text: str, by_words: bool) -> list[str | bytes]:
        """Parts of a text that are encoded by themselves: pre-tokens (as bytes), and words (as text) that one blank leads.

        Under the public pattern a blank between two characters that are no white space begins a
        pre-token, whatever stands around it, so a word with its blank need not be cut again.
        """
        if not by_words:
            return [p.encode() for p in self.cut(text)]
        first, *words = text.split(" ")
        return [*(p.encode() for p in self.cut(first)), *words] if first == first.rstrip() else [*words, ""]

    def _tokens(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pre-tokens in a row, and how many each has."""
        letters, lengths = to_letters(b"".join(distinct)), np.array([len(p) for p in distinct], dtype=np.int64)
        ends = np.cumsum(lengths)
        ids: list = [self.whole.get(p) for p in distinct]
        ask = [i for i, token in enumerate(ids) if token is None]
        ends, starts = ends.tolist(), (ends - lengths).tolist()
        made = self.pieces.encode([letters[starts[i]:ends[i]] for i in ask], num_threads=1) if ask else []
        for i, pieces in zip(ask, made, strict=True):
            ids[i] = pieces
        # a pre-token that is a token is that token, also where its merges would end elsewhere
        lists = [x if isinstance(x, list) else (x,) for x in ids]
        return np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int32), np.array([len(x) for x in lists], dtype=np.int64)

    def _learn(self, fresh: list[str | bytes]) -> None:
        """Encode units that are not remembered and append them to the memory."""
        alone = [u for u in fresh if isinstance(u, bytes)]
        words = [u for u in fresh if isinstance(u, str)]
        # the blank before or after such a word stands next to other white space: its text is cut as a whole
        if TWO_BLANKS.search(f" {' '.join(words)} "):
            odd = [w for w in words if not w or w[0].isspace() or w[-1].isspace()]
            self.known.update(dict.fromkeys(odd, IRREGULAR))
            words = [w for w in words if w not in self.known]
        cuts = self.cut(" " + " ".join(words)) if words else []
        number = {p: i for i, p in enumerate(dict.fromkeys([*alone, *(p.encode() for p in cuts)]))}
        ids, counts = self._tokens(list(number))
        firsts = np.cumsum(counts) - counts
        at = np.array([number[p] for p in alone] + [number[p.encode()] for p in cuts], dtype=np.int64)
        # of the pre-tokens of a word the first one begins with the blank
        owner = np.cumsum([1] * len(alone) + [p[0] == " " for p in cuts], dtype=np.int64) - 1
        sizes = np.bincount(owner, weights=counts[at], minlength=len(alone) + len(words)).astype(np.int64)
        learned = len(self.count)
        self.known.update(zip([*alone, *words], range(learned, learned + len(sizes)), strict=True))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
        self.count = np.concatenate([self.count, sizes])
        self.flat = np.concatenate([self.flat, ids[_places(firsts[at], counts[at])]])
        self.size += sum(map(len, fresh))

    def _codes(self, units: list[list[str | bytes]]) -> np.ndarray:
        """Numbers of the units in the memory; ``IRREGULAR`` where there is none."""
        every = list(itertools.chain.from_iterable(units))
        codes = np.fromiter(map(self.known.get, every, itertools.repeat(UNSEEN)), dtype=np.int64, count=len(every))
        unseen = np.flatnonzero(codes == UNSEEN).tolist()
        if unseen:
            self._learn(list(dict.fromkeys(every[i] for i in unseen)))
            codes[unseen] = [self.known[every[i]] for i in unseen]
        return codes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and where each text's begin (one more place for the end)."""
        if self.size > REMEMBERED:
            self._forget()
        units = [self._units(t, self.by_words) for t in texts]
        codes = self._codes(units)
        ends = np.cumsum([0, *map(len, units)])
        irregular = np.unique(np.searchsorted(ends, np.flatnonzero(codes == IRREGULAR), side="right") - 1).tolist()
        if irregular:
            again = [self._units(texts[i], False) for i in irregular]
            cut = np.split(codes, ends[1:-1])
            for i, part in zip(irregular, np.split(self._codes(again), np.cumsum([len(u) for u in again])[:-1]), strict=True):
                cut[i] = part
            codes, ends = np.concatenate(cut), np.cumsum([0, *map(len, cut)])
        counts = self.count[codes]
        return self.flat[_places(self.first[codes], counts)], np.concatenate([[0], np.cumsum(counts)])[ends]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of token ids, in order."""
        return to_bytes(self.pieces.decode(ids)) if ids else b""


def _places(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of stretches that begin at ``firsts`` and hold ``counts`` places, in a row."""
    ends = np.cumsum(counts)
    return np.repeat(firsts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    return Codec(read_ranks(path or default_path()), pattern or default_pattern())


def encode(docs: DataFrame, by: Codec, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every row of ``docs``: the token ids of the whole text, without special tokens.

    Null and empty texts have no ids (an empty array), rows with a null id stay, repeated rows are
    encoded each, an empty table gives an empty one; other columns are ignored.  Bytes that are no
    UTF-8 count as U+FFFD.  The broadcast codec has the size of the vocabulary.
    """
    packed = shared(docs.sparkSession, by)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = None
        for part in by_bytes(stream, 1):
            inside = inside or unpacked(packed.value).open()
            ids, places = inside.encode([b.decode("utf-8", "replace") if b else "" for b in part.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(places, type=pa.int32()), pa.array(ids, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], schema=schema)

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, by: Codec, *, ids: str = "ids", into: str = "body") -> DataFrame:
    """``encoded`` with the bytes of the token ids as column ``into``; null ids give null, no ids no bytes.

    All columns stay; one that is already called ``into`` is replaced.  Rows are independent of
    each other, so repeated rows and empty tables need no rule.  An id outside the vocabulary is an error.
    """
    kept = encoded.drop(into)
    packed = shared(encoded.sparkSession, by)
    at = kept.columns.index(ids)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = None
        for part in by_bytes(stream, at):
            inside = inside or unpacked(packed.value).open()
            made = [None if row is None else inside.decode(row) for row in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, type=pa.binary())], names=[*part.schema.names, into])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(into, T.BinaryType())]))
