"""WARC archives: writing with segmentation and revisits, reading with reassembly.

Writing turns each page into a ``response`` record whose HTTP body is in chunked framing, or,
when an equal large payload is archived elsewhere, into a ``revisit`` record.  A record longer
than a segment is continued in ``continuation`` records.  The archives are ordinary
gzip-compressed WARC files in a folder that all executors share, written and read by Spark.

Record identifiers follow from what is archived (key, URL, payload), so a task that runs again
writes the same ones, and a revisit names the record that it refers to in the standard header.
Repeated rows give records of one identifier with equal segments.

Reading takes the records of each file in turn, groups the continuations of a record by the
identifier of its first segment, orders them by segment number, verifies that no segment is
missing and that the total length is as stated, and decodes the chunked framing.  A file that
ends inside a record is an error.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.session import written

from .common import batches

#: Payloads of fewer bytes are always archived in full.
REVISIT_BYTES = 1000
SEGMENT_BYTES = 16384
CHUNK_BYTES = 4096
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"

_RECORD = pa.schema([("record", pa.binary())])
_PARSED = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("origin_id", pa.string()), ("segment", pa.int64()),
    ("total", pa.int64()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()),
    ("digest", pa.string()), ("content", pa.binary())])
PARSED = ("record_id string, record_type string, origin_id string, segment long, total long, page_id long, "
          "refers_to long, url string, digest string, content binary")


def revisits(pages: DataFrame, *, key: str = "page_id", payload: str = "html", url: str | None = None) -> DataFrame:
    """``pages`` with ``refers_to``: the largest key with an equal payload of ``REVISIT_BYTES`` or more.

    With ``url`` also ``refers_url``: the largest URL of the rows with that key and payload.

    Null where the page itself is archived in full: a smaller payload, or the largest key itself
    (each of its rows, if it is repeated).  A row without a key, equal to one with a key, refers to that one.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    large = F.octet_length(body) >= REVISIT_BYTES
    mark = F.when(large, F.unhex(F.sha2(body, 256)))
    marked = pages.drop("refers_to", "refers_url", "_mark", "_largest").withColumn("_mark", mark)
    first = F.struct(F.col(key).alias("key"), (F.lit(None) if url is None else F.col(url)).cast("string").alias("url"))
    # written, so that the join's two sides are dealt alike and Spark can split a frequent payload
    groups = written(marked.where("_mark is not null").groupBy("_mark")
                     .agg(F.max(first).alias("_largest"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    joined = marked.join(groups, "_mark", "left")
    other = F.when(~F.col(key).eqNullSafe(F.col("_largest.key")), F.col("_largest"))
    found = joined.withColumn("refers_to", other["key"])
    return (found if url is None else found.withColumn("refers_url", other["url"])).drop("_mark", "_largest")


def _chunked(body: bytes) -> bytes:
    parts = []
    for at in range(0, len(body), CHUNK_BYTES):
        piece = body[at:at + CHUNK_BYTES]
        parts += [b"%x" % len(piece), CRLF, piece, CRLF]
    return b"".join([*parts, b"0", CRLF, CRLF])


def _framed(fields: list[tuple[str, object]], content: bytes) -> bytes:
    """A whole record but its very last byte, which the text writer adds as line end."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"".join([b"WARC/1.1\r\n", head.encode(), b"Content-Length: %d" % len(content), CRLF, CRLF, content, b"\r\n\r"])


def _identifier(*parts: object) -> str:
    """A record identifier that follows from the parts."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(parts))}>"


def _records(columns: list) -> Iterator[tuple]:
    for page_id, url, body, refers_to, refers_url in zip(*columns, strict=True):
        body = body or b""
        digest = "sha1:" + hashlib.sha1(body).hexdigest()
        record_id = _identifier(page_id, url, digest)
        # a target may not hold blanks or controls, which would end the header line
        target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
        common = [("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Page-ID", page_id),
                  ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
        if refers_to is not None:
            extra = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", _identifier(refers_to, refers_url, digest)),
                     ("WARC-Refers-To-Date", DATE), ("WARC-Refers-To-Page-ID", refers_to)]
            yield (_framed([*extra, *common], head),)
            continue
        content = head + _chunked(body)
        if len(content) <= SEGMENT_BYTES:
            yield (_framed([("WARC-Type", "response"), *common], content),)
            continue
        for number, at in enumerate(range(0, len(content), SEGMENT_BYTES), 1):
            part = content[at:at + SEGMENT_BYTES]
            if number == 1:
                fields = [("WARC-Type", "response"), *common]
            else:
                fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", _identifier(record_id, number)), ("WARC-Date", DATE),
                          ("WARC-Segment-Origin-ID", record_id)]
            total = len(content) if at + SEGMENT_BYTES >= len(content) else None
            yield (_framed([*fields, ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)], part),)


def write(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Archive every row of ``pages`` in gzip WARC files under ``folder``.

    A null payload is an empty one, a null URL becomes ``urn:page:<key>``.  Repeated rows give a
    record each.  Other columns are ignored; an empty table gives archives without records.
    """
    narrow = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(payload).alias("html"))
    marked = revisits(narrow, url="url").select(
        "page_id", "url", F.col("html").cast("string").cast("binary").alias("html"), "refers_to", "refers_url")
    records = marked.mapInArrow(batches(_records, _RECORD), "record binary")
    # the text writer writes the bytes of a string as they are
    records.select(F.col("record").cast("string")).write.option("compression", "gzip").option("lineSep", "\n").text(folder)


class _Parser:
    """Records out of the lines of one archive file, by their stated lengths."""

    def __init__(self) -> None:
        self.fields: dict[str, str] | None = None
        self.parts: list[bytes] = []
        self.missing = -1

    def feed(self, line: bytes) -> tuple | None:
        """Take one line (without its ``\\n``); the record that it completes, if any."""
        if self.missing >= 0:
            self.parts.append(line + b"\n")
            self.missing -= len(line) + 1
            if self.missing >= 0:
                return None
            # what follows the content is CR LF CR LF; its first line end has just been read
            content = b"".join(self.parts)
            content = content[:len(content) + self.missing]
            fields, self.fields, self.parts, self.missing = self.fields, None, [], -1
            return self._record(fields, content)
        line = line.removesuffix(b"\r")
        if self.fields is None:
            if line.startswith(b"WARC/"):
                self.fields = {}
            elif line:
                raise ValueError(f"no record starts with {line[:40]!r}")
        elif line:
            name, _, value = line.decode().partition(":")
            self.fields[name.lower()] = value.strip()
        else:
            self.missing = int(self.fields["content-length"])
        return None

    def close(self, path: str) -> None:
        """The file has ended: an error if a record has not."""
        if self.fields is not None:
            raise ValueError(f"{path} ends inside a record")

    @staticmethod
    def _record(fields: dict[str, str], content: bytes) -> tuple:
        number = lambda k: int(fields[k]) if k in fields else None
        record_id = fields["warc-record-id"]
        return (record_id, fields["warc-type"], fields.get("warc-segment-origin-id", record_id),
                number("warc-segment-number"), number("warc-segment-total-length"), number("warc-page-id"),
                number("warc-refers-to-page-id"), fields.get("warc-target-uri"),
                fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, content)


def _parse(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parsers: dict[str, _Parser] = {}
    for batch in stream:
        done, held = [], 0
        for path, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if path not in parsers:
                for earlier, parser in parsers.items():
                    parser.close(earlier)
                parsers = {path: _Parser()}  # a file is read by one task from its start to its end
            made = parsers[path].feed(line)
            if made is not None:
                done.append(made)
                held += len(made[-1])
                if held > 8 << 20:
                    yield _batch(done)
                    done, held = [], 0
        if done:
            yield _batch(done)
    for path, parser in parsers.items():
        parser.close(path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _PARSED, strict=True)], schema=_PARSED)


def read_records(spark, folder: str) -> DataFrame:
    """One row per WARC record (segment) of the gzip archives under ``folder``.

    Gzip files cannot be split, so each is read in order by one task, one record at a time.
    """
    lines = spark.read.option("lineSep", "\n").text(folder)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line")).mapInArrow(_parse, PARSED)


def _dechunk(body: bytes) -> bytes:
    at, parts = 0, []
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size:at + size + 2] != CRLF:
            raise ValueError("a chunk is longer than stated")
        parts.append(body[at:at + size])
        at += size + 2


def payload_of(content: bytes) -> bytes:
    """The HTTP body of a response record, without transfer framing."""
    head, _, body = content.partition(CRLF + CRLF)
    return _dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def _opened(columns: list) -> Iterator[tuple]:
    for page_id, url, kind, refers_to, digest, content in zip(*columns, strict=True):
        if kind == "revisit":
            yield page_id, url, kind, refers_to, digest, None
            continue
        body = payload_of(content)
        if digest != hashlib.sha1(body).hexdigest():
            raise ValueError(f"page {page_id}: the payload does not have the stated digest")
        yield page_id, url, kind, refers_to, digest, body


_OPENED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                     ("digest", pa.string()), ("payload", pa.binary())])
OPENED = "page_id long, url string, record_type string, refers_to long, digest string, payload binary"


def _checked(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def read_pages(spark, folder: str) -> DataFrame:
    """One row per archived page: ``page_id, url, record_type, refers_to, digest, payload``.

    Segments are reassembled; a missing segment, a wrong total length, broken chunked framing or a
    wrong digest raises an error.  The payload of a revisit is null.
    """
    records = read_records(spark, folder)
    fields = ["page_id", "url", "record_type", "refers_to", "digest"]
    whole = records.where("segment is null").select(*fields, "content")
    # equal segments of repeated records are counted before the segments of one record meet;
    # a record is a row and fits a task like any row
    single = records.where("segment is not null").groupBy("origin_id", "segment", "content").agg(
        F.max("total").alias("total"), F.max(F.struct(*fields)).alias("head"), F.count("*").alias("copies"))
    parts = single.groupBy("origin_id").agg(
        F.sort_array(F.collect_list(F.struct("segment", "content"))).alias("parts"), F.max("total").alias("total"),
        F.max("segment").alias("last"), F.max_by("head", F.col("segment") == 1).alias("first"),
        F.min("copies").alias("copies"), F.max("copies").alias("most"))
    joined = parts.withColumn("content", F.aggregate(
        "parts", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["content"])))
    numbers = F.transform("parts", lambda p: p["segment"])
    ok = ((numbers == F.sequence(F.lit(1).cast("long"), F.col("last"))) & (F.octet_length("content") == F.col("total"))
          & (F.col("copies") == F.col("most")))
    checked = joined.select("first.*", _checked(F.coalesce(ok, F.lit(False)), F.col("content"), "segments do not make a whole record").alias("content"),
                            F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")
    return whole.unionByName(checked).select("page_id", "url", "record_type", "refers_to", "digest", "content").mapInArrow(
        batches(_opened, _OPENED), OPENED)


def inventory(spark, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every archived page.

    Length and digest of a revisit are those of the response that it refers to, which must be in
    the archive with the digest that the revisit states.
    """
    # one reading of the archives; of the payloads only their lengths go on
    pages = written(read_pages(spark, folder).select(
        "page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("n")))
    full = pages.where("record_type = 'response'")
    lengths = written(full.where(F.col("n") >= REVISIT_BYTES).groupBy(
        F.col("page_id").alias("refers_to"), "digest").agg(F.max("n").alias("target")))
    again = pages.where("record_type = 'revisit'").drop("n").join(lengths, ["refers_to", "digest"], "left").select(
        "page_id", "record_type", "refers_to", "digest",
        _checked(F.col("target").isNotNull(), F.col("target"), "a revisit refers to no response").alias("n"))
    return full.unionByName(again).select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                                          "record_type", "refers_to")
