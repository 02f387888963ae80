r"""WARC/1.1 archives as chunked record tables.

``write_archive`` turns each row into one WARC record and stores the record's
bytes as rows (record_id, chunk_no, n_chunks, data): the header and the payload in
pieces of ``chunk_bytes`` at most, each a view into the batch that Arrow delivers,
so no record is put together in memory. The rows of a record in order of
chunk_no, records after one another, are a valid WARC file; ``export_files``
writes such files. The table lives in the shared folder under Spark's own commit
protocol, so it works on any file system Spark can write and a lost executor
leaves no half record.

``read_archive`` parses those bytes again. Records of a single chunk are parsed
where they lie; only the chunks of oversized ones are brought together by record
and sorted, and pass through the parser one at a time: it carries the SHA-1 and the
length forward and keeps nothing else.

Equal payloads: that with the smallest page_id is ``response``, the others are
``revisit`` records (profile identical-payload-digest) whose block holds the HTTP
header alone. Payloads are compared by SHA-1 and length. The smallest ids come
from a map-side combined aggregate and go back by a sort-merge join that Spark can
split where one payload holds a large share of all rows. Only pages that may be revisits
take part in it, payload included: a bitmap of fixed size with the ids of revisits tells
the others, whose records are written where their pages are read.

Defined cases
    * null html: an empty payload. null url: an empty WARC-Target-URI.
    * null page_id: never a revisit and never referred to, always ``response``.
    * repeated page_ids with equal payloads at the smallest id: each is ``response``.
    * repeated page_ids with other payloads: each row is judged by its own payload.
    * payloads under ``min_bytes``: always ``response``.
    * empty table: an empty archive and an empty result.
    * extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, discard, in_bitmap, materialize, small_batches, trimmed

CHUNK_BYTES = 1 << 20
ARCHIVE_SCHEMA = "record_id string, chunk_no int, n_chunks int, data binary"
READ_SCHEMA = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, stored_bytes long, intact boolean"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _views(column: pa.Array) -> Iterator[memoryview]:
    """Each value's UTF-8 bytes, as views into Arrow's buffer; null is empty."""
    column = column.cast(pa.large_binary())
    for i in range(len(column)):
        v = column[i]
        yield memoryview(v.as_buffer()) if v.is_valid else memoryview(b"")


def _pieces(view: memoryview, size: int) -> Iterator[memoryview]:
    for at in range(0, len(view), size):
        yield view[at : at + size]


def base32_sha1(state) -> str:
    return base64.b32encode(state.digest()).decode()


def digests(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, names = [], []
            for view in _views(b.column("payload")):
                state = hashlib.sha1()
                for piece in _pieces(view, chunk_bytes):
                    state.update(piece)
                sizes.append(len(view))
                names.append(base32_sha1(state))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.string())], names=["page_id", "payload_bytes", "payload_digest"])

    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[payload_col].alias("payload")).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string")


def decide(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, refers_to: the smallest page_id of an
    equal payload for revisits, else null."""
    own = materialize(digests(pages, id_col, payload_col), "warc-digests")
    eligible = own.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    first = eligible.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = materialize(first, "warc-first")
    joined = own.join(first, ["payload_digest", "payload_bytes"], "left")
    refers = F.when((F.col("page_id") != F.col("first_id")) & (F.col("payload_bytes") >= min_bytes), F.col("first_id"))
    return joined.select("page_id", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def record_head(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None) -> tuple[bytes, str]:
    record_id = f"<urn:page:{'' if page_id is None else page_id}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers_to is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http, record_id


def _in_hex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests as Spark's sha1 writes them."""
    for b in batches:
        made = [base64.b32decode(x).hex() for x in b.column("payload_digest").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("payload_bytes").cast(pa.int32()), pa.array(made, pa.string()), b.column("refers_to")], names=["page_id", "payload_bytes", "hex", "refers_to"])


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the archive table to the shared folder; returns it."""
    small_batches(pages.sparkSession)
    revisits = decide(pages, id_col, payload_col, min_bytes).where("refers_to is not null").distinct()
    decided = materialize(revisits.mapInArrow(_in_hex, "page_id long, payload_bytes int, hex string, refers_to long"), "warc-revisits")
    bits = bitmap(decided.select(F.xxhash64("page_id").alias("k")), "k")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[payload_col].alias("payload")).withColumn("k", F.xxhash64("page_id"))

    def chosen(maybe: bool):
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = in_bitmap(bits.value, b.column("k").to_numpy())
                yield b.filter(pa.array(hit if maybe else ~hit))

        return pick

    # by payload too: rows of one page_id may differ in it
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    maybe = rows.mapInArrow(chosen(True), rows.schema).withColumns({"payload_bytes": F.octet_length(payload), "hex": F.sha1(payload)}).join(decided, ["page_id", "payload_bytes", "hex"], "left").select("page_id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(nos, pa.int32()), pa.array(counts, pa.int32()), pa.array(parts, pa.binary())], names=["record_id", "chunk_no", "n_chunks", "data"])
            for x in (ids, nos, counts, parts):
                x.clear()
            return batch

        ids: list[str] = []
        nos: list[int] = []
        counts: list[int] = []
        parts: list[bytes] = []
        held = serial = 0
        task = TaskContext.get().partitionId()
        for b in trimmed(batches):
            refer = b.column("refers_to").to_pylist() if "refers_to" in b.schema.names else [None] * b.num_rows
            for page_id, url, refers_to, view in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), refer, _views(b.column("payload"))):
                state = hashlib.sha1()
                for piece in _pieces(view, chunk_bytes):
                    state.update(piece)
                head, record_id = record_head(page_id, url, len(view), base32_sha1(state), refers_to)
                body = view if refers_to is None else view[:0]
                n = max(1, -(-len(body) // chunk_bytes))
                serial += 1
                key = f"{record_id}/{task}{'r' if 'refers_to' in b.schema.names else 'p'}/{serial}"  # repeated page_ids keep their chunks apart
                for k in range(n):
                    part = (head if k == 0 else b"") + bytes(body[k * chunk_bytes : (k + 1) * chunk_bytes]) + (b"\r\n\r\n" if k == n - 1 else b"")
                    ids.append(key)
                    nos.append(k)
                    counts.append(n)
                    parts.append(part)
                    held += len(part)
                    if held >= 4 * chunk_bytes:
                        yield flush()
                        held = 0
        if ids:
            yield flush()

    def run_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(chosen(False)(batches))

    archive = materialize(maybe.mapInArrow(run, ARCHIVE_SCHEMA).unionByName(rows.mapInArrow(run_others, ARCHIVE_SCHEMA)), "warc-archive")
    discard(decided)
    return archive


class RecordParser:
    """Takes the chunks of one record in order; keeps the header, a digest and a length."""

    def __init__(self):
        self.head: dict[bytes, bytes] | None = None
        self.http: dict[bytes, bytes] = {}
        self.state = hashlib.sha1()
        self.block = self.left = self.stored = 0

    @staticmethod
    def _fields(lines: list[bytes]) -> dict[bytes, bytes]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}

    def feed(self, chunk: bytes) -> None:
        view = memoryview(chunk)
        if self.head is None:
            # the first chunk holds both headers whole: they are never cut
            end = chunk.index(b"\r\n\r\n")
            self.head = self._fields(chunk[:end].split(b"\r\n")[1:])
            begin = end + 4
            http_end = chunk.index(b"\r\n\r\n", begin) + 4
            self.http = self._fields(chunk[begin : http_end - 4].split(b"\r\n")[1:])
            self.left = int(self.head[b"content-length"]) - (http_end - begin)
            view = view[http_end:]
        body = view[: self.left]
        self.state.update(body)
        self.stored += len(body)
        self.left -= len(body)

    def result(self) -> tuple:
        number = lambda raw: int(x) if (x := raw.removeprefix(b"<urn:page:").removesuffix(b">")) else None
        head = self.head or {}
        kind = head[b"warc-type"].decode()
        said = head[b"warc-payload-digest"].decode().removeprefix("sha1:")
        revisit = kind == "revisit"
        size = int(self.http[b"content-length"]) if revisit else self.stored
        digest = said if revisit else base32_sha1(self.state)
        intact = self.left == 0 and digest == said and size == int(self.http[b"content-length"])
        return number(head[b"warc-record-id"]), kind, number(head[b"warc-refers-to"]) if revisit else None, head[b"warc-target-uri"].decode("utf-8", "replace"), size, digest, self.stored, intact


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest", "stored_bytes", "intact"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    parser: RecordParser | None = None
    for b in batches:
        out = []
        for no, n, data in zip(b.column("chunk_no").to_pylist(), b.column("n_chunks").to_pylist(), b.column("data")):
            if no == 0:
                parser = RecordParser()
            parser.feed(data.as_py())
            if no == n - 1:
                out.append(parser.result())
        cols = list(zip(*out)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def read_archive(archive: DataFrame) -> DataFrame:
    """One row per record, read back from its bytes."""
    small = archive.where("n_chunks = 1")
    large = archive.where("n_chunks > 1")
    large = large.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return small.mapInArrow(_parse, READ_SCHEMA).unionByName(large.mapInArrow(_parse, READ_SCHEMA))


def export_files(archive: DataFrame, folder: str) -> list[str]:
    """Write one .warc file per partition to a folder that all machines mount. Files
    appear by rename, so a repeated task replaces its own file and no other."""

    def run(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = os.path.join(folder, f"part-{part:05d}.warc")
        with open(f"{target}.{os.getpid()}.tmp", "wb") as out:
            for b in batches:
                for data in b.column("data"):
                    out.write(data.as_py())
        os.replace(out.name, target)
        yield pa.RecordBatch.from_arrays([pa.array([target])], names=["file"])

    os.makedirs(folder, exist_ok=True)
    ordered = archive.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")

    def with_part(batches):
        return run(TaskContext.get().partitionId(), batches)

    return sorted(r["file"] for r in ordered.mapInArrow(with_part, "file string").collect())
