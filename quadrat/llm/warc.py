"""WARC archives of pages: a writer and a sequential reader.

Every record is a gzip member of its own. The writer runs in the tasks that hold the pages and starts a new archive beyond
``ARCHIVE_BYTES``; the archives go to the shared folder through pyarrow's file systems, which know ``file``, ``hdfs``, ``gs``, ``abfs`` and ``s3``; ``s3a`` and
``s3n`` are taken as ``s3``. Archives of attempts that failed are never read, as only the paths that a successful task returned are kept in the written list
of archives. A record's id comes from its archive and its place there, so no two are alike, whatever the keys of the pages.

The reader walks an archive from front to back: blocks of ``READ_BYTES`` are inflated step by step, a record ends where its member
ends, its block is framed by Content-Length, and block and payload digests are verified. It holds one record at a time.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.text import text_slices
from quadrat.operators.staging import stage, staging_root

LEAST_BYTES = 100
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 256 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of archives for each reading task, unless there are few archives.
TASK_BYTES = 256 << 20
_END = b"\r\n\r\n"
_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


class WarcError(ValueError):
    """An archive that does not hold what its records say."""


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system of a folder and the folder's path there. Spark's names of the S3 schemes mean the same store."""
    scheme, colon, rest = folder.partition("://")
    if colon and scheme in ("s3a", "s3n"):
        folder = f"s3://{rest}"
    return fs.FileSystem.from_uri(folder)


def mark_revisits(
    pages: DataFrame, key: str = "page_id", html: str = "html", least: int = LEAST_BYTES, url: str | None = None
) -> DataFrame:
    """The pages with ``__digest``, ``__bytes``, ``__type``, ``__refers_to`` and, NULL where ``url`` is not given, ``__refers_to_url``.

    Of pages with equal payloads of at least ``least`` bytes, the one with the smallest key is the response and the others
    revisit it; rows that repeat the smallest key are responses too. NULL html is an empty payload; a NULL key counts as the largest.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    marked = pages.withColumns(
        {"__digest": F.sha2(payload.cast("binary"), 256), "__bytes": F.octet_length(payload).cast("long")}
    )
    firsts = (
        marked.where(F.col("__bytes") >= least)
        .groupBy(F.col("__digest").alias("__d"))
        .agg(
            F.min(key).alias("__first"),
            (F.min_by(url, key) if url else F.lit(None).cast("string")).alias("__first_url"),
            F.count("*").alias("__n"),
        )
        .where(F.col("__n") > 1)
        .drop("__n")
    )
    joined = marked.join(firsts, F.col("__digest") == F.col("__d"), "left")
    repeat = F.col("__d").isNotNull() & ~F.col(key).eqNullSafe(F.col("__first"))
    return joined.withColumns(
        {
            "__type": F.when(repeat, "revisit").otherwise("response"),
            "__refers_to": F.when(repeat, F.col("__first")),
            "__refers_to_url": F.when(repeat, F.col("__first_url")),
        }
    ).drop("__d", "__first", "__first_url")


def record_id(archive: str, place: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'{archive} {place}').urn}>"


def format_record(
    name: str, key, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to, refers_to_url: str | None = None
) -> bytes:
    """One record, of the id ``name``, as a gzip member. A revisit keeps the HTTP head and leaves the payload out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if kind == "response":
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if key is not None:
        lines.append(f"X-Page-Key: {key}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Key: {refers_to}"]
        if refers_to_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {quote(refers_to_url, safe=_SAFE)}")
    lines += [
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    squeeze = zlib.compressobj(wbits=31)
    return squeeze.compress("\r\n".join(lines).encode() + _END + block + _END) + squeeze.flush()


def _writer(folder: str, key: str, url: str, html: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        out, path, written, place = None, "", 0, 0
        for batch in text_slices(batches, html):
            columns = [batch.column(c).to_pylist() for c in (key, url, html, "__bytes", "__digest", "__type", "__refers_to", "__refers_to_url")]
            for k, u, page, size, digest, kind, first, first_url in zip(*columns):
                if out is None:
                    path, written, place = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                name = record_id(path, place)
                member = format_record(name, k, u, (page or "").encode(), size, digest, kind, first, first_url)
                out.write(member)
                place += 1
                written += len(member)
                if written >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield _listed(path, written)
        if out is not None:
            out.close()
            yield _listed(path, written)

    return run


def _listed(path: str, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": pa.array([path]), "size": pa.array([size], pa.int64())})


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages as archives; returns the written list of their (path, size). No pages give no archives."""
    spark = pages.sparkSession
    folder = f"{staging_root(spark)}/warc-{uuid.uuid4().hex}"
    store, root = open_store(folder)
    store.create_dir(root)
    marked = mark_revisits(pages.select(key, url, html), key, html, url=url)
    archives = stage(marked.mapInArrow(_writer(folder, key, url, html), "path string, size long"), "archives")
    return archives.withColumn("folder", F.lit(folder))


@dataclass
class Record:
    """A record as it was read; ``payload`` is None where it was not asked for or the record is a revisit."""

    headers: dict[str, str] = field(default_factory=dict)
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None


class _Framer:
    """Takes a member's inflated bytes piece by piece: head, block of the given length, end."""

    def __init__(self, keep: bool):
        self.record, self.keep = Record(), keep
        self.pending, self.left, self.in_block, self.in_payload = b"", 0, False, False
        self.block, self.payload, self.kept = hashlib.sha256(), hashlib.sha256(), []

    def feed(self, data: bytes) -> None:
        self.pending += data
        if not self.in_block:
            head, found, rest = self.pending.partition(_END)
            if not found:
                return
            version, _, lines = head.partition(b"\r\n")
            if not version.startswith(b"WARC/"):
                raise WarcError("A record does not start with its version.")
            self.record.headers = _fields(lines)
            self.left = int(self.record.headers["content-length"])
            self.in_block, self.pending = True, rest
        part, self.pending = self.pending[: self.left], self.pending[self.left :]
        if self.in_payload:
            self._take(part)
        else:
            self.kept.append(part)
            head, found, rest = b"".join(self.kept).partition(_END)
            if found:
                self.record.http = _fields(head.partition(b"\r\n")[2])
                self.in_payload, self.kept = True, []
                self._take(rest)
        self.block.update(part)
        self.left -= len(part)

    def _take(self, part: bytes) -> None:
        self.payload.update(part)
        if self.keep:
            self.kept.append(part)

    def close(self) -> Record:
        headers = self.record.headers
        if not self.in_payload or self.left or self.pending != _END:
            raise WarcError(f"Record {headers.get('warc-record-id')} is not as long as its Content-Length.")
        if headers["warc-block-digest"] != f"sha256:{self.block.hexdigest()}":
            raise WarcError(f"Record {headers.get('warc-record-id')} does not match its block digest.")
        if headers["warc-type"] == "response":
            if headers["warc-payload-digest"] != f"sha256:{self.payload.hexdigest()}":
                raise WarcError(f"Record {headers.get('warc-record-id')} does not match its payload digest.")
            self.record.payload = b"".join(self.kept) if self.keep else None
        return self.record


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(b"\r\n") if line)
    return {name.strip().lower().decode(): value.strip().decode() for name, _, value in pairs}


def read_records(stream, keep: bool = True, size: int = READ_BYTES) -> Iterator[Record]:
    """The records of an archive in order; ``stream`` has ``read``."""
    inflate, framer, began = zlib.decompressobj(wbits=31), _Framer(keep), False
    while data := stream.read(size):
        while data:
            began = True
            try:
                framer.feed(inflate.decompress(data))
            except zlib.error as error:
                raise WarcError(f"A member cannot be inflated: {error}") from error
            data = b""
            if inflate.eof:
                data = inflate.unused_data
                yield framer.close()
                inflate, framer, began = zlib.decompressobj(wbits=31), _Framer(keep), False
    if began:
        raise WarcError("An archive ends inside a record.")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_key, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each record of the archives.

    Archives are dealt evenly to as many tasks as there are archives, or one for every ``TASK_BYTES`` where that is enough for all cores. Keys are strings, as the archive has them; sizes and digests are those of the full payload,
    which a revisit names. Raises ``WarcError`` where a record does not match its length or digests.
    """
    schema = (
        "page_key string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, "
        "payload binary"
    )
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, path in zip(batch.column("folder").to_pylist(), batch.column("path").to_pylist()):
                store, _ = open_store(folder)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for record in read_records(stream, payloads):
                        h = record.headers
                        url = h.get("warc-target-uri")
                        rows.append(
                            (
                                h.get("x-page-key"),
                                None if url is None else unquote(url),
                                int(record.http["content-length"]),
                                h["warc-payload-digest"].removeprefix("sha256:"),
                                h["warc-type"],
                                h.get("x-refers-to-key"),
                                record.payload,
                            )
                        )
                        held += len(record.payload or b"") + 200
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return archives.repartitionByRange(reading_tasks(archives), "path").mapInArrow(run, schema)


def reading_tasks(archives: DataFrame) -> int:
    count, size = archives.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cores = archives.sparkSession.sparkContext.defaultParallelism
    return max(1, min(count, max(4 * cores, size // TASK_BYTES)))
