"""WARC archives written and read as streams of chunks.

A record is never held whole: payloads travel as (record, chunk number, bytes)
rows, the writer appends chunk after chunk to a gzip member, and the reader
hands out chunks with the digest so far. Archives lie in the shared folder;
a task writes under a name of its own, and only files that a finished task
reports are read, so tasks can be repeated at any time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, scratch_path

CHUNK = 256 << 10
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_DATE = b"2000-01-01T00:00:00Z"


def decide(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(row, type, refers_to): of equal payloads the one with the largest id is the response."""
    named = pages.where((F.col("size") >= min_bytes) & F.col("id").isNotNull())
    last = named.groupBy("digest", "size").agg(F.max("id").alias("last"), F.min("id").alias("first")).where("first < last").select("digest", "size", "last")
    return named.join(last, ["digest", "size"]).where("id < last").select("id", "digest", F.col("last").alias("refers_to")).distinct()


def _head(kind: bytes, row: dict, length: int) -> bytes:
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + kind,
        b"WARC-Record-ID: <urn:page:%s>" % str(row["id"]).encode(),
        b"WARC-Date: " + _DATE,
        b"WARC-Target-URI: " + (row["url"] or "").replace("\r", "").replace("\n", "").encode(),
        b"WARC-Payload-Digest: sha1:" + base64.b32encode(row["sha"]),
        b"Content-Type: application/http;msgtype=response",
        b"Content-Length: %d" % length,
    ]
    if row["refers_to"] is not None:
        lines += [b"WARC-Refers-To: <urn:page:%d>" % row["refers_to"], b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def _writer(folder: str, level: int):
    """Chunk rows of one record follow each other; each record becomes a gzip member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, sink, records, pack = f"{base}/part-{uuid.uuid4().hex}.warc.gz", None, 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("id", "url", "sha", "refers_to", "size", "chunk", "last")}
                if sink is None:
                    sink = fs.open_output_stream(name, compression=None)
                if row["chunk"] == 0:
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    http = _HTTP % row["size"]
                    revisit = row["refers_to"] is not None
                    sink.write(pack.compress(_head(b"revisit" if revisit else b"response", row, len(http) + (0 if revisit else row["size"])) + http))
                    records += 1
                if row["refers_to"] is None:
                    data = batch.column("data")[i].as_buffer()
                    if data is not None:
                        sink.write(pack.compress(data))
                if row["last"]:
                    sink.write(pack.compress(b"\r\n\r\n") + pack.flush())
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[1]]), pa.array([records], pa.int64())], names=["file", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write one record per row below ``folder``; returns the finished files (file, records).

    Of rows whose payloads are equal and of at least ``min_bytes`` bytes those
    under the largest id are responses and the others revisit it; smaller
    payloads, and rows with a null id, are all responses. A null payload is
    empty. The only shuffle of payloads is the join with the revisit list.
    """
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    marked = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    revisits = materialize(decide(marked.select("id", "digest", "size"), min_bytes), "revisits")
    joined = marked.join(revisits, ["id", "digest"], "left")
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / CHUNK)).cast("int")
    numbers = F.when(F.col("refers_to").isNotNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1))
    # cut before they become rows: no row carries more than its own chunk
    cut = F.transform(numbers, lambda i: F.struct(i.alias("chunk"), F.when(F.col("refers_to").isNull(), F.substring("payload", i * CHUNK + 1, F.lit(CHUNK))).alias("data")))
    chunks = joined.select("id", "url", "size", "refers_to", F.unhex("digest").alias("sha"), n.alias("n"), F.explode(cut).alias("c")).select(
        "id", "url", "size", "refers_to", "sha", "c.chunk", (F.col("refers_to").isNotNull() | (F.col("c.chunk") == F.col("n") - 1)).alias("last"), "c.data"
    )
    return materialize(chunks.mapInArrow(_writer(folder, level), "file string, records long"), "archives")


class _Stream:
    """Decompressed bytes of a file of gzip members, a piece at a time."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source, self.pack, self.buffer, self.ended = source, zlib.decompressobj(31), b"", False

    def _more(self) -> bool:
        while not self.ended:
            if self.pack.eof:
                rest = self.pack.unused_data or self.source.read(CHUNK)
                if not rest:
                    self.ended = True
                    return False
                self.pack = zlib.decompressobj(31)
            else:
                rest = self.pack.unconsumed_tail or self.source.read(CHUNK)
                if not rest:
                    raise EOFError("the archive ends inside a record")
            if got := self.pack.decompress(rest, CHUNK):
                self.buffer += got
                return True
        return False

    def line(self) -> bytes | None:
        while (at := self.buffer.find(b"\n")) < 0:
            if not self._more():
                return None
        out, self.buffer = self.buffer[: at + 1], self.buffer[at + 1 :]
        return out.rstrip(b"\r\n")

    def some(self, n: int) -> bytes:
        """Up to n bytes; as many as are at hand."""
        if not self.buffer and not self._more():
            raise EOFError("the archive ends inside a record")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def fields(self) -> dict[bytes, bytes]:
        found = {}
        while line := self.line():
            name, _, value = line.partition(b":")
            found[name.strip().lower()] = value.strip()
        return found


def _page(value: bytes | None) -> int | None:
    tail = value.rpartition(b":")[2].rstrip(b">") if value else b""
    return int(tail) if tail.lstrip(b"-").isdigit() else None


CHUNK_ROWS = "file string, record long, chunk int, type string, id long, url string, refers_to long, declared string, bytes long, digest string, data binary"


def _reader(folder: str, with_data: bool):
    def rows(name: str, fs: pafs.FileSystem, base: str) -> Iterator[tuple]:
        with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
            stream, record = _Stream(source), 0
            while (line := stream.line()) is not None:
                if not line.startswith(b"WARC/"):
                    continue
                head = stream.fields()
                left = int(head[b"content-length"])
                sha, chunk = hashlib.sha1(), 0
                # the HTTP header belongs to the block, not to the payload
                status = stream.line()
                left -= len(status) + 2
                while http := stream.line():
                    left -= len(http) + 2
                left -= 2
                about = (head[b"warc-type"].decode(), _page(head.get(b"warc-record-id")), head[b"warc-target-uri"].decode(), _page(head.get(b"warc-refers-to")), head[b"warc-payload-digest"].decode().removeprefix("sha1:"))
                while left or not chunk:
                    data = b""
                    while left and len(data) < CHUNK:
                        data += (got := stream.some(min(left, CHUNK - len(data))))
                        left -= len(got)
                    sha.update(data)
                    yield (name, record, chunk, *about, len(data), base64.b32encode(sha.digest()).decode(), data if with_data else None)
                    chunk += 1
                record += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNK_ROWS.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in CHUNK_ROWS.split(", ")]

        def batch_of(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)

        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                some, held = [], 0
                for row in rows(name, fs, base):
                    some.append(row)
                    held += 200 + len(row[-1] or b"")
                    if held > 8 * CHUNK:
                        yield batch_of(some)
                        some, held = [], 0
                if some:
                    yield batch_of(some)

    return run


def read_chunks(files: DataFrame, folder: str, *, with_data: bool = False) -> DataFrame:
    """The chunk table of the archives: a row for each record and chunk number, with the digest of the payload so far.

    A revisit and an empty payload have one chunk of no bytes; a record written
    for a null id has a null id, one for a null URL an empty one. No files give
    no rows; other columns of ``files`` are ignored.
    """
    spark = files.sparkSession
    spread = files.select("file").repartition(max(1, 2 * spark.sparkContext.defaultParallelism))
    return spread.mapInArrow(_reader(folder, with_data), CHUNK_ROWS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: page id, url, payload_bytes, payload_digest, record_type, refers_to; revisits are resolved to what they refer to."""
    whole = chunks.groupBy("file", "record").agg(
        F.sum("bytes").alias("bytes"), F.max_by("digest", "chunk").alias("digest"), *(F.first(c).alias(c) for c in ("type", "id", "url", "refers_to", "declared"))
    )
    whole = materialize(whole, "records")
    kept = whole.where("type = 'response'")
    of = kept.where("id is not null").select(F.col("id").alias("refers_to"), F.col("digest").alias("declared"), F.col("bytes").alias("of_bytes")).distinct()
    named = F.col("id").alias("page_id")
    back = whole.where("type = 'revisit'").join(of, ["refers_to", "declared"]).select(named, "url", F.col("of_bytes").alias("payload_bytes"), F.col("declared").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
    return kept.select(named, "url", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(back)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write archives of ``pages`` and read their records back: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    One row per row of ``pages``. Nulls, empty and repeated payloads, repeated
    ids and payloads of any length are as ``write_archives`` states; an empty
    table gives an empty result; other columns are ignored.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return records(read_chunks(write_archives(pages, folder, **options), folder))
