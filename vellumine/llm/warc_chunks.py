"""WARC archives as a chunked record table.

``write_archives`` writes one WARC/1.1 record per page to gzip members in the shared folder, one archive per task. Payloads
reach it as rows of (record, chunk number, chunk) of at most ``CHUNK_BYTES``, which the JVM cuts out of the table's own value, and
are compressed and digested as they come; a record whose digest isn't the one its header names fails. Of equal payloads of at least ``REVISIT_BYTES``, the page with the largest id is the response and the others are
``revisit`` records that name it and hold only the HTTP header.

``chunk_table`` reads archives as rows (record_id, chunk_no, offset, data, digest, ...): a payload is streamed in chunks
of ``CHUNK_BYTES``, each with the SHA-1 of the payload up to its end, so the last chunk's digest is the payload's and
neither writer nor reader holds a whole record. Records without payload get one empty chunk. ``records`` folds the table
into one row per record.

Archives are streamed through the file system that the shared folder's URI names. A payload that very many pages share is a
hot key of the narrow join that finds revisits; one side has it once, and adaptive skew joins split the other.

Defined cases: a null html is an empty payload; repeated rows are records of their own (those with the
largest id are all responses); a null page id is never chosen as response while another id has the payload, and if all ids
of a payload are null its rows are all responses; an empty table gives no archives and an empty result; other
columns are ignored; urls may be null.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.common import column, prepare, shared_dir, table, written

REVISIT_BYTES = 1000
CHUNK_BYTES = 1 << 16
LEVEL = 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2025-01-01T00:00:00Z"
_BREAK = b"\r\n"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Member:
    """One gzip member of an archive, written piece by piece."""

    def __init__(self, sink) -> None:
        self.sink, self.z = sink, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> None:
        self.sink.write(self.z.compress(data))

    def close(self) -> None:
        self.sink.write(self.z.flush())


def _header(lines: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + _BREAK


def _one_line(text: str) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in text)


class Record:
    """One record, written as its payload comes; a revisit (``refers_to``) has the HTTP header of the full payload and no payload."""

    def __init__(self, sink, record_id: str, url: str, digest: str, size: int, refers_to: str | None) -> None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {size}\r\n\r\n".encode()
        self.digest, self.left, self.sha = digest, 0 if refers_to else size, None if refers_to else hashlib.sha1(usedforsecurity=False)
        lines: list[tuple[str, object]] = [
            ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE),
            ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + self.left),
        ]
        if refers_to:
            lines += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
        self.member = _Member(sink)
        self.member.write(_header(lines) + http)

    def write(self, chunk: bytes) -> None:
        self.member.write(chunk)
        self.left -= len(chunk)
        if self.sha:
            self.sha.update(chunk)

    def close(self) -> None:
        if self.left or (self.sha and self.sha.hexdigest() != self.digest):
            raise ValueError("a payload isn't what its record's header says")
        self.member.write(_BREAK * 2)
        self.member.close()


def payload_chunks(pages: DataFrame) -> DataFrame:
    """``pages`` (record_id, url, html, digest, size, refers_to) as rows of chunks (chunk_no, last, data), each record's in order; no exchange."""
    body = F.when(F.col("refers_to").isNull(), F.col("html").cast("binary")).otherwise(F.lit(b""))
    n = F.greatest(F.ceil(F.octet_length("body") / CHUNK_BYTES), F.lit(1)).cast("int")
    cut = pages.withColumn("body", body).withColumn("n", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    data = F.expr(f"substring(body, chunk_no * {CHUNK_BYTES} + 1, {CHUNK_BYTES})")
    return cut.select("record_id", "url", "digest", "size", "refers_to", "chunk_no", (F.col("chunk_no") + 1 == F.col("n")).alias("last"), data.alias("data"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (record_id, url, html, digest, size, refers_to) as archives; rows (path, n_records).

    An archive's name holds the partition and the attempt, so a task that runs again never mixes with a lost one; only
    the archives that the returned rows name count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        n, record = 0, None
        with store.open_output_stream(f"{base}/{name}", compression=None) as sink:
            for batch in batches:
                heads = zip(*[batch.column(c).to_pylist() for c in ("record_id", "url", "digest", "size", "refers_to", "chunk_no", "last")], strict=True)
                for (record_id, url, digest, size, refers_to, chunk_no, last), data in zip(heads, batch.column("data"), strict=True):
                    if chunk_no == 0:
                        record = Record(sink, record_id, url or "", digest, size, refers_to)
                    record.write(memoryview(data.as_buffer()))
                    if last:
                        record.close()
                        n += 1
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n]})

    return payload_chunks(pages).mapInArrow(write, "path string, n_records long")


class _Inflated:
    """The plain bytes of an archive of gzip members, read in bounded pieces."""

    def __init__(self, source) -> None:
        self.source, self.z, self.raw, self.buf = source, zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        if self.z.eof:
            self.raw, self.z = self.z.unused_data or self.raw, zlib.decompressobj(31)
        elif self.z.unconsumed_tail:
            self.raw = self.z.unconsumed_tail
        if not self.raw:
            self.raw = self.source.read(CHUNK_BYTES)
            if not self.raw:
                return False
        raw, self.raw = bytes(self.raw), b""
        self.buf += self.z.decompress(raw, CHUNK_BYTES)
        return True

    def line(self) -> bytes | None:
        while (i := self.buf.find(_BREAK)) < 0:
            if not self._more():
                return None
        out = bytes(self.buf[:i])
        del self.buf[: i + 2]
        return out

    def take(self, most: int) -> bytes:
        """From 1 to ``most`` bytes, or none at the end."""
        while not self.buf:
            if not self._more():
                return b""
        out = bytes(self.buf[:most])
        del self.buf[:most]
        return out


def _fields(src: _Inflated) -> tuple[dict[str, str], int]:
    """Header lines up to the empty one, and their bytes."""
    out, n = {}, 0
    while True:
        line = src.line()
        if line is None:
            raise ValueError("an archive ends inside a record")
        n += len(line) + 2
        if not line:
            return out, n
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out[k.strip().lower()] = v.strip()


def read_chunks(source) -> Iterator[tuple]:
    """The chunk rows of one archive."""
    src, record_no = _Inflated(source), 0
    while (line := src.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head, _ = _fields(src)
        left = int(head["content-length"])
        status = src.line()
        http, n = _fields(src)
        left -= n + len(status or b"") + 2
        fixed = (record_no, head["warc-record-id"].strip("<>"), head["warc-type"], head.get("warc-refers-to", "").strip("<>") or None, head.get("warc-payload-digest"), int(http.get("content-length", 0)))
        sha, chunk_no, offset = hashlib.sha1(usedforsecurity=False), 0, 0
        while left or not chunk_no:
            data = bytearray()
            while left and len(data) < CHUNK_BYTES:
                piece = src.take(min(left, CHUNK_BYTES - len(data)))
                if not piece:
                    raise ValueError("an archive ends inside a payload")
                data += piece
                left -= len(piece)
            sha.update(data)
            yield (*fixed, chunk_no, offset, bytes(data), sha.copy().hexdigest())
            offset += len(data)
            chunk_no += 1
        record_no += 1


CHUNKS = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("record_no", T.LongType()), T.StructField("record_id", T.StringType()), T.StructField("warc_type", T.StringType()), T.StructField("refers_to_id", T.StringType()),
    T.StructField("named_digest", T.StringType()), T.StructField("http_length", T.LongType()), T.StructField("chunk_no", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("digest", T.StringType()),
])


_CHUNK_NAMES = CHUNKS.names


def chunk_table(archives: DataFrame) -> DataFrame:
    """The chunk rows of all archives that ``archives`` (path) names; an Arrow batch holds at most 64 chunks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = pa.string(), pa.int64()
        schema = pa.schema(list(zip(_CHUNK_NAMES, (s, n, s, s, s, s, n, n, n, pa.binary(), s), strict=True)))
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = _open(path)
                with store.open_input_stream(at, compression=None) as source:
                    rows = read_chunks(source)
                    while some := list(islice(rows, 64)):
                        columns = zip(*((path, *r) for r in some), strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return archives.select("path").mapInArrow(read, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: its type, what it refers to, and its payload's bytes and SHA-1.

    For a revisit these are those of the payload it stands for: the digest and length that its headers name.
    """
    revisit = F.first("warc_type") == "revisit"
    narrow = chunks.select(*[f.name for f in CHUNKS if f.name != "data"], F.octet_length("data").alias("n"))
    return narrow.groupBy("archive", "record_no").agg(
        F.first("record_id").alias("record_id"), F.first("warc_type").alias("record_type"), F.first("refers_to_id").alias("refers_to_id"),
        F.when(revisit, F.first("http_length")).otherwise(F.sum("n")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.substring_index(F.first("named_digest"), ":", -1)).otherwise(F.max_by("digest", "chunk_no")).alias("payload_digest"),
    )


def pages_as_records(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Each page with its record id, digest, size and, for a revisit, the record id of its response.

    Who is response is decided on narrow rows; the payloads are exchanged once, by page, so that no task gets all
    copies of one payload.
    """
    rows = pages.select(column(pages, page_id).alias("page_id"), column(pages, url).alias("url"), F.coalesce(column(pages, html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    large = written(rows.filter(F.col("size") >= REVISIT_BYTES).select("page_id", "digest"), folder, "large")
    shared = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    again = large.join(shared, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first").distinct()
    again = written(again, folder, "revisits")
    kinds = rows.join(again, rows.page_id.eqNullSafe(again.p) & (rows.digest == again.d), "left")
    return kinds.select(_record_id("page_id").alias("record_id"), "url", "html", "digest", "size", F.when(F.col("d").isNotNull(), _record_id("first")).alias("refers_to"))


def _record_id(page: str) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("null")), F.lit(":"), F.col("digest"))


def _page_of(record_id: str) -> Column:
    return F.split_part(F.col(record_id), F.lit(":"), F.lit(3)).try_cast("long")


def archive(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` as archives under ``folder`` and return the table (path, n_records) of those that count."""
    prepare(spark)
    return written(write_archives(pages_as_records(pages, folder), f"{folder}/warc"), folder, "archives")


def op3_warc_chunks(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC archives and read back from them."""
    made = archive(spark, table(spark, sf_dir, "pages"), shared_dir(spark))
    out = records(chunk_table(made.repartition(max(1, made.count()))))
    return out.select(_page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page_of("refers_to_id").alias("refers_to"))


ORACLE_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 1000
"""
