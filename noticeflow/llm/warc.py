"""Operator 10, WARC archives as a chunked record table.

An archive is a table of rows (archive, record, chunk_no, data, block_sha1): the `data` of its records in order
are the bytes of a WARC 1.1 file, and no row holds more than `chunk_bytes`. An archive's name is new for every task
of every write, so later writes add archives. Payloads reach the writers in slices that are cut beside the scan, and
leave them chunk by chunk with incremental digests; readers likewise take a record's chunks one by one. Python thus
holds an Arrow batch (which Spark bounds in bytes, see spark.sql.execution.arrow.maxBytesPerBatch) and a chunk, never a
record; the source row itself is as large as its scan reads it. Equal payloads are told by SHA-1 and length. `block_sha1` is the SHA-1 of the record's bytes up to and with that chunk: a reader checks each chunk as it
comes. Records with equal payloads of at least `least_bytes` are one response and revisits that refer to it.

Defined results: null html is an empty payload; a null url leaves its header out; of equal payloads the smallest
page_id is the response (all rows with that page_id and payload are; a null page_id only if there is no other);
repeated rows are records of their own; an empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm import kernel as K
from noticeflow.llm.shared import cut, only, table_path

TABLE = "archive string, record long, chunk_no long, data binary, block_sha1 binary"
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
#: Rows that one Arrow batch of the writer holds: a few, as each may be a whole chunk.
BATCH_ROWS = 64
#: Payloads that occur again (about 60 bytes each) up to which all of them are sent to every executor.
BROADCAST_PAYLOADS = 100_000
#: Fixed texts of the format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32_of(digest: bytes) -> str:
    """Bare upper-case base32."""
    return base64.b32encode(digest).decode()


def _record_id(digest: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}/{page_id}')}>"


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_head(page_id: int | None, url: str | None, size: int, digest: str, first: int | None, response: bool) -> bytes:
    """What stands before a record's payload: its header, and the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = len(http) + (size if response else 0)
    lines = [f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {_record_id(digest, page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {block}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if not response:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(digest, first)}"]
        if first is not None:
            lines.append(f"X-Refers-To-Page: {first}")
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + http


class RecordWriter:
    """Takes a record's bytes in any pieces and gives chunks of one size, each with the digest of all bytes so far."""

    def __init__(self, size: int):
        self.size, self.held, self.sha, self.no = size, bytearray(), hashlib.sha1(), 0

    def _chunk(self) -> tuple[int, bytes, bytes]:
        data = bytes(self.held)
        self.held.clear()
        self.sha.update(data)
        self.no += 1
        return self.no - 1, data, self.sha.copy().digest()

    def feed(self, part: memoryview | bytes) -> Iterator[tuple[int, bytes, bytes]]:
        at = 0
        while at < len(part):
            take = min(self.size - len(self.held), len(part) - at)
            self.held += part[at : at + take]
            at += take
            if len(self.held) == self.size:
                yield self._chunk()

    def close(self) -> Iterator[tuple[int, bytes, bytes]]:
        yield from self.feed(b"\r\n\r\n")
        if self.held:
            yield self._chunk()


def write_archive(pages: DataFrame, path: str, *, chunk_bytes: int = 256 << 10, least_bytes: int = 0) -> None:
    """Appends a record per row of pages (page_id, url, html) to the record table at `path`; a task writes an archive."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body"))
    rows = rows.select("*", F.unhex(F.sha1("body")).alias("digest"), F.octet_length("body").cast("long").alias("size"))
    # only payloads that occur again need their first page
    shared = rows.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_rows")).where((F.col("_rows") > 1) & (F.col("size") >= least_bytes)).select("digest", "first", F.lit(True).alias("again"))
    shared = cut(shared)
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_PAYLOADS else shared
    marked = rows.join(shared, "digest", "left").withColumn("response", F.col("again").isNull() | F.col("first").eqNullSafe(F.col("page_id")))
    # slices of a payload follow each other in its row's task; a revisit has none but the first, empty
    at = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(chunk_bytes).cast("long"))
    parts = F.when(F.col("response"), F.transform(at, lambda a: F.substring(F.col("body"), (a + 1).cast("int"), F.lit(chunk_bytes)))).otherwise(F.array(F.lit(b"")))
    sliced = marked.select("page_id", "url", "size", "digest", "first", "response", F.posexplode(parts).alias("at", "part"))
    written = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        archive = f"{written}-{context.partitionId() if context else 0:06d}"
        nth, out, writer = -1, [], None

        def batch_of(rows_):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows_), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["archive", "record", "chunk_no", "data", "block_sha1"])

        def put(chunks):
            for no, data, sha in chunks:
                out.append((archive, nth, no, data, sha))

        for batch in batches:
            raw, edge = K.string_buffers(K.columns(batch, "part"))
            view = memoryview(raw)
            ids, urls, sizes, digests, firsts, responses, ats = (K.columns(batch, c).to_pylist() for c in ("page_id", "url", "size", "digest", "first", "response", "at"))
            for i in range(batch.num_rows):
                if ats[i] == 0:
                    if writer is not None:
                        put(writer.close())
                    nth, writer = nth + 1, RecordWriter(chunk_bytes)
                    put(writer.feed(record_head(ids[i], urls[i], sizes[i], base32_of(digests[i]), firsts[i], responses[i])))
                put(writer.feed(view[edge[i] : edge[i + 1]]))
                if len(out) >= BATCH_ROWS:
                    yield batch_of(out)
                    out.clear()
        if writer is not None:
            put(writer.close())
        if out:
            yield batch_of(out)

    sliced.mapInArrow(write, TABLE).write.mode("append").parquet(path)


class RecordReader:
    """Reads one record from its chunks in order; the payload is digested and dropped (or handed to `sink`)."""

    def __init__(self, sink=None):
        self.head, self.fields, self.sink = bytearray(), None, sink
        self.sha, self.block, self.payload, self.running = hashlib.sha1(), 0, 0, hashlib.sha1()
        self.http, self.in_payload, self.tail, self.intact, self.next = bytearray(), False, bytearray(), True, 0

    def feed(self, no: int, data: bytes, digest: bytes) -> None:
        self.running.update(data)
        self.intact &= no == self.next and self.running.digest() == digest
        self.next += 1
        view = memoryview(data)
        if self.fields is None:
            before = len(self.head)
            self.head += view
            if (end := self.head.find(b"\r\n\r\n")) < 0:
                return
            lines = bytes(self.head[:end]).split(b"\r\n")
            self.intact &= lines[0] == VERSION
            self.fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
            self.left = int(self.fields["content-length"])
            view = view[end + 4 - before :]
            self.head.clear()
        body, rest = view[: self.left], view[self.left :]
        self.left -= len(body)
        if not self.in_payload and len(body):
            before = len(self.http)
            self.http += body
            if (end := self.http.find(b"\r\n\r\n")) >= 0:
                self.in_payload = True
                body = body[end + 4 - before :]
                self.http = self.http[: end + 4]
            else:
                body = body[:0]
        if self.in_payload and len(body):
            self.sha.update(body)
            self.payload += len(body)
            if self.sink:
                self.sink(bytes(body))
        self.tail += rest

    def row(self) -> tuple:
        """page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact."""
        f = self.fields or {}
        kind, said = f.get("warc-type"), f.get("warc-payload-digest", "").removeprefix("sha1:")
        length = next((int(x.partition(b":")[2]) for x in bytes(self.http).split(b"\r\n") if x.lower().startswith(b"content-length:")), -1)
        whole = self.intact and self.fields is not None and self.left == 0 and bytes(self.tail) == b"\r\n\r\n"
        if kind == "response":
            digest = base32_of(self.sha.digest())
            whole &= digest == said and self.payload == length
        else:
            digest = said
        number = lambda k: int(f[k]) if k in f else None
        return number("x-page-id"), f.get("warc-target-uri"), self.payload if kind == "response" else length, digest, kind, number("x-refers-to-page"), whole


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row per record, from its chunks: digests are recomputed and checked (`intact`)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, out = None, None, []

        def batch_of(rows_):
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows_), kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])

        for batch in batches:
            for archive, record, no, data, digest in zip(*(K.columns(batch, c) for c in ("archive", "record", "chunk_no", "data", "block_sha1")), strict=True):
                if (r := (archive.as_py(), record.as_py())) != now:
                    if reader is not None:
                        out.append(reader.row())
                    now, reader = r, RecordReader()
                reader.feed(no.as_py(), data.as_py(), digest.as_py())
            if len(out) >= 5000:
                yield batch_of(out)
                out = []
        if reader is not None:
            out.append(reader.row())
        if out:
            yield batch_of(out)

    table = spark.read.schema(TABLE).parquet(path)
    return table.repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk_no").mapInArrow(read, ROWS)


def export_warc(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Writes each archive of the table as a .warc file in a Hadoop folder, a chunk at a time through the driver."""
    table = spark.read.schema(TABLE).parquet(path).select("archive", "record", "chunk_no", "data").orderBy("archive", "record", "chunk_no")
    out, now, stream, hadoop = [], None, None, spark._jvm.org.apache.hadoop.fs
    for archive, _, _, data in table.toLocalIterator():
        if archive != now:
            if stream is not None:
                stream.close()
            now, name = archive, f"{folder.rstrip('/')}/{archive}.warc"
            p = hadoop.Path(name)
            stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
            out.append(name)
        stream.write(bytes(data))
    if stream is not None:
        stream.close()
    return out


def round_trip(pages: DataFrame, *, path: str | None = None, **options) -> DataFrame:
    """Writes the archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, intact."""
    path = path or table_path(pages.sparkSession, "warc")
    write_archive(pages, path, **options)
    return read_archive(pages.sparkSession, path).drop("url")
