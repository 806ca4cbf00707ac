"""Web archives from tables and back, as a table of record chunks.

Every task writes one archive of gzip members, one member a record, and lists it in a
manifest. Names hold the task attempt, and only manifested files are read, so a repeated
attempt leaves a stray file but no double record. Archives are read in blocks: a payload
comes out as rows (record_id, chunk_no, data) with the digest and byte count so far, so
no record is ever held whole in a reading task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermetrics.llm.common import utf8
from ordermetrics.session import scratch_folder, written

CHUNK = 1 << 20
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = (
    "record_id string, page_id bigint, url string, record_type string, refers_to bigint, chunk_no bigint, data binary, "
    "bytes bigint, digest string, payload_bytes bigint, payload_digest string, last boolean")


def marked(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type and refers_to.

    Of the pages with one payload of ``least`` bytes or more the one of smallest
    page_id is the response and the others revisit it; rows that repeat that page_id
    are responses too. A null page_id is never the smallest beside others.
    """
    body = utf8("html")
    pages = pages.drop("payload_bytes", "payload_digest", "record_type", "refers_to")
    pages = pages.withColumn("payload_bytes", F.octet_length(body).cast("long")).withColumn("payload_digest", F.sha2(body, 256))
    groups = pages.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("payload_digest").alias("_d"), "_first")
    pages = pages.join(written(groups, "same-payload"), F.col("payload_digest") == F.col("_d"), "left")
    revisit = F.col("_d").isNotNull() & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return pages.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(revisit, F.col("_first"))).drop("_d", "_first")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest[:32]}>"


def _one_line(value: str | None) -> str:
    return "" if value is None else value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _many_lines(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Writes ``pages`` (page_id, url, html; see ``marked``) and returns the stored manifest (path, records).

    ``folder`` is a URI every executor reaches; by default a new one in the shared folder.
    A null html is an empty payload, a null url is left out of the header.
    """
    folder = folder or scratch_folder(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        records, out = 0, None
        for batch in batches:
            for page_id, url, html, size, digest, kind, refers_to in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns)), strict=True):
                out = out or store.open_output_stream(path, compression=None)
                view = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                head = [
                    "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}",
                    *([f"WARC-Target-URI: {_one_line(url)}"] if url is not None else []), f"WARC-Payload-Digest: sha256:{digest}",
                    "Content-Type: application/http; msgtype=response", f"X-Payload-Length: {size}"]
                if kind == "revisit":
                    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
                    view = memoryview(b"")
                head.append(f"Content-Length: {len(http) + len(view)}")
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http))
                for at in range(0, len(view), CHUNK):
                    out.write(gz.compress(view[at : at + CHUNK]))
                out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                records += 1
        if out:
            out.close()
            yield pa.record_batch({"path": [path], "records": pa.array([records], pa.int64())})

    # a binary column: the payload comes as bytes, without a Python string
    rows = pages.select("page_id", "url", F.when(F.col("html").isNotNull(), utf8("html")).alias("html"), "payload_bytes", "payload_digest", "record_type", "refers_to")
    return written(rows.mapInArrow(write, "path string, records bigint").withColumn("folder", F.lit(folder)), "warc-manifest")


class _Blocks:
    """Plain bytes of one archive, read a block at a time; one gzip member is one record."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.raw, self.out = stream, size, b"", b""
        self.gz = zlib.decompressobj(31)

    def more(self) -> bool:
        """Appends some bytes of the current member; False at its end."""
        while not self.gz.eof:
            self.raw = self.raw or self.stream.read(self.size)
            if not self.raw:
                raise EOFError("an archive ends inside a record")
            got = self.gz.decompress(self.raw, self.size)
            self.raw = self.gz.unconsumed_tail or self.gz.unused_data
            if got:
                self.out += got
                return True
        return False

    def next_member(self) -> bool:
        self.raw = self.raw or self.stream.read(self.size)
        self.gz, self.out = zlib.decompressobj(31), b""
        return bool(self.raw)

    def until(self, mark: bytes) -> bytes:
        while mark not in self.out:
            if not self.more():
                raise EOFError("a record has no end of header")
        head, self.out = self.out.split(mark, 1)
        return head

    def chunk(self, size: int) -> bytes:
        """``size`` bytes of the member."""
        while len(self.out) < size and self.more():
            pass
        if len(self.out) < size:
            raise EOFError("a record is shorter than its header says")
        got, self.out = self.out[:size], self.out[size:]
        return got


def _chunks(path: str, stream, size: int) -> Iterator[tuple]:
    blocks = _Blocks(stream, size)
    while blocks.next_member():
        head = dict(x.split(": ", 1) for x in blocks.until(b"\r\n\r\n").decode().split("\r\n")[1:])
        http = blocks.until(b"\r\n\r\n")
        left = int(head["Content-Length"]) - len(http) - 4
        digest, done, number = hashlib.sha256(), 0, 0
        named = head["WARC-Record-ID"].split(":")[2]
        refers = head.get("WARC-Refers-To", "::").split(":")[2]
        url = _many_lines(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None
        revisit = head["WARC-Type"] == "revisit"
        while True:
            data = blocks.chunk(min(size, left))
            left, done = left - len(data), done + len(data)
            digest.update(data)
            told = head["WARC-Payload-Digest"].removeprefix("sha256:")
            if not left and not revisit and digest.hexdigest() != told:
                raise ValueError(f"{path}: payload of {head['WARC-Record-ID']} doesn't have its digest")
            yield (head["WARC-Record-ID"], int(named) if named else None, url, head["WARC-Type"], int(refers) if refers else None, number,
                   data, done, digest.hexdigest(), int(head["X-Payload-Length"]), told, not left)
            if not left:
                break
            number += 1
        blocks.chunk(4)
        while blocks.more():  # the member's end
            pass


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """The archives of ``manifest`` as chunk rows (``CHUNKS``), ``last`` marking a record's last chunk.

    ``bytes`` and ``digest`` are those of the payload up to and with the chunk;
    payload_bytes and payload_digest those of the full payload, for revisits as the
    header tells. A response whose bytes don't have its digest raises.
    """
    files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(list(zip(names, kinds, strict=True))))

        for batch in batches:
            for row in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(row["folder"])
                rows, held = [], 0
                with store.open_input_stream(row["path"], compression=None) as stream:
                    for chunk in _chunks(row["path"], stream, chunk_bytes):
                        rows.append(chunk)
                        held += len(chunk[6])
                        if held >= 4 * chunk_bytes or len(rows) >= 2000:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    names = [x.split()[0] for x in CHUNKS.split(", ")]
    of = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds = [of[x.split()[1]] for x in CHUNKS.split(", ")]
    return manifest.select("path", "folder").repartition(files).mapInArrow(read, CHUNKS)


def read_records(manifest: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row a record: page_id, url, record_type, refers_to, payload_bytes, payload_digest."""
    return read_chunks(manifest, chunk_bytes).where("last").select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")
