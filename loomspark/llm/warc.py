"""WARC archives as a chunked record table.

A record's payload never has to exist as one object in a task: it is a run of (record id, chunk
number, bytes) rows, cut by the scan. SHA-1 and size are carried along the chunks; the writer
streams the chunks of a record into a gzip member of its own, the reader streams members back out
as chunk rows, each with the digest so far.

Records with equal payloads (same SHA-1 and size) of at least `least_revisit` bytes are stored once:
the one with the largest id is the response, the others are revisits that refer to it.

An archive is written to a temporary name and then renamed to one that tells its task, so a repeated
task replaces what the lost one left. `write` returns the list of archives; `read` opens no others.

Defined results: a null payload is the empty one; a record without id never is the response if
another with its payload has an id. Rows that repeat id and payload are alike, all responses or
all revisits. Empty tables give no archive and no rows. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, small

CHUNK = 1 << 20
READ = "record long, kind string, uri string, refers long, size long, digest string, chunk int, last boolean, running string, data binary"


def place(root: str) -> tuple[fs.FileSystem, str]:
    """A file system that tasks open by themselves, and the path in it."""
    return fs.FileSystem.from_uri("file://" + root if root.startswith("/") else root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root)


def whole(spark: SparkSession, root: str) -> str:
    """The path with its scheme, so that a bare one is in Hadoop's default file system for tasks, too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def records(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    """(record, uri, body, mark): mark is a hash by which a row finds its own digest again."""
    rows = pages.select(F.col(page_id).cast("long").alias("record"), F.col(url).cast("string").alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary")).alias("body"))
    return rows.withColumn("mark", F.xxhash64("record", "body"))


def chunked(rows: DataFrame, chunk: int) -> DataFrame:
    """rows with their body as chunk rows (chunk, last, data), in order within a record.

    Only chunk numbers are generated; each chunk is cut from the body as it is passed on, so no array of chunks exists.
    """
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / chunk).cast("int"))
    numbered = rows.withColumn("__n", n).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    data = F.substring("body", F.col("chunk") * chunk + 1, F.lit(chunk))
    return numbered.select(*[c for c in rows.columns if c != "body"], "chunk", (F.col("chunk") == F.col("__n") - 1).alias("last"), data.alias("data"))


def base32(sha: object) -> str:
    return base64.b32encode(sha.digest()).decode()


def digests(chunks: DataFrame) -> DataFrame:
    """(record, mark, size, digest) by one pass over the chunk rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, size = hashlib.sha1(), 0
        for batch in batches:
            ends, sizes, found = [], [], []
            for i, (last, data) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
                raw = data.as_buffer()
                sha.update(raw)
                size += len(raw)
                if last:
                    ends.append(i), sizes.append(size), found.append(base32(sha))
                    sha, size = hashlib.sha1(), 0
            at = pa.array(ends, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sizes, pa.int64()), pa.array(found, pa.string())], names=["record", "mark", "size", "digest"])

    return chunks.select("record", "mark", "last", "data").mapInArrow(run, "record long, mark long, size long, digest string")


def header(row: dict) -> bytes:
    name = lambda x: f"<urn:record:{'' if x is None else x}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if row['revisit'] else 'response'}", f"WARC-Record-ID: {name(row['record'])}", f"WARC-Target-URI: {' '.join((row['uri'] or '').split())}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{row['digest']}"]
    if row["revisit"]:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(row['refers'])}", f"X-Payload-Length: {row['size']}"]
    return "\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if row['revisit'] else row['size']}", "", ""]).encode("utf-8", "surrogatepass")


def write(pages: DataFrame, root: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_revisit: int = 0, chunk: int = CHUNK, archive_bytes: int = 64 << 20, level: int = 4) -> DataFrame:
    """Write pages as gzip WARC archives under root; returns their list (archive, records)."""
    rows = records(pages, page_id, url, payload)
    told = cut(digests(chunked(rows, chunk)).distinct(), "digests")
    largest = told.groupBy("digest", "size").agg(F.max("record").alias("refers"))
    revisit = (F.col("size") >= least_revisit) & ~F.col("record").eqNullSafe(F.col("refers"))
    plan = told.join(largest, ["digest", "size"]).select(F.col("record").alias("of"), F.col("mark").alias("of_mark"), "size", "digest", revisit.alias("revisit"), F.when(revisit, F.col("refers")).alias("refers"))
    joined = rows.join(plan, (F.col("mark") == F.col("of_mark")) & F.col("record").eqNullSafe(F.col("of"))).drop("of", "of_mark", "mark")
    body = F.when(~F.col("revisit"), F.col("body")).otherwise(F.lit("").cast("binary"))
    at = f"{whole(pages.sparkSession, root)}/{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, folder = place(at)
        disk.create_dir(folder, recursive=True)
        part, done, out, temp, n = TaskContext.get().partitionId(), [], None, "", 0

        def close() -> None:
            out.close()
            done.append((f"{folder}/part-{part:05d}-{len(done):04d}.warc.gz", n))
            disk.move(temp, done[-1][0])

        for batch in small(batches, 64):
            for row in batch.to_pylist():
                if row["chunk"] == 0:
                    if out is None:
                        temp, n = f"{folder}/.{uuid.uuid4().hex}", 0
                        out = disk.open_output_stream(temp)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(packer.compress(header(row)))
                out.write(packer.compress(row["data"]))
                if row["last"]:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    n += 1
                    if out.tell() >= archive_bytes:
                        close()
                        out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["archive", "records"])

    ready = chunked(joined.withColumn("body", body), chunk)
    return cut(ready.mapInArrow(run, "archive string, records long"), "archives").withColumn("root", F.lit(at))


class Members:
    """The bytes of the gzip members of an archive, one member after the other."""

    def __init__(self, stream: object, block: int = 1 << 18) -> None:
        self.stream, self.block, self.left = stream, block, b""
        self.inflate, self.held = zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflate a further bit of this member; False at its end."""
        while not self.inflate.eof:
            if not self.left:
                self.left = self.stream.read(self.block)
                if not self.left:
                    raise EOFError("the archive ends inside a record")
            got = self.inflate.decompress(self.left, self.block)
            self.left = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.left = self.inflate.unused_data
            if got:
                self.held += got
                return True
        return False

    def upto(self, mark: bytes) -> bytes:
        while mark not in self.held:
            if not self.more():
                raise ValueError("a record has no end of header")
        found, _, self.held = self.held.partition(mark)
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("a record is shorter than its header says")
        found, self.held = self.held[:n], self.held[n:]
        return found

    def next(self) -> bool:
        """Skip to the next member; False after the last."""
        while self.more():
            pass
        self.inflate, self.held = zlib.decompressobj(31), b""
        if not self.left:
            self.left = self.stream.read(self.block)
        return bool(self.left)


def opened(stream: object, chunk: int) -> Iterator[tuple]:
    """The chunk rows of one archive."""
    members = Members(stream)
    members.left = stream.read(members.block)
    while members.left:
        fields = dict(x.split(": ", 1) for x in members.upto(b"\r\n\r\n").decode("utf-8", "surrogatepass").split("\r\n")[1:])
        number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:record:").rstrip(">")) else None
        kind, block, sha = fields["WARC-Type"], int(fields["Content-Length"]), hashlib.sha1()
        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields.get("X-Payload-Length", block))
        for i, at in enumerate(range(0, max(1, block), chunk)):
            data = members.take(min(chunk, block - at))
            sha.update(data)
            last = at + chunk >= block
            if last and kind == "response" and base32(sha) != digest:
                raise ValueError(f"record {fields['WARC-Record-ID']} doesn't have the digest {digest}")
            yield number("WARC-Record-ID"), kind, fields["WARC-Target-URI"], number("WARC-Refers-To"), size, digest, i, last, base32(sha), data
        if not members.next():
            return


def read(archives: DataFrame, chunk: int = CHUNK, rows_at_once: int = 256, bytes_at_once: int = 8 << 20) -> DataFrame:
    """The chunk table of the listed archives: one row per record and chunk (see READ)."""
    schema = pa.schema([("record", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("refers", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("running", pa.string()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                disk, _ = place(root)
                with disk.open_input_stream(archive, compression=None) as stream:
                    rows, size = [], 0
                    for row in opened(stream, chunk):
                        rows.append(row)
                        size += len(row[-1])
                        if len(rows) >= rows_at_once or size >= bytes_at_once:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = archives.select("archive", "root")
    spread = max(1, min(files.count(), 10_000))
    return files.repartition(spread, "archive").mapInArrow(run, READ)
