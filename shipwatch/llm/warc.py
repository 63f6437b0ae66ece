"""WARC archives written and read as streams of record chunks.

Writing: the payload of every page becomes rows (record, chunk number, at most
``CHUNK`` bytes), cut by Spark before Python sees them; a task appends its
records chunk by chunk to gzip members of one archive file in the shared
folder, so no record is ever held whole. Of pages with equal payloads of at
least ``least`` bytes the largest page id is the response; the others are
revisit records (identical-payload-digest) that name it and hold no payload.

Reading: every archive is parsed from a stream into chunk rows that carry the
SHA-1 of the payload up to their end; the row that ends a record has the
digest of it all, and the number of its bytes. A digest that differs from the
one in the record's header is an error.

Recovery: a task that is run again writes a file of its own name; only files
of the manifest, which Spark commits with the successful tasks, are read.

Only digests (one narrow row per page, summed per task by digest) are grouped;
the pages meet the result by digest, salted, so a payload that a third of the
pages share is spread over ``SALTS`` keys.

Defined cases: a null html is an empty payload; pages that tie on the largest
id of their payload are all responses; a null page_id is smaller than any
other (a response only if all pages of its payload have none, and then all are);
null urls are written as an empty target; repeated rows are records of their
own; extra columns are ignored; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shipwatch.llm import batches as B
from shipwatch.llm.store import settled

CHUNK = 256 << 10
LEAST = 0
SALTS = 16
LEVEL = 1                       # of gzip
_READ = 256 << 10

CHUNK_ROW = ("page_id long, url string, record_type string, refers_to long, chunk long, data binary, sha1 binary, "
             "bytes_so_far long, last boolean, archive string")
_CHUNKS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                     ("refers_to", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("sha1", pa.binary()),
                     ("bytes_so_far", pa.int64()), ("last", pa.bool_()), ("archive", pa.string())])


def _open(path: str):
    """(file system, path) of a URI of the shared folder, as any store that pyarrow knows."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_chunks(pages: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the pages to write: a revisit has one chunk without data."""
    body = (pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("_body"))
            .withColumn("_sha1", F.unhex(F.sha1("_body"))).withColumn("_size", F.octet_length("_body").cast("long")))
    groups = (body.where(F.col("_size") >= least).groupBy("_sha1")
              .agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null"))
    groups = settled(groups, "warc-payloads").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = (body.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
            .join(groups, ["_sha1", "_salt"], "left")
            .withColumn("revisit", F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))))
    n_chunks = F.when(F.col("revisit"), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("_size") / chunk)))
    return (told.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n_chunks.cast("long") - 1)))
            .select("page_id", "url", "revisit", F.when(F.col("revisit"), F.col("_first")).alias("refers_to"),
                    F.col("_sha1").alias("sha1"), F.col("_size").alias("size"), "chunk",
                    F.when(F.col("revisit"), F.lit(b"")).otherwise(
                        F.substring(F.col("_body"), (F.col("chunk") * chunk + 1).cast("int"), F.lit(chunk))).alias("data")))


def _header(page_id, url, revisit, refers_to, sha1, size) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {quote(url or '', safe='%/:=&?~#+!$,;@()*[]')}",
             f"WARC-Payload-Digest: sha1:{base32(sha1)}", "Content-Type: text/html; charset=utf-8"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Payload-Length: {size}"]
    lines.append(f"Content-Length: {0 if revisit else size}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Append the chunk rows to archives under ``folder``; returns the manifest (archive, records, bytes).

    The chunks of a record are neighbours in their partition, in order.
    """
    B.prepare(chunks.sparkSession)
    run_id = uuid.uuid4().hex

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/{run_id}-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, packer, records, total = None, None, 0, 0
        for batch in it:
            for r in batch.to_pylist():
                if out is None:
                    store, path = _open(name)
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                if r["chunk"] == 0:
                    packer, left = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0 if r["revisit"] else r["size"]
                    out.write(packer.compress(_header(r["page_id"], r["url"], r["revisit"], r["refers_to"], r["sha1"],
                                                      r["size"])))
                    records += 1
                out.write(packer.compress(r["data"]))
                left -= len(r["data"])
                if left == 0:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        if out is not None:
            total = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [records], "bytes": [total]})

    return settled(chunks.mapInArrow(run, "archive string, records long, bytes long"), "warc-manifest")


class _Stream:
    """Decompressed bytes of a file of gzip members, read piece by piece."""

    def __init__(self, source):
        self.source, self.buffer, self.ended = source, b"", False
        self.unpacker, self.rest = zlib.decompressobj(31), b""

    def _fill(self) -> bool:
        while not self.ended:
            if self.unpacker.eof:
                self.rest, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
            raw = self.rest or self.source.read(_READ)
            self.rest = b""
            if not raw:
                self.ended = True
                break
            got = self.unpacker.decompress(raw, _READ)
            if not self.unpacker.eof:
                self.rest = self.unpacker.unconsumed_tail
            if got:
                self.buffer += got
                return True
        return False

    def header(self) -> list[bytes] | None:
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._fill():
                if self.buffer.strip():
                    raise ValueError("an archive ends inside a record's header")
                return None
        lines, self.buffer = self.buffer[:at].split(b"\r\n"), self.buffer[at + 4:]
        return lines

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._fill():
            pass
        if len(self.buffer) < n:
            raise ValueError("an archive ends inside a record")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out


def parse(source, name: str, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of one open archive."""
    stream = _Stream(source)
    while (lines := stream.header()) is not None:
        fields = dict(line.decode().split(": ", 1) for line in lines[1:] if b": " in line)
        page = fields["WARC-Record-ID"][len("<urn:page:"):-1]
        refers = fields.get("WARC-Refers-To")
        row = {"page_id": int(page) if page else None, "url": unquote(fields.get("WARC-Target-URI", "")),
               "record_type": fields["WARC-Type"], "refers_to": int(refers[len("<urn:page:"):-1]) if refers else None,
               "archive": name}
        stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
        left, done, k, digest = int(fields["Content-Length"]), 0, 0, hashlib.sha1()
        while True:
            data = stream.take(min(chunk, left - done))
            digest.update(data)
            done += len(data)
            last = done == left
            so_far, size = digest.digest(), done
            if row["record_type"] == "revisit":
                so_far, size = stated, int(fields["X-Payload-Length"])
            elif last and so_far != stated:
                raise ValueError(f"the payload of record {page} differs from its digest")
            yield row | {"chunk": k, "data": data, "sha1": so_far, "bytes_so_far": size, "last": last}
            k += 1
            if last:
                break
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def read_archives(manifest: DataFrame, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table of the archives; without ``data`` the payload bytes stay behind."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name in batch.column("archive").to_pylist():
                store, path = _open(name)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for r in parse(source, name, chunk):
                        if not data:
                            r["data"] = None
                        rows.append(r)
                        held += len(r["data"] or b"") + 200
                        if held > (4 << 20):
                            yield pa.RecordBatch.from_pylist(rows, schema=_CHUNKS)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_CHUNKS)

    n = manifest.count()
    # one archive a task: files are as large as the writer's partitions
    return manifest.repartition(max(n, 1), "archive").mapInArrow(run, CHUNK_ROW)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from the chunk that ends it."""
    @F.pandas_udf("string")
    def text32(sha1: pd.Series) -> pd.Series:
        return sha1.map(lambda x: base32(bytes(x)))

    return chunks.where("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"),
                                       text32("sha1").alias("payload_digest"), "record_type", "refers_to")


def archived(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write the pages to archives in ``folder``, read these back, and report per record."""
    manifest = write_archives(record_chunks(pages, least), folder)
    return records(read_archives(manifest, data=False))

