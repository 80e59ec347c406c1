"""WARC archives as a table of chunks.

A record's payload travels as rows of record identifier and chunk number, each
of a bounded size, in both directions: the writer streams chunks into gzip
members, and the reader yields chunks with the digest of the payload so far, so
that neither holds a record whole. Records with equal payloads of at least
``least`` bytes are written once, by the smallest id; the others revisit it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of a payload in one chunk row, and bytes that the reader takes from an archive at a time.
CHUNK_BYTES, READ_BYTES = 1 << 18, 1 << 16
LEAST_BYTES = 100
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_CHUNK = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, chunk int, chunks int, data binary"
_READ = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk int, data binary, digest_so_far string, last boolean"
_READ_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk", pa.int32()), ("data", pa.binary()), ("digest_so_far", pa.string()), ("last", pa.bool_())]
)


def records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Each page with its record type and the page it refers to.

    A null html counts as empty. Pages without an id are written as responses of
    their own and never referred to; of rows that share the smallest id and the
    payload all are responses.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    # Only digests that several pages share; the sums are formed before rows move, and the payloads stay out of it.
    first = own.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = own.join(first.drop("n"), "payload_digest", "left")
    revisit = F.col("page_id") != F.col("first")
    return joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first"))}).drop("first")


def chunked(records: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """Record identifier and chunk number with at most ``size`` bytes; a revisit has one chunk without bytes."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    chunks = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / size)).cast("int")
    cut = records.withColumn("body", body).withColumn("chunks", chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    data = F.substring("body", F.col("chunk") * size + 1, F.lit(size))
    return cut.withColumn("data", data).select(*[x.split()[0] for x in _CHUNK.split(", ")])


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes a gzip archive per task, one member per record; returns path and records of each.

    Chunks of a record have to follow each other in a partition, as ``chunked``
    leaves them. Each task writes under a name of its own and renames at the end.
    """
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        files, root = C.filesystem(folder)
        files.create_dir(root, recursive=True)
        shard, mark, n, out = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, None
        path = f"{root}/{shard:05d}.warc.gz"
        for r in (r for b in batches for r in b.to_pylist()):
            if out is None:
                out = files.open_output_stream(f"{path}.{mark}", compression=None)
            if r["chunk"] == 0:
                member, digest = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha256()
                response = r["record_type"] == "response"
                out.write(member.compress(_head(r, response) + (_HTTP if response else b"")))
            digest.update(r["data"])
            out.write(member.compress(r["data"]))
            if r["chunk"] == r["chunks"] - 1:
                if response and digest.hexdigest() != r["payload_digest"]:
                    raise ValueError(f"the chunks of page {r['page_id']} are not its payload")
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                n += 1
        if out is not None:
            out.close()
            files.move(f"{path}.{mark}", path)
            yield C.batch(schema, [f"{folder}/{shard:05d}.warc.gz"], [n])

    return chunks.mapInArrow(run, "path string, records long")


def _head(r: dict, response: bool) -> bytes:
    name = lambda page: f"<urn:page:{'none' if page is None else page}>"
    lines = ["WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: {name(r['page_id'])}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{r['payload_digest']}", f"X-Payload-Length: {r['payload_bytes']}"]
    if r["url"] and not set(r["url"]) & set("\r\n"):
        lines.append(f"WARC-Target-URI: {r['url']}")
    if not response:
        lines += [f"WARC-Refers-To: {name(r['refers_to'])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    length = len(_HTTP) + r["payload_bytes"] if response else 0
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


class _Source:
    """Plain bytes of a gzip archive of many members, a bounded piece at a time."""

    def __init__(self, raw) -> None:
        self.raw, self.member, self.rest, self.buffer = raw, zlib.decompressobj(31), b"", bytearray()

    def more(self) -> bool:
        """Adds at most a few READ_BYTES to the buffer; False at the end."""
        if self.member.eof:
            self.rest, self.member = self.member.unused_data, zlib.decompressobj(31)
        data = self.rest or self.member.unconsumed_tail or self.raw.read(READ_BYTES)
        self.rest = b""
        if not data:
            return False
        self.buffer += self.member.decompress(data, READ_BYTES)
        return True

    def head(self) -> bytes | None:
        """The bytes up to a blank line, without it."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if bytes(self.buffer).strip():
                    raise ValueError("the archive ends inside a record")
                return None
        found = bytes(self.buffer[:at])
        del self.buffer[: at + 4]
        return found

    def take(self, most: int) -> bytes:
        while len(self.buffer) < most:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        found = bytes(self.buffer[:most])
        del self.buffer[:most]
        return found


def read_archives(archives: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of the archives with the SHA-256 of the payload so far; ``last`` marks a record's last chunk."""

    def run(batches):
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            files, at = C.filesystem(path)
            with files.open_input_stream(at, compression=None) as raw:
                yield from _batches(_records(_Source(raw), size))

    n = max(1, archives.count())
    return archives.select("path").repartitionByRange(n, "path").mapInArrow(run, _READ)


def _records(source: _Source, size: int):
    while (head := source.head()) is not None:
        fields = dict(x.split(": ", 1) for x in head.decode().lstrip("\r\n").split("\r\n")[1:])
        page, target = ((None if (x := fields.get(k, "<urn:page:none>")[10:-1]) == "none" else int(x)) for k in ("WARC-Record-ID", "WARC-Refers-To"))
        left, digest, chunk = int(fields["Content-Length"]), hashlib.sha256(), 0
        if left:
            left -= len(source.head()) + 4  # the HTTP head
        while True:
            data = source.take(min(size, left))
            left -= len(data)
            digest.update(data)
            yield page, fields["WARC-Type"], target, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].partition(":")[2], chunk, data, digest.hexdigest(), not left
            chunk += 1
            if not left:
                break
        source.take(4)


def _batches(rows, most: int = 64):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield C.batch(_READ_SCHEMA, *zip(*held, strict=True))
            held = []
    if held:
        yield C.batch(_READ_SCHEMA, *zip(*held, strict=True))


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages, reads the archives back and describes each record by what was read.

    A response's digest and length are those of the bytes read; a revisit carries
    those of the payload that its record names.
    """
    spark = pages.sparkSession
    C.prepare(spark)
    archives = C.written(write_archives(chunked(records(pages)), folder), "archives")
    read = read_archives(archives)
    length = F.col("chunk").cast("long") * CHUNK_BYTES + F.octet_length("data")
    response = F.col("record_type") == "response"
    return read.where("last").select(
        "page_id", F.when(response, length).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(response, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to"
    )
