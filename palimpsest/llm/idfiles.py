"""Token ids as binary files: one zstandard dictionary for all, one frame per document.

A shard is two files. ``NNNNN.frames`` holds the frames of the documents one
after another; a frame is the document's ids as little-endian unsigned 16-bit
numbers (32-bit where an id needs it), compressed by itself with the shared
dictionary. ``NNNNN.index`` is an Arrow file with a row per document (doc_id,
offset, bytes, ids before it in the shard, ids, width) whose metadata carries the
SHA-256 of the dictionary. ``dictionary`` is the shared dictionary. A document
is read by its index row and one ranged read, without its neighbours.

The dictionary is trained on a bounded sample of id arrays; documents of any
size and count are written by it.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Documents, and bytes of each one's ids, that the dictionary is trained on; bytes of the dictionary.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 1 << 13, 1 << 16
#: Documents that share one frame reader's memory while they are read back.
READ_ROWS = 256
_INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("bytes", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int8())])


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from about ``SAMPLE_DOCS`` documents drawn by hash; empty if the sample is too small to train one."""
    import zstandard

    schema = pa.schema([("ids", pa.binary())])

    def run(batches):
        own = C.PieceEncoder.load(tokenizer, spaced=True)
        for b in batches:
            yield C.batch(schema, [_serial(_ended(x, end_id))[0][:SAMPLE_BYTES] for x in own.packed(C.texts(b.column(0)))])

    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    samples = [r[0] for r in chosen.select("text").mapInArrow(run, "ids binary").collect()]  # bounded by the two sample limits
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the ids of every whole text, ``end_id`` after each, in ascending id order; returns the manifest.

    The manifest has a row per shard in its order: shard, path, documents, ids and
    ids in the shards before it. Null texts count as empty; documents without an
    id stand first; repeated ids stand side by side, in the order of their texts.
    An empty table gives no shards. A task writes under a name of its own and
    renames at the end, so a repeated task leaves a whole file.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    dictionary = train_dictionary(docs, tokenizer, end_id)
    files, root = C.filesystem(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/dictionary") as f:
        f.write(dictionary)
    schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        own, pack = C.PieceEncoder.load(tokenizer, spaced=True), _compressor(dictionary)
        files, root = C.filesystem(folder)
        shard, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        path, rows, at, before = f"{root}/{shard:05d}", [], 0, 0
        with files.open_output_stream(f"{path}.frames.{mark}") as out:
            for b in batches:
                for doc_id, packed in zip(b.column(0).to_pylist(), own.packed(C.texts(b.column(1))), strict=True):
                    raw, n, width = _serial(_ended(packed, end_id))
                    frame = pack.compress(raw)
                    out.write(frame)
                    rows.append((doc_id, at, len(frame), before, n, width))
                    at, before = at + len(frame), before + n
        if not rows:
            files.delete_file(f"{path}.frames.{mark}")
            return
        index = pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX.with_metadata({"dictionary": hashlib.sha256(dictionary).hexdigest()}))
        with files.open_output_stream(f"{path}.index.{mark}") as out, pa.ipc.new_file(out, index.schema) as w:
            w.write_table(index, max_chunksize=1 << 14)
        for kind in ("frames", "index"):
            files.move(f"{path}.{kind}.{mark}", f"{path}.{kind}")
        yield C.batch(schema, [shard], [f"{folder}/{shard:05d}"], [len(rows)], [before])

    dealt = docs.repartitionByRange(C.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = sorted(dealt.mapInArrow(run, "shard long, path string, documents long, ids long").collect())  # a row per shard
    starts = np.cumsum([0, *[s.ids for s in shards]])
    return spark.createDataFrame([(*s, int(n)) for s, n in zip(shards, starts[:-1], strict=True)], "shard long, path string, documents long, ids long, before long")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads the files back: doc_id, start (ids of all documents before it), n_tokens, ids binary (little-endian unsigned 32-bit numbers)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for shard in (r for b in batches for r in b.to_pylist()):
            dictionary = _dictionary(folder)
            unpack = _decompressor(dictionary)
            files, path = C.filesystem(shard["path"])
            with files.open_input_file(f"{path}.index") as at, files.open_input_file(f"{path}.frames") as frames:
                index = pa.ipc.open_file(at)
                if index.schema.metadata[b"dictionary"].decode() != hashlib.sha256(dictionary).hexdigest():
                    raise ValueError(f"{shard['path']} was written with another dictionary")
                for k in range(index.num_record_batches):
                    whole = index.get_batch(k)
                    for part in (whole.slice(s, READ_ROWS) for s in range(0, whole.num_rows, READ_ROWS)):
                        rows = part.to_pylist()
                        first, last = rows[0], rows[-1]
                        data = memoryview(frames.read_at(last["offset"] + last["bytes"] - first["offset"], first["offset"]))
                        ids = []
                        for r in rows:
                            raw = unpack.decompress(data[(s := r["offset"] - first["offset"]) : s + r["bytes"]])
                            ids.append(np.frombuffer(raw, f"<u{r['width']}").astype("<u4").tobytes())
                        yield C.batch(schema, [r["doc_id"] for r in rows], [shard["before"] + r["before"] for r in rows], [r["n_tokens"] for r in rows], ids)

    n = max(1, manifest.count())
    return manifest.repartitionByRange(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def one_document(row: dict, shard: str, folder: str) -> np.ndarray:
    """The ids of one document by its index row, with a single ranged read."""
    files, path = C.filesystem(shard)
    with files.open_input_file(f"{path}.frames") as frames:
        raw = _decompressor(_dictionary(folder)).decompress(frames.read_at(row["bytes"], row["offset"]))
    return np.frombuffer(raw, f"<u{row['width']}").astype("<u4")


def stored(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Written, read back, and reduced: doc_id, start, n_tokens, ids_crc32."""
    out = read_ids(write_ids(docs, folder, tokenizer, end_id), folder)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _ended(packed: bytes, end_id: int) -> bytes:
    return packed + end_id.to_bytes(4, "little")


def _serial(packed: bytes) -> tuple[bytes, int, int]:
    ids = np.frombuffer(packed, "<u4")
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return ids.astype(f"<u{width}").tobytes(), len(ids), width


def _dictionary(folder: str) -> bytes:
    files, root = C.filesystem(folder)
    with files.open_input_stream(f"{root}/dictionary") as f:
        return f.read()


def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
