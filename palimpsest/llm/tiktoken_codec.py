"""Byte-level BPE encoding and decoding with the ``tiktoken`` library and a local rank file.

Long texts are cut before encoding at safe boundaries: a plain space or line
break after a letter or digit. Every alternative of the split pattern takes at
most one leading space and then no white space, or white space alone, so a match
always ends there, and none looks behind; the parts give the ids of the whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Characters from which on a text is cut before it is encoded.
PART_CHARS = 1 << 15
_SAFE = re.compile(r"(?<=[^\W_])[ \n]")
_loaded: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """The encoding of a rank file, once in a worker."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        _loaded[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut only at safe boundaries."""
    start = 0
    while len(text) - start > size and (found := _SAFE.search(text, start + size)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of each whole text: ``id_column``, ids array<int>. A null text counts as empty and has no ids; a null id is kept."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        own = encoding(path, pattern)
        for b in batches:
            yield C.batch(schema, b.column(0).to_pylist(), [[i for p in parts(t) for i in own.encode_ordinary(p)] for t in C.texts(b.column(1))])

    return _two(docs, id_column, text_column).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """The raw bytes of each id list: ``id_column``, bytes binary. Null ids decode to no bytes."""
    schema = pa.schema([("id", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        own = encoding(path, pattern)
        for b in batches:
            yield C.batch(schema, b.column(0).to_pylist(), [own.decode_bytes(x or []) for x in b.column(1).to_pylist()])

    return encoded.select(F.col(id_column).alias("id"), "ids").mapInArrow(run, "id long, bytes binary").withColumnRenamed("id", id_column)


def digests(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encoding and decoding in one pass, reduced to digests.

    ``id_column``, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded bytes). Part by part, so that of a long text
    only one part's ids exist at a time. One row per input row, repeated ones too.
    """
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        own = encoding(path, pattern)
        names = [str(i) for i in range(own.n_vocab)]
        for b in batches:
            n_tokens, written, back = [], [], []
            for text in C.texts(b.column(1)):
                n, said, raw = 0, hashlib.sha256(), hashlib.sha256()
                for part in parts(text):
                    ids = own.encode_ordinary(part)
                    if ids:
                        said.update((("," if n else "") + ",".join([names[i] for i in ids])).encode())
                        raw.update(own.decode_bytes(ids))
                        n += len(ids)
                n_tokens.append(n)
                written.append(said.hexdigest())
                back.append(raw.hexdigest())
            yield C.batch(schema, b.column(0).to_pylist(), n_tokens, written, back)

    out = _two(docs, id_column, text_column).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_column)


def _two(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    C.prepare(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
