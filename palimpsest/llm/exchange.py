"""Packed number arrays that pieces of a corpus and buckets of keys send each other.

A piece of text holds millions of keys. Instead of a row per key it sends one
packed array per bucket of the key space; a bucket merges what all pieces sent and
answers each of them in its own order. What is shuffled is a few bytes per key and
piece, no group is larger than a piece or a bucket, and a key that occurs
everywhere is one entry per piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common as C

#: Bytes of a row group and of an Arrow batch where rows are large.
HELD = 8 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers below 2**32 and of equal length: their bytes by significance, compressed."""
    planes = [np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, arrays: int = 1) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    planes = raw.reshape(arrays, 4, -1)
    return [np.ascontiguousarray(p.T).view("<u4").ravel() for p in planes]


def pack_rising(*arrays: np.ndarray) -> bytes:
    """Like ``pack``, for a first array that rises: it is kept as differences."""
    first, *others = arrays
    return pack(np.diff(first.astype(np.int64), prepend=0), *others)


def unpack_rising(data: bytes, arrays: int = 1) -> list[np.ndarray]:
    first, *others = unpack(data, arrays)
    return [np.cumsum(first, dtype=np.int64), *others]


def power_of_two(least: float) -> int:
    """The exponent of the smallest power of two that is not below."""
    return max(0, int(np.ceil(np.log2(max(1.0, least)))))


def by_bucket(rows: DataFrame, answer: Callable[[int, pa.Table], Iterable[tuple]], schema: str) -> DataFrame:
    """``answer(bucket, its rows)`` for each bucket: tuples in ``schema``."""
    types = _types(schema)

    def merged(table: pa.Table) -> pa.Table:
        return _table(answer(table.column("bucket")[0].as_py(), table), types)

    return rows.groupBy("bucket").applyInArrow(merged, schema)


def by_piece(pieces: DataFrame, answers: DataFrame, go_on: Callable[[dict, list[dict]], Iterable[tuple] | pa.Table], schema: str) -> DataFrame:
    """``go_on(piece, answers in the order of their buckets)`` for each piece, by column ``piece``."""
    types = _types(schema)

    def resumed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return types.empty_table()
        found = go_on(left.to_pylist()[0], right.sort_by("bucket").to_pylist())
        return found.cast(types) if isinstance(found, pa.Table) else _table(found, types)

    return pieces.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(resumed, schema)


def written_pieces(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table whose rows hold megabytes each: small row groups and Arrow batches keep few of them in memory."""
    spark, path = df.sparkSession, C.new_folder(df.sparkSession, name)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(HELD))
    df.write.option("parquet.block.size", HELD).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _types(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _table(rows: Iterable[tuple], types: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.table([pa.array(c, t.type) for c, t in zip(columns, types, strict=True)], schema=types)
