"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import unicodedata
import uuid
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: documents may hold a hundred thousand characters each.
BATCH_ROWS = "256"
#: Pieces of text kept with their ids in a worker, in each of two generations.
KEPT_PIECES = 350_000
#: Characters that Python takes for white space and the tokenizers do not.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Capitals whose lower case depends on what follows, or is more than one sign.
_UNEVEN = re.compile("[\u03a3\u0130]")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and this package on the path of the Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    home, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [home, paths.get("PYTHONPATH", "")]))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a scratch folder of its own only in a local session without one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        if not context.getCheckpointDir():
            context.setCheckpointDir(folder)
        return folder
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, by: int) -> Column:
    """crc32 of the id's text, mod ``by``; ids that are null count as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(by)), F.lit(0))


def filesystem(uri: str):
    """Arrow's file system for a place of the shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^file:/*", "file:///", uri) if uri.startswith("file:") else f"file://{uri}")


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


class PieceEncoder:
    """Ids of whole texts by a tokenizer file of the ``tokenizers`` library.

    A text is cut where the tokenizer cuts it whatever stands around: at white
    space, and between a run of Latin letters and the marks of ``_MARKS`` after it.
    The ids of the pieces are kept as packed little-endian 32-bit numbers, in two
    generations of bounded size. Texts with separators that the two sides read
    differently are encoded whole.
    """

    #: Signs that are neither letters nor digits nor apostrophes, and join with nothing before them.
    _MARKS = r"[^\s.,;:!?*#$%&|\")\]]"
    _LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    _loaded: dict[tuple, PieceEncoder] = {}

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # A byte-level tokenizer joins one space to the word after it and keeps the other white space apart.
        word, space = (" ?", r"|\s+(?!\S)|\s") if spaced else ("", "")
        self.cut = re.compile(rf"{word}[{self._LETTERS}]+(?!{self._MARKS})|{word}\S+{space}").findall
        # One that lowers case itself has fewer pieces if that is done before; only where it is the same for every letter.
        self.lower = not spaced
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, spaced: bool) -> PieceEncoder:
        if (path, spaced) not in cls._loaded:
            cls._loaded[path, spaced] = cls(path, spaced)
        return cls._loaded[path, spaced]

    def _encode(self, pieces: list[str]) -> Iterator[bytes]:
        # The fast form leaves out the offsets, which nobody reads here; the ids are the same.
        for found in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False):
            ids = array("I", found.ids)
            if sys.byteorder == "big":
                ids.byteswap()
            yield ids.tobytes()

    def _pieces(self, text: str) -> list[str]:
        if SEPARATORS.search(text):
            return [text]
        if self.lower and unicodedata.is_normalized("NFC", text) and not _UNEVEN.search(text):
            text = text.lower()
        return self.cut(text)

    def packed(self, documents: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in its order."""
        for text in documents:
            pieces = self._pieces(text)
            kept, older = self.kept, self.older
            if new := set(pieces).difference(kept):
                if len(kept) > KEPT_PIECES:
                    self.older, self.kept = older, kept = kept, {}
                    new = set(pieces)
                kept.update((x, older[x]) for x in new if x in older)
                unseen = [x for x in new if x not in kept]
                kept.update(zip(unseen, self._encode(unseen), strict=True))
            yield b"".join(map(kept.__getitem__, pieces))
            for x in new:
                if len(x) > 48:
                    del kept[x]
