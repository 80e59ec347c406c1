"""Bounded-space online packing of token ids into sequences of a fixed length.

Each partition keeps a fixed number of open windows. A document goes into the
window that it fills best; if it fits into none, the fullest is topped up with
its first ids (unless the gap is too small to be worth a piece) and emitted. What
the partitions leave open is merged afterwards, again with a fixed number of
open windows, by tasks that each take the leftovers of many partitions.
"""

from __future__ import annotations

import bisect
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 4096
#: Open windows in a partition; gaps below this many ids are left as padding; partitions whose leftovers meet in a task.
OPEN_WINDOWS, LEAST_PIECE, MERGED_PARTITIONS = 32, 16, 64
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in _PIECE.split(", ")] + [("open", pa.bool_())])


class Windows:
    """Open windows, ordered by the room that they have left."""

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most, self.rooms = length, most, []  # (room, number of the window)
        self.pieces: dict[int, list] = {}
        self.made = 0

    def best(self, size: int) -> int | None:
        at = bisect.bisect_left(self.rooms, (size, -1))
        return at if at < len(self.rooms) else None

    def open(self) -> int:
        self.pieces[self.made] = []
        bisect.insort(self.rooms, (self.length, self.made))
        self.made += 1
        return self.rooms.index((self.length, self.made - 1))

    def put(self, at: int, piece: tuple, size: int) -> tuple[int, list] | None:
        """Adds a piece; returns the window if it is full now."""
        room, number = self.rooms.pop(at)
        self.pieces[number].append((piece, self.length - room))
        if room == size:
            return number, self.pieces.pop(number)
        bisect.insort(self.rooms, (room - size, number))
        return None

    def close(self, at: int) -> tuple[int, list]:
        number = self.rooms.pop(at)[1]
        return number, self.pieces.pop(number)

    def full(self) -> bool:
        return len(self.rooms) >= self.most


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, windows: int = OPEN_WINDOWS, least: int = LEAST_PIECE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty and still has its end id; repeated rows and rows
    without an id are packed like any other; an empty table gives no rows. Other
    columns are ignored. Sequences hold at most ``length`` ids, offsets in them
    have no gaps, and every id lies in exactly one piece.
    """
    spark = docs.sparkSession
    C.prepare(spark)

    def run(batches):
        from pyspark import TaskContext

        base, own, held = TaskContext.get().partitionId() << 40, C.PieceEncoder.load(tokenizer, spaced=False), Windows(length, windows)

        def rows(window, still_open):
            number, pieces = window
            return [(*piece, base + number, at, still_open) for piece, at in pieces]

        for b in batches:
            out = []
            for doc_id, packed in zip(b.column(0).to_pylist(), own.packed(C.texts(b.column(1))), strict=True):
                ids = memoryview(packed + end_id.to_bytes(4, "little"))
                total, start = len(ids) // 4, 0
                while start < total:
                    left = total - start
                    at = held.best(min(left, length))
                    if at is None and not held.full():
                        at = held.open()
                    if at is None:  # it fits nowhere: the fullest window goes, topped up where that is worth a piece
                        room = held.rooms[0][0]
                        if room < least:
                            out += rows(held.close(0), False)
                            continue
                        at, left = 0, room
                    size = min(left, length)
                    piece = (doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), total)
                    if window := held.put(at, piece, size):
                        out += rows(window, False)
                    start += size
            if out:
                yield C.batch(_SCHEMA, *zip(*out, strict=True))
        out = [r for _, number in held.rooms for r in rows((number, held.pieces[number]), True)]
        if out:
            yield C.batch(_SCHEMA, *zip(*out, strict=True))

    placed = C.written(docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(run, _PIECE + ", open boolean"), "packed")
    return placed.where(~F.col("open")).drop("open").unionByName(_merged(placed.where("open").drop("open"), length, windows))


def _merged(left: DataFrame, length: int, windows: int) -> DataFrame:
    """The leftover windows of many partitions joined into fewer, largest first; pieces stay whole."""
    names = [x.split()[0] for x in _PIECE.split(", ")]
    schema = pa.schema(list(_SCHEMA)[:-1])

    def run(batches):
        from pyspark import TaskContext

        base, held = (1 << 62) + (TaskContext.get().partitionId() << 40), Windows(length, windows)

        def rows(window):
            number, groups = window
            return [(*p[:5], base + number, at + k) for group, at in groups for p, k in group]

        found: dict[int, list] = {}
        for r in (r for b in batches for r in b.to_pylist()):
            found.setdefault(r["sequence_id"], []).append(tuple(r[n] for n in names))
        out = []
        for group in sorted(found.values(), key=lambda g: (-sum(p[2] for p in g), g[0][5])):
            pieces, size = [], 0
            for p in sorted(group, key=lambda p: p[6]):
                pieces.append((p, size))
                size += p[2]
            if (at := held.best(size)) is None:
                if held.full():
                    out += rows(held.close(0))
                at = held.open()
            if window := held.put(at, pieces, size):
                out += rows(window)
        out += [r for _, number in held.rooms for r in rows((number, held.pieces[number]))]
        if out:
            yield C.batch(schema, *zip(*out, strict=True))

    # A task's leftovers are at most windows x MERGED_PARTITIONS sequences: partitions that lie side by side meet.
    groups = max(1, -(-left.select((F.col("sequence_id") / (1 << 40)).cast("long").alias("p")).distinct().count() // MERGED_PARTITIONS))
    return left.repartition(groups, (F.shiftright("sequence_id", 40) / MERGED_PARTITIONS).cast("long")).mapInArrow(run, _PIECE)
