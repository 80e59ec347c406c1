"""Pairs of rows that share a key, without emitting pairs, and components of links.

A key with many rows is cut into chunks, and each pair of chunks is one block of
bounded size, so that no task meets a whole hot key. What leaves a block has at
most one row per member.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common as C


def blocked(rows: DataFrame, fn: Callable, schema: str, size: int) -> DataFrame:
    """``fn`` over the blocks of ``rows`` (key long, id, and more).

    Keys with one row are left out. ``fn.load`` turns an Arrow table into the form
    that ``fn(loaded, first, last, across)`` reads blocks from; if a block joins two
    chunks, only pairs across them count (column ``chunk``), else all pairs. ``fn``
    returns tuples in ``schema``.
    """
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    chunks = F.ceil(F.col("_n") / size).cast("int")
    dealt = rows.join(counts, "key").withColumn("_c", chunks).drop("_n")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("_c")).cast("int")).withColumn("_mate", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    dealt = dealt.withColumns({"lo": F.least("chunk", "_mate"), "hi": F.greatest("chunk", "_mate")}).drop("_c", "_mate")
    types = to_arrow_schema(StructType.fromDDL(schema))
    names = types.names

    def run(batches):
        held = None
        for b in batches:
            table = pa.Table.from_batches([b])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            parts = [table.column(c).to_numpy() for c in ("key", "lo", "hi")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in parts], axis=0)) + 1
            if not len(cuts):
                held = table
                continue
            yield from answer(table.slice(0, cuts[-1]), [0, *cuts.tolist()])
            held = table.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from answer(held, [0, held.num_rows])

    def answer(table, cuts):
        columns, out = fn.load(table), []
        lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s > 1:
                out += fn(columns, s, e, lo[s] != hi[s])
        for at in range(0, len(out), 4096):
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out[at : at + 4096]], schema=types)

    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node that has an edge; columns a and b of any ordered type.

    Each round joins all neighbours of a node to the smallest of them, the larger
    ones first and then the smaller, until nothing changes: a logarithmic number
    of rounds in practice, and never more links than there were. Rounds end in a
    checkpoint in the shared folder.
    """
    C.shared_folder(edges.sparkSession)
    links = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    state = None
    while True:
        both = links.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(links.select(F.col("v").alias("n"), F.col("u").alias("o")))
        least = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(least, "n").where("o > n").select(F.col("o").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = small.unionByName(below.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def countable(chunk: np.ndarray, across: bool) -> np.ndarray:
    """Pairs of a block that are its own to look at."""
    return chunk[:, None] != chunk[None, :] if across else ~np.eye(len(chunk), dtype=bool)


def shared(values: np.ndarray, rows: np.ndarray, n: int, wide: int = 4096) -> np.ndarray:
    """For each two of ``n`` rows, how many of their distinct values they share; values of one row alone cost nothing."""
    _, at, times = np.unique(values, return_inverse=True, return_counts=True)
    often = times > 1
    column, rows = (np.cumsum(often) - 1)[at][often[at]], rows[often[at]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((n, n), np.float32 if len(column) < 1 << 24 else float)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        first, last = np.searchsorted(column, (low, low + wide))
        part = np.zeros((n, int(column[last - 1]) - low + 1), np.float32)
        part[rows[first:last], column[first:last] - low] = 1
        out += part @ part.T
    return out


def gathered(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest row that it reaches."""
    n = len(linked)
    label = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new
