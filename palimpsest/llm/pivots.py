"""Near-duplicate vectors by a pivot-permutation index.

Every distinct vector is described by its nearest reference points (pivots) in
order. The inverted lists hold, for each two pivots, the vectors that have both
among their nearest; a pair of vectors is retrieved from the list of the two
smallest pivots that they share, if it shares enough of them, and then verified
by its cosine in double precision.

Equal vectors are one entry of the index. Lists are processed in blocks, and
what leaves a block is per vector, so a group of many near copies costs its
comparisons but is never written out as pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import common as C

#: Reference points at most; one per so many distinct vectors; nearest ones that describe a vector; shared ones that make a candidate.
PIVOTS, VECTORS_PER_PIVOT, NEAREST, SHARED = 1024, 8, 8, 3
#: Vectors drawn for each pivot, and the cosine below which two pivots have to stay: in a group of
#: near copies several pivots would be nearest in any order.
DRAWN, APART = 3, 0.8
BLOCK = 512


def usable(embedding: str) -> Column:
    """Vectors without null or non-finite components that are not zero."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def identity(vector: str) -> Column:
    """128 bits of hash: the name of a distinct vector."""
    return F.concat(F.lpad(F.hex(F.xxhash64(vector)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(7), vector)), 16, "0"))


def links(embeddings: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Rows link from ``threshold`` on. Vectors that are null, zero, or hold null or
    non-finite components link with nothing and are their own component; vectors
    of different lengths do not link. Rows without an id take part but never name
    a component unless all its rows lack one. Repeated rows count one by one.
    """
    spark = embeddings.sparkSession
    C.prepare(spark)
    base = embeddings.select(F.col(id_column).cast("long").alias("row_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    base = base.withColumn("id", F.when(usable("vector"), identity("vector")))
    classes = C.written(
        base.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("row_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "vectors"
    )
    n = min(PIVOTS, max(16, classes.count() // VECTORS_PER_PIVOT))
    pivots = _apart([r["vector"] for r in classes.orderBy("id").limit(DRAWN * n).select("vector").collect()])[:n]  # at most DRAWN x PIVOTS come here
    found = _verified(classes, _listed(classes, pivots), threshold)
    found = C.written(found, "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = B.components(found.where("mate is not null").select(F.col("id").alias("a"), F.col("mate").alias("b")))
    least = roots.join(classes.select(F.col("id").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    known = classes.select("id", "least", "copies").join(counts, "id", "left").join(roots.join(least, "root").select(F.col("node").alias("id"), "component"), "id", "left")
    known = known.select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    out = base.select("row_id", "id").join(known, "id", "left")
    component = F.coalesce("component_id", "row_id")
    return out.select(F.col("row_id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("row_id") == component, F.lit(False)).alias("kept"))


def _listed(classes: DataFrame, pivots: list) -> DataFrame:
    """Rows of the inverted lists: key (two pivots), id, and the ordered nearest pivots of the vector."""
    if not pivots:
        return classes.sparkSession.createDataFrame([], "key long, id string, nearest binary")
    width = max(map(len, pivots))
    points = _unit(_fitted(pivots, width))
    m = min(NEAREST, len(points))
    # Vectors that all have the same pivots all meet in one list, that of the first two (or of the only one and none).
    pairs = np.array(list(combinations(range(m), 2)) if len(points) > NEAREST else [(0, min(1, m - 1))])
    schema = pa.schema([("key", pa.int64()), ("id", pa.string()), ("nearest", pa.binary())])

    def run(batches):
        for b in batches:
            near = _unit(_fitted(b.column(1).to_pylist(), width)) @ points.T
            order = np.argsort(-near, axis=1, kind="stable")[:, :m].astype("<i4")
            placed = np.sort(order, axis=1)
            keys = placed[:, pairs[:, 0]].astype(np.int64) * PIVOTS + (placed[:, pairs[:, 1]] if m > 1 else 1)
            rows = np.repeat(np.arange(len(order)), len(pairs))
            names = b.column(0).take(pa.array(rows))
            own = [o.tobytes() for o in order]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), names, pa.array([own[i] for i in rows], pa.binary())], schema=schema)

    return classes.select("id", "vector").mapInArrow(run, "key long, id string, nearest binary")


def _fitted(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows of one width: others are cut or filled with zeros, for their description only."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v[:width]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _apart(vectors: list) -> list:
    """The vectors that are not close to an earlier one."""
    if not vectors:
        return []
    x = _unit(_fitted(vectors, max(map(len, vectors))))
    kept: list[int] = []
    for i in range(len(x)):
        if not kept or (x[kept] @ x[i]).max() < APART:
            kept.append(i)
    return [vectors[i] for i in kept]


class _Candidates:
    """Members of a list that share enough pivots with another one, in the list where that pair belongs."""

    def load(self, table: pa.Table) -> tuple:
        near = np.frombuffer(b"".join(table.column("nearest").to_pylist()), "<i4").reshape(table.num_rows, -1)
        return near, table.column("chunk").to_numpy(), table.column("key").to_numpy(), table.column("id").to_pylist()

    def pairs(self, near: np.ndarray, chunk: np.ndarray, key: int, across: bool) -> np.ndarray:
        n, m = near.shape
        values, rows = near.ravel(), np.repeat(np.arange(n), m)
        enough = B.shared(values, rows, n) >= min(SHARED, m)
        below = values < key % PIVOTS  # of the pivots before the list's second, a pair of this list shares the first only
        return enough & (B.shared(values[below], rows[below], n) == 1) & B.countable(chunk, across)

    def __call__(self, loaded, s: int, e: int, across: bool) -> list[tuple]:
        near, chunk, key, names = loaded
        found = self.pairs(near[s:e], chunk[s:e], int(key[s]), across).any(axis=1)
        return [(int(key[s]), names[s + i], near[s + i].tobytes()) for i in np.flatnonzero(found)]


class _Links(_Candidates):
    """Links of a list's members: how many rows each links with there, and a chain through each component."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def load(self, table: pa.Table) -> tuple:
        return *super().load(table), table.column("copies").to_numpy(), table.column("vector")

    def __call__(self, loaded, s: int, e: int, across: bool) -> list[tuple]:
        near, chunk, key, names, copies, vectors = loaded
        own = vectors.slice(s, e - s).to_pylist()
        sizes = np.array([len(v) for v in own])
        x = _unit(_fitted(own, sizes.max()))
        linked = (x @ x.T >= self.threshold) & (sizes[:, None] == sizes[None, :]) & self.pairs(near[s:e], chunk[s:e], int(key[s]), across)
        n, label = linked @ copies[s:e].astype(np.int64), B.gathered(linked)
        return [(names[s + i], int(n[i]), names[s + label[i]] if label[i] != i else None) for i in np.flatnonzero(linked.any(axis=1))]


def _verified(classes: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """id, links, mate of the vectors that link with another."""
    members = B.blocked(C.written(lists, "lists"), _Candidates(), "key long, id string, nearest binary", BLOCK).distinct()
    whole = members.join(classes.select("id", "copies", "vector"), "id")
    return B.blocked(C.written(whole, "candidates"), _Links(threshold), "id string, links long, mate string", BLOCK)
