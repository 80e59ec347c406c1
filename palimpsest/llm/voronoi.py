"""Exact top-k by inner product: a Voronoi join of queries and data.

Data vectors go to the cell of their nearest pivot, queries to groups around
pivots of their own. From summaries of the cells (how many vectors lie how near
to the pivot) follows a score that every query of a group reaches k times at least;
a data vector is replicated to a group only if the bound of its score there reaches
that. The groups are solved locally, in blocks of data, and the blocks' best are
merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .pivots import identity

#: Cells of the data; queries in a group, and groups around pivots, at most; data vectors in a block.
CELLS, GROUP_QUERIES, GROUPS, BLOCK = 64, 2048, 256, 32_768
#: Room for rounding in the bounds, which only widens what is replicated.
SLACK = 1e-6


def scaled(embedding: str, scale: float) -> Column:
    """floor(scale * x) of each component as long; null for vectors that take no part."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(x.isNotNull() & finite, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), ``id_column`` and score: the ``k`` highest integer inner products of each query with other rows.

    Ties go to the smaller id. ``is_query`` selects the queries by columns of
    ``vectors``. Vectors that are null or hold null or non-finite components take no
    part, nor do rows without an id; a row that is repeated whole counts once, and
    rows with the query's id are not its candidates. Vectors of different lengths
    have no score. Fewer candidates than ``k`` give fewer rows.
    """
    spark = vectors.sparkSession
    C.prepare(spark)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), scaled(vector_column, scale).alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & F.col("vec_id").isNotNull()).withColumn("cid", identity("vector"))
    # Of equal vectors the k + 1 smallest ids can be in a result, the query itself among them.
    first = _first_ids(rows.select("cid", "vec_id", "vector").groupBy("cid", "vec_id").agg(F.first("vector").alias("vector")), k + 1)
    data = C.written(first.withColumn("width", F.size("vector")), "data")
    asked = C.written(rows.where("asks").select("vec_id", "cid", "vector"), "asked")
    queries = C.written(asked.groupBy("cid").agg(F.first("vector").alias("vector")).withColumn("width", F.size("vector")), "queries")
    best = None
    for width in [r[0] for r in queries.select("width").distinct().collect()]:  # lengths of vectors: one, as a rule
        own = _joined(queries.where(F.col("width") == width).drop("width"), data.where(F.col("width") == width).drop("width"), k + 1)
        best = own if best is None else best.unionByName(own)
    if best is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_column} long, score long")
    found = asked.select(F.col("vec_id").alias("query_id"), "cid").distinct().join(best, "cid")
    other = F.slice(F.filter("best", lambda x: x.vec_id != F.col("query_id")), 1, k)
    return found.select("query_id", F.posexplode(other).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias(id_column), F.col("x.score").alias("score"))


def _first_ids(rows: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("cid").orderBy("vec_id"))
    return rows.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _drawn(df: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` vectors, by hash."""
    return np.array([r[0] for r in df.orderBy("cid").select("vector").limit(n).collect()], float)


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2 * x @ points.T, 0))


def _joined(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """cid and its ``k`` best as array<struct<score, vec_id>>."""
    n_queries, n_data = queries.count(), data.count()
    cells = _drawn(data, CELLS)
    centres = _drawn(queries, min(GROUPS, math.ceil(n_queries / GROUP_QUERIES)))
    blocks = max(1, math.ceil(n_data / BLOCK))
    groups = C.written(_grouped(queries, centres), "groups")
    shape = groups.groupBy("centre").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # at most GROUPS
    radius, sizes = {r["centre"]: r["radius"] for r in shape}, {r["centre"]: r["n"] for r in shape}
    # A group that holds most queries is solved in parts.
    parts = {c: math.ceil(n / GROUP_QUERIES) for c, n in sizes.items()}
    groups = groups.withColumn("part", F.pmod(F.xxhash64("cid"), _by_centre(parts)).cast("int"))
    used = sorted(radius)
    centre, reach = centres[used], np.array([radius[c] for c in used])
    near = _summary(data, cells, k)
    least = _least_scores(centre, reach, cells, near, k)
    sent = _replicated(data, used, centre, reach, least, blocks, parts)
    asked = groups.select("centre", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "cid", "vector")
    solved = asked.groupBy("centre", "part", "block").cogroup(sent.groupBy("centre", "part", "block")).applyInArrow(_solver(k), "cid string, block int, best array<struct<score: long, vec_id: long>>")
    width = max(1, math.isqrt(blocks))
    return _best(_best(solved.withColumn("block", F.floor(F.col("block") / width)), ["cid", "block"], k), ["cid"], k)


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    ordered = F.array_sort(F.flatten(F.collect_list("best")), lambda a, b: F.when((a.score > b.score) | ((a.score == b.score) & (a.vec_id < b.vec_id)), -1).otherwise(1))
    return rows.groupBy(*by).agg(F.slice(ordered, 1, k).alias("best"))


def _grouped(queries: DataFrame, centres: np.ndarray) -> DataFrame:
    """Queries with the nearest centre and the distance to it."""
    schema = pa.schema([("centre", pa.int32()), ("distance", pa.float64()), ("cid", pa.string()), ("vector", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            away = _distances(_matrix(b.column(1)).astype(float), centres)
            at = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(away[np.arange(len(at)), at]), b.column(0), b.column(1).cast(schema.field(3).type)], schema=schema)

    return queries.select("cid", "vector").mapInArrow(run, "centre int, distance double, cid string, vector array<long>")


def _summary(data: DataFrame, cells: np.ndarray, k: int) -> dict[int, np.ndarray]:
    """For each cell the ``k`` smallest distances of its vectors from the pivot."""
    schema = pa.schema([("cell", pa.int32()), ("near", pa.list_(pa.float64()))])

    def run(batches):
        kept: dict[int, np.ndarray] = {}
        for b in batches:
            away = _distances(_matrix(b.column(0)).astype(float), cells)
            at = away.argmin(axis=1)
            for c in np.unique(at):
                kept[c] = np.sort(np.append(kept.get(c, []), away[at == c, c]))[:k]
        if kept:
            yield C.batch(schema, list(kept), [v.tolist() for v in kept.values()])

    own = data.select("vector").mapInArrow(run, "cell int, near array<double>")
    merged = own.groupBy("cell").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))  # k numbers a task and cell
    return {r["cell"]: np.array(r["near"]) for r in merged.collect()}


def _least_scores(centre: np.ndarray, reach: np.ndarray, cells: np.ndarray, near: dict[int, np.ndarray], k: int) -> np.ndarray:
    """For each group a score that each of its queries reaches with ``k`` data vectors; minus infinity if there are fewer."""
    out = []
    for p, r in zip(centre, reach, strict=True):
        found = [p @ cells[c] - r * np.linalg.norm(cells[c]) - (np.linalg.norm(p) + r) * d for c, d in near.items()]
        found = np.sort(np.concatenate(found))[::-1] if found else np.zeros(0)
        out.append(found[k - 1] if len(found) >= k else -np.inf)
    out = np.array(out)
    return out - SLACK * (1 + np.abs(np.where(np.isfinite(out), out, 0)))


def _replicated(data: DataFrame, used: list[int], centre: np.ndarray, reach: np.ndarray, least: np.ndarray, blocks: int, parts: dict[int, int]) -> DataFrame:
    """Data vectors with each group whose least score their bound reaches, and a block."""
    schema = pa.schema([("centre", pa.int32()), ("vec_id", pa.int64()), ("vector", pa.list_(pa.int64()))])
    names = np.array(used, np.int32)

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1)).astype(float)
            bound = x @ centre.T + np.linalg.norm(x, axis=1)[:, None] * reach[None, :]
            rows, group = np.nonzero(bound + SLACK * (1 + np.abs(bound)) >= least[None, :])
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(names[group]), b.column(0).take(at), b.column(1).cast(schema.field(2).type).take(at)], schema=schema)

    sent = data.select("vec_id", "vector").mapInArrow(run, "centre int, vec_id long, vector array<long>")
    sent = sent.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return sent.withColumn("part", F.explode(F.sequence(F.lit(0), _by_centre(parts).cast("int") - 1)))


def _by_centre(values: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x).cast("int") for item in values.items() for x in item]), F.col("centre"))


def _solver(k: int):
    def solve(asked: pa.Table, sent: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and sent.num_rows:
            order = np.argsort(sent.column("vec_id").to_numpy(), kind="stable")
            ids, x, q = sent.column("vec_id").to_numpy()[order], _matrix(sent.column("vector"))[order], _matrix(asked.column("vector"))
            # Doubles are exact below 2^53; larger products are formed in integers.
            exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < 2.0**53
            x, q = (x.astype(float), q.astype(float)) if exact else (x, q)
            names, block = asked.column("cid").to_pylist(), asked.column("block")[0].as_py()
            for low in range(0, len(q), 128):
                scores = q[low : low + 128] @ x.T
                n = scores.shape[1]
                least = np.partition(scores, n - min(k, n), axis=1)[:, n - min(k, n)]
                for name, row, limit in zip(names[low : low + 128], scores, least, strict=True):
                    at = np.flatnonzero(row >= limit)
                    at = at[np.argsort(-row[at], kind="stable")][:k]
                    out.append((name, block, [{"score": int(s), "vec_id": int(v)} for s, v in zip(row[at], ids[at], strict=True)]))
        shape = pa.schema([("cid", pa.string()), ("block", pa.int32()), ("best", pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())])))])
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), shape, strict=True)], schema=shape)

    return solve
