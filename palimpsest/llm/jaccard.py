"""Join of texts by the Jaccard similarity of their word n-grams: chosen-path sets.

Each run splits the sets recursively: a set chooses each of its n-grams with a
chance of one in (threshold x size), by a hash that all sets share, and meets in
the bucket of an n-gram the sets that chose it too. Buckets of few sets are
compared by brute force; the others are split again by further n-grams, down to
a last level whose buckets are compared in blocks. The number of runs follows from
the recall that is asked for: a pair that meets in a small bucket needs the first
level only, so few runs serve all sets; those in larger buckets, whose pairs must
meet at every level, go through further runs among themselves.

Texts with equal n-gram sets are one class from the start. Within the buckets, a
pair belongs to the smallest bucket that it shares; a sketch first picks the
members that have a partner there, and only those fetch their n-grams for the
exact comparison. What leaves a bucket is per member, never per pair. The links
found give the components; in those of more than two sets all pairs are then
counted exactly, in blocks.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from . import blocks as B
from . import common as C

#: A pair at the threshold is missed once in a million, by the first runs and by the further ones each.
WORDS, THRESHOLD, RECALL, LEVELS = 5, 0.8, 1 - 1e-6, 3
#: Sets in a bucket that is not split further; members in a chunk of a bucket for the sketches, and for the exact comparison.
SMALL_BUCKET, SKETCH_CHUNK, CHUNK = 128, 512, 128
#: Ranges of a sketch, and the deviations by which it may fall short: at 6, a pair at the threshold is ruled out once in a million.
SKETCH, MARGIN = 64, 6.0
_KEPT_WORDS = 200_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def runs_for(recall: float, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold shares a last bucket with this chance.

    A pair at the threshold shares one chosen n-gram per level in the mean (sets of
    different sizes, the worst case), so its path lives on as a branching process.
    """
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _runs(first: int, end: int) -> np.ndarray:
    """The names that stand above the first level in these runs."""
    return _mix(np.arange(first + 1, end + 1, dtype=np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    return x


class Shingler:
    """Sorted distinct hashes of a text's word n-grams, words in lower case between white space.

    A text of fewer words has one n-gram of them all; one without words has none.
    """

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.kept = words, {}

    def __call__(self, text: str) -> np.ndarray:
        words, kept = text.lower().split(), self.kept
        try:
            ids = [kept[w] for w in words]
        except KeyError:
            if len(kept) > _KEPT_WORDS:
                kept.clear()
            ids = []
            for w in words:
                if (h := kept.get(w)) is None:
                    h = kept[w] = xxhash.xxh64_intdigest(w)
                ids.append(h)
        h = np.array(ids, np.uint64)
        n = min(self.words, len(h))
        if not n:
            return h
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mix(out + h[i : len(h) - n + 1 + i])
        return np.unique(out)


def sketch(grams: np.ndarray) -> np.ndarray:
    """The smallest hash in each of 64 ranges, 16 bits of it; 0 where there is none."""
    bounds = np.arange(SKETCH, dtype=np.uint64) << np.uint64(58)
    at = np.searchsorted(grams, bounds)
    end = np.append(at[1:], len(grams))
    out = np.zeros(SKETCH, np.uint16)
    full = at < end
    out[full] = 1 + (_mix(grams[at[full]]) >> np.uint64(48)) % np.uint64(65535)
    return out


def paths(grams: np.ndarray, above: np.ndarray, level: int, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """The chosen paths of a level as (place of the path above, path); above the first level stand the runs."""
    limit = np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(grams)))))
    rows, at = np.nonzero(_mix(grams[None, :] ^ above[:, None]) < limit)
    # Named after the path above and the n-gram.
    return rows, _mix(above[rows] + _mix(grams[at] + np.uint64(level + 1)))


def _shingled(docs: DataFrame, words: int, threshold: float, recall: float) -> DataFrame:
    """Per row its id, the hash of its text, the name and size of its n-gram set, sketch and paths of the first level."""
    shape = "doc_id long, text_hash long, id binary, size int, sketch binary, path array<long>"
    schema = to_arrow_schema(StructType.fromDDL(shape))
    runs = _runs(0, runs_for(recall, 1))

    def run(batches):
        grams_of = Shingler(words)
        for b in batches:
            rows = []
            for doc_id, text_hash, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                grams = grams_of(text or "")
                if not len(grams):
                    rows.append((doc_id, text_hash, None, 0, None, None))
                    continue
                chosen = paths(grams, runs, 0, threshold)[1].view(np.int64)
                rows.append((doc_id, text_hash, xxhash.xxh3_128_digest(grams.tobytes()), len(grams), sketch(grams).tobytes(), chosen))
            yield C.batch(schema, *zip(*rows, strict=True))

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, shape)


def _deeper(docs: DataFrame, classes: DataFrame, nodes: DataFrame, further: np.ndarray, threshold: float, words: int) -> DataFrame:
    """level, above, key and id of the paths below ``nodes`` (key, id), found again from the texts: few sets need them.

    Level 0 holds these sets' first paths in the ``further`` runs.
    """
    shape = "level int, above long, key long, id binary"
    schema = to_arrow_schema(StructType.fromDDL(shape))
    members = nodes.groupBy("id").agg(F.collect_set("key").alias("tops")).join(classes.select("id", "first"), "id")

    def run(batches):
        grams_of = Shingler(words)

        def listed(level: int, grams: np.ndarray, above: np.ndarray, name: bytes) -> tuple[pa.RecordBatch, np.ndarray]:
            rows, below = paths(grams, above, level, threshold)
            return C.batch(schema, [level] * len(below), above[rows].view(np.int64), below.view(np.int64), [name] * len(below)), below

        for b in batches:
            for name, tops, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                grams, above = grams_of(text), np.array(tops, np.int64).view(np.uint64)
                if len(further):
                    yield listed(0, grams, further, name)[0]
                for level in range(1, LEVELS):
                    found, above = listed(level, grams, above, name)
                    yield found

    return _texts(docs, members).select("id", "tops", "text").mapInArrow(run, shape)


def _buckets(docs: DataFrame, classes: DataFrame, threshold: float, words: int, recall: float) -> DataFrame:
    """key and id of the buckets with two sets or more that are compared: small ones of any level, all of the last.

    Pairs that share a small bucket are met in the first runs. The others share
    large ones only, so both their sets take part in the further runs.
    """
    further = _runs(runs_for(recall, 1), runs_for(recall))
    first, deep = _split(docs, classes, classes.select("id", F.explode("path").alias("key")), further, threshold, words)
    again, _ = _split(docs, classes, deep.where("level = 0").select("id", "key"), further[:0], threshold, words)
    return first.unionByName(again)


def _split(docs: DataFrame, classes: DataFrame, nodes: DataFrame, further: np.ndarray, threshold: float, words: int) -> tuple[DataFrame, DataFrame]:
    """The buckets to compare from the paths of the first level (``nodes``) down, and what ``_deeper`` found for the large ones."""
    found, deep = [], None
    for level in range(LEVELS):
        sizes = C.written(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        last = level == LEVELS - 1
        found.append(nodes.join(sizes if last else sizes.where(F.col("n") <= SMALL_BUCKET), "key", "left_semi").select("key", "id"))
        if last:
            break
        large = sizes.where(F.col("n") > SMALL_BUCKET).select("key")
        if level:
            nodes = deep.where(F.col("level") == level + 1).join(large.withColumnRenamed("key", "above"), "above", "left_semi")
        else:
            # All of these lie below a large bucket.
            deep = C.written(_deeper(docs, classes, nodes.join(large, "key", "left_semi"), further, threshold, words), "deeper")
            nodes = deep.where("level = 1")
        nodes = nodes.select("key", "id").distinct()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, deep


class _Bucket:
    """Blocks of a bucket's members, of which each knows all its buckets."""

    def base(self, table: pa.Table) -> tuple:
        return table.column("key").to_numpy(), table.column("chunk").to_numpy(), table.column("id").to_pylist(), table.column("buckets"), table.column("size").to_numpy().astype(np.int64)

    def owned(self, loaded: tuple, s: int, e: int, across: bool) -> np.ndarray:
        """Pairs that share no smaller bucket."""
        key, chunk, _, buckets, _ = loaded[:5]
        lists = buckets.slice(s, e - s).to_pylist()
        rows = np.repeat(np.arange(e - s), [len(x) for x in lists])
        values = np.array([v for x in lists for v in x], np.int64)
        before = values < key[s]
        return (B.shared(values[before], rows[before], e - s) == 0) & B.countable(chunk[s:e], across)


class _Candidates(_Bucket):
    """Members with a partner that the sketches do not rule out."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def load(self, table: pa.Table) -> tuple:
        return *self.base(table), np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH)

    def __call__(self, loaded, s: int, e: int, across: bool) -> list[tuple]:
        key, chunk, names, buckets, size, sketches = loaded
        own, n = sketches[s:e], size[s:e]
        same, both = np.zeros((e - s, e - s), np.int16), np.zeros((e - s, e - s), np.int16)
        for k in range(SKETCH):
            x = own[:, k]
            either = (x[:, None] > 0) | (x[None, :] > 0)
            both += either
            same += either & (x[:, None] == x[None, :])
        t = self.threshold
        near = same >= t * both - MARGIN * np.sqrt(t * (1 - t) * both)
        near &= np.minimum(n[:, None], n[None, :]) >= t * np.maximum(n[:, None], n[None, :]) * (1 - 1e-12)
        near &= B.countable(chunk[s:e], across)
        if not near.any():
            return []
        found = (near & self.owned(loaded, s, e, across)).any(axis=1)
        return [(int(key[s]), names[s + i]) for i in np.flatnonzero(found)]


class _Links(_Bucket):
    """Exact links of the members: documents linked with, and a chain through each component."""

    def __init__(self, threshold: float) -> None:
        self.ratio = Fraction(threshold).limit_denominator(10_000)

    def load(self, table: pa.Table) -> tuple:
        return *self.base(table), table.column("copies").to_numpy().astype(np.int64), table.column("grams")

    def __call__(self, loaded, s: int, e: int, across: bool) -> list[tuple]:
        _, _, names, _, size, copies, grams = loaded
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in grams.slice(s, e - s)]
        n = e - s
        common = B.shared(np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets]), n).astype(float)
        p, q, total = self.ratio.numerator, self.ratio.denominator, size[s:e, None] + size[None, s:e]
        linked = (common * (p + q) >= p * total) & self.owned(loaded, s, e, across)
        count, label = linked @ copies[s:e], B.gathered(linked)
        return [(names[s + i], int(count[i]), names[s + label[i]] if label[i] != i else None) for i in np.flatnonzero(linked.any(axis=1))]


def similar(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, text_hash, class_id, n_links, component_id, kept.

    class_id is the smallest id with the same n-gram set, n_links the number of
    other rows at the threshold or above, component_id the smallest id reachable by
    links, and kept marks that row. Texts that are null, empty or without words link
    with nothing. Rows without an id take part; they name a class or component only
    if none of its rows has one. Repeated rows count one by one, and are all kept if
    one is: they cannot be told apart.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = C.written(_shingled(docs, words, threshold, recall), "shingled")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    kept = [F.first(c).alias(c) for c in rows.columns[3:]]
    classes = C.written(rows.where("id is not null").groupBy("id").agg(first, F.count(F.lit(1)).alias("copies"), *kept), "classes")
    found = C.written(_linked(docs, classes, threshold, words, recall), "links")
    roots = C.written(B.components(found.where("mate is not null").select(F.col("id").alias("a"), F.col("mate").alias("b"))), "roots")
    counts = _counted(docs, classes, roots, threshold, words).groupBy("id").agg(F.sum("links").alias("links"))
    least = roots.join(classes.select(F.col("id").alias("node"), "first"), "node").groupBy("root").agg(F.min("first").alias("component"))
    known = classes.select("id", "first", "copies").join(counts, "id", "left").join(roots.join(least, "root").select(F.col("node").alias("id"), "component"), "id", "left")
    known = known.select("id", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component"))
    out = rows.select("doc_id", "text_hash", "id").join(known, "id", "left")
    lone = F.col("first").isNull()
    return out.select(
        F.col("doc_id").alias(id_column),
        "text_hash",
        F.when(lone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(lone, F.col("doc_id")).otherwise(F.col("component.doc_id")).alias("component_id"),
        (lone | (F.col("doc_id").eqNullSafe(F.col("component.doc_id")) & (F.col("text_hash") == F.col("component.text_hash")))).alias("kept"),
    )


def _linked(docs: DataFrame, classes: DataFrame, threshold: float, words: int, recall: float) -> DataFrame:
    """id, links, mate of the classes that link with another."""
    buckets = C.written(_buckets(docs, classes, threshold, words, recall), "buckets")
    known = classes.select("id", "first", "copies", "size", "sketch").join(buckets.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("buckets")), "id")
    known = C.written(known, "members")
    # Of its other buckets a row takes along those before the bucket: they alone decide whose a pair is.
    listed = known.select(F.posexplode("buckets").alias("at", "key"), "id", "buckets", "size", "sketch").withColumn("buckets", F.expr("slice(buckets, 1, at)")).drop("at")
    near = C.written(B.blocked(listed, _Candidates(threshold), "key long, id binary", SKETCH_CHUNK).distinct(), "candidates")
    members = known.drop("sketch").join(near.groupBy("id").agg(F.collect_list("key").alias("keys")), "id")
    texts = _texts(docs, members.select("id", "copies", "size", "buckets", "keys", "first"))
    whole = C.written(_with_grams(texts, words), "grams").select(F.explode("keys").alias("key"), "id", "copies", "size", "buckets", "grams")
    return B.blocked(whole.withColumn("buckets", F.expr("filter(buckets, b -> b < key)")), _Links(threshold), "id binary, links long, mate binary", CHUNK)


def _counted(docs: DataFrame, classes: DataFrame, roots: DataFrame, threshold: float, words: int) -> DataFrame:
    """id and links of all pairs inside each component."""
    pairs = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"))
    # Two sets in a component are linked with each other.
    two = pairs.where("n = 2").select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("mate")), F.struct(F.col("b").alias("id"), F.col("a").alias("mate")))).alias("x"))
    two = two.select("x.*").join(classes.select(F.col("id").alias("mate"), F.col("copies").alias("links")), "mate").select("id", "links")
    members = roots.join(pairs.where("n > 2").select("root"), "root").select(F.xxhash64("root").alias("key"), F.col("node").alias("id"))
    members = members.join(classes.select("id", "copies", "size", "first"), "id")
    whole = C.written(_with_grams(_texts(docs, members), words), "components").withColumn("buckets", F.array().cast("array<long>"))
    return two.unionByName(B.blocked(whole, _Links(threshold), "id binary, links long, mate binary", CHUNK).select("id", "links"))


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The text of each member in place of the row (first) that names it. Rows that are repeated whole bring it more than once."""
    members = members.withColumns({"doc_id": F.col("first.doc_id"), "text_hash": F.col("first.text_hash")}).drop("first")
    same = docs.alias("d").join(members.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_hash") == F.col("m.text_hash")))
    return same.select(*[f"m.{c}" for c in members.columns if c not in ("doc_id", "text_hash")], "d.text").dropDuplicates(["id"])


def _with_grams(texts: DataFrame, words: int) -> DataFrame:
    """The n-gram set in place of the text."""
    kept = texts.drop("text")

    def run(batches):
        grams_of = Shingler(words)
        for b in batches:
            at = b.schema.get_field_index("text")
            grams = pa.array([grams_of(t).tobytes() for t in b.column(at).to_pylist()], pa.binary())
            yield b.set_column(at, "grams", grams)

    return texts.select(*kept.columns, "text").mapInArrow(run, StructType([*kept.schema.fields, StructField("grams", BinaryType())]))
