"""Match offsets: every match of a pattern with its half-open code-point range.

Two forms of the same primitive.  ``match_spans`` is a row-local Column (no
shuffle), meant for patterns with few hits per row.  ``explode_matches`` gives
one row per hit and takes offsets from a running sum, meant for dense patterns
such as words; its window only needs the document key, so a table already
hash-partitioned by document is not shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Runs of letters (other numeric symbols count as letters, decimal digits do not).
WORD = r"[\p{L}\p{Nl}\p{No}]+"
# A sentence keeps its closing punctuation.
SENTENCE = r"[^.!?…\n]+[.!?…]*"

SPAN_TYPE = "array<struct<start:int,end:int,text:string>>"
_CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scanned(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """What ``emit(state before, item)`` (an array of type ``kind``) gives along ``items``, with the state that ``step`` carries.

    Arrays grow by copies, so the items are taken in blocks: first the state at the start of each block, then the blocks.
    """

    def block_items(block: Column, state: Column) -> Column:
        start = F.struct(state.alias("state"), F.array().cast(kind).alias("out"))
        return F.aggregate(
            block, start, lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], emit(acc["state"], x)).alias("out")),
            lambda acc: acc["out"],
        )

    def whole(z: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(z), F.lit(_CHUNK)), lambda at: F.slice(z, at, F.lit(_CHUNK)))
        states = lambda bs: F.aggregate(bs, F.array(zero), lambda acc, b: F.concat(acc, F.array(F.aggregate(b, F.element_at(acc, -1), step))))
        many = let(blocks, lambda bs: F.flatten(F.zip_with(bs, F.slice(states(bs), F.lit(1), F.size(bs)), block_items)))
        return F.when(F.size(z) <= _CHUNK, block_items(z, zero)).otherwise(many)

    return let(items, whole)


def match_spans(text: Column, pattern: str | Column, following: bool = False) -> Column:
    """All matches of ``pattern`` as ``array<struct<start,end,text>>`` (code points).

    ``following`` adds ``then``, the text between a match and the next one.

    The pattern must not match the empty string.  Offsets are prefix sums taken
    in blocks, so a long text costs close to linear time.
    """
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    empty = F.array().cast(SPAN_TYPE.replace("text:string", "text:string,then:string") if following else SPAN_TYPE)

    def part(gap: Column, hit: Column) -> Column:
        return F.struct(F.char_length(gap).alias("gap"), F.char_length(hit).alias("size"), hit.alias("hit"))

    if following:
        pairs = let(
            F.split(text, pat, -1),
            lambda gaps: F.zip_with(
                F.zip_with(gaps, F.regexp_extract_all(text, pat, F.lit(0)), part),
                F.slice(gaps, F.lit(2), F.size(gaps)),
                lambda p, then: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), p["hit"].alias("hit"), then.alias("then")),
            ),
        )
    else:
        pairs = F.zip_with(F.split(text, pat, -1), F.regexp_extract_all(text, pat, F.lit(0)), part)

    def advance(pos: Column, pair: Column) -> Column:
        return pos + pair["gap"] + F.coalesce(pair["size"], F.lit(0))

    def block_spans(block: Column, base: Column) -> Column:
        def step(acc: Column, pair: Column) -> Column:
            begin = acc["pos"] + pair["gap"]
            after = [pair["then"].alias("then")] if following else []
            item = F.struct(begin.alias("start"), (begin + pair["size"]).alias("end"), pair["hit"].alias("text"), *after)
            return F.when(pair["hit"].isNull(), acc).otherwise(
                F.struct((begin + pair["size"]).alias("pos"), F.concat(acc["out"], F.array(item)).alias("out"))
            )

        start = F.struct(base.cast("int").alias("pos"), empty.alias("out"))
        return F.aggregate(block, start, step, lambda acc: acc["out"])

    def whole(z: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(1), F.size(z), F.lit(_CHUNK)), lambda at: F.slice(z, at, F.lit(_CHUNK))
        )
        many = let(
            blocks,
            lambda bs: F.flatten(
                F.zip_with(
                    bs,
                    F.aggregate(
                        bs,
                        F.array(F.lit(0)),
                        lambda acc, b: F.concat(
                            acc, F.array(F.aggregate(b, F.element_at(acc, -1), advance))
                        ),
                        lambda acc: F.slice(acc, F.lit(1), F.size(bs)),
                    ),
                    block_spans,
                )
            ),
        )
        return F.when(F.size(z) <= _CHUNK, block_spans(z, F.lit(0))).otherwise(many)

    return F.when(text.rlike(pattern) if isinstance(pattern, str) else F.regexp_like(text, pat), let(pairs, whole)).otherwise(empty)


def explode_matches(
    df: DataFrame,
    pattern: str,
    keys: Sequence[str],
    text: str = "text",
    carry: Sequence[str] = (),
    with_gap: bool = False,
) -> DataFrame:
    """One row per match: ``keys``, ``carry``, ``n`` (0-based), ``start``, ``end``, ``match``.

    ``keys`` must identify a row of ``df``; the first one is the document key.
    ``with_gap`` adds ``gap``, the text between the previous match and this one.
    """
    extra = [F.col("_z.gap").alias("gap")] if with_gap else []
    pieces = df.select(
        *keys,
        *carry,
        F.posexplode(
            F.arrays_zip(
                F.split(F.col(text), pattern, -1).alias("gap"),
                F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("hit"),
            )
        ).alias("n", "_z"),
    ).select(*keys, *carry, "n", F.char_length("_z.gap").alias("_gap"), *extra, F.col("_z.hit").alias("match"))
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("match")
    return (
        pieces.withColumn("end", F.sum(F.col("_gap") + F.coalesce(size, F.lit(0))).over(w).cast("int"))
        .where(F.col("match").isNotNull())
        .select(*keys, *carry, "n", (F.col("end") - size).alias("start"), "end", "match", *(["gap"] if with_gap else []))
    )


def colocate(df: DataFrame, key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Hash-partition by document once, while rows are still whole texts.

    Everything exploded from the result keeps the partitioning, so windows over
    (document, …) run without another exchange.  A document is one input row,
    so no task ever holds more than its share of whole rows.

    Spark 4.1 may treat a union of such branches as still partitioned by document;
    together with a reused exchange its branches are then not aligned and a
    ``distinct`` above keeps duplicates.  That inference is switched off here.

    ``parts``: for steps whose rows outweigh the texts, so that small exchanges are not merged into few partitions.
    """
    df.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return df.repartition(parts, F.col(key)) if parts else df.repartition(F.col(key))


def words(paragraphs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Letter runs of every paragraph with code-point offsets."""
    return explode_matches(paragraphs, WORD, ["doc_id", "paragraph"], carry=carry).withColumnRenamed("match", "word")


#: Words of an Arrow batch of ``words_in_place``.
_BATCH = 200_000


def words_in_place(paragraphs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The rows of ``words`` without exchange or sort: words are found by Spark, offsets summed up on Arrow batches."""
    text, names = F.col("text"), ["doc_id", "paragraph", *carry]
    lists = paragraphs.where(text.rlike(WORD)).select(
        *names, F.transform(F.split(text, WORD, -1), F.char_length).alias("_gaps"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_hits")
    )
    kinds = [paragraphs.schema[c] for c in names]
    shape = StructType([*kinds, *[StructField(c, IntegerType()) for c in ("n", "start", "end")], StructField("word", StringType())])

    def run(batches):
        for b in batches:
            counts = pc.list_value_length(b.column("_hits")).to_numpy(zero_copy_only=False)
            blocks = np.cumsum(counts) // _BATCH
            for first in np.flatnonzero(np.diff(blocks, prepend=-1)):
                part = b.slice(first, int(np.searchsorted(blocks, blocks[first], "right")) - first)
                count = pc.list_value_length(part.column("_hits")).to_numpy(zero_copy_only=False).astype(np.int64)
                found = part.column("_hits").flatten()
                size = pc.utf8_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(count)), count)
                # A paragraph has one gap more than words.
                gap = part.column("_gaps").flatten().to_numpy(zero_copy_only=False)[np.arange(len(row)) + row].astype(np.int64)
                begins = np.cumsum(count) - count
                total = np.cumsum(gap + size)
                end = total - np.repeat(np.concatenate(([0], total))[begins], count)
                n = np.arange(len(row)) - np.repeat(begins, count)
                kept = [part.column(c).take(pa.array(row)) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x, pa.int32()) for x in (n, end - size, end)], found], names=shape.names)

    return lists.mapInArrow(run, shape)


def sentences(spans: DataFrame, keys: Sequence[str] = ("doc_id", "paragraph"), text: str = "text") -> DataFrame:
    """Sentences of each row's text, offsets relative to that text."""
    return spans.select(*keys, F.posexplode(match_spans(F.col(text), SENTENCE)).alias("n", "_s")).select(
        *keys, "n", F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), F.col("_s.text").alias("sentence")
    )


def sentence_ordinal(ends: Column, offset: Column) -> Column:
    """How many sentence ends lie at or before ``offset``."""
    return F.size(F.filter(ends, lambda e: e <= offset))
