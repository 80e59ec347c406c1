"""Phrase collocations: Rabin-Karp fingerprints of all n-grams, text for the frequent ones only.

1. Documents are gathered into pieces of bounded size per language, in lower case, with one
   space between the words of a part and a line end between parts.
2. Prefix polynomials over the bytes of a piece fingerprint every n-gram with two look-ups.
   A piece sends its distinct fingerprints with their counts, cut to the bits that the corpus
   needs, to the buckets of the fingerprint space; the piece is their occurrence pointer.
3. A bucket adds up the counts and tells each piece which of its fingerprints are frequent.
4. The piece finds their occurrences again and verifies them against its text byte by byte:
   n-grams that share a fingerprint are told apart, and only these phrases become text.
5. Phrases are counted by their text. A collision can let a rare one through to this
   count, which drops it; it never adds to another's count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import exchange as X

#: Occurrences that a phrase needs; per cent of a phrase's occurrences inside a longer one that absorb it.
LEAST, ABSORBED = 10, 50
#: Score of a phrase whose parts occur nowhere else.
SCALE = 1_000_000
#: Bytes of a piece, and n-grams that meet in a bucket.
PIECE, BUCKET = 3 << 20, 8 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLDED = bytes(
    32 if b == 9 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b
    for b in range(256)
)
_SPACES = re.compile(b"  +")


def folded(text: str) -> bytes:
    """A-Z in lower case, parts ended by line ends, one space between words."""
    body = text.encode().translate(_FOLDED)
    return _SPACES.sub(b" ", body) if b"  " in body else body


def _cut(body: bytes, size: int) -> Iterator[bytes]:
    """Cuts at ends of parts; a part is never cut, however long."""
    at = 0
    while len(body) - at > size:
        cut = body.rfind(b"\n", at, at + size)
        cut = cut if cut >= 0 else body.find(b"\n", at + size)
        if cut < 0:
            break
        yield body[at:cut]
        at = cut + 1
    yield body[at:]


def pieces(docs: DataFrame, size: int = PIECE) -> DataFrame:
    """piece, lang, body (compressed), size, words: texts of a language, one after the other, about ``size`` bytes each."""
    types = pa.schema([("piece", pa.int64()), ("lang", pa.string()), ("body", pa.binary()), ("size", pa.int64()), ("words", pa.int64())])

    def gather(batches):
        held: dict[str, list[bytes]] = {}
        sizes: Counter = Counter()
        number = TaskContext.get().partitionId() << 32

        def emit(lang):
            nonlocal number
            body = b"\n".join(held.pop(lang))
            del sizes[lang]
            number += 1
            packed = zstandard.ZstdCompressor(level=3).compress(body)
            return C.batch(types, [number - 1], [lang], [packed], [len(body)], [len(body.split())])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for part in _cut(folded(text), size):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] += len(part)
                    if sizes[lang] >= size:
                        yield emit(lang)
                    elif sizes.total() >= 2 * size:
                        yield emit(max(sizes, key=sizes.get))
        for lang in list(held):
            yield emit(lang)

    known = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    return known.mapInArrow(gather, "piece long, lang string, body binary, size long, words long")


def _plain(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body)


@lru_cache(maxsize=2)
def _powers(base: int, exponent: int) -> np.ndarray:
    out = np.full(1 << exponent, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)


class Grams:
    """All n-grams of up to ``longest`` words of a body, with fingerprints of ``bits`` bits.

    ``first`` and ``last``: where each begins and ends; ``marks``: its fingerprint.
    """

    def __init__(self, body: bytes, longest: int, bits: int) -> None:
        self.body, signs = body, np.frombuffer(body, np.uint8)
        inside = np.zeros(len(signs) + 2, np.int8)
        inside[1:-1] = (signs != 32) & (signs != 10)
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[0::2], edges[1::2]
        goes_on = np.zeros(len(starts), bool)  # the next word belongs to the same part
        if len(starts) > 1:
            goes_on[:-1] = (starts[1:] - ends[:-1] == 1) & (signs[ends[:-1]] == 32)
        exponent = X.power_of_two(len(signs) + 1)
        prefix = np.zeros(len(signs) + 1, np.uint64)
        np.cumsum(_signs()[signs] * _powers(_BASE, exponent)[: len(signs)], out=prefix[1:])
        first, last = [], []
        at = np.arange(len(starts))
        for n in range(1, longest + 1):
            first.append(starts[at])
            last.append(ends[at + n - 1])
            at = at[goes_on[at + n - 1]]
        self.words = [np.full(len(x), n, np.int8) for n, x in enumerate(first, 1)]
        self.first, self.last, self.words = map(np.concatenate, (first, last, self.words))
        marks = (prefix[self.last] - prefix[self.first]) * _powers(_INVERSE, exponent)[self.first]
        marks ^= marks >> np.uint64(31)
        marks *= np.uint64(0xD6E8FEB86659FD93)
        self.marks = marks >> np.uint64(64 - bits)

    def keep(self, chosen: np.ndarray) -> None:
        self.first, self.last, self.words, self.marks = (x[chosen] for x in (self.first, self.last, self.words, self.marks))

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct phrases: where one begins and ends, and how often each occurs; verified byte by byte."""
        order = np.argsort(self.marks, kind="stable")
        self.keep(order)
        begins = np.flatnonzero(np.diff(self.marks, prepend=self.marks[:1] + np.uint64(1)))
        times = np.diff(np.append(begins, len(order)))
        leader = np.repeat(begins, times)
        wrong = ~self._equal(leader)
        if not wrong.any():
            return begins, times, self.words[begins]
        # Fingerprints that stand for several phrases: these are counted by their text.
        mixed = np.isin(leader, leader[wrong])
        clean = ~mixed[begins]
        told: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(mixed).tolist():
            told.setdefault(self.body[self.first[i] : self.last[i]], []).append(i)
        own = np.array([x[0] for x in told.values()])
        begins, times = np.append(begins[clean], own), np.append(times[clean], [len(x) for x in told.values()])
        return begins, times, self.words[begins]

    def _equal(self, leader: np.ndarray) -> np.ndarray:
        """Whether each n-gram has the bytes of its leader: eight at a time."""
        padded = self.body + bytes(8)
        eight = np.ndarray((len(self.body) + 1,), "<u8", padded, strides=(1,))
        lengths = self.last - self.first
        same = lengths == lengths[leader]
        at, offset = np.flatnonzero(same & (leader != np.arange(len(leader)))), 0
        while len(at):
            left = lengths[at] - offset
            part = left < 8
            differ = eight[self.first[at] + offset] ^ eight[self.first[leader[at]] + offset]
            differ[part] &= (np.uint64(1) << (np.uint64(8) * left[part].astype(np.uint64))) - np.uint64(1)
            same[at[differ != 0]] = False
            at, offset = at[(differ == 0) & (left > 8)], offset + 8
        return same

    def texts(self, rows: np.ndarray) -> pa.Array:
        lengths = (self.last - self.first)[rows]
        ends = np.cumsum(lengths)
        offsets = np.append(0, ends).astype(np.int32)
        places = np.repeat(self.first[rows] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        data = np.frombuffer(self.body, np.uint8)[places]
        return pa.StringArray.from_buffers(len(rows), pa.py_buffer(offsets), pa.py_buffer(data))


def counts(docs: DataFrame, longest: int = 3, least: int = LEAST, bits: int | None = None, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, count) of every phrase of up to ``longest`` words with ``least`` occurrences, and (lang, words).

    ``bits`` of a fingerprint follow the size of the corpus where they are not given.
    """
    C.prepare(docs.sparkSession)
    table = X.written_pieces(pieces(docs, piece), "pieces")
    size = table.agg(F.sum("size")).first()[0] or 0
    bits = bits or min(60, max(16, X.power_of_two(size * longest / 3)))  # about twice as many fingerprints as n-grams
    high = min(bits, X.power_of_two(size * longest / 6 / BUCKET))
    low = np.uint64(bits - high)

    def cuts(distinct):
        return np.searchsorted(distinct, np.arange((1 << high) + 1, dtype=np.uint64) << low)

    def send(batches):
        for b in batches:
            for number, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                distinct, times = np.unique(Grams(_plain(body), longest, bits).marks, return_counts=True)
                at, rows = cuts(distinct), []
                for k in np.flatnonzero(np.diff(at)).tolist():
                    own = slice(at[k], at[k + 1])
                    rows.append((k, number, X.pack_rising(distinct[own] - (np.uint64(k) << low), times[own])))
                for i in range(0, len(rows), 64):
                    yield C.batch(sent, *zip(*rows[i : i + 64], strict=True))

    sent = pa.schema([("bucket", pa.int64()), ("piece", pa.int64()), ("marks", pa.binary())])

    def frequent(bucket, rows):
        total = np.zeros(1 << int(low), np.int64)
        for data in rows.column("marks"):
            marks, times = X.unpack_rising(data.as_py(), 2)
            total[marks] += times
        often = total >= least
        for number, data in zip(rows.column("piece").to_pylist(), rows.column("marks"), strict=True):
            yield number, bucket, np.packbits(often[X.unpack_rising(data.as_py(), 2)[0]]).tobytes()

    def resolve(own, answers):
        grams = Grams(_plain(own["body"]), longest, bits)
        distinct = np.unique(grams.marks)
        at = cuts(distinct)
        often = np.zeros(len(distinct), bool)
        for a in answers:
            s, e = at[a["bucket"]], at[a["bucket"] + 1]
            often[s:e] = np.unpackbits(np.frombuffer(a["often"], np.uint8), count=e - s)
        chosen = distinct[often]
        place = np.minimum(np.searchsorted(chosen, grams.marks), max(0, len(chosen) - 1))
        grams.keep(chosen[place] == grams.marks if len(chosen) else np.zeros(len(grams.marks), bool))
        rows, times, _ = grams.counted()
        return pa.table([pc.binary_join_element_wise(own["lang"], grams.texts(rows), "\n"), pa.array(times, pa.int64())], names=["key", "count"])

    marked = table.select("piece", "body").mapInArrow(send, "bucket long, piece long, marks binary")
    answers = C.written(X.by_bucket(marked, frequent, "piece long, bucket long, often binary"), "frequent")
    found = X.by_piece(table.select("piece", "lang", "body"), answers, resolve, "key string, count long")
    every = found.groupBy("key").agg(F.sum("count").alias("count")).where(F.col("count") >= least)
    phrase = F.substring_index("key", "\n", -1)
    every = every.select(F.expr("substr(key, 1, length(key) - length(substring_index(key, '\n', -1)) - 1)").alias("lang"), F.size(F.split(phrase, " ")).alias("n"), phrase.alias("phrase"), "count")
    return C.written(every, "phrases"), table.groupBy("lang").agg(F.sum("words").alias("words"))


def collocations(
    docs: DataFrame, longest: int = 3, least: int = LEAST, absorbed: int = ABSORBED, top: int | None = 2000, bits: int | None = None, piece: int = PIECE
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of 2 to ``longest`` words of ``docs`` (text, lang), the first ``top`` of each language.

    A phrase with ``a`` occurrences, cut in two parts that occur ``l`` and ``r`` times, scores ``SCALE * a * a / (l * r)``,
    rounded down; the cut with the lowest score counts, the first of several. A phrase goes if ``absorbed`` per cent of its
    occurrences or more lie in one longer phrase with ``least`` occurrences. ``n``: words of the language. Ties in
    score and ``a`` go by the bytes of the phrase. Null texts are empty, null languages ``und``; repeated rows count each;
    other columns are left out; an empty table gives no rows. Numbers are exact up to 10**15 occurrences.
    """
    found, totals = counts(docs, longest, least, bits, piece)
    words = F.split("phrase", " ")
    long = found.where("n >= 2").withColumnRenamed("count", "a")
    cut = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cut = cut.withColumns({"head": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "tail": F.array_join(F.slice(words, F.col("k") + 1, F.col("n")), " ")})
    head = found.select("lang", F.col("phrase").alias("head"), F.col("count").alias("l"))
    tail = found.select("lang", F.col("phrase").alias("tail"), F.col("count").alias("r"))
    exact = F.expr(f"(cast({SCALE} as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    scored = cut.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).withColumn("score", exact)
    least_cut = scored.groupBy("lang", "phrase", "n", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("_c"))
    # Every contiguous part of two words or more of a longer phrase, with the most frequent phrase around it.
    spans = F.expr("flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), i -> struct(i, m))))")
    around = found.where("n >= 3").withColumn("_s", F.explode(spans)).select("lang", F.array_join(F.slice(words, F.col("_s.i"), F.col("_s.m")), " ").alias("phrase"), "count")
    around = around.groupBy("lang", "phrase").agg(F.max("count").alias("_around"))
    kept = least_cut.join(around, ["lang", "phrase"], "left").where(f"_around IS NULL OR 100 * _around < {absorbed} * a")
    ordered = Window.partitionBy("lang").orderBy(F.desc("_c.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(ordered).cast("long"))
    ranked = ranked.where(F.col("rank") <= top) if top else ranked
    out = ranked.join(totals.withColumnRenamed("words", "total"), "lang")
    return out.select("lang", "rank", "phrase", "a", "_c.l", "_c.r", F.col("total").alias("n"), "_c.score")
