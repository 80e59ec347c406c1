"""Class-based bigram language model: exchange clustering, class transitions and word emissions.

Texts are kept in pieces as numbers of their piece's own word list, in the order of
the buckets that words hash to. Pieces and buckets then send each other packed
arrays (``exchange``), so every word of the corpus is counted, has a class and is moved,
and nothing but tables of classes x classes goes through the driver.

1. Buckets add up word counts. The most frequent words begin with a class each, all
   others share the last one; class 0 is the end of a text, which also stands before its first word.
2. Exchange: pieces count the classes before and after each of their words; a bucket
   adds them up, takes each word out of its class and puts it where its neighbours are most
   likely, given the class transitions. All words move at once, in each of ``rounds``.
3. Per text, pieces count its class transitions; a last pass turns them into probabilities.

P(w | c') = P(c | c') * (count(w) + 1) / (N_c + V_c + 1) for a word of class c after class c', where N_c counts its
tokens and V_c its words; the one left over is the class's share for unknown words, whose probability is the sum of
these shares over all classes. P(c | c') = (n(c', c) + m * P(c)) / (n(c') + m) with
P(c) = (N_c + V_c + 1) / (N + V + C). An unknown word leaves the class context as it was.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import exchange as X

#: Classes with the end's, rounds of exchange, weight of P(c) in a transition.
CLASSES, ROUNDS, WEIGHT = 32, 2, 32.0
#: Bytes of text in a piece, and for which there is a bucket.
PIECE, BUCKET = 8 << 20, 16 << 20
END = 0
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STATE = "piece long, bucket long, ids binary, low binary, high binary, classes binary, top array<struct<times: long, id: long, word: binary>>, types array<long>, total long"


def words_of(text: str) -> list[bytes]:
    """A-Z in lower case, cut at space and \\x09-\\x0D."""
    return text.encode().translate(_LOWER).split()


@dataclass(frozen=True)
class Scored:
    """What was learned and the scores of all texts.

    ``scores``: doc_id, learned, n_tokens, n_known, train_tokens, base_score, score. ``words``: word, count, class
    of each word of the learned texts. ``transitions[a, b]``: how often class b follows class a in them.
    """

    scores: DataFrame
    words: DataFrame
    transitions: np.ndarray
    train_tokens: int
    train_words: int


def pieces(docs: DataFrame, learn: Column, high: int, size: int = PIECE) -> DataFrame:
    """Texts as word numbers, about ``size`` bytes of them together; words ordered by bucket (2**high of them)."""
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["piece", "doc_ids", "learned", "lengths", "ids", "words", "sizes", "times"]

    def gather(batches):
        number, doc_ids, learned, lengths, words, held = TaskContext.get().partitionId() << 32, [], [], [], [], 0

        def emit():
            encoded = pa.array(words, pa.binary()).dictionary_encode()
            own = encoded.dictionary.to_pylist()
            buckets = [zlib.crc32(w) >> (32 - high) if high else 0 for w in own]
            order = sorted(range(len(own)), key=lambda i: (buckets[i], own[i]))
            place = np.empty(len(own), np.int64)
            place[order] = np.arange(len(own))
            ids = place[np.asarray(encoded.indices, np.int64)]
            times = np.bincount(ids[np.repeat(learned, lengths)], minlength=len(own))
            sizes = np.bincount(np.array(buckets, np.int64), minlength=1 << high)
            values = [number], [doc_ids], [bytes(learned)], [X.pack(np.array(lengths, np.int64))], [X.pack(ids)], [_joined([own[i] for i in order])], [X.pack(sizes)], [X.pack(times)]
            types = [pa.int64(), pa.list_(id_type), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

        for b in batches:
            id_type = b.schema.field(0).type
            for doc_id, known, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                found = words_of(text)
                doc_ids.append(doc_id)
                learned.append(known)
                lengths.append(len(found))
                words += found
                held += len(text)
                if held >= size:
                    yield emit()
                    number, doc_ids, learned, lengths, words, held = number + 1, [], [], [], [], 0
        if doc_ids:
            yield emit()

    rows = docs.select("doc_id", F.coalesce(learn, F.lit(False)).alias("learned"), F.coalesce("text", F.lit("")).alias("text"))
    binary = ", ".join(f"{c} binary" for c in names[2:])
    return rows.mapInArrow(gather, f"piece long, doc_ids array<{key}>, {binary}")


def _joined(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def _split(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b" ") if data else []


def _wide(low: bytes, high: bytes) -> np.ndarray:
    return X.unpack(low)[0].astype(np.int64) + (X.unpack(high)[0].astype(np.int64) << 32)


def _bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def _words_sent(table: DataFrame) -> DataFrame:
    """bucket, piece, words, times: the words of a piece that belong to a bucket, and how often its learned texts hold them."""
    schema = pa.schema([("bucket", pa.int64()), ("piece", pa.int64()), ("words", pa.binary()), ("times", pa.binary())])

    def send(batches):
        for b in batches:
            for piece, words, sizes, times in zip(*[c.to_pylist() for c in b.columns], strict=True):
                words, sizes, times = _split(words), X.unpack(sizes)[0], X.unpack(times)[0]
                cuts = np.append(0, np.cumsum(sizes, dtype=np.int64)).tolist()
                rows = [(k, piece, _joined(words[s:e]), X.pack(times[s:e])) for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]
                for i in range(0, len(rows), 64):
                    yield C.batch(schema, *zip(*rows[i : i + 64], strict=True))

    return table.select("piece", "words", "sizes", "times").mapInArrow(send, "bucket long, piece long, words binary, times binary")


def _added_up(classes: int):
    """Word counts of a bucket, answered to each piece; and (piece -1) its most frequent words and totals."""

    def answer(bucket, rows):
        parts = [_split(x.as_py()) for x in rows.column("words")]
        every = pa.array([w for p in parts for w in p], pa.binary()).dictionary_encode()
        order = np.argsort(np.array(every.dictionary.to_pylist(), object), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ids = rank[np.asarray(every.indices, np.int64)]
        times = np.concatenate([X.unpack(x.as_py())[0].astype(np.int64) for x in rows.column("times")])
        total = np.zeros(len(order), np.int64)
        np.add.at(total, ids, times)
        at = 0
        for piece, part in zip(rows.column("piece").to_pylist(), parts, strict=True):
            own = ids[at : at + len(part)]
            at += len(part)
            yield piece, bucket, X.pack(own), X.pack(total[own] & 0xFFFFFFFF), X.pack(total[own] >> 32), None, None, None, None
        best = np.lexsort((np.arange(len(total)), -total))[: classes - 2]
        top = [{"times": int(total[i]), "id": int(i), "word": every.dictionary[int(order[i])].as_py()} for i in best if total[i]]
        yield -1, bucket, None, None, None, None, top, [int((total > 0).sum())], int(total.sum())

    return answer


class _Piece:
    """A piece with the classes and counts of its words."""

    def __init__(self, own: dict, answers: list[dict], classes: int, first: dict | None = None) -> None:
        self.doc_ids, self.learned = own["doc_ids"], np.frombuffer(own["learned"], np.uint8).astype(bool)
        self.lengths, self.ids = X.unpack(own["lengths"])[0].astype(np.int64), X.unpack(own["ids"])[0].astype(np.int64)
        of = [self._begun(a, classes, first) if first is not None else _bytes(a["classes"]) for a in answers]
        self.parts = of
        self.classes = np.concatenate([np.zeros(0, np.uint8), *of])
        self.ends = np.cumsum(self.lengths + 1) - 1
        is_word = np.ones(len(self.ids) + len(self.ends), bool)
        is_word[self.ends] = False
        self.is_word = is_word
        self.of_token = np.full(len(is_word), END, np.int64)
        self.of_token[is_word] = self.classes[self.ids]
        self.taught = np.repeat(self.learned, self.lengths + 1)

    @staticmethod
    def _begun(answer: dict, classes: int, first: dict) -> np.ndarray:
        ids = X.unpack(answer["ids"])[0]
        out = np.full(len(ids), classes - 1, np.uint8)
        for word, c in first.get(answer["bucket"], {}).items():
            out[ids == word] = c
        return out

    def transitions(self, classes: int) -> np.ndarray:
        before = np.append(END, self.of_token[:-1])
        return np.bincount((before * classes + self.of_token)[self.taught], minlength=classes * classes)


def _contexts_sent(table: DataFrame, state: DataFrame, classes: int, first: dict | None) -> DataFrame:
    """A row per piece and bucket with the classes around its words; and (bucket -1) the transitions of the piece."""

    def count(own, answers):
        p = _Piece(own, answers, classes, first)
        before, after = np.append(END, p.of_token[:-1]), np.append(p.of_token[1:], END)
        chosen = p.is_word & p.taught
        ids = p.ids[p.taught[p.is_word]]
        wide = 2 * classes
        around = np.bincount(np.concatenate([ids * wide + before[chosen], ids * wide + classes + after[chosen]]), minlength=len(p.classes) * wide)
        keys = np.flatnonzero(around)
        times = around[keys]
        at = 0
        for a, of in zip(answers, p.parts, strict=True):
            s, e = np.searchsorted(keys, (at * wide, (at + len(of)) * wide))
            packed = zstandard.ZstdCompressor(level=1).compress(of.tobytes())
            yield a["bucket"], own["piece"], a["ids"], a["low"], a["high"], packed, X.pack_rising(keys[s:e] - at * wide, times[s:e]), None
            at += len(of)
        found = p.transitions(classes)
        pairs = np.flatnonzero(found)
        yield -1, own["piece"], None, None, None, None, None, [{"pair": int(k), "times": int(found[k])} for k in pairs]

    schema = "bucket long, piece long, ids binary, low binary, high binary, classes binary, around binary, pairs array<struct<pair: int, times: long>>"
    return C.written(X.by_piece(table.select("piece", "doc_ids", "learned", "lengths", "ids"), state, count, schema), "contexts")


def _summed(rows: DataFrame, classes: int) -> np.ndarray:
    """Transitions of all pieces: at most classes * classes rows come back."""
    pairs = rows.where("pairs IS NOT NULL").select(F.explode("pairs").alias("p")).groupBy("p.pair").agg(F.sum("p.times").alias("times"))
    out = np.zeros(classes * classes)
    for r in pairs.collect():
        out[r["pair"]] = r["times"]
    return out.reshape(classes, classes)


def moved(around: np.ndarray, own: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The class of each word in which its neighbours are most likely, with the word taken out of its own class first.

    ``around``: how often each class stands before and after the word. Class 0 takes no words; words that were
    never seen stay; ties go to the own class, then the smallest.
    """
    classes = len(transitions)
    before, after = around[:, :classes].astype(float), around[:, classes:].astype(float)
    rows, columns = transitions.sum(1), transitions.sum(0)
    link = lambda n, a, b: np.log((n + 0.5) / ((a + 1.0) * (b + 1.0)))
    forward = link(transitions, rows[:, None], columns[None, :])
    gain = before @ forward + after @ forward.T
    index, times = np.arange(len(own)), around[:, :classes].sum(1)
    without = link(np.maximum(transitions.T[own] - before, 0), rows[None, :], np.maximum(columns[own] - times, 0)[:, None])
    behind = link(np.maximum(transitions[own] - after, 0), np.maximum(rows[own] - times, 0)[:, None], columns[None, :])
    stay = (before * without).sum(1) + (after * behind).sum(1)
    gain[index, own] = stay
    gain[:, END] = -np.inf
    best = gain.argmax(1)
    return np.where((times > 0) & (gain[index, best] > stay + 1e-9), best, own)


def _exchanged(sent: DataFrame, transitions: np.ndarray) -> DataFrame:
    classes = len(transitions)

    def answer(bucket, rows):
        parts = [X.unpack(x.as_py())[0].astype(np.int64) for x in rows.column("ids")]
        size = max(int(p.max()) for p in parts) + 1
        around, own = np.zeros((size, 2 * classes), np.int64), np.zeros(size, np.int64)
        for ids, of, packed in zip(parts, rows.column("classes"), rows.column("around"), strict=True):
            own[ids] = _bytes(of.as_py())
            keys, times = X.unpack_rising(packed.as_py(), 2)
            around[ids[keys // (2 * classes)], keys % (2 * classes)] += times
        seen = around.any(1)
        new = own.copy()
        for at in range(0, size, 1 << 15):  # bounded blocks of words
            part = slice(at, at + (1 << 15))
            new[part] = moved(around[part], own[part], transitions)
        for i, ids in enumerate(parts):
            packed = zstandard.ZstdCompressor(level=1).compress(new[ids].astype(np.uint8).tobytes())
            yield rows.column("piece")[i].as_py(), bucket, *(rows.column(c)[i].as_py() for c in ("ids", "low", "high")), packed, None, None, None
        yield -1, bucket, None, None, None, None, None, np.bincount(new[seen], minlength=classes).tolist(), None

    rows = sent.where("bucket >= 0").drop("pairs")
    return C.written(X.by_bucket(rows, answer, _STATE), "classes")


def fit_score(docs: DataFrame, learn: Column, classes: int = CLASSES, rounds: int = ROUNDS, piece: int = PIECE, bucket: int = BUCKET) -> Scored:
    """Learns from the rows of ``docs`` (doc_id, text) for which ``learn`` holds and scores all of them.

    Texts are words and one end each; null texts are empty: an end alone. A null ``learn`` counts as false. Repeated
    rows count and are scored each; other columns are left out. With nothing to learn from, every probability is 1. All rounds
    end in tables in the shared folder. A text is the largest unit a task holds.
    """
    if not 3 <= classes <= 255 or rounds < 1:
        raise ValueError("3 to 255 classes, and one round at least")
    spark = docs.sparkSession
    C.prepare(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    high = X.power_of_two(size / bucket)
    table = C.written(pieces(docs, learn, high, piece), "pieces")
    taught = _ends(table)
    state = C.written(X.by_bucket(_words_sent(table), _added_up(classes), _STATE), "counts")
    info = state.where("piece = -1")
    total, kinds = info.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum(F.element_at("types", 1)), F.lit(0))).first()
    first: dict[int, dict[int, int]] = {}
    top = info.select("bucket", F.explode("top").alias("t")).orderBy(F.desc("t.times"), "t.word").limit(classes - 2).collect()
    for c, r in enumerate(top, 1):
        first.setdefault(r["bucket"], {})[r["t"]["id"]] = c
    n, v = int(total) + taught, int(kinds) + (taught > 0)

    for k in range(rounds):
        sent = _contexts_sent(table, state.where("piece >= 0"), classes, first if k == 0 else None)
        state = _exchanged(sent, _summed(sent, classes))
    types = np.zeros(classes)
    for r in state.where("piece = -1").select(F.posexplode("types").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect():
        types[r["c"]] = r["n"]
    types[END] = float(taught > 0)
    state = state.where("piece >= 0")

    key = docs.schema["doc_id"].dataType.simpleString()
    pairs = C.written(
        X.by_piece(
            table.select("piece", "doc_ids", "learned", "lengths", "ids"), state, lambda own, answers: _per_text(own, answers, classes, n, v, taught),
            f"doc_id {key}, learned boolean, n_tokens long, n_known long, base_score double, emitted double, pairs binary, times binary",
        ),
        "pairs",
    )
    transitions = _learned(pairs, classes)
    scores = _scores(pairs, _logarithms(transitions, types, n, v), n, key)

    def named(own, answers):
        words, at = _split(own["words"]), 0
        for a in answers:
            for c, k in zip(_wide(a["low"], a["high"]).tolist(), _bytes(a["classes"]).tolist(), strict=True):
                if c:
                    yield words[at].decode(), c, k
                at += 1

    words = X.by_piece(table.select("piece", "words"), state, named, "word string, count long, class int").distinct()
    return Scored(scores, words, transitions, n, v)


def _ends(table: DataFrame) -> int:
    """How many texts are learned from: each has an end."""

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(sum(x) for x in b.column(0).to_pylist())], pa.int64())], names=["n"])

    return int(table.select("learned").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0)


def _per_text(own: dict, answers: list[dict], classes: int, n: int, v: int, taught: int) -> pa.Table:
    """Per text its known tokens, the base score, and its transitions between classes; ``classes**2 + c``: unknown words after class c."""
    p = _Piece(own, answers, classes)
    counts = np.concatenate([np.zeros(0, np.int64), *[_wide(a["low"], a["high"]) for a in answers]])
    of_token = np.full(len(p.is_word), taught, np.int64)
    of_token[p.is_word] = counts[p.ids]
    known = of_token > 0
    place = np.maximum.accumulate(np.where(known, np.arange(len(known)), -1))
    last = np.append(-1, place[:-1])
    before = np.where(last >= 0, p.of_token[last], END)
    pair = np.where(known, before * classes + p.of_token, classes * classes + before)
    begins = p.ends - p.lengths
    logs = np.log10(of_token + 1.0)
    text = np.repeat(np.arange(len(begins)), p.lengths + 1)
    keys, times = np.unique(text * (classes * classes + classes) + pair, return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(begins) + 1) * (classes * classes + classes)).tolist()
    keys, times = (keys % (classes * classes + classes)).astype("<u2"), times.astype("<u4")
    sums = lambda x: np.add.reduceat(x, begins)
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    columns = [
        own["doc_ids"], p.learned, p.lengths + 1, sums(known.astype(np.int64)), sums(logs - np.log10(n + v + 1.0)), sums(np.where(known, logs, 0.0)),
        [keys[s:e].tobytes() for s, e in spans], [times[s:e].tobytes() for s, e in spans],
    ]
    types = [None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
    names = ["doc_id", "learned", "n_tokens", "n_known", "base_score", "emitted", "pairs", "times"]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _learned(pairs: DataFrame, classes: int) -> np.ndarray:
    def count(batches):
        found = np.zeros(classes * classes + classes, np.int64)
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[np.frombuffer(k, "<u2")] += np.frombuffer(t, "<u4")
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], names=["pair", "times"])

    summed = pairs.where("learned").select("pairs", "times").mapInArrow(count, "pair int, times long").groupBy("pair").agg(F.sum("times").alias("times"))
    out = np.zeros(classes * classes)
    for r in summed.collect():  # at most classes * classes rows
        out[r["pair"]] = r["times"]
    return out.reshape(classes, classes)


def _logarithms(transitions: np.ndarray, types: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 of what each pair adds to a text's score besides the count of its word."""
    classes = len(transitions)
    room = transitions.sum(0) + types + 1.0  # N_c + V_c + 1
    alone = room / room.sum()
    follows = (transitions + WEIGHT * alone[None, :]) / (transitions.sum(1, keepdims=True) + WEIGHT)
    known = np.log10(follows / room[None, :])
    unknown = np.log10((follows / room[None, :]).sum(1))
    return np.concatenate([known.ravel(), unknown]) if n else np.zeros(classes * classes + classes)


def _scores(pairs: DataFrame, logs: np.ndarray, n: int, key: str) -> DataFrame:
    def score(batches):
        for b in batches:
            *kept, emitted, k, t = b.columns
            own = [np.frombuffer(x, "<u4").astype(float) @ logs[np.frombuffer(p, "<u2")] for p, x in zip(k.to_pylist(), t.to_pylist(), strict=True)]
            total = np.asarray(emitted) + np.array(own, float)
            yield pa.RecordBatch.from_arrays([*kept[:4], pa.array(np.full(len(total), n), pa.int64()), kept[4], pa.array(total)], names=names)

    names = ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return pairs.mapInArrow(score, f"doc_id {key}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
