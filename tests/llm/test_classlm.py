"""The class-based model against plain counting with the classes it found."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import classlm, queries

END = None


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.decode() for w in lowered.encode().split()] + [END]


def some_rows(seed=1, size=400):
    own = random.Random(seed)
    tongues = [[f"{p}{i}" for i in range(60)] for p in ("ka", "Lo", "mé")]
    rows = []
    for i in range(size):
        words = own.choice(tongues)
        rows.append((i, " ".join(own.choices(words, range(60, 0, -1), k=own.randint(0, 40)))))
    return [*rows, (size, None), (size + 1, " \t"), (size + 1, " \t"), (None, "ka1 Lo2"), (size + 2, "never seen words\x0bka1"), (size + 3, "ka1 " * 5000)]


def base(rows, learned):
    counts = Counter(t for (_, text), k in zip(rows, learned, strict=True) if k for t in tokens(text))
    n, v = counts.total(), len(counts)
    return counts, n, [sum(math.log10((counts[t] + 1) / (n + 1 * (v + 1))) for t in tokens(text)) for _, text in rows]


def check(found, rows, learned, classes):
    counts, n, expected = base(rows, learned)
    words = {r["word"]: (r["count"], r["class"]) for r in found.words.collect()}
    assert {w: c for w, (c, _) in words.items()} == {w: c for w, c in counts.items() if w is not END}
    of = {w: k for w, (_, k) in words.items()} | {END: 0}
    follows, types = np.zeros((classes, classes)), np.zeros(classes)
    for (_, text), k in zip(rows, learned, strict=True):
        before = 0
        for t in tokens(text) if k else ():
            follows[before, of[t]] += 1
            before = of[t]
    for t in counts:
        types[of[t]] += 1
    assert (follows == found.transitions).all() and (found.train_tokens, found.train_words) == (n, len(counts))
    room = follows.sum(0) + types + 1
    smooth = (follows + classlm.WEIGHT * room / room.sum()) / (follows.sum(1, keepdims=True) + classlm.WEIGHT)
    result = []
    for (doc_id, text), low in zip(rows, expected, strict=True):
        before, score = 0, 0.0
        for t in tokens(text):
            if counts[t]:
                score += math.log10(smooth[before, of[t]] * (counts[t] + 1) / room[of[t]])
                before = of[t]
            else:
                score += math.log10((smooth[before] / room).sum())
        result.append((doc_id, len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), n, low, score))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found.scores.collect()]
    assert len(got) == len(result)
    for a, b in zip(sorted(got, key=key), sorted(result, key=key), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)
    # The probabilities of all words and of an unknown one sum to one after any class.
    sums = [sum(smooth[c, of[t]] * (counts[t] + 1) / room[of[t]] for t in counts) + (smooth[c] / room).sum() for c in range(classes)]
    assert sums == pytest.approx([1.0] * classes)


@pytest.mark.parametrize("classes, rounds, piece, bucket", [(8, 2, 3000, 500), (32, 1, 1 << 20, 1 << 20), (3, 3, 700, 5000)])
def test_equal_to_plain_counting(spark, classes, rounds, piece, bucket):
    rows = some_rows(classes)
    learned = [i is None or i % 4 != 1 for i, _ in rows]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, word string, score double")
    found = classlm.fit_score(df, F.col("doc_id").isNull() | (F.col("doc_id") % 4 != 1), classes, rounds, piece, bucket)
    check(found, rows, learned, classes)


def test_classes_tell_the_tongues_apart(spark):
    rows = some_rows(2)[:400]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = classlm.fit_score(df, F.col("doc_id") % 4 != 1, 8)
    held = [r for r in found.scores.where("NOT learned").collect() if r["n_tokens"] > 10]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.2 * sum(r["n_tokens"] for r in held)
    by_class: dict = {}
    for r in found.words.collect():
        by_class.setdefault(r["class"], Counter())[r["word"][:2]] += r["count"]
    right = sum(max(c.values()) for c in by_class.values())
    assert right > 0.95 * sum(c.total() for c in by_class.values())


def test_a_move_raises_the_likelihood():
    own = np.random.default_rng(4)
    words = own.integers(0, 40, 6000)
    words[1::2] = (words[::2] // 10) * 10 + words[1::2] % 10  # pairs of one group
    of = own.integers(1, 6, 40)
    likelihood = lambda t: sum(x * math.log(x / (t[i].sum() * t[:, j].sum())) for (i, j), x in np.ndenumerate(t) if x)

    def state(of):
        text = of[words]
        t = np.zeros((6, 6))
        np.add.at(t, (np.append(0, text), np.append(text, 0)), 1)
        around = np.zeros((40, 12), int)
        np.add.at(around, (words, np.append(0, text[:-1])), 1)
        np.add.at(around, (words, 6 + np.append(text[1:], 0)), 1)
        return t, around

    before = likelihood(state(of)[0])
    for _ in range(4):
        t, around = state(of)
        of = classlm.moved(around, of, t)
    assert (of > 0).all() and likelihood(state(of)[0]) > before + 100
    unseen = classlm.moved(np.zeros((2, 12), int), np.array([3, 5]), t)
    assert unseen.tolist() == [3, 5]


def test_nothing_learned_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id int, text string")
    got = classlm.fit_score(df, F.lit(None).cast("boolean"), 4)
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got.scores.collect()} == {(1, 3, 0, 0, 0.0, 0.0), (None, 1, 0, 0, 0.0, 0.0)}
    assert got.words.count() == 0 and classlm.fit_score(df.where("false"), F.lit(True), 4).scores.count() == 0
    blank = classlm.fit_score(spark.createDataFrame([("k", None)], "doc_id string, text string"), F.lit(True), 4).scores.first()
    assert (blank["doc_id"], blank["n_tokens"], blank["n_known"], blank["train_tokens"]) == ("k", 1, 1, 1)


def test_query(spark, tmp_path):
    rows = some_rows(7)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_class_lm(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    assert {r["doc_id"] for r in got.where("held_out").collect()} == held
    _, n, expected = base(rows, [i not in held for i, _ in rows])
    assert sorted(r["base_score"] for r in got.collect()) == pytest.approx(sorted(expected)) and got.first()["train_tokens"] == n
