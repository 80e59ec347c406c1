"""Periodic runs against a search over all starts and periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from palimpsest.llm import periodic, queries


def brute(words, shortest=6, repeats=4):
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        start = 0
        while start + q < n:
            if words[start] != words[start + q] or start and words[start - 1] == words[start - 1 + q]:
                start += 1
                continue
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            stretch = words[start : start + length]
            smaller = any(stretch[p:] == stretch[: length - p] for p in range(1, q))
            if length >= max(shortest, repeats * q) and not smaller:
                out.append((start, length, q))
            start += 1
    return sorted((s, length, q) for s, length, q in out)


def some_words(own: random.Random) -> list[int]:
    words: list[int] = []
    for _ in range(own.randint(0, 6)):
        part = [own.randint(0, 3) for _ in range(own.randint(1, 14))]
        words += (part * own.randint(1, 9))[: own.randint(1, 80)]
    return words


@pytest.mark.parametrize("shortest, repeats", [(6, 4), (1, 2), (20, 3)])
def test_runs_equal_brute_force(shortest, repeats):
    own = random.Random(shortest)
    for _ in range(250):
        words = some_words(own)
        assert periodic.runs_of(words, shortest, repeats) == brute(words, shortest, repeats), words


def test_words_may_come_in_any_steps():
    own = random.Random(5)
    for _ in range(150):
        words, catcher, at = some_words(own), periodic.Catcher(), 0
        while at < len(words):
            step = own.randint(1, 30)
            catcher.append(np.array(words[at : at + step]))
            at += step
            assert catcher.runs() == brute(words[:at])


def test_long_texts_and_long_periods():
    own = random.Random(9)
    part = [own.randint(0, 10**6) for _ in range(30_011)]
    words = [1, 2, 3, *part * 5, 7, *[4] * 50_000]
    assert periodic.runs_of(words) == [(3, 5 * len(part), len(part)), (4 + 5 * len(part), 50_000, 1)]


def test_strongest_and_collapsed():
    assert periodic.strongest([(0, 9, 2), (20, 18, 4)]) == (0, 9, 2) and periodic.strongest([]) is None
    words = list("abababababcddddddde")
    runs = periodic.runs_of(words)
    dropped = {x for s, length, q in runs for x in range(s + q, s + length)}
    assert periodic.collapsed(words, runs) == [w for i, w in enumerate(words) if i not in dropped] == list("abcde")


def test_rows_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "a b " * 6, 3), (1, "a b " * 6, 3), (2, None, 1), (None, " \t\r\n\x0b\x0c", 1), (3, "x y " * 7, 2), (4, "solo", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period long")
    found = {(r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) for r in periodic.find(docs).collect()}
    assert found == {(1, 1, 0, 12, 2, 6000), (2, 0, None, None, None, None), (None, 0, None, None, None, None), (3, 1, 0, 7, 1, 7000), (4, 0, None, None, None, None)}
    assert periodic.find(docs).count() == len(rows) and periodic.find(docs.where("false")).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    own = random.Random(3)
    texts = [" ".join(own.choice(["so", "it", "goes", "on"]) for _ in range(own.randint(0, 70))) for _ in range(120)]
    rows = list(enumerate([*texts, None, "", "a  b\tc"]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    planted = 0
    for doc_id, text in rows:
        words = (text or "").split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)], planted + 1
        runs = brute(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
        r = found[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert planted > 5
