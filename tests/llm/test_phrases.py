"""Collocations against counts of word tuples."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from palimpsest.llm import exchange, phrases, queries


def brute(rows, longest=3, least=10, absorbed=50, top=2000):
    found, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for part in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", part)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                found[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, f in found.items():
        kept = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if not any(len(q) > len(p) and 100 * b >= absorbed * a and inside(q) for q, b in candidates.items()):
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def some_rows(seed: int, size: int = 250):
    own = random.Random(seed)
    words = ["The", "old", "mill", "né", "by", "a", "streamlet", "XY", "über", "|", "x\x1cy", "a b", "ab", "aba"]
    gaps = [" "] * 12 + ["  ", "\t", ". ", ",", " \n", "\x0b", " - "]
    text = lambda: "".join(own.choice(words) + own.choice(gaps) for _ in range(own.randint(0, 60)))
    rows = [(text(), own.choice(["en", "fr", None, "und"])) for _ in range(size)]
    return [*rows, (None, "en"), ("", None), (". , ;\n", "en"), rows[0], rows[0], ("same words " * 700, "fr"), ("once", "xx")]


def answer(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"bits": 16, "piece": 300}, {"bits": 3}, {"longest": 4, "least": 5, "absorbed": 80, "piece": 2000, "top": 7}])
def test_equal_to_brute_force(spark, options):
    rows = some_rows(len(options))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, n int")
    asked = {k: v for k, v in options.items() if k not in ("bits", "piece")}
    expected = brute(rows, **asked)
    assert answer(phrases.collocations(df, **options)) == expected and len(expected) > 20


def test_collisions_are_told_apart():
    body = phrases.folded("aa bb aa bb. cc, aa bb " + "long" * 9 + "x " + "long" * 9 + "y")
    for bits in (1, 2, 60):
        grams = phrases.Grams(body, 2, bits)
        rows, times, n = grams.counted()
        found = dict(zip(grams.texts(rows).to_pylist(), zip(times.tolist(), n.tolist()), strict=True))
        assert found == {"aa": (3, 1), "bb": (3, 1), "cc": (1, 1), "long" * 9 + "x": (1, 1), "long" * 9 + "y": (1, 1), "aa bb": (3, 2), "bb aa": (1, 2), "bb " + "long" * 9 + "x": (1, 2), "long" * 9 + "x " + "long" * 9 + "y": (1, 2)}


def test_empty_table_and_no_words(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, "a"), (" .", None)], "text string, lang string")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**14 + 7, 10**14 + 9, 10**14 + 8)], "a long, l long, r long")
    exact = "(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"
    assert df.selectExpr(exact).first()[0] == 10**6 * (10**14 + 7) ** 2 // ((10**14 + 9) * (10**14 + 8))


def test_packed_arrays():
    import numpy as np

    a, b = np.array([0, 3, 70_000, 2**32 - 1]), np.array([1, 2**31, 0, 5])
    assert [x.tolist() for x in exchange.unpack(exchange.pack(a, b), 2)] == [a.tolist(), b.tolist()]
    assert [x.tolist() for x in exchange.unpack_rising(exchange.pack_rising(a, b), 2)] == [a.tolist(), b.tolist()]
    assert exchange.unpack(exchange.pack(a[:0]))[0].tolist() == []


def test_query_reads_whole_table(spark, tmp_path):
    rows = some_rows(8)
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert answer(queries.op11_phrase_collocations(spark, str(tmp_path))) == brute(rows)
