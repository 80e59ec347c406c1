"""Language identification by words first, then by progressively shorter character n-grams.

A known word scores by its log frequency in each language. An unseen word is
looked up by its longest n-grams of which any is known, down to single letters.
The model is fitted on a bounded sample of labelled texts, drawn by hash from all
of them, and has a bounded number of words and n-grams, so it is small enough to
go to every task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

UNKNOWN = "und"
#: Expected texts per language that the model is fitted on; words, and n-grams of each length, that it keeps.
SAMPLE_TEXTS, WORDS, GRAMS, LONGEST = 4_000, 40_000, 15_000, 5
#: Pseudo count of what was not seen; words that count at most towards the certainty of a text.
SMOOTHING, CERTAIN_WORDS = 0.5, 40
_WORDS = re.compile(r"[^\W\d_]+").findall
_KEPT_WORDS = 150_000


@dataclass(frozen=True)
class Model:
    """Per language log frequencies of words and n-grams."""

    languages: tuple[str, ...]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters; runs of other number signs do not count."""
    return [w for w in _WORDS(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def grams_of(word: str, n: int) -> list[str]:
    """n-grams with the word's ends marked; single letters without them."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE_TEXTS) -> Model:
    """The model from rows of ``docs`` (doc_id, text, lang) for which ``learn`` holds and lang is not null.

    Texts are sampled by hash so that about ``sample`` remain of each language.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    known = docs.where(learn & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    drawn = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    counts = ", ".join(f"l{i} long" for i in range(len(languages)))
    by_language = [F.sum(f"l{i}").alias(f"l{i}") for i in range(len(languages))]
    word_schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("count", pa.int64())])
    gram_schema = pa.schema([("n", pa.int32()), ("term", pa.string()), *[(f"l{i}", pa.int64()) for i in range(len(languages))]])

    def count(batches):
        for b in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            found: dict[str, Counter] = {}
            for text, lang in zip(C.texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, k) for lang, words in found.items() for w, k in words.items()]
            if rows:
                yield C.batch(word_schema, *zip(*rows, strict=True))

    def divide(batches):
        for b in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            found: dict[tuple, list] = {}
            for word, *own in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for n in range(1, LONGEST + 1):
                    for g in grams_of(word, n):
                        if (held := found.get((n, g))) is None:
                            found[n, g] = own[:]
                        else:
                            held[:] = map(add, held, own)
            if found:
                yield C.batch(gram_schema, *zip(*[(n, g, *own) for (n, g), own in found.items()], strict=True))

    # n-grams are counted from the summed words: each distinct word is divided once.
    said = drawn.select("text", "lang").mapInArrow(count, "lang string, term string, count long")
    columns = [F.when(F.col("lang") == x, F.col("count")).otherwise(0).alias(f"l{i}") for i, x in enumerate(languages)]
    words = C.written(said.select("term", *columns).groupBy("term").agg(*by_language), "words")
    grams = words.mapInArrow(divide, f"n int, term string, {counts}").groupBy("n", "term").agg(*by_language)
    every = words.select(F.lit(0).alias("n"), *words.columns).unionByName(grams)
    table = C.written(every.withColumn("count", sum((F.col(f"l{i}") for i in range(len(languages))), F.lit(0))).where("count > 1"), "terms")
    kept = [table.where(F.col("n") == n).orderBy(F.desc("count"), "term").limit(WORDS if n == 0 else GRAMS) for n in range(LONGEST + 1)]
    totals = {r["n"]: np.array([r[f"l{i}"] for i in range(len(languages))], float) for r in table.groupBy("n").agg(*by_language).collect()}

    def scores(n: int) -> tuple[list[str], np.ndarray]:
        rows = kept[n].collect()  # bounded by WORDS or GRAMS
        counts = np.array([[r[f"l{i}"] for i in range(len(languages))] for r in rows], float).reshape(len(rows), len(languages))
        return [r["term"] for r in rows], np.log((counts + SMOOTHING) / (totals.get(n, np.zeros(len(languages))) + SMOOTHING * (len(rows) + 1)))

    vocabulary, word_scores = scores(0)
    found = [scores(n) for n in range(1, LONGEST + 1)]
    known_grams = [g for names, _ in found for g in names]
    return Model(languages, {w: i for i, w in enumerate(vocabulary)}, word_scores, {g: i for i, g in enumerate(known_grams)}, np.concatenate([s for _, s in found]))


def scorer(model: Model) -> Callable[[str], tuple[str, float]]:
    """A function from a text to its language and the certainty (0 to 1)."""
    base, known = len(model.words), model.grams.get
    # A row more, of zeros, for words of which not even a letter is known.
    gram_scores = np.concatenate([model.gram_scores, np.zeros((1, len(model.languages)))])
    memory = np.empty((base + _KEPT_WORDS, len(model.languages)))
    memory[:base] = model.word_scores
    places = dict(model.words)

    def backed_off(word: str) -> list[int]:
        """Places of the longest n-grams of which any is known."""
        marked = f"^{word}$"
        for n in range(min(LONGEST, len(marked)), 1, -1):
            if found := [g for i in range(len(marked) - n + 1) if (g := known(marked[i : i + n])) is not None]:
                return found
        return [g for c in word if (g := known(c)) is not None] or [len(gram_scores) - 1]

    def unseen(words: list[str]) -> np.ndarray:
        found = [backed_off(w) for w in words]
        sizes = np.array([len(x) for x in found])
        rows = gram_scores[[g for x in found for g in x]]
        return np.add.reduceat(rows, np.cumsum(sizes) - sizes) / sizes[:, None]

    def total(words: list[str]) -> np.ndarray:
        nonlocal places
        try:
            return memory[list(map(places.__getitem__, words))].sum(axis=0)
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in places]
        if len(places) + len(new) > len(memory):
            places = dict(model.words)
            new = [w for w in dict.fromkeys(words) if w not in places]
        memory[len(places) : len(places) + len(new)] = unseen(new)
        places.update(zip(new, range(len(places), len(places) + len(new)), strict=True))
        return memory[list(map(places.__getitem__, words))].sum(axis=0)

    def score(text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not model.languages:
            return UNKNOWN, 0.0
        # A part has at most as many new words as are remembered.
        found = sum(total(words[at : at + _KEPT_WORDS]) for at in range(0, len(words), _KEPT_WORDS))
        return _certainty(model.languages, found / len(words), len(words))

    return score


def _certainty(languages: tuple[str, ...], mean: np.ndarray, words: int) -> tuple[str, float]:
    odds = np.exp((mean - mean.max()) * min(words, CERTAIN_WORDS))
    best = int(np.argmax(odds))
    return languages[best], float(odds[best] / odds.sum())


def identify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added; the prediction reads the text alone.

    Texts that are null or have no letters, and all texts if the model has learned
    no language, get ``und`` and 0. Columns of these names are replaced.
    """
    C.prepare(docs.sparkSession)

    def run(column: pd.Series) -> pd.DataFrame:
        if "scorer" not in held:
            held["scorer"] = scorer(model)
        return pd.DataFrame([held["scorer"](t or "") for t in column], columns=["lang_pred", "score"])

    held: dict = {}
    predict = F.pandas_udf(run, "lang_pred string, score double")
    out = docs.drop("lang_pred", "score").withColumn("_said", predict(F.col(text_column)))
    return out.withColumns({"lang_pred": F.col("_said.lang_pred"), "score": F.col("_said.score")}).drop("_said")

