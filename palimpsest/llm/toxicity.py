"""Toxicity by weak supervision.

Voters are lexicon words and stem patterns (word beginnings) that stand out in
texts labelled toxic. A generative label model estimates from the votes on all
texts how accurate each voter is and which of them move together, anchored by the
labels that may be learned from; a linear classifier is then trained on the
posterior labels of a bounded sample, and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Lengths of the word beginnings that may become patterns; 0 stands for the whole word.
STEMS = (0, 5, 6, 7)
#: A term votes if it stands in this share of the toxic texts, and both its rate and its share of texts are so many times those of the others.
LEAST_SHARE, LEAST_LIFT, LEAST_TEXTS = 0.02, 5.0, 5
#: Voters that are kept, terms that are counted in clean texts, texts that the classifier is fitted on.
VOTERS, CANDIDATES, SAMPLE_TEXTS = 20, 20_000, 20_000
#: Labelled documents that the voters and the label model learn from: drawn by hash, about so many at most.
LABELS = 200_000
#: A pattern votes toxic from this many hits and this rate on; a lone hit is enough at the other rate.
PATTERN_HITS, PATTERN_RATE, LONE_RATE = 2, 0.006, 0.04
_WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class Model:
    terms: tuple[tuple[str, int], ...]  # text and stem length of each voter
    accuracies: np.ndarray  # two columns: chance to vote if toxic, if clean
    correlations: np.ndarray
    weights: np.ndarray  # of the classifier, the intercept last


def stems(word: str) -> list[tuple[str, int]]:
    return [(word if n == 0 else word[:n], n) for n in STEMS if n == 0 or len(word) > n]


def _hits(text: str, places: dict, sizes: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """Hits of each voter in a text, and its words."""
    words = _WORDS(text.lower())
    hits = np.zeros(len(places), np.int64)
    for n in sizes:
        for stem, k in Counter(w if n == 0 else w[:n] for w in words if n == 0 or len(w) > n).items():
            if (stem, n) in places:
                hits[places[stem, n]] += k
    return hits, len(words)


def _votes(hits: np.ndarray, words: int, pattern: np.ndarray) -> np.ndarray:
    """1 where a voter says toxic, -1 where it abstains; last the voter that says clean (0) where no term occurs."""
    rate = hits / max(words, 1)
    enough = np.where(pattern, (rate >= PATTERN_RATE) & ((hits >= PATTERN_HITS) | (rate >= LONE_RATE)), hits > 0)
    return np.append(np.where(enough, 1, -1), -1 if hits.any() else 0)


def _features(hits: np.ndarray, words: int, pattern: np.ndarray) -> np.ndarray:
    """Per voter its vote, and its saturated rate."""
    votes = _votes(hits, words, pattern)[:-1]
    return np.concatenate([(votes == 1).astype(float), np.minimum(1.0, hits / max(words, 1) / PATTERN_RATE / 4)])


def find_terms(labelled: DataFrame) -> list[tuple[str, int]]:
    """Voters from rows (text, toxic): first the terms of toxic texts, then their counts in the others."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int32()), ("texts", pa.int64()), ("hits", pa.int64())])
    shape = "term string, n int, texts long, hits long"

    def counter(allowed: set | None):
        def run(batches):
            for b in batches:
                texts, hits = Counter(), Counter()
                for text in C.texts(b.column(0)):
                    own = Counter(s for w in _WORDS(text.lower()) for s in stems(w))
                    own = own if allowed is None else {s: k for s, k in own.items() if s in allowed}
                    texts.update(own.keys())
                    hits.update(own)
                if hits:
                    yield C.batch(schema, *zip(*[(t, n, texts[t, n], k) for (t, n), k in hits.items()], strict=True))

        return run

    def summed(df: DataFrame, allowed: set | None) -> DataFrame:
        return df.select("text").mapInArrow(counter(allowed), shape).groupBy("term", "n").agg(F.sum("texts").alias("texts"), F.sum("hits").alias("hits"))

    toxic, clean = labelled.where("toxic = 1"), labelled.where("toxic = 0")
    size = labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    n, chars = {r["toxic"]: r["n"] for r in size}, {r["toxic"]: r["chars"] or 1 for r in size}
    if not n.get(1) or not n.get(0):
        return []
    least = max(LEAST_TEXTS, LEAST_SHARE * n[1])
    seen = summed(toxic, None).where(F.col("texts") >= least).orderBy(F.desc("texts"), "term", "n").limit(CANDIDATES).collect()
    found = {(r["term"], r["n"]): r for r in seen}
    other = {(r["term"], r["n"]): r for r in summed(clean, set(found)).collect()}  # bounded by CANDIDATES
    ranked = []
    for key, r in found.items():
        c = other.get(key)
        lift = (r["hits"] / chars[1]) / (((c["hits"] if c else 0) + 0.5) / chars[0])
        spread = (r["texts"] / n[1]) / (((c["texts"] if c else 0) + 0.5) / n[0])
        if min(lift, spread) >= LEAST_LIFT:
            ranked.append((r["texts"] / n[1] * np.log(min(lift, spread)), key))
    # Of terms that begin alike the one that says most stands for all, and a whole word for its beginnings if it says nearly as much.
    best = dict((key, value) for value, key in ranked)
    chosen: list[tuple[str, int]] = []
    for value, (term, k) in sorted(ranked, key=lambda x: (-x[0], x[1])):
        if len(chosen) == VOTERS or any(term.startswith(t) or t.startswith(term) for t, _ in chosen):
            continue
        whole = max((w for w in best if w[1] == 0 and w[0].startswith(term) and best[w] >= 0.9 * value), key=lambda w: (best[w], w), default=None)
        chosen.append(whole or (term, k))
    return chosen


def label_model(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Accuracies, correlations and posteriors of distinct vote patterns, by expectation maximisation.

    ``counts`` are the texts of each pattern, and ``known`` (two columns) those of them
    that are labelled clean and toxic: these keep their labels, and the others get
    those that the votes speak for. A voter that abstains says nothing. The strongest
    voice counts whole; a further one counts for less the more its voter moves with
    others beyond what the classes explain.
    """
    spoke = np.concatenate([patterns[:, :-1] == 1, patterns[:, -1:] == 0], axis=1)
    free = np.maximum(counts - known.sum(axis=1), 0)
    post = np.where(spoke[:, -1], prior / 4, 0.5)
    weight, corr = np.ones(spoke.shape[1]), np.eye(spoke.shape[1])
    rates = np.zeros((spoke.shape[1], 2))
    for k in range(rounds):
        mass = np.stack([free * post + known[:, 1], free * (1 - post) + known[:, 0]])
        rates = ((mass @ spoke + 0.5) / (mass.sum(axis=1, keepdims=True) + 1)).T
        share = float(np.clip(mass[0].sum() / max(mass.sum(), 1), 1e-4, 0.5))
        if k == rounds // 2:
            corr = _residual(spoke, mass, rates)
            weight = 1 / (1 + np.maximum(corr - np.eye(len(corr)), 0).sum(axis=0))
        said = spoke * np.log(rates[:, 0] / rates[:, 1])
        first = np.abs(said).argmax(axis=1)[:, None]
        odds = np.log(share / (1 - share)) + said @ weight + (np.take_along_axis(said, first, 1) * (1 - weight[first]))[:, 0]
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return rates, corr, post


def _residual(spoke: np.ndarray, mass: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Correlation of the votes that is left within the classes."""
    cov = np.zeros((spoke.shape[1],) * 2)
    for side in (0, 1):
        off = spoke - rates[:, side]
        cov += (off * mass[side][:, None]).T @ off
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    return cov / np.outer(scale, scale)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE_TEXTS) -> Model:
    """The model from all texts of ``docs`` (doc_id, text) and the labels (doc_id, toxic) of documents for which ``learn`` holds.

    Contradicting labels of a document count as toxic. Without labels of both
    kinds there are no voters and every text scores the same, below 0.5. At most about
    ``LABELS`` labelled documents are learned from; their ids go to the texts, no text to its label.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = C.written(marks, "labels")
    share = min(1.0, LABELS / max(1, marks.count()))
    drawn = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    labelled = C.written(docs.where(learn).select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic"), "labelled")
    terms = find_terms(labelled)
    if not terms:
        return Model((), np.zeros((0, 2)), np.zeros((0, 0)), np.array([-3.0]))
    places, pattern, sizes = _places(terms)
    prior = labelled.agg(F.avg("toxic")).first()[0]
    schema = pa.schema([("votes", pa.binary()), ("count", pa.int64()), ("clean", pa.int64()), ("toxic", pa.int64())])

    def vote(batches):
        for b in batches:
            found: dict[bytes, list] = {}
            for text, label in zip(C.texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                own = found.setdefault(_votes(*_hits(text, places, sizes), pattern).astype(np.int8).tobytes(), [0, 0, 0])
                if label is None:
                    own[0] += 1
                else:
                    own[1 + label] += 1
            yield C.batch(schema, list(found), *zip(*found.values(), strict=True))

    # Votes of every text, and again of the labelled ones with their labels; what comes here are the counts of
    # all vote patterns, of which there are at most 2 ** VOTERS + 1 whatever the input.
    every = docs.select("text", F.lit(None).cast("int").alias("toxic")).unionByName(labelled.select("text", F.col("toxic").cast("int").alias("toxic")))
    counted = every.mapInArrow(vote, "votes binary, count long, clean long, toxic long").groupBy("votes").agg(*[F.sum(c).alias(c) for c in ("count", "clean", "toxic")])
    rows = counted.orderBy("votes").toArrow()
    votes = np.array([np.frombuffer(v.as_buffer(), np.int8) for v in rows.column("votes")], np.int8)
    counts, *known = (rows.column(c).to_numpy().astype(float) for c in ("count", "clean", "toxic"))
    rates, corr, post = label_model(votes, counts, np.stack(known, axis=1), prior)
    posterior = dict(zip(map(bytes, votes), post, strict=True))

    def features(batches):
        for b in batches:
            out = []
            for t in C.texts(b.column(0)):
                hits, words = _hits(t, places, sizes)
                out.append((_features(hits, words, pattern).astype("<f4").tobytes(), _votes(hits, words, pattern).astype(np.int8).tobytes()))
            yield C.batch(shape, *zip(*out, strict=True))

    shape = pa.schema([("x", pa.binary()), ("votes", pa.binary())])
    total = counts.sum()
    # The sample for the classifier: texts by hash, and as many of those with a vote.
    drawn = docs.select("text", F.pmod(F.xxhash64("text"), F.lit(1 << 20)).alias("h")).where(F.col("h") < min(1.0, sample / max(total, 1)) * (1 << 20))
    found = drawn.select("text").mapInArrow(features, "x binary, votes binary").collect()
    toxic = labelled.where("toxic = 1")
    share = min(1.0, sample / 8 / max(1, toxic.count()))
    marked = toxic.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select("text")
    found += marked.mapInArrow(features, "x binary, votes binary").collect()
    x = np.array([np.frombuffer(r["x"], "<f4") for r in found], float)
    y = np.array([posterior[bytes(r["votes"])] for r in found])
    return Model(tuple(terms), rates, corr, _logistic(x, y))


def _places(terms) -> tuple[dict, np.ndarray, tuple[int, ...]]:
    return {t: i for i, t in enumerate(terms)}, np.array([n > 0 for _, n in terms]), tuple(sorted({n for _, n in terms}))


def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-4, rounds: int = 60) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) * decay * max(1, len(x))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on); the text alone decides. Null and empty texts score as texts without hits."""
    C.prepare(docs.sparkSession)
    places, pattern, sizes = _places(model.terms)
    weights = model.weights

    def run(column: pd.Series) -> pd.Series:
        x = np.array([_features(*_hits(t or "", places, sizes), pattern) for t in column]).reshape(len(column), 2 * len(places))
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))

    out = docs.drop("score", "predicted").withColumn("score", F.pandas_udf(run, "double")(F.col(text_column)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
