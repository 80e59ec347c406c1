"""Jaccard links of large groups of different near copies, against brute force."""

from __future__ import annotations

import random

import numpy as np

from palimpsest.llm import jaccard


def test_jaccard_counts_every_link_of_a_large_group(spark):
    # Texts that each differ from a common one in some words, so that pairs stand on both sides of the threshold.
    own = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in own.sample(range(300), own.randint(1, 5)):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words[: own.randint(297, 300)])))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    names = {g: k for k, g in enumerate({g for s in sets for g in s})}
    x = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        x[i, [names[g] for g in s]] = 1
    common, size = x @ x.T, x.sum(axis=1)
    linked = 9 * common >= 4 * (size[:, None] + size[None, :])
    np.fill_diagonal(linked, False)
    # One run finds a part of the pairs, enough to connect the group: the recount has to find the others.
    found = {r["doc_id"]: r["n_links"] for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.3).collect()}
    assert 0.1 * linked.size < linked.sum() < 0.95 * linked.size
    assert found == dict(enumerate(linked.sum(axis=1).tolist()))


def test_jaccard_pairs_that_meet_in_large_buckets_only(spark, monkeypatch):
    # With buckets of more than three sets split, every pair here depends on the deeper levels and the further runs.
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", 3)
    assert jaccard.runs_for(jaccard.RECALL) > jaccard.runs_for(jaccard.RECALL, 1)
    own, rows = random.Random(5), []
    passage = [f"p{i}" for i in range(60)]
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(90)]
        for i in range(5 if group else 30):
            words = list(base)
            words[own.randrange(90)] = f"g{group}x{i}"
            rows.append((len(rows), " ".join(passage + words[: own.randint(84, 90)])))
    # Pairs that share the passage and little else stay below the threshold.
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for _, t in rows]
    links = [[j for j, b in enumerate(sets) if j != i and 5 * len(a & b) >= 4 * len(a | b)] for i, a in enumerate(sets)]
    found = {r["doc_id"]: r for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["n_links"] for i, r in found.items()} == {i: len(x) for i, x in enumerate(links)}
    reach = list(range(len(rows)))
    while (new := [min([reach[i], *(reach[j] for j in x)]) for i, x in enumerate(links)]) != reach:
        reach = new
    assert [found[i]["component_id"] for i in range(len(rows))] == reach
