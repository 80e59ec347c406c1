"""Near-duplicate vectors where few of the drawn vectors stay apart, against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from palimpsest.llm import pivots


def tight(n: int, spread: float, seed: int = 3) -> np.ndarray:
    own = np.random.default_rng(seed)
    return own.normal(size=16) + own.normal(size=(n, 16)) * spread


TABLES = {
    "one vector": tight(1, 0.1),
    "one vector, repeated": np.repeat(tight(1, 0.1), 3, axis=0),
    "two near copies": tight(2, 0.01),
    "a tight group of several blocks": tight(1100, 0.19),
    "three directions": np.concatenate([tight(40, 0.19, seed) for seed in (3, 4, 5)]),
}


@pytest.mark.parametrize("name", TABLES)
def test_pivot_links_of_tight_tables(spark, name):
    x = TABLES[name]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    component = np.arange(len(x))
    for _ in range(len(x)):
        new = np.where(linked, component[None, :], len(x)).min(axis=1)
        if (np.minimum(new, component) == component).all():
            break
        component = np.minimum(new, component)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivots.links(df).collect()}
    assert found == {i: (int(n), int(c), i == c) for i, (n, c) in enumerate(zip(linked.sum(axis=1), component, strict=True))}
