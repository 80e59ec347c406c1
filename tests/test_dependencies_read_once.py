"""dependencies come from findings that are computed once, and read no sentences."""

from __future__ import annotations

import registry
from palimpsest.operators import relations as R
from registry import findings as G
from registry import verdicts as Q


def test_findings_once_and_equal(spark, tmp_path, monkeypatch):
    sf = str(tmp_path)
    text = "era assim que que foi!! e vez vez. a casa casa ?? sim sim! que  que a.\nnão não foi foi!! e e nada nada ## aqui"
    spark.createDataFrame([(d, text[d:], "pt", "s", 9) for d in range(8)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(d, 0, d % 2) for d in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    calls = []
    own = G.own_findings
    count = lambda *a, **k: calls.append(1) or own(*a, **k)
    monkeypatch.setattr(G, "own_findings", count)
    monkeypatch.setattr(Q, "own_findings", count)
    read = []
    monkeypatch.setattr(Q.R, "numbered", lambda *a, **k: read.append(1))
    found = sorted(map(tuple, registry.QUERIES["f17_dependencies"](spark, sf).collect()))
    assert len(calls) == 1 and not read
    rows = own(spark, sf).select("doc_id", "paragraph", "report_order", "finding_id", "start").orderBy("doc_id", "paragraph", "report_order").collect()
    decided = {r.doc_id for r in rows if r.doc_id < 6}
    pairs = {(a.doc_id, a.finding_id, b.finding_id) for a, b in zip(rows, rows[1:]) if (a.doc_id, a.paragraph) == (b.doc_id, b.paragraph) and a.start % 4 == 2 and a.doc_id in decided}
    assert pairs and {r[:3] for r in found} == pairs


def test_long_chains_in_few_rounds(spark, monkeypatch):
    """A chain of 200 with a cycle at its end, one without, a cycle of two, one of five with a tail, and a self-dependency."""
    edges = [(1, f"a{k:03}", f"a{k + 1:03}") for k in range(200)] + [(1, "a200", "a190")]
    edges += [(2, f"a{k:03}", f"a{k + 1:03}") for k in range(200)]
    edges += [(3, "x", "y"), (3, "y", "x"), (3, "z", "z"), *[(4, f"c{k}", f"c{(k + 1) % 5}") for k in range(5)], (4, "t", "c3")]
    rounds = []
    cut = R._cut_lineage
    monkeypatch.setattr(R, "_cut_lineage", lambda df: rounds.append(1) or cut(df))
    found = {tuple(r) for r in R.dependency_cycles(spark.createDataFrame(edges, "doc_id long, a string, b string")).collect()}
    assert found == {(1, f"a{k}") for k in range(190, 201)} | {(3, "x"), (3, "y")} | {(4, f"c{k}") for k in range(5)}
    assert len(rounds) <= 10
