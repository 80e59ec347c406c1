"""places of checker matches with and without characters of two UTF-16 units; only the former read the text for each match."""

from __future__ import annotations

from palimpsest.operators import editorial as E


def test_places_of_matches(spark):
    paras = spark.createDataFrame([(1, 1, "O taser caiu aqui."), (1, 2, "𝔄 taser caiu 𝔄."), (1, 3, "Um tas…"), (1, 4, "um tasando…")], "doc_id long, paragraph int, text string")
    schema = "doc_id long, paragraph int, offset int, length int, rule_id string, issue_type string, category_id string, replacements array<string>, message string"
    rows = [(1, p, at, n, rule, "misspelling", "TYPOS", [], "") for p, at, n, rule in [
        (1, 2, 5, "M"), (1, 13, 99, "M"), (1, -1, 2, "M"), (2, 3, 5, "M"), (2, 0, 2, "M"), (3, 3, 3, "M"), (4, 0, 2, "LP_PARONYMS"), (1, 0, 1, "LP_PARONYMS"), (1, None, 2, "M"),
    ]]
    none = spark.createDataFrame([], "doc_id long, name string")
    found = E.filter_checker_matches(
        spark.createDataFrame(rows, schema), paras, none, none, spark.createDataFrame([], "doc_id long, word string"), spark.createDataFrame([], "word string, flags int")
    )
    assert sorted((r.paragraph, r.start, r.end, r.excerpt) for r in found.collect()) == [
        (1, 0, 1, "O"), (1, 0, 1, "O"), (1, 2, 7, "taser"), (1, 13, 18, "aqui."), (2, 0, 1, "𝔄"), (2, 2, 7, "taser"),
    ]
    wide = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "encode(" in line]
    assert wide and all("CASE WHEN _wide" in line for line in wide)
