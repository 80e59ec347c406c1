"""states of decided findings come from excerpts, and texts meet them only where they lie."""

from __future__ import annotations

import registry
from palimpsest.operators import verdicts as V

from .test_decisions import answer

ITEM = "doc_id long, finding_id string, decision string, paragraph int, text string, start int, end int, context array<string>, answer string"


def test_equal_to_items_with_their_text(spark):
    text = "era uma vez e era assim, era"
    given = [{}, {"ocorrencia": 1}, {"evidencia": "ausente"}, {"evidencia": "⟦vez⟧"}, {"existe": "sim", "razao_literaria": "identificada", "evidencia_razao": "vez e"}]
    rows = [(d, f"{d}{k}{a}", "Erro confirmado" if k % 2 else "Intencional", 1, text, a, a + 3, [text], answer(**g)) for d in (1, 2) for a in (0, 14, 25, 8) for k, g in enumerate(given)]
    items = spark.createDataFrame(rows, ITEM)
    columns = "doc_id finding_id state adequacy motive priority covers which total reason".split()
    wanted = V.derive_state(V.parse_answers(items)).select(*columns)
    light = items.selectExpr("doc_id", "finding_id", "decision", "paragraph", "start", "end", "substring(text, start + 1, end - start) AS excerpt", "answer")
    texts = items.select("doc_id", "paragraph", "text").distinct()
    found = V.derive_state(V.parse_answers(light), texts).select(*columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())) and found.count() == len(rows)


def test_query_runs(spark, tmp_path):
    spark.createDataFrame([(1, "era assim que  que foi!! e a. a vez", "pt", "s", 36), (2, "nada!!", "pt", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = registry.QUERIES["g04_derive_state"](spark, str(tmp_path)).collect()
    assert found and {r.doc_id for r in found} == {1} and all(r.which <= r.total for r in found)
