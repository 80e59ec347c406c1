from __future__ import annotations

import json

import pytest

from palimpsest.operators import decisions as D
from palimpsest.operators import metrics as M
from palimpsest.operators import policy as P
from palimpsest.operators import relations as R
from palimpsest.operators import verdicts as V
from palimpsest.sources import config as C
from palimpsest.sources import reports as A


def test_settings_are_validated():
    assert C.validate_settings({"rules": {"estrutura": False}})["rules"]["residuo_edicao"] is False
    for bad in ({"x": 1}, {"word_distance": 41}, {"duplicate_similarity": 0.5}, {"tense_scopes": ["y"]}):
        with pytest.raises(C.SettingsError):
            C.validate_settings(bad)


def test_reports_source_and_sink(spark, tmp_path):
    finding = {"id": "a", "category": "c", "priority": "p", "paragraph": 1, "chapter": "", "text": "casa", "start": 0, "end": 2,
               "reason": "", "source": "s", "excerpt": "ca"}
    (tmp_path / "in").mkdir()
    good = {"schema_version": 1, "document": "d.docx", "sha256": "a" * 64, "findings": [finding]}
    bad = {**good, "sha256": "b" * 64, "findings": [{**finding, "end": 9}]}
    twice = {**good, "sha256": "c" * 64, "findings": [finding, finding]}
    for name, report in (("g", good), ("b", bad), ("t", twice)):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(report, indent=1))
    reports, findings, rejected = A.read_reports(spark, str(tmp_path / "in"))
    assert [r.sha256[0] for r in reports.collect()] == ["a"] and findings.count() == 1
    assert {(r.sha256[0], r.problem) for r in rejected.collect()} == {("b", "finding"), ("c", "duplicate_ids")}
    A.write_report(reports, str(tmp_path / "out"))
    with pytest.raises(Exception):
        A.write_report(reports, str(tmp_path / "out"))


def test_inheritance_needs_equal_counts(spark):
    schema = "doc_id long, finding_id string, content_key string, report_order long, decision string"
    old = spark.createDataFrame(
        [(1, "a", "k", 1, "Erro confirmado"), (1, "b", "k", 2, "Falso positivo"), (1, "c", "m", 3, "Intencional"), (1, "d", "z", 4, "Pendente")], schema
    )
    new = spark.createDataFrame(
        [(1, "n1", "k", 1), (1, "n2", "k", 2), (1, "n3", "m", 3), (1, "n4", "m", 4), (1, "c", "q", 5), (1, "n5", "z", 6)],
        "doc_id long, finding_id string, content_key string, report_order long",
    )
    got = {r.finding_id: r.decision for r in D.inherit_decisions(new, old).collect()}
    assert got == {"n1": "Erro confirmado", "n2": "Falso positivo", "n3": None, "n4": None, "c": "Intencional", "n5": None}


def test_absorbed_ids_fill_or_conflict(spark):
    old = spark.createDataFrame(
        [(1, "x", "k", 1, "Erro confirmado"), (1, "y", "m", 2, "Falso positivo")],
        "doc_id long, finding_id string, content_key string, report_order long, decision string",
    )
    rows = [(1, "n1", "p", 1, [("x", "s")]), (1, "n2", "q", 2, [("x", "s"), ("y", "t")])]
    new = spark.createDataFrame(rows, "doc_id long, finding_id string, content_key string, report_order long, absorbed array<struct<id:string,source:string>>")
    got = {r.finding_id: (r.decision, r.conflict) for r in D.inherit_decisions(new, old).collect()}
    assert got["n1"] == ("Erro confirmado", None)
    assert got["n2"] == (None, ["Erro confirmado — s", "Falso positivo — t"])


def test_latest_vote_wins(spark):
    schema = "doc_id long, book string, report_time long, finding_id string, rule string, category_code string, source string, confidence string, severity string, text string, start int, end int"
    rows = [(d, "b", d, f"f{d}", "r", None, "s", "alta", "probable_error", "casa", 0, 2) for d in (1, 2)]
    decided = spark.createDataFrame([(1, "f1", "Falso positivo"), (2, "f2", "Corrigido")], "doc_id long, finding_id string, decision string")
    row = M.precision_by_class(M.votes(spark.createDataFrame(rows, schema), decided)).first()
    assert (row["decisions"], row["erro"], row["falso_positivo"], row["precision"]) == (1, 1, 0, 1.0)


@pytest.mark.parametrize(
    "n,precision,confidence,expected", [(20, 0.95, "alta", ("pendencia", True)), (19, 0.95, "alta", ("pendencia", False)),
                                        (20, 0.4, "alta", ("informacao", False)), (5, 0.1, "baixa", ("informacao", False))]
)
def test_routes(spark, n, precision, confidence, expected):
    found = spark.createDataFrame([(1, "a", "crase", "s", confidence, "probable_error")], "doc_id long, finding_id string, rule string, source string, confidence string, severity string")
    measures = spark.createDataFrame([("crase", confidence, n, precision)], "class string, confidence string, decisions long, precision double")
    row = P.route(found, measures).first()
    assert (row["destination"], row["blocking"]) == expected


def answer(**kw):
    base = dict(id="a", ocorrencia=2, existe="nao", natureza="objetivo", certeza="clara", gravidade="alta", razao_literaria="nao_se_aplica",
                justificativa_detector="correta", evidencia_suficiente=True, evidencia="era", evidencia_razao="", explicacao="porque",
                recomendacao="", problema_trecho="", problema_explicacao="")
    return json.dumps({**base, **kw})


@pytest.mark.parametrize(
    "decision,given,expected",
    [
        ("Erro confirmado", {}, ("contestada", None)),
        ("Erro confirmado", {"ocorrencia": 1}, ("inconclusiva", "ocorrencia_divergente")),
        ("Erro confirmado", {"evidencia": "ausente"}, ("inconclusiva", "evidencia_inexistente")),
        ("Falso positivo", {"justificativa_detector": "incorreta"}, ("apontamento_inadequado", None)),
        ("Falso positivo", {"existe": "incerto"}, ("inconclusiva", None)),
        ("Intencional", {"existe": "sim", "razao_literaria": "nao_identificada"}, ("revisao_recomendada", "intencao_nao_determinada")),
    ],
)
def test_derived_state(spark, decision, given, expected):
    text = "era uma vez e era assim"
    rows = [(1, "a", decision, 1, text, 14, 17, [text], answer(**given))]
    items = spark.createDataFrame(rows, "doc_id long, finding_id string, decision string, paragraph int, text string, start int, end int, context array<string>, answer string")
    row = V.derive_state(V.parse_answers(items)).first()
    assert (row["state"], row["motive"]) == expected


def test_answer_contract(spark):
    rows = [(answer(),), (answer(existe="talvez"),), ("{}",), ("não é json",)]
    got = [r.refusal for r in V.parse_answers(spark.createDataFrame(rows, "answer string")).collect()]
    assert got == [None, "valor_fora_da_enumeracao", "campo_ausente", "nao_e_objeto"]


def test_components_and_cycles(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d"), (1, "e", "f")], "doc_id long, a string, b string")
    nodes = spark.createDataFrame([(1, n) for n in "abcdefg"], "doc_id long, node string")
    groups = {r.node: r.component for r in R.connected_components(nodes, edges).collect()}
    assert groups == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e", "g": "g"}
    assert {r.node for r in R.dependency_cycles(edges).collect()} == {"a", "b", "c"}


def test_usage_is_null_when_any_value_is_missing(spark):
    calls = spark.createDataFrame([(10, 1, 1, 5, 0.1, "m"), (None, 1, 1, 5, 0.2, "m")], "tokens_in int, tokens_cached int, tokens_cache_written int, tokens_out int, cost_usd double, model string")
    row = M.usage_totals(calls).first()
    assert (row["tokens_in"], row["tokens_out"], row["cost_usd"], row["models"]) == (None, 10, 0.3, "m")
