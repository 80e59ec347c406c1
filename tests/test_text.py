from __future__ import annotations

import difflib
import re
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import spans as S
from palimpsest.functions import text as T


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text", ["", "ação 😀 à noite", "  x", "a" * 2000 + " b", "um dois " * 700])
def test_match_spans_equals_finditer(spark, text):
    found = one(spark, text, S.match_spans(F.col("text"), S.WORD))
    expected = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W\d_]+", text)]
    assert [tuple(r) for r in found] == expected


def test_explode_matches_equals_row_local_form(spark):
    df = spark.createDataFrame([(1, 1, "Ana viu. Ana sorriu!"), (1, 2, ""), (2, 1, "é é")], "doc_id long, paragraph int, text string")
    rows = S.words(df).orderBy("doc_id", "paragraph", "n").collect()
    assert [(r.doc_id, r.start, r.end, r.word) for r in rows] == [
        (1, 0, 3, "Ana"), (1, 4, 7, "viu"), (1, 9, 12, "Ana"), (1, 13, 19, "sorriu"), (2, 0, 1, "é"), (2, 2, 3, "é")
    ]


def test_occurrence_ordinal_counts_whole_words(spark):
    text = "espera a era, era a hora"
    place = one(spark, text, T.occurrence_ordinal(F.col("text"), F.lit(14), F.lit(17)))
    assert (place["which"], place["total"]) == (2, 2)


def test_find_excerpt_tolerates_signs_and_case(spark):
    found = one(spark, "Ele disse: “Não  vou” — e saiu.", T.find_excerpt(F.col("text"), F.lit('"não vou"')))
    assert [(r["start"], r["end"]) for r in found] == [(11, 21)]


def test_marker_pair_skips_used_marks(spark):
    pair = one(spark, "um ⟦dois⟧", T.marker_pair(F.array("text")))
    assert (pair["open"], pair["close"]) == ("⟪", "⟫")


def test_utf16_offsets(spark):
    assert one(spark, "a😀b", T.utf16_to_codepoint(F.col("text"), F.lit(3))) == 2


def test_minimal_change(spark):
    change = one(spark, "casa azul", T.minimal_change(F.col("text"), F.lit("casa verde azul")))
    assert "casa azul"[: change["start"]] + change["after"] + "casa azul"[change["end"]:] == "casa verde azul"


def test_cased_like(spark):
    for model, expected in (("QUE", "QUÊ"), ("Que", "Quê"), ("que", "quê")):
        assert one(spark, model, T.cased_like(F.col("text"), F.lit("quê"))) == expected


def test_expressive_and_labels(spark):
    assert one(spark, "Haaaa", T.is_expressive(F.col("text")))
    assert not one(spark, "casa", T.is_expressive(F.col("text")))
    assert one(spark, "Parte 3", T.is_list_or_label(F.col("text")))
    assert one(spark, "Ana da Silva", T.is_credit_line(F.col("text")))
    assert not one(spark, "Ana saiu cedo.", T.is_credit_line(F.col("text")))


def test_near_spelling_matches_ratio_examples(spark):
    from palimpsest.operators.editorial import near_spelling

    near = lambda a, b: one(spark, a, near_spelling(F.col("text"), F.lit(b)))
    assert near("csaa", "casa") and near("cása", "casa") and near("casas", "casa")
    assert not near("taser", "fazer")
    assert difflib.SequenceMatcher(None, "ab", "ab").ratio() == 1


def test_accented_stop_words_stay_search_keys(spark):
    from palimpsest.functions.text import prefix_keys

    rows = spark.createDataFrame([("Não você também para outro café",), ("cafe\u0301",)], "t string")
    found = [r[0] for r in rows.select(prefix_keys(rows.t)).collect()]
    assert found == [["nao", "voce", "tambe", "cafe"], ["cafe"]]


@pytest.mark.parametrize("x,y", [("", "a"), ("ação", "ação"), ("ação 😀!", "ação 😀?"), ("abc", "ab"), ("x", "y"), ("a" * 20_000 + "é", "a" * 20_000 + "e")])
def test_common_prefix_of_long_texts(spark, x, y):
    found = spark.createDataFrame([(x, y)], "x string, y string").select(T.common_prefix(F.col("x"), F.col("y")).alias("v")).first()["v"]
    expected = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    assert found == expected


def test_common_prefix_of_null_is_null_and_long_changes_stay_cheap(spark):
    df = spark.createDataFrame([(None, "a")], "x string, y string")
    assert df.select(T.common_prefix(F.col("x"), F.col("y")).alias("v")).first()["v"] is None
    text = "palavra " * 50_000  # one look at every place of such a text took minutes
    begun = time.perf_counter()
    change = one(spark, text, T.minimal_change(F.col("text"), F.concat(F.col("text"), F.lit("fim"))))
    assert (change["start"], change["end"], change["after"]) == (len(text), len(text), "fim")
    assert time.perf_counter() - begun < 30


def test_match_spans_following(spark):
    found = one(spark, "a1bb22c", S.match_spans(F.col("text"), r"\d+", following=True))
    assert [tuple(r) for r in found] == [(1, 2, "1", "bb"), (4, 6, "22", "c")]
    assert one(spark, "abc", S.match_spans(F.col("text"), r"\d+", following=True)) == []
