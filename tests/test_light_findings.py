"""Steps over findings read each text once: sentence numbers, corrections and gold sentences come without it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import spans as S
from palimpsest.operators import findings as N
from palimpsest.operators import relations as R
from registry import findings as G

SCHEMA = "doc_id long, paragraph int, start int, finding_id string, text string"
TEXTS = {1: "Um dois. Tres!!  Quatro", 2: "sem fim", 3: "a.\nb… c?” d", 4: ""}


@pytest.fixture(scope="module")
def items(spark):
    rows = [(d, p, at, f"{d}{p}{at:02d}", t) for d in (1, 2) for p, t in TEXTS.items() for at in range(len(t))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(d, p, t) for d in (1, 2) for p, t in TEXTS.items()], "doc_id long, paragraph int, text string")


def test_sentence_numbers_without_the_text(items, pages):
    """the running count gives what a look at the whole paragraph gives at every place."""
    old = {(r.doc_id, r.finding_id): r.sentence for r in R.placed(items).collect()}
    new = R.numbered(items.drop("text"), pages)
    assert {(r.doc_id, r.finding_id): r.sentence for r in new.collect()} == old
    assert new.schema["sentence"].dataType == R.placed(items).schema["sentence"].dataType


def test_nearest_findings_without_the_text(items, pages):
    """equal to all pairs of a paragraph, in which sentences do not lie in one stretch of eight."""
    light = R.numbered(items.drop("text"), pages)
    rows = light.collect()
    wanted = set()
    for a in rows:
        near = sorted(
            (b.sentence != a.sentence, abs(b.start - a.start), b.start, b.finding_id)
            for b in rows if (b.doc_id, b.paragraph) == (a.doc_id, a.paragraph) and b.finding_id != a.finding_id
        )
        wanted |= {(a.doc_id, a.finding_id, i, n[3], max(len(near) - 8, 0)) for i, n in enumerate(near[:8], 1)}
    found = R.related_top(light).select("doc_id", "finding_id", "rank", "related_id", "omitted").collect()
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted


def test_consolidation_without_the_text(spark):
    """the digest of the corrected paragraph stands for the text."""
    rows = [
        (1, 1, "o que que há", 2, 9, "palavra_consecutiva", "editorial · palavra_consecutiva", None, "own", 1),
        (1, 1, "o que que há", 2, 9, "languagetool", "LanguageTool local · PORTUGUESE_WORD_REPEAT_RULE", "que", "same", 2),
        (1, 1, "o que que há", 2, 9, "languagetool", "LanguageTool local · PORTUGUESE_WORD_REPEAT_RULE", "quê", "other", 3),
        (1, 1, "o que que há", 2, 9, "languagetool", "LanguageTool local · MORFOLOGIK_RULE_PT", "que", "spelling", 4),
    ]
    schema = "doc_id long, paragraph int, text string, start int, end int, rule string, source string, suggestion string, finding_id string, report_order long"
    whole = spark.createDataFrame(rows, schema)
    light = whole.withColumn("corrected", N.corrected_digest()).drop("text")
    look = lambda df: {(r.finding_id, tuple(a.id for a in r.absorbed)) for r in N.consolidate(df).collect()}
    assert look(light) == look(whole) == {("own", ("same",)), ("other", ()), ("spelling", ())}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf = tmp_path_factory.mktemp("light")
    gold = "um dois tres quatro cinco seis."
    docs = [(1, f"a a a. {gold} Fim!!\n{gold}\nsem sem fim", "pt", "b"), (2, "nada nada aqui", "pt", "b")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, gold)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return str(sf)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gold_is_read_from_written_sentences(spark, folder):
    """errors and tolerated sentences come from one reading of the texts."""
    errors, tolerated = G.gold(spark, folder)
    assert {(r.doc_id, r.paragraph, r.error_id) for r in errors.collect()} == {(1, 1, 1), (1, 2, 0)}
    assert {(r.doc_id, r.paragraph, r.tolerated_id) for r in tolerated.collect()} == {(1, 1, 1)}
    assert "documents.parquet" not in _plan(errors) + _plan(tolerated)


def test_light_findings_carry_no_text(spark, folder):
    """own and external findings are written once, without their text, and equal the whole ones."""
    light = G.mixed(spark, folder, light=True)
    whole = G.mixed(spark, folder)
    assert "text" not in light.columns and "documents.parquet" not in _plan(light)
    keys = ["doc_id", "finding_id", "report_order", "corrected"]
    assert sorted(light.select(*keys).collect()) == sorted(whole.withColumn("corrected", N.corrected_digest()).select(*keys).collect())


def test_numbers_follow_one_exchange(items, pages):
    """Ends and findings meet in one union, not in a join of every finding with its paragraph."""
    plan = _plan(R.numbered(S.colocate(items).drop("text"), S.colocate(pages)).where(F.col("sentence") >= 0))
    assert "Join" not in plan
