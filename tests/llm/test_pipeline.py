"""The stages of corpus_pipeline and its whole run against plain Python, on a small corpus."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline as P
from palimpsest.llm import queries
from palimpsest.llm.common import written

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
SPEECH = {
    "en": "the and of that with from this have were which their would there about house river under garden morning people".split(),
    "fr": "le et des que avec pour cette sont dans leur serait alors maison jardin matin peuple riviere toujours encore jamais".split(),
}
TOXIC, CARD = "vilewretch", "4111 1111 1111 1111"


def prose(own: random.Random, lang: str, n: int) -> list[str]:
    return [own.choice(SPEECH[lang]) for _ in range(n)]


def corpus() -> tuple[list[tuple], set[int], dict[int, int]]:
    """Rows, the toxic ids, and the copies by the id that stays."""
    own, rows, toxic, copies = random.Random(3), [], set(), {}
    for i in range(240):
        lang = "en" if i % 2 else "fr"
        words = prose(own, lang, 120)
        if i % 4 == 1:
            words[own.randrange(120)] = TOXIC
            words[own.randrange(120)] = TOXIC
            toxic.add(i)
        rows.append([i, " ".join(words), lang])
    for new, old in enumerate((2, 6, 7, 11), 300):
        words = rows[old][1].split()
        if new % 2:
            words[60] = "changed"
        rows.append([new, " ".join(words), rows[old][2]])
        copies[new] = old
    rows[10][1] += f" {CARD}"
    rows.append([400, None, "en"])
    rows.append([401, "", None])
    rows.append([402, "12 34 - !", "en"])
    rows.append([403, rows[3][1] + " own ending of this", None])
    rows.append(list(rows[14]))
    rows.append([None, " ".join(prose(own, "en", 90)), "en"])
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in rows], toxic, copies | {403: 3}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, toxic, copies = corpus()
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SHAPE).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, int(r[0] in toxic)) for r in rows if r[0] is not None and r[0] < 240]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, toxic, copies


@pytest.fixture(scope="module")
def results(spark, tables):
    """What each stage keeps of its own input."""
    folder, found = tables[0], [queries.table(spark, tables[0], "documents")]
    for _, stage in P.STAGES:
        found.append(written(stage(spark, found[-1], folder), "stage"))
    return [[r.asDict() for r in x.collect()] for x in found]


def grams(text: str) -> frozenset:
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_texts_without_a_language_go(results):
    before, after = results[0], results[1]
    assert set(after[0]) == set(P.COLUMNS)
    lettered = sorted((str(r["doc_id"]), r["text"]) for r in before if re.search("[a-z]", r["text"] or ""))
    assert sorted((str(r["doc_id"]), r["text"]) for r in after) == lettered
    assert all(r["lang"] == ("en" if r["doc_id"] % 2 else "fr") for r in after if r["doc_id"] is not None and r["doc_id"] < 240)
    assert {r["lang"] for r in after if r["doc_id"] == 403} == {"en"}


def test_toxic_texts_go_and_clean_ones_stay(results, tables):
    before, after = results[1], results[2]
    clean = sorted((str(r["doc_id"]), r["text"]) for r in before if TOXIC not in r["text"])
    assert sorted((str(r["doc_id"]), r["text"]) for r in after) == clean
    assert tables[2].isdisjoint({r["doc_id"] for r in after})


def test_one_document_of_each_group_stays(results, tables):
    before, after = results[2], results[3]
    rows = sorted(before, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    sets, stay = [grams(r["text"]) for r in rows], []
    for i, own in enumerate(sets):
        if not any(5 * len(own & other) >= 4 * len(own | other) for other in sets[:i]):
            stay.append(str(rows[i]["doc_id"]))
    assert sorted(str(r["doc_id"]) for r in after) == sorted(stay)
    kept = {r["doc_id"] for r in after}
    assert kept.isdisjoint(tables[3]) and set(tables[3].values()) <= kept and None in kept


def test_personal_data_give_way(results):
    before, after = ({r["doc_id"]: r for r in x} for x in results[3:5])
    assert before.keys() == after.keys() and CARD in before[10]["text"]
    for i, r in after.items():
        assert r["n_chars"] == len(r["text"]) and {k: r[k] for k in ("lang", "source")} == {k: before[i][k] for k in ("lang", "source")}
        assert (r["text"] == before[i]["text"]) == (i != 10)
    assert CARD not in after[10]["text"] and re.search(r"\d{4} \d{4} \d{4} \d{4}$", after[10]["text"])


def test_every_id_is_in_one_piece(results):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    total = {r["doc_id"]: len(own.encode(r["text"], add_special_tokens=False).ids) + 1 for r in results[4]}
    pieces = {i: sorted((p["start"], p["length"]) for p in results[5] if p["doc_id"] == i) for i in total}
    assert {p["doc_id"] for p in results[5]} == total.keys()
    for i, n in total.items():
        ends = [0, *(s + k for s, k in pieces[i])]
        assert [s for s, _ in pieces[i]] == ends[:-1] and ends[-1] == n


def test_run_is_the_stages_in_order(spark, tables, results):
    assert [name for name, _ in P.STAGES] == ["language ID", "toxicity", "n-gram Jaccard join", "PII", "packing"]
    # Which sequence a piece lies in depends on the order of rows; the documents and their lengths do not.
    found = {(r["doc_id"], r["doc_tokens"]) for r in P.run(spark, tables[0]).collect()}
    assert found == {(r["doc_id"], r["doc_tokens"]) for r in results[5]}


def test_run_over_an_empty_table(spark, tables, tmp_path, results):
    spark.createDataFrame([], SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = P.run(spark, str(tmp_path))
    assert out.count() == 0 and set(out.columns) == set(results[5][0])
