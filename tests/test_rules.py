from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import editorial as E
from palimpsest.operators import rules as R
from palimpsest.operators import segments as G
from palimpsest.operators import tokens as K


def classified(spark, *lines):
    df = spark.createDataFrame([(1, i, t, False) for i, t in enumerate(lines, 1)], "doc_id long, paragraph int, text string, heading boolean")
    return G.classify_roles(df)


def found(spark, text, rules=R.SURFACE_RULES):
    rows = R.apply_rules(classified(spark, text), rules).orderBy("start").collect()
    return [(r.rule, r.excerpt, r.suggestion, r.severity) for r in rows]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Além de disso, saiu.", [("construcao_invalida", "Além de disso", "Além disso", "confirmed_error")]),
        ("Foi,, e voltou.", [("pontuacao_duplicada", ",,", ",", "confirmed_error")]),
        ("Fim.. Depois… e... nada.", [("pontuacao_duplicada", "..", None, "probable_error")]),
        ("O que?", [("que_tonico_interrogativo", "que", "quê", "probable_error")]),
        ("Ele  viu isto , sim.", [("espacamento", "  ", " ", "probable_error"), ("espacamento", " ", "", "probable_error")]),
        ("Disse que, não iria.", [("virgula_que_nao", "que, não", "que não", "probable_error")]),
        ("Disse que, não obstante, iria.", []),
        ("Pelo que, não irei.", []),
        ("Você vai? ela perguntou.", [("capitalizacao_contextual", " ela", " Ela", "probable_error")]),
        ("Ah! tu vens.", []),
    ],
)
def test_surface_rules(spark, text, expected):
    assert found(spark, text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Saiu as pressas.", ["às pressas"]),
        ("As vezes chove.", ["Às vezes"]),
        ("Todas as vezes que vem.", []),
        ("Chegou as seis horas da manhã.", ["às"]),
        ("Você saiu porque?", ["por quê"]),
        ("Queria ir, mais não pôde.", ["mas"]),
        ("Queria ir," + " " * 60 + "mais não pôde.", ["mas"]),
        ("Queria ir mais não pôde.", []),
        (" " * 40 + "Porque veio?", ["Por que"]),
        ("Saiu." + " " * 40 + "Porque veio?", ["Por que"]),
        ("Saiu.Porque veio?", []),
        ("Menino mau educado.", ["mal educado"]),
        ("Estava de baixo da mesa.", ["debaixo"]),
        ("Foi até a casa da.", [None]),
        ("Ficou em…", []),
        ("Foi ao invés de ficar.", ["em vez"]),
    ],
)
def test_grammar_surface_rules(spark, text, expected):
    assert [s for _, _, s, _ in found(spark, text, R.GRAMMAR_RULES)] == expected


def test_doubled_words(spark):
    units = spark.createDataFrame([(1, 1, "o o gato viu viu Viu. Alcancei-a a pé. P. p. Se se sabe, se se ele.")], "doc_id long, paragraph int, text string")
    all_pairs = R.doubled_words(units).orderBy("start").collect()
    assert [r.excerpt for r in all_pairs] == ["o o", "viu viu", "viu Viu", "Se se", "se se"]
    lexicon = spark.createDataFrame([("o", 32), ("viu", 3), ("se", 32), ("sabe", 5)], "word string, flags int")
    known = R.doubled_words(units, lexicon).orderBy("start").collect()
    assert [r.start for r in known] == [0, 9, 13, all_pairs[4].start]


def test_vocatives(spark):
    lexicon = spark.createDataFrame([("venha", 1), ("achei", 3)], "word string, flags int")
    lines = ["Pedro não faça isso.", "Achei você bem.", "Não senhora.", "Ana minha filha venha cá."]
    units = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines, 1)], "doc_id long, paragraph int, text string")
    rows = {r.paragraph: r.suggestion for r in R.vocatives(units, lexicon).collect()}
    assert rows == {1: "Pedro,", 3: "Não, senhora", 4: "Ana, minha filha,"}


def test_vocatives_after_any_amount_of_space(spark):
    lexicon = spark.createDataFrame([("venha", 1)], "word string, flags int")
    gap = " " * 50
    lines = [gap + "Pedro não faça isso.", "Saiu." + gap + "Não senhora.", "Saiu!" + gap + "Ana minha filha venha cá.", "disse Não senhora.", "Saiu.Pedro não faça isso."]
    units = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines, 1)], "doc_id long, paragraph int, text string")
    rows = {r.paragraph: r.shape for r in R.vocatives(units, lexicon).collect()}
    assert rows == {1: "call", 2: "answer", 3: "apposition"}


def test_narrative_tense_needs_the_lexicon(spark):
    rows = [
        (1, 0, "Past", "Ind", True, None), (2, R.FINITE | R.PAST, "Pres", "Ind", True, "passado"), (3, R.FINITE | R.PRESENT, "Pres", "Ind", True, "presente"),
        (4, R.FINITE | R.PRESENT, "Pres", "Imp", True, None), (5, R.FINITE | R.PAST | R.PRESENT, "Past", "Ind", True, None),
        (6, R.FINITE | R.PRESENT | R.FUTURE, "Pres", "Ind", True, None), (7, R.FINITE | R.PAST, "Past", "Ind", False, None), (8, R.FINITE | R.PAST, None, None, True, "passado"),
    ]
    df = spark.createDataFrame(
        [(i, flags, "VERB", {k: v for k, v in (("VerbForm", "Fin"), ("Tense", t), ("Mood", m)) if v}, ok) for i, flags, t, m, ok, _ in rows],
        "i int, flags int, pos string, morph map<string,string>, ok boolean",
    )
    got = {r.i: r.t for r in df.select("i", K.narrative_tense(F.col("flags"), F.col("ok")).alias("t")).collect()}
    assert got == {r[0]: r[-1] for r in rows}


def test_speech_verbs(spark):
    words = ["perguntei", "disse-me", "dissera", "respondemos", "andou", "casa"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.where(R.speech_verb(F.col("w"))).collect()]
    assert got == ["perguntei", "disse-me", "dissera", "respondemos"]


def test_accent_candidates(spark):
    words = spark.createDataFrame([("caia",), ("Saiam",), ("dia",)], "word string")
    lexicon = spark.createDataFrame([("caía", 3), ("saíam", 3), ("día", 7)], "word string, flags int")
    got = {r.word: r.proposal for r in R.accent_candidates(words, lexicon).collect()}
    assert got == {"caia": "caía", "Saiam": "Saíam"}


def sentence_units(spark, *lines):
    rows = [(1, i, 0, "narracao", 0, t) for i, t in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "doc_id long, paragraph int, section int, role string, base int, text string")


def test_repeated_and_similar_sentences(spark):
    base = "O vento frio soprava pela janela aberta."
    near = "O vento frio soprava pela porta aberta."
    fillers = [f"Uma frase {w} que não se parece com nada." for w in "abcdefgh"]
    s = E.eligible_sentences(sentence_units(spark, base, base, near, *fillers, base))
    exact = E.repeated_sentences(s).collect()
    assert [(r.paragraph, r.earlier_paragraph) for r in exact] == [(2, 1)]
    similar = {r.paragraph: r.earlier_paragraph for r in E.similar_sentences(s, 0.8).collect()}
    assert similar[2] == 1 and similar[3] == 2


def test_edit_scars(spark):
    schema = "doc_id long, paragraph int, text string, heading boolean, chapter string"
    old = [(1, 1, "A velha casa de pedra ficava no alto da serra coberta de neve. Eles subiram.", False, "1")]
    new = [(1, 1, "A velha. Eles subiram.", False, "1")]
    rows = E.edit_scars(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()
    assert [(r.word, r.start, r.removed) for r in rows] == [("eles", 9, 11)]


def test_checker_filter(spark):
    paras = spark.createDataFrame([(1, 1, "O taser caiu. Haaaa! Kirvane veio."), (1, 2, "Fwoosh!")], "doc_id long, paragraph int, text string")
    schema = "doc_id long, paragraph int, offset int, length int, rule_id string, issue_type string, category_id string, replacements array<string>, message string"
    rows = [
        (1, 1, 2, 5, "MORFOLOGIK", "misspelling", "TYPOS", ["fazer"], ""),
        (1, 1, 14, 5, "MORFOLOGIK", "misspelling", "TYPOS", ["há"], ""),
        (1, 1, 21, 7, "MORFOLOGIK", "misspelling", "TYPOS", ["Cirvane"], ""),
        (1, 1, 8, 4, "X", "style", "STYLE", [], ""),
        (1, 2, 0, 6, "MORFOLOGIK", "misspelling", "TYPOS", [], ""),
    ]
    names = spark.createDataFrame([(1, "kirvane")], "doc_id long, name string")
    none = spark.createDataFrame([], "doc_id long, word string")
    lexicon = spark.createDataFrame([("o", 32)], "word string, flags int")
    out = E.filter_checker_matches(spark.createDataFrame(rows, schema), paras, names, names.where("false"), none, lexicon).collect()
    assert [(r.excerpt, r.confidence) for r in out] == [("taser", "baixa")]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("que que que fim", [("que que", 0, 7), ("que que", 4, 11)]),
        ("Ele ele, disse disse", [("Ele ele", 0, 7), ("disse disse", 9, 20)]),
        ("o a a. fim", []),
        ("dá-a a eles", []),
        ("que \n que. Sim", [("que \n que", 0, 9)]),
    ],
)
def test_doubled_words_read_what_follows_up_to_the_next_pair(spark, text, expected):
    rows = R.doubled_words(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    assert [(r.excerpt, r.start, r.end) for r in rows] == expected
    plan = R.apply_rules(classified(spark, text), [R.DOUBLED_SYMBOL])._jdf.queryExecution().optimizedPlan().toString()
    assert "(?!)" not in plan  # no search over the text around each match of a rule that asks for none


def test_light_findings_are_computed_once(spark, tmp_path):
    from registry import findings as X

    docs = [(1, "Fim!! Ele ele saiu de. Foi!!", "pt", "a", 28), (2, "Nada aqui", "pt", "b", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    whole = X.own_findings(spark, str(tmp_path)).drop("text")
    light = X.light_findings(spark, str(tmp_path))
    assert sorted(whole.collect()) == sorted(light.collect()) and light.count() == 4
    plan = X.routed(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in plan and "simbolo_dobrado" not in plan.split("Relation")[-1]
