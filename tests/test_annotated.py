"""Rules over annotated sentences, on authored sentences with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import clauses as Q
from palimpsest.operators import fragments as G
from palimpsest.operators import narrative as N
from palimpsest.operators import syntax as X
from palimpsest.sources.scratch import written
from registry.annotated import _KEYS, FIELDS, tokens_of

SCHEMA = "doc_id long, paragraph int, sent int, i int, idx int, text string, lemma string, pos string, dep string, head int, flags int, morph map<string,string>"


CASES: dict[tuple, int] = {}


def case(*paragraphs):
    """The document of these paragraphs: lists of sentences, ``None`` for one without narration."""
    return CASES.setdefault(tuple(tuple(p) if p else None for p in paragraphs), len(CASES))


def rows_of(doc, paragraphs):
    for p, lines in enumerate(paragraphs):
        i = 0
        for s, line in enumerate(lines or ()):
            tokens = tokens_of(line)
            for t in tokens:
                f = dict(zip(FIELDS[1:], t, strict=True))
                morph = {k: f[k.lower()] for k in _KEYS.values() if f[k.lower()]}
                yield doc, p, s, i + f["n"], 1000 * s + f["offs"], f["text"], f["lemma"], f["pos"], f["dep"], i + f["up"], f["flags"], morph
            i += len(tokens)


@pytest.fixture(scope="module")
def book(spark):
    """Readings, functions, events and what the rules find, of all cases at once: each step runs once."""
    rows = [r for paragraphs, doc in CASES.items() for r in rows_of(doc, paragraphs)]
    t = written(X.tense_readings(X.verb_evidence(spark.createDataFrame(rows, SCHEMA))), "readings")
    functions = written(N.present_function(N.annotate(t)), "functions")
    breaks = spark.createDataFrame([(case(*SCENE), 4)], "doc_id long, paragraph int")
    events = written(N.events(t, breaks), "events")
    return {
        "readings": t.collect(), "functions": functions.where("function IS NOT NULL").collect(), "events": events.collect(), "shifts": N.tense_shifts(events).collect(),
        "commas": Q.subject_verb_comma(t).collect(), "correlation": Q.tense_correlation(t).collect(), "relations": Q.clause_relations(functions).collect(),
        "agreement": Q.agreement(t).collect(), "case": Q.case_marking(t).collect(), "fragments": G.fragments(t).collect(), "subordinate": G.subordinate_without_main(t).collect(),
        "empty": [X.verb_evidence(t.where("false").drop("certain").withColumn("morph", F.lit(None).cast("map<string,string>"))).count()],
    }


def said(book, name, doc, *columns):
    found = [r for r in book[name] if r["doc_id"] == doc]
    return [tuple(r[c] for c in columns) for r in sorted(found, key=lambda r: (r["paragraph"], r.asDict().get("i", r["sent"])))]


EVIDENCE = {
    "A>2.det garra>3.nsubj segura>0.ROOT o>5.det menino>3.obj .>3.punct": (["segura"], []),
    "A>2.det garra>5.obl segura=ADJ>2.amod ele>5.nsubj corre>0.ROOT .>5.punct": (["corre"], ["segura"]),
    "Uma>3.det nova>3.amod era>4.nsubj começa>0.ROOT .>4.punct": (["começa"], ["era"]),
    "Todo>3.det o>3.det segura>4.nsubj caiu>0.ROOT .>4.punct": (["caiu"], []),
    "A>2.det casa>4.nsubj estava>4.cop vazia>0.ROOT .>4.punct": (["estava"], []),
    "É>2.cop preciso>0.ROOT sair>2.csubj .>2.punct": (["É"], []),
    "Preciso>0.ROOT falar>1.xcomp com>4.case Helena>2.obl .>1.punct": (["Preciso"], []),
    "O>2.det braço>3.nsubj causa>0.ROOT coceira>3.obj .>3.punct": (["causa"], []),
    "Ela>2.nsubj segura=NOUN>0.ROOT .>2.punct": (["segura"], []),
    "O>2.det quarto>0.ROOT onde>4.advmod toca=NOUN>2.nmod .>2.punct": ([], ["toca"]),
    "Demora>0.ROOT para>4.case o>4.det quarto>1.nmod .>1.punct": ([], ["Demora"]),
    "Pedras>0.ROOT soltas>1.amod .>1.punct": ([], []),
}


EVIDENCE_DOCS = {line: case([line]) for line in [*EVIDENCE, "Xilofona=VERB>0.ROOT .>1.punct"]}


def test_evidence_of_verbs(book):
    for line, (certain, more) in EVIDENCE.items():
        tokens = said(book, "readings", EVIDENCE_DOCS[line], "text", "certain", "possible")
        assert [t for t, sure, _ in tokens if sure] == certain, line
        assert [t for t, sure, maybe in tokens if maybe and not sure] == more, line
    assert said(book, "readings", EVIDENCE_DOCS["Xilofona=VERB>0.ROOT .>1.punct"], "certain", "possible") == [(False, False)] * 2
    assert not [r for r in book["readings"] if r["certain"] and not r["possible"]] and book["empty"] == [0]


READINGS = case(
    ["Ele>3.nsubj tinha>3.aux esquecido>0.ROOT a>5.det lista>3.obj .>3.punct"], ["Se>3.mark ele>3.nsubj chegasse>6.advcl ,>3.punct ela>6.nsubj faria>0.ROOT isso>6.obj .>6.punct"],
    ["O>2.det carro>3.nsubj para=VERB>0.ROOT no>5.case sinal>3.obl .>3.punct"], ["Escorrem>0.ROOT as>3.det pedras>1.nsubj .>1.punct"], ["Ela>2.nsubj vira>0.ROOT o>4.det mapa>2.obj e>6.cc passamos>2.conj .>2.punct"],
)


def test_readings(book):
    rows = {r["text"]: r for r in book["readings"] if r["doc_id"] == READINGS}
    assert rows["tinha"]["pluperfect"] and rows["tinha"]["imperfect"] == "indicativo" and rows["tinha"]["narrative"] == "passado" and rows["tinha"]["only_past"]
    assert (rows["chegasse"]["imperfect"], rows["chegasse"]["strict"]) == ("subjuntivo", None) and (rows["faria"]["strict"], rows["faria"]["imperfect"]) == ("conditional", "condicional")
    assert rows["para"]["recovered"] == "present" and rows["para"]["strict"] is None
    assert rows["Escorrem"]["recovered"] == "present" and rows["Escorrem"]["strict"] is None
    assert (rows["vira"]["strict"], rows["vira"]["recovered"]) == ("ambiguous_past_present", "present") and rows["passamos"]["recovered"] == "past"


def test_subtrees_of_crossing_trees(spark):
    heads = [2, 3, 2, 2, 1]  # the last hangs on the second, across the root
    rows = [(1, 0, 0, 10 + i, 0, "w", "w", "NOUN", "x", 10 + h, 0, {}) for i, h in enumerate(heads)]
    t = X.subtrees(spark.createDataFrame(rows, SCHEMA)).orderBy("i").collect()
    assert [(r["first"] - 10, r["last"] - 10, r["depth"]) for r in t] == [(0, 0, 1), (1, 4, 2), (0, 4, 0), (1, 4, 1), (4, 4, 3)]
    for a in range(5):
        for b in range(5):
            chain, at = [b], b
            while heads[at] != at:
                at = heads[at]
                chain.append(at)
            assert (t[a]["enter"] <= t[b]["enter"] < t[a]["leave"]) == (a in chain)


PAST = "O>2.det menino>3.nsubj saiu>0.ROOT .>3.punct"
SCENE = [
    [PAST, "Ele>2.nsubj abriu>0.ROOT a>4.det porta>2.obj .>2.punct"], ["Ele>2.nsubj corre>0.ROOT na>4.case casa>2.obl .>2.punct"], None,
    ["Silêncio>0.ROOT .>1.punct", PAST], [".>0.ROOT"], ["Helena>2.nsubj abre>0.ROOT a>4.det porta>2.obj e>6.cc saiu>2.conj .>2.punct"],
]


SCENE_DOC = case(*SCENE)


def test_events_count_sentences_paragraphs_and_gaps(book):
    assert said(book, "events", SCENE_DOC, "text", "scene", "ordinal", "tense", "subject") == [
        ("saiu", 0, 0, "past", "menino"), ("abriu", 0, 1, "past", "ele"), ("corre", 0, 3, "present", "ele"), ("saiu", 0, 6, "past", "menino"),
        ("abre", 1, 1, "present", "helena"), ("saiu", 1, 1, "past", "helena"),
    ]


PRESENT = "Ele>2.nsubj corre>0.ROOT na>4.case casa>2.obl .>2.punct"
BARE = "Corre>0.ROOT na>3.case casa>1.obl .>1.punct"
OTHER = "Uma>2.det mão>3.nsubj abre>0.ROOT a>5.det porta>3.obj .>3.punct"
SHIFTS = [
    (case(["Helena>2.nsubj abre>0.ROOT a>4.det porta>2.obj e>6.cc saiu>2.conj .>2.punct"]), [("abre", "coordinated_tense_mismatch", 0.88, "unknown", ["saiu"])]),
    (case([PAST, PRESENT, PAST]), [("corre", "past_present_past", 0.9, "past", ["saiu", "saiu"])]),
    (case([PAST, PAST, PRESENT]), [("corre", "same_subject_narrative_shift", 0.85, "past", ["saiu", "saiu"])]),
    (case([PAST, BARE]), [("Corre", "same_subject_narrative_shift", 0.75, "past", ["saiu"])]),
    (case([PAST, PAST, OTHER]), [("abre", "local_narrative_tense_shift", 0.7, "past", ["saiu", "saiu"])]),
    (case([PRESENT, PAST]), [("corre", "local_narrative_tense_shift", 0.72, "unknown", ["saiu"])]),
    (case([PAST], None, None, None, None, None, [PRESENT]), []),
    (case([PRESENT]), []),
]


def test_every_reading_of_a_shift(book):
    for doc, expected in SHIFTS:
        assert said(book, "shifts", doc, "text", "relation", "confidence", "state", "anchors") == expected


FUNCTIONS = {
        "Ela>2.nsubj olha>0.ROOT a>4.det casa>2.obj ?>2.punct": ("olha", "thought"), "Ele>2.nsubj corre>0.ROOT sempre>2.advmod na>5.case noite>2.obl .>2.punct": ("corre", "narrator_comment"),
        "O>2.det vento>3.nsubj conduz>0.ROOT medo>3.obj .>3.punct": ("conduz", "general_truth"), "Ela>2.nsubj parece>0.ROOT assustada>2.xcomp .>2.punct": ("parece", "transient_state"),
        "Ela>2.nsubj fica>0.ROOT olhando>2.xcomp o>5.det vento>3.obj .>2.punct": ("fica", "narrative_event"), "Ele>2.nsubj sabe>0.ROOT isso>2.obj .>2.punct": ("sabe", "state"),
        "Este>2.det homem>3.nsubj olha>0.ROOT a>5.det casa>3.obj .>3.punct": ("olha", "narrator_comment"), "Corre>0.ROOT .>1.punct": ("Corre", "discourse_marker"),
        "Ele>2.nsubj disse>0.ROOT que>4.mark corre>2.ccomp na>6.case casa>4.obl .>2.punct": ("corre", "general_truth"),
        "Ele>2.nsubj corre>0.ROOT e>5.cc hoje>5.advmod saiu>2.conj .>2.punct": ("corre", "narrative_event"),
}
FUNCTION_DOCS = {line: case([line]) for line in FUNCTIONS}


def test_functions_of_the_present(book):
    for line, expected in FUNCTIONS.items():
        assert said(book, "functions", FUNCTION_DOCS[line], "text", "function") == [expected], line


COMMAS = case(
    ["Os>2.det homens>4.nsubj ,>2.punct correram>0.ROOT .>4.punct"], ["Helena>3.nsubj ,>1.punct saiu>0.ROOT .>3.punct"],
        ["O>2.det homem>8.nsubj que>4.nsubj chegou>2.acl:relcl na>6.case noite>4.obl ,>4.punct rega>0.ROOT as>10.det flores>8.obj .>8.punct"],
        ["O>2.det homem>6.nsubj ,>4.punct Mariana>2.appos ,>4.punct saiu>0.ROOT .>6.punct"], ["As>2.det luzes>3.nsubj correram>0.ROOT .>3.punct"],
)


def test_commas_after_subjects(book):
    assert sorted(said(book, "commas", COMMAS, "paragraph", "i", "kind")) == [(0, 2, "subject"), (2, 6, "relative"), (2, 6, "subject")]


CORRELATED = case(
    ["Embora>3.mark ele>3.nsubj fosse>6.advcl ,>3.punct ela>6.nsubj corre>0.ROOT .>6.punct"], ["Ela>2.nsubj corre>0.ROOT e>4.cc saiu>2.conj antes=ADV>7.advmod que>7.mark terminasse>4.advcl .>2.punct"],
        ["Ela>2.nsubj corre>0.ROOT como>5.mark se>5.mark fosse>2.advcl .>2.punct"], ["Se>3.mark ele>3.nsubj chegasse>6.advcl ,>3.punct ela>6.nsubj faria>0.ROOT isso>6.obj .>6.punct"],
        ["Ela>2.nsubj corre>0.ROOT —>2.punct se>6.mark ele>6.nsubj chegasse>2.advcl .>2.punct"],
)


def test_correlation_takes_the_nearest_verb_outside(book):
    assert sorted(said(book, "correlation", CORRELATED, "paragraph", "phrase", "text", "main", "confidence")) == [(0, "embora", "fosse", "corre", 0.6)]


RELATED = case(
    ["Ele>2.nsubj faria>0.ROOT uma>4.det lista>2.obj que>6.nsubj será>4.acl:relcl nova>6.xcomp .>2.punct"], ["O>2.det homem>3.nsubj saiu>0.ROOT enquanto>6.mark ela>6.nsubj corre>3.advcl .>3.punct"],
        ["O>2.det homem>3.nsubj saiu>0.ROOT enquanto>6.mark ela>6.nsubj passamos>3.advcl .>3.punct"], ["Ele>2.nsubj saiu>0.ROOT e>4.cc corre>2.conj .>2.punct"], ["Ele>2.nsubj saiu>0.ROOT ;>2.punct e>5.cc corre>2.conj .>2.punct"],
        ["Ele>2.nsubj devia>0.ROOT correr>2.xcomp e>5.cc olha>2.conj o>7.det mapa>5.obj .>2.punct"], ["Ele>2.nsubj saiu>0.ROOT e>4.cc sabe>2.conj .>2.punct"],
)


def test_relations_by_the_path(book):
    assert sorted(said(book, "relations", RELATED, "paragraph", "text", "anchor", "relation")) == [(0, "será", "faria", "conditional_future"), (1, "corre", "saiu", "simultaneous_present"), (2, "passamos", "saiu", "ambiguous_simultaneity"), (3, "corre", "saiu", "coordinated_past_present")]


AGREEING = case(
    ["As>2.det luzes>3.nsubj caiu>0.ROOT .>3.punct"], ["A>2.det lista>5.nsubj de>4.case nomes>2.nmod correram>0.ROOT .>5.punct"], ["A>2.det maioria>5.nsubj dos>4.case homens>2.nmod correram>0.ROOT .>5.punct"],
        ["Haviam>0.ROOT turistas>1.obj .>1.punct"], ["Parece>3.cop tão>3.advmod nervosos>0.ROOT .>3.punct"], ["As>2.det luzes>4.nsubj estavam>4.cop apagada>0.ROOT .>4.punct"],
        ["Nenhuma>2.nsubj correram>0.ROOT .>2.punct"], ["As>2.det luzes>4.nsubj ,>2.punct caiu>0.ROOT .>4.punct"], ["O>2.det menino>5.nsubj e>4.cc Helena>2.conj correram>0.ROOT .>5.punct"],
        ["Abriu>0.ROOT as>3.det luzes>4.nsubj caiu>1.conj .>1.punct"],
)


def test_shapes_of_agreement(book):
    assert sorted(said(book, "agreement", AGREEING, "paragraph", "shape", "suggestion")) == [(0, "plural_subject", None), (1, "attraction", None), (3, "impersonal", "havia"), (4, "elided_subject", "parecem"), (5, "adjective", None), (6, "single_subject", None)]


MARKED = case(
    ["Entregou>0.ROOT o>3.det livro>1.obj a>5.det irmã>1.obl .>1.punct"], ["Entregou>0.ROOT ao=ADP>3.case menino>1.obl a>5.det lista>1.obj .>1.punct"], ["Correram>0.ROOT à=ADP>3.case sair>1.advcl .>1.punct"], ["Abriu>0.ROOT o>3.det livro>1.obj a>5.det irmã>1.obl .>1.punct"]
)


def test_case_marking(book):
    assert sorted(said(book, "case", MARKED, "paragraph", "kind", "suggestion")) == [(0, "missing", "à irmã"), (2, "undue", "a sair")]


FRAGMENTS = [
    (case(["Quando>2.mark noite>0.ROOT nova>2.amod .>2.punct"]), "likely_incomplete_clause"),
    (case([PAST, "Pedras>0.ROOT enferrujadas>1.amod ,>4.punct galhos>1.conj secos>4.amod ,>7.punct medo>1.conj .>1.punct"]), "likely_literary_fragment"),
    (case([PAST, "Primeiro>2.advmod devagar>0.ROOT ,>5.punct depois>5.advmod muito>2.advmod .>2.punct"]), "likely_adverbial_fragment"),
    (case(["As>2.det chaves>3.nsubj correram>0.ROOT .>3.punct", "Enferrujadas>0.ROOT ,>1.punct quase=ADV>1.advmod nervosos>1.conj .>1.punct"]), "likely_elliptical_predication"),
    (case([PAST, "Uma>3.det velha>3.amod noite>0.ROOT na>5.case noite>3.nmod .>3.punct"]), "uncertain"),
    (case(["Pensei>0.ROOT na>3.case casa>1.obl .>1.punct", "No>2.case quarto>0.ROOT .>2.punct"]), None),
    (case([PAST, "Silêncio>0.ROOT …>1.punct nenhuma>4.det respostas>1.conj .>1.punct"]), None),
]


def test_classes_of_fragments(book):
    for doc, expected in FRAGMENTS:
        assert said(book, "fragments", doc, "class") == ([(expected,)] if expected else [])


SUBORDINATE = case(
    ["Quando>4.mark o>3.det homem>4.nsubj chegou>0.ROOT ao=ADP>6.case quarto>4.obl .>4.punct"], ["Quando>3.mark ele>3.nsubj chegou>6.advcl ,>3.punct ela>6.nsubj saiu>0.ROOT .>6.punct"],
    ["O>2.det homem>7.nsubj da>4.case noite>2.nmod enquanto>7.mark eles>7.nsubj correram>0.ROOT .>7.punct"],
)


def test_subordinate_without_main(book):
    assert said(book, "subordinate", SUBORDINATE, "paragraph", "opening", "kind") == [(0, "quando", "opening"), (2, None, "hanging")]
