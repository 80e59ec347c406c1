"""Rules over annotated sentences move no tokens; trees that are none."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import spans as S
from palimpsest.operators import clauses as Q
from palimpsest.operators import fragments as G
from palimpsest.operators import narrative as N
from palimpsest.operators import syntax as X
from palimpsest.operators import tokens as K

from .test_annotated import SCHEMA

RULES = {
    "evidence": X.verb_evidence, "readings": lambda t: _read(t), "subtrees": X.subtrees, "comma": lambda t: Q.subject_verb_comma(_read(t)),
    "correlation": lambda t: Q.tense_correlation(_read(t)), "agreement": lambda t: Q.agreement(_read(t)), "case": lambda t: Q.case_marking(_read(t)),
    "fragments": lambda t: G.fragments(_read(t)), "subordinate": lambda t: G.subordinate_without_main(_read(t)),
    "relations": lambda t: Q.clause_relations(N.present_function(N.annotate(_read(t)))),
}


def _read(tokens):
    return X.tense_readings(X.verb_evidence(tokens))


@pytest.mark.parametrize("rule", RULES)
def test_one_exchange_by_document(spark, rule):
    # Stored texts stand for tokens here: only the plan is looked at.
    tokens = S.colocate(spark.createDataFrame([], SCHEMA).union(spark.createDataFrame([(1, 0, 0, 0, 0, "w", "w", "NOUN", "ROOT", 0, 0, {})], SCHEMA)))
    plan = RULES[rule](tokens)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_cycles_and_heads_elsewhere(spark):
    heads = [1, 0, 1, 9, 3]  # a cycle, a token below it, a head outside the sentence, a token below that
    rows = [(1, 0, 0, 10 + i, 0, "w", "w", "NOUN", "x", 10 + h, 0, {}) for i, h in enumerate(heads)]
    t = X.subtrees(spark.createDataFrame(rows, SCHEMA), F.col("i") != 14).orderBy("i").collect()
    assert [(r["first"], r["last"], r["enter"], r["leave"], r["depth"]) for r in t] == [
        (10, 10, -1, -1, 0), (11, 11, -1, -1, 0), (12, 12, -1, -1, 0), (13, 13, 0, 2, 0), (15, 9, 1, 2, 1),
    ]


def test_two_sentences_share_a_paragraph(spark):
    rows = [(1, 0, s, 3 * s + k, 0, "w", "w", "NOUN", "x", 3 * s, 0, {}) for s in range(2) for k in range(3)]
    t = X.with_heads(X.kids(spark.createDataFrame(rows, SCHEMA), "text"), "text").orderBy("i").collect()
    assert [(r["h"]["i"], [x["i"] for x in r["_kids"]]) for r in t] == [(0, [1, 2]), (0, []), (0, []), (3, [4, 5]), (3, []), (3, [])]


def test_ancestors_stay_in_their_partition(spark):
    heads = [2, 2, 3, 3, 9, 3]  # the fifth hangs outside the sentence
    deps = ["det", "aux", "conj", "ROOT", "obj", "cop"]
    rows = [(1, 0, 0, 10 + i, 0, "w", "w", "NOUN", d, 10 + h, 0, {"a": "b"}) for i, (h, d) in enumerate(zip(heads, deps, strict=True))]
    found = K.ancestors(S.colocate(spark.createDataFrame(rows, SCHEMA)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Scan Existing" not in plan.replace("Scan ExistingRDD[doc_id", "")
    assert [(r["path"], r["relations"], r["morph"]) for r in found.orderBy("i").collect()] == [
        ([10, 12, 13], ["det", "conj"], {"a": "b"}), ([12, 13], ["conj"], {"a": "b"}), ([12, 13], ["conj"], {"a": "b"}), ([13], [], {"a": "b"}),
        ([14, 19], ["obj"], {"a": "b"}), ([13], [], {"a": "b"}),
    ]
    chain = [(1, 0, 0, i, 0, "w", "w", "NOUN", "x", (i + 1) % 5, 0, {}) for i in range(5)]
    with pytest.raises(Exception, match="cycle"):
        K.ancestors(spark.createDataFrame(chain, SCHEMA)).collect()
