"""The short look ahead of the open endings leaves out no match of the plain list."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from palimpsest.operators import rules as R


def test_look_ahead_changes_no_match(spark):
    pattern = next(r.pattern for r in R.GRAMMAR_RULES if r.rule == "frase_cortada")
    plain = rf"(?iuU)\b(?:{R.OPEN_ENDINGS})\b(?=\s*(?:[!?]|\.(?!\.)))"
    words = [*R.OPEN_ENDINGS.split("|"), "DA", "Sem", "ſem", "dé", "des", "pelosx", "_de", "9da", "é", "ção", "a"]
    after = ["!", ".", "..", " ?", "\n .", " \t . ", ",", "", " de.", "́!", "‍."]
    texts = [f"{lead}{w}{end} e {w}{end}" for lead, w, end in itertools.product(["", "x ", "—", "́"], words, after)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    # The words around a match tell where it is.
    marks = lambda p: F.regexp_replace("text", p, "<$0>")
    assert rows.where(marks(pattern) != marks(plain)).count() == 0
    assert rows.where(F.col("text").rlike(plain)).count() > 100


def test_every_open_ending_fits_the_look_ahead():
    assert all(2 <= len(w) <= 5 and w[0] in "acdenps" for w in R.OPEN_ENDINGS.split("|"))
    assert all(R._OPEN_AHEAD in r.pattern for r in R.GRAMMAR_RULES if r.rule == "frase_cortada")


def test_texts_are_searched_only_where_a_rule_applies(spark):
    """A pattern that fails on a unit it is not meant for is never tried there."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.char_length("text").alias("end"), F.lit("narracao").alias("role")))
    lines = spark.createDataFrame([(1, 1, "fim de. a!!")], "doc_id long, paragraph int, text string").withColumn("roles", whole)
    rules = [R.DOUBLED_SYMBOL, *[r for r in R.GRAMMAR_RULES if r.rule == "frase_cortada"]]
    found = R.apply_rules(lines, rules)
    assert {(r.rule, r.start, r.end) for r in found.collect()} == {("simbolo_dobrado", 9, 11), ("frase_cortada", 4, 6)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    tests = [line for line in plan.split("\n") if "Generate" in line and R.DOUBLED_SYMBOL.pattern in line and "unit = span" in line]
    assert tests and all(line.index("unit = span") < line.index("RLIKE") for line in tests)
