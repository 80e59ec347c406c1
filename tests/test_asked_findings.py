"""requests carry the excerpt of a finding, not its paragraph, and their terms come from nearby."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from palimpsest.operators import relations as R
from registry import verdicts as G


def test_requests_carry_their_excerpt_only(spark, tmp_path):
    text = "Uma casa casa velha!! " * 60 + "E " + "x" * 300 + " fim fim."
    spark.createDataFrame([(1, text, "pt", "a", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = G._asked(spark, str(tmp_path)).collect()
    assert len(rows) == 121
    assert {(r.text, r.start, r.end) for r in rows} == {("!!", 0, 2), ("casa casa", 0, 9), ("fim fim", 0, 7)}
    assert {tuple(r.terms) for r in rows} == {("velha", "casa"), ("uma", "velha"), ("uma",), ("x" * 300, "e")}


def test_last_two_words_are_whole(spark):
    text = "Não, " + "longa" * 50 + " e " + "ÉΣ" * 90 + " — fim; " + "." * 250 + " ora 12 tal"
    rows = spark.range(len(text) + 1).select(F.col("id").cast("int").alias("n"), F.lit(text).alias("t")).select("n", F.slice(F.reverse(R.words_before(F.col("t"), F.col("n"))), 1, 2).alias("w"))
    for r in rows.collect():
        assert r.w == [w.lower() for w in re.findall(r"\w+", text[: r.n])[::-1][:2]], r.n
