"""Dates are permuted one to one in every form, over the whole domain."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from palimpsest.llm import pseudonyms

FIRST, DAYS = dt.date(1900, 1, 1), 73_049


def test_all_dates_of_all_forms_are_one_to_one(spark):
    day = F.expr("date_add(date'1900-01-01', CAST(id AS INT))")
    days = spark.range(0, DAYS, 1, 8).withColumn("day", day)
    forms = F.array(*[F.date_format("day", f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "MM/dd/yyyy")])
    docs = days.select("id", F.posexplode(forms).alias("form", "said")).where("form < 3 OR CAST(substr(said, 4, 2) AS INT) > 12")
    out = pseudonyms.pseudonymize(docs.withColumn("text", F.col("said")), "k").toPandas()
    assert len(out) == 3 * DAYS + sum((FIRST + dt.timedelta(i)).day > 12 for i in range(DAYS))
    # No two strings share a pseudonym, so each form's strings are permuted among themselves.
    assert set(out["text"]) == set(out["said"]) and out["text"].nunique() == len(out)
    assert (out["n_values"] == 1).all() and (out["text"] != out["said"]).mean() > 0.99
    # A day has one pseudonym in all forms.
    kinds = {0: "%Y-%m-%d", 1: "%d/%m/%Y", 2: "%d.%m.%Y", 3: "%m/%d/%Y"}
    sample = out[out["id"] % 37 == 0]
    read = [(i, dt.datetime.strptime(t, kinds[f]).date()) for i, f, t in zip(sample["id"], sample["form"], sample["text"], strict=True)]
    assert len(set(read)) == sample["id"].nunique()


def test_days_that_do_not_exist_and_other_shapes_stay(spark):
    said = ["2021-02-30", "31/31/2021", "29/02/2023", "30.02.2000", "00/10/2001", "1899-12-31", "2100-01-01", "13/13/2013"]
    rows = [(i, f"on {v}, then") for i, v in enumerate(said)] + [(90, None), (91, ""), (92, "2020-02-29 " * 5_000)]
    out = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert [out[i] for i in range(len(said))] == [f"on {v}, then" for v in said]
    assert out[90] is None and out[91] == "" and len(set(out[92].split())) == 1 and len(out[92].split()) == 5_000


def test_pseudonyms_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_values int")
    assert pseudonyms.pseudonymize(docs, "k").columns == ["doc_id", "text", "n_values"] and pseudonyms.pseudonymize(docs, "k").count() == 0
