"""Cards as 4-6-5 and phone numbers in other than American groups."""

from __future__ import annotations

import re

from palimpsest.llm import pseudonyms

VALUES = ["3782 822463 10005", "3782-822463-10005", "3056 930902 5904", "+33 1 23 45 67 89", "01 23 45 67 89", "01.23.45.67.89", "+49 30 12345678", "+34 612 345 678", "+44 (20) 7946 0958"]
CLEAN = ["12 34 56 78", "+12 345", "01 23 45 67", "1 234 567 890", "3782 82246 10005"]


def shape(text: str) -> str:
    return re.sub("[0-9]", "9", text)


def test_cards_and_phones_in_other_groups(spark):
    rows = list(enumerate(VALUES + CLEAN))
    df = spark.createDataFrame([(i, f"say {v}, or {v}.") for i, v in rows], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymize(df, "k").collect()}
    for i, v in rows:
        first, second = re.fullmatch(r"say (.*), or (.*)\.", out[i]["text"]).groups()
        assert first == second and shape(first) == shape(v), v
        assert (first != v, out[i]["n_values"]) == ((True, 2) if v in VALUES else (False, 0)), v
        assert not v.startswith("+") or first.split()[0] == v.split()[0]
        assert not v.startswith("0") or first[0] == "0"
