"""the draw from few rows is the draw from all; words in place are the words of the window form."""

from __future__ import annotations

import hashlib
import random

from palimpsest.functions import spans as S
from palimpsest.operators import metrics as M


def _drawn(rows, strata, per_stratum, per_form):
    out, used = [], set()
    for stratum in strata:
        seen, count, new = {}, {}, []
        digest = lambda r: hashlib.sha256(f"1:{stratum}\x01{r[0]}".encode()).hexdigest()  # noqa: E731, B023
        for item, place, form, names in sorted(rows, key=lambda r: (digest(r), r[0])):
            key = (place, form.lower())
            if stratum in names and item not in used and seen.get(key, 0) < per_form:
                seen[key] = seen.get(key, 0) + 1
                if count.get(place, 0) < per_stratum:
                    count[place] = count.get(place, 0) + 1
                    new.append((item, place, form, stratum))
        used |= {r[0] for r in new}
        out += new
    return sorted(out, key=str)


def test_draw_is_that_from_all_rows(spark):
    r = random.Random(3)
    strata = ("a", "b", "c")
    # Hot forms, a set without a name, few items in one set (all used early), and rows that share an item.
    rows = [(f"i{n}", r.choice(["pt", "en", None]), r.choice(["De", "de", "o", f"w{n % 37}"]), [s for s in strata if r.random() < 0.7]) for n in range(3000)]
    rows += [(f"j{n}", "few", f"f{n}", list(strata)) for n in range(7)] + [("same", "hot", f"h{n}", list(strata)) for n in range(30)]
    rows += [(f"k{n}", "hot", f"h{n}", list(strata)) for n in range(10)]
    frame = spark.createDataFrame(rows, "item_id string, sample_set string, form string, strata array<string>").repartition(4)
    for per_stratum, per_form in ((4, 2), (6, 1)):
        found = M.stratified_sample(frame, strata, per_stratum, per_form)
        got = sorted(map(tuple, found.select("item_id", "sample_set", "stratum").collect()), key=str)
        assert got == sorted([(i, p, s) for i, p, _, s in _drawn(rows, strata, per_stratum, per_form)], key=str)


def test_words_in_place(spark, monkeypatch):
    monkeypatch.setattr(S, "_BATCH", 3)
    texts = ["", "...", "um", " 𝔄 dois, três!", "a b c d e f", "Ⅳ 12 ½x", "fim"]
    rows = spark.createDataFrame([(1 + i % 2, i, t, None if i % 3 else "pt") for i, t in enumerate(texts)], "doc_id long, paragraph int, text string, lang string").repartition(1)
    assert sorted(map(str, S.words_in_place(rows, ["lang"]).collect())) == sorted(map(str, S.words(rows, ["lang"]).collect()))
