"""Alignment on arrays against difflib, and edit scars in long and repetitive documents."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from palimpsest.functions import alignment
from palimpsest.operators import editorial as E


@pytest.mark.parametrize("variety", [2, 8, 40, 300])
def test_blocks_are_those_of_difflib(variety, monkeypatch):
    monkeypatch.setattr(alignment, "FEW_WORDS", -1)
    r = random.Random(variety)
    word = lambda: int(variety * r.random() ** 2)
    for _ in range(150):
        a = [word() for _ in range(r.choice([0, 1, 5, 30, 150, 260, 400]))]
        b = list(a)
        for _ in range(r.randint(0, 8)):
            x = r.randrange(len(b) + 1)
            b[x : x + r.randint(0, 40)] = [word() for _ in range(r.choice([0, 3, 12]))]
        expected = [tuple(m) for m in SequenceMatcher(None, a, b).get_matching_blocks()]
        assert alignment.blocks(np.array(a, np.int64), np.array(b, np.int64)) == expected


def test_scars_by_paragraph(spark):
    """Offsets count code points before lower case, also where that changes the length of a word."""
    schema = "doc_id long, paragraph int, text string, heading boolean, chapter string"
    gone = "A velha casa de pedra ficava no alto da serra coberta de neve."
    old = [(1, 2, f"İa ali. {gone} Eles subiram.", False, "1"), (1, 5, gone, False, "1"), (1, 7, "Nada.", False, "1"), (2, 1, gone, False, "1")]
    new = [(1, 2, "İa ali. Eles subiram.", False, "1"), (1, 7, "Nada 𝔄, disso: isso.", False, "1"), (2, 1, "“" + gone, False, "1")]
    rows = E.edit_scars(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()
    assert sorted((r.doc_id, r.paragraph, r.start, r.end, r.word, r.removed, r.removed_paragraphs) for r in rows) == [
        (1, 2, 8, 12, "eles", 13, [2]),
        (1, 7, 15, 19, "isso", 13, [5]),
    ]
