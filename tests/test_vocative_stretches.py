"""calls are searched sentence by sentence, and no text moves to the lexicon."""

from __future__ import annotations

from palimpsest.operators import rules as R

SCHEMA = "doc_id long, paragraph int, text string, base int"


def test_no_text_goes_to_the_lexicon(spark):
    lexicon = spark.createDataFrame([("venha", 1), ("achei", 3), ("viu", 9)], "word string, flags int")
    lines = [
        "Achei. Pedro você viu? Ana minha filha venha cá! Sim senhora… Pedro tu",
        "Ele viu Ana minha filha venha. Não senhora, Sim mãe",
        "… Pedro você. Achei você?",
        "Pedro você. Achei você… ",
    ]
    units = spark.createDataFrame([(1, i, t, 10) for i, t in enumerate(lines)], SCHEMA)
    found = R.vocatives(units, lexicon)
    moved = found._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "Join" in moved and "text#" not in moved
    rows = sorted((r.paragraph, r.start, r.end, r.shape, r.excerpt) for r in found.collect())
    assert rows == [
        (0, 17, 22, "call", "Pedro"),
        (0, 33, 48, "apposition", "Ana minha filha"),
        (0, 59, 70, "answer", "Sim senhora"),
        (1, 41, 52, "answer", "Não senhora"),
        (3, 10, 15, "call", "Pedro"),
    ]
