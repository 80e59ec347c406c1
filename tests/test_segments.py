from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import segments as G

PARAS = "doc_id long, paragraph int, text string, heading boolean"


def roles(spark, lines, rules=G.SegmentRules(), headings=()):
    rows = [(1, i, t, i in headings) for i, t in enumerate(lines, 1)]
    out = G.classify_roles(spark.createDataFrame(rows, PARAS), rules).orderBy("paragraph").collect()
    return [[(r.text[s["start"]:s["end"]], s["role"]) for s in r.roles] for r in out]


def test_dash_turns(spark):
    (line,) = roles(spark, ["— Vamos — disse ela. — Agora."])
    assert line == [
        ("—", "separador"), (" Vamos ", "dialogo"), ("—", "separador"), (" disse ela. ", "narracao"), ("—", "separador"), (" Agora.", "dialogo")
    ]


def test_hyphen_needs_spaces(spark):
    (line,) = roles(spark, ["- Bem-vindo - disse ela."])
    assert [r for _, r in line] == ["separador", "dialogo", "separador", "narracao"]


def test_open_speech_continues_only_when_closed(spark):
    (line,) = roles(spark, ["— Vamos\npara casa — disse ela"])
    assert ("para casa ", "dialogo") in [(t.strip("\n"), r) for t, r in line] or ("para casa ", "dialogo") in line
    (line,) = roles(spark, ["— Vamos\nEla saiu."])
    assert line[-1][1] == "narracao"


def test_quotes_cross_paragraphs_and_stop_at_headings(spark):
    out = roles(spark, ["Ele disse “vou", "embora” e saiu.", "“aberta", "TÍTULO", "fim"], headings={4})
    assert out[0] == [("Ele disse ", "narracao"), ("“", "separador"), ("vou", "dialogo")]
    assert out[1] == [("embora", "dialogo"), ("”", "separador"), (" e saiu.", "narracao")]
    assert out[3] == [("TÍTULO", "titulo")]
    assert out[4] == [("fim", "narracao")]


def test_restart_after_unclosed_quote(spark):
    out = roles(spark, ["“aberta", "“Sim” disse."])
    assert out[1] == [("“", "separador"), ("Sim", "dialogo"), ("”", "separador"), (" disse.", "narracao")]


def test_roles_tile_and_mask_keeps_length(spark):
    rng = random.Random(7)
    lines = ["".join(rng.choice("ab —“”\"-‘’.") for _ in range(rng.randint(1, 60))) + "x" for _ in range(40)]
    df = spark.createDataFrame([(1, i, t, False) for i, t in enumerate(lines, 1)], PARAS)
    out = G.classify_roles(df).withColumn("mask", G.mask_text(F.col("text"), F.col("roles"), ["narracao"])).collect()
    for r in out:
        assert r.roles[0]["start"] == 0 and r.roles[-1]["end"] == len(r.text)
        assert all(a["end"] == b["start"] and a["role"] != b["role"] for a, b in zip(r.roles, r.roles[1:]))
        assert len(r.mask) == len(r.text)


def walk_quotes(lines):
    """Character by character: the state of quotations at the end of each line."""
    pairs = {"“": "”", "«": "»", '"': '"', "‘": "’"}
    back = {v: k for k, v in pairs.items()}
    state, out = "", []
    for text in lines:
        body = text.lstrip()
        if state and body.startswith(back[state]) and state in body[1:]:
            state = ""
        for c in text:
            if state:
                state = "" if c == state else state
            else:
                state = pairs.get(c, "")
        out.append(state)
    return out


def test_quote_state_equals_walk(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice("ab “”\"«»‘’") for _ in range(rng.randint(1, 12))) + "." for _ in range(120)]
    df = spark.createDataFrame([(1, i, t, False) for i, t in enumerate(lines, 1)], PARAS)
    rows = G.quote_state(df).orderBy("paragraph").collect()
    assert ["", "”", "»", '"', "’"] and [["", "”", "»", '"', "’"][r.exit] for r in rows] == walk_quotes(lines)


@pytest.mark.parametrize("cap", [5, 12])
def test_scenes_equal_loop(spark, cap):
    rng = random.Random(cap)
    lines = [rng.choice(["***", "x" * rng.randint(1, 9)]) for _ in range(60)]
    df = spark.createDataFrame([(1, i, t, False) for i, t in enumerate(lines, 1)], PARAS).withColumn("chapter", F.lit("c"))
    got = {r.paragraph: r.scene for r in G.scenes(df, cap).collect()}
    number, size, open_, expected = 0, 0, False, {}
    for i, t in enumerate(lines, 1):
        if t == "***":
            open_ = False
            continue
        if not open_ or size + len(t) > cap:
            number, size, open_ = number + 1, 0, True
        expected[i] = number
        size += len(t)
    assert got == expected


def test_many_spans_of_a_paragraph_stay_linear(spark):
    # Looking through all spans for each of their bounds took minutes for such a line.
    begun = time.perf_counter()
    (line,) = roles(spark, ["— " + "a — b “c” “d, — e” f " * 4_000])
    assert "".join(t for t, _ in line) == "— " + "a — b “c” “d, — e” f " * 4_000
    assert all(a[1] != b[1] for a, b in zip(line, line[1:], strict=False))
    short = roles(spark, ["— " + "a — b “c” “d, — e” f " * 3])[0]
    assert line[: len(short) - 2] == short[:-2]
    assert time.perf_counter() - begun < 60
