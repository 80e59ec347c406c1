"""The operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import blocks, common, idfiles, jaccard, langid, packing, pivots, pseudonyms, queries, tiktoken_codec, toxicity, voronoi, warc

WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty knoll larch meadow north ochre pine quarry ridge slope tarn umber vale weir yarrow".split()


def prose(seed: int, n: int) -> str:
    own = random.Random(seed)
    return " ".join(own.choice(WORDS) + own.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [(1, base), (2, base), (3, near), (4, prose(2, 90)), (5, None), (6, ""), (7, "a b"), (8, "A  B"), (None, base), (9, prose(3, 30_000)), (4, prose(2, 90)), (10, "\x01 1 \x02")]
    return spark.createDataFrame([(i, t, "en", "s", "x", -1.0) for i, t in rows], "doc_id long, text string, lang string, source string, id string, score double")


def empty(df):
    return df.where("false")


def grams(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard_links_and_classes(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [grams(t) for _, t in rows]
    linked = [[i != j and bool(a) and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    expected = sorted(((i is None, i, sum(row)) for (i, _), row in zip(rows, linked, strict=True)), key=str)
    found = jaccard.similar(docs)
    assert sorted(((r["doc_id"] is None, r["doc_id"], r["n_links"]) for r in found.collect()), key=str) == expected
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[2]["class_id"] == 1 and by_id[3]["component_id"] == 1 and by_id[8]["component_id"] == 7 and by_id[None]["class_id"] == 1
    assert by_id[5]["kept"] and not by_id[3]["kept"] and by_id[6]["n_links"] == 0
    assert jaccard.similar(empty(docs)).count() == 0


def test_jaccard_splits_a_large_group_of_near_copies(spark):
    base = prose(7, 300).split()
    rows = [(i, " ".join([*base[:i], f"own{i}", *base[i + 1 :]])) for i in range(300)]
    found = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}
    assert sum(r["n_links"] for r in found) >= 0.99 * 300 * 299


def test_runs_reach_the_recall():
    assert jaccard.runs_for(0.99) > jaccard.runs_for(0.9) > 0


def test_components_of_a_chain_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(1000)] + [(2000 + i, 2000 + (i + 1) % 500) for i in range(500)]
    roots = {r["node"]: r["root"] for r in blocks.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(1001)} | {2000 + i: 2000 for i in range(500)}


def vectors(spark):
    own = np.random.default_rng(5)
    x = own.normal(size=(300, 16))
    x[100:180] = x[100] + own.normal(size=(80, 16)) * 0.15
    x[200:210] = x[200]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(300, None), (301, [0.0] * 16), (302, [math.nan] * 16), (303, [None] * 16), (304, [1.0, 2.0]), (None, rows[5][1]), (5, rows[5][1])]
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, id int"), rows


def test_pivot_links(spark):
    df, rows = vectors(spark)
    usable = [i for i, (_, v) in enumerate(rows) if v and len(v) == 16 and None not in v and all(map(math.isfinite, v)) and any(v)]
    x = np.array([rows[i][1] for i in usable])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    found = pivots.links(df).collect()
    assert len(found) == len(rows)
    assert sum(r["n_links"] for r in found) >= 0.9 * linked.sum()
    true = {}
    for i, n in zip(usable, linked.sum(1), strict=True):
        true.setdefault(rows[i][0], []).append(int(n))
    assert all(r["n_links"] <= max(true.get(r["vec_id"], [0])) for r in found)
    assert all(r["n_links"] == 0 and r["kept"] for r in found if (r["vec_id"] or 0) >= 300)
    assert pivots.links(empty(df)).count() == 0


def test_top_k_is_exact(spark):
    df, rows = vectors(spark)
    usable = {i: np.floor(64 * np.array(v)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v))}
    expected = set()
    for q in (i for i in usable if i % 20 == 0):
        scored = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:20]
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    found = voronoi.top_k(df, F.col("vec_id") % 20 == 0, 20, 64.0)
    assert {tuple(r) for r in found.collect()} == expected
    assert voronoi.top_k(empty(df), F.col("vec_id") % 20 == 0).count() == 0


def test_language_by_words_and_then_grams(spark):
    rows = [(i, prose(i, 40), "one") for i in range(40)] + [(100 + i, prose(i, 40)[::-1], "two") for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    asked = spark.createDataFrame([(1, "amberbasin tarnvale"), (2, "wxyambr nisabrebma"), (3, None), (4, "12 ½ --"), (5, "")], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(asked, model).collect()}
    assert found[1][0] == "one" and found[2][0] == "two" and all(found[i] == ("und", 0.0) for i in (3, 4, 5))
    nothing = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(False))
    assert langid.identify(asked, nothing).where("lang_pred <> 'und'").count() == 0


def test_language_model_counts_as_brute_force(spark):
    rows = [(i, prose(i, 30), "one") for i in range(12)] + [(50 + i, prose(i, 30)[::-1] + " \u03a3\u00bd 12", "two") for i in range(9)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    words = {x: Counter(w for _, t, lang in rows if lang == x for w in langid.words_of(t)) for x in ("one", "two")}
    for n in range(langid.LONGEST + 1):
        terms = words if n == 0 else {x: Counter() for x in words}
        if n:
            for x, own in words.items():
                for w, k in own.items():
                    terms[x].update({g: k * langid.grams_of(w, n).count(g) for g in set(langid.grams_of(w, n))})
        both = terms["one"] + terms["two"]
        kept = {t for t, k in both.items() if k > 1}
        places, scores = (model.words, model.word_scores) if n == 0 else (model.grams, model.gram_scores)
        assert {t for t in places if n == 0 or len(t) == n} == kept
        total = np.array([sum(terms[x][t] for t in kept) for x in ("one", "two")])
        for t in kept:
            counts = np.array([terms[x][t] for x in ("one", "two")])
            assert np.allclose(scores[places[t]], np.log((counts + langid.SMOOTHING) / (total + langid.SMOOTHING * (len(kept) + 1))))


@pytest.mark.parametrize("kept", [1, 3, 1000])
def test_language_scores_as_brute_force(kept, monkeypatch):
    monkeypatch.setattr(langid, "_KEPT_WORDS", kept)
    terms = sorted({g for w in WORDS for n in range(1, langid.LONGEST + 1) for g in langid.grams_of(w, n) if zlib.crc32(g.encode()) % 3})
    own = np.random.default_rng(5)
    model = langid.Model(("one", "two"), {w: i for i, w in enumerate(WORDS[:8])}, own.normal(size=(8, 2)), {g: i for i, g in enumerate(terms)}, own.normal(size=(len(terms), 2)))

    def by_hand(word: str) -> np.ndarray:
        if word in model.words:
            return model.word_scores[model.words[word]]
        for n in range(langid.LONGEST, 0, -1):
            if found := [model.gram_scores[model.grams[g]] for g in langid.grams_of(word, n) if g in model.grams]:
                return np.mean(found, axis=0)
        return np.zeros(2)

    score = langid.scorer(model)
    for text in ["amber", "q \u4e2d", "Ab umber, weirs-yarrow " * 3, " ".join(WORDS), prose(4, 200), "tarn " + prose(6, 50)]:
        words = langid.words_of(text)
        mean = np.mean([by_hand(w) for w in words], axis=0) * min(len(words), langid.CERTAIN_WORDS)
        odds = np.exp(mean - mean.max())
        lang, certainty = score(text)
        assert lang == model.languages[int(odds.argmax())] and math.isclose(certainty, odds.max() / odds.sum(), rel_tol=1e-9)


def test_toxicity_held_out(spark):
    rows = [(i, prose(i, 60) + (" wretch" if i % 8 == 0 else ""), int(i % 8 == 0)) for i in range(400)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(texts, labels, F.col("doc_id") % 5 != 0)
    found = {r["doc_id"]: r for r in toxicity.score(texts, model).collect()}
    assert all(found[i]["predicted"] == y for i, _, y in rows) and found[900]["predicted"] == 0 and 0 <= found[901]["score"] < 0.5
    blank = toxicity.fit(texts, labels.where("toxic = 0"), F.lit(True))
    assert toxicity.score(texts, blank).agg(F.max("score")).first()[0] < 0.5


def test_tiktoken_parts_and_round_trip(docs):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken_codec.encoding(path, P.PATTERN)
    for text in ("a b\n\nc  d " * 900, "x" * 5000, "é　ñ \n q's " * 700, "", " \n" * 400):
        parts = list(tiktoken_codec.parts(text, 64))
        assert "".join(parts) == text and [i for p in parts for i in own.encode_ordinary(p)] == own.encode_ordinary(text)
    found = sorted(map(tuple, tiktoken_codec.digests(docs, path, P.PATTERN).collect()), key=str)
    expected = []
    for r in docs.collect():
        ids = own.encode_ordinary(r["text"] or "")
        expected.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert found == sorted(expected, key=str)
    back = tiktoken_codec.decode(tiktoken_codec.encode(docs.where("doc_id = 3"), path, P.PATTERN), path, P.PATTERN).first()["bytes"]
    assert bytes(back).decode() == docs.where("doc_id = 3").first()["text"]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_ids_of_the_whole_text(name, spaced, monkeypatch):
    monkeypatch.setattr(common, "KEPT_PIECES", 50)
    own, rnd = common.PieceEncoder(queries.tokenizer(name), spaced), random.Random(3)
    signs = ["a", "B", "é", "é", "Σ", "İ", "'s", "'T", " ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", ".", ",!", "***", "|", "12", "½", "中", "🙂", "<|endoftext|>", "\r\n", "word"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 20))) for _ in range(3000)]
    for text, packed in zip(texts, own.packed(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing_covers_every_id_once(docs):
    own = common.PieceEncoder(queries.tokenizer("word_bpe_49k.json"), False)
    whole = {}
    for r in docs.collect():
        whole.setdefault(r["doc_id"], []).append(next(own.packed([r["text"] or ""])) + (2).to_bytes(4, "little"))
    rows = packing.pack(docs, queries.tokenizer("word_bpe_49k.json"), 2).collect()
    for r in rows:
        assert any(zlib.crc32(x[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] and len(x) == 4 * r["doc_tokens"] for x in whole[r["doc_id"]])
    assert sum(r["length"] for r in rows) == sum(len(x) // 4 for v in whole.values() for x in v)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(empty(docs), queries.tokenizer("word_bpe_49k.json"), 2).count() == 0


def test_id_files_round_trip(spark, docs):
    folder = common.new_folder(spark, "ids")
    path = queries.tokenizer("byte_bpe_50k.json")
    own, at, expected = common.PieceEncoder(path, True), 0, []
    for r in docs.orderBy("doc_id", "text").collect():
        ids = next(own.packed([r["text"] or ""])) + (0).to_bytes(4, "little")
        expected.append((r["doc_id"], at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, idfiles.stored(spark, docs, folder, path, 0).collect()), key=lambda r: r[1]) == expected
    assert idfiles.stored(spark, empty(docs), common.new_folder(spark, "ids"), path, 0).count() == 0


def test_warc_round_trip(spark):
    long, same = "é" * 600_000, "x" * 100
    rows = [(5, "u", same), (2, None, same), (9, "u", same), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "http://a/b: c", long), (1, "u", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, payload string")
    found = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(pages, common.new_folder(spark, "warc")).collect()}
    for page, _, html in rows:
        raw = (html or "").encode()
        revisit = html == same and page != 2
        assert found[page] == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None)
    assert warc.round_trip(empty(pages), common.new_folder(spark, "warc")).count() == 0


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_formats_links_and_text(spark):
    values = ["4111111111111111", "4111 1111 1111 1112", "+1 (017) 555-7713", "123-45-6789", "233.254.104.120", "2021-02-28", "31/12/1999", "2021-02-30", "a.b@example.org", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"]
    rows = [(i, f"\x01 say {v}, or {v}!\x02") for i, v in enumerate(values)] + [(90, None), (91, ""), (92, "clean 12 of 3.14"), (93, f"again {values[0]}")]
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymize(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_values int"), "k").collect()}
    new = {}
    for i, v in enumerate(values):
        first, second = re.fullmatch("\x01 say (.*), or (.*)!\x02", out[i]["text"]).groups()
        assert first == second and (first != v or v == "2021-02-30")
        new[i] = first
    assert luhn(new[0]) and not luhn(new[1].replace(" ", "")) and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", new[1])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new[2]) and re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", new[3])
    assert all(0 <= int(x) < 256 for x in new[4].split(".")) and 1900 <= dt.date.fromisoformat(new[5]).year < 2100
    assert dt.datetime.strptime(new[6], "%d/%m/%Y") and new[8].endswith("@mail.invalid") and len(new[9]) == 40
    assert out[93]["text"] == f"again {new[0]}" and out[90]["text"] is None and out[91]["text"] == "" and out[92]["text"] == "clean 12 of 3.14"
    assert out[0]["n_values"] == 2 and out[92]["n_values"] == 0
    cards = spark.range(2000).select(F.concat(F.lit("4111"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("text"))
    assert pseudonyms.pseudonymize(cards, "k").select("text").distinct().count() == 2000
