"""The queries of this subpackage over the given tables, and their SQL twins."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import classlm, idfiles, jaccard, langid, packing, periodic, phrases, pivots, pseudonyms, tiktoken_codec, toxicity, voronoi, warc

#: Keys the pseudonyms of the registered query; a real one comes from a vault.
PSEUDONYM_KEY = "documents of the test tables"
WORD_END, BYTE_END = 2, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    C.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.links(table(spark, sf_dir, "embeddings"), 0.95)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, C.remainder("doc_id", 4) != 2)
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (C.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tiktoken_codec.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), WORD_END)


def op6_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, 64.0)


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(table(spark, sf_dir, "documents"), PSEUDONYM_KEY).select("doc_id", "text", "n_values")


def op8_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), C.new_folder(spark, "warc"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), C.remainder("doc_id", 5) != 0)
    return toxicity.score(docs, model).select("doc_id", (C.remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return idfiles.stored(spark, docs, C.new_folder(spark, "ids"), tokenizer("byte_bpe_50k.json"), BYTE_END)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classlm.fit_score(table(spark, sf_dir, "documents"), C.remainder("doc_id", 7) != 2)
    return found.scores.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _repeating(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One document in ten, by its id's checksum, goes on from some word in periods of a fixed length."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(table(spark, sf_dir, "documents"), _repeating)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pivot_near_dedup, op2_language_id, op3_byte_bpe, op4_ngram_jaccard_join, op5_packing, op6_voronoi_top_k, op7_pseudonyms, op8_warc_chunks, op9_toxicity, op10_id_files, op11_phrase_collocations, op12_class_lm, op13_periodic_runs)
}

#: Components are walked from the links; a pair is compared only if its vectors may reach the threshold.
ORACLE: dict[str, str] = {
    "op1_pivot_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
root AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(r.component_id, e.vec_id) AS component_id, e.vec_id = coalesce(r.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN root r ON r.a = e.vec_id""",
    "op4_ngram_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w),
c AS (SELECT min(doc_id) AS class_id, count(*) AS copies, g, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
t AS (SELECT class_id, n, unnest(g) AS gram FROM c),
shared AS (
  SELECT a.class_id AS a, b.class_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM t a JOIN t b ON a.gram = b.gram AND a.class_id <> b.class_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM shared WHERE 9 * k >= 4 * (na + nb)),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
root AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a),
degree AS (SELECT p.a, sum(c.copies) AS n FROM pairs p JOIN c ON c.class_id = p.b GROUP BY p.a)
SELECT s.doc_id, coalesce(c.class_id, s.doc_id) AS class_id, (coalesce(d.n, 0) + coalesce(c.copies - 1, 0))::BIGINT AS n_links,
  coalesce(r.component_id, c.class_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON len(s.g) > 0 AND list_sort(s.g) = c.g LEFT JOIN degree d ON d.a = c.class_id LEFT JOIN root r ON r.a = c.class_id""",
    "op6_voronoi_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.e) = len(x.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_warc_chunks": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, payload_bytes, d.payload_digest, CASE WHEN f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest""",
    "op11_phrase_collocations": """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, m, unnest(list_transform(range(1, greatest(len(ws) - m + 2, 1)), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM w CROSS JOIN (SELECT unnest([1, 2, 3]) AS m)),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m >= 2 AND a >= 10),
s AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, (1000000 * c.a * c.a) // (x.a * y.a) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:c.m], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS around FROM (
    SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE m = 3 AND k = 1) GROUP BY ALL),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.around IS NULL OR 100 * o.around < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n, score::BIGINT AS score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000""",
}
