"""A corpus from documents: five stages, each by one operator of palimpsest.llm.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next one's
documents. All but the last return the columns of documents: a stage removes rows
or changes texts, and later stages see only what it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common as C
from palimpsest.llm import jaccard, langid, packing, pseudonyms, queries, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose language is less certain than this are rejected.
LEAST_CERTAINTY = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters or of no clear language; lang becomes the language found."""
    model = langid.fit(docs, C.remainder("doc_id", 4) != 2)
    known = langid.identify(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_CERTAINTY))
    return known.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that score as toxic."""
    labels = queries.table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, C.remainder("doc_id", 5) != 0)
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, that of the smallest id."""
    kept = jaccard.similar(docs).where("kept").select("doc_id", "text_hash").distinct()
    keyed = docs.withColumn("text_hash", F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_hash") == F.col("k.text_hash"))
    found = keyed.join(kept.alias("k"), same, "left_semi")
    # Rows with the same id and text are the same document, but only one of them may stay.
    return found.dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to pseudonyms; n_chars follows the text."""
    return pseudonyms.pseudonymize(docs, queries.PSEUDONYM_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row per piece."""
    return packing.pack(docs, queries.tokenizer("word_bpe_49k.json"), queries.WORD_END)


STAGES = [("language ID", identified), ("toxicity", civil), ("n-gram Jaccard join", distinct), ("PII", private), ("packing", packed)]
#: Trained models and tokenizers are not for SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
