"""Registry of queries and of their SQL twins.

Shared SQL stages are named CTEs; ``with_stages`` prepends the ones a statement
mentions, in dependency order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}  # statements before their shared stages are added
STAGES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of stored texts a partition: its tokens are some 60 times as large while they are sorted.
_PART_BYTES = 4 << 20


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for steps over the tokens of all documents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/documents.parquet")
    stored = files.agg(F.sum("length")).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, -(-stored // _PART_BYTES))


def stage(name: str, sql: str) -> str:
    STAGES[name] = sql.strip()
    return name


def _mentions(sql: str) -> list[str]:
    seen = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql))
    return [name for name in STAGES if name in seen]


def with_stages(sql: str) -> str:
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _mentions(text):
            if name not in order and STAGES[name] is not text:
                visit(STAGES[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    body = ",\n".join(f"{name} AS MATERIALIZED (\n{STAGES[name]}\n)" for name in order)
    own = re.match(r"\s*WITH\s+(?:RECURSIVE\s+)?", sql)
    rest = ", " + sql[own.end():].strip() if own else "\n" + sql.strip()
    return f"WITH RECURSIVE {body}{rest}"


def query(name: str, sql: str | None = None):
    """Register a query and, when given, its SQL twin."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def sql_matches(source: str, pattern: str, keys: str, text: str = "text", carry: str = "") -> str:
    """SQL twin of the match primitive: gaps and hits side by side, offsets as running sums."""
    pat = pattern.replace("'", "''")
    extra = f", {carry}" if carry else ""
    return f"""
SELECT {keys}{extra}, n, (stop - length(hit))::INT AS "start", stop::INT AS "end", hit AS "match" FROM (
  SELECT {keys}{extra}, n, hit, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY {keys} ORDER BY n) AS stop
  FROM (SELECT {keys}{extra}, unnest(range(0, len(gaps)))::INT AS n, unnest(gaps) AS gap, unnest(list_concat(hits, [NULL])) AS hit
        FROM (SELECT {keys}{extra}, string_split_regex({text}, '{pat}') AS gaps, regexp_extract_all({text}, '{pat}') AS hits FROM {source}) a) b
) c WHERE hit IS NOT NULL"""
