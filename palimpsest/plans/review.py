"""The review as one composition: text to routed findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings as fnd
from ..operators import policy, rules
from ..operators.segments import SegmentRules, classify_roles, role_spans
from ..sources.documents import global_offsets

COLUMNS = (
    "doc_id paragraph chapter text start end rule category category_code severity confidence confidence_score suggestion source"
).split()


def _shape(df: DataFrame, source: str) -> DataFrame:
    out = df.withColumn("source", F.concat(F.lit(f"{source} · "), F.col("rule")))
    for name in ("suggestion", "category_code"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    out = out.withColumn("category_code", F.coalesce("category_code", "rule"))
    return out.select(*COLUMNS)


def rule_findings(
    classified: DataFrame, lexicon: DataFrame | None = None, catalogue: Sequence[rules.Rule] = rules.SURFACE_RULES
) -> DataFrame:
    """Surface rules, doubled words and missing final punctuation of classified paragraphs."""
    surface = rules.apply_rules(classified, catalogue)
    body = classified.where(~F.exists("roles", lambda s: s["role"] == "titulo"))
    spans = role_spans(body, list(rules.ALL_SCOPES)).withColumnRenamed("start", "base").drop("end")
    doubled = rules.doubled_words(spans, lexicon).select(
        "doc_id", "paragraph", "chapter", F.col("paragraph_text").alias("text"), "start", "end",
        F.lit("palavra_consecutiva").alias("rule"), F.lit("Palavra repetida").alias("category"),
        F.lit("editorial_attention").alias("severity"), F.lit("média").alias("confidence"), F.lit(0.65).alias("confidence_score"),
    )
    ending = rules.missing_final_punctuation(body)
    return (
        _shape(surface, "rules")
        .unionByName(_shape(doubled, "editorial"))
        .unionByName(_shape(ending, "rules"))
    )


def review(paras: DataFrame, measures: DataFrame, lexicon: DataFrame | None = None, segment: SegmentRules = SegmentRules(),
           catalogue: Sequence[rules.Rule] = rules.SURFACE_RULES, limits: policy.Thresholds = policy.Thresholds()) -> DataFrame:
    """Structured paragraphs to findings with range, class, destination and blocking state."""
    placed = global_offsets(paras)
    found = rule_findings(classify_roles(paras, segment), lexicon, catalogue)
    accepted, _ = fnd.standardize(found, placed, "linguistic")
    routed = policy.route(accepted, measures, limits)
    return routed.withColumn("finding_id", fnd.finding_id(routed))


