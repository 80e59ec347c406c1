"""Statistical class, destination and blocking state from a policy kept as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import CHECKER

# ---- fixed values -----------------------------------------------------------------------------
DESTINATIONS = ("diagnostico", "informacao", "pendencia")
ERROR_SEVERITIES = ("confirmed_error", "probable_error")
RULES_WITHOUT_CLASS = ("tempo_verbal", "estrutura", "residuo_edicao", "pontuacao_dialogo", "languagetool")
OBJECTIVE_CLASSES = (
    "crase", "homofonos", "concordancia", "pontuacao_duplicada", "espacamento", "construcao_invalida",
    "que_tonico_interrogativo", "acentuacao_contextual", "virgula_que_nao", "languagetool:ortografia",
    "languagetool:gramatica",
)
AUDIT_RULE, GLOBAL_RULE = "auditoria_ia", "coerencia2_ia"
# -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    """Limits of the policy; the class lists are settings, a few dozen names."""

    minimum_decisions: int = 20
    blocking_precision: float = 0.9
    observation_precision: float = 0.5
    objective_classes: tuple[str, ...] = OBJECTIVE_CLASSES
    audit_routes: tuple[tuple[str, str], ...] = ()
    audit_default: str = "diagnostico"


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def statistical_class(df: DataFrame) -> Column:
    """Stored class, else spelling / grammar of the checker, audit category, category code or rule."""
    source, rule, code, category = (_col(df, c) for c in ("source", "rule", "category_code", "category"))
    unknown = F.lit("desconhecida")
    spelled = F.contains(source, F.lit("MORFOLOGIK")) | F.contains(source, F.lit("SPELLING"))
    present = lambda c: F.when(c != "", c)
    derived = (
        F.when(F.startswith(source, F.lit(CHECKER)), F.when(spelled, "languagetool:ortografia").otherwise("languagetool:gramatica"))
        .when((rule == AUDIT_RULE) & (code != ""), code)
        .when(rule.isin(*RULES_WITHOUT_CLASS), F.coalesce(present(code), present(category), unknown))
        .otherwise(F.coalesce(present(rule), present(code), present(category), unknown))
    )
    return F.coalesce(present(_col(df, "class")), derived)


def route(findings: DataFrame, measures: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Adds ``class``, ``destination`` and ``blocking``.

    ``measures`` (class, confidence, decisions, precision) has one row per measured
    class and confidence; the size estimate decides whether it is broadcast.
    """
    df = findings.withColumn("class", statistical_class(findings))
    measured = measures.select("class", "confidence", F.col("decisions").alias("_n"), F.col("precision").alias("_p"))
    joined = df.join(measured, ["class", "confidence"], "left")
    rule, confidence = _col(df, "rule"), F.col("confidence")
    enough = F.coalesce(F.col("_n") >= limits.minimum_decisions, F.lit(False))
    audit = F.coalesce(rule == AUDIT_RULE, F.lit(False))
    first_route = F.lit(limits.audit_default)
    for name, target in limits.audit_routes:
        first_route = F.when(F.col("class") == name, F.lit(target)).otherwise(first_route)
    own = _col(df, "destination")
    destination = (
        F.when(rule == GLOBAL_RULE, F.when(own.isin("diagnostico", "informacao"), own).otherwise("diagnostico"))
        .when(audit & (confidence == "baixa"), "diagnostico")
        .when(enough, F.when(F.col("_p") < limits.observation_precision, "informacao").otherwise("pendencia"))
        .when(audit, first_route)
        .when(confidence == "baixa", "informacao")
        .otherwise("pendencia")
    )
    objective = F.col("class").isin(*limits.objective_classes)
    blocking = F.coalesce(
        (F.col("_dest") == "pendencia")
        & enough
        & (F.col("_p") >= limits.blocking_precision)
        & objective
        & F.col("severity").isin(*ERROR_SEVERITIES),
        F.lit(False),
    )
    return joined.withColumn("_dest", destination).withColumn("blocking", blocking).withColumn("destination", F.col("_dest")).drop("_dest", "_n", "_p")


def contract_violations(findings: DataFrame) -> DataFrame:
    """Routed findings that break the contract, with the reason."""
    reason = (
        F.when(~F.coalesce(F.col("destination").isin(*DESTINATIONS), F.lit(False)) | F.col("blocking").isNull(), "invalid_destination")
        .when((F.coalesce("class", F.lit("")) == "") | (F.coalesce("rule", F.lit("")) == ""), "no_rule_or_class")
        .when(
            F.col("blocking") & ((F.col("destination") != "pendencia") | ~F.coalesce(F.col("severity").isin(*ERROR_SEVERITIES), F.lit(False))),
            "blocking_without_error",
        )
    )
    return findings.withColumn("violation", reason).where("violation IS NOT NULL")


def tally(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per report: pending, blocking and observations, total and open, and whether the review can close."""
    df = findings.join(decisions.select("doc_id", "finding_id", "decision"), ["doc_id", "finding_id"], "left")
    open_ = F.coalesce("decision", F.lit("Pendente")) == "Pendente"
    target = F.coalesce("destination", F.lit("pendencia"))
    pending, info = target == "pendencia", target == "informacao"
    blocking = pending & F.coalesce("blocking", F.lit(False))
    return (
        df.groupBy("doc_id")
        .agg(
            F.count_if(pending).alias("pending"),
            F.count_if(pending & open_).alias("pending_open"),
            F.count_if(blocking).alias("blocking"),
            F.count_if(blocking & open_).alias("blocking_open"),
            F.count_if(info).alias("observations"),
            F.count_if(info & open_).alias("observations_open"),
        )
        .withColumn("can_close", F.col("blocking_open") == 0)
    )


def closure_applies(closures: DataFrame, reports: DataFrame) -> DataFrame:
    """Closure rows with ``applies``: same text, policy version and missing components."""
    current = reports.select(
        "doc_id", F.col("sha256").alias("_sha"), F.col("policy_version").alias("_policy"), F.coalesce("missing", F.array().cast("array<string>")).alias("_missing")
    )
    own = F.coalesce("missing", F.array().cast("array<string>"))
    return (
        closures.join(current, "doc_id", "left")
        .withColumn(
            "applies",
            F.coalesce(
                (F.col("sha256") == F.col("_sha")) & F.col("policy_version").eqNullSafe(F.col("_policy")) & (own == F.col("_missing")), F.lit(False)
            ),
        )
        .drop("_sha", "_policy", "_missing")
    )


def report_counts(findings: DataFrame) -> DataFrame:
    """Counts per stage, destination and category with their subtotals."""
    return findings.rollup("module", "destination", "category").agg(
        F.count("*").alias("findings"), F.count_if(F.col("blocking")).alias("blocking")
    )
