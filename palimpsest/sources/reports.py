"""Reports, decisions and answers as JSON sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import excerpt

EVIDENCE = (
    "struct<paragraph:int,chapter:string,text:string,start:int,end:int,document:string,type:string,"
    "range:struct<start:bigint,end:bigint>,excerpt:string>"
)
ABSORBED = "struct<id:string,rule:string,classe:string,category:string,source:string,paragraph:int,start:int,end:int>"
FINDING = (
    "struct<id:string,category:string,priority:string,paragraph:int,chapter:string,text:string,start:int,end:int,"
    "reason:string,source:string,rule:string,category_code:string,layer:string,module:string,severity:string,"
    "confidence:string,confidence_score:double,suggestion:string,suggestion_kind:string,message:string,excerpt:string,"
    f"range:struct<start:bigint,end:bigint>,related:array<{EVIDENCE}>,context:array<{EVIDENCE}>,evidence:array<{EVIDENCE}>,"
    f"destino:string,impeditivo:boolean,classe:string,absorvidos:array<{ABSORBED}>,detectores:array<string>>"
)
REPORT = (
    "schema_version int, document string, sha256 string, created string, metadata map<string,string>, "
    f"warnings array<string>, findings array<{FINDING}>"
)
# ---- fixed values -----------------------------------------------------------------------------
MODULES = ("linguistic", "morphosyntactic", "editorial", "global_coherence", "audit")
SEVERITIES = ("confirmed_error", "probable_error", "editorial_attention", "possible_inconsistency", "author_query")
DESTINATIONS = ("diagnostico", "informacao", "pendencia")
# -----------------------------------------------------------------------------------------------


def _range_ok(e: Column) -> Column:
    return F.coalesce((e["start"] >= 0) & (e["end"] >= e["start"]) & (e["end"] <= F.char_length(e["text"])), F.lit(False))


def _valid(f: Column) -> Column:
    optional = lambda value, allowed: value.isNull() | value.isin(*allowed)
    span = f["range"].isNull() | (
        (f["range"]["start"] >= 0) & (f["range"]["end"] - f["range"]["start"] == f["end"] - f["start"])
    )
    marked = f["excerpt"].isNull() | (f["excerpt"] == excerpt(f["text"], f["start"], f["end"]))
    score = f["confidence_score"].isNull() | f["confidence_score"].between(0, 1)
    blocking = ~F.coalesce(f["impeditivo"], F.lit(False)) | (F.coalesce(f["destino"], F.lit("pendencia")) == "pendencia")
    absorbed = f["absorvidos"].isNull() | F.forall(
        f["absorvidos"],
        lambda a: (a["paragraph"] == f["paragraph"]) & (a["start"] >= 0) & (a["end"] >= a["start"]) & (a["end"] <= F.char_length(f["text"])),
    )
    proofs = [f[name].isNull() | F.forall(f[name], _range_ok) for name in ("related", "context")]
    return F.coalesce(
        _range_ok(f)
        & optional(f["module"], MODULES)
        & optional(f["severity"], SEVERITIES)
        & optional(f["destino"], DESTINATIONS)
        & span & marked & score & blocking & absorbed & proofs[0] & proofs[1],
        F.lit(False),
    )


def validate_reports(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): version, hash, unique ids and every offset are checked."""
    ids = F.transform("findings", lambda f: f["id"])
    problem = (
        F.when(~F.coalesce(F.col("schema_version") == 1, F.lit(False)), "version")
        .when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "sha256")
        .when(F.size(F.array_distinct(ids)) != F.size("findings"), "duplicate_ids")
        .when(~F.forall("findings", _valid), "finding")
    )
    checked = raw.withColumn("problem", problem)
    return checked.where("problem IS NULL").drop("problem"), checked.where("problem IS NOT NULL")


def explode_findings(reports: DataFrame) -> DataFrame:
    """One row per finding, keyed by the report hash, in report order."""
    return reports.select("sha256", "document", F.posexplode("findings").alias("report_order", "_f")).select(
        "sha256", "document", "report_order", F.col("_f.id").alias("finding_id"), "_f.*"
    ).drop("id")


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reports, findings, rejected) of a folder of report JSON files."""
    raw = spark.read.schema(REPORT).option("multiLine", True).json(path)
    valid, rejected = validate_reports(raw)
    return valid.drop("findings"), explode_findings(valid), rejected


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A new location only; an existing report is never overwritten."""
    df.write.mode("errorifexists").format(fmt).option("ignoreNullFields", False).save(path)


DECISION_FILE = (
    "schema_version int, sha256 string, document string, decisions map<string,string>, conflitos map<string,array<string>>"
)


def explode_decisions(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, conflicts) of decision records: one row per finding id."""
    decisions = files.select("sha256", F.explode("decisions").alias("finding_id", "decision"))
    conflicts = files.select("sha256", F.explode("conflitos").alias("finding_id", "_c")).select(
        "sha256", "finding_id", F.explode("_c").alias("conflict")
    )
    return decisions, conflicts


def read_decisions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return explode_decisions(spark.read.schema(DECISION_FILE).option("multiLine", True).json(path))


def export_false_positives(df: DataFrame, path: str) -> bool:
    """Writes the rejected findings as JSON with nulls kept; an empty set writes nothing."""
    if df.isEmpty():
        return False
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    return True


FACT = "struct<entidade:string,tipo:string,aspecto:string,valor:string,paragrafo:int,trecho:string,fonte:string>"
SUGGESTION = "struct<paragrafo:int,trecho:string,paragrafo_anterior:int,trecho_anterior:string,explicacao:string>"
ANSWER = f"struct<fatos:array<{FACT}>,conflitos:array<{SUGGESTION}>,_corrupt_record:string>"


def parse_fact_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, suggested conflicts, corrupt rows) of scene answers.

    ``answers``: doc_id, scene, answer (JSON text).
    """
    parsed = answers.withColumn(
        "_a", F.from_json("answer", ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    )
    corrupt = parsed.where(F.col("_a").isNull() | F.col("_a._corrupt_record").isNotNull()).select("doc_id", "scene", "answer")
    good = parsed.where(F.col("_a").isNotNull() & F.col("_a._corrupt_record").isNull())
    facts = good.select("doc_id", "scene", F.explode("_a.fatos").alias("_f")).select(
        "doc_id",
        "scene",
        F.col("_f.entidade").alias("entity"),
        F.col("_f.tipo").alias("kind"),
        F.col("_f.aspecto").alias("aspect"),
        F.col("_f.valor").alias("value"),
        F.col("_f.paragrafo").alias("paragraph"),
        F.col("_f.trecho").alias("excerpt"),
        F.col("_f.fonte").alias("source"),
    )
    conflicts = good.select("doc_id", "scene", F.explode("_a.conflitos").alias("_c")).select(
        "doc_id",
        "scene",
        F.col("_c.paragrafo").alias("paragraph"),
        F.col("_c.trecho").alias("excerpt"),
        F.col("_c.paragrafo_anterior").alias("earlier_paragraph"),
        F.col("_c.trecho_anterior").alias("earlier_excerpt"),
        F.col("_c.explicacao").alias("explanation"),
    )
    return facts, conflicts, corrupt
