"""Settings, policy, lexicon and annotated corpora as tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import FINITE, FUTURE, NONFINITE, NONVERB, PAST, PRESENT

# ---- fixed values -----------------------------------------------------------------------------
RULES = (
    "tempo_verbal estrutura pontuacao_dialogo palavra_consecutiva frase_duplicada variacao_nome pronome_apos_corte "
    "construcao_invalida pontuacao_duplicada espacamento virgula_que_nao que_tonico_interrogativo coerencia_temporal "
    "acentuacao_contextual vocativo capitalizacao_contextual dialogo_contextual crase homofonos concordancia regencia "
    "virgula_sujeito_verbo correlacao_tempos frase_cortada locucoes residuo_edicao"
).split()
FIRST_RULES = (
    "tempo_verbal estrutura pontuacao_dialogo palavra_consecutiva palavra_proxima frase_duplicada variacao_nome "
    "duracao_suspensao adiamento_amanha referente_proximidade pronome_apos_corte"
).split()
RETIRED_RULES = (
    "memoria_narrativa conflito_habilidade conflito_objeto conflito_cronologia coerencia_generica tratamento "
    "palavra_proxima gerundismo duracao_suspensao adiamento_amanha referente_proximidade referente_contextual"
).split()
SCOPES = ("narracao", "dialogo", "pensamento")
DEFAULTS: dict[str, Any] = {
    "schema_version": 1,
    "rules": {r: True for r in RULES},
    "tense_scopes": ["narracao"],
    "repetition_scopes": list(SCOPES),
    "word_distance": 8,
    "repetition_boundary": "trecho",
    "duplicate_across_paragraphs": True,
    "duplicate_similarity": 1.0,
    "dialogue_dashes": True,
    "quotes_role": "dialogo",
    "italic_thoughts": True,
    "ignored_names": [],
    "chapter_titles": [],
    "chapter_styles": [],
    "chapter_auto": True,
}
# -----------------------------------------------------------------------------------------------


class SettingsError(ValueError):
    """Settings that do not follow the schema."""


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise SettingsError(message)


def validate_settings(value: Mapping[str, Any]) -> dict[str, Any]:
    """Defaults plus the given values; unknown keys and out-of-range values are refused."""
    _need(isinstance(value, Mapping) and value.get("schema_version", 1) == 1, "unsupported settings version")
    _need(not set(value) - set(DEFAULTS), f"unknown settings: {sorted(set(value) - set(DEFAULTS))}")
    given = value.get("rules", {})
    _need(isinstance(given, Mapping) and not set(given) - {*RULES, *RETIRED_RULES}, "unknown rule")
    _need(all(type(v) is bool for v in given.values()), "rule switches are booleans")
    rules = {name: given.get(name, True) for name in RULES}
    if set(FIRST_RULES) <= set(given) and not any(given.values()):
        rules = dict.fromkeys(RULES, False)
    if "residuo_edicao" not in given:
        rules["residuo_edicao"] = rules["estrutura"]
    out = {**DEFAULTS, **value, "rules": rules}
    for key in ("tense_scopes", "repetition_scopes"):
        _need(isinstance(out[key], list) and set(out[key]) <= set(SCOPES), f"invalid scopes: {key}")
    for key in ("dialogue_dashes", "italic_thoughts", "duplicate_across_paragraphs", "chapter_auto"):
        _need(type(out[key]) is bool, f"not a boolean: {key}")
    _need(type(out["word_distance"]) is int and 2 <= out["word_distance"] <= 40, "word_distance must be 2 to 40")
    _need(out["repetition_boundary"] in ("trecho", "frase"), "invalid repetition_boundary")
    similarity = out["duplicate_similarity"]
    _need(type(similarity) in (int, float) and 0.8 <= similarity <= 1, "duplicate_similarity must be 0.8 to 1")
    _need(out["quotes_role"] in SCOPES, "invalid quotes_role")
    for key in ("ignored_names", "chapter_titles", "chapter_styles"):
        names = out[key]
        _need(isinstance(names, list) and len(names) <= 500, f"list too long: {key}")
        _need(all(isinstance(n, str) and n.strip() and len(n) <= 200 for n in names), f"invalid entry: {key}")
    return out


def load_settings(spark: SparkSession, value: Mapping[str, Any]) -> DataFrame:
    """Validated settings as ``rule_config`` rows: rule, enabled, scopes."""
    settings = validate_settings(value)
    scopes = {"tempo_verbal": settings["tense_scopes"]}
    for rule in ("palavra_consecutiva", "frase_duplicada"):
        scopes[rule] = settings["repetition_scopes"]
    rows = [(rule, on, list(scopes.get(rule, SCOPES))) for rule, on in settings["rules"].items()]
    return spark.createDataFrame(rows, "rule string, enabled boolean, scopes array<string>")


POLICY_SCHEMA = (
    "versao int, limiares struct<minimo_decisoes:int,impeditivo_precisao:double,observacao_precisao:double>, "
    "natureza_objetiva array<string>, medicoes map<string,struct<decisoes:bigint,precisao:double>>, "
    "auditoria struct<destino_inicial:map<string,string>,padrao:string>"
)


def load_policy(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Policy JSON as tables: thresholds, measures (class, confidence), objective classes and audit routes."""
    raw = spark.read.schema(POLICY_SCHEMA).option("multiLine", True).json(path)
    measure = raw.select(F.explode("medicoes").alias("_k", "_v"))
    return {
        "thresholds": raw.select("versao", "limiares.*"),
        "measures": measure.select(
            F.split_part("_k", F.lit("|"), F.lit(1)).alias("class"),
            F.split_part("_k", F.lit("|"), F.lit(2)).alias("confidence"),
            F.col("_v.decisoes").alias("decisions"),
            F.col("_v.precisao").alias("precision"),
        ),
        "objective": raw.select(F.explode("natureza_objetiva").alias("class")),
        "routes": raw.select(F.explode("auditoria.destino_inicial").alias("class", "destination")),
    }


def build_lexicon(word_lines: DataFrame, verb_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lexicon, malformed): flags are the OR of every source row of a word.

    ``word_lines``: value (``word,TAG TAG``); ``verb_rows``: word, lemma, features
    (``VerbForm=Fin|Mood=Ind|Tense=Past``), verbs and auxiliaries together.
    """
    lines = word_lines.where(F.trim("value") != "")
    good = F.contains("value", F.lit(","))
    tags = F.filter(F.split(F.regexp_extract("value", r"^.*,(.*)$", 1), r"\s+"), lambda t: t != "")
    other = F.size(F.array_except(tags, F.array(F.lit("VERB"), F.lit("AUX")))) > 0
    nouns = lines.where(good).select(
        F.lower(F.regexp_extract("value", r"^(.*),", 1)).alias("word"), F.when(other, NONVERB).otherwise(0).alias("_f")
    )
    feats = F.str_to_map("features", F.lit(r"[|]"), F.lit("="))
    tense = F.try_element_at(feats, F.lit("Tense"))
    indicative = F.try_element_at(feats, F.lit("Mood")) == "Ind"
    when = (
        F.when(tense.isin("Past", "Imp", "Pqp"), PAST).when(tense == "Pres", PRESENT).when(tense == "Fut", FUTURE).otherwise(0)
    )
    finite = F.coalesce(F.try_element_at(feats, F.lit("VerbForm")) == "Fin", F.lit(False))
    verbs = verb_rows.select(
        F.lower("word").alias("word"),
        F.when(finite, F.lit(FINITE).bitwiseOR(F.when(indicative, when).otherwise(0))).otherwise(NONFINITE).alias("_f"),
    )
    lexicon = nouns.unionByName(verbs).groupBy("word").agg(F.bit_or("_f").alias("flags"))
    return lexicon, lines.where(~good).select(F.col("value").alias("text"))


GOLD_SCHEMA = (
    "schema_version int, conjunto string, descricao string, textos array<struct<id:string,tempo:string,controle:boolean,"
    "paragrafos:array<string>,erros:array<struct<p:int,trecho:string,n:int,categoria:string,camada:string>>,"
    "aceitaveis:array<struct<p:int,trecho:string,n:int>>>>"
)


def read_gold(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Annotated corpus: paragraphs, errors and tolerated spans, keyed by text id."""
    raw = spark.read.schema(GOLD_SCHEMA).option("multiLine", True).json(path).where("schema_version = 1")
    texts = raw.select("conjunto", F.explode("textos").alias("t"))
    key = F.col("t.id").alias("doc_id")
    return {
        "paragraphs": texts.select(
            key, F.coalesce("t.controle", F.lit(False)).alias("control"), F.posexplode("t.paragrafos").alias("_p", "text")
        ).select("doc_id", "control", (F.col("_p") + 1).alias("paragraph"), "text"),
        "errors": texts.select(key, F.posexplode("t.erros").alias("error_id", "_e")).select(
            "doc_id", "error_id", F.col("_e.p").alias("paragraph"), F.col("_e.trecho").alias("excerpt"),
            F.coalesce("_e.n", F.lit(1)).alias("n"), F.col("_e.categoria").alias("category"), F.col("_e.camada").alias("layer"),
        ),
        "tolerated": texts.select(key, F.posexplode("t.aceitaveis").alias("tolerated_id", "_e")).select(
            "doc_id", "tolerated_id", F.col("_e.p").alias("paragraph"), F.col("_e.trecho").alias("excerpt"), F.coalesce("_e.n", F.lit(1)).alias("n")
        ),
    }
