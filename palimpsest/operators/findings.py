"""Findings: identity, contract, overlap, consolidation, precedence and edits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt, short_hash

# ---- fixed values -----------------------------------------------------------------------------
CHECKER = "LanguageTool"  # source prefix of the external checker's matches
CONFIDENCE_SCORES = {"alta": 0.9, "média": 0.65, "baixa": 0.4}
CATEGORY_CODES = {
    "Tempo verbal": "narrative_tense",
    "Estrutura da frase": "sentence_structure",
    "Pontuação de diálogo": "dialogue_punctuation",
    "Palavra repetida": "repetition",
    "Ortografia e gramática": "grammar",
}
LINGUISTIC_MODULES = ("linguistic", "morphosyntactic")
# Phenomenon families: own rules and external rule ids that report the same thing.
FAMILIES = {
    "crase": (("crase",), ("CRASE_CONFUSION", "CRASE_CONFUSION_2", "ERROS_DE_CRASE_MARCOAGPINTO", "SAIR_AS_RUAS")),
    "pontuacao_duplicada": (("pontuacao_duplicada",), ("DOUBLE_PUNCTUATION", "DOUBLE_PUNCTUATION_XML")),
    "espacamento": (
        ("espacamento",),
        ("ESPACO_DUPLO", "WHITESPACE_RULE", "SPACE_BEFORE_PUNCTUATION", "SPACE_BEFORE_PUNCTUATION2", "COMMA_PARENTHESIS_WHITESPACE"),
    ),
    "maiuscula_inicial": (("capitalizacao_contextual",), ("UPPERCASE_SENTENCE_START",)),
    "palavra_duplicada": (("palavra_consecutiva",), ("PORTUGUESE_WORD_REPEAT_RULE", "WORD_REPEAT_RULE")),
}
# Rules that once had no rule name; their old content key is still honoured.
RULES_ADDED_LATER = ("tempo_verbal", "estrutura", "residuo_edicao", "pontuacao_dialogo", "languagetool")
# -----------------------------------------------------------------------------------------------


def _mapped(value: Column, pairs: Mapping[str, object]) -> Column:
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.try_element_at(F.create_map(*flat), value)


def finding_id(df: DataFrame) -> Column:
    """16 hexadecimal digits from paragraph, category, source, range and text."""
    fields = [F.col("paragraph").cast("string"), F.col("category"), F.col("source"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("text")]
    own = short_hash(F.concat_ws(":", *fields))
    if "related" not in df.columns:
        return own
    evidence = F.to_json("related", {"ignoreNullFields": "false"})
    return F.when(F.size("related") > 0, short_hash(F.concat(own, evidence))).otherwise(own)


def content_key(df: DataFrame, with_rule: bool = True) -> Column:
    """Identity by content only (no paragraph number, no chapter)."""
    parts = [F.col("category"), F.col("source"), F.col("text"), F.col("start"), F.col("end")]
    if with_rule:
        parts.insert(1, F.col("rule"))
    if "related" in df.columns:
        parts.append(F.transform("related", lambda e: F.struct(e["text"].alias("text"), e["start"].alias("start"), e["end"].alias("end"), e["document"].alias("document"))).alias("related"))
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def legacy_content_key(df: DataFrame) -> Column:
    """The key before rules were recorded, only for the rules that gained a name later."""
    return F.when(F.col("rule").isin(*RULES_ADDED_LATER), content_key(df, with_rule=False))


def standardize(findings: DataFrame, paras: DataFrame, module: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): defaults, document range and excerpt; ranges that do not match the text are set apart.

    ``paras`` carries ``doc_start`` (see ``global_offsets``).
    """
    truth = paras.select("doc_id", "paragraph", F.col("text").alias("_text"), F.col("chapter").alias("_chapter"), "doc_start")
    columns = findings.columns
    have = lambda name: F.col(name) if name in columns else F.lit(None)
    severity = (
        F.when(have("rule").isin("duracao_suspensao", "adiamento_amanha"), "possible_inconsistency")
        .when(have("rule").isin("referente_proximidade", "pronome_apos_corte"), "author_query")
        .when(F.startswith("source", F.lit(CHECKER)), "probable_error")
        .otherwise(F.coalesce(have("severity"), F.lit("editorial_attention")))
    )
    confidence = F.coalesce(have("confidence"), F.lit("média"))
    joined = findings.join(truth, ["doc_id", "paragraph"], "left")
    valid = F.coalesce(
        (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.char_length("_text")) & (F.col("text") == F.col("_text")),
        F.lit(False),
    )
    shaped = (
        joined.withColumn("_ok", valid)
        .withColumn("severity", severity)
        .withColumn("confidence", confidence)
        .withColumn("confidence_score", F.coalesce(have("confidence_score").cast("double"), _mapped(F.col("confidence"), CONFIDENCE_SCORES)))
        .withColumn("module", F.lit(module))
        .withColumn(
            "category_code",
            F.coalesce(have("category_code"), have("rule"), _mapped(F.col("category"), CATEGORY_CODES), F.lit("editorial_review")),
        )
        .withColumn("layer", F.coalesce(have("layer"), F.lit("linguistica" if module in LINGUISTIC_MODULES else "editorial")))
        .withColumn("suggestion", have("suggestion").cast("string"))
        .withColumn("chapter", F.coalesce(have("chapter"), F.col("_chapter")))
        .withColumn("range_start", F.col("doc_start") + F.col("start"))
        .withColumn("range_end", F.col("doc_start") + F.col("end"))
        .withColumn("excerpt", excerpt(F.col("text"), F.col("start"), F.col("end")))
        .drop("_text", "_chapter", "doc_start")
    )
    accepted = shaped.where("_ok").drop("_ok")
    rejected = shaped.where("NOT _ok").select("doc_id", "module", F.coalesce(have("rule"), F.col("category")).alias("rule"), "paragraph", "start", "end")
    return accepted, rejected


def verify_related(findings: DataFrame, paras: DataFrame) -> DataFrame:
    """Findings whose every related evidence matches the current text."""
    proofs = findings.select("doc_id", "finding_id", F.explode("related").alias("_e")).where("_e.document = 'atual'")
    truth = paras.select("doc_id", "paragraph", F.col("text").alias("_text"))
    bad = (
        proofs.select("doc_id", "finding_id", F.col("_e.paragraph").alias("paragraph"), "_e")
        .join(truth, ["doc_id", "paragraph"])
        .where((F.col("_e.text") != F.col("_text")) | (F.col("_e.start") < 0) | (F.col("_e.start") > F.col("_e.end")) | (F.col("_e.end") > F.char_length("_text")))
        .select("doc_id", "finding_id")
    )
    return findings.join(bad, ["doc_id", "finding_id"], "left_anti")


def _pairs(a: DataFrame, b: DataFrame, condition: Column, how: str) -> DataFrame:
    left, right = a.alias("a"), b.alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.paragraph") == F.col("b.paragraph"))
    return left.join(right, same & condition, how)


def overlap_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Same document and paragraph and at least one shared character (touching ranges do not overlap).

    Sides are aliased ``a`` and ``b``.  The equi-key is the paragraph, so the
    range test only meets findings of one paragraph.
    """
    return _pairs(a, b, (F.col("b.start") < F.col("a.end")) & (F.col("a.start") < F.col("b.end")), how)


def containment_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """``a`` lies inside ``b``."""
    return _pairs(a, b, (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end")), how)


def from_checker(source: Column) -> Column:
    return F.startswith(source, F.lit(CHECKER))


def checker_rule(source: Column) -> Column:
    return F.element_at(F.split(source, " · "), -1)


def family(source: Column, rule: Column) -> Column:
    """Phenomenon family of a finding, own or external; null outside every family."""
    own = {r: name for name, (mine, _) in FAMILIES.items() for r in mine}
    external = {r: name for name, (_, theirs) in FAMILIES.items() for r in theirs}
    return F.when(from_checker(source), _mapped(checker_rule(source), external)).otherwise(_mapped(rule, own))


def corrected_text(source: Column, rule: Column, text: Column, start: Column, end: Column, suggestion: Column) -> Column:
    """Paragraph after the proposed correction; a doubled word is corrected by keeping one of the two."""
    marked = excerpt(text, start, end)
    kept = F.when(~from_checker(source) & (rule == "palavra_consecutiva"), F.regexp_extract(marked, r"\S+", 0))
    proposal = F.coalesce(suggestion, F.when(kept != "", kept))
    return F.concat(F.substring(text, F.lit(1), start), proposal, F.substring(text, end + 1, F.char_length(text)))


def corrected_digest() -> Column:
    """Digest of the corrected paragraph, for findings of a family."""
    fixed = corrected_text(*[F.col(c) for c in ("source", "rule", "text", "start", "end", "suggestion")])
    return F.when(family(F.col("source"), F.col("rule")).isNotNull(), F.sha2(fixed, 256))


def consolidate(findings: DataFrame) -> DataFrame:
    """Own and external findings of the same family, range and correction become one.

    The first own finding in report order (``report_order``) absorbs; it keeps its
    identity and gains ``absorbed`` (id and source of each) and ``detectors``.  ``findings`` may have ``corrected``
    (see ``corrected_digest``) instead of the text.
    """
    fam = family(F.col("source"), F.col("rule"))
    fixed = F.col("corrected") if "corrected" in findings.columns else corrected_digest()
    light = findings.withColumn("_family", fam).where(F.col("_family").isNotNull()).select(
        "doc_id", "paragraph", "finding_id", "report_order", "source", "start", "end", "_family", fixed.alias("_fixed")
    ).where(F.col("_fixed").isNotNull())
    own, external = light.where(~from_checker(F.col("source"))), light.where(from_checker(F.col("source")))
    same = (F.col("a._family") == F.col("b._family")) & (F.col("a._fixed") == F.col("b._fixed"))
    matched = overlap_join(external, own).where(same)
    chosen = matched.groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.finding_id").alias("absorbed_id")).agg(
        F.min(F.struct(F.col("b.report_order"), F.col("b.finding_id").alias("finding_id"))).alias("_owner"),
        F.min(F.struct(F.col("a.report_order").alias("o"), F.col("a.source").alias("source"))).alias("_self"),
    )
    absorbed = chosen.groupBy("doc_id", F.col("_owner.finding_id").alias("finding_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_self.o").alias("report_order"), F.col("absorbed_id").alias("id"), F.col("_self.source").alias("source")))).alias("absorbed")
    )
    gone = chosen.select("doc_id", F.col("absorbed_id").alias("finding_id"))
    kept = findings.join(gone, ["doc_id", "finding_id"], "left_anti").join(absorbed, ["doc_id", "finding_id"], "left")
    empty = F.array().cast("array<struct<report_order:bigint,id:string,source:string>>")
    return kept.withColumn("absorbed", F.coalesce(F.col("absorbed").cast("array<struct<report_order:bigint,id:string,source:string>>"), empty)).withColumn(
        "detectors", F.array_distinct(F.concat(F.array("source"), F.transform("absorbed", lambda a: a["source"])))
    )


def drop_tense_mirrors(relations: DataFrame, tense: DataFrame, narrative_form: str) -> DataFrame:
    """Relations whose target keeps the narrative tense and whose related range is already a tense finding fall.

    ``relations`` has ``target_form`` and ``related``.
    """
    marked = tense.where(F.col("category") == "Tempo verbal").select("doc_id", "paragraph", "start", "end").distinct()
    mirrored = (
        relations.where(F.col("target_form") == narrative_form)
        .select("doc_id", "finding_id", F.explode("related").alias("_e"))
        .select("doc_id", "finding_id", F.col("_e.paragraph").alias("paragraph"), F.col("_e.start").alias("start"), F.col("_e.end").alias("end"))
        .join(marked, ["doc_id", "paragraph", "start", "end"], "left_semi")
        .select("doc_id", "finding_id")
        .distinct()
    )
    return relations.join(mirrored, ["doc_id", "finding_id"], "left_anti")


def drop_tense_under_relation(tense: DataFrame, relations: DataFrame) -> DataFrame:
    """Tense findings that lie inside the range of a relation fall; other findings stay."""
    covered = containment_join(tense, relations, "left_anti")
    general = tense.where(F.col("category") != "Tempo verbal")
    return covered.where(F.col("category") == "Tempo verbal").unionByName(general)


def merge_batches(batches: DataFrame, key: str = "finding_id") -> tuple[DataFrame, DataFrame]:
    """(kept, conflicts): one row per id; the same id with different content is an error row."""
    content = F.xxhash64(*[c for c in batches.columns if c != key])
    grouped = batches.groupBy(key).agg(F.min(content).alias("_lo"), F.max(content).alias("_hi"))
    conflicts = grouped.where("_lo <> _hi").select(key)
    kept = batches.dropDuplicates().join(conflicts, key, "left_anti")
    return kept, conflicts


def precedence_dedup(findings: DataFrame, ranking: Sequence[str], column: str = "relation") -> DataFrame:
    """One finding per range: the lowest rank, then the earliest; unlisted names come last."""
    position = F.array_position(F.array(*[F.lit(r) for r in ranking]), F.col(column)).cast("int")
    rank = F.when(F.coalesce(position, F.lit(0)) == 0, F.lit(len(ranking) + 1)).otherwise(position)
    keys = ["doc_id", "paragraph", "start", "end"]
    payload = F.struct(*[c for c in findings.columns if c not in keys])
    best = findings.withColumn("_rank", rank).groupBy(*keys).agg(F.min_by(payload, F.struct("_rank", "report_order")).alias("_p"))
    return best.select(*keys, "_p.*")


def first_per_span(findings: DataFrame, order: Sequence[str] = ("rule_order",)) -> DataFrame:
    """One finding per range, the earliest rule wins."""
    keys = ["doc_id", "paragraph", "start", "end"]
    payload = F.struct(*[c for c in findings.columns if c not in keys])
    return findings.groupBy(*keys).agg(F.min_by(payload, F.struct(*order)).alias("_p")).select(*keys, "_p.*")


def relocate(findings: DataFrame, paras: DataFrame) -> DataFrame:
    """Adds ``situation`` and ``new_paragraph`` against another version of the document.

    Intact at the same number, else the only identical paragraph, else changed or not located.
    """
    body = paras.where(~F.col("heading"))
    same = body.select("doc_id", "paragraph", F.col("text").alias("_there"))
    twins = body.groupBy("doc_id", F.xxhash64("text").alias("_h"), "text").agg(F.count("*").alias("_n"), F.min("paragraph").alias("_at"))
    valid = (F.col("text") != "") & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.char_length("text"))
    return (
        findings.join(same, ["doc_id", "paragraph"], "left")
        .withColumn("_h", F.xxhash64("text"))
        .join(twins, ["doc_id", "_h", "text"], "left")
        .withColumn(
            "situation",
            F.when(~valid, "nao_localizado")
            .when(F.col("_there") == F.col("text"), "integro")
            .when(F.col("_n") == 1, "relocalizado")
            .when(F.col("_n").isNull(), "trecho_alterado")
            .otherwise("nao_localizado"),
        )
        .withColumn("new_paragraph", F.when(F.col("situation") == "integro", F.col("paragraph")).when(F.col("situation") == "relocalizado", F.col("_at")))
        .drop("_there", "_n", "_at", "_h")
    )


def verify_version(findings: DataFrame, paras: DataFrame, versions: DataFrame, reach: int = 3, allow_partial: bool = True) -> DataFrame:
    """Adds ``level`` or ``reason``: exact hash, partial context, or why the item stays out.

    ``versions`` has ``doc_id``, ``file_sha`` and ``report_sha``; ``findings`` has
    ``context`` (array of structs with ``paragraph`` and ``text``).  Partial needs a
    unique identical paragraph with every recorded neighbour within reach.
    """
    w = Window.partitionBy("doc_id").orderBy("paragraph")
    near = F.collect_list("text").over(w.rowsBetween(-reach, reach))
    around = paras.withColumn("_near", near).groupBy("doc_id", F.xxhash64("text").alias("_h"), "text").agg(
        F.count("*").alias("_n"), F.any_value("_near").alias("_near")
    )
    expected = F.transform(F.filter("context", lambda e: e["paragraph"] != F.col("paragraph")), lambda e: e["text"])
    partial = F.coalesce(
        (F.col("_n") == 1) & (F.size("_expected") > 0) & (F.size(F.array_except("_expected", "_near")) == 0), F.lit(False)
    )
    exact = F.col("report_sha").isNotNull() & (F.col("file_sha") == F.col("report_sha"))
    joined = (
        findings.withColumn("_expected", expected)
        .withColumn("_h", F.xxhash64("text"))
        .join(versions, "doc_id")
        .join(around, ["doc_id", "_h", "text"], "left")
    )
    level = F.when(exact, "versao_confere")
    reason = F.when(exact, F.lit(None))
    if allow_partial:
        level = level.when(partial, "contexto_parcial")
        reason = reason.when(partial, F.lit(None)).otherwise(F.lit("contexto_nao_verificavel"))
    else:
        reason = reason.otherwise(F.lit("versao_do_manuscrito_diferente"))
    return joined.withColumn("level", level).withColumn("reason", reason).drop("_expected", "_h", "_n", "_near")


# ---- edits ------------------------------------------------------------------------------------
def apply_edits(text: Column, edits: Column) -> Column:
    """Text after non-overlapping replacements (array of struct start, end, after), applied right to left."""
    ordered = F.reverse(F.array_sort(F.transform(edits, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["after"].alias("after")))))
    fits = lambda e, size: (e["start"] >= 0) & (e["start"] <= e["end"]) & (e["end"] <= size)
    return F.aggregate(
        ordered,
        text,
        lambda acc, e: F.when(
            fits(e, F.char_length(acc)),
            F.concat(F.substring(acc, F.lit(1), e["start"]), e["after"], F.substring(acc, e["end"] + 1, F.char_length(acc))),
        ).otherwise(acc),
    )


def shift_offset(offset: Column, edits: Column) -> Column:
    """A report offset in the edited text: length changes of the edits that end at or before it."""
    return F.aggregate(
        F.filter(edits, lambda e: e["end"] <= offset),
        offset.cast("int"),
        lambda acc, e: acc + F.char_length(e["after"]) - (e["end"] - e["start"]),
    )


def collides(start: Column, end: Column, edits: Column) -> Column:
    """A new replacement touches one already made."""
    return F.exists(
        edits,
        lambda e: (F.greatest(start, e["start"]) < F.least(end, e["end"]))
        | (start == e["start"])
        | (end == e["end"])
        | ((start == end) & (e["start"] < start) & (start < e["end"])),
    )


def verify_edit(before: DataFrame, after: DataFrame, edits: DataFrame) -> DataFrame:
    """One verdict per edit (doc_id, paragraph, expected): ok, or what went wrong and which other paragraphs changed."""
    cols = [c for c in ("text", "italic") if c in before.columns and c in after.columns]
    old = before.select("doc_id", "paragraph", F.struct(*cols).alias("_old"))
    new = after.select("doc_id", "paragraph", F.struct(*cols).alias("_new"))
    both = old.join(new, ["doc_id", "paragraph"], "full")
    target = edits.join(both, ["doc_id", "paragraph"], "left")
    changed = both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("doc_id", F.col("paragraph").alias("_p"))
    others = (
        edits.select("doc_id", "paragraph")
        .join(changed, "doc_id")
        .where("_p <> paragraph")
        .groupBy("doc_id", "paragraph")
        .agg(F.count("*").alias("others"), F.min("_p").alias("first_other"))
    )
    verdict = (
        F.when(F.col("_old").isNull(), "paragraph_missing")
        .when(~F.coalesce(F.col("_new.text"), F.lit("")).eqNullSafe(F.col("expected")), "unexpected_text")
        .when(F.col("others") > 0, "others_changed")
        .otherwise("ok")
    )
    return (
        target.join(others, ["doc_id", "paragraph"], "left")
        .withColumn("others", F.coalesce("others", F.lit(0)))
        .withColumn("verdict", verdict)
        .drop("_old", "_new", "expected")
    )


def desk_filter(
    findings: DataFrame,
    *,
    layer: str | None = None,
    module: str | None = None,
    severity: str | None = None,
    category: str | None = None,
    decision: str | None = None,
    assessment: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Optional predicates of the review desk over findings joined to their decisions."""
    df = findings
    if layer is not None:
        df = df.where(F.coalesce("layer", F.lit("linguistica")) == layer)
    for name, value in (("module", module), ("severity", severity), ("category", category), ("assessment", assessment)):
        if value is not None:
            df = df.where(F.col(name) == value)
    if decision is not None:
        df = df.where(F.coalesce("decision", F.lit("Pendente")) == decision)
    if search:
        df = df.where(F.contains(F.lower(F.concat_ws(" ", "text", "chapter")), F.lit(search.lower())))
    return df


def desk_order(findings: DataFrame, section: str = "pendencia") -> DataFrame:
    """One destination section, blocking first, text order inside."""
    return findings.where(F.coalesce("destination", F.lit("pendencia")) == section).orderBy(
        F.desc(F.coalesce("blocking", F.lit(False))), "doc_id", "paragraph", "start", "category"
    )

