"""Findings from the rules: identity, overlap, consolidation, versions, decisions, policy and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import decisions as D
from palimpsest.operators import findings as N
from palimpsest.operators import metrics as M
from palimpsest.operators import policy as P
from palimpsest.operators import rules as R
from palimpsest.plans import review as V
from palimpsest.sources import documents as A
from palimpsest.sources.scratch import written

from .core import query, sql_matches, stage, table
from .rules import checker_matches, lexicon, narration
from .structure import WORD_SQL, paragraphs, words_in_place

CATALOGUE = (R.DOUBLED_SYMBOL, *[r for r in R.GRAMMAR_RULES if r.rule == "frase_cortada"])

# ---- inputs -----------------------------------------------------------------------------------
# Own findings of every document: doubled symbols, open endings, doubled words, missing final stop.
stage("symbol_runs", sql_matches("paragraphs", r"!{2,}|%{2,}|#{2,}|\*{2,}|&{2,}|\${2,}|\|{2,}", "doc_id, paragraph", carry="lang, source, text").replace('"match"', "hit_text"))
stage("plain_words", sql_matches("paragraphs", r"[\p{L}\p{N}_]+", "doc_id, paragraph", carry="lang, source, text").replace('"match"', "word"))
stage(
    "own_raw",
    rf"""SELECT doc_id, paragraph, lang, source AS book, text, "start", "end", 'simbolo_dobrado' AS rule, 'Símbolo dobrado' AS category, 'probable_error' AS severity, 'alta' AS confidence, 0.9::DOUBLE AS confidence_score, substr(hit_text, 1, 1) AS suggestion, 'rules · simbolo_dobrado' AS source FROM symbol_runs
UNION ALL SELECT doc_id, paragraph, lang, source, text, "start", "end", 'frase_cortada', 'Frase cortada', 'probable_error', 'média', 0.75, NULL, 'rules · frase_cortada' FROM plain_words
 WHERE regexp_full_match(lower(word), '(?:{R.OPEN_ENDINGS})') AND regexp_matches(substr(text, "end" + 1), '^\s*(?:[!?]|\.(?:[^.]|$))')
UNION ALL SELECT doc_id, paragraph, lang, source, text, "start", "end", 'palavra_consecutiva', 'Palavra repetida', 'editorial_attention', 'média', 0.65, NULL, 'editorial · palavra_consecutiva' FROM doubled
UNION ALL SELECT doc_id, paragraph, lang, source, text, (length(t) - length(last))::INT, length(t)::INT, 'frase_cortada', 'Pontuação final ausente', 'probable_error', 'média', 0.8, last || '.', 'rules · frase_cortada' FROM (
  SELECT doc_id, paragraph, lang, source, text, t, regexp_extract(t, '{WORD_SQL}$', 0) AS last, list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '') AS parts FROM (SELECT *, rtrim(text) AS t FROM paragraphs) p) q
 WHERE last <> '' AND len(regexp_extract_all(t, '{WORD_SQL}')) >= 4 AND regexp_matches(t, '[\p{{L}}\p{{N}}]$')
  AND NOT (len(parts) >= 2 AND len(list_filter(parts, lambda w: NOT regexp_matches(w, '^[\p{{Lu}}\p{{Nd}}]'))) = 0)""",
)
stage(
    "findings",
    """SELECT *, substr(sha256(concat_ws(':', paragraph, category, source, "start", "end", text)), 1, 16) AS finding_id,
  row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, "start", "end", category) AS report_order FROM own_raw""",
)
stage(
    "decisions",
    """SELECT f.doc_id, f.finding_id, CASE WHEN l.toxic = 1 THEN 'Intencional' WHEN l.quality = 1 THEN 'Falso positivo' ELSE 'Erro confirmado' END AS decision
FROM findings f JOIN labels l USING (doc_id)""",
)
stage(
    "measures",
    """SELECT rule AS class, confidence, count(*) AS decisions, count(*) FILTER (WHERE d.decision = 'Erro confirmado') / count(*) AS precision
FROM findings f JOIN decisions d USING (doc_id, finding_id) GROUP BY rule, confidence""",
)


def own_findings(spark, sf, reading: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """Flat findings with book, identity and report order; ``reading`` adds columns that read the text, before anything moves."""
    lines = paragraphs(spark, sf).withColumnRenamed("source", "book").withColumn("chapter", F.lit(""))
    found = V.rule_findings(narration(lines), None, CATALOGUE)
    # The identity reads the text before anything moves, so a query that needs no text never shuffles it.
    found = reading(found.withColumn("finding_id", N.finding_id(found)))
    info = table(spark, sf, "documents").select("doc_id", "lang", F.col("source").alias("book"))
    named = found.join(info, "doc_id")
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("paragraph", "start", "end", "category")
    return named.withColumn("report_order", F.row_number().over(order).cast("long"))


def light_findings(spark, sf) -> DataFrame:
    """The findings without their text, written once: for queries that meet them with themselves."""
    return written(own_findings(spark, sf).drop("text"), "findings")


def decisions(spark, sf, findings: DataFrame) -> DataFrame:
    labels = table(spark, sf, "labels")
    label = F.when(F.col("toxic") == 1, "Intencional").when(F.col("quality") == 1, "Falso positivo").otherwise("Erro confirmado")
    return findings.select("doc_id", "finding_id").join(labels.select("doc_id", label.alias("decision")), "doc_id")


def measures(findings: DataFrame, decided: DataFrame) -> DataFrame:
    joined = findings.join(decided, ["doc_id", "finding_id"])
    return joined.groupBy(F.col("rule").alias("class"), "confidence").agg(
        F.count("*").alias("decisions"), (F.count_if(F.col("decision") == "Erro confirmado") / F.count("*")).alias("precision")
    )


# Objective classes of this corpus, so that the blocking branch is exercised.
LIMITS = P.Thresholds(blocking_precision=0.3, observation_precision=0.2, objective_classes=("simbolo_dobrado", "frase_cortada"))
stage(
    "routed",
    """SELECT *, destination = 'pendencia' AND coalesce(decisions >= 20 AND precision >= 0.3, false) AND rule IN ('simbolo_dobrado', 'frase_cortada') AND severity IN ('confirmed_error', 'probable_error') AS blocking FROM (
 SELECT f.*, m.decisions, m.precision, CASE WHEN m.decisions >= 20 THEN CASE WHEN m.precision < 0.2 THEN 'informacao' ELSE 'pendencia' END WHEN f.confidence = 'baixa' THEN 'informacao' ELSE 'pendencia' END AS destination
 FROM findings f LEFT JOIN measures m ON m.class = f.rule AND m.confidence = f.confidence) r""",
)


def routed(spark, sf) -> DataFrame:
    """The light findings with measures, destination and blocking state."""
    found = light_findings(spark, sf)
    return P.route(found, measures(found, decisions(spark, sf, found)), LIMITS)


# ---- flagship ---------------------------------------------------------------------------------
@query(
    "review_summary",
    "SELECT rule, lang, destination, count(*) AS findings, count(DISTINCT doc_id) AS documents, count(*) FILTER (WHERE blocking) AS blocking FROM routed GROUP BY rule, lang, destination",
)
def review_summary(spark, sf):
    return routed(spark, sf).groupBy("rule", "lang", "destination").agg(
        F.count("*").alias("findings"), F.count_distinct("doc_id").alias("documents"), F.count_if("blocking").alias("blocking")
    )


# ---- B: identity, desk, edits -----------------------------------------------------------------
@query("b14_desk_filter", """SELECT doc_id, finding_id FROM routed LEFT JOIN decisions USING (doc_id, finding_id) WHERE severity = 'probable_error' AND coalesce(decision, 'Pendente') = 'Pendente' AND contains(lower(text || ' '), 'que')""")
def b14(spark, sf):
    df = routed(spark, sf).join(paragraphs(spark, sf).select("doc_id", "paragraph", "text"), ["doc_id", "paragraph"])
    joined = df.join(decisions(spark, sf, df.drop("text")), ["doc_id", "finding_id"], "left")
    return N.desk_filter(joined, severity="probable_error", decision="Pendente", search="QUE").select("doc_id", "finding_id")


@query("b15_desk_order", """SELECT doc_id, finding_id, row_number() OVER (PARTITION BY doc_id ORDER BY blocking DESC, paragraph, "start", category) AS place FROM routed WHERE destination = 'pendencia'""")
def b15(spark, sf):
    from pyspark.sql import Window

    ordered = N.desk_order(routed(spark, sf))
    w = Window.partitionBy("doc_id").orderBy(F.desc("blocking"), "paragraph", "start", "category")
    return ordered.select("doc_id", "finding_id", F.row_number().over(w).cast("long").alias("place"))


stage(
    "edit_points",
    """SELECT doc_id, paragraph, text, length(text) // 4 AS a, length(text) // 2 AS b, (3 * length(text)) // 4 AS c FROM paragraphs WHERE length(text) >= 8""",
)


@query(
    "b17_apply_edits",
    """SELECT doc_id, paragraph, substr(text, 1, a) || '[x]' || substr(text, a + 2, b - a - 1) || '' || substr(text, b + 3) AS edited, (c + 2 - 2)::INT AS moved FROM edit_points""",
)
def b17(spark, sf):
    quarter = lambda k: F.expr(f"({k} * char_length(text)) div 4").cast("int")
    edit = lambda s, n, after: F.struct(s.alias("start"), (s + n).cast("int").alias("end"), F.lit(after).alias("after"))
    edits = F.array(edit(quarter(1), 1, "[x]"), edit(quarter(2), 2, ""))
    lines = paragraphs(spark, sf).where(F.char_length("text") >= 8)
    return lines.select(
        "doc_id", "paragraph", N.apply_edits(F.col("text"), edits).alias("edited"), N.shift_offset(quarter(3), edits).alias("moved")
    )


@query(
    "b17_minimal_change",
    """SELECT doc_id, paragraph, "start"::INT AS "start", "end"::INT AS "end", after FROM (SELECT doc_id, paragraph, b AS "start", b + 1 AS "end", '⟦⟧' AS after FROM edit_points) e""",
)
def b17b(spark, sf):
    half = F.expr("char_length(text) div 2").cast("int")
    lines = paragraphs(spark, sf).where(F.char_length("text") >= 8)
    changed = F.concat(F.substring("text", F.lit(1), half), F.lit("⟦⟧"), F.substring("text", half + 2, F.char_length("text")))
    return lines.withColumn("_c", T.minimal_change(F.col("text"), changed)).select("doc_id", "paragraph", "_c.start", "_c.end", "_c.after")


@query("b18_finding_ids", 'SELECT doc_id, paragraph, "start", "end", category, finding_id FROM findings')
def b18(spark, sf):
    return own_findings(spark, sf).select("doc_id", "paragraph", "start", "end", "category", "finding_id")


@query(
    "b19_content_groups",
    """SELECT category, rule, count(*) AS groups, sum(n)::BIGINT AS findings, max(n) AS largest FROM (SELECT category, rule, source, text, "start", "end", count(*) AS n FROM findings GROUP BY ALL) g GROUP BY ALL""",
)
def b19(spark, sf):
    found = own_findings(spark, sf)
    keyed = found.withColumn("content_key", N.content_key(found))
    return (
        keyed.groupBy("category", "rule", "content_key").agg(F.count("*").alias("n")).groupBy("category", "rule")
        .agg(F.count("*").alias("groups"), F.sum("n").alias("findings"), F.max("n").alias("largest"))
    )


@query(
    "b20_standardize",
    """SELECT f.doc_id, f.finding_id, (o.doc_start + f."start")::BIGINT AS range_start, (o.doc_start + f."end")::BIGINT AS range_end, substr(f.text, f."start" + 1, f."end" - f."start") AS excerpt, f.confidence_score, f.rule AS category_code
FROM findings f JOIN (SELECT doc_id, paragraph, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY paragraph ROWS UNBOUNDED PRECEDING) - length(text) - 1 AS doc_start FROM paragraphs) o USING (doc_id, paragraph)""",
)
def b20(spark, sf):
    placed = A.global_offsets(paragraphs(spark, sf).withColumn("chapter", F.lit("")))
    accepted, _ = N.standardize(own_findings(spark, sf), placed, "linguistic")
    return accepted.select("doc_id", "finding_id", "range_start", "range_end", "excerpt", "confidence_score", "category_code")


@query(
    "b20_rejected",
    """SELECT f.doc_id, f.paragraph, f.rule, f."start", f."end" FROM findings f JOIN paragraphs p ON p.doc_id = f.doc_id AND p.paragraph = f.paragraph WHERE replace(p.text, 'é', 'e') <> f.text
  UNION ALL SELECT f.doc_id, f.paragraph, f.rule, f."start", f."end" FROM findings f WHERE false""",
)
def b20b(spark, sf):
    """The same findings against a version without one accent: those paragraphs no longer match."""
    changed = paragraphs(spark, sf).withColumn("chapter", F.lit("")).withColumn("text", F.replace("text", F.lit("é"), F.lit("e")))
    _, rejected = N.standardize(own_findings(spark, sf), A.global_offsets(changed), "linguistic")
    return rejected.select("doc_id", "paragraph", "rule", "start", "end")


# ---- E: overlap, consolidation, precedence, versions ------------------------------------------
@query(
    "e09_overlap_join",
    """SELECT a.doc_id, a.finding_id AS a_id, b.finding_id AS b_id FROM findings a JOIN findings b ON a.doc_id = b.doc_id AND a.paragraph = b.paragraph AND b."start" < a."end" AND a."start" < b."end" AND a.rule <> b.rule""",
)
def e09(spark, sf):
    found = own_findings(spark, sf).select("doc_id", "paragraph", "start", "end", "finding_id", "rule")
    return N.overlap_join(found, found).where(F.col("a.rule") != F.col("b.rule")).select(
        F.col("a.doc_id").alias("doc_id"), F.col("a.finding_id").alias("a_id"), F.col("b.finding_id").alias("b_id")
    )


@query(
    "e09_containment_join",
    """SELECT f.doc_id, f.finding_id, s.n AS sentence FROM findings f JOIN sentences s ON f.doc_id = s.doc_id AND f.paragraph = s.paragraph AND s."start" <= f."start" AND f."end" <= s."end\"""",
)
def e09b(spark, sf):
    from palimpsest.functions import spans as S

    found = own_findings(spark, sf).select("doc_id", "paragraph", "start", "end", "finding_id")
    return N.containment_join(found, S.sentences(paragraphs(spark, sf))).select(
        F.col("a.doc_id").alias("doc_id"), F.col("a.finding_id").alias("finding_id"), F.col("b.n").alias("sentence")
    )


stage(
    "mixed",
    """SELECT doc_id, paragraph, text, "start", "end", rule, category, source, suggestion, finding_id, report_order FROM findings
UNION ALL SELECT c.doc_id, c.paragraph, p.text, c."start", c."end", 'languagetool', 'Ortografia e gramática', 'LanguageTool local · ' || c.rule_id, c.replacements[1],
  substr(sha256(concat_ws(':', c.paragraph, 'Ortografia e gramática', 'LanguageTool local · ' || c.rule_id, c."start", c."end", p.text)), 1, 16),
  1000000 + row_number() OVER (PARTITION BY c.doc_id ORDER BY c.paragraph, c."start", c."end", c.rule_id) FROM checker_rows c JOIN paragraphs p USING (doc_id, paragraph)""",
)


def mixed(spark, sf, light: bool = False) -> DataFrame:
    """Own and external findings; ``light`` ones have the digest of the corrected paragraph instead of the text, and are written once."""
    from pyspark.sql import Window

    columns = "doc_id paragraph text start end rule category source suggestion finding_id report_order".split()
    # Texts of light findings are read before the windows and joins, not carried through them.
    reading = lambda df: df.withColumn("corrected", N.corrected_digest()).drop("text") if light else df
    columns = ["corrected" if light and c == "text" else c for c in columns]
    external = (
        checker_matches(spark, sf)
        .join(paragraphs(spark, sf).select("doc_id", "paragraph", "text"), ["doc_id", "paragraph"])
        .withColumn("start", F.col("offset").cast("int"))
        .withColumn("end", (F.col("offset") + F.col("length")).cast("int"))
        .withColumn("rule", F.lit("languagetool"))
        .withColumn("category", F.lit("Ortografia e gramática"))
        .withColumn("source", F.concat(F.lit("LanguageTool local · "), "rule_id"))
        .withColumn("suggestion", F.element_at("replacements", 1))
    )
    w = Window.partitionBy("doc_id").orderBy("paragraph", "start", "end", "rule_id")
    external = reading(external.withColumn("finding_id", N.finding_id(external)))
    external = external.withColumn("report_order", (F.row_number().over(w) + 1000000).cast("long"))
    both = own_findings(spark, sf, reading).select(*columns).unionByName(external.select(*columns))
    return written(both, "findings") if light else both


@query(
    "e10_consolidate",
    """WITH o AS (SELECT *, substr(text, 1, "start") || regexp_extract(substr(text, "start" + 1, "end" - "start"), '\\S+', 0) || substr(text, "end" + 1) AS fixed FROM mixed WHERE rule = 'palavra_consecutiva'),
x AS (SELECT *, substr(text, 1, "start") || suggestion || substr(text, "end" + 1) AS fixed FROM mixed WHERE source = 'LanguageTool local · PORTUGUESE_WORD_REPEAT_RULE'),
m AS (SELECT x.doc_id, x.finding_id AS gone, arg_min(o.finding_id, o.report_order) AS owner FROM x JOIN o ON o.doc_id = x.doc_id AND o.paragraph = x.paragraph AND o."start" < x."end" AND x."start" < o."end" AND o.fixed = x.fixed GROUP BY ALL)
SELECT f.doc_id, f.finding_id, f.source, coalesce(a.n, 0)::INT AS absorbed FROM mixed f LEFT JOIN (SELECT doc_id, owner, count(*) AS n FROM m GROUP BY ALL) a ON a.doc_id = f.doc_id AND a.owner = f.finding_id
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = f.doc_id AND m.gone = f.finding_id)""",
)
def e10(spark, sf):
    return N.consolidate(mixed(spark, sf, light=True)).select("doc_id", "finding_id", "source", F.size("absorbed").alias("absorbed"))


# Tense stand-ins: each doubled word is a tense finding, each open ending a relation that points to the doubled words of its paragraph.
stage(
    "tense_relations",
    """SELECT r.doc_id, r.paragraph, r."start", r."end", r.finding_id, CASE WHEN r."start" % 2 = 0 THEN 'passado' ELSE 'presente' END AS target_form FROM findings r WHERE r.rule = 'simbolo_dobrado'""",
)


def tense(spark, sf) -> tuple[DataFrame, DataFrame]:
    found = own_findings(spark, sf).select("doc_id", "paragraph", "start", "end", "finding_id", "rule", "category")
    marks = found.where(F.col("rule") == "palavra_consecutiva").withColumn("category", F.lit("Tempo verbal"))
    near = marks.groupBy("doc_id", "paragraph").agg(
        F.collect_list(F.struct(F.col("paragraph").alias("paragraph"), F.col("start").alias("start"), F.col("end").alias("end"))).alias("related")
    )
    relations = found.where(F.col("rule") == "simbolo_dobrado").join(near, ["doc_id", "paragraph"], "left").withColumn(
        "target_form", F.when(F.col("start") % 2 == 0, "passado").otherwise("presente")
    )
    return marks, relations.withColumn("related", F.coalesce("related", F.array().cast(near.schema["related"].dataType)))


@query(
    "e11_tense_mirrors",
    """SELECT doc_id, finding_id FROM tense_relations r WHERE NOT (target_form = 'passado' AND EXISTS (SELECT 1 FROM findings t WHERE t.doc_id = r.doc_id AND t.paragraph = r.paragraph AND t.rule = 'palavra_consecutiva'))""",
)
def e11(spark, sf):
    marks, relations = tense(spark, sf)
    return N.drop_tense_mirrors(relations, marks, "passado").select("doc_id", "finding_id")


@query(
    "e12_tense_under_relation",
    """SELECT t.doc_id, t.finding_id FROM findings t WHERE t.rule = 'palavra_consecutiva' AND NOT EXISTS (SELECT 1 FROM sentences r WHERE r.doc_id = t.doc_id AND r.paragraph = t.paragraph AND r.n % 2 = 0 AND r."start" <= t."start" AND t."end" <= r."end")""",
)
def e12(spark, sf):
    from palimpsest.functions import spans as S

    marks, _ = tense(spark, sf)
    even = S.sentences(paragraphs(spark, sf)).where("n % 2 = 0")
    return N.drop_tense_under_relation(marks, even).select("doc_id", "finding_id")


@query(
    "e13_merge_batches",
    """SELECT finding_id, count(DISTINCT (paragraph, "start", "end", category, text)) > 1 AS conflict FROM findings GROUP BY finding_id""",
)
def e13(spark, sf):
    found = own_findings(spark, sf).select("finding_id", "paragraph", "start", "end", "category", "text")
    kept, conflicts = N.merge_batches(found.unionByName(found))
    return kept.select("finding_id", F.lit(False).alias("conflict")).unionByName(conflicts.select("finding_id", F.lit(True).alias("conflict")))


@query(
    "e14_precedence",
    """SELECT doc_id, paragraph, "start", "end", arg_min(rule, (CASE rule WHEN 'palavra_consecutiva' THEN 1 WHEN 'frase_cortada' THEN 2 ELSE 3 END, report_order)) AS rule FROM findings GROUP BY doc_id, paragraph, "start", "end\"""",
)
def e14(spark, sf):
    ranked = N.precedence_dedup(own_findings(spark, sf), ["palavra_consecutiva", "frase_cortada"], "rule")
    return ranked.select("doc_id", "paragraph", "start", "end", "rule")


stage(
    "next_version",
    """SELECT doc_id, paragraph + 1 AS paragraph, CASE WHEN paragraph % 3 = 0 THEN replace(text, 'e', 'é') ELSE text END AS text FROM paragraphs
UNION ALL SELECT doc_id, 1, 'Nova linha.' FROM documents""",
)


def next_version(spark, sf) -> DataFrame:
    """The following version of every document: one new first line and every third paragraph rewritten."""
    lines = paragraphs(spark, sf).select(
        "doc_id",
        (F.col("paragraph") + 1).alias("paragraph"),
        F.when(F.col("paragraph") % 3 == 0, F.replace("text", F.lit("e"), F.lit("é"))).otherwise(F.col("text")).alias("text"),
    )
    first = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("paragraph"), F.lit("Nova linha.").alias("text"))
    return lines.unionByName(first).withColumn("heading", F.lit(False)).withColumn("chapter", F.lit(""))


@query(
    "e15_relocate",
    """SELECT f.doc_id, f.finding_id, CASE WHEN s.text = f.text THEN 'integro' WHEN t.n = 1 THEN 'relocalizado' WHEN t.n IS NULL THEN 'trecho_alterado' ELSE 'nao_localizado' END AS situation,
  CASE WHEN s.text = f.text THEN f.paragraph WHEN t.n = 1 THEN t.at END AS new_paragraph
FROM findings f LEFT JOIN next_version s ON s.doc_id = f.doc_id AND s.paragraph = f.paragraph
LEFT JOIN (SELECT doc_id, text, count(*) AS n, min(paragraph) AS at FROM next_version GROUP BY doc_id, text) t ON t.doc_id = f.doc_id AND t.text = f.text""",
)
def e15(spark, sf):
    return N.relocate(own_findings(spark, sf), next_version(spark, sf)).select("doc_id", "finding_id", "situation", "new_paragraph")


@query(
    "e16_verify_version",
    """WITH around AS (SELECT doc_id, text, count(*) AS n, any_value(near) AS near FROM (SELECT doc_id, text, list(text) OVER (PARTITION BY doc_id ORDER BY paragraph ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM next_version) x GROUP BY doc_id, text),
ctx AS (SELECT doc_id, paragraph, list_filter([lag(text) OVER w, lead(text) OVER w], lambda t: t IS NOT NULL) AS expected FROM paragraphs WINDOW w AS (PARTITION BY doc_id ORDER BY paragraph))
SELECT f.doc_id, f.finding_id, CASE WHEN coalesce(a.n = 1 AND len(c.expected) > 0 AND len(list_filter(c.expected, lambda t: NOT list_contains(a.near, t))) = 0, false) THEN 'contexto_parcial' END AS level
FROM findings f JOIN ctx c USING (doc_id, paragraph) LEFT JOIN around a ON a.doc_id = f.doc_id AND a.text = f.text""",
)
def e16(spark, sf):
    from palimpsest.operators import segments as G

    lines = paragraphs(spark, sf).withColumn("chapter", F.lit(""))
    context = G.context_window(lines, 1, 1).select("doc_id", "paragraph", "context")
    found = own_findings(spark, sf).join(context, ["doc_id", "paragraph"])
    versions = table(spark, sf, "documents").select("doc_id", F.lit("b").alias("file_sha"), F.lit("a").alias("report_sha"))
    return N.verify_version(found, next_version(spark, sf), versions).select("doc_id", "finding_id", "level")


@query(
    "e34_verify_edit",
    """WITH edits AS (SELECT doc_id, min(paragraph) AS paragraph FROM paragraphs GROUP BY doc_id),
later AS (SELECT p.doc_id, p.paragraph, CASE WHEN p.paragraph = e.paragraph THEN p.text || '!' WHEN p.paragraph % 7 = 0 THEN p.text || '?' ELSE p.text END AS text FROM paragraphs p JOIN edits e USING (doc_id))
SELECT e.doc_id, e.paragraph, CASE WHEN count(*) FILTER (WHERE l.text <> p.text AND p.paragraph <> e.paragraph) > 0 THEN 'others_changed' ELSE 'ok' END AS verdict, count(*) FILTER (WHERE l.text <> p.text AND p.paragraph <> e.paragraph) AS others
FROM edits e JOIN paragraphs p ON p.doc_id = e.doc_id JOIN later l ON l.doc_id = p.doc_id AND l.paragraph = p.paragraph GROUP BY ALL""",
)
def e34(spark, sf):
    lines = paragraphs(spark, sf).select("doc_id", "paragraph", "text")
    first = lines.groupBy("doc_id").agg(F.min_by(F.struct("paragraph", "text"), "paragraph").alias("_f"))
    edits = first.select("doc_id", "_f.paragraph", F.concat("_f.text", F.lit("!")).alias("expected"))
    marked = lines.join(edits.select("doc_id", F.col("paragraph").alias("_e")), "doc_id")
    later = marked.select(
        "doc_id",
        "paragraph",
        F.when(F.col("paragraph") == F.col("_e"), F.concat("text", F.lit("!"))).when(F.col("paragraph") % 7 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"),
    )
    return N.verify_edit(lines, later, edits).select("doc_id", "paragraph", "verdict", "others")


# ---- decisions --------------------------------------------------------------------------------
@query("g01_eligible", "SELECT f.doc_id, f.finding_id, d.decision FROM findings f JOIN decisions d USING (doc_id, finding_id) WHERE d.decision IN ('Erro confirmado','Estilo do autor','Falso positivo','Intencional','Aceito editorialmente')")
def g01(spark, sf):
    found = light_findings(spark, sf)
    return D.eligible(found, decisions(spark, sf, found))[0].select("doc_id", "finding_id", "decision")


@query(
    "a17_false_positives",
    """SELECT f.doc_id, f.finding_id AS id, f.report_order, f.rule, f.category, f.severity, f.confidence, f.paragraph, f."start", f."end", substr(f.text, f."start" + 1, f."end" - f."start") AS excerpt, f.suggestion
FROM findings f JOIN decisions d USING (doc_id, finding_id) WHERE d.decision = 'Falso positivo'""",
)
def a17(spark, sf):
    found = own_findings(spark, sf)
    out = D.false_positives(found, decisions(spark, sf, found))
    return out.select("doc_id", "id", "report_order", "rule", "category", "severity", "confidence", "paragraph", "start", "end", "excerpt", "suggestion")


stage(
    "later_findings",
    """SELECT doc_id, CASE WHEN "start" % 5 = 0 THEN finding_id ELSE substr(sha256(finding_id || 'v2'), 1, 16) END AS finding_id, content_key, report_order FROM keyed_findings WHERE "start" % 11 <> 1""",
)
stage("keyed_findings", """SELECT f.*, concat_ws('|', category, rule, source, text, "start", "end") AS content_key, d.decision FROM findings f LEFT JOIN decisions d USING (doc_id, finding_id)""")


def versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(new, old) findings of the same documents: most ids changed, one in eleven offsets gone; ``text`` is a digest."""
    found = own_findings(spark, sf)
    # Keys and digests of the texts are written, so that texts are not carried with every finding.
    keyed = written(found.withColumn("content_key", N.content_key(found)).withColumn("text", F.sha2("text", 256)), "findings")
    found = keyed.select("doc_id", "finding_id")
    old = keyed.join(decisions(spark, sf, found), ["doc_id", "finding_id"], "left")
    fresh = F.when(F.col("start") % 5 == 0, F.col("finding_id")).otherwise(T.short_hash(F.concat("finding_id", F.lit("v2"))))
    return keyed.where("start % 11 <> 1").withColumn("finding_id", fresh), old


@query(
    "e17_inherit_decisions",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, content_key ORDER BY report_order) AS n, count(*) OVER (PARTITION BY doc_id, content_key) AS total FROM keyed_findings),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, content_key ORDER BY report_order) AS n, count(*) OVER (PARTITION BY doc_id, content_key) AS total FROM later_findings)
SELECT w.doc_id, w.finding_id, coalesce(i.decision, o.decision) AS decision FROM w LEFT JOIN keyed_findings i ON i.doc_id = w.doc_id AND i.finding_id = w.finding_id
LEFT JOIN o ON o.doc_id = w.doc_id AND o.content_key = w.content_key AND o.n = w.n AND o.total = w.total""",
)
def e17(spark, sf):
    new, old = versions(spark, sf)
    return D.inherit_decisions(new, old).select("doc_id", "finding_id", "decision")


@query(
    "e31_diff_reports",
    """WITH n AS (SELECT * FROM later_findings), b AS (SELECT doc_id, finding_id FROM findings)
SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, count(b.finding_id) AS before, count(n.finding_id) AS after, count(*) FILTER (WHERE n.finding_id IS NULL) AS gone, count(*) FILTER (WHERE b.finding_id IS NULL) AS entered,
 (count(*) FILTER (WHERE n.finding_id IS NULL) = 0 AND count(*) FILTER (WHERE b.finding_id IS NULL) = 0) AS identical
FROM b FULL JOIN n ON n.doc_id = b.doc_id AND n.finding_id = b.finding_id GROUP BY 1""",
)
def e31(spark, sf):
    new, old = versions(spark, sf)
    return D.diff_reports(old, new).select("doc_id", "before", "after", "gone", "entered", "identical")


@query(
    "e32_overlap_runs",
    """WITH a AS (SELECT * FROM findings WHERE rule = 'palavra_consecutiva'), b AS (SELECT * FROM findings WHERE rule = 'simbolo_dobrado')
SELECT doc_id, finding_id, 'a' AS engine, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b.paragraph = a.paragraph) THEN 'both' ELSE 'only_a' END AS overlap FROM a
UNION ALL SELECT doc_id, finding_id, 'b', CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.paragraph = b.paragraph) THEN 'both' ELSE 'only_b' END FROM b""",
)
def e32(spark, sf):
    found = own_findings(spark, sf).withColumn("paragraphs", F.array("paragraph"))
    side = lambda rule: found.where(F.col("rule") == rule).select("doc_id", "finding_id", "paragraphs")
    return D.overlap_runs(side("palavra_consecutiva"), side("simbolo_dobrado"))


@query(
    "e35_note_state",
    """SELECT f.doc_id, f.finding_id, CASE WHEN w.finding_id IS NULL THEN 'not_located' WHEN f.doc_id % 3 = 0 THEN 'manuscript_changed_intact' WHEN d.decision IS NOT NULL AND d.decision <> 'Erro confirmado' THEN 'decision_changed' ELSE 'current' END AS state
FROM findings f LEFT JOIN later_findings w ON w.doc_id = f.doc_id AND w.finding_id = f.finding_id LEFT JOIN decisions d ON d.doc_id = f.doc_id AND d.finding_id = f.finding_id""",
)
def e35(spark, sf):
    new, old = versions(spark, sf)
    notes = old.select("doc_id", "finding_id", F.lit("s").alias("manuscript_sha"), F.col("text").alias("paragraph_text"), F.lit("x").alias("assessment"), F.lit("Erro confirmado").alias("human_decision"))
    reports = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "t").otherwise("s").alias("sha256"))
    seen = new.select("doc_id", "finding_id", F.lit("x").alias("assessment"))
    return D.note_state(notes, reports, new, seen, old.select("doc_id", "finding_id", "decision")).select("doc_id", "finding_id", "state")


@query(
    "e37_resolve_cases",
    """WITH cases AS (SELECT doc_id || ':' || paragraph || ':' || prefix AS case_id, doc_id, paragraph, prefix FROM (SELECT DISTINCT doc_id, paragraph, substr(text, "start" + 1, 2) AS prefix FROM findings) c),
m AS (SELECT c.case_id, count(f.finding_id) AS matches, min(f.finding_id) AS finding_id, min(c.doc_id) AS doc_id FROM cases c LEFT JOIN findings f ON f.doc_id = c.doc_id AND f.paragraph = c.paragraph AND starts_with(substr(f.text, f."start" + 1, f."end" - f."start"), c.prefix) GROUP BY c.case_id)
SELECT case_id, matches, CASE WHEN matches = 0 THEN 'missing' WHEN matches > 1 THEN 'ambiguous' WHEN count(*) FILTER (WHERE matches = 1) OVER (PARTITION BY doc_id, finding_id) > 1 THEN 'shared' ELSE 'ok' END AS result FROM m""",
)
def e37(spark, sf):
    found = own_findings(spark, sf)
    cases = found.select("doc_id", "paragraph", F.substring("text", F.col("start") + 1, F.lit(2)).alias("prefix")).distinct()
    cases = cases.withColumn("case_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("paragraph").cast("string"), "prefix"))
    return D.resolve_cases(found, cases).select("case_id", "matches", "result")


def reports(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("report_id"), F.concat("source", F.lit(".docx")).alias("document"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("time")
    )


def report_decisions(spark, sf) -> DataFrame:
    found = light_findings(spark, sf)
    decided = found.join(decisions(spark, sf, found), ["doc_id", "finding_id"])
    return decided.select(F.col("doc_id").alias("report_id"), "finding_id", "decision")


@query(
    "e38_seed_memory",
    """SELECT d.doc_id AS report_id, d.source AS book, (SELECT max(o.doc_id) FROM documents o WHERE o.source = d.source AND sha256(o.text) <> sha256(d.text) AND o.doc_id IN (SELECT doc_id FROM decisions)) AS seed FROM documents d""",
)
def e38(spark, sf):
    return D.seed_memory(reports(spark, sf), report_decisions(spark, sf))


@query(
    "f19_retention_plan",
    """WITH newest AS (SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source),
owner AS (SELECT DISTINCT arg_max(x.doc_id, (x.doc_id IN (SELECT doc_id FROM newest), x.doc_id)) OVER (PARTITION BY d.source, x.finding_id) AS doc_id FROM decisions x JOIN documents d USING (doc_id))
SELECT doc_id AS report_id, doc_id IN (SELECT doc_id FROM newest) OR doc_id IN (SELECT doc_id FROM owner) AS keep FROM documents""",
)
def f19(spark, sf):
    described = reports(spark, sf).withColumn("book", D.book_name(F.col("document"))).withColumn("pinned", F.lit(False))
    return D.retention_plan(described, report_decisions(spark, sf)).select("report_id", "keep")


# ---- F: policy and metrics --------------------------------------------------------------------
@query(
    "f01_statistical_class",
    """SELECT CASE WHEN starts_with(source, 'LanguageTool') THEN CASE WHEN contains(source, 'MORFOLOGIK') THEN 'languagetool:ortografia' ELSE 'languagetool:gramatica' END ELSE rule END AS class, count(*) AS findings FROM mixed GROUP BY ALL""",
)
def f01(spark, sf):
    df = mixed(spark, sf)
    return df.groupBy(P.statistical_class(df).alias("class")).agg(F.count("*").alias("findings"))


def ballots(spark, sf) -> DataFrame:
    found = own_findings(spark, sf).withColumn("place", M.vote_place(F.col("text"), F.col("start"), F.col("end"))).drop("text")
    found = written(found.withColumn("report_time", F.col("doc_id")), "findings")
    return M.votes(found, decisions(spark, sf, found))


stage(
    "ballots",
    """SELECT book, class, arg_max(confidence, (doc_id, finding_id)) AS confidence, arg_max(severity, (doc_id, finding_id)) AS severity, arg_max(outcome, (doc_id, finding_id)) AS outcome FROM (
 SELECT f.*, f.rule AS class, CASE d.decision WHEN 'Erro confirmado' THEN 'erro' WHEN 'Falso positivo' THEN 'falso_positivo' WHEN 'Intencional' THEN 'intencional' END AS outcome FROM findings f JOIN decisions d USING (doc_id, finding_id)) v
GROUP BY book, class, text, substr(text, "start" + 1, "end" - "start"), "start\"""",
)


@query(
    "f02_precision_by_class",
    """SELECT class, confidence, count(*) AS decisions, count(*) FILTER (WHERE outcome = 'erro') AS erro, count(*) FILTER (WHERE outcome = 'falso_positivo') AS falso_positivo, 0::BIGINT AS estilo, count(*) FILTER (WHERE outcome = 'intencional') AS intencional, 0::BIGINT AS aceito,
 round_even(count(*) FILTER (WHERE outcome = 'erro') / count(*), 3) AS precision, count(*) >= 20 AS measured, count(*) >= 20 AND count(*) FILTER (WHERE outcome = 'erro') / count(*) >= 0.9 AS reaches_threshold FROM ballots GROUP BY ALL""",
)
def f02(spark, sf):
    return M.precision_by_class(ballots(spark, sf))


@query("f02_severity_histogram", "SELECT class, confidence, severity, count(*) AS decisions FROM ballots GROUP BY ALL")
def f02b(spark, sf):
    return M.severity_histogram(ballots(spark, sf))


@query("f02_precision_by_book", "SELECT book, count(*) AS decisions FROM ballots GROUP BY ALL")
def f02c(spark, sf):
    return M.precision_by_book(ballots(spark, sf))


@query(
    "f03_precision_by_checker_rule",
    """SELECT checker_rule, 'não registrada' AS checker_category, 'não registrado' AS checker_type, class, count(*) AS decisions, count(*) FILTER (WHERE outcome = 'erro') AS erro, count(*) FILTER (WHERE outcome = 'falso_positivo') AS falso_positivo, count(*) FILTER (WHERE outcome = 'intencional') AS intencional,
 round_even(count(*) FILTER (WHERE outcome = 'erro') / count(*), 3) AS precision FROM (
 SELECT CASE WHEN contains(m.source, 'MORFOLOGIK') THEN 'languagetool:ortografia' ELSE 'languagetool:gramatica' END AS class, string_split(m.source, ' · ')[-1] AS checker_rule,
  arg_max(CASE WHEN l.toxic = 1 THEN 'intencional' WHEN l.quality = 1 THEN 'falso_positivo' ELSE 'erro' END, (m.doc_id, m.finding_id)) AS outcome
 FROM mixed m JOIN labels l USING (doc_id) JOIN documents d USING (doc_id) WHERE starts_with(m.source, 'LanguageTool') GROUP BY d.source, class, m.source, m.text, substr(m.text, m."start" + 1, m."end" - m."start"), m."start") b GROUP BY ALL""",
)
def f03(spark, sf):
    found = mixed(spark, sf).withColumn("report_time", F.col("doc_id")).withColumn("confidence", F.lit("média")).withColumn("severity", F.lit("probable_error"))
    # The class separates spelling from grammar; the rule id travels with the vote.
    books = table(spark, sf, "documents").select("doc_id", F.col("source").alias("book"))
    external = found.where(N.from_checker(F.col("source"))).join(books, "doc_id")
    named = external.withColumn("checker_category", F.lit(None).cast("string")).withColumn("checker_type", F.lit(None).cast("string"))
    counted = M.precision_by_checker_rule(M.votes(named, decisions(spark, sf, named)))
    return counted.drop("estilo", "aceito")


@query("f04_destination", "SELECT rule, confidence, destination, count(*) AS findings FROM routed GROUP BY ALL")
def f04(spark, sf):
    return routed(spark, sf).groupBy("rule", "confidence", "destination").agg(F.count("*").alias("findings"))


@query("f05_blocking", "SELECT doc_id, finding_id, blocking FROM routed")
def f05(spark, sf):
    return routed(spark, sf).select("doc_id", "finding_id", "blocking")


@query("f05_contract", "SELECT finding_id, '' AS violation FROM routed WHERE blocking AND severity NOT IN ('confirmed_error', 'probable_error')")
def f05b(spark, sf):
    return P.contract_violations(routed(spark, sf)).select("finding_id", "violation")


@query(
    "f06_tally",
    """SELECT r.doc_id, count(*) FILTER (WHERE destination = 'pendencia') AS pending, count(*) FILTER (WHERE destination = 'pendencia' AND decision IS NULL) AS pending_open, count(*) FILTER (WHERE blocking) AS blocking, count(*) FILTER (WHERE blocking AND decision IS NULL) AS blocking_open,
 count(*) FILTER (WHERE destination = 'informacao') AS observations, count(*) FILTER (WHERE destination = 'informacao' AND decision IS NULL) AS observations_open, count(*) FILTER (WHERE blocking AND decision IS NULL) = 0 AS can_close
FROM routed r LEFT JOIN decisions d ON d.doc_id = r.doc_id AND d.finding_id = r.finding_id GROUP BY r.doc_id""",
)
def f06(spark, sf):
    df = routed(spark, sf)
    return P.tally(df, decisions(spark, sf, df))


@query(
    "f07_report_counts",
    """SELECT 'linguistic' AS module, destination, category, count(*) AS findings, count(*) FILTER (WHERE blocking) AS blocking FROM routed GROUP BY destination, category
UNION ALL SELECT 'linguistic', destination, NULL, count(*), count(*) FILTER (WHERE blocking) FROM routed GROUP BY destination
UNION ALL SELECT 'linguistic', NULL, NULL, count(*), count(*) FILTER (WHERE blocking) FROM routed
UNION ALL SELECT NULL, NULL, NULL, count(*), count(*) FILTER (WHERE blocking) FROM routed""",
)
def f07(spark, sf):
    return P.report_counts(routed(spark, sf).withColumn("module", F.lit("linguistic")))


# Gold: each benchmark sentence found again inside a document is an annotated error.
stage(
    "gold_errors",
    rf"""SELECT DISTINCT s.doc_id, s.paragraph, s.n AS error_id, s."start", s."end" FROM sentences s JOIN (
  SELECT DISTINCT array_to_string(regexp_extract_all(lower(unnest(regexp_extract_all(text, '[^.!?…\n]+[.!?…]*'))), '{WORD_SQL}'), ' ') AS key FROM benchmark) b
 ON b.key = array_to_string(regexp_extract_all(lower(s.sentence), '{WORD_SQL}'), ' ') WHERE len(string_split(b.key, ' ')) >= 6""",
)
stage("gold_tolerated", """SELECT doc_id, paragraph, n AS tolerated_id, "start", "end" FROM sentences WHERE n = 1""")


def gold(spark, sf) -> tuple[DataFrame, DataFrame]:
    from palimpsest.functions import spans as S

    passages = table(spark, sf, "benchmark").select(F.explode(S.match_spans(F.col("text"), S.SENTENCE)).alias("m")).select(T.normalized_words(F.col("m.text")).alias("key")).distinct()
    passages = passages.where(F.size(F.split("key", " ")) >= 6)
    lines = S.sentences(paragraphs(spark, sf)).withColumn("key", T.normalized_words(F.col("sentence")))
    # The sentences are read once; of them only the gold and the tolerated ones are written.
    marked = lines.join(passages.withColumn("gold", F.lit(True)), "key", "left").where("gold OR n = 1")
    marked = written(marked.select("doc_id", "paragraph", "n", "start", "end", "gold"), "sentences")
    errors = marked.where("gold").select("doc_id", "paragraph", F.col("n").alias("error_id"), "start", "end")
    tolerated = marked.where("n = 1").select("doc_id", "paragraph", F.col("n").alias("tolerated_id"), "start", "end")
    return errors, tolerated


stage(
    "judged",
    """SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM gold_errors e WHERE e.doc_id = f.doc_id AND e.paragraph = f.paragraph AND e."start" < f."end" AND f."start" < e."end") THEN 'true'
 WHEN EXISTS (SELECT 1 FROM gold_tolerated e WHERE e.doc_id = f.doc_id AND e.paragraph = f.paragraph AND e."start" < f."end" AND f."start" < e."end") THEN 'neutral' ELSE 'false_alarm' END AS outcome FROM routed f""",
)
stage("scored", """SELECT e.*, EXISTS (SELECT 1 FROM routed f WHERE e.doc_id = f.doc_id AND e.paragraph = f.paragraph AND e."start" < f."end" AND f."start" < e."end") AS found FROM gold_errors e""")


def judged(spark, sf) -> tuple[DataFrame, DataFrame]:
    errors, tolerated = gold(spark, sf)
    return M.match_gold(routed(spark, sf).withColumn("module", F.lit("linguistic")), errors, tolerated)


@query("e18_match_gold", "SELECT doc_id, finding_id, outcome FROM judged")
def e18(spark, sf):
    return judged(spark, sf)[0].select("doc_id", "finding_id", "outcome")


@query("e18_gold_hits", "SELECT doc_id, paragraph, error_id, found FROM scored")
def e18b(spark, sf):
    return judged(spark, sf)[1].select("doc_id", "paragraph", "error_id", "found")


@query(
    "f08_detection_summary",
    """WITH f AS (SELECT count(*) AS findings, count(*) FILTER (WHERE outcome = 'true') AS t, count(*) FILTER (WHERE outcome = 'neutral') AS neutral, count(*) FILTER (WHERE outcome = 'false_alarm') AS fa,
  count(*) FILTER (WHERE outcome = 'true' AND destination = 'pendencia') AS qt, count(*) FILTER (WHERE outcome = 'false_alarm' AND destination = 'pendencia') AS qf FROM judged),
e AS (SELECT count(*) AS expected, count(*) FILTER (WHERE found) AS found FROM scored), w AS (SELECT count(*) AS words FROM words)
SELECT findings, t AS true_findings, neutral AS neutral_findings, fa AS false_alarms, qt AS queue_true, qf AS queue_false, expected, found, 0::BIGINT AS audit_only, words,
 round_even(t / (t + fa), 3) AS precision, round_even(fa * 10000.0::DOUBLE / words, 1) AS false_alarms_per_10k_words, round_even(qt / (qt + qf), 3) AS queue_precision, round_even(qf * 10000.0::DOUBLE / words, 1) AS queue_false_alarms_per_10k_words
FROM f, e, w""",
)
def f08(spark, sf):
    found, errors = judged(spark, sf)
    return M.detection_summary(found, errors, paragraphs(spark, sf))


@query(
    "f13_hash_sample",
    "SELECT doc_id, finding_id FROM findings WHERE ('0x' || substr(sha256(finding_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1",
)
def f13(spark, sf):
    return M.hash_sample(own_findings(spark, sf), F.col("finding_id"), 0.1).select("doc_id", "finding_id")


@query(
    "f14_complement_sample",
    """WITH r AS (SELECT * FROM findings WHERE rule <> 'palavra_consecutiva'),
b AS (SELECT category, arg_min(finding_id, sha256('v3' || chr(1) || finding_id)) AS finding_id FROM r GROUP BY category)
SELECT finding_id, category FROM b ORDER BY sha256('v3' || chr(1) || category) LIMIT 2""",
)
def f14(spark, sf):
    found = light_findings(spark, sf)
    return M.complement_sample(found, found.where(F.col("rule") == "palavra_consecutiva").select("finding_id"), 2)


@query("f12_stratified_sample")
def f12(spark, sf):
    seen = words_in_place(spark, sf).select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("paragraph").cast("string"), F.col("start").cast("string")).alias("item_id"), F.col("lang").alias("sample_set"), F.col("word").alias("form")
    )
    size = F.char_length("form")
    strata = F.array_compact(F.array(*[F.when(size % (i + 2) == 0, F.lit(s)) for i, s in enumerate(M.SAMPLE_STRATA)]))
    return M.stratified_sample(seen.withColumn("strata", strata))


@query(
    "f20_vocabulary_filter",
    r"""WITH unknown AS (SELECT DISTINCT s.doc_id, s.paragraph, s.n FROM sentences s JOIN words w ON w.doc_id = s.doc_id AND w.paragraph = s.paragraph AND w."start" >= s."start" AND w."end" <= s."end" WHERE regexp_matches(w.word, '^\p{Ll}') AND lower(w.word) NOT IN (SELECT word FROM lexicon))
SELECT doc_id, paragraph, n FROM sentences s WHERE NOT EXISTS (SELECT 1 FROM unknown u WHERE u.doc_id = s.doc_id AND u.paragraph = s.paragraph AND u.n = s.n)""",
)
def f20(spark, sf):
    from palimpsest.functions import spans as S

    lines = S.sentences(paragraphs(spark, sf))
    tokens = lines.select("doc_id", "paragraph", "n", F.explode(F.regexp_extract_all("sentence", F.lit(S.WORD), F.lit(0))).alias("word"))
    keys = ["doc_id", "paragraph", "n"]
    return M.vocabulary_filter(lines.select(*keys), tokens, lexicon(spark, sf), keys)
