"""Verdicts, relations, facts and project state on rows derived from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import facts as K
from palimpsest.operators import metrics as M
from palimpsest.operators import policy as P
from palimpsest.operators import project as J
from palimpsest.operators import relations as R
from palimpsest.operators import verdicts as V
from palimpsest.sources import reports as A
from palimpsest.sources.scratch import written

from .core import query, stage, table
from .findings import decisions, light_findings, own_findings
from .structure import paragraphs, structured

# ---- verdict rows -----------------------------------------------------------------------------
# One synthetic opinion per decided finding; every field depends on its position.
stage(
    "opinions",
    """SELECT f.doc_id, f.finding_id, f.paragraph, f.text, f."start", f."end", f.category, f.rule, d.decision,
  CASE f."start" % 5 WHEN 0 THEN 'nao' WHEN 1 THEN 'incerto' ELSE 'sim' END AS existe,
  CASE f."start" % 3 WHEN 0 THEN 'objetivo' WHEN 1 THEN 'interpretativo' ELSE 'nenhuma' END AS natureza,
  CASE f."start" % 2 WHEN 0 THEN 'clara' ELSE 'discutivel' END AS certeza,
  CASE f."end" % 4 WHEN 0 THEN 'alta' WHEN 1 THEN 'media' WHEN 2 THEN 'baixa' ELSE 'nenhuma' END AS gravidade,
  CASE f."end" % 3 WHEN 0 THEN 'identificada' WHEN 1 THEN 'indicio_contrario' ELSE 'nao_se_aplica' END AS razao,
  CASE f."start" % 7 WHEN 0 THEN 'contestada' WHEN 1 THEN 'apontamento_inadequado' WHEN 2 THEN 'revisao_recomendada' WHEN 3 THEN 'inconclusiva' ELSE 'mantida' END AS state,
  f."end" % 3 AS evidence_count
FROM findings f JOIN decisions d USING (doc_id, finding_id)""",
)


def _pick(column: str, modulus: int, *values: str):
    out = F.when(F.col(column) % modulus == 0, values[0])
    for i, v in enumerate(values[1:-1], 1):
        out = out.when(F.col(column) % modulus == i, v)
    return out.otherwise(values[-1])


def opinions(spark, sf, found: DataFrame | None = None) -> DataFrame:
    found = light_findings(spark, sf) if found is None else found
    df = found.join(decisions(spark, sf, found), ["doc_id", "finding_id"])
    return (
        df.withColumn("existe", _pick("start", 5, "nao", "incerto", "sim"))
        .withColumn("natureza", _pick("start", 3, "objetivo", "interpretativo", "nenhuma"))
        .withColumn("certeza", _pick("start", 2, "clara", "discutivel"))
        .withColumn("gravidade", _pick("end", 4, "alta", "media", "baixa", "nenhuma"))
        .withColumn("razao", _pick("end", 3, "identificada", "indicio_contrario", "nao_se_aplica"))
        .withColumn("state", _pick("start", 7, "contestada", "apontamento_inadequado", "revisao_recomendada", "inconclusiva", "mantida"))
        .withColumn("evidence_count", F.col("end") % 3)
    )


_ADEQUACY = """CASE WHEN existe = 'incerto' THEN 'indeterminada' WHEN decision = 'Erro confirmado' THEN CASE existe WHEN 'sim' THEN 'adequada' ELSE 'inadequada' END
 WHEN decision = 'Falso positivo' THEN CASE existe WHEN 'nao' THEN 'adequada' ELSE 'inadequada' END WHEN decision = 'Aceito editorialmente' THEN 'adequada' WHEN existe = 'nao' THEN 'adequada'
 WHEN razao = 'identificada' THEN 'adequada' WHEN razao = 'indicio_contrario' THEN 'inadequada' ELSE 'indeterminada' END"""


@query(
    "g02_adequacy",
    f"""SELECT doc_id, finding_id, {_ADEQUACY} AS adequacy, CASE WHEN existe = 'incerto' THEN 'incerto' WHEN decision = 'Erro confirmado' THEN CASE existe WHEN 'sim' THEN 'sim' ELSE 'nao' END
 WHEN decision = 'Falso positivo' THEN CASE existe WHEN 'nao' THEN 'sim' ELSE 'nao' END WHEN existe = 'nao' THEN 'sim' ELSE 'incerto' END AS coherent FROM opinions""",
)
def g02(spark, sf):
    return opinions(spark, sf).select(
        "doc_id",
        "finding_id",
        V.adequacy(F.col("decision"), F.col("existe"), F.col("razao")).alias("adequacy"),
        V.decision_coherence(F.col("decision"), F.col("existe"), F.lit("incerta")).alias("coherent"),
    )


@query(
    "g03_review_priority",
    """SELECT doc_id, finding_id, ['baixa', 'media', 'alta'][greatest(0, least(2, (natureza = 'objetivo')::INT + (certeza = 'clara')::INT + CASE gravidade WHEN 'alta' THEN 1 WHEN 'baixa' THEN -1 ELSE 0 END)) + 1] AS priority FROM opinions""",
)
def g03(spark, sf):
    return opinions(spark, sf).select(
        "doc_id", "finding_id", V.review_priority(F.col("natureza"), F.col("certeza"), F.col("gravidade")).alias("priority")
    )


@query("g04_derive_state")
def g04(spark, sf):
    """Every decided finding with a JSON answer that quotes its own range; excerpts move, texts do not."""
    marked = T.excerpt(F.col("text"), F.col("start"), F.col("end"))
    found = written(own_findings(spark, sf, lambda f: f.withColumn("excerpt", marked)).drop("text"), "findings")
    marked = F.col("excerpt")
    answer = F.to_json(
        F.struct(
            F.col("finding_id").alias("id"), F.lit(1).alias("ocorrencia"), "existe", "natureza", "certeza", "gravidade",
            F.col("razao").alias("razao_literaria"), F.lit("correta").alias("justificativa_detector"), (F.col("start") % 9 != 0).alias("evidencia_suficiente"),
            marked.alias("evidencia"), F.when(F.col("end") % 2 == 0, marked).otherwise(F.lit("ausente do texto")).alias("evidencia_razao"),
            F.lit("porque sim").alias("explicacao"), F.lit("").alias("recomendacao"), F.lit("").alias("problema_trecho"), F.lit("").alias("problema_explicacao"),
        )
    )
    asked = opinions(spark, sf, found).select("doc_id", "finding_id", "decision", "paragraph", "excerpt", "start", "end", answer.alias("answer"))
    lines = paragraphs(spark, sf).select("doc_id", "paragraph", "text")
    derived = V.derive_state(V.parse_answers(asked).where("refusal IS NULL"), lines)
    return derived.select("doc_id", "finding_id", "state", "adequacy", "motive", "priority", "covers", "which", "total")


@query(
    "g05_assessment",
    f"""SELECT doc_id, finding_id, CASE WHEN decision <> 'Erro confirmado' THEN 'desatualizada'
 WHEN state IN ('mantida', 'apontamento_inadequado') THEN CASE WHEN adequacy = 'adequada' AND existe <> 'incerto' AND evidence_count > 0 THEN 'provavelmente_correta' ELSE 'inconclusiva' END
 WHEN state = 'contestada' THEN CASE WHEN NOT (adequacy = 'inadequada' AND existe IN ('sim', 'nao') AND evidence_count > 0) THEN 'inconclusiva' WHEN existe = 'nao' OR (natureza = 'objetivo' AND certeza = 'clara') THEN 'possivel_erro' ELSE 'revisao_recomendada' END
 WHEN state = 'revisao_recomendada' THEN CASE existe WHEN 'sim' THEN 'revisao_recomendada' ELSE 'inconclusiva' END ELSE 'inconclusiva' END AS assessment FROM (SELECT *, {_ADEQUACY} AS adequacy FROM opinions) o""",
)
def g05(spark, sf):
    df = (
        opinions(spark, sf)
        .withColumn("adequacy", V.adequacy(F.col("decision"), F.col("existe"), F.col("razao")))
        .withColumn("previous_decision", F.lit("Erro confirmado"))
        .withColumn("current", F.lit(True))
        .withColumn("situation", F.lit("valida"))
        .withColumn("result", F.col("state"))
    )
    return df.select("doc_id", "finding_id", V.assessment().alias("assessment"))


@query(
    "g06_validity",
    """SELECT doc_id, finding_id, CASE WHEN "start" % 4 = 0 THEN 'nova' WHEN "start" % 4 = 1 THEN 'nova' WHEN "end" % 3 = 0 THEN 'desatualizada_conteudo' WHEN "end" % 3 = 1 THEN 'desatualizada_configuracao' ELSE 'valida' END AS situation, "start" % 4 IN (0, 1) AS analyse FROM findings""",
)
def g06(spark, sf):
    items = own_findings(spark, sf).withColumn("content_key", T.short_hash(F.col("text"))).withColumn("config_key", F.lit("c1"))
    records = items.where("start % 4 <> 0").select(
        "doc_id",
        "finding_id",
        F.when(F.col("end") % 3 == 0, F.lit("old")).otherwise(F.col("content_key")).alias("content_key"),
        F.when(F.col("end") % 3 == 1, F.lit("c0")).otherwise(F.lit("c1")).alias("config_key"),
        F.when(F.col("start") % 4 == 1, "em_processamento").otherwise("analisada").alias("stage"),
    )
    return V.validity(items, records).select("doc_id", "finding_id", "situation", "analyse")


@query(
    "g11_technical_level",
    """SELECT doc_id, finding_id, CASE WHEN existe = 'sim' AND certeza = 'clara' THEN 'identificado' WHEN existe = 'sim' THEN 'discutivel' WHEN existe = 'nao' THEN 'nao_identificado' ELSE 'nao_estabelecido' END AS level,
 array_to_string(list_filter([CASE WHEN existe = 'incerto' THEN 'existencia_incerta' END, CASE WHEN existe = 'sim' AND certeza = 'discutivel' THEN 'certeza_discutivel' END, CASE WHEN evidence_count = 0 THEN 'sem_evidencia_verificada' END], lambda x: x IS NOT NULL), ',') AS limits,
 CASE WHEN state = 'contestada' THEN CASE WHEN decision IN ('Erro confirmado', 'Aceito editorialmente') AND existe = 'nao' THEN 'problema_nao_existe' WHEN decision = 'Falso positivo' AND existe = 'sim' THEN 'problema_existe' WHEN decision IN ('Estilo do autor', 'Intencional') AND existe = 'sim' THEN 'desvio_nao_deliberado' ELSE 'discorda' END END AS meaning FROM opinions""",
)
def g11(spark, sf):
    limits = V.limitations(F.col("existe"), F.col("certeza"), F.lit(True), F.col("evidence_count"), F.lit("versao_confere"), F.lit(False))
    return opinions(spark, sf).select(
        "doc_id",
        "finding_id",
        V.technical_level(F.col("existe"), F.col("certeza")).alias("level"),
        F.array_join(limits, ",").alias("limits"),
        V.disagreement_meaning(F.col("decision"), F.col("state"), F.col("existe")).alias("meaning"),
    )


@query(
    "e33_reconcile_judgements",
    """SELECT o.doc_id, o.finding_id, CASE WHEN o.state = 'contestada' AND EXISTS (SELECT 1 FROM opinions k WHERE k.doc_id = o.doc_id AND k.paragraph = o.paragraph AND k.finding_id <> o.finding_id AND k.state IN ('mantida', 'apontamento_inadequado') AND k."start" < o."end" AND o."start" < k."end") THEN 'inconclusiva' ELSE o.state END AS state FROM opinions o""",
)
def e33(spark, sf):
    return V.reconcile_judgements(opinions(spark, sf)).select("doc_id", "finding_id", "state")


@query(
    "f10_run_stability",
    """WITH runs AS (SELECT finding_id || ':' || doc_id || ':' || "start" || ':' || paragraph || ':' || category AS item_id, r.run, CASE ("start" + r.run * ("end" % 2)) % 3 WHEN 0 THEN 'mantida' WHEN 1 THEN 'contestada' ELSE 'inconclusiva' END AS state, "end" % 2 AS core FROM opinions, (SELECT unnest([1, 2, 3]) AS run) r WHERE NOT (r.run = 2 AND "start" % 10 = 0)),
m AS (SELECT item_id, state, count(*) AS n, min(run) AS f FROM runs GROUP BY ALL UNION ALL SELECT item_id, NULL, 3 - count(*), 2 FROM runs GROUP BY item_id HAVING count(*) < 3),
b AS (SELECT item_id, count(*) AS seen, count(DISTINCT state) AS states, count(DISTINCT core) AS cores, bool_or(state = 'contestada') AS c, bool_or(state <> 'contestada') AS o FROM runs GROUP BY item_id),
top AS (SELECT item_id, state AS mode, n FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, f) = 1)
SELECT b.item_id, top.mode, round_even(top.n / 3, 3) AS agreement, CASE WHEN seen = 3 AND states = 1 THEN 'estavel' WHEN seen = 3 AND cores = 1 THEN 'so_rotulo' ELSE 'interpretacao' END AS kind, c AND (o OR seen < 3) AS crosses_contestation FROM b JOIN top USING (item_id)""",
)
def f10(spark, sf):
    item = F.concat_ws(":", "finding_id", F.col("doc_id").cast("string"), F.col("start").cast("string"), F.col("paragraph").cast("string"), "category")
    rows = opinions(spark, sf).select(item.alias("item_id"), "start", "end", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("run"))
    rows = rows.where("NOT (run = 2 AND start % 10 = 0)")
    turn = (F.col("start") + F.col("run") * (F.col("end") % 2)) % 3
    state = F.when(turn == 0, "mantida").when(turn == 1, "contestada").otherwise("inconclusiva")
    return M.run_stability(rows.select("item_id", "run", state.alias("state"), (F.col("end") % 2).alias("core")), 3)


@query(
    "f18_judgement_precision",
    """WITH v AS (SELECT CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '2' END AS version, CASE existe WHEN 'sim' THEN 'procedente' WHEN 'nao' THEN 'improcedente' END AS verdict FROM opinions)
SELECT version, count(verdict) AS decided, count(*) FILTER (WHERE verdict = 'procedente') AS upheld, round_even(count(*) FILTER (WHERE verdict = 'procedente') / nullif(count(verdict), 0), 3) AS precision, count(*) FILTER (WHERE verdict IS NULL) AS without_verdict FROM v GROUP BY version""",
)
def f18(spark, sf):
    df = opinions(spark, sf).select(
        F.when(F.col("doc_id") % 2 == 0, "1").otherwise("2").alias("version"),
        F.when(F.col("existe") == "sim", "procedente").when(F.col("existe") == "nao", "improcedente").alias("verdict"),
    )
    return M.judgement_precision(df)


@query(
    "f21_verdict_matrix",
    """WITH r AS (SELECT doc_id, finding_id, existe || '/' || natureza || '/' || certeza || '/' || gravidade || '|' || razao || '|-|' || state || '|-' AS a, existe || '/-/-/-|-|' || CASE WHEN existe = 'sim' THEN 'adequada' ELSE 'indeterminada' END || '|' || state || '|-' AS b FROM opinions)
SELECT doc_id, finding_id, max(a) AS v5, max(b) AS v3, max(a) <> max(b) AS disagree FROM r GROUP BY ALL""",
)
def f21(spark, sf):
    null = F.lit(None).cast("string")
    df = opinions(spark, sf)
    new = df.select(
        "doc_id", "finding_id", F.lit("v5").alias("version"), "existe", "natureza", "certeza", "gravidade", null.alias("procede"), F.col("razao").alias("razao_literaria"),
        null.alias("legitimidade"), null.alias("justificativa_editorial"), null.alias("adequacao"), null.alias("coerente"), "state", null.alias("priority"),
    )
    old = df.select(
        "doc_id", "finding_id", F.lit("v3").alias("version"), null.alias("existe"), null.alias("natureza"), null.alias("certeza"), null.alias("gravidade"), F.col("existe").alias("procede"),
        null.alias("razao_literaria"), null.alias("legitimidade"), null.alias("justificativa_editorial"), null.alias("adequacao"),
        F.when(F.col("existe") == "sim", "sim").otherwise("incerto").alias("coerente"), "state", null.alias("priority"),
    )
    return V.verdict_matrix(new.unionByName(old), ["v5", "v3"])


@query(
    "f15_usage_totals",
    """SELECT source, count(*) AS calls, CASE WHEN count(*) FILTER (WHERE n_chars % 50 = 0) = 0 THEN sum(n_chars)::BIGINT END AS tokens_in, sum(n_chars // 3)::BIGINT AS tokens_cached, sum(n_chars // 5)::BIGINT AS tokens_cache_written, count(*) * 10 AS tokens_out,
 round(sum(n_chars * 0.25::DOUBLE), 6) AS cost_usd, array_to_string(list_sort(list(DISTINCT lang)), ',') AS models, CASE WHEN count(*) FILTER (WHERE n_chars % 50 = 0) = 0 THEN sum(n_chars)::BIGINT END - sum(n_chars // 3)::BIGINT - sum(n_chars // 5)::BIGINT AS tokens_uncached FROM documents GROUP BY source""",
)
def f15(spark, sf):
    calls = table(spark, sf, "documents").select(
        "source",
        F.when(F.col("n_chars") % 50 != 0, F.col("n_chars")).alias("tokens_in"),
        F.expr("n_chars div 3").alias("tokens_cached"),
        F.expr("n_chars div 5").alias("tokens_cache_written"),
        F.lit(10).cast("long").alias("tokens_out"),
        (F.col("n_chars") * 0.25).alias("cost_usd"),
        F.col("lang").alias("model"),
    )
    return M.usage_totals(calls, ["source"])


# ---- batches and cost -------------------------------------------------------------------------
@query("g07_pack_batches")
def g07(spark, sf):
    lines = structured(spark, sf).where(~F.col("heading"))
    shifted = own_findings(spark, sf).withColumn("paragraph", F.col("paragraph") + 3).drop("chapter")
    items = shifted.join(lines.select("doc_id", "paragraph", "chapter"), ["doc_id", "paragraph"]).withColumn("item_order", F.col("report_order"))
    return V.pack_batches(items, lines)


@query(
    "f16_cost_plan",
    """WITH b AS (SELECT source AS plan, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS batch, n_chars / 4.0::DOUBLE AS tokens FROM documents)
SELECT plan, count(*) AS requests, count(*) * 3 AS items, round(sum(((CASE WHEN batch = 1 THEN 1250.0::DOUBLE * 4 ELSE 100.0::DOUBLE * 4 END) + tokens * 1000.0::DOUBLE + 3100.0::DOUBLE * 5000) / 1e6) * 0.5, 2) AS minimum_usd,
 round(sum(((CASE WHEN batch = 1 THEN 1250.0::DOUBLE * 4 ELSE 100.0::DOUBLE * 4 END) + tokens * 1000.0::DOUBLE + 3100.0::DOUBLE * 5000) / 1e6), 2) AS expected_usd,
 round(sum(((4 + tokens) * 1250.0::DOUBLE + 16000 * 5000.0::DOUBLE) / 1e6), 2) AS maximum_usd, round(max(((4 + tokens) * 1250.0::DOUBLE + 16000 * 5000.0::DOUBLE) / 1e6), 2) AS worst_request_usd FROM b GROUP BY plan""",
)
def f16(spark, sf):
    w = Window.partitionBy("source").orderBy("doc_id")
    batches = table(spark, sf, "documents").select(
        F.col("source").alias("plan"), F.lit("m").alias("model"), F.row_number().over(w).alias("batch"), F.lit(3).cast("long").alias("items"), (F.col("n_chars") / 4.0).alias("tokens")
    )
    prices = spark.createDataFrame([("m", 1000.0, 1250.0, 100.0, 5000.0)], "model string, input double, cache_write double, cache_read double, output double")
    plan = M.cost_plan(batches, prices, 4.0, 1000.0, 700.0, 16000.0)
    return plan.select("plan", "requests", "items", *[F.round(c, 2).alias(c) for c in ("minimum_usd", "expected_usd", "maximum_usd", "worst_request_usd")])


# ---- relations --------------------------------------------------------------------------------
stage(
    "placed_findings",
    r"""SELECT *, (len(string_split_regex(substr(text, 1, "start"), '[.!?…]+["”»)\]]*\s+|\n')) - 1)::INT AS sentence,
 CASE WHEN len(w) >= 2 AND w[-1] NOT IN ('o','a','os','as','um','uma','uns','umas','ele','ela','eles','elas','eu','tu','nós','vós','você','vocês','me','te','se','lhe','lhes','seu','sua','seus','suas','meu','minha','meus','minhas','nosso','nossa') THEN w[-2] || ' ' || w[-1] END AS trigger
FROM (SELECT *, regexp_extract_all(lower(substr(text, 1, "start")), '[\p{L}\p{N}_]+') AS w FROM findings) f""",
)


@query(
    "e27_relation_groups",
    """SELECT p.doc_id, p.finding_id, p.paragraph, p."start", p.category, count(*) OVER (PARTITION BY doc_id, paragraph, sentence) - 1 AS same_sentence,
  count(*) OVER (PARTITION BY doc_id, paragraph) - count(*) OVER (PARTITION BY doc_id, paragraph, sentence) AS same_paragraph,
  CASE WHEN trigger IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, category, rule, trigger) - count(*) OVER (PARTITION BY doc_id, category, rule, trigger, paragraph) END AS same_construction FROM placed_findings p""",
)
def e27(spark, sf):
    found = own_findings(spark, sf, R.with_trigger).drop("text")
    return R.relation_groups(R.numbered(found, paragraphs(spark, sf))).select(
        "doc_id", "finding_id", "paragraph", "start", "category", "same_sentence", "same_paragraph", "same_construction"
    )


def quiet_findings(spark, sf) -> DataFrame:
    """Findings whose pairs stay few, for the pairwise form alone."""
    return own_findings(spark, sf).where(F.col("rule") == "frase_cortada")


@query(
    "e27_relation_edges",
    """WITH q AS (SELECT * FROM placed_findings WHERE rule = 'frase_cortada')
SELECT a.doc_id, a.finding_id AS a, b.finding_id AS b, CASE WHEN a.paragraph = b.paragraph THEN CASE WHEN a.sentence = b.sentence THEN 'mesma_frase' ELSE 'mesmo_paragrafo' END ELSE 'mesma_construcao' END AS kind
FROM q a JOIN q b ON a.doc_id = b.doc_id AND (a.paragraph, a."start", a.finding_id) < (b.paragraph, b."start", b.finding_id) AND (a.paragraph = b.paragraph OR (a.category = b.category AND a.trigger = b.trigger))""",
)
def e27b(spark, sf):
    return R.relation_edges(quiet_findings(spark, sf))


@query(
    "e28_related_top8",
    """SELECT doc_id, finding_id, rank, related_id, kind, omitted FROM (
 SELECT a.doc_id, a.finding_id, row_number() OVER (PARTITION BY a.doc_id, a.paragraph, a."start", a."end", a.category ORDER BY a.sentence <> b.sentence, abs(a."start" - b."start"), b."start", b.finding_id)::INT AS rank, b.finding_id AS related_id,
  CASE WHEN a.sentence = b.sentence THEN 'mesma_frase' ELSE 'mesmo_paragrafo' END AS kind, greatest(count(*) OVER (PARTITION BY a.doc_id, a.paragraph, a."start", a."end", a.category) - 8, 0) AS omitted
 FROM placed_findings a JOIN placed_findings b ON a.doc_id = b.doc_id AND a.paragraph = b.paragraph AND a.finding_id <> b.finding_id) x WHERE rank <= 8""",
)
def e28(spark, sf):
    found = own_findings(spark, sf).select("doc_id", "paragraph", "start", "finding_id")
    return R.related_top(R.numbered(found, paragraphs(spark, sf)))


def chain(spark, sf) -> DataFrame:
    """Each finding linked to the next one of its paragraph."""
    w = Window.partitionBy("doc_id", "paragraph").orderBy("report_order")
    node = F.concat_ws(":", F.format_string("%08d", F.col("report_order")), "finding_id")
    rows = own_findings(spark, sf).withColumn("node", node)
    return rows.select("doc_id", "paragraph", "node", F.lead("node").over(w).alias("next"), F.row_number().over(w).alias("k"))


@query(
    "e29_connected_components",
    """SELECT doc_id, node, min(node) OVER (PARTITION BY doc_id, paragraph, (k - 1) // 6) AS component FROM (
 SELECT doc_id, paragraph, printf('%08d', report_order) || ':' || finding_id AS node, row_number() OVER (PARTITION BY doc_id, paragraph ORDER BY report_order) AS k FROM findings) f""",
)
def e29(spark, sf):
    rows = chain(spark, sf)
    edges = rows.where("next IS NOT NULL AND k % 6 <> 0").select("doc_id", F.col("node").alias("a"), F.col("next").alias("b"))
    return R.connected_components(rows.select("doc_id", "node"), edges)


@query(
    "e30_dependency_cycles",
    """SELECT doc_id, node FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, paragraph, (k - 1) // 3) AS n FROM (
 SELECT doc_id, paragraph, printf('%08d', report_order) || ':' || finding_id AS node, row_number() OVER (PARTITION BY doc_id, paragraph ORDER BY report_order) AS k FROM findings) f) g WHERE n = 3 AND paragraph % 2 = 0""",
)
def e30(spark, sf):
    rows = chain(spark, sf)
    w = Window.partitionBy("doc_id", "paragraph").orderBy("k")
    forward = rows.where("next IS NOT NULL AND k % 3 <> 0").select("doc_id", F.col("node").alias("a"), F.col("next").alias("b"))
    back = rows.withColumn("first", F.lag("node", 2).over(w)).where("k % 3 = 0 AND paragraph % 2 = 0").select("doc_id", F.col("node").alias("a"), F.col("first").alias("b"))
    return R.dependency_cycles(forward.unionByName(back))


stage(
    "neighbours",
    """SELECT doc_id, finding_id AS a, b, kind FROM (SELECT doc_id, finding_id, lead(finding_id) OVER w AS b, CASE WHEN lead(sentence) OVER w = sentence THEN 'mesma_frase' ELSE 'mesmo_paragrafo' END AS kind FROM placed_findings WINDOW w AS (PARTITION BY doc_id, paragraph ORDER BY report_order)) x WHERE b IS NOT NULL""",
)


def _consistency(spark, sf, sentences: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges between neighbours, unique opinions, declarations on every edge, and the written findings they come from.

    Without ``sentences`` the edges have no kind and no text is read for it.
    """
    w = Window.partitionBy("doc_id", "paragraph").orderBy("report_order")
    found = light_findings(spark, sf)
    rows = R.numbered(found, paragraphs(spark, sf)) if sentences else found
    kind = [F.when(F.lead("sentence").over(w) == F.col("sentence"), "mesma_frase").otherwise("mesmo_paragrafo").alias("kind")] if sentences else []
    edges = rows.select("doc_id", F.col("finding_id").alias("a"), F.lead("finding_id").over(w).alias("b"), *kind, "start").where("b IS NOT NULL")
    edges = written(edges, "edges")
    said = F.when(F.col("start") % 4 == 0, "diferenca").when(F.col("start") % 4 == 1, "mesma_questao").when(F.col("start") % 4 == 2, "depende_de").otherwise("independente")
    declared = edges.select("doc_id", F.col("a").alias("finding_id"), F.col("b").alias("with_id"), said.alias("kind"), (F.col("start") % 8 == 0).alias("complete"), F.lit(None).cast("boolean").alias("authentic"))
    return edges.drop("start"), opinions(spark, sf, found), declared, found


@query(
    "f17_consistency_pairs",
    """WITH e AS (SELECT doc_id, finding_id AS a, b, kind, "start" FROM (SELECT doc_id, finding_id, "start", lead(finding_id) OVER w AS b, CASE WHEN lead(sentence) OVER w = sentence THEN 'mesma_frase' ELSE 'mesmo_paragrafo' END AS kind FROM placed_findings WINDOW w AS (PARTITION BY doc_id, paragraph ORDER BY report_order)) x WHERE b IS NOT NULL)
SELECT e.doc_id, e.a, e.b, e.kind, CASE WHEN oa.existe IS NULL OR ob.existe IS NULL THEN 'comparacao_indisponivel' WHEN e."start" % 4 = 1 AND oa.existe IN ('sim', 'nao') AND ob.existe IN ('sim', 'nao') AND oa.existe <> ob.existe THEN 'contradicao_declarada'
  WHEN e."start" % 8 = 0 THEN 'diferenca_declarada' WHEN oa.existe = ob.existe AND oa.natureza = ob.natureza AND oa.certeza = ob.certeza THEN 'classificacoes_alinhadas' ELSE 'diferenca_nao_articulada' END AS state
FROM e LEFT JOIN opinions oa ON oa.doc_id = e.doc_id AND oa.finding_id = e.a LEFT JOIN opinions ob ON ob.doc_id = e.doc_id AND ob.finding_id = e.b""",
)
def f17(spark, sf):
    edges, verdicts, declared, _ = _consistency(spark, sf)
    return V.consistency_pairs(edges, verdicts, declared).select("doc_id", "a", "b", "kind", "state")


@query("f17_dependencies")
def f17b(spark, sf):
    _, verdicts, declared, found = _consistency(spark, sf, sentences=False)
    return V.consistency_dependencies(found.select("doc_id", "finding_id"), verdicts, declared)


@query("g09_check_relations")
def g09(spark, sf):
    edges, _, declared, _ = _consistency(spark, sf, sentences=False)
    offered = edges.select("doc_id", F.col("a").alias("finding_id"), F.col("b").alias("related_id"))
    rows = declared.withColumn("pos", F.lit(0)).withColumn("property", F.when(F.col("complete"), "forma verbal").otherwise("")).withColumn(
        "motive", F.lit("o mesmo critério vale para ambos")
    ).withColumn("quote", F.lit(""))
    contexts = own_findings(spark, sf).select("doc_id", "finding_id", F.array("text").alias("context"))
    done, _ = V.check_relations(rows, offered, contexts.dropDuplicates(["doc_id", "finding_id"]))
    return done.select("doc_id", "finding_id", "with_id", "kind", "complete", F.array_join("problems", ",").alias("problems"))


# ---- retrieval --------------------------------------------------------------------------------
def _asked(spark, sf) -> DataFrame:
    """One request per finding: the two words before it are the terms.  Its excerpt stands for the text, read before anything moves."""

    def reading(found: DataFrame) -> DataFrame:
        # One after the other: within one projection the lambdas of the terms would read the new text.
        asked = found.withColumn("terms", F.slice(F.reverse(R.words_before(F.col("text"), F.col("start"))), 1, 2))
        return asked.withColumn("text", T.excerpt(F.col("text"), F.col("start"), F.col("end")))

    lines = own_findings(spark, sf, reading).withColumn("chapter", F.lit("1")).withColumn("reason", F.col("category"))
    return lines.withColumn("start", F.lit(0)).withColumn("end", F.char_length("text"))


@query(
    "e25_retrieve_by_terms",
    r"""WITH i AS (SELECT doc_id, finding_id, paragraph, list_filter(list_reverse(regexp_extract_all(lower(substr(text, 1, "start")), '[\p{L}\p{N}_]+'))[1:2], lambda t: length(t) >= 3) AS terms FROM findings),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph) AS seq FROM paragraphs),
c AS (SELECT i.doc_id, i.finding_id, p.paragraph, sum(length(p.text)) OVER (PARTITION BY i.doc_id, i.finding_id ORDER BY abs(p.paragraph - i.paragraph), p.paragraph ROWS UNBOUNDED PRECEDING) AS total
 FROM i JOIN s me ON me.doc_id = i.doc_id AND me.paragraph = i.paragraph JOIN s p ON p.doc_id = i.doc_id AND abs(p.seq - me.seq) > 2 AND len(list_filter(i.terms, lambda t: contains(lower(p.text), t))) > 0)
SELECT doc_id, finding_id, paragraph FROM c WHERE total <= 3000""",
)
def e25(spark, sf):
    lines = paragraphs(spark, sf).withColumn("heading", F.lit(False)).withColumn("chapter", F.lit("1"))
    return R.retrieve_by_terms(_asked(spark, sf), lines)


_STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_KEYS)
_KEYS_SQL = "list_distinct(list_transform(list_filter(regexp_extract_all(translate(lower({c}), '%s', '%s'), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN (%s)), lambda w: substr(w, 1, 5)))" % (T.ACCENTED, T.PLAIN, _STOP_SQL)


@query(
    "e26_antecedent_scores",
    rf"""WITH s AS (SELECT doc_id, paragraph, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph) AS seq, count(*) OVER (PARTITION BY doc_id) AS n, {_KEYS_SQL.format(c='text')} AS keys FROM paragraphs),
k AS (SELECT doc_id, paragraph, seq, n, unnest(keys) AS key FROM s), d AS (SELECT doc_id, key, count(*) AS df, any_value(n) AS n FROM k GROUP BY ALL HAVING count(*) <= greatest(3, any_value(n) // 6)),
i AS (SELECT doc_id, finding_id, paragraph, unnest(list_concat(list_concat(list_transform({_KEYS_SQL.format(c="array_to_string(list_reverse(regexp_extract_all(lower(substr(text, 1, start)), '[\p{L}\p{N}_]+'))[1:2], ' ')")}, lambda x: {{'key': x, 'w': 3}}),
  list_transform({_KEYS_SQL.format(c='substr(text, "start" + 1, "end" - "start")')}, lambda x: {{'key': x, 'w': 2}})), list_transform({_KEYS_SQL.format(c='category')}, lambda x: {{'key': x, 'w': 1}}))) AS q FROM findings),
u AS (SELECT doc_id, finding_id, paragraph, q.key AS key, max(q.w) AS w FROM i GROUP BY ALL)
SELECT u.doc_id, u.finding_id, k.paragraph, round(sum(u.w * ln(1 + d.n / d.df)) * CASE WHEN k.paragraph < u.paragraph THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END, 6) AS score
FROM u JOIN s me ON me.doc_id = u.doc_id AND me.paragraph = u.paragraph JOIN k ON k.doc_id = u.doc_id AND k.key = u.key AND abs(k.seq - me.seq) > 2 JOIN d ON d.doc_id = u.doc_id AND d.key = u.key GROUP BY u.doc_id, u.finding_id, u.paragraph, k.paragraph""",
)
def e26(spark, sf):
    lines = paragraphs(spark, sf).withColumn("heading", F.lit(False)).withColumn("chapter", F.lit("1"))
    return R.antecedent_scores(_asked(spark, sf), lines).withColumn("score", F.round("score", 6))


@query("e26_retrieve_antecedents")
def e26b(spark, sf):
    lines = paragraphs(spark, sf).withColumn("heading", F.lit(False)).withColumn("chapter", F.lit("1"))
    return R.retrieve_antecedents(_asked(spark, sf), lines)


# ---- facts ------------------------------------------------------------------------------------
# A fact per paragraph: who (first word), how long (length of the paragraph), and a quote from its middle.
stage(
    "facts",
    r"""SELECT doc_id, paragraph, regexp_extract(text, '[\p{L}]+', 0) AS entity, 'tamanho' AS aspect, (length(text) // 100)::VARCHAR AS value, substr(text, length(text) // 2, 20) AS excerpt, paragraph % 2 = 0 AS is_new FROM paragraphs""",
)


def facts(spark, sf) -> DataFrame:
    return paragraphs(spark, sf).select(
        "doc_id",
        "paragraph",
        F.regexp_extract("text", r"[\p{L}]+", 0).alias("entity"),
        F.lit("tamanho").alias("aspect"),
        F.expr("char_length(text) div 100").cast("string").alias("value"),
        F.substring("text", F.expr("char_length(text) div 2").cast("int"), F.lit(20)).alias("excerpt"),
        (F.col("paragraph") % 2 == 0).alias("is_new"),
    )


_ENTITY = r"regexp_replace(regexp_replace(lower(trim({c})), '^(?:o|a|os|as|um|uma|dona|seu|sr\.?|sra\.?)\s+', ''), '^[ .,:;!?]+|[ .,:;!?]+$', '', 'g')"
_NORMAL = r"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"


@query("a16_fact_answers", 'SELECT doc_id, paragraph AS scene, entity, aspect, value, paragraph, excerpt FROM facts WHERE paragraph % 5 <> 0')
def a16(spark, sf):
    fact = F.struct(
        F.col("entity").alias("entidade"), F.lit("personagem").alias("tipo"), F.col("aspect").alias("aspecto"), F.col("value").alias("valor"),
        F.col("paragraph").alias("paragrafo"), F.col("excerpt").alias("trecho"), F.lit("narrador").alias("fonte"),
    )
    whole = F.to_json(F.struct(F.array(fact).alias("fatos"), F.array().cast(f"array<{A.SUGGESTION}>").alias("conflitos")))
    broken = F.when(F.col("paragraph") % 5 == 0, F.substring(whole, F.lit(1), F.char_length(whole) - 3)).otherwise(whole)
    answers = facts(spark, sf).select("doc_id", F.col("paragraph").alias("scene"), broken.alias("answer"))
    return A.parse_fact_answers(answers)[0].select("doc_id", "scene", "entity", "aspect", "value", "paragraph", "excerpt")


@query("a16_corrupt_answers", "SELECT doc_id, paragraph AS scene FROM facts WHERE paragraph % 5 = 0")
def a16b(spark, sf):
    answers = facts(spark, sf).select(
        "doc_id", F.col("paragraph").alias("scene"),
        F.when(F.col("paragraph") % 5 == 0, F.lit('{"fatos": [')).otherwise(F.lit('{"fatos": [], "conflitos": []}')).alias("answer"),
    )
    return A.parse_fact_answers(answers)[2].select("doc_id", "scene")


@query(
    "e19_incompatible_facts",
    f"""WITH k AS (SELECT DISTINCT doc_id, {_ENTITY.format(c='entity')} AS e, value AS v, paragraph, excerpt, is_new FROM facts)
SELECT DISTINCT a.doc_id, a.e AS entity_key, a.paragraph AS a_paragraph, a.excerpt AS a_excerpt, b.paragraph AS b_paragraph, b.excerpt AS b_excerpt FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.e = b.e AND a.paragraph < b.paragraph AND a.v <> b.v AND (a.is_new OR b.is_new)""",
)
def e19(spark, sf):
    return K.incompatible_facts(facts(spark, sf)).select("doc_id", "entity_key", "a_paragraph", "a_excerpt", "b_paragraph", "b_excerpt")


@query(
    "e21_verify_excerpts",
    f"""SELECT f.doc_id, f.paragraph, coalesce({_NORMAL.format(c='f.excerpt')} <> '' AND contains({_NORMAL.format(c='p.text')}, {_NORMAL.format(c='f.excerpt')}), false) AS valid FROM (SELECT doc_id, paragraph + (paragraph % 3 = 0)::INT AS paragraph, excerpt FROM facts) f LEFT JOIN paragraphs p USING (doc_id, paragraph)""",
)
def e21(spark, sf):
    moved = facts(spark, sf).withColumn("paragraph", (F.col("paragraph") + (F.col("paragraph") % 3 == 0).cast("int")).cast("int"))
    return K.verify_excerpts(moved, paragraphs(spark, sf)).select("doc_id", "paragraph", "valid")


@query(
    "e20_relevant_facts",
    f"""WITH sp AS (SELECT DISTINCT doc_id, paragraph AS scene, unnest(regexp_extract_all({_NORMAL.format(c='text')}, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM paragraphs)
SELECT doc_id, scene, fact_order, k::INT AS rank FROM (SELECT f.doc_id, s.scene, f.paragraph AS fact_order, row_number() OVER (PARTITION BY f.doc_id, s.scene ORDER BY f.paragraph DESC) AS k
 FROM (SELECT *, {_ENTITY.format(c='entity')} AS e FROM facts) f JOIN sp s ON s.doc_id = f.doc_id AND s.w = f.e AND f.paragraph < s.scene WHERE length(f.e) > 2) x""",
)
def e20(spark, sf):
    known = facts(spark, sf).select("doc_id", F.col("paragraph").alias("fact_order"), "entity", F.lit("personagem").alias("kind"), F.col("paragraph").alias("scene"))
    pages = paragraphs(spark, sf).select("doc_id", F.col("paragraph").alias("scene"), "paragraph", "text")
    return K.relevant_facts(known, pages)


@query("e22_verify_evidence")
def e22(spark, sf):
    quotes = facts(spark, sf).select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("paragraph").cast("string")).alias("evidence_id"),
        "doc_id",
        (F.col("paragraph") + (F.col("paragraph") % 4 == 0).cast("int")).cast("int").alias("paragraph"),
        F.when(F.col("paragraph") % 7 == 0, F.lit("texto que não existe")).otherwise(F.col("excerpt")).alias("excerpt"),
    )
    return K.verify_evidence(quotes, paragraphs(spark, sf)).select("evidence_id", "doc_id", "paragraph", "valid", "start", "end", "reason")


def confirmed(spark, sf) -> DataFrame:
    """Neighbouring facts of a document as confirmed contradictions."""
    w = Window.partitionBy("doc_id").orderBy("paragraph")
    side = F.lead(F.struct("paragraph", "excerpt")).over(w)
    rows = facts(spark, sf).select("doc_id", F.col("paragraph").alias("a_paragraph"), F.col("excerpt").alias("a_excerpt"), side.alias("_b")).where("_b IS NOT NULL")
    level = F.when(F.col("a_paragraph") % 3 == 0, "alta").when(F.col("a_paragraph") % 3 == 1, "media").otherwise("baixa")
    return rows.select(
        "doc_id", F.col("a_paragraph").alias("ord"), "a_paragraph", "a_excerpt", F.col("_b.paragraph").alias("b_paragraph"), F.col("_b.excerpt").alias("b_excerpt"),
        level.alias("confidence"), F.lit("").alias("explanation"),
    )


@query("e23_group_contradictions")
def e23(spark, sf):
    return K.group_contradictions(confirmed(spark, sf))


@query("e24_match_contradictions")
def e24(spark, sf):
    rows = confirmed(spark, sf).withColumnRenamed("doc_id", "case_id")
    gold = rows.select("case_id", F.col("ord").alias("gold_ord"), F.col("b_paragraph").alias("paragraph"), F.col("a_paragraph").alias("against"), F.col("b_excerpt").alias("excerpt"))
    return K.match_contradictions(rows.where("ord % 3 <> 0"), gold)


@query("g08_global_findings")
def g08(spark, sf):
    rows = confirmed(spark, sf).withColumn("point_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ord").cast("string")))
    kinds = F.array(*[F.lit(c) for c in V.GLOBAL_CATEGORIES])
    points = rows.select(
        "doc_id", "point_id", F.element_at(kinds, (F.col("ord") % 6 + 1).cast("int")).alias("category"), F.when(F.col("ord") % 2 == 0, "lacuna").otherwise("contradicao").alias("nature"),
        F.when(F.col("ord") % 3 == 0, "sugestao").otherwise("atencao").alias("priority"), F.col("confidence").alias("certainty"), F.lit("importa").alias("gap_relevance"),
    )
    sides = F.array(F.struct(F.col("a_paragraph").alias("paragraph"), F.col("a_excerpt").alias("excerpt")), F.struct(F.col("b_paragraph").alias("paragraph"), F.col("b_excerpt").alias("excerpt")))
    quotes = rows.select("doc_id", "point_id", F.posexplode(sides).alias("_k", "_s")).select(
        "doc_id", "point_id", F.concat_ws(":", "point_id", F.col("_k").cast("string")).alias("evidence_id"), "_s.paragraph", "_s.excerpt"
    )
    return V.global_findings(points, K.verify_evidence(quotes, paragraphs(spark, sf))).select("doc_id", "global_id", "category", "situation", "destination", "rank")


@query("g10_global_to_findings")
def g10(spark, sf):
    rows = facts(spark, sf).select(
        "doc_id", T.short_hash(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("paragraph").cast("string"))).alias("global_id"), F.lit("media").alias("certainty"), F.lit("informacao").alias("destination"),
        F.array(F.struct("paragraph", F.lit(0).alias("start"), F.lit(4).alias("end")), F.struct("paragraph", F.lit(5).alias("start"), F.lit(9).alias("end"))).alias("evidence"),
    )
    lines = paragraphs(spark, sf).withColumn("chapter", F.lit("1"))
    out = V.global_to_findings(rows, lines)
    return out.select("doc_id", "finding_id", "paragraph", "start", "end", "confidence", F.size("related").alias("related"))


@query("e36_audit_acceptance")
def e36(spark, sf):
    cats = F.array(*[F.lit(c) for c in V.AUDIT_CATEGORIES])
    rows = facts(spark, sf).select(
        "doc_id", F.col("paragraph").alias("pos"), "paragraph", F.when(F.col("paragraph") % 6 == 0, F.lit("não há")).otherwise(F.col("excerpt")).alias("excerpt"),
        F.element_at(cats, (F.col("paragraph") % 11 + 1).cast("int")).alias("category"), F.lit("alta").alias("confidence"),
    )
    again = rows.withColumn("pos", F.col("pos") + 1000000)
    return V.audit_acceptance(rows.unionByName(again), paragraphs(spark, sf), own_findings(spark, sf)).select("doc_id", "pos", "category", "start", "end", "result", "confidence")


# ---- project state ----------------------------------------------------------------------------
def chapters(spark, sf) -> DataFrame:
    """Chapters of ten paragraphs."""
    lines = chapter_lines(spark, sf)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("paragraph", "text"))), lambda r: r["text"]), "\n")
    return lines.groupBy("doc_id", "chapter_id").agg(F.min("paragraph").alias("first_paragraph"), F.sha2(text, 256).alias("hash"))


def chapter_lines(spark, sf) -> DataFrame:
    number = F.expr("(paragraph - 1) div 10").cast("string")
    w = Window.partitionBy("doc_id", "chapter_id").orderBy("paragraph")
    return paragraphs(spark, sf).withColumn("chapter_id", number).withColumn("relative", F.row_number().over(w) - 1).withColumn("chapter", F.col("chapter_id"))


stage("chapter_rows", """SELECT doc_id, ((paragraph - 1) // 10)::VARCHAR AS chapter_id, min(paragraph) AS first_paragraph, sha256(string_agg(text, chr(10) ORDER BY paragraph)) AS hash FROM paragraphs GROUP BY ALL""")


def state(spark, sf) -> DataFrame:
    """The stored state: one chapter in four is older, one more no longer exists."""
    df = chapters(spark, sf)
    old = df.select("doc_id", "chapter_id", F.when(F.col("first_paragraph") % 4 == 1, "old").otherwise(F.col("hash")).alias("hash"), F.lit("m1").alias("model"))
    gone = df.where("chapter_id = '0'").select("doc_id", F.lit("gone").alias("chapter_id"), F.lit("x").alias("hash"), F.lit("m1").alias("model"))
    return old.unionByName(gone)


@query(
    "h01_changed_chapters",
    """SELECT doc_id, chapter_id, CASE WHEN first_paragraph % 4 = 1 THEN 'changed' ELSE 'unchanged' END AS status FROM chapter_rows UNION ALL SELECT doc_id, 'gone', 'removed' FROM chapter_rows WHERE chapter_id = '0'""",
)
def h01(spark, sf):
    return J.changed_chapters(chapters(spark, sf), state(spark, sf), "m1").select("doc_id", "chapter_id", "status")


@query(
    "h02_carry_facts",
    """SELECT f.doc_id, c.chapter_id, f.paragraph + 0 AS paragraph, f.is_new FROM (SELECT *, ((paragraph - 1) // 10)::VARCHAR AS chapter_id, row_number() OVER (PARTITION BY doc_id, (paragraph - 1) // 10 ORDER BY paragraph) AS k FROM facts) f JOIN chapter_rows c ON c.doc_id = f.doc_id AND c.chapter_id = f.chapter_id WHERE c.first_paragraph % 4 <> 1""",
)
def h02(spark, sf):
    rows = facts(spark, sf).withColumn("chapter_id", F.expr("(paragraph - 1) div 10").cast("string"))
    stored = rows.join(chapters(spark, sf).select("doc_id", "chapter_id", "first_paragraph"), ["doc_id", "chapter_id"])
    stored = stored.withColumn("relative", F.col("paragraph") - F.col("first_paragraph")).withColumn("reevaluate", F.col("is_new")).drop("first_paragraph", "paragraph", "is_new")
    changed = J.changed_chapters(chapters(spark, sf), state(spark, sf), "m1")
    return J.carry_facts(changed, stored).select("doc_id", "chapter_id", "paragraph", "is_new")


def _requests(spark, sf) -> DataFrame:
    pairs = K.incompatible_facts(facts(spark, sf))
    return pairs.withColumn("request", F.concat_ws("|", "a_excerpt", "b_excerpt"))


@query(
    "h03_pairs_to_judge",
    f"""WITH k AS (SELECT DISTINCT doc_id, {_ENTITY.format(c='entity')} AS e, value AS v, paragraph, excerpt, is_new FROM facts),
p AS (SELECT DISTINCT a.doc_id, a.paragraph AS a_paragraph, b.paragraph AS b_paragraph, a.excerpt || '|' || b.excerpt AS request FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.e = b.e AND a.paragraph < b.paragraph AND a.v <> b.v AND (a.is_new OR b.is_new))
SELECT doc_id, a_paragraph, b_paragraph FROM p WHERE request NOT IN (SELECT request FROM p WHERE a_paragraph % 2 = 0)""",
)
def h03(spark, sf):
    pairs = _requests(spark, sf)
    cache = pairs.where("a_paragraph % 2 = 0").select(F.sha2(F.concat_ws("\n", F.lit("m1"), "request"), 256).alias("cache_key"), F.lit("nao").alias("verdict"), F.lit(100).alias("tokens")).distinct()
    return J.pairs_to_judge(pairs, cache, "m1")[0].select("doc_id", "a_paragraph", "b_paragraph")


def pendencies(spark, sf) -> DataFrame:
    rows = confirmed(spark, sf)
    place = chapter_lines(spark, sf).select("doc_id", "paragraph", "chapter_id", "relative")
    side = lambda p: place.select("doc_id", F.col("paragraph").alias(f"{p}_paragraph"), F.col("chapter_id").alias(f"{p}_chapter"), F.col("relative").alias(f"{p}_relative"))
    placed = rows.join(side("a"), ["doc_id", "a_paragraph"]).join(side("b"), ["doc_id", "b_paragraph"])
    w = Window.partitionBy("doc_id").orderBy("ord")
    return (
        placed.withColumn("number", F.row_number().over(w))
        .withColumn("pendency_id", F.format_string("C%03d", "number"))
        .withColumn("status", F.when(F.col("ord") % 5 == 0, J.CORRECTED).otherwise(J.OPEN))
        .drop("a_paragraph", "b_paragraph")
    )


@query("h04_reconcile_pendencies")
def h04(spark, sf):
    current = J.changed_chapters(chapters(spark, sf), state(spark, sf), "m1")
    lines = chapter_lines(spark, sf).withColumn("text", F.when(F.col("paragraph") % 7 == 0, F.lit("outra coisa")).otherwise(F.col("text")))
    done = J.reconcile_pendencies(pendencies(spark, sf), current, lines)
    return done.select("doc_id", "pendency_id", "status", "a_relative", "b_relative")


@query("h05_upsert_pendencies")
def h05(spark, sf):
    known = pendencies(spark, sf)
    new = known.select("doc_id", (F.col("ord") + 0).alias("ord"), "a_chapter", "a_relative", "a_excerpt", "b_chapter", "b_relative", "b_excerpt", "explanation", "confidence")
    return J.upsert_pendencies(known.where("number % 3 <> 0"), new).select("doc_id", "pendency_id", "status", "related")


@query("h05_chapter_status")
def h05b(spark, sf):
    return J.chapter_status(chapters(spark, sf).select("doc_id", "chapter_id"), pendencies(spark, sf))


@query("h06_round_ledger")
def h06(spark, sf):
    pairs = _requests(spark, sf)
    cached = pairs.where("a_paragraph % 2 = 0").withColumn("tokens", F.lit(100))
    calls = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("tokens"), (F.col("n_chars") * 0.000001).alias("cost_usd"))
    current = J.changed_chapters(chapters(spark, sf), state(spark, sf), "m1")
    return J.round_ledger(current, pairs.where("a_paragraph % 2 = 1"), cached, calls, pendencies(spark, sf))


@query("h07_pendencies_to_findings")
def h07(spark, sf):
    out = J.pendencies_to_findings(pendencies(spark, sf), chapter_lines(spark, sf))
    return out.select("doc_id", "pendency_id", "paragraph", "start", "end", "confidence", "finding_id")


@query(
    "f06_closure_applies",
    """SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 4 <> 0 AS applies FROM documents""",
)
def f06b(spark, sf):
    docs = table(spark, sf, "documents")
    none = F.lit(None).cast("array<string>")
    closures = docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.lit(2).alias("policy_version"), none.alias("missing"))
    current = docs.select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.sha2("text", 256)).alias("sha256"), F.when(F.col("doc_id") % 4 == 0, 3).otherwise(2).alias("policy_version"), none.alias("missing")
    )
    return P.closure_applies(closures, current).select("doc_id", "applies")


