"""Second opinions as tables: contract, derived state, reconciliation, consistency and acceptance.

Answers arrive as data; no model is called here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import let
from ..functions.text import short_hash, stripped, with_occurrence
from .findings import overlap_join
from .relations import dependency_cycles

# ---- fixed values -----------------------------------------------------------------------------
EXISTS = ("sim", "nao", "incerto")
NATURE = ("objetivo", "interpretativo", "nenhuma")
CERTAINTY = ("clara", "discutivel", "nao_se_aplica")
GRAVITY = ("alta", "media", "baixa", "nenhuma")
REASON = ("identificada", "nao_identificada", "indicio_contrario", "nao_se_aplica")
JUSTIFICATION = ("correta", "parcial", "incorreta")
PRIORITIES = ("baixa", "media", "alta")
PRESERVING = ("Estilo do autor", "Intencional")
MARKS = "⟦⟧⟪⟫【】⦃⦄"
DECLARED_KINDS = ("independente", "depende_de", "mesma_questao", "diferenca", "incerta")
NEED_MOTIVE = ("depende_de", "mesma_questao", "diferenca")
NEED_PROPERTY = ("mesma_questao", "diferenca")
GLOBAL_CATEGORIES = (
    "fato_incompativel continuidade_espacial_temporal continuidade_causal evento_abandonado conhecimento_do_personagem "
    "clareza_contextual"
).split()
AUDIT_CATEGORIES = {
    # category: rule switch that turns it off (empty: none)
    "ortografia": "", "concordancia": "concordancia", "regencia": "regencia", "crase": "crase", "pontuacao": "",
    "tempo_verbal": "tempo_verbal", "estrutura_frase": "estrutura", "repeticao": "palavra_consecutiva",
    "dialogo": "pontuacao_dialogo", "referencia": "", "continuidade_local": "",
}
DOUBLED = r"(?iuU)\b(\p{L}+)\s+\1\b"
ANSWER = (
    "id string, ocorrencia int, existe string, natureza string, certeza string, gravidade string, razao_literaria string, "
    "justificativa_detector string, evidencia_suficiente boolean, evidencia string, evidencia_razao string, explicacao string, "
    "recomendacao string, problema_trecho string, problema_explicacao string"
)
# -----------------------------------------------------------------------------------------------


def decision_coherence(decision: Column, upheld: Column, justification: Column) -> Column:
    """Coherence of a decision with the problem, by the meaning of the decision."""
    return (
        F.when(upheld == "incerto", "incerto")
        .when(decision == "Erro confirmado", F.when(upheld == "sim", "sim").otherwise("nao"))
        .when(decision == "Falso positivo", F.when(upheld == "nao", "sim").otherwise("nao"))
        .when(decision == "Aceito editorialmente", "sim")
        .when(upheld == "nao", "sim")
        .when(justification == "presente", "sim")
        .when(justification == "ausente", "nao")
        .otherwise("incerto")
    )


def adequacy(decision: Column, exists: Column, reason: Column) -> Column:
    return (
        F.when(exists == "incerto", "indeterminada")
        .when(decision == "Erro confirmado", F.when(exists == "sim", "adequada").otherwise("inadequada"))
        .when(decision == "Falso positivo", F.when(exists == "nao", "adequada").otherwise("inadequada"))
        .when(decision == "Aceito editorialmente", "adequada")
        .when(exists == "nao", "adequada")
        .when(reason == "identificada", "adequada")
        .when(reason == "indicio_contrario", "inadequada")
        .otherwise("indeterminada")
    )


def review_priority(nature: Column, certainty: Column, gravity: Column) -> Column:
    """Three ordered levels; gravity moves one step."""
    objective, clear = nature == "objetivo", certainty == "clara"
    level = objective.cast("int") + clear.cast("int") + F.when(gravity == "alta", 1).when(gravity == "baixa", -1).otherwise(0)
    clamped = F.least(F.greatest(level, F.lit(0)), F.lit(2))
    return F.element_at(F.array(*[F.lit(p) for p in PRIORITIES]), clamped + 1)


def _without_marks(text: Column) -> Column:
    return stripped(F.translate(text, MARKS, ""))


def parse_answers(answers: DataFrame) -> DataFrame:
    """Adds the answer fields and ``refusal`` (null when the contract holds).  Input: ``answer`` (JSON text).

    The whole contract is one expression over one parse, so a filter on
    ``refusal`` that moves down the plan does not parse again per field.
    """
    fields = [f.split(" ")[0] for f in ANSWER.split(", ")]
    enums = (
        ("existe", EXISTS), ("natureza", NATURE), ("certeza", CERTAINTY), ("gravidade", GRAVITY),
        ("justificativa_detector", JUSTIFICATION), ("razao_literaria", REASON),
    )

    def contract(z: Column) -> Column:
        a, present = z["a"], z["present"]
        missing = F.size(F.array_except(F.array(*[F.lit(f) for f in fields]), present)) > 0
        outside, typed = F.lit(False), F.lit(False)
        for name, allowed in enums:
            outside = outside | ~F.coalesce(a[name].isin(*allowed), F.lit(False))
        for name in fields:
            typed = typed | a[name].isNull()
        return (
            F.when(a.isNull() | present.isNull(), "nao_e_objeto")
            .when(missing, "campo_ausente")
            .when(outside, "valor_fora_da_enumeracao")
            .when(typed, "tipo_invalido")
        )

    parsed = F.struct(F.from_json("answer", ANSWER).alias("a"), F.json_object_keys("answer").alias("present"))
    both = let(parsed, lambda z: F.struct(z["a"].alias("a"), contract(z).alias("refusal")))
    return answers.withColumn("_p", both).select(*answers.columns, "_p.a.*", F.col("_p.refusal").alias("refusal"))


def _covers(text: Column, start: Column, end: Column, fragment: Column) -> Column:
    """Some literal occurrence of the fragment shares a character with the range."""
    size = F.char_length(fragment)
    low = F.greatest(start - size + 1, F.lit(0))
    return (size > 0) & F.contains(F.substring(text, low + 1, end - 1 + size - low), fragment)


def derive_state(items: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """State of each judged item from its answer and the checks of authenticity and place.

    ``items``: doc_id, finding_id, decision, paragraph, text, start, end, ``context`` (texts that
    were sent, the paragraph included) and the answer fields of ``parse_answers``.
    Adds state, adequacy, reason, motive, priority and whether the evidence covers the target.
    ``texts``: doc_id, paragraph, text of the paragraphs, for items with their ``excerpt`` instead of text and context; the
    paragraph alone was sent, and it is read where it lies.
    """
    quote, target = _without_marks(F.col("evidencia_razao")), _without_marks(F.col("evidencia"))
    sent = F.col("context") if texts is None else F.array("text")
    anywhere = lambda q: (q != "") & F.exists(sent, lambda t: F.contains(t, q))
    df = with_occurrence(items, texts=texts)
    df = df if texts is None else df.join(texts, ["doc_id", "paragraph"])
    df = (
        df.withColumn("_quote", quote)
        .withColumn("_target", target)
        .withColumn("_quoted", anywhere(F.col("_quote")))
        .withColumn("_found", anywhere(F.col("_target")))
        .withColumn("covers", _covers(F.col("text"), F.col("start"), F.col("end"), F.col("_target")))
        .withColumn(
            "reason",
            F.when(F.col("razao_literaria").isin("identificada", "indicio_contrario") & ~F.col("_quoted"), "nao_identificada").otherwise(
                F.col("razao_literaria")
            ),
        )
    )
    df = df.withColumn("_adequacy", adequacy(F.col("decision"), F.col("existe"), F.col("reason")))
    keeps = F.col("decision").isin(*PRESERVING)
    # The contradiction test looks at the declared reason, before the quote was checked.
    contradictory = keeps & (
        ((F.col("existe") == "nao") & (F.col("razao_literaria") != "nao_se_aplica"))
        | ((F.col("existe") == "sim") & (F.col("razao_literaria") == "nao_se_aplica"))
    )
    weak = (
        F.when(F.col("ocorrencia") != F.col("which"), "ocorrencia_divergente")
        .when((stripped(F.col("explicacao")) == "") | (F.col("_target") == ""), "evidencia_ausente")
        .when(~F.col("_found"), "evidencia_inexistente")
        .when(~F.col("covers"), "evidencia_de_outra_ocorrencia")
    )
    open_ = ~F.col("evidencia_suficiente") | (F.col("existe") == "incerto")
    inadequate = F.col("_adequacy") == "inadequada"
    motive = (
        F.when(contradictory, "resposta_contraditoria")
        .when(open_, F.lit(None))
        .when(inadequate, weak)
        .when(F.col("_adequacy") == "indeterminada", "intencao_nao_determinada")
    )
    state = (
        F.when(contradictory | open_, "inconclusiva")
        .when(inadequate & weak.isNull(), "contestada")
        .when(inadequate, F.when(F.col("existe") == "sim", "revisao_recomendada").otherwise("inconclusiva"))
        .when(F.col("_adequacy") == "indeterminada", "revisao_recomendada")
        .when((F.col("existe") == "nao") & (F.col("justificativa_detector") == "incorreta"), "apontamento_inadequado")
        .otherwise("mantida")
    )
    ranked = (F.col("existe") == "sim") & F.col("state").isin("contestada", "revisao_recomendada")
    return (
        df.withColumn("motive", motive)
        .withColumn("state", state)
        .withColumn("adequacy", F.when(F.col("state") == "inconclusiva", "indeterminada").otherwise(F.col("_adequacy")))
        .withColumn("priority", F.when(ranked, review_priority(F.col("natureza"), F.col("certeza"), F.col("gravidade"))))
        .drop("_quote", "_target", "_quoted", "_found", "_adequacy")
    )


def assessment() -> Column:
    """Six desk classes.  Columns: result, previous_decision, decision (live), current, situation, existe,
    natureza, certeza, adequacy and evidence_count; ``result`` is null when there is no verdict."""
    exists, adequate = F.col("existe"), F.col("adequacy")
    supported = F.coalesce(F.col("evidence_count") > 0, F.lit(False))
    stale = (F.col("decision").isNotNull() & ~F.col("decision").eqNullSafe(F.col("previous_decision"))) | ~F.coalesce("current", F.lit(False)) | ~F.col("situation").eqNullSafe("valida")
    kept = F.when((adequate == "adequada") & (exists != "incerto") & supported, "provavelmente_correta").otherwise("inconclusiva")
    contested = (
        F.when(~(F.coalesce(adequate == "inadequada", F.lit(False)) & exists.isin("sim", "nao") & supported), "inconclusiva")
        .when((exists == "nao") | ((F.col("natureza") == "objetivo") & (F.col("certeza") == "clara")), "possivel_erro")
        .otherwise("revisao_recomendada")
    )
    return (
        F.when(F.col("result").isNull(), "nao_analisada")
        .when(stale, "desatualizada")
        .when(F.col("result").isin("mantida", "apontamento_inadequado"), kept)
        .when(F.col("result") == "contestada", contested)
        .when(F.col("result") == "revisao_recomendada", F.when(exists == "sim", "revisao_recomendada").otherwise("inconclusiva"))
        .otherwise("inconclusiva")
    )


def validity(items: DataFrame, records: DataFrame, active: bool = False, revalidate: Sequence[str] = ()) -> DataFrame:
    """Adds ``situation`` and ``analyse`` of every item against its stored record.

    ``items``: doc_id, finding_id, content_key, config_key; ``records`` has the same keys and ``stage``.
    """
    stored = records.select(
        "doc_id", "finding_id", F.col("content_key").alias("_ck"), F.col("config_key").alias("_fk"), F.col("stage").alias("_stage"), F.lit(True).alias("_has")
    )
    situation = (
        F.when(F.col("_has").isNull(), "nova")
        .when(F.col("_stage") == "em_processamento", "em_processamento" if active else "nova")
        .when(~F.col("_ck").eqNullSafe(F.col("content_key")), "desatualizada_conteudo")
        .when(~F.col("_fk").eqNullSafe(F.col("config_key")), "desatualizada_configuracao")
        .otherwise("valida")
    )
    again = F.col("finding_id").isin(list(revalidate)) if revalidate else F.lit(False)
    df = items.join(stored, ["doc_id", "finding_id"], "left").withColumn("situation", situation)
    return df.withColumn("analyse", (F.col("situation") == "nova") | (F.startswith("situation", F.lit("desatualizada")) & again)).drop("_ck", "_fk", "_stage", "_has")


def pack_batches(items: DataFrame, paras: DataFrame, max_items: int = 3, max_chars: int = 9000, window: int = 3) -> DataFrame:
    """Batch number of every item: one chapter per batch, shared context paragraphs counted once.

    ``items``: doc_id, finding_id, item_order, paragraph, chapter; ``paras`` must not
    contain headings.  The context of an item is a run of consecutive positions and
    items come in order, so what is already in the batch is known by its last
    position: the fold keeps numbers only.
    """
    seq = Window.partitionBy("doc_id", "chapter").orderBy("paragraph")
    size = F.char_length("text")
    lined = paras.withColumn("_at", F.row_number().over(seq)).withColumn("_upto", F.sum(size).over(seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    marks = lined.select(
        "doc_id", "chapter", "paragraph", "_at",
        F.greatest(F.col("_at") - window, F.lit(1)).alias("_lo"),
        F.max("_upto").over(seq.rowsBetween(0, window)).alias("_hi_chars"),
        F.max("_at").over(seq.rowsBetween(0, window)).alias("_hi"),
        F.coalesce(F.max("_upto").over(seq.rowsBetween(Window.unboundedPreceding, -window - 1)), F.lit(0)).alias("_lo_chars"),
    )
    rows = items.join(marks, ["doc_id", "chapter", "paragraph"]).select(
        "doc_id", F.struct("item_order", "finding_id", "chapter", "_lo", "_hi", "_lo_chars", "_hi_chars").alias("_r")
    )
    listed = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("_r")).alias("_rows"))

    def step(acc: Column, r: Column) -> Column:
        # Characters not yet in the batch: from the end of what it holds, or the whole window.
        ahead = F.greatest(r["_hi_chars"] - F.greatest(r["_lo_chars"], acc["reach"]), F.lit(0))
        same = acc["chapter"] == r["chapter"]
        fits = same & (acc["items"] < max_items) & (acc["size"] + ahead <= max_chars)
        own = r["_hi_chars"] - r["_lo_chars"]
        number = F.when(fits, acc["batch"]).otherwise(acc["batch"] + 1)
        return F.struct(
            number.cast("int").alias("batch"),
            F.when(fits, acc["items"] + 1).otherwise(F.lit(1)).cast("int").alias("items"),
            F.when(fits, acc["size"] + ahead).otherwise(own).cast("long").alias("size"),
            F.when(fits, F.greatest(acc["reach"], r["_hi_chars"])).otherwise(r["_hi_chars"]).cast("long").alias("reach"),
            r["chapter"].alias("chapter"),
            F.concat(acc["out"], F.array(F.struct(r["finding_id"].alias("finding_id"), number.cast("int").alias("batch")))).alias("out"),
        )

    start = F.struct(
        F.lit(0).alias("batch"), F.lit(0).alias("items"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("reach"),
        F.lit("\u0000").alias("chapter"), F.array().cast("array<struct<finding_id:string,batch:int>>").alias("out"),
    )
    return listed.select("doc_id", F.explode(F.aggregate("_rows", start, step, lambda a: a["out"])).alias("_o")).select("doc_id", "_o.finding_id", "_o.batch")


def global_findings(points: DataFrame, evidence: DataFrame, limit: int | None = None) -> DataFrame:
    """Global-reading points with verified evidence: supported or inconclusive, destination, id and rank in the document.

    All are returned unless a ``limit`` keeps the first ones of each document.

    ``points``: doc_id, point_id, category, nature, priority, certainty, gap_relevance;
    ``evidence``: output of ``verify_evidence`` with point_id.
    """
    shown = evidence.groupBy("point_id").agg(
        F.count("*").alias("_all"),
        F.count_if("valid").alias("_valid"),
        F.count_distinct(F.when(F.col("valid"), F.struct("paragraph", "start"))).alias("_distinct"),
        F.array_sort(F.collect_list(F.when(F.col("valid"), F.struct("paragraph", "start", "end")))).alias("evidence"),
        F.min(F.when(F.col("valid"), F.struct("evidence_id", "paragraph"))).alias("_first"),
    )
    well_formed = (
        F.col("category").isin(GLOBAL_CATEGORIES)
        & F.col("nature").isin("contradicao", "lacuna")
        & F.col("priority").isin("atencao", "sugestao")
        & F.col("certainty").isin("alta", "media", "baixa")
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_valid") < F.col("_all"), "evidencia_parcial"),
            F.when((F.col("nature") == "contradicao") & (F.col("_distinct") < 2), "contradicao_sem_dois_trechos"),
            F.when((F.col("nature") == "lacuna") & (F.trim(F.coalesce("gap_relevance", F.lit(""))) == ""), "lacuna_sem_relevancia"),
        )
    )
    firm = (F.size("reasons") == 0) & (F.col("priority") == "atencao") & F.col("certainty").isin("alta", "media")
    spans = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["paragraph"].cast("string"), e["start"].cast("string"), e["end"].cast("string"))), "|")
    kept = (
        points.where(well_formed)
        .join(shown, "point_id")
        .where("_valid > 0")
        .withColumn("reasons", reasons)
        .withColumn("situation", F.when(F.size("reasons") > 0, "inconclusiva").otherwise("sustentada"))
        .withColumn("destination", F.when(firm, "informacao").otherwise("diagnostico"))
        .withColumn("global_id", short_hash(F.concat_ws("|", "category", spans)))
    )
    columns = [c for c in kept.columns if c not in ("doc_id", "global_id")]
    once = kept.groupBy("doc_id", "global_id").agg(F.min_by(F.struct(*columns), "point_id").alias("_p")).select("doc_id", "global_id", "_p.*")
    order = Window.partitionBy("doc_id").orderBy(F.when(F.col("priority") == "atencao", 0).otherwise(1), F.col("_first.paragraph"), "global_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).drop("_all", "_valid", "_distinct", "_first")
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def global_to_findings(points: DataFrame, paras: DataFrame) -> DataFrame:
    """Each global point as a finding: its last evidence in text order is the anchor, the earlier ones are related."""
    anchor = F.element_at("evidence", -1)
    titles = paras.select("doc_id", "paragraph", "chapter", "text")
    score = F.when(F.col("certainty") == "alta", 0.65).when(F.col("certainty") == "media", 0.55).otherwise(0.4)
    return (
        points.withColumn("_e", anchor)
        .withColumn("paragraph", F.col("_e.paragraph"))
        .join(titles, ["doc_id", "paragraph"])
        .select(
            "doc_id",
            short_hash(F.concat(F.lit("coerencia2:"), F.col("global_id"))).alias("finding_id"),
            "paragraph",
            "chapter",
            "text",
            F.col("_e.start").alias("start"),
            F.col("_e.end").alias("end"),
            F.lit("coerencia2_ia").alias("rule"),
            F.lit("narrative_global_ai").alias("category_code"),
            F.lit("possible_inconsistency").alias("severity"),
            F.when(F.col("certainty").isin("alta", "media"), "média").otherwise("baixa").alias("confidence"),
            score.alias("confidence_score"),
            F.slice("evidence", F.lit(1), F.size("evidence") - 1).alias("related"),
            "destination",
        )
    )


def check_relations(declared: DataFrame, offered: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(declared relations that stand, with problems; offered ids never declared).

    ``declared``: doc_id, finding_id, pos, with_id, kind, property, motive, quote;
    ``offered``: doc_id, finding_id, related_id; ``contexts``: doc_id, finding_id, context (texts sent).
    """
    known = offered.select("doc_id", "finding_id", F.col("related_id").alias("with_id"))
    valid = declared.where((F.col("with_id") != F.col("finding_id")) & F.col("kind").isin(*DECLARED_KINDS)).join(
        known, ["doc_id", "finding_id", "with_id"], "left_semi"
    )
    first = valid.groupBy("doc_id", "finding_id", "with_id").agg(
        F.min_by(F.struct("kind", "property", "motive", "quote"), "pos").alias("_d"), F.count_distinct("kind").alias("_kinds")
    ).where("_kinds = 1")
    rows = first.select("doc_id", "finding_id", "with_id", "_d.*").join(contexts, ["doc_id", "finding_id"], "left")
    prop, motive, quote = F.trim("property"), F.trim("motive"), F.trim(_without_marks(F.col("quote")))
    short = (F.size(F.filter(F.split(motive, r"\s+"), lambda w: w != "")) < 4) | (F.lower(motive) == F.lower(prop))
    problems = F.array_compact(
        F.array(
            F.when(F.col("kind").isin(*NEED_MOTIVE), F.when(motive == "", "motivo_ausente").when(short, "motivo_pouco_informativo")),
            F.when(F.col("kind").isin(*NEED_PROPERTY) & (prop == ""), "propriedade_ausente"),
        )
    )
    authentic = F.when(quote != "", F.coalesce(F.exists("context", lambda t: F.contains(t, quote)), F.lit(False)))
    out = (
        rows.withColumn("problems", problems)
        .withColumn("complete", F.size("problems") == 0)
        .withColumn("authentic", authentic)
        .withColumn("quote", F.when(F.coalesce(F.col("authentic"), F.lit(False)), F.substring(quote, 1, 200)).otherwise(""))
        .drop("context")
    )
    undeclared = known.join(out.select("doc_id", "finding_id", "with_id"), ["doc_id", "finding_id", "with_id"], "left_anti")
    return out, undeclared


def technical_level(exists: Column, certainty: Column) -> Column:
    return (
        F.when((exists == "sim") & (certainty == "clara"), "identificado")
        .when(exists == "sim", "discutivel")
        .when(exists == "nao", "nao_identificado")
        .otherwise("nao_estabelecido")
    )


def limitations(exists: Column, certainty: Column, sufficient: Column, evidence_count: Column, level: Column, more_context: Column) -> Column:
    """Structured reasons that limit a verdict."""
    return F.array_compact(
        F.array(
            F.when(exists == "incerto", "existencia_incerta"),
            F.when(~sufficient, "texto_insuficiente"),
            F.when((exists == "sim") & (certainty == "discutivel"), "certeza_discutivel"),
            F.when(F.coalesce(evidence_count, F.lit(0)) == 0, "sem_evidencia_verificada"),
            F.when(level == "contexto_parcial", "versao_diferente"),
            F.when(more_context, "contexto_pendente"),
        )
    )


def disagreement_meaning(decision: Column, state: Column, exists: Column) -> Column:
    return F.when(
        state == "contestada",
        F.when(decision.isin("Erro confirmado", "Aceito editorialmente") & (exists == "nao"), "problema_nao_existe")
        .when((decision == "Falso positivo") & (exists == "sim"), "problema_existe")
        .when(decision.isin(*PRESERVING) & (exists == "sim"), "desvio_nao_deliberado")
        .otherwise("discorda"),
    )


def reconcile_judgements(judged: DataFrame) -> DataFrame:
    """A contested verdict over the range of a kept one becomes inconclusive, with its rivals listed.

    ``judged``: doc_id, finding_id, paragraph, text, start, end, state and optionally
    ``independent_quote``; an independent question that falls on another judged
    range is dropped.
    """
    light = judged.select("doc_id", "paragraph", "start", "end", "finding_id", "state")
    rivals = (
        overlap_join(light.where(F.col("state") == "contestada"), light.where(F.col("state").isin("mantida", "apontamento_inadequado")))
        .where(F.col("a.finding_id") != F.col("b.finding_id"))
        .groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.finding_id").alias("finding_id"))
        .agg(F.array_sort(F.collect_set("b.finding_id")).alias("conflict_with"))
    )
    out = judged.join(rivals, ["doc_id", "finding_id"], "left").withColumn(
        "state", F.when(F.col("conflict_with").isNotNull(), "inconclusiva").otherwise(F.col("state"))
    )
    if "independent_quote" not in judged.columns:
        return out
    asking = judged.where(F.coalesce("independent_quote", F.lit("")) != "").select(
        "doc_id", "paragraph", "finding_id", "text", F.col("independent_quote").alias("_q")
    )
    hit = (
        asking.alias("q")
        .join(light.alias("o"), (F.col("q.doc_id") == F.col("o.doc_id")) & (F.col("q.paragraph") == F.col("o.paragraph")) & (F.col("q.finding_id") != F.col("o.finding_id")))
        .where(_covers(F.col("q.text"), F.col("o.start"), F.col("o.end"), F.col("q._q")))
        .groupBy(F.col("q.doc_id").alias("doc_id"), F.col("q.finding_id").alias("finding_id"))
        .agg(F.min("o.finding_id").alias("question_conflict"))
    )
    return out.join(hit, ["doc_id", "finding_id"], "left").withColumn(
        "independent_quote", F.when(F.col("question_conflict").isNull(), F.col("independent_quote"))
    )


def consistency_pairs(edges: DataFrame, verdicts: DataFrame, declarations: DataFrame) -> DataFrame:
    """State of each related pair: unavailable, declared contradiction or difference, aligned, unarticulated difference.

    ``edges``: doc_id, a, b, kind; ``verdicts`` (valid ones): doc_id, finding_id, existe,
    natureza, certeza; ``declarations``: doc_id, finding_id, with_id, kind, complete, authentic.
    """
    side = lambda p: verdicts.select(
        "doc_id", F.col("finding_id").alias(p), F.struct("existe", "natureza", "certeza").alias(f"_{p}f")
    )
    said = declarations.select("doc_id", F.col("finding_id").alias("_from"), F.col("with_id").alias("_to"), F.struct("kind", "complete", "authentic").alias("_d"))
    df = edges.join(side("a"), ["doc_id", "a"], "left").join(side("b"), ["doc_id", "b"], "left")
    df = df.join(said.select("doc_id", F.col("_from").alias("a"), F.col("_to").alias("b"), F.col("_d").alias("_ab")), ["doc_id", "a", "b"], "left")
    df = df.join(said.select("doc_id", F.col("_from").alias("b"), F.col("_to").alias("a"), F.col("_d").alias("_ba")), ["doc_id", "a", "b"], "left")
    said_both = F.array_compact(F.array("_ab", "_ba"))
    kinds = F.transform(said_both, lambda d: d["kind"])
    ea, eb = F.col("_af.existe"), F.col("_bf.existe")
    opposed = ea.isin("sim", "nao") & eb.isin("sim", "nao") & (ea != eb)
    same_q, differ_d = F.array_contains(kinds, "mesma_questao"), F.array_contains(kinds, "diferenca")
    complete = F.exists(said_both, lambda d: (d["kind"] == "diferenca") & d["complete"])
    state = (
        F.when(F.col("_af").isNull() | F.col("_bf").isNull(), "comparacao_indisponivel")
        .when(same_q & (differ_d | opposed), "contradicao_declarada")
        .when(complete, "diferenca_declarada")
        .when(F.col("_af") == F.col("_bf"), "classificacoes_alinhadas")
        .otherwise("diferenca_nao_articulada")
    )
    return (
        df.withColumn("state", state)
        .withColumn("attention", (F.col("state") == "contradicao_declarada") | ((F.col("state") == "diferenca_nao_articulada") & (ea != eb)))
        .select("doc_id", "a", "b", "kind", "state", F.coalesce("attention", F.lit(False)).alias("attention"))
    )


def consistency_dependencies(items: DataFrame, verdicts: DataFrame, declarations: DataFrame) -> DataFrame:
    """State of each declared dependency between valid verdicts: circular, not analysed, conditional or declared."""
    ok = verdicts.select("doc_id", "finding_id")
    depends = (
        declarations.where(F.col("kind") == "depende_de")
        .join(ok, ["doc_id", "finding_id"], "left_semi")
        .select("doc_id", F.col("finding_id").alias("a"), F.col("with_id").alias("b"))
        .distinct()
    )
    cycle = dependency_cycles(depends)
    mark = lambda c, name: cycle.select("doc_id", F.col("node").alias(c), F.lit(True).alias(name))
    target = verdicts.select("doc_id", F.col("finding_id").alias("b"), F.col("state").alias("_state"), F.lit(True).alias("_ok"))
    df = (
        depends.join(mark("a", "_ca"), ["doc_id", "a"], "left")
        .join(mark("b", "_cb"), ["doc_id", "b"], "left")
        .join(items.select("doc_id", F.col("finding_id").alias("b"), F.lit(True).alias("_known")), ["doc_id", "b"], "left")
        .join(target, ["doc_id", "b"], "left")
    )
    state = (
        F.when(F.col("_ca") & F.col("_cb"), "dependencia_circular")
        .when(F.col("_known").isNull() | F.col("_ok").isNull(), "dependencia_nao_analisada")
        .when(F.col("_state") == "inconclusiva", "dependencia_condicional")
        .otherwise("dependencia_declarada")
    )
    return df.select("doc_id", "a", "b", state.alias("state")).withColumn(
        "attention", F.col("state").isin("dependencia_circular", "dependencia_nao_analisada")
    )


def audit_acceptance(answers: DataFrame, paras: DataFrame, previous: DataFrame, enabled: Sequence[str] | None = None,
                     tense_scopes: Sequence[str] = ("narracao",)) -> DataFrame:
    """Adds ``result`` (accepted or the reason of discard), range and confidence of every audit answer.

    ``answers``: doc_id, pos, paragraph, excerpt, category, confidence; ``paras`` may
    carry ``roles``; ``previous``: ranges already reported.  "Already accepted" is an
    ordered condition, folded per paragraph over numbers only.
    """
    allowed = [c for c, rule in AUDIT_CATEGORIES.items() if not rule or enabled is None or rule in enabled]
    have = [c for c in ("text", "roles") if c in paras.columns]
    page = paras.select("doc_id", "paragraph", *have)
    located = answers.join(page, ["doc_id", "paragraph"], "left").withColumn(
        "start", F.when(F.trim("excerpt") != "", F.expr("locate(excerpt, text)") - 1)
    )
    located = located.withColumn("end", (F.col("start") + F.char_length("excerpt")).cast("int"))
    tense = F.lit(False)
    if "roles" in have:
        tense = (F.col("category") == "tempo_verbal") & F.exists(
            "roles", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")) & ~s["role"].isin(*tense_scopes)
        )
    reason = (
        F.when(F.col("text").isNull(), "paragrafo_fora")
        .when(F.coalesce(F.col("start"), F.lit(-1)) < 0, "trecho_inexistente")
        .when(~F.coalesce(F.col("category").isin(allowed), F.lit(False)), "fora_do_escopo")
        .when(F.coalesce(tense, F.lit(False)), "fora_do_escopo")
    )
    first = located.withColumn("_why", reason)
    candidates = first.where("_why IS NULL")
    ranges = previous.select("doc_id", "paragraph", "start", "end")
    clear = overlap_join(candidates.select("doc_id", "paragraph", "start", "end", "pos"), ranges, "left_semi").select("doc_id", "pos", F.lit(True).alias("_seen"))
    tested = candidates.join(clear, ["doc_id", "pos"], "left").withColumn(
        "_style", (F.col("category") == "repeticao") & ~F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).rlike(DOUBLED)
    )
    rows = tested.where("_seen IS NULL").groupBy("doc_id", "paragraph").agg(
        F.sort_array(F.collect_list(F.struct("pos", "start", "end", F.col("_style").alias("style")))).alias("_rows")
    )
    kind = rows.schema["_rows"].dataType.elementType.simpleString()

    def step(acc: Column, r: Column) -> Column:
        clash = F.exists(acc, lambda m: (m["result"] == "aceito") & (m["row"]["start"] < r["end"]) & (r["start"] < m["row"]["end"]))
        result = F.when(clash, "repetido").when(r["style"], "estilo").otherwise("aceito")
        return F.concat(acc, F.array(F.struct(result.alias("result"), r.alias("row"))))

    folded = rows.select("doc_id", F.explode(F.aggregate("_rows", F.array().cast(f"array<struct<result:string,row:{kind}>>"), step)).alias("_m")).select(
        "doc_id", F.col("_m.row.pos").alias("pos"), F.col("_m.result").alias("_result")
    )
    seen = tested.where("_seen").select("doc_id", "pos", F.lit("alerta_existente").alias("_result"))
    return (
        first.join(folded.unionByName(seen), ["doc_id", "pos"], "left")
        .withColumn("result", F.coalesce("_why", "_result"))
        .withColumn("confidence", F.when(F.col("confidence").isin("alta", "media", "média"), "média").otherwise("baixa"))
        .withColumn("confidence_score", F.when(F.col("confidence") == "média", 0.6).otherwise(0.4))
        .drop("_why", "_result", "text", "roles")
    )


def verdict_matrix(runs: DataFrame, versions: Sequence[str]) -> DataFrame:
    """One row per finding: technical tuple, legitimacy, adequacy, state and priority per engine version, and ``disagree``.

    ``runs``: doc_id, finding_id, version and the nullable fields of any version.
    """
    dash = F.lit("-")
    technical = F.concat_ws("/", *[F.coalesce(F.col(c), dash) for c in ("existe", "natureza", "certeza", "gravidade")])
    fallback = F.concat_ws("/", F.coalesce("procede", dash), dash, dash, dash)
    legitimacy = F.coalesce("razao_literaria", "legitimidade", "justificativa_editorial", dash)
    adequate = F.coalesce(
        "adequacao",
        F.when(F.col("coerente") == "sim", "adequada").when(F.col("coerente") == "nao", "inadequada").when(F.col("coerente") == "incerto", "indeterminada"),
        dash,
    )
    row = F.concat_ws(
        "|", F.when(F.col("existe").isNotNull(), technical).otherwise(fallback), legitimacy, adequate, F.coalesce("state", dash), F.coalesce("priority", dash)
    )
    wide = runs.withColumn("_row", row).groupBy("doc_id", "finding_id").pivot("version", list(versions)).agg(F.max("_row"))
    seen = F.array_distinct(F.array_compact(F.array(*[F.col(f"`{v}`") for v in versions])))
    return wide.withColumn("disagree", F.size(seen) > 1)

