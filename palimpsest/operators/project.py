"""Incremental project state: changed chapters, carried facts, pairs to judge and pendencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import let, match_spans
from ..functions.text import normalize_quotes, short_hash
from .facts import _words_of, same_contradiction

# ---- fixed values -----------------------------------------------------------------------------
OPEN, CORRECTED, INTENTIONAL, RESOLVED = "aberta", "corrigida", "intencional", "resolvida_por_edicao"
CATEGORY, RULE, CODE = "Possível contradição", "coerencia_ia", "narrative_contradiction_ai"
# -----------------------------------------------------------------------------------------------


def changed_chapters(current: DataFrame, state: DataFrame, model: str, force: bool = False) -> DataFrame:
    """Every chapter of today or of the state with ``status``: changed, unchanged or removed.

    ``current``: doc_id, chapter_id, hash; ``state``: the same plus model.
    """
    old = state.select("doc_id", "chapter_id", F.col("hash").alias("_hash"), F.col("model").alias("_model"))
    both = current.join(old, ["doc_id", "chapter_id"], "full")
    status = (
        F.when(F.col("hash").isNull(), "removed")
        .when(F.lit(force) | ~F.col("hash").eqNullSafe(F.col("_hash")) | ~F.col("_model").eqNullSafe(F.lit(model)), "changed")
        .otherwise("unchanged")
    )
    return both.withColumn("status", status).drop("_hash", "_model")


def carry_facts(chapters: DataFrame, stored: DataFrame) -> DataFrame:
    """Facts of unchanged chapters at today's paragraphs; those to re-evaluate count as new.

    ``chapters``: output of ``changed_chapters`` with first_paragraph; ``stored``:
    doc_id, chapter_id, relative, reevaluate and fact columns.
    """
    kept = chapters.where(F.col("status") == "unchanged").select("doc_id", "chapter_id", "first_paragraph")
    return (
        stored.join(kept, ["doc_id", "chapter_id"])
        .withColumn("paragraph", (F.col("first_paragraph") + F.col("relative")).cast("int"))
        .withColumn("is_new", F.coalesce("reevaluate", F.lit(False)))
        .drop("first_paragraph", "reevaluate")
    )


def pairs_to_judge(pairs: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(pairs without a cached verdict, pairs answered by the cache with their verdict and tokens saved).

    ``pairs`` has ``request`` (what would be asked); ``cache``: cache_key, verdict, tokens.
    """
    keyed = pairs.withColumn("cache_key", F.sha2(F.concat_ws("\n", F.lit(model), "request"), 256))
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti"), keyed.join(cache, "cache_key")


def _sides(pendencies: DataFrame) -> DataFrame:
    return pendencies.select(
        "doc_id",
        "pendency_id",
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("side"), F.col("a_chapter").alias("chapter_id"), F.col("a_excerpt").alias("excerpt")),
                F.struct(F.lit("b").alias("side"), F.col("b_chapter").alias("chapter_id"), F.col("b_excerpt").alias("excerpt")),
            )
        ).alias("_s"),
    ).select("doc_id", "pendency_id", "_s.*")


def reconcile_pendencies(pendencies: DataFrame, chapters: DataFrame, paras: DataFrame) -> DataFrame:
    """Open pendencies that touch changed or removed chapters: closed when the quote vanished, moved otherwise.

    ``pendencies``: doc_id, pendency_id, status, a_chapter, a_relative, a_excerpt and the same for b;
    ``chapters``: doc_id, chapter_id, status; ``paras``: doc_id, chapter_id, relative, text.
    """
    live = _sides(pendencies.where(F.col("status") == OPEN))
    known = live.join(chapters.where("status <> 'removed'").select("doc_id", "chapter_id", F.col("status").alias("_cs")), ["doc_id", "chapter_id"], "left")
    touched = known.where("_cs = 'changed'").drop("_cs").withColumn("_q", normalize_quotes(F.col("excerpt")))
    pages = paras.select("doc_id", "chapter_id", "relative", normalize_quotes(F.col("text")).alias("_page"))
    places = (
        touched.join(pages, ["doc_id", "chapter_id"])
        .where(F.contains("_page", F.col("_q")))
        .groupBy("doc_id", "pendency_id", "side")
        .agg(F.min("relative").alias("_at"))
    )
    verdict = known.join(places, ["doc_id", "pendency_id", "side"], "left").groupBy("doc_id", "pendency_id").agg(
        F.max(F.col("_cs").isNull() | ((F.col("_cs") == "changed") & F.col("_at").isNull())).alias("_gone"),
        F.max(F.when(F.col("side") == "a", F.col("_at"))).alias("_a"),
        F.max(F.when(F.col("side") == "b", F.col("_at"))).alias("_b"),
        F.max(F.when(F.col("side") == "a", F.col("_cs").isNull() | ((F.col("_cs") == "changed") & F.col("_at").isNull()))).alias("_ga"),
    )
    out = pendencies.join(verdict, ["doc_id", "pendency_id"], "left")
    # The second side is only refreshed when the first one still stands.
    return (
        out.withColumn("status", F.when(F.col("_gone"), RESOLVED).otherwise(F.col("status")))
        .withColumn("a_relative", F.coalesce("_a", "a_relative"))
        .withColumn("b_relative", F.when(F.coalesce("_ga", F.lit(False)), F.col("b_relative")).otherwise(F.coalesce("_b", "b_relative")))
        .drop("_gone", "_a", "_b", "_ga")
    )


def pendency_key(prefix_a: str = "a", prefix_b: str = "b") -> Column:
    parts = [F.col(f"{prefix_a}_chapter"), normalize_quotes(F.col(f"{prefix_a}_excerpt")), F.col(f"{prefix_b}_chapter"), normalize_quotes(F.col(f"{prefix_b}_excerpt"))]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def _point() -> Column:
    side = lambda p: F.struct(
        F.concat_ws("\u0001", F.col(f"{p}_chapter"), F.col(f"{p}_relative").cast("string")).alias("paragraph"),
        normalize_quotes(F.col(f"{p}_excerpt")).alias("quote"),
        _words_of(normalize_quotes(F.col(f"{p}_excerpt"))).alias("words"),
    )
    return F.struct(side("a").alias("a"), side("b").alias("b"))


def upsert_pendencies(pendencies: DataFrame, judgements: DataFrame) -> DataFrame:
    """Pendencies after a round of confirmed judgements.

    The same key reopens what was corrected or resolved; any other state stays.
    A new judgement on a point already registered becomes related to it; the rest
    get the next numbers in order.  ``judgements``: doc_id, ord and both sides,
    explanation, confidence.
    """
    keyed = judgements.withColumn("pendency_key", pendency_key())
    first = keyed.groupBy("doc_id", "pendency_key").agg(F.min_by(F.struct(*[c for c in keyed.columns if c not in ("doc_id", "pendency_key")]), "ord").alias("_j"))
    news = first.select("doc_id", "pendency_key", "_j.*")
    old = pendencies.withColumn("pendency_key", pendency_key())
    hit = news.select("doc_id", "pendency_key", F.lit(True).alias("_again"))
    known = old.join(hit, ["doc_id", "pendency_key"], "left").withColumn(
        "status", F.when(F.col("_again") & F.col("status").isin(CORRECTED, RESOLVED), OPEN).otherwise(F.col("status"))
    ).drop("_again")
    fresh = news.join(old.select("doc_id", "pendency_key"), ["doc_id", "pendency_key"], "left_anti").withColumn("_point", _point())
    # Same point as a registered pendency (closed ones do not count).
    stands = known.where(F.col("status") != RESOLVED).select("doc_id", F.col("pendency_id").alias("_pid"), F.col("number").alias("_num"), _point().alias("_other"))
    # Candidate points share a paragraph, the equi-join key; the full test follows.
    places = lambda c: F.array_distinct(F.array(F.col(f"{c}.a.paragraph"), F.col(f"{c}.b.paragraph")))
    owner = (
        fresh.select("doc_id", "ord", "_point", F.explode(places("_point")).alias("_place"))
        .join(stands.select("doc_id", "_pid", "_num", "_other", F.explode(places("_other")).alias("_place")), ["doc_id", "_place"])
        .where(same_contradiction(F.col("_point"), F.col("_other")))
        .groupBy("doc_id", "ord")
        .agg(F.min(F.struct("_num", "_pid")).alias("_o"))
        .select("doc_id", "ord", F.col("_o._pid").alias("_owner"))
    )
    placed = fresh.join(owner, ["doc_id", "ord"], "left")
    top = pendencies.groupBy("doc_id").agg(F.max("number").alias("_max"))
    # Later new judgements may fall on the point of an earlier new one: greedy in order, per document.
    rows = placed.where("_owner IS NULL").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "pendency_key", F.col("_point").alias("point")))).alias("_rows"))
    kind = rows.schema["_rows"].dataType.elementType.simpleString()

    def step(acc: Column, r: Column) -> Column:
        same = F.filter(acc, lambda m: (m["lead"] == m["row"]["ord"]) & same_contradiction(r["point"], m["row"]["point"]))
        lead = F.coalesce(F.array_min(F.transform(same, lambda m: m["lead"])), r["ord"])
        return F.concat(acc, F.array(F.struct(lead.alias("lead"), r.alias("row"))))

    ord_kind = judgements.schema["ord"].dataType.simpleString()
    start = F.array().cast(f"array<struct<lead:{ord_kind},row:{kind}>>")
    led = rows.select("doc_id", F.explode(F.aggregate("_rows", start, step)).alias("_m")).select("doc_id", F.col("_m.row.ord").alias("ord"), F.col("_m.lead").alias("lead"))
    number = Window.partitionBy("doc_id").orderBy("ord")
    added = (
        placed.join(led.where("ord = lead").select("doc_id", "ord"), ["doc_id", "ord"], "left_semi")
        .join(top, "doc_id", "left")
        .withColumn("number", (F.coalesce("_max", F.lit(0)) + F.row_number().over(number)).cast("int"))
        .withColumn("pendency_id", F.format_string("C%03d", "number"))
        .withColumn("status", F.lit(OPEN))
    )
    new_ids = added.select("doc_id", F.col("ord").alias("lead"), F.col("pendency_id").alias("_lead_id"))
    related = (
        placed.join(led, ["doc_id", "ord"], "left")
        .join(new_ids, ["doc_id", "lead"], "left")
        .where(F.col("_owner").isNotNull() | (F.col("lead") != F.col("ord")))
        .groupBy("doc_id", F.coalesce("_owner", "_lead_id").alias("pendency_id"))
        .agg(F.count("*").cast("int").alias("_related"))
    )
    columns = ["doc_id", "pendency_id", "number", "pendency_key", "a_chapter", "a_relative", "a_excerpt", "b_chapter", "b_relative", "b_excerpt", "explanation", "confidence", "status"]
    everything = known.select(*columns, F.col("related") if "related" in known.columns else F.lit(0).alias("related")).unionByName(
        added.select(*columns, F.lit(0).alias("related"))
    )
    return everything.join(related, ["doc_id", "pendency_id"], "left").withColumn("related", (F.col("related") + F.coalesce("_related", F.lit(0))).cast("int")).drop("_related")


def chapter_status(chapters: DataFrame, pendencies: DataFrame) -> DataFrame:
    """Chapters with and without open pendencies."""
    open_ = _sides(pendencies.where(F.col("status") == OPEN)).select("doc_id", "chapter_id").distinct().withColumn("_open", F.lit(True))
    return chapters.join(open_, ["doc_id", "chapter_id"], "left").withColumn(
        "situation", F.when(F.col("_open"), "com_pendencias").otherwise("sem_pendencias")
    ).drop("_open")


def round_ledger(chapters: DataFrame, pairs: DataFrame, cached: DataFrame, calls: DataFrame, pendencies: DataFrame) -> DataFrame:
    """One row per document: chapters sent, pairs judged and cached, tokens, cost and open pendencies."""
    sent = chapters.groupBy("doc_id").agg(F.count_if(F.col("status") != "removed").alias("chapters"), F.count_if(F.col("status") == "changed").alias("sent"))
    judged = pairs.groupBy("doc_id").agg(F.count("*").alias("to_judge"))
    saved = cached.groupBy("doc_id").agg(F.count("*").alias("from_cache"), F.sum("tokens").alias("tokens_saved"))
    spent = calls.groupBy("doc_id").agg(F.sum("tokens").alias("tokens_spent"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))
    open_ = pendencies.groupBy("doc_id").agg(F.count_if(F.col("status") == OPEN).alias("open"))
    df = sent
    for part in (judged, saved, spent, open_):
        df = df.join(part, "doc_id", "left")
    return df.na.fill(0)


def _loose_range(text: Column, quote: Column) -> Column:
    """First place of the words of a quote in order, whatever signs lie between; the whole text when absent."""
    parts = F.regexp_extract_all(quote, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    pattern = F.concat(F.lit("(?iu)"), F.array_join(parts, r"[^\p{L}\p{N}_]+"))
    whole = F.struct(F.lit(0).alias("start"), F.char_length(text).alias("end"))
    return F.when(F.size(parts) == 0, whole).otherwise(
        let(
            match_spans(text, pattern),
            lambda m: F.when(F.size(m) > 0, F.struct(F.element_at(m, 1)["start"].alias("start"), F.element_at(m, 1)["end"].alias("end"))).otherwise(whole),
        )
    )


def pendencies_to_findings(pendencies: DataFrame, paras: DataFrame) -> DataFrame:
    """Open pendencies placed on today's paragraphs: the later side is the finding, the earlier one its evidence.

    ``paras``: doc_id, chapter_id, relative, paragraph, chapter, text.
    """
    page = lambda p: paras.select(
        "doc_id", F.col("chapter_id").alias(f"{p}_chapter"), F.col("relative").alias(f"{p}_relative"),
        F.col("paragraph").alias(f"{p}_paragraph"), F.col("text").alias(f"{p}_text"), F.col("chapter").alias(f"{p}_title"),
    )
    placed = (
        pendencies.where(F.col("status") == OPEN)
        .join(page("a"), ["doc_id", "a_chapter", "a_relative"])
        .join(page("b"), ["doc_id", "b_chapter", "b_relative"])
        .withColumn("_a", _loose_range(F.col("a_text"), F.col("a_excerpt")))
        .withColumn("_b", _loose_range(F.col("b_text"), F.col("b_excerpt")))
    )
    high = F.col("confidence") == "alta"
    related = F.array(
        F.struct(
            F.col("a_paragraph").alias("paragraph"), F.col("a_title").alias("chapter"), F.col("a_text").alias("text"),
            F.col("_a.start").alias("start"), F.col("_a.end").alias("end"), F.lit("atual").alias("document"),
        )
    )
    shaped = placed.select(
        "doc_id",
        "pendency_id",
        F.col("b_paragraph").alias("paragraph"),
        F.col("b_title").alias("chapter"),
        F.col("b_text").alias("text"),
        F.col("_b.start").alias("start"),
        F.col("_b.end").alias("end"),
        F.lit(CATEGORY).alias("category"),
        F.lit(RULE).alias("rule"),
        F.lit(CODE).alias("category_code"),
        F.lit("possible_inconsistency").alias("severity"),
        F.when(high, "alta").otherwise("média").alias("confidence"),
        F.when(high, F.lit(0.85)).otherwise(F.lit(0.65)).alias("confidence_score"),
        F.lit("contradictions · coerencia_ia").alias("source"),
        related.alias("related"),
    )
    own = short_hash(F.concat_ws(":", F.col("paragraph").cast("string"), "category", "source", F.col("start").cast("string"), F.col("end").cast("string"), "text"))
    return shaped.withColumn("finding_id", short_hash(F.concat(own, F.to_json("related"))))
