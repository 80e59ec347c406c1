"""Facts, contradictions and the evidence behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import explode_matches, let
from ..functions.text import entity_key, excerpt_pattern, find_excerpt, fold_signs, normalize_quotes

# ---- fixed values -----------------------------------------------------------------------------
CONFIDENCE_ORDER = ("alta", "media", "baixa")
SETTING_KIND = "ambiente"
MINIMUM_WORDS = 2
OVERLAP_SHARE = 0.6
# -----------------------------------------------------------------------------------------------


def verify_excerpts(facts: DataFrame, paras: DataFrame) -> DataFrame:
    """Adds ``valid`` and ``reason``: the quote must exist in the stated paragraph.

    With ``earlier_paragraph`` and ``earlier_excerpt`` (suggested conflicts) both
    sides are checked and the earlier one may not come later.  With
    ``scene_first`` / ``scene_last`` the paragraph must lie inside the scene.
    """
    pages = paras.select("doc_id", "paragraph", normalize_quotes(F.col("text")).alias("_page"))
    quoted = lambda page, quote: F.coalesce((quote != "") & F.contains(page, normalize_quotes(quote)), F.lit(False))
    df = facts.join(pages, ["doc_id", "paragraph"], "left").withColumn("_ok", quoted(F.col("_page"), F.col("excerpt"))).drop("_page")
    reason = F.lit("trecho inexistente")
    if "earlier_paragraph" in facts.columns:
        earlier = pages.withColumnRenamed("paragraph", "earlier_paragraph")
        df = df.join(earlier, ["doc_id", "earlier_paragraph"], "left")
        both = F.col("_ok") & quoted(F.col("_page"), F.col("earlier_excerpt")) & F.coalesce(F.col("earlier_paragraph") <= F.col("paragraph"), F.lit(False))
        df = df.withColumn("_ok", both).drop("_page")
        reason = F.lit("conflito com trecho inexistente")
    if "scene_first" in facts.columns:
        df = df.withColumn("_ok", F.col("_ok") & F.col("paragraph").between(F.col("scene_first"), F.col("scene_last")))
    return df.withColumn("valid", F.col("_ok")).withColumn("reason", F.when(~F.col("_ok"), reason)).drop("_ok")


def incompatible_facts(facts: DataFrame, suggested: DataFrame | None = None) -> DataFrame:
    """Pairs of facts with the same entity and aspect and different values in different paragraphs.

    ``facts``: doc_id, entity, aspect, value, paragraph, excerpt, is_new.  Facts are
    first reduced to distinct quotes per value, so copies of one fact do not
    multiply.  Suggested conflicts come first; both sides identify a pair.
    """
    keyed = facts.select(
        "doc_id",
        entity_key(F.col("entity")).alias("entity_key"),
        entity_key(F.col("aspect")).alias("aspect_key"),
        entity_key(F.col("value")).alias("value_key"),
        "paragraph",
        "excerpt",
        "is_new",
    )
    distinct = keyed.groupBy("doc_id", "entity_key", "aspect_key", "value_key", "paragraph", "excerpt").agg(F.max("is_new").alias("is_new"))
    # Groups where every value agrees have no pair to offer.
    disputed = distinct.groupBy("doc_id", "entity_key", "aspect_key").agg(
        F.min("value_key").alias("_lo"), F.max("value_key").alias("_hi"), F.max("is_new").alias("_any")
    ).where((F.col("_lo") != F.col("_hi")) & F.col("_any")).select("doc_id", "entity_key", "aspect_key")
    live = distinct.join(disputed, ["doc_id", "entity_key", "aspect_key"], "left_semi")
    side = lambda p: live.select(
        "doc_id", "entity_key", "aspect_key", *[F.col(c).alias(f"{p}_{c}") for c in ("value_key", "paragraph", "excerpt", "is_new")]
    )
    pairs = (
        side("a")
        .join(side("b"), ["doc_id", "entity_key", "aspect_key"])
        .where((F.col("a_paragraph") < F.col("b_paragraph")) & (F.col("a_value_key") != F.col("b_value_key")) & (F.col("a_is_new") | F.col("b_is_new")))
        .select("doc_id", F.lit("memoria").alias("origin"), "entity_key", "aspect_key", "a_paragraph", "a_excerpt", "b_paragraph", "b_excerpt")
    )
    if suggested is not None:
        offered = suggested.select(
            "doc_id",
            F.lit("extracao").alias("origin"),
            F.lit("").alias("entity_key"),
            F.lit("").alias("aspect_key"),
            F.col("earlier_paragraph").alias("a_paragraph"),
            F.col("earlier_excerpt").alias("a_excerpt"),
            F.col("paragraph").alias("b_paragraph"),
            F.col("excerpt").alias("b_excerpt"),
        )
        pairs = offered.unionByName(pairs)
    sides = ["doc_id", "a_paragraph", "a_excerpt", "b_paragraph", "b_excerpt"]
    # "extracao" sorts before "memoria": the suggestion keeps its place.
    return pairs.groupBy(*sides).agg(F.min(F.struct("origin", "entity_key", "aspect_key")).alias("_p")).select(*sides, "_p.*")


def relevant_facts(facts: DataFrame, scene_paras: DataFrame, limit: int | None = None) -> DataFrame:
    """Facts to carry into each scene: their entity occurs in it, or they describe the setting.

    All are returned, ``rank`` counts from the last one; a ``limit`` keeps the last ones only.

    ``facts``: doc_id, fact_order, entity, kind, scene (where it was read);
    ``scene_paras``: doc_id, scene, paragraph, text.  Only earlier scenes count.
    """
    known = facts.withColumnRenamed("scene", "fact_scene")
    spoken = explode_matches(
        scene_paras.select("doc_id", "scene", "paragraph", normalize_quotes(F.col("text")).alias("text")),
        r"[\p{L}\p{N}_]+",
        ["doc_id", "scene", "paragraph"],
    ).select("doc_id", "scene", F.col("match").alias("_w")).distinct()
    names = F.filter(F.split(entity_key(F.col("entity")), r"\s+"), lambda w: F.char_length(w) > 2)
    wanted = known.select("doc_id", "fact_order", "fact_scene", F.explode(names).alias("_w"))
    hits = wanted.join(spoken, ["doc_id", "_w"]).where("fact_scene < scene").select("doc_id", "scene", "fact_order").distinct()
    settings = known.where(F.col("kind") == SETTING_KIND).select("doc_id", "fact_order", "fact_scene")
    scenes = scene_paras.select("doc_id", "scene").distinct()
    carried = settings.join(scenes, "doc_id").where("fact_scene < scene").select("doc_id", "scene", "fact_order")
    last = Window.partitionBy("doc_id", "scene").orderBy(F.desc("fact_order"))
    ranked = hits.unionByName(carried).distinct().withColumn("rank", F.row_number().over(last))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def verify_evidence(evidence: DataFrame, paras: DataFrame) -> DataFrame:
    """Adds ``valid``, ``start``, ``end`` and ``reason``: a quote counts only with exactly one match in its paragraph.

    ``evidence``: evidence_id, doc_id, paragraph, excerpt.
    """
    pages = paras.select("doc_id", "paragraph", F.col("text").alias("_page"))
    word_count = F.size(F.filter(F.split("excerpt", r"(?U)\s+"), lambda w: w != ""))
    df = (
        evidence.join(pages, ["doc_id", "paragraph"], "left")
        .withColumn("_words", F.coalesce(word_count, F.lit(0)))
        .withColumn("_hits", F.when(F.col("_page").isNotNull() & (F.col("_words") >= MINIMUM_WORDS), find_excerpt(F.col("_page"), F.col("excerpt"))))
    )
    # Only documents with a quote missing from its paragraph are read whole, once each.
    lost = df.where(F.size("_hits") == 0).groupBy("doc_id").agg(F.collect_list(F.struct("evidence_id", "excerpt")).alias("_lost"))
    lines = F.sort_array(F.collect_list(F.struct("paragraph", "_page")))
    whole = pages.join(lost.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(
        F.array_join(F.transform(lines, lambda r: fold_signs(r["_page"])), "\u0001").alias("_all")
    )
    elsewhere = (
        whole.join(lost, "doc_id")
        .select(F.explode(F.filter("_lost", lambda q: F.regexp_like(F.col("_all"), excerpt_pattern(q["excerpt"])))).alias("_q"))
        .select(F.col("_q.evidence_id").alias("evidence_id"), F.lit(True).alias("_elsewhere"))
    )
    reason = (
        F.when(F.col("_page").isNull() | F.col("excerpt").isNull(), "paragrafo_inexistente")
        .when(F.col("_words") < MINIMUM_WORDS, "trecho_curto")
        .when(F.size("_hits") > 1, "ambigua")
        .when(F.size("_hits") == 1, F.lit(None))
        .when(F.col("_elsewhere"), "paragrafo_incorreto")
        .otherwise("trecho_inexistente")
    )
    one = F.size("_hits") == 1
    return (
        df.join(elsewhere, "evidence_id", "left")
        .withColumn("reason", reason)
        .withColumn("valid", F.coalesce(one, F.lit(False)))
        .withColumn("start", F.when(one, F.element_at("_hits", 1)["start"]))
        .withColumn("end", F.when(one, F.element_at("_hits", 1)["end"]))
        .drop("_page", "_words", "_hits", "_elsewhere")
    )


def _words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def _sides_overlap(x: Column, y: Column) -> Column:
    """Same paragraph and one quote inside the other, or most words shared."""

    def test(z: Column) -> Column:
        a, b = z["a"], z["b"]
        shared = F.size(F.array_intersect(z["wa"], z["wb"])) / F.nullif(F.least(F.size(z["wa"]), F.size(z["wb"])), F.lit(0))
        return F.contains(a, b) | F.contains(b, a) | F.coalesce(shared >= OVERLAP_SHARE, F.lit(False))

    pair = F.struct(x["quote"].alias("a"), y["quote"].alias("b"), x["words"].alias("wa"), y["words"].alias("wb"))
    return (x["paragraph"] == y["paragraph"]) & let(pair, test)


def same_contradiction(x: Column, y: Column) -> Column:
    """The same point of the text: same pair of distinct paragraphs, or overlapping quotes."""
    ax, bx, ay, by = x["a"], x["b"], y["a"], y["b"]
    straight = (ax["paragraph"] == ay["paragraph"]) & (bx["paragraph"] == by["paragraph"])
    crossed = (ax["paragraph"] == by["paragraph"]) & (bx["paragraph"] == ay["paragraph"])
    pair = (ax["paragraph"] != bx["paragraph"]) & (straight | crossed)
    return pair | _sides_overlap(ax, ay) | _sides_overlap(ax, by) | _sides_overlap(bx, ay) | _sides_overlap(bx, by)


def group_contradictions(confirmed: DataFrame, extra: str = "explanation") -> DataFrame:
    """Greedy grouping in order: each contradiction joins the first group with a matching member.

    ``confirmed``: doc_id, ord, a_paragraph, a_excerpt, b_paragraph, b_excerpt,
    confidence, explanation.  Confirmed contradictions of one document are the
    few that survived a judge; the best confidence of a group leads.
    """
    side = lambda p: F.struct(
        F.col(f"{p}_paragraph").alias("paragraph"), normalize_quotes(F.col(f"{p}_excerpt")).alias("quote"), _words_of(normalize_quotes(F.col(f"{p}_excerpt"))).alias("words")
    )
    rank = F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE_ORDER]), F.col("confidence")).cast("int")
    ranked = F.when(F.coalesce(rank, F.lit(0)) == 0, len(CONFIDENCE_ORDER) + 1).otherwise(rank)
    rows = confirmed.select("doc_id", F.struct("ord", side("a").alias("a"), side("b").alias("b"), ranked.alias("rank")).alias("_r"))
    listed = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("_r")).alias("_rows"))

    def step(acc: Column, r: Column) -> Column:
        hits = F.filter(acc, lambda m: same_contradiction(r, m["row"]))
        group = F.coalesce(F.array_min(F.transform(hits, lambda m: m["grp"])), F.coalesce(F.array_max(F.transform(acc, lambda m: m["grp"])), F.lit(0)) + 1)
        return F.concat(acc, F.array(F.struct(group.cast("int").alias("grp"), r.alias("row"))))

    row_type = listed.schema["_rows"].dataType.elementType.simpleString()
    start = F.array().cast(f"array<struct<grp:int,row:{row_type}>>")
    members = (
        listed.withColumn("_g", F.aggregate("_rows", start, step))
        .select("doc_id", F.explode("_g").alias("_m"))
        .select("doc_id", F.col("_m.grp").alias("group"), F.col("_m.row.ord").alias("ord"), F.col("_m.row.rank").alias("_rank"))
    )
    lead = members.groupBy("doc_id", "group").agg(F.min(F.struct("_rank", "ord")).alias("_lead"), F.count("*").alias("members"))
    return members.join(lead, ["doc_id", "group"]).select(
        "doc_id", "group", "ord", "members", (F.col("ord") == F.col("_lead.ord")).alias("leads")
    )


def match_contradictions(detected: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold contradictions with ``found`` (the detection used); each detection serves once, in order.

    ``detected``: case_id, ord, a_paragraph, a_excerpt, b_paragraph, b_excerpt;
    ``gold``: case_id, gold_ord, paragraph, against, excerpt.
    """
    g, d = gold.alias("g"), detected.alias("d")
    touches = (F.col("g.paragraph") == F.col("d.a_paragraph")) | (F.col("g.paragraph") == F.col("d.b_paragraph"))
    pair = ((F.col("g.against") == F.col("d.a_paragraph")) | (F.col("g.against") == F.col("d.b_paragraph"))) & (F.col("g.against") != F.col("g.paragraph"))
    target = normalize_quotes(F.col("g.excerpt"))
    quote = lambda s: (F.col(f"d.{s}_paragraph") == F.col("g.paragraph")) & (
        F.contains(normalize_quotes(F.col(f"d.{s}_excerpt")), target) | F.contains(target, normalize_quotes(F.col(f"d.{s}_excerpt")))
    )
    edges = g.join(d, F.col("g.case_id") == F.col("d.case_id")).where(touches & (pair | quote("a") | quote("b"))).select(
        F.col("g.case_id").alias("case_id"), F.col("g.gold_ord").alias("gold_ord"), F.col("d.ord").alias("ord")
    )
    options = edges.groupBy("case_id", "gold_ord").agg(F.sort_array(F.collect_set("ord")).alias("ords"))
    listed = options.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("gold_ord", "ords"))).alias("_rows"))
    kind = listed.schema["_rows"].dataType.elementType["ords"].dataType.elementType.simpleString()
    gold_kind = listed.schema["_rows"].dataType.elementType["gold_ord"].dataType.simpleString()

    def step(acc: Column, r: Column) -> Column:
        free = F.array_except(r["ords"], F.transform(acc, lambda m: m["ord"]))
        pick = F.array_min(free)
        return F.when(pick.isNull(), acc).otherwise(F.concat(acc, F.array(F.struct(r["gold_ord"].alias("gold_ord"), pick.alias("ord")))))

    start = F.array().cast(f"array<struct<gold_ord:{gold_kind},ord:{kind}>>")
    used = listed.select("case_id", F.explode(F.aggregate("_rows", start, step)).alias("_m")).select("case_id", "_m.gold_ord", F.col("_m.ord").alias("used"))
    return gold.join(used, ["case_id", "gold_ord"], "left").withColumn("found", F.col("used").isNotNull())

