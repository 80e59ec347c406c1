"""Precision, detection scores, samples, stability and cost, all as grouped aggregates.

Votes are reduced with ``max_by`` (partial aggregation), never by a window over a
hot class or book.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import WORD, let, match_spans
from ..functions.text import excerpt, quoted_word_pattern, unit_interval_hash
from ..sources.scratch import written
from .findings import from_checker, overlap_join
from .policy import statistical_class

# ---- fixed values -----------------------------------------------------------------------------
OUTCOMES = {
    "Erro confirmado": "erro",
    "Corrigido": "erro",
    "Falso positivo": "falso_positivo",
    "Estilo do autor": "estilo",
    "Intencional": "intencional",
    "Aceito editorialmente": "aceito",
}
OUTCOME_NAMES = ("erro", "falso_positivo", "estilo", "intencional", "aceito")
VERDICTS = ("procedente", "improcedente", "duvidoso")
SAMPLE_STRATA = (
    "homografo_nome_verbo",
    "infinitivo_ou_futuro_subjuntivo",
    "inicio_de_frase",
    "discordancia",
    "controle_verbo",
    "controle_nao_verbal",
)
# -----------------------------------------------------------------------------------------------


def _outcome(decision: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv]), decision)


def vote_place(text: Column, start: Column, end: Column) -> Column:
    """Digest of a paragraph, its marked excerpt and where that starts."""
    return F.sha2(F.concat_ws("\u0001", text, excerpt(text, start, end), start.cast("string")), 256)


def votes(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """One vote per (book, class, text, excerpt, start): the latest report wins; pending is out.

    ``findings``: doc_id (report), book, report_time, finding_id, text, start, end (or ``place`` instead of the text) and
    classification columns; ``decisions``: doc_id, finding_id, decision.
    """
    place = F.col("place") if "place" in findings.columns else vote_place(F.col("text"), F.col("start"), F.col("end"))
    decided = (
        findings.withColumn("class", statistical_class(findings))
        # The paragraph itself never travels: its digest is the key.
        .withColumn("_place", place)
        .drop("text")
        .join(decisions.select("doc_id", "finding_id", "decision"), ["doc_id", "finding_id"])
        .withColumn("outcome", _outcome(F.col("decision")))
        .where("outcome IS NOT NULL")
    )
    extra = [c for c in ("source", "checker_category", "checker_type") if c in decided.columns]
    row = F.struct(
        F.coalesce("confidence", F.lit("sem")).alias("confidence"),
        F.coalesce("severity", F.lit("sem")).alias("severity"),
        "outcome",
        "decision",
        *extra,
    )
    return (
        decided.groupBy("book", "class", "_place")
        .agg(F.max_by(row, F.struct("report_time", "doc_id", "finding_id")).alias("_v"))
        .select("book", "class", "_v.*")
    )


def precision_by_class(ballots: DataFrame, minimum: int = 20, threshold: float = 0.9) -> DataFrame:
    """Decisions, outcomes and precision per class and confidence, with the numeric flags of the policy."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOME_NAMES]
    grouped = ballots.groupBy("class", "confidence").agg(F.count("*").alias("decisions"), *counts)
    precision = F.col("erro") / F.col("decisions")
    return (
        grouped.withColumn("precision", F.bround(precision, 3))
        .withColumn("measured", F.col("decisions") >= minimum)
        .withColumn("reaches_threshold", (F.col("decisions") >= minimum) & (precision >= threshold))
    )


def severity_histogram(ballots: DataFrame) -> DataFrame:
    return ballots.groupBy("class", "confidence", "severity").agg(F.count("*").alias("decisions"))


def precision_totals(by_class: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("decisions", *OUTCOME_NAMES)]
    return by_class.agg(*sums).withColumn("precision", F.bround(F.col("erro") / F.col("decisions"), 3))


def precision_by_book(ballots: DataFrame) -> DataFrame:
    return ballots.groupBy("book").agg(F.count("*").alias("decisions"))


def precision_by_checker_rule(ballots: DataFrame) -> DataFrame:
    """External checker votes per rule, its category and type, and class."""
    rule = F.element_at(F.split("source", " · "), -1)
    named = (
        ballots.where(from_checker(F.col("source")))
        .withColumn("checker_rule", rule)
        .withColumn("checker_category", F.coalesce("checker_category", F.lit("não registrada")))
        .withColumn("checker_type", F.coalesce("checker_type", F.lit("não registrado")))
    )
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOME_NAMES]
    return (
        named.groupBy("checker_rule", "checker_category", "checker_type", "class")
        .agg(F.count("*").alias("decisions"), *counts)
        .withColumn("precision", F.bround(F.col("erro") / F.col("decisions"), 3))
    )


# ---- detection against an annotated corpus ----------------------------------------------------
def locate_gold(gold: DataFrame, paras: DataFrame) -> DataFrame:
    """Adds ``start`` and ``end`` of the n-th whole-word occurrence of ``excerpt`` (null when absent)."""
    joined = gold.join(paras.select("doc_id", "paragraph", "text"), ["doc_id", "paragraph"])
    hits = match_spans(F.col("text"), quoted_word_pattern(F.col("excerpt")))
    chosen = let(hits, lambda h: F.try_element_at(h, F.coalesce("n", F.lit(1)).cast("int")))
    return joined.withColumn("_m", chosen).withColumn("start", F.col("_m.start")).withColumn("end", F.col("_m.end")).drop("_m", "text")


def finding_spans(findings: DataFrame) -> DataFrame:
    """Main range and current related evidence of every finding, one row each."""
    main = findings.select("doc_id", "finding_id", "module", "destination", "paragraph", "start", "end")
    if "related" not in findings.columns:
        return main
    related = (
        findings.select("doc_id", "finding_id", "module", "destination", F.explode("related").alias("_e"))
        .where("_e.document = 'atual'")
        .select("doc_id", "finding_id", "module", "destination", F.col("_e.paragraph").alias("paragraph"), F.col("_e.start").alias("start"), F.col("_e.end").alias("end"))
    )
    return main.unionByName(related)


def match_gold(findings: DataFrame, errors: DataFrame, tolerated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings with ``outcome``, errors with ``found`` and ``found_by_rules``).

    ``errors`` and ``tolerated`` are located (see ``locate_gold``) with ``error_id``
    or ``tolerated_id``.
    """
    ranges = finding_spans(findings)
    hits = overlap_join(ranges, errors).select(
        F.col("a.doc_id").alias("doc_id"), F.col("a.finding_id").alias("finding_id"), F.col("b.error_id").alias("error_id"), F.col("a.module").alias("module")
    )
    errors_hit = hits.groupBy("doc_id", "error_id").agg(F.max(F.coalesce(F.col("module") != "audit", F.lit(True))).alias("found_by_rules"))
    scored = (
        errors.join(errors_hit, ["doc_id", "error_id"], "left")
        .withColumn("found", F.col("found_by_rules").isNotNull())
        .withColumn("found_by_rules", F.coalesce("found_by_rules", F.lit(False)))
    )
    true_ids = hits.select("doc_id", "finding_id").distinct().withColumn("_true", F.lit(True))
    neutral = (
        overlap_join(ranges, tolerated)
        .select(F.col("a.doc_id").alias("doc_id"), F.col("a.finding_id").alias("finding_id"))
        .distinct()
        .withColumn("_neutral", F.lit(True))
    )
    # An audit finding only over errors the rules already had adds nothing new.
    audit = (
        hits.where("module = 'audit'")
        .join(errors_hit, ["doc_id", "error_id"])
        .groupBy("doc_id", "finding_id")
        .agg(F.min("found_by_rules").alias("_already"))
    )
    outcome = F.when(F.col("_true"), "true").when(F.col("_neutral"), "neutral").otherwise("false_alarm")
    judged = (
        findings.join(true_ids, ["doc_id", "finding_id"], "left")
        .join(neutral, ["doc_id", "finding_id"], "left")
        .join(audit, ["doc_id", "finding_id"], "left")
        .withColumn("outcome", outcome)
        .withColumn("already_found", F.col("_already"))
        .drop("_true", "_neutral", "_already")
    )
    return judged, scored


def detection_summary(judged: DataFrame, scored: DataFrame, paras: DataFrame) -> DataFrame:
    """One row: coverage, precision and false alarms per 10,000 words, for all findings and for the queue."""
    words = paras.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("words"))
    queue = F.coalesce("destination", F.lit("pendencia")) == "pendencia"
    true, false = F.col("outcome") == "true", F.col("outcome") == "false_alarm"
    found = judged.agg(
        F.count("*").alias("findings"),
        F.count_if(true).alias("true_findings"),
        F.count_if(F.col("outcome") == "neutral").alias("neutral_findings"),
        F.count_if(false).alias("false_alarms"),
        F.count_if(true & queue).alias("queue_true"),
        F.count_if(false & queue).alias("queue_false"),
    )
    expected = scored.agg(F.count("*").alias("expected"), F.count_if("found").alias("found"), F.count_if(F.col("found") & ~F.col("found_by_rules")).alias("audit_only"))
    rate = lambda n, d, scale, digits: F.when(F.col(d) > 0, F.bround(F.col(n) * scale / F.col(d), digits))
    # Three one-row aggregates side by side.
    one = F.lit(1)
    joined = found.withColumn("_k", one).join(expected.withColumn("_k", one), "_k").join(words.withColumn("_k", one), "_k").drop("_k")
    return (
        joined.withColumn("_judged", F.col("true_findings") + F.col("false_alarms"))
        .withColumn("_queue", F.col("queue_true") + F.col("queue_false"))
        .withColumn("precision", rate("true_findings", "_judged", 1.0, 3))
        .withColumn("false_alarms_per_10k_words", rate("false_alarms", "words", 10000.0, 1))
        .withColumn("queue_precision", rate("queue_true", "_queue", 1.0, 3))
        .withColumn("queue_false_alarms_per_10k_words", rate("queue_false", "words", 10000.0, 1))
        .drop("_judged", "_queue")
    )


def detection_by(scored: DataFrame, column: str) -> DataFrame:
    """Expected and found errors per category or layer."""
    return scored.groupBy(column).agg(F.count("*").alias("expected"), F.count_if("found").alias("found"))


# ---- stability, samples, operations -----------------------------------------------------------
def run_stability(runs: DataFrame, run_count: int) -> DataFrame:
    """Per id over the runs: mode (a tie goes to the state of the earliest run), agreement and kind of variation.

    ``runs``: run (1…run_count), item_id, state, core (what was concluded, without the label).
    """
    absent = "\u0000"
    base = runs.groupBy("item_id").agg(
        F.count("*").alias("_seen"),
        F.count_distinct("state").alias("_states"),
        F.count_distinct("core").alias("_cores"),
        F.max(F.col("state") == "contestada").alias("_contested"),
        F.max(F.col("state") != "contestada").alias("_other"),
        F.array_agg("run").alias("_runs"),
    )
    per_state = runs.groupBy("item_id", "state").agg(F.count("*").alias("_n"), F.min("run").alias("_first"))
    missing_first = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(run_count)), F.col("_runs").cast("array<int>")))
    missing = (
        base.where(F.col("_seen") < run_count)
        .select("item_id", F.lit(absent).alias("state"), (F.lit(run_count) - F.col("_seen")).alias("_n"), missing_first.alias("_first"))
    )
    mode = per_state.unionByName(missing).groupBy("item_id").agg(
        F.max_by(F.struct("state", "_n"), F.struct(F.col("_n"), -F.col("_first"))).alias("_m")
    )
    complete = F.col("_seen") == run_count
    kind = (
        F.when(complete & (F.col("_states") == 1), "estavel").when(complete & (F.col("_cores") == 1), "so_rotulo").otherwise("interpretacao")
    )
    return base.join(mode, "item_id").select(
        "item_id",
        F.nullif(F.col("_m.state"), F.lit(absent)).alias("mode"),
        F.bround(F.col("_m._n") / run_count, 3).alias("agreement"),
        kind.alias("kind"),
        (F.col("_contested") & (F.col("_other") | ~complete)).alias("crosses_contestation"),
    )


def stability_summary(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count("*").alias("items"),
        F.count_if(F.col("kind") == "estavel").alias("stable"),
        F.count_if(F.col("kind") == "so_rotulo").alias("label_only"),
        F.count_if(F.col("kind") == "interpretacao").alias("interpretation"),
        F.count_if("crosses_contestation").alias("cross_contestation"),
        F.bround(F.coalesce(F.avg("agreement"), F.lit(0.0)), 3).alias("mean_agreement"),
    )


def operation_metrics(items: DataFrame) -> DataFrame:
    """Precision and recall of the three verb readings against finite / non-finite / non-verbal labels.

    ``items``: stratum, expected, ambiguous, certain, possible, present.
    """
    clear = items.where(~F.col("ambiguous"))
    finite, nonverbal = F.col("expected") == "finito", F.col("expected") == "nao_verbal"
    share = lambda cond, within: F.bround(F.count_if(cond & within) / F.nullif(F.count_if(within), F.lit(0)), 3)
    return clear.groupBy("stratum").agg(
        F.count("*").alias("items"),
        share(finite, F.col("certain")).alias("certain_precision"),
        share(F.col("certain"), finite).alias("certain_recall"),
        F.count_if(F.col("certain") & ~finite).alias("certain_false"),
        share(F.col("possible"), finite).alias("possible_recall"),
        share(F.col("possible"), nonverbal).alias("possible_on_nonverbal"),
        share(F.col("present"), finite).alias("present_recall"),
        share(F.col("present"), nonverbal).alias("present_on_nonverbal"),
        F.count_if(F.col("certain") == finite).alias("certain_right"),
        F.count_if(finite & ~F.col("possible")).alias("possible_missed"),
        F.every(~F.col("certain") | F.col("possible")).alias("certain_implies_possible"),
    )


def hash_sample(df: DataFrame, key: Column, rate: float) -> DataFrame:
    """Deterministic draw from the row key."""
    return df.where(unit_interval_hash(key) < rate)


def _seeded(seed: str, *columns: str) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(seed), *[F.col(c).cast("string") for c in columns]), 256)


def stratified_sample(
    candidates: DataFrame,
    strata: Sequence[str] = SAMPLE_STRATA,
    per_stratum: int = 25,
    per_form: int = 2,
    seed: str = "1",
) -> DataFrame:
    """Per (set, stratum): seeded order, each form at most ``per_form`` times, an item used once across strata.

    ``candidates``: item_id, sample_set, form and ``strata`` (array of names).  They are read twice, in two
    narrow passes: the first counts, per form, how many rows stand at each level of the seeded order (its
    leading zero bits), the second brings only the rows that can be drawn even if ``spare`` rows were used
    by earlier strata.  Where more were, both limits are widened, so the draw is that from all rows.
    """
    place = ["sample_set", "stratum", "_form"]
    order = F.sha2(F.concat_ws("\u0001", F.concat(F.lit(f"{seed}:"), "stratum"), F.col("item_id").cast("string")), 256)
    listed = F.explode(F.array_intersect(F.array(*[F.lit(s) for s in strata]), "strata"))
    keyed = candidates.select("item_id", "sample_set", "form", F.lower("form").alias("_form"), listed.alias("stratum")).withColumn("_order", order)
    keyed = keyed.withColumn("_level", 60 - F.char_length(F.bin(F.conv(F.substring("_order", 1, 15), 16, 10).cast("long"))))
    levels = written(keyed.groupBy(*place, "_level").agg(F.count(F.lit(1)).alias("_rows")), "levels")
    spare = per_stratum
    while True:
        rows = written(_within_reach(keyed, levels, place, per_stratum + spare, per_form + spare), "reach")
        chosen, used = _drawn(rows, strata, per_stratum, per_form)
        if used <= spare:
            return chosen
        spare = 2 * used


def _same(a: str, b: str, columns: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def _within_reach(keyed: DataFrame, levels: DataFrame, place: Sequence[str], forms: int, rows: int) -> DataFrame:
    """The first ``rows`` rows of each form or more, down to the level at which so many ``forms`` have appeared."""
    group = [c for c in place if c != "_form"]
    before = F.sum("_rows").over(Window.partitionBy(*place).orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, -1))
    least = levels.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < rows).groupBy(*place).agg(F.min("_level").alias("_least"), F.max("_level").alias("_top"))
    first = least.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_top"), "_form"))).where(F.col("_n") <= forms)
    floor = first.groupBy(*group).agg(F.when(F.count(F.lit(1)) >= forms, F.min("_top")).otherwise(0).alias("_floor"))
    limits = least.alias("l").join(floor.alias("f"), _same("l", "f", group)).where(F.col("_top") >= F.col("_floor"))
    limits = written(limits.select(*[F.col(f"l.{c}") for c in place], F.greatest("_least", "_floor").alias("_least")), "limits")
    return keyed.alias("k").join(limits.alias("l"), _same("k", "l", place) & (F.col("_level") >= F.col("_least")), "left_semi")


def _drawn(rows: DataFrame, strata: Sequence[str], per_stratum: int, per_form: int) -> tuple[DataFrame, int]:
    """The draw, stratum by stratum, and how many rows of one set and stratum earlier strata had used at most."""
    by_form = Window.partitionBy("sample_set", "_form").orderBy("_order", "item_id")
    by_set = Window.partitionBy("sample_set").orderBy("_order", "item_id")
    chosen: DataFrame | None = None
    most = 0
    for stratum in strata:
        group = rows.where(F.col("stratum") == stratum)
        if chosen is not None:
            taken = group.join(chosen.select("item_id"), "item_id", "left_semi").groupBy("sample_set").count()
            most = max(most, taken.agg(F.max("count")).first()[0] or 0)
            group = group.join(chosen.select("item_id"), "item_id", "left_anti")
        picked = (
            group.withColumn("_f", F.row_number().over(by_form))
            .where(F.col("_f") <= per_form)
            .withColumn("_n", F.row_number().over(by_set))
            .where(F.col("_n") <= per_stratum)
            .select("item_id", "sample_set", "form", "stratum")
        )
        picked = written(picked, "drawn")
        chosen = picked if chosen is None else chosen.unionByName(picked)
    assert chosen is not None
    return chosen, most


def complement_sample(findings: DataFrame, chosen: DataFrame, k: int = 3, seed: str = "v3") -> DataFrame:
    """``k`` further findings of different categories: categories of no chosen item first, then the others."""
    reserve = findings.join(chosen.select("finding_id"), "finding_id", "left_anti")
    used = findings.join(chosen.select("finding_id"), "finding_id", "left_semi").select("category").distinct().withColumn("_used", F.lit(1))
    best = reserve.groupBy("category").agg(F.min_by("finding_id", _seeded(seed, "finding_id")).alias("finding_id"))
    ranked = best.join(used, "category", "left").withColumn("_used", F.coalesce("_used", F.lit(0)))
    return ranked.orderBy("_used", _seeded(seed, "category")).limit(k).select("finding_id", "category")


def usage_totals(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Token sums that are null when any value is missing; cost and distinct models."""
    total = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))
    return (
        calls.groupBy(*by)
        .agg(
            F.count("*").alias("calls"),
            total("tokens_in").alias("tokens_in"),
            total("tokens_cached").alias("tokens_cached"),
            total("tokens_cache_written").alias("tokens_cache_written"),
            total("tokens_out").alias("tokens_out"),
            F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("cost_usd"),
            F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
        )
        .withColumn("tokens_uncached", F.col("tokens_in") - F.col("tokens_cached") - F.col("tokens_cache_written"))
    )


def cost_plan(batches: DataFrame, prices: DataFrame, fixed_tokens: float, out_fixed: float, out_per_item: float, out_limit: float, keys: Sequence[str] = ("plan",)) -> DataFrame:
    """Cost of the requests of a plan without sending them.

    ``batches``: plan keys, model, batch (1…n), items, tokens; ``prices``: model, input,
    cache_write, cache_read, output (USD per million tokens).  The first batch pays
    the cache write, later ones the cache read.
    """
    joined = batches.join(prices, "model")
    first = F.col("batch") == 1
    cache = F.lit(fixed_tokens) * F.when(first, F.col("cache_write")).otherwise(F.col("cache_read"))
    out = F.least(F.lit(out_fixed) + F.lit(out_per_item) * F.col("items"), F.lit(out_limit))
    expected = (cache + F.col("tokens") * F.col("input") + out * F.col("output")) / 1e6
    worst = ((F.lit(fixed_tokens) + F.col("tokens")) * F.col("cache_write") + F.lit(out_limit) * F.col("output")) / 1e6
    return (
        joined.withColumn("_e", expected)
        .withColumn("_w", worst)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("requests"),
            F.sum("items").alias("items"),
            F.round(F.sum("_e") * 0.5, 4).alias("minimum_usd"),
            F.round(F.sum("_e"), 4).alias("expected_usd"),
            F.round(F.sum("_w"), 4).alias("maximum_usd"),
            F.round(F.max("_w"), 4).alias("worst_request_usd"),
        )
    )


def judgement_precision(items: DataFrame) -> DataFrame:
    """Per engine version: decided, upheld, precision and items without a verdict."""
    decided = F.col("verdict").isin(*VERDICTS)
    return items.groupBy("version").agg(
        F.count_if(decided).alias("decided"),
        F.count_if(F.col("verdict") == "procedente").alias("upheld"),
        F.bround(F.count_if(F.col("verdict") == "procedente") / F.nullif(F.count_if(decided), F.lit(0)), 3).alias("precision"),
        F.count_if(F.col("verdict").isNull()).alias("without_verdict"),
    )


def vocabulary_filter(sentences: DataFrame, words: DataFrame, lexicon: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sentences whose every lower-case word is in the lexicon (``words`` carries the sentence keys)."""
    from ..functions.text import lexicon_key

    known = lexicon.where("flags <> 0").select(F.col("word").alias("_key"))
    unknown = (
        words.where(F.col("word").rlike(r"^\p{Ll}"))
        .select(*keys, lexicon_key(F.col("word")).alias("_key"))
        .join(known, "_key", "left_anti")
        .select(*keys)
        .distinct()
    )
    return sentences.join(unknown, list(keys), "left_anti")
