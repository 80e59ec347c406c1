"""Rules over annotated tokens: one row per token, heads by position in the document.

``tokens``: doc_id, paragraph, sent, i, idx, text, lemma, pos, dep, head, morph (map).
Heads are looked up inside a sentence, never by graph walks over a document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import FINITE, FUTURE, NONFINITE, NONVERB, PAST, PRESENT, speech_verb

# ---- fixed values -----------------------------------------------------------------------------
AUXILIARY_DEPS = ("aux", "aux:pass", "cop")
VERBAL = ("VERB", "AUX")
TENSE_MINIMUM, TENSE_SHARE = 3, 0.7
CONTRADICTION_MINIMUM = 20
STRAIGHT_PRONOUNS = {"ele": "o", "ela": "a", "eles": "os", "elas": "as"}
INTRANSITIVE = (
    "ser estar ficar parecer permanecer continuar tornar virar chegar sair entrar voltar vir ir partir surgir aparecer "
    "nascer morrer cair correr sorrir rir acordar dormir existir acontecer restar sobrar faltar"
).split()
# -----------------------------------------------------------------------------------------------

_SENTENCE = ["doc_id", "paragraph", "sent"]


def _morph(name: str) -> Column:
    return F.try_element_at("morph", F.lit(name))


def conjugated(prefix: str = "") -> Column:
    """Verb or auxiliary the tagger marks as finite."""
    p = f"{prefix}." if prefix else ""
    return F.col(f"{p}pos").isin(*VERBAL) & F.coalesce(F.try_element_at(F.col(f"{p}morph"), F.lit("VerbForm")) == "Fin", F.lit(False))


def model_finite() -> Column:
    return F.col("pos").isin(*VERBAL) & (F.coalesce(_morph("VerbForm") == "Fin", F.lit(False)) | _morph("Mood").isNotNull())


def only_verb(flags: Column) -> Column:
    """The lexicon knows the form only as a finite verb."""
    return (flags.bitwiseAND(FINITE) != 0) & (flags.bitwiseAND(NONVERB | NONFINITE) == 0)


def with_head(tokens: DataFrame, columns: Sequence[str] = ("i", "text", "pos", "dep", "morph")) -> DataFrame:
    """Adds ``h`` (struct of the head token); the root is its own head."""
    heads = tokens.select(*_SENTENCE, F.col("i").alias("head"), F.struct(*columns).alias("h"))
    return tokens.join(heads, [*_SENTENCE, "head"], "left")


def predicate_head(tokens: DataFrame) -> DataFrame:
    """Adds ``predicate``: the head of an auxiliary or copula, the token itself otherwise."""
    return tokens.withColumn("predicate", F.when(F.col("dep").isin(*AUXILIARY_DEPS), F.col("head")).otherwise(F.col("i")))


def ancestors(tokens: DataFrame, max_depth: int = 200) -> DataFrame:
    """Adds ``path`` (positions from the token's predicate to the root) and ``relations`` along it.

    A sentence is gathered once, without an exchange where its document already lies together; depths come from
    doubled jumps, so a token climbs only as far as its root.  A head outside the sentence ends its path.
    """
    base = predicate_head(tokens)
    maps = [f.name for f in base.schema if f.dataType.typeName() == "map"]
    first = ["i", *[c for c in base.columns if c not in {"i", *_SENTENCE}]]
    flat = F.struct(*[(F.map_entries(c) if c in maps else F.col(c)).alias(c) for c in first])  # maps have no order
    lines = base.groupBy(*_SENTENCE).agg(F.array_sort(F.collect_list(flat)).alias("_t"))
    lines = lines.withColumn("_ids", F.transform("_t", lambda x: x["i"]))

    def place(position: Column) -> Column:
        """Where a position stands in the sentence; null outside it."""
        near = position - F.col("_ids")[0]
        found = F.array_position("_ids", position).cast("int")
        return F.when(F.get("_ids", near) == position, near).when(found > 0, found - 1)

    up = F.transform("_t", lambda x, k: F.coalesce(place(x["head"]), k))
    lines = lines.withColumn("_up", up)
    jump = F.struct(F.col("_up").alias("to"), F.transform("_up", lambda u, k: (u != k).cast("int")).alias("far"))
    twice = lambda a, _: F.struct(
        F.transform(a["to"], lambda j: a["to"][j]).alias("to"), F.zip_with(a["far"], a["to"], lambda far, j: far + a["far"][j]).alias("far"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("_t"))).cast("int"))
    lines = lines.withColumn("_j", F.aggregate(rounds, jump, twice))
    astray = F.exists("_j.to", lambda j: F.col("_up")[j] != j) | (F.array_max("_j.far") > max_depth)
    lines = lines.withColumn("_j", F.when(astray, F.raise_error(F.lit("heads form a cycle or a tree deeper than max_depth"))).otherwise(F.col("_j")))

    def hop(a: Column, _: Column) -> Column:
        x = F.get("_t", a["at"])
        stay = F.struct(F.lit(None).cast("int").alias("at"), a["path"].alias("path"), a["relations"].alias("relations"))
        on = F.struct(place(x["head"]).alias("at"), F.concat(a["path"], F.array(x["head"])).alias("path"), F.concat(a["relations"], F.array(x["dep"])).alias("relations"))
        return F.when(a["at"].isNull() | (x["head"] == x["i"]), stay).otherwise(on)

    def climb(x: Column) -> Column:
        start = F.struct(place(x["predicate"]).alias("at"), F.array(x["predicate"]).alias("path"), F.array().cast("array<string>").alias("relations"))
        return F.aggregate(F.sequence(F.lit(0), F.coalesce(F.get("_j.far", place(x["predicate"])), F.lit(0))), start, hop)

    walked = lines.withColumn("_w", F.transform("_t", climb)).select(*_SENTENCE, F.explode(F.arrays_zip("_t", "_w")).alias("_z"))
    column = lambda c: (F.map_from_entries(f"_z._t.{c}") if c in maps else F.col(f"_z._t.{c}")).alias(c)
    return walked.select(*[c if c in _SENTENCE else column(c) for c in base.columns], F.col("_z._w.path").alias("path"), F.col("_z._w.relations").alias("relations"))


def nearest_anchor(tokens: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adds ``anchor``: the only anchor verb whose predicate is the nearest ancestor that has any.

    ``anchors``: doc_id, paragraph, sent, predicate, anchor (position).  An ancestor with
    two anchors stops the search without a choice.
    """
    groups = anchors.groupBy(*_SENTENCE, F.col("predicate").alias("_node")).agg(F.count("*").alias("_n"), F.min("anchor").alias("_a"))
    walked = ancestors(tokens)
    up = walked.select(*_SENTENCE, "i", F.posexplode("path").alias("_k", "_node")).where("_k > 0")
    first = up.join(groups, [*_SENTENCE, "_node"]).groupBy(*_SENTENCE, "i").agg(F.min_by(F.struct("_n", "_a"), "_k").alias("_g"))
    return walked.join(first, [*_SENTENCE, "i"], "left").withColumn("anchor", F.when(F.col("_g._n") == 1, F.col("_g._a"))).drop("_g")


def narrative_tense(flags: Column, certain: Column) -> Column:
    """Past or present of a form that is certainly a finite verb; the lexicon decides.

    A form listed as both, or not listed, has no tense.  The past needs no agreement of
    the tagger; the present needs its indicative, which keeps imperatives apart.
    ``certain``: the positive evidence that the token is a finite verb.
    """
    past, present, future = (flags.bitwiseAND(f) != 0 for f in (PAST, PRESENT, FUTURE))
    indicative = model_finite() & F.coalesce(_morph("Mood") == "Ind", F.lit(False))
    listed = F.when(past & ~present & ~future, "passado").when(present & ~past & ~future & indicative, "presente")
    return F.when(F.coalesce(certain, F.lit(False)), listed)


def dominant_tense(tensed: DataFrame) -> DataFrame:
    """Per document: the tense of at least three verbs and 70 % of them; null when inconclusive.

    ``tensed``: doc_id, tense (null when unknown).
    """
    past, present = F.count_if(F.col("tense") == "passado"), F.count_if(F.col("tense") == "presente")
    counted = tensed.groupBy("doc_id").agg(past.alias("past"), present.alias("present"))
    top = F.greatest("past", "present")
    firm = (top >= TENSE_MINIMUM) & (top >= TENSE_SHARE * (F.col("past") + F.col("present")))
    return counted.withColumn("expected", F.when(firm, F.when(F.col("past") > F.col("present"), "passado").otherwise("presente")))


def tense_contradiction(chosen: Column) -> Column:
    """The other tense has twenty verbs or more and 70 % of them."""
    other = F.when(chosen == "passado", F.col("present")).when(chosen == "presente", F.col("past"))
    return F.coalesce((other >= CONTRADICTION_MINIMUM) & (other >= TENSE_SHARE * (F.col("past") + F.col("present"))), F.lit(False))


def tense_outliers(tensed: DataFrame, dominant: DataFrame) -> DataFrame:
    """Narrative verbs whose tense is not the expected one of their document."""
    return tensed.join(dominant.where("expected IS NOT NULL").select("doc_id", "expected"), "doc_id").where(
        F.col("tense").isNotNull() & (F.col("tense") != F.col("expected"))
    )


def double_auxiliary(tokens: DataFrame) -> DataFrame:
    """Two adjacent finite auxiliaries of one head."""
    finite = tokens.where(F.col("dep").isin(*AUXILIARY_DEPS) & conjugated())
    w = Window.partitionBy(*_SENTENCE, "head").orderBy("i")
    nxt = F.lead(F.struct("i", "idx", "text")).over(w)
    return finite.withColumn("_n", nxt).where((F.col("_n.i") == F.col("i") + 1) & (F.lower("_n.text") != F.lower("text"))).select(
        "doc_id", "paragraph", F.col("idx").alias("start"), (F.col("_n.idx") + F.char_length("_n.text")).alias("end"), "text", F.col("_n.text").alias("second")
    )


def subject_verb_number(tokens: DataFrame) -> DataFrame:
    """Plural subject with a singular finite verb."""
    subjects = tokens.where((F.col("dep") == "nsubj") & (_morph("Number") == "Plur"))
    verbs = tokens.where(conjugated() & (_morph("Number") == "Sing")).select(
        *_SENTENCE, F.col("i").alias("head"), F.col("idx").alias("start"), (F.col("idx") + F.char_length("text")).alias("end"), F.col("text").alias("verb")
    )
    return subjects.join(verbs, [*_SENTENCE, "head"]).select("doc_id", "paragraph", "start", "end", "verb", F.col("text").alias("subject"))


def object_pronoun(tokens: DataFrame) -> DataFrame:
    """Straight pronoun right after the verb it is the object of; suggests the clitic."""
    w = Window.partitionBy(*_SENTENCE).orderBy("i")
    nxt = F.lead(F.struct("i", "idx", "text", "dep", "head")).over(w)
    clitic = F.try_element_at(F.create_map(*[F.lit(x) for kv in STRAIGHT_PRONOUNS.items() for x in kv]), F.lower("_n.text"))
    return (
        tokens.withColumn("_n", nxt)
        .where((F.col("pos") == "VERB") & conjugated() & (F.col("_n.dep") == "obj") & (F.col("_n.head") == F.col("i")))
        .where(F.lower("_n.text").isin(*STRAIGHT_PRONOUNS) & ~speech_verb(F.col("text")) & ~F.lower("lemma").isin(*INTRANSITIVE))
        .select(
            "doc_id", "paragraph", F.col("idx").alias("start"), (F.col("_n.idx") + F.char_length("_n.text")).alias("end"),
            F.concat_ws("-", F.col("text"), clitic).alias("suggestion"),
        )
    )
