"""Repetition, name variants, checker matches and cuts against an earlier version."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import cuts
from ..functions.spans import SENTENCE, WORD, explode_matches, let, match_spans
from ..functions.text import (
    ENCLITIC,
    PARTICLES,
    ends_in_dash,
    is_credit_line,
    is_expressive,
    is_upper,
    lexicon_key,
    normalized_words,
    starts_upper,
    strip_accents,
    stripped,
    utf16_to_codepoint,
)
from .rules import speech_verb

# ---- fixed values -----------------------------------------------------------------------------
COMMON_WORDS = (
    "a o as os um uma uns umas de da do das dos em no na nos nas por para pra com sem e ou mas que se eu tu ele ela eles "
    "elas nós vós você vocês me te lhe lhes meu minha seus suas seu sua isso isto esse essa este esta ao aos à às não sim "
    "já só mais muito como quando porque então era foi tinha havia estava ser estar ter faz fez fazer disse dizer é está "
    "são eram foram pelo pela pelos pelas comigo contigo consigo assim aqui ali tudo nada pouco cada qual onde aquele "
    "aquela aquilo estou estamos obrigado obrigada"
).split()
SENTENCE_OPENERS = ".!?…:;—–\"“”«»‘’("
SENTENCE_END = ".!?…\"“”«»—–"
CUT_PRONOUNS = ("eles", "elas", "isso", "aquilo")
CUT_MINIMUM, CUT_REACH = 8, 35
IGNORED_ISSUES = ("style", "register", "locale-violation")
IGNORED_CATEGORIES = ("STYLE", "REDUNDANCY", "COLLOQUIALISMS", "REGIONALISMS", "FORMAL")
IGNORED_RULES = ("INTERJECTIONS_PUNTUATION", "REGARDS_COMMA")
COMMA_FREE_LOCUTIONS = ("agora sim",)
COMPLETED_BY_BESIDES = (
    "nada ninguém algo alguém tudo mais nenhum nenhuma nenhuns nenhumas algum alguma alguns algumas"
).split()
NEGATIVES = "nenhum nenhuma nenhuns nenhumas".split()
# -----------------------------------------------------------------------------------------------


# ---- repetition -------------------------------------------------------------------------------
def eligible_sentences(spans: DataFrame, across_paragraphs: bool = True, minimum_words: int = 6) -> DataFrame:
    """Sentences long enough to compare, numbered inside each section.

    ``spans`` has doc_id, paragraph, section, role, base and text.  A heading opens
    a section; without ``across_paragraphs`` so does every paragraph.
    """
    pieces = spans.select(
        "doc_id", "paragraph", "section", "role", "base", F.explode(match_spans(F.col("text"), SENTENCE)).alias("_m")
    ).select(
        "doc_id",
        "paragraph",
        "section",
        F.col("role").alias("scope"),
        (F.col("base") + F.col("_m.start")).cast("int").alias("start"),
        (F.col("base") + F.col("_m.end")).cast("int").alias("end"),
        normalized_words(F.col("_m.text")).alias("key"),
    )
    long_enough = pieces.where(F.size(F.split("key", " ")) >= minimum_words)
    section = ["doc_id", "section"] if across_paragraphs else ["doc_id", "section", "paragraph"]
    return long_enough.withColumn("ordinal", F.row_number().over(Window.partitionBy(*section).orderBy("paragraph", "start")))


def section_spans(role_spans: DataFrame, paras: DataFrame | None = None) -> DataFrame:
    """Role spans with ``base`` and the running count of headings as ``section``."""
    source = role_spans if paras is None else paras
    w = Window.partitionBy("doc_id").orderBy("paragraph").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return source.withColumn("section", F.sum(F.col("heading").cast("int")).over(w))


def repeated_sentences(sentences: DataFrame, reach: int = 8, across_paragraphs: bool = True) -> DataFrame:
    """Sentence equal to one of the previous ``reach`` eligible ones of the same scope; the nearest is the evidence.

    The nearest equal sentence is a lag over its key, so repeated lines never
    meet each other pairwise.
    """
    section = ["doc_id", "section"] if across_paragraphs else ["doc_id", "section", "paragraph"]
    w = Window.partitionBy(*section, "scope", "key").orderBy("ordinal")
    earlier = F.lag(F.struct("ordinal", "paragraph", "start", "end")).over(w)
    return (
        sentences.withColumn("_e", earlier)
        .where((F.col("ordinal") - F.col("_e.ordinal")) <= reach)
        .select(
            "doc_id",
            "paragraph",
            "scope",
            "start",
            "end",
            F.col("_e.paragraph").alias("earlier_paragraph"),
            F.col("_e.start").alias("earlier_start"),
            F.col("_e.end").alias("earlier_end"),
        )
    )


def _nearest_similar(threshold: float):
    @F.pandas_udf("struct<position:int,ratio:double>")
    def nearest(key: pd.Series, earlier: pd.Series) -> pd.DataFrame:
        from difflib import SequenceMatcher

        def best(current: str, candidates) -> tuple[int | None, float | None]:
            words = current.split()
            for position in range(len(candidates) - 1, -1, -1):
                if candidates[position] is None:
                    continue
                ratio = 1.0 if candidates[position] == current else SequenceMatcher(None, candidates[position].split(), words, autojunk=False).ratio()
                if ratio >= threshold:
                    return position, ratio
            return None, None

        found = [best(k, c) for k, c in zip(key, earlier)]
        return pd.DataFrame({"position": pd.array([p for p, _ in found], dtype="Int32"), "ratio": [r for _, r in found]})

    return nearest


def similar_sentences(sentences: DataFrame, threshold: float = 0.8, reach: int = 8, across_paragraphs: bool = True) -> DataFrame:
    """Like ``repeated_sentences`` with a matching-block ratio on words.

    At most ``reach`` earlier sentences are carried per row; a length bound on the
    ratio leaves most rows without any comparison before Python sees them.
    """
    section = ["doc_id", "section"] if across_paragraphs else ["doc_id", "section", "paragraph"]
    w = Window.partitionBy(*section).orderBy("ordinal").rowsBetween(-reach, -1)
    size = F.size(F.split("key", " "))
    recent = F.collect_list(F.struct("scope", "key", "paragraph", "start", "end", size.alias("size"))).over(w)

    def possible(r: Column) -> Column:
        bound = 2.0 * F.least(r["size"], F.col("_size")) / (r["size"] + F.col("_size"))
        return (r["scope"] == F.col("scope")) & (bound >= threshold)

    candidates = F.filter("_recent", possible)
    return (
        sentences.withColumn("_size", size)
        .withColumn("_recent", recent)
        .withColumn("_recent", candidates)
        .where(F.size("_recent") > 0)
        .withColumn("_b", _nearest_similar(threshold)(F.col("key"), F.transform("_recent", lambda r: r["key"])))
        .where(F.col("_b.position").isNotNull())
        .withColumn("_e", F.element_at("_recent", F.col("_b.position") + 1))
        .select(
            "doc_id",
            "paragraph",
            "scope",
            "start",
            "end",
            F.col("_e.paragraph").alias("earlier_paragraph"),
            F.col("_e.start").alias("earlier_start"),
            F.col("_e.end").alias("earlier_end"),
            F.col("_b.ratio").alias("ratio"),
        )
    )


# ---- names ------------------------------------------------------------------------------------
def _name_shape(word: Column) -> Column:
    low = F.lower(word)
    letters = F.array_distinct(F.split(low, ""))
    return (
        (F.char_length(word) >= 4)
        & starts_upper(word)
        & ~is_upper(word)
        & ~low.isin(*COMMON_WORDS)
        & ~low.rlike(r"^h+[aeiou]*m*$")
        & (F.size(F.filter(letters, lambda c: c != "")) > 2)
        & ~low.rlike(r"(.)\1{2}")
    )


def name_occurrences(words: DataFrame, lexicon: DataFrame | None = None, ignored: Sequence[str] = ()) -> DataFrame:
    """Capitalised words per document: count and first place."""
    low = F.lower("word")
    shaped = words.where(_name_shape(F.col("word")))
    if ignored:
        shaped = shaped.where(~low.isin([x.lower() for x in ignored]))
    names = shaped.groupBy("doc_id", "word").agg(
        F.count("*").alias("times"), F.min(F.struct("paragraph", "start", "end")).alias("first")
    )
    if lexicon is None:
        return names
    known = lexicon.where("flags <> 0").select(F.col("word").alias("_key"))
    return names.withColumn("_key", lexicon_key(F.col("word"))).join(known, "_key", "left_anti").drop("_key")


def name_variants(names: DataFrame) -> DataFrame:
    """Pairs at edit distance one, same first letter, one of them seen twice or more.

    Two words one edit apart share the word itself or a one-letter deletion, so
    those strings are the join keys; nothing is compared with a whole block.
    """
    low = F.lower("word")
    at = F.sequence(F.lit(2), F.char_length("word"))
    cuts = F.transform(at, lambda i: F.concat(F.substring(low, F.lit(1), i - 1), F.substring(low, i + 1, F.char_length("word"))))
    keyed = names.withColumn("_low", low).withColumn("_key", F.explode(F.array_distinct(F.concat(F.array(low), cuts))))
    side = lambda p: keyed.select(
        "doc_id", "_key", F.col("word").alias(f"{p}_word"), F.col("_low").alias(f"{p}_low"), F.col("times").alias(f"{p}_times"), F.col("first").alias(f"{p}_first")
    )
    pairs = (
        side("a")
        .join(side("b"), ["doc_id", "_key"])
        .where((F.col("a_word") < F.col("b_word")) & (F.greatest("a_times", "b_times") >= 2))
        .where(F.levenshtein("a_low", "b_low") == 1)
        .where(F.substring("a_low", 1, 1) == F.substring("b_low", 1, 1))
        .drop("_key")
        .dropDuplicates(["doc_id", "a_word", "b_word"])
    )
    return pairs.select(
        "doc_id",
        F.col("a_word").alias("word"),
        F.col("b_word").alias("other"),
        F.col("a_times").alias("times"),
        F.col("b_times").alias("other_times"),
        F.col("a_first.paragraph").alias("paragraph"),
        F.col("a_first.start").alias("start"),
        F.col("a_first.end").alias("end"),
        F.col("b_first.paragraph").alias("other_paragraph"),
        F.col("b_first.start").alias("other_start"),
    )


def _previous_sign(n: Column, gap: Column) -> Column:
    """Last visible character before a match: a sign of the gap, a letter (`x`) or none."""
    sign = F.regexp_extract(gap, r"(?U)(\S)\s*$", 1)
    return F.when(sign != "", sign).when(n > 0, F.lit("x")).otherwise(F.lit(""))


def _one_of(sign: Column, signs: str) -> Column:
    return F.contains(F.lit(signs), sign)


TERM = WORD + r"(?:-" + WORD + r")*"


def terms(paras: DataFrame) -> DataFrame:
    """Words and hyphenated compounds with the sign before each."""
    found = explode_matches(paras.where(~F.col("heading")), TERM, ["doc_id", "paragraph"], with_gap=True)
    return found.withColumn("before", _previous_sign(F.col("n"), F.col("gap"))).drop("gap").withColumnRenamed("match", "word")


def case_oscillation(found: DataFrame, lexicon: DataFrame | None = None, ignored: Sequence[str] = ()) -> DataFrame:
    """The same mid-sentence term with and without a capital."""
    usable = found.where(
        (F.col("before") != "") & ~_one_of(F.col("before"), SENTENCE_OPENERS) & ~is_upper(F.col("word")) & (F.char_length("word") >= 3)
    ).withColumn("term", F.lower("word"))
    if ignored:
        usable = usable.where(~F.col("term").isin([x.lower() for x in ignored]))
    capital = starts_upper(F.col("word"))
    place = F.struct("paragraph", "start", "end")
    both = (
        usable.groupBy("doc_id", "term")
        .agg(
            F.count_if(capital).alias("capital_times"),
            F.count_if(~capital).alias("plain_times"),
            F.min(F.when(capital, place)).alias("_upper"),
            F.min(F.when(~capital, place)).alias("_lower"),
        )
        .where("capital_times > 0 AND plain_times > 0")
    )
    if lexicon is not None:
        known = lexicon.where("flags <> 0").select(F.col("word").alias("_key"))
        # A hyphenated compound may belong to the work; an enclitic form may not.
        plain = ~F.contains("term", F.lit("-")) | F.col("term").rlike(ENCLITIC)
        keyed = both.withColumn("_key", F.when(plain, lexicon_key(F.col("term"))).otherwise(F.lit("-")))
        both = keyed.join(known, "_key", "left_anti").drop("_key")
    return both.select(
        "doc_id",
        "term",
        "capital_times",
        "plain_times",
        F.col("_lower.paragraph").alias("paragraph"),
        F.col("_lower.start").alias("start"),
        F.col("_upper.paragraph").alias("capital_paragraph"),
        F.col("_upper.start").alias("capital_start"),
    )


def proper_names(paras: DataFrame, ignored: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(names for spelling, stricter names for a capital after a comma), lower case, per document."""
    body = paras.where(~F.col("heading"))
    found = explode_matches(body, WORD, ["doc_id", "paragraph"], with_gap=True)
    word = F.col("match")
    before = _previous_sign(F.col("n"), F.col("gap"))
    capital = starts_upper(word) & ~(is_upper(word) & (F.char_length(word) > 1))
    middle = capital & (before != "") & ~_one_of(before, SENTENCE_END) & (before != ":")
    counted = found.groupBy("doc_id", F.lower("match").alias("name")).agg(
        F.count_if(capital).alias("_capital"), F.count_if(middle).alias("_middle"), F.count_if(~starts_upper(word)).alias("_lower")
    )
    always = (F.col("_capital") >= 2) & (F.col("_lower") == 0)
    credits = (
        body.where(is_credit_line(F.col("text")))
        .select("doc_id", F.explode(F.split(stripped(F.col("text")), r"(?U)\s+")).alias("_w"))
        .where(~F.col("_w").isin(PARTICLES))
        .select("doc_id", F.lower("_w").alias("name"))
    )
    given = [w.lower() for entry in ignored for w in entry.split()]
    extra = body.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(w) for w in given])).alias("name")) if given else None
    spelling = counted.where((F.col("_middle") > 0) | always).select("doc_id", "name").unionByName(credits)
    comma = counted.where((F.col("_middle") >= 2) | always).select("doc_id", "name")
    if extra is not None:
        spelling, comma = spelling.unionByName(extra), comma.unionByName(extra)
    variants = F.array_compact(
        F.array(
            F.col("name"),
            F.concat("name", F.lit("s")),
            F.concat("name", F.lit("es")),
            F.when(F.endswith("name", F.lit("es")), F.substring("name", F.lit(1), F.char_length("name") - 2)),
            F.when(F.endswith("name", F.lit("s")), F.substring("name", F.lit(1), F.char_length("name") - 1)),
        )
    )
    return spelling.select("doc_id", F.explode(variants).alias("name")).distinct(), comma.distinct()


def recurring_unknown(words: DataFrame, lexicon: DataFrame, minimum: int = 3) -> DataFrame:
    """Words outside the lexicon seen ``minimum`` times or more; counted before the lexicon is met."""
    counted = words.groupBy("doc_id", F.lower("word").alias("word")).agg(F.count("*").alias("times")).where(F.col("times") >= minimum)
    known = lexicon.where("flags <> 0").select(F.col("word").alias("_key"))
    return counted.withColumn("_key", lexicon_key(F.col("word"))).join(known, "_key", "left_anti").drop("_key")


# ---- external checker -------------------------------------------------------------------------
def _plain(text: Column) -> Column:
    return strip_accents(F.regexp_replace(text, r"[ \-]", ""))


def near_spelling(a: Column, b: Column) -> Column:
    """At most one edit apart, a swap of neighbouring letters counting as one."""

    def swapped(z: Column) -> Column:
        x, y = z["x"], z["y"]
        at = F.sequence(F.lit(1), F.greatest(F.char_length(x), F.lit(1)))
        differ = F.filter(at, lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1)))

        def crossed(d: Column) -> Column:
            p, q = F.try_element_at(d, F.lit(1)), F.try_element_at(d, F.lit(2))
            same = lambda u, i, v, k: F.substring(u, i, F.lit(1)) == F.substring(v, k, F.lit(1))
            return (F.size(d) == 2) & (q == p + 1) & same(x, p, y, q) & same(x, q, y, p)

        return (F.char_length(x) == F.char_length(y)) & F.coalesce(let(differ, crossed), F.lit(False))

    both = F.struct(_plain(a).alias("x"), _plain(b).alias("y"))
    return let(both, lambda z: (F.levenshtein(z["x"], z["y"]) <= 1) | swapped(z))


def _besides_inside_clause(text: Column, start: Column, excerpt: Column) -> Column:
    """'além de' completing a pronoun or quantifier of the same clause, not the connector."""
    at = F.char_length(F.regexp_extract(excerpt, r"(?iuU)^(.*?)\balém\s+d", 1))
    clause = F.regexp_extract(F.substring(text, F.lit(1), start + at), r"([^,.;:!?…—–()\[\]\"“”«»]*)$", 1)
    found = F.regexp_extract_all(F.lower(clause), F.lit(WORD), F.lit(0))
    last3 = F.slice(found, F.greatest(F.size(found) - 2, F.lit(1)), F.lit(3))
    return excerpt.rlike(r"(?iuU)\balém\s+d") & (
        F.coalesce(F.try_element_at(found, F.lit(-1)).isin(COMPLETED_BY_BESIDES), F.lit(False))
        | F.arrays_overlap(last3, F.array(*[F.lit(n) for n in NEGATIVES]))
    )


def filter_checker_matches(
    matches: DataFrame,
    paras: DataFrame,
    names: DataFrame,
    comma_names: DataFrame,
    recurring: DataFrame,
    lexicon: DataFrame,
) -> DataFrame:
    """External checker matches that stand, with confidence lowered where the work explains the word.

    ``matches``: doc_id, paragraph, offset, length (UTF-16 units), rule_id, issue_type,
    category_id, replacements (array of strings), message.
    """
    keep = (
        ~F.coalesce(F.col("issue_type").isin(*IGNORED_ISSUES), F.lit(False))
        & ~F.coalesce(F.col("category_id").isin(*IGNORED_CATEGORIES), F.lit(False))
        & ~F.coalesce(F.col("rule_id").isin(*IGNORED_RULES), F.lit(False))
    )
    body = [c for c in ("text", "italic") if c in paras.columns]
    # Whether UTF-16 units differ from code points is asked once a paragraph; a match reads the whole text only then.
    seen = paras.select("doc_id", "paragraph", *body, F.col("text").rlike(r"[\x{10000}-\x{10FFFF}]").alias("_wide"), F.char_length("text").alias("_size"))
    point = lambda units: (
        F.when(F.col("_wide"), utf16_to_codepoint(F.col("text"), units)).when(units < 0, 0).when(units > F.col("_size"), F.col("_size")).otherwise(units)
    )
    placed = (
        matches.where(keep)
        .join(seen, ["doc_id", "paragraph"])
        .withColumn("start", point(F.col("offset")))
        .withColumn("end", point(F.col("offset") + F.col("length")))
        .withColumn("excerpt", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
        .where(F.trim("excerpt") != "")
        .withColumn("spelling", (F.coalesce("issue_type", F.lit("")) == "misspelling") | (F.coalesce("category_id", F.lit("")) == "TYPOS"))
        .withColumn("_head", F.when(F.col("rule_id") == "UPPERCASE_SENTENCE_START", F.substring("text", F.lit(1), F.col("start"))))
        .withColumn("_before", F.when(F.col("rule_id") == "SENTENCE_WHITESPACE", F.regexp_replace(F.substring("text", F.lit(1), F.col("start")), r"(?U)\s+$", "")))
        .withColumn("_after", F.substring("text", F.col("end") + 1, F.when(F.col("rule_id") == "LP_PARONYMS", F.col("_size")).otherwise(3)))
        .withColumn("word", F.regexp_replace("excerpt", r"^[ ,.;:!?…]+|[ ,.;:!?…]+$", ""))
        .withColumn("_first", F.lower(F.regexp_extract("word", r"^\S+", 0)))
        .withColumn("_last", F.lower(F.regexp_extract("word", r"\S+$", 0)))
        .withColumn("_low", F.lower(stripped(F.col("excerpt"))))
    )
    rule = F.col("rule_id")
    alone = F.col("text").rlike(r"(?U)^[—–\s]*\w+[!?]+[\s.…]*$")
    cut_word = F.col("_after").rlike(r"^(?:…|\.\.\.|-|—)")
    veto = (
        ((rule == "SENTENCE_WHITESPACE") & F.col("_before").rlike(r"(?:…|\.\.\.)$"))
        | ((rule == "UPPERCASE_AFTER_COMMA") & F.col("excerpt").rlike(r"^\s*:"))
        | ((rule == "AUXILIARY_VERB_INFINITIVE") & F.endswith("_first", F.lit("ndo")))
        | ((rule == "TODOS_FOLLOWED_BY_NOUN_PLURAL") & F.col("_last").rlike(r"(?iuU)^\w+(?:ad|id)[oa]s$"))
        | ((rule == "LP_PARONYMS") & F.col("_after").rlike(rf"(?U)^\s+{WORD[:-1]}*ndo\b"))
        | ((rule == "VERB_COMMA_CONJUNCTION") & F.lower("word").isin(*COMMA_FREE_LOCUTIONS))
        | ((rule == "VERB_COMMA_CONJUNCTION") & _besides_inside_clause(F.col("text"), F.col("start"), F.col("excerpt")))
        | (F.col("spelling") & (is_expressive(F.col("word")) | alone | cut_word))
        | ((rule == "CRASE_CONFUSION") & speech_verb(F.regexp_extract("excerpt", r"\S+", 0)))
        | ((rule == "UPPERCASE_SENTENCE_START") & ends_in_dash(F.col("_head")))
    )
    if "italic" in body:
        veto = veto | (F.col("spelling") & F.exists("italic", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"])))
    kept = placed.where(~F.coalesce(veto, F.lit(False)))
    # Semi-joins as flags: each side is distinct per document and key.
    kept = kept.join(comma_names.select("doc_id", F.col("name").alias("_last"), F.lit(True).alias("_vocative")), ["doc_id", "_last"], "left")
    kept = kept.join(names.select("doc_id", F.col("name").alias("_low"), F.lit(True).alias("_named")), ["doc_id", "_low"], "left")
    known = lexicon.where("flags <> 0").select(F.col("word").alias("_key"), F.lit(True).alias("_known"))
    kept = kept.withColumn("_key", lexicon_key(F.col("_first"))).join(known, "_key", "left")
    again = recurring.select("doc_id", F.col("word").alias("_wl"), F.lit(True).alias("_again"))
    kept = kept.withColumn("_wl", F.lower("word")).join(again, ["doc_id", "_wl"], "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    stands = (
        ~((rule == "UPPERCASE_AFTER_COMMA") & no("_vocative"))
        & ~(F.col("spelling") & no("_named"))
        & ~((rule == "PORTUGUESE_WORD_REPEAT_RULE") & (F.col("word") != "") & ~no("_known"))
    )
    offers = F.slice(F.filter("replacements", lambda r: r.isNotNull() & (r != "")), 1, 3)
    far = (F.size(offers) > 0) & ~F.exists(offers, lambda r: near_spelling(F.col("word"), r))
    low = F.col("spelling") & (no("_again") | far)
    return kept.where(stands).select(
        "doc_id",
        "paragraph",
        "text",
        "start",
        "end",
        "excerpt",
        F.lit("languagetool").alias("rule"),
        F.lit("grammar").alias("category_code"),
        F.lit("Ortografia e gramática").alias("category"),
        F.concat(F.lit("LanguageTool local · "), rule).alias("source"),
        F.try_element_at(offers, F.lit(1)).alias("suggestion"),
        F.when(low, "baixa").when(F.col("spelling"), "alta").otherwise("média").alias("confidence"),
        F.when(low, F.lit(0.4)).when(F.col("spelling"), F.lit(0.9)).otherwise(F.lit(0.75)).alias("confidence_score"),
        "rule_id",
        "category_id",
        "issue_type",
        "message",
    )


# ---- cuts against the original ----------------------------------------------------------------
def _document_lines(paras: DataFrame) -> DataFrame:
    """One row per document with its paragraphs in order (documents are input rows, so this is their size)."""
    return paras.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("paragraph", "text", "heading", "chapter"))).alias("lines"))


_SCAR = "array<struct<paragraph:int,start:int,end:int,word:string,removed:int,removed_paragraphs:array<int>>>"
_SCAR_TYPE = pa.list_(
    pa.struct([("paragraph", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("word", pa.string()), ("removed", pa.int32()), ("removed_paragraphs", pa.list_(pa.int32()))])
)


def _scars():
    @F.arrow_udf(_SCAR)
    def scars(old: pa.Array, old_places: pa.Array, new: pa.Array, new_places: pa.Array, gaps: pa.Array, sizes: pa.Array, stops: pa.Array, chapters: pa.Array) -> pa.Array:
        """Deletions of eight words or more followed at short reach by a pronoun; lists of words, by paragraph."""

        def one(row: int) -> list[dict]:
            before, after = old[row].values, new[row].values
            lost_words, words = before.flatten(), after.flatten()
            both = pa.concat_arrays([lost_words, words]).dictionary_encode()
            codes = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            a, b = codes[: len(lost_words)], codes[len(lost_words) :]
            if np.array_equal(a, b):
                return []
            line, old_line = (np.repeat(np.arange(len(x)), x.value_lengths().to_numpy(zero_copy_only=False)) for x in (after, before))
            pronoun = pc.is_in(both.dictionary, pa.array(CUT_PRONOUNS)).to_numpy(zero_copy_only=False)[b]
            heads, chapter = stops[row].as_py(), chapters[row].as_py()
            places, old_numbers = new_places[row].as_py(), old_places[row].as_py()
            used, out = set(), []
            for first, end, c, d in cuts(a, b):
                lost = (end - first) - (d - c)
                if lost < CUT_MINIMUM:
                    continue
                for j in range(d, min(d + CUT_REACH, len(b))):
                    if heads[line[j]]:
                        break
                    if pronoun[j] and j not in used and chapter[line[j]] == chapter[line[d]]:
                        used.add(j)
                        at = int(line[j])
                        place = j - int(np.searchsorted(line, at))
                        size = sizes[row].values[at].values.to_numpy(zero_copy_only=False)
                        begin = int(gaps[row].values[at].values.to_numpy(zero_copy_only=False)[: place + 1].sum() + size[:place].sum())
                        gone = list(dict.fromkeys(old_numbers[k] for k in np.unique(old_line[first:end])))
                        out.append(
                            {"paragraph": places[at], "start": begin, "end": begin + int(size[place]), "word": words[j].as_py(), "removed": lost, "removed_paragraphs": gone}
                        )
                        break
            return out

        return pa.array([one(row) for row in range(len(old))], _SCAR_TYPE)

    return scars


def edit_scars(original: DataFrame, revised: DataFrame, limit: int | None = None) -> DataFrame:
    """Pronouns shortly after a long cut; with a ``limit``, documents above so many words in both versions together are left out.

    Texts move whole; their words are read after that, and offsets are summed up where a pronoun is found.
    """
    hits = lambda text: F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    each = lambda c, f: F.transform(c, lambda r: f(r["text"]))
    low = lambda c: each(c, lambda t: F.transform(hits(t), F.lower))
    old = _document_lines(original).select("doc_id", F.col("lines").alias("_old"))
    new = _document_lines(revised).select("doc_id", F.col("lines").alias("_new"))
    both = old.join(new, "doc_id")
    if limit is not None:
        count = lambda c: F.size(F.flatten(each(c, hits)))
        both = both.where(count(F.col("_old")) + count(F.col("_new")) <= limit)
    # Identical versions have nothing to align.
    changed = both.where(F.col("_old.text") != F.col("_new.text"))
    found = _scars()(
        low(F.col("_old")),
        F.col("_old.paragraph"),
        low(F.col("_new")),
        F.col("_new.paragraph"),
        each(F.col("_new"), lambda t: F.transform(F.split(t, WORD, -1), F.char_length)),
        each(F.col("_new"), lambda t: F.transform(hits(t), F.char_length)),
        F.col("_new.heading"),
        F.col("_new.chapter"),
    )
    return changed.select("doc_id", F.explode(found).alias("_s")).select("doc_id", "_s.*")
