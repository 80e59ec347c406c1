"""Documents to structured paragraphs: numbering, headings, chapters, front matter, offsets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import WORD
from ..functions.text import is_blank, is_upper, stripped

# ---- fixed values -----------------------------------------------------------------------------
NUMBER_WORDS = (
    "um uma dois duas três tres quatro cinco seis sete oito nove dez onze doze treze catorze quatorze quinze "
    "dezesseis dezasseis dezessete dezassete dezoito dezenove dezanove vinte trinta quarenta cinquenta sessenta "
    "setenta oitenta noventa cem primeiro primeira segundo segunda terceiro terceira quarto quarta quinto quinta "
    "sexto sexta sétimo sétima setimo setima oitavo oitava nono nona décimo décima decimo decima"
).split()
HEADING_STYLE_PREFIXES = ("heading", "título", "title", "cabeçalho")
HEADING_STYLES = ("capítulo", "capitulo", "pré-capítulo", "pre-capitulo", "nome da obra")
CREDIT_MARKER = r"(?iu)^\s*(?:autora?\s*:|revisão(?: e correção)?\s*:?)\s*$"
NO_CHAPTER = "Sem capítulo identificado"
MAX_PARAGRAPH = 100_000
# -----------------------------------------------------------------------------------------------

_NUMBERS = "|".join(NUMBER_WORDS)
CHAPTER_LABEL = (
    rf"(?iuU)^cap[íi]tulo\s+(?:{_NUMBERS}|\d+[ºª]?|[ivxlcdm]+)"
    rf"(?:\s*$|\s*[:—–.\-].*$|(?:\s+(?:{_NUMBERS}|e))+\s*$)"
)


@dataclass(frozen=True)
class HeadingRules:
    """What counts as a heading besides its look; lists are bounded settings, not data."""

    titles: Sequence[str] = field(default_factory=tuple)
    styles: Sequence[str] = field(default_factory=tuple)
    automatic: bool = True


def paragraphs(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Lines numbered from 1 counting the blank ones, which are then dropped."""
    return (
        docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("_pos", "text"))
        .where(~is_blank(F.col("text")))
        .select("doc_id", *keep, (F.col("_pos") + 1).alias("paragraph"), "text")
    )


def chapter_label(text: Column) -> Column:
    bare = stripped(text)
    return (F.char_length(bare) <= 160) & bare.rlike(CHAPTER_LABEL)


def short_title(text: Column) -> Column:
    """Short line in capitals without sentence punctuation."""
    word_count = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return (word_count <= 10) & (F.char_length(text) <= 100) & is_upper(text) & ~text.rlike('[.!?…,:;"“”]')


def detect_headings(paras: DataFrame, rules: HeadingRules = HeadingRules()) -> DataFrame:
    """Adds ``heading``.  Optional input columns: ``style`` (lower case) and ``outline``."""
    text = F.col("text")
    found = F.lower(stripped(text)).isin([t.strip().lower() for t in rules.titles]) if rules.titles else F.lit(False)
    style = F.col("style") if "style" in paras.columns else None
    if style is not None and rules.styles:
        found = found | style.isin([s.strip().lower() for s in rules.styles])
    if rules.automatic:
        found = found | chapter_label(text) | short_title(text)
        if style is not None:
            for prefix in HEADING_STYLE_PREFIXES:
                found = found | style.startswith(prefix)
            found = found | style.isin(list(HEADING_STYLES))
        if "outline" in paras.columns:
            found = found | F.col("outline")
    return paras.withColumn("heading", F.coalesce(found, F.lit(False)))


def front_matter(paras: DataFrame) -> DataFrame:
    """Adds ``narrative_role``; lines of the credits block become front matter and headings.

    The block exists only when a credit marker precedes the first chapter label;
    it ends at the first non-blank line after the last marker.
    """
    doc = Window.partitionBy("doc_id")
    text, number = F.col("text"), F.col("paragraph")
    first = F.min(F.when(chapter_label(text), number)).over(doc)
    with_first = paras.withColumn("_first", first)
    marker = F.max(F.when(text.rlike(CREDIT_MARKER) & (number < F.col("_first")), number)).over(doc)
    with_marker = with_first.withColumn("_marker", marker)
    value = F.min(F.when((number > F.col("_marker")) & (number < F.col("_first")), number)).over(doc)
    return (
        with_marker.withColumn("_end", F.coalesce(value, F.col("_marker"), F.lit(0)))
        .withColumn(
            "narrative_role",
            F.when(number <= F.col("_end"), "front_matter").when(F.col("heading"), "heading").otherwise("body"),
        )
        .withColumn("heading", F.col("heading") | (F.col("narrative_role") == "front_matter"))
        .drop("_first", "_marker", "_end")
    )


def fill_chapter(paras: DataFrame, default: str = NO_CHAPTER) -> DataFrame:
    """Each paragraph takes the latest heading that is not front matter."""
    w = Window.partitionBy("doc_id").orderBy("paragraph").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.col("heading")
    if "narrative_role" in paras.columns:
        opens = opens & (F.col("narrative_role") != "front_matter")
    title = F.last(F.when(opens, stripped(F.col("text"))), ignorenulls=True).over(w)
    return paras.withColumn("chapter", F.coalesce(title, F.lit(default)))


def structure(docs: DataFrame, rules: HeadingRules = HeadingRules(), keep: Sequence[str] = ()) -> DataFrame:
    """Paragraph table with heading, narrative role and chapter (one exchange, by document)."""
    return fill_chapter(front_matter(detect_headings(paragraphs(docs, keep), rules)))


def global_offsets(paras: DataFrame) -> DataFrame:
    """Half-open document range of every paragraph, one line feed between them."""
    w = Window.partitionBy("doc_id").orderBy("paragraph").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("text")
    before = F.coalesce(F.sum(size + 1).over(w), F.lit(0)).cast("long")
    return paras.withColumn("doc_start", before).withColumn("doc_end", F.col("doc_start") + size)


def duplicate_numbers(paras: DataFrame) -> DataFrame:
    """Paragraph numbers used more than once in a document (a contract error)."""
    return paras.groupBy("doc_id", "paragraph").agg(F.count("*").alias("times")).where("times > 1")


def text_index(paras: DataFrame) -> DataFrame:
    """Length and SHA-256 of the text of every document, lines joined by one line feed."""
    lines = F.sort_array(F.collect_list(F.struct("paragraph", "text")))
    joined = F.array_join(F.transform(lines, lambda r: r["text"]), "\n")
    return (
        paras.groupBy("doc_id")
        .agg(joined.alias("_text"))
        .select("doc_id", F.char_length("_text").alias("length"), F.sha2("_text", 256).alias("sha256"))
    )


def input_guards(docs: DataFrame, paras: DataFrame) -> DataFrame:
    """Warnings per document: no text, oversized paragraph, no heading."""
    seen = paras.groupBy("doc_id").agg(
        F.max(F.char_length("text")).alias("_longest"), F.max(F.col("heading").cast("int")).alias("_headed")
    )
    checked = docs.select("doc_id").join(seen, "doc_id", "left")
    flags = F.array_compact(
        F.array(
            F.when(F.col("_longest").isNull(), F.lit("empty_document")),
            F.when(F.col("_longest") > MAX_PARAGRAPH, F.lit("oversized_paragraph")),
            F.when(F.coalesce(F.col("_headed"), F.lit(0)) == 0, F.lit("no_heading")),
        )
    )
    return checked.select("doc_id", F.explode(flags).alias("warning"))


def chapter_index(paras: DataFrame) -> DataFrame:
    """Chapter titles in reading order; other non-body roles are listed with their role."""
    return paras.where(F.col("narrative_role") != "body").select(
        "doc_id", "paragraph", stripped(F.col("text")).alias("title"), "narrative_role"
    )


def plain_book_paragraphs(docs: DataFrame, minimum_words: int = 6) -> DataFrame:
    """Plain-text books: text between the START and END marks, blank-line blocks, single spaces."""
    body = F.regexp_replace(F.col("text"), r"(?s)^.*?\*\*\* ?START OF[^\n]*\n", "")
    body = F.regexp_replace(body, r"(?s)\*\*\* ?END OF.*$", "")
    line = stripped(F.regexp_replace(F.col("_block"), r"(?U)\s+", " "))
    return (
        docs.select("doc_id", F.posexplode(F.split(body, r"\n\s*\n")).alias("block", "_block"))
        .select("doc_id", "block", line.alias("text"))
        .where((F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))) >= minimum_words) & ~is_upper(F.col("text")))
    )
