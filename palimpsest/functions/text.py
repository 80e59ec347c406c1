"""Scalar text expressions (Columns in, Columns out; all evaluated in the JVM)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import WORD, let, match_spans

# ---- fixed values -----------------------------------------------------------------------------
# Portuguese words without search value for the accent-free prefix keys.
# They stand with their accents and are compared with words that have lost theirs: accented ones never match.
STOP_KEYS = (
    "a o as os um uma uns umas de do da dos das em no na nos nas por para com sem sob sobre "
    "entre até ao aos à às que se e ou mas porém como quando onde quem qual quais seu sua seus suas meu minha meus "
    "minhas teu tua nosso nossa dele dela deles delas ele ela eles elas eu tu nós vós você vocês me te lhe lhes "
    "isso isto aquilo esse essa esses essas este esta estes estas aquele aquela aqueles aquelas é são era eram foi "
    "foram ser estar está estão estava estavam tem têm tinha tinham há havia mais menos muito muita muitos muitas "
    "já ainda também só mesmo mesma depois antes agora então assim aqui ali lá não sim sempre nunca todo toda "
    "todos todas cada outro outra outros outras algum alguma alguns algumas nenhum nenhuma tudo nada algo"
).split()
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñýÿ"
PLAIN = "aaaaaeeeeiiiiooooouuuucnyy"
PARTICLES = ["de", "da", "do", "dos", "das", "e"]
DOUBLE_QUOTES = "“”«»\""
SINGLE_QUOTES = "‘’"
DASHES = "—–"
NO_BREAK_SPACE = "\u00a0"
ENCLITIC = r"-(?:me|te|se|nos|vos|lhe|lhes|o|a|os|as|lo|la|los|las)$"
# Repeated letters and interjection shapes (hum, ah, oh, ué …).
EXPRESSIVE = (
    r"(?iu)([\p{L}\p{N}_])\1\1|"
    r"^(?:h+u*m+|h+a+m+|a+h+[mn]*|a+h+a+|h+[mn]+|hã+|u+é|u+h+|o+h+|a+i+)$"
)
MARKER_PAIRS = (("⟦", "⟧"), ("⟪", "⟫"), ("【", "】"), ("⦃", "⦄"))
SCENE_BREAK = r"^\s*([*#~]\s*){1,5}$"
CUT_MARKER = r"(?iu)^\s*(?:\*{3}|—{3}|no dia seguinte\b|dias depois\b|na manhã seguinte\b)"
# -----------------------------------------------------------------------------------------------


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_upper(text: Column) -> Column:
    """At least one cased letter and none of them lower case."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def starts_upper(text: Column) -> Column:
    return text.rlike(r"^\p{Lu}")


def normalized_words(text: Column) -> Column:
    """Lower-cased letter runs joined by one space.

    ``lower`` stands in for full case folding; they differ for ``ß`` only.
    """
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), " ")


def strip_accents(text: Column) -> Column:
    """Lower case, the letters of the table without their accents, and no combining marks."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{M}+", "")


def prefix_keys(text: Column, stop: Iterable[str] | None = STOP_KEYS) -> Column:
    """Distinct 5-letter prefixes of accent-free words of three letters or more."""
    found = F.regexp_extract_all(strip_accents(text), F.lit(r"[a-z0-9]+"), F.lit(0))
    keep = F.filter(found, lambda w: F.char_length(w) >= 3)
    if stop is not None:
        keep = F.array_except(keep, F.array(*[F.lit(w) for w in stop]))
    return F.array_distinct(F.transform(keep, lambda w: F.substring(w, 1, 5)))


def normalize_quotes(text: Column) -> Column:
    """Plain quotes, apostrophes and hyphens, single spaces, lower case."""
    signs = F.translate(text, NO_BREAK_SPACE + DOUBLE_QUOTES + SINGLE_QUOTES + DASHES, ' """""\'\'--')
    return F.lower(stripped(F.regexp_replace(signs, r"(?U)\s+", " ")))


def entity_key(text: Column) -> Column:
    """Normalised name without leading article or title and without edge punctuation."""
    bare = F.regexp_replace(normalize_quotes(text), r"^(?:o|a|os|as|um|uma|dona|seu|sr\.?|sra\.?)\s+", "")
    return F.regexp_replace(bare, r"^[ .,:;!?]+|[ .,:;!?]+$", "")


def is_list_or_label(text: Column) -> Column:
    """Two or more words, all opening with a capital or digit, and no final punctuation."""
    parts = F.filter(F.split(text, r"(?U)\s+"), lambda p: p != "")
    return (
        (F.size(parts) >= 2)
        & text.rlike(r"(?U)[\p{L}\p{N}]\s*$")
        & F.forall(parts, lambda p: p.rlike(r"^[\p{Lu}\p{Nd}]"))
    )


def is_credit_line(text: Column) -> Column:
    """Up to four words, letters only, all capitalised except name particles."""
    bare = stripped(text)
    parts = F.split(bare, r"(?U)\s+")
    shape = r"(?U)^" + WORD + r"(?:\s+" + WORD + r"){0,3}$"
    return bare.rlike(shape) & F.forall(parts, lambda p: p.isin(PARTICLES) | starts_upper(p))


def is_expressive(word: Column) -> Column:
    return word.rlike(EXPRESSIVE) | (
        (F.char_length(word) >= 3) & word.rlike(r"^\p{L}+$") & is_upper(word)
    )


def excerpt(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def marked_parts(text: Column, start: Column, end: Column) -> Column:
    """``before``, ``marked`` and ``after`` of a range clamped to the text."""
    size = F.char_length(text)
    low = F.least(F.greatest(F.lit(0), start), size)
    high = F.least(F.greatest(low, end), size)
    return F.struct(
        F.substring(text, F.lit(1), low).alias("before"),
        excerpt(text, low, high).alias("marked"),
        F.substring(text, high + 1, size - high).alias("after"),
    )


def marker_pair(texts: Column) -> Column:
    """First pair of marks absent from every text of an array; a numbered pair otherwise."""
    joined = F.array_join(texts, "\n")

    def absent(pair: tuple[str, str]) -> Column:
        return ~F.contains(joined, F.lit(pair[0])) & ~F.contains(joined, F.lit(pair[1]))

    # A numbered mark longer than any digit run between two marks cannot occur.
    runs = F.regexp_extract_all(joined, F.lit(r"⟦\d+(?=⟦)|⟧\d+(?=⟧)"), F.lit(0))
    taken = F.transform(runs, lambda r: F.regexp_extract(r, r"(\d+)", 1))
    numbers = F.sequence(F.lit(1), F.size(taken) + 1)
    first_free = F.element_at(F.filter(numbers, lambda n: ~F.array_contains(taken, n.cast("string"))), 1)
    label = first_free.cast("string")
    chosen = F.struct(F.concat(F.lit("⟦"), label, F.lit("⟦")).alias("open"), F.concat(F.lit("⟧"), label, F.lit("⟧")).alias("close"))
    for pair in reversed(MARKER_PAIRS):
        chosen = F.when(absent(pair), F.struct(F.lit(pair[0]).alias("open"), F.lit(pair[1]).alias("close"))).otherwise(chosen)
    return chosen


def mark_target(text: Column, start: Column, end: Column, pair: Column) -> Column:
    parts = marked_parts(text, start, end)
    return F.concat(parts["before"], pair["open"], parts["marked"], pair["close"], parts["after"])


def utf16_to_codepoint(text: Column, units: Column) -> Column:
    """Code points covered by the first ``units`` UTF-16 units."""
    wide = F.encode(text, "UTF-16LE")
    return F.char_length(F.decode(F.substring(wide, F.lit(1), 2 * units), "UTF-16LE"))


def quoted_word_pattern(target: Column) -> Column:
    """Literal pattern that does not start or end inside a word."""
    # Literal text: escape every regular-expression sign.
    literal = F.regexp_replace(target, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")
    before = F.when(target.rlike(r"^[\p{L}\p{N}]"), F.lit(r"(?<![\p{L}\p{N}_])")).otherwise(F.lit(""))
    after = F.when(target.rlike(r"[\p{L}\p{N}]$"), F.lit(r"(?![\p{L}\p{N}_])")).otherwise(F.lit(""))
    return F.concat(before, literal, after)


def whole_word_starts(text: Column, target: Column) -> Column:
    """Start offsets of whole-word occurrences of ``target``."""
    return F.transform(match_spans(text, quoted_word_pattern(target)), lambda m: m["start"])


def occurrence_ordinal(text: Column, start: Column, end: Column) -> Column:
    """(which, of how many): position of the range among whole-word occurrences of its text."""
    return let(
        whole_word_starts(text, excerpt(text, start, end)),
        lambda starts: F.struct(
            F.greatest(F.array_position(starts, start.cast("int")).cast("int"), F.lit(1)).alias("which"),
            F.greatest(F.size(starts), F.lit(1)).alias("total"),
        ),
    )


def with_occurrence(df: DataFrame, keys: Sequence[str] = ("doc_id", "paragraph"), texts: DataFrame | None = None) -> DataFrame:
    """Adds ``which`` and ``total`` of each range, reading every (paragraph, excerpt) once.

    Many ranges of a paragraph often mark the same text; its occurrences are
    listed once per distinct excerpt and joined back by position.  ``texts``: keys and text of
    the paragraphs, for ranges that hold their ``excerpt`` instead; a text then meets all its excerpts at once.
    """
    place = [*keys, "_excerpt"]
    if texts is None:
        marked = df.withColumn("_excerpt", excerpt(F.col("text"), F.col("start"), F.col("end")))
        asked = marked.groupBy(*place).agg(F.any_value("text").alias("text"))
    else:
        marked = df.withColumn("_excerpt", F.col("excerpt"))
        asked = marked.groupBy(*keys).agg(F.collect_set("_excerpt").alias("_excerpt")).join(texts, [*keys])
        asked = asked.select(*keys, "text", F.explode("_excerpt").alias("_excerpt"))
    starts = whole_word_starts(F.col("text"), F.col("_excerpt"))
    listed = (
        asked.withColumn("_starts", starts).select(
            *place, F.size("_starts").alias("_total"), F.posexplode_outer("_starts").alias("_at", "start")
        )
    )
    totals = listed.groupBy(*place).agg(F.max("_total").alias("_total"))
    ranks = listed.where("start IS NOT NULL").select(*place, "start", (F.col("_at") + 1).alias("_which"))
    return (
        marked.join(totals, place)
        .join(ranks, [*place, "start"], "left")
        .withColumn("which", F.coalesce("_which", F.lit(1)))
        .withColumn("total", F.greatest("_total", F.lit(1)))
        .drop("_excerpt", "_total", "_which")
    )


def fold_signs(text: Column) -> Column:
    """One-to-one folding of quotes, apostrophes, dashes and case (length is kept)."""
    return F.lower(F.translate(text, DOUBLE_QUOTES + "„" + SINGLE_QUOTES + DASHES + NO_BREAK_SPACE, '""""""\'\'-- '))


def excerpt_pattern(fragment: Column) -> Column:
    """Pattern for a fragment: words in order, any run of spaces between them."""
    parts = F.filter(F.split(fold_signs(fragment), r"(?U)\s+"), lambda p: p != "")
    literal = F.transform(parts, lambda p: F.regexp_replace(p, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1"))
    return F.concat(F.lit("(?U)"), F.array_join(literal, r"\s+"))


def find_excerpt(text: Column, fragment: Column) -> Column:
    """Every position of a fragment, tolerant to quotes, dashes, spaces and case."""
    return F.when(is_blank(fragment), F.array().cast("array<struct<start:int,end:int,text:string>>")).otherwise(
        match_spans(fold_signs(text), excerpt_pattern(fragment))
    )


def lexicon_key(word: Column) -> Column:
    """Lower-cased word without an enclitic pronoun."""
    return F.regexp_replace(F.lower(word), ENCLITIC, "")


def cased_like(model: Column, replacement: Column) -> Column:
    """Give ``replacement`` the capitals of ``model`` (all, first letter, or none)."""
    first_up = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, F.lit(2), F.char_length(replacement)))
    return F.when(is_upper(model), F.upper(replacement)).when(starts_upper(model), first_up).otherwise(replacement)


def opens_speech(text: Column, strict: bool = False) -> Column:
    """The text opens with a dash, or with a hyphen and a space; ``strict`` always asks for the space."""
    return text.rlike(r"(?U)^\s*[-–—]\s") if strict else text.rlike(r"(?U)^\s*(?:[—–]|- )")


def ends_in_dash(prefix: Column) -> Column:
    return prefix.rlike(r"(?U)[—–]\s*$")


def scene_break(text: Column) -> Column:
    return text.rlike(SCENE_BREAK)


def cut_marker(text: Column) -> Column:
    return text.rlike(CUT_MARKER)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def unit_interval_hash(key: Column) -> Column:
    """Deterministic draw in [0, 1) from the first 32 bits of a SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, found by halving: a long text is read once for each bit of its length."""

    def measure(z: Column) -> Column:
        x, y = z["x"], z["y"]
        limit = F.least(F.char_length(x), F.char_length(y))

        def halve(acc: Column, _: Column) -> Column:
            middle = F.floor((acc["low"] + acc["high"] + 1) / 2).cast("int")
            same = F.substring(x, F.lit(1), middle) == F.substring(y, F.lit(1), middle)
            return let(
                F.struct(middle.alias("at"), same.alias("same")),
                lambda m: F.struct(
                    F.when(m["same"], m["at"]).otherwise(acc["low"]).alias("low"),
                    F.when(m["same"], acc["high"]).otherwise(F.least(m["at"] - 1, acc["high"])).alias("high"),
                ),
            )

        bits = F.sequence(F.lit(1), F.char_length(F.bin(limit.cast("long"))))
        begin = F.struct(F.lit(0).alias("low"), limit.alias("high"))
        return F.when(x.isNotNull() & y.isNotNull(), F.aggregate(bits, begin, halve, lambda acc: F.greatest(acc["low"], F.lit(0))))

    return let(F.struct(a.alias("x"), b.alias("y")), measure)


def minimal_change(before: Column, after: Column) -> Column:
    """Smallest contiguous replacement that turns ``before`` into ``after``."""
    prefix = common_prefix(before, after)

    def trimmed(p: Column) -> Column:
        rest_b = F.substring(before, p + 1, F.char_length(before))
        rest_a = F.substring(after, p + 1, F.char_length(after))
        suffix = common_prefix(F.reverse(rest_b), F.reverse(rest_a))
        return let(
            suffix,
            lambda s: F.struct(
                p.alias("start"),
                (F.char_length(before) - s).alias("end"),
                F.substring(after, p + 1, F.char_length(after) - p - s).alias("after"),
            ),
        )

    return let(prefix, trimmed)
