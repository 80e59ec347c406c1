"""Documents, paragraphs, scalar expressions and segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import spans as S
from palimpsest.functions import text as T
from palimpsest.operators import segments as G
from palimpsest.sources import documents as D

from .core import query, sql_matches, stage, table

WORD_SQL = r"[\p{L}\p{Nl}\p{No}]+"
SENT_SQL = r"[^.!?…\n]+[.!?…]*"

# ---- shared inputs ----------------------------------------------------------------------------
stage(
    "paragraphs",
    r"""SELECT doc_id, lang, source, paragraph::INT AS paragraph, text FROM (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) AS paragraph FROM documents) p
WHERE regexp_matches(text, '\S')""",
)
stage("words", sql_matches("paragraphs", WORD_SQL, "doc_id, paragraph", carry="lang, source").replace('"match"', "word"))
stage("sentences", sql_matches("paragraphs", SENT_SQL, "doc_id, paragraph", carry="lang, source").replace('"match"', "sentence"))

# Every document as a small manuscript: credits, a chapter label, then its own text.
stage(
    "manuscript",
    "SELECT doc_id, lang, source, 'Autora:' || chr(10) || source || chr(10) || 'Capítulo um — ' || lang || chr(10) || text AS text FROM documents",
)
stage(
    "mparagraphs",
    r"""SELECT doc_id, lang, source, paragraph::INT AS paragraph, text FROM (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) AS paragraph FROM manuscript) p
WHERE regexp_matches(text, '\S')""",
)
stage(
    "structured",
    r"""SELECT doc_id, lang, source, paragraph, text, heading OR role = 'front_matter' AS heading, role AS narrative_role,
  coalesce(last_value(CASE WHEN heading AND role <> 'front_matter' THEN trim(text) END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY paragraph ROWS UNBOUNDED PRECEDING), 'Sem capítulo identificado') AS chapter
FROM (SELECT *, CASE WHEN paragraph <= front_end THEN 'front_matter' WHEN heading THEN 'heading' ELSE 'body' END AS role
  FROM (SELECT *, coalesce(min(CASE WHEN paragraph > marker AND paragraph < first_label THEN paragraph END) OVER (PARTITION BY doc_id), marker, 0) AS front_end
    FROM (SELECT *, max(CASE WHEN text = 'Autora:' AND paragraph < first_label THEN paragraph END) OVER (PARTITION BY doc_id) AS marker
      FROM (SELECT *, min(CASE WHEN regexp_matches(text, '(?i)^cap[íi]tulo um —') THEN paragraph END) OVER (PARTITION BY doc_id) AS first_label,
          regexp_matches(text, '(?i)^cap[íi]tulo um —') OR (len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 10
            AND length(text) <= 100 AND regexp_matches(text, '\p{Lu}') AND NOT regexp_matches(text, '[\p{Ll}\p{Lt}]')
            AND NOT regexp_matches(text, '[.!?…,:;"“”]')) AS heading
        FROM mparagraphs) a) b) c) d""",
)
# Dialogue reading of every paragraph: it opens with a dash and every comma becomes an aside.
stage("dialogue", "SELECT doc_id, paragraph, lang, source, '— ' || replace(text, ', ', ' — ') AS text FROM paragraphs")
stage("dseps", sql_matches("dialogue", "[—–]", "doc_id, paragraph", carry="text").replace('"match"', "sep"))
stage(
    "dialogue_roles",
    """SELECT doc_id, paragraph, "start", "end", 'separador' AS role, text AS full_text FROM dseps
UNION ALL SELECT doc_id, paragraph, "end", stop, CASE WHEN n % 2 = 0 THEN 'dialogo' ELSE 'narracao' END, text FROM (
  SELECT *, coalesce(lead("start") OVER (PARTITION BY doc_id, paragraph ORDER BY n), length(text))::INT AS stop FROM dseps) d
WHERE stop > "end\"""",
)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts hashed by document: the one exchange that later windows and joins by document reuse."""
    return S.colocate(table(spark, sf, "documents"))


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return D.paragraphs(documents(spark, sf), keep=["lang", "source"])


def words(spark: SparkSession, sf: str) -> DataFrame:
    return S.words(paragraphs(spark, sf), carry=["lang", "source"])


def words_in_place(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows for queries that need the offsets of all words."""
    return S.words_in_place(paragraphs(spark, sf), carry=["lang", "source"])


def manuscript(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.concat_ws("\n", F.lit("Autora:"), "source", F.concat(F.lit("Capítulo um — "), "lang"), "text")
    return documents(spark, sf).select("doc_id", "lang", "source", lines.alias("text"))


def structured(spark: SparkSession, sf: str) -> DataFrame:
    return D.structure(manuscript(spark, sf), keep=["lang", "source"])


def dialogue(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("— "), F.replace("text", F.lit(", "), F.lit(" — ")))
    return paragraphs(spark, sf).withColumn("text", text).withColumn("heading", F.lit(False))


def quoted(spark: SparkSession, sf: str) -> DataFrame:
    """Commas open quotations and exclamation marks close them, so many stay open across paragraphs."""
    text = F.replace(F.replace("text", F.lit(", "), F.lit(", “")), F.lit("!"), F.lit("!”"))
    return paragraphs(spark, sf).withColumn("text", text).withColumn("heading", D.short_title(F.col("text")))


# ---- A: sources -------------------------------------------------------------------------------
@query("a01_paragraphs", "SELECT doc_id, paragraph, text FROM paragraphs")
def a01(spark, sf):
    return paragraphs(spark, sf).select("doc_id", "paragraph", "text")


@query("a02_headings", "SELECT doc_id, paragraph, text FROM structured WHERE heading")
def a02(spark, sf):
    return structured(spark, sf).where("heading").select("doc_id", "paragraph", "text")


@query("a03_chapters", "SELECT doc_id, paragraph, chapter FROM structured")
def a03(spark, sf):
    return structured(spark, sf).select("doc_id", "paragraph", "chapter")


@query("a04_front_matter", "SELECT doc_id, paragraph, narrative_role FROM structured")
def a04(spark, sf):
    return structured(spark, sf).select("doc_id", "paragraph", "narrative_role")


@query(
    "a05_global_offsets",
    """SELECT doc_id, paragraph, (stop - length(text) - 1)::BIGINT AS doc_start, (stop - 1)::BIGINT AS doc_end FROM (
SELECT doc_id, paragraph, text, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY paragraph ROWS UNBOUNDED PRECEDING) AS stop FROM paragraphs) p""",
)
def a05(spark, sf):
    return D.global_offsets(paragraphs(spark, sf)).select("doc_id", "paragraph", "doc_start", "doc_end")


@query(
    "a06_text_index",
    "SELECT doc_id, length(t)::INT AS length, sha256(t) AS sha256 FROM (SELECT doc_id, string_agg(text, chr(10) ORDER BY paragraph) AS t FROM paragraphs GROUP BY doc_id) p",
)
def a06(spark, sf):
    return D.text_index(paragraphs(spark, sf))


@query(
    "a06_duplicate_numbers",
    """SELECT conv_id AS doc_id, paragraph, count(*) AS times FROM (
SELECT conv_id, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS paragraph, unnest(string_split(text, chr(10))) AS line FROM conversations) t
WHERE regexp_matches(line, '\\S') GROUP BY ALL HAVING count(*) > 1""",
)
def a06b(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "text")
    return D.duplicate_numbers(D.paragraphs(turns))


@query(
    "a07_input_guards",
    r"""WITH seen AS (SELECT doc_id, max(length(text)) AS longest,
  max((len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 10 AND length(text) <= 100 AND regexp_matches(text, '\p{Lu}')
    AND NOT regexp_matches(text, '[\p{Ll}\p{Lt}]') AND NOT regexp_matches(text, '[.!?…,:;"“”]'))::INT) AS headed FROM paragraphs GROUP BY doc_id)
SELECT d.doc_id, w.warning FROM documents d LEFT JOIN seen s USING (doc_id),
  LATERAL (SELECT unnest([CASE WHEN longest IS NULL THEN 'empty_document' END, CASE WHEN longest > 100000 THEN 'oversized_paragraph' END,
    CASE WHEN coalesce(headed, 0) = 0 THEN 'no_heading' END]) AS warning) w WHERE w.warning IS NOT NULL""",
)
def a07(spark, sf):
    return D.input_guards(documents(spark, sf), D.detect_headings(paragraphs(spark, sf)))


@query(
    "a15_plain_books",
    r"""SELECT doc_id, block::INT AS block, text FROM (SELECT doc_id, block, trim(regexp_replace(b, '\s+', ' ', 'g')) AS text FROM (
  SELECT doc_id, unnest(parts) AS b, generate_subscripts(parts, 1) - 1 AS block FROM (
    SELECT doc_id, string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)) AS parts FROM documents) x) y) z
WHERE len(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+')) >= 6 AND NOT (regexp_matches(text, '\p{Lu}') AND NOT regexp_matches(text, '[\p{Ll}\p{Lt}]'))""",
)
def a15(spark, sf):
    wrapped = F.concat(
        F.lit("front\n*** START OF THE BOOK ***\n"),
        F.replace("text", F.lit(".\n"), F.lit(".\n\n")),
        F.lit("*** END OF THE BOOK ***\nlicence"),
    )
    return D.plain_book_paragraphs(documents(spark, sf).select("doc_id", wrapped.alias("text")))


@query("a18_chapter_index", "SELECT doc_id, paragraph, trim(text) AS title, narrative_role FROM structured WHERE narrative_role <> 'body'")
def a18(spark, sf):
    return D.chapter_index(structured(spark, sf))


# ---- B: scalar expressions --------------------------------------------------------------------
@query(
    "b01_normalized_words",
    rf"SELECT doc_id, paragraph, array_to_string(regexp_extract_all(lower(text), '{WORD_SQL}'), ' ') AS key FROM paragraphs",
)
def b01(spark, sf):
    return paragraphs(spark, sf).select("doc_id", "paragraph", T.normalized_words(F.col("text")).alias("key"))


_STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_KEYS)


@query(
    "b02_prefix_keys",
    rf"""SELECT doc_id, paragraph, count(DISTINCT substr(w, 1, 5)) AS keys, min(substr(w, 1, 5)) AS first_key FROM (
  SELECT doc_id, paragraph, unnest(regexp_extract_all(translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}'), '[a-z0-9]+')) AS w FROM paragraphs) t
WHERE length(w) >= 3 AND w NOT IN ({_STOP_SQL}) GROUP BY ALL""",
)
def b02(spark, sf):
    keyed = paragraphs(spark, sf).select("doc_id", "paragraph", T.prefix_keys(F.col("text")).alias("k"))
    return keyed.where(F.size("k") > 0).select(
        "doc_id", "paragraph", F.size("k").cast("long").alias("keys"), F.array_min("k").alias("first_key")
    )


@query(
    "b03_normalize_quotes",
    r"""SELECT doc_id, paragraph, q AS normal, regexp_replace(regexp_replace(q, '^(?:o|a|os|as|um|uma|dona|seu|sr\.?|sra\.?)\s+', ''), '^[ .,:;!?]+|[ .,:;!?]+$', '', 'g') AS entity
FROM (SELECT doc_id, paragraph, lower(trim(regexp_replace(translate(text, '“”«»‘’—–', '""""''''--'), '\s+', ' ', 'g'))) AS q FROM paragraphs) p""",
)
def b03(spark, sf):
    return paragraphs(spark, sf).select(
        "doc_id", "paragraph", T.normalize_quotes(F.col("text")).alias("normal"), T.entity_key(F.col("text")).alias("entity")
    )


@query(
    "b04_words",
    'SELECT doc_id, paragraph, count(*) AS words, sum("start")::BIGINT AS starts, sum("end")::BIGINT AS ends, max(word) AS last_word FROM words GROUP BY ALL',
)
def b04(spark, sf):
    return (
        words(spark, sf)
        .groupBy("doc_id", "paragraph")
        .agg(F.count("*").alias("words"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.max("word").alias("last_word"))
    )


@query("b05_sentences", 'SELECT doc_id, paragraph, n, "start", "end", sentence FROM sentences')
def b05(spark, sf):
    return S.sentences(paragraphs(spark, sf))


@query(
    "b05_sentence_ordinal",
    r"""SELECT p.doc_id, p.paragraph, (SELECT count(*) FROM sentences s WHERE s.doc_id = p.doc_id AND s.paragraph = p.paragraph AND s."end" <= length(p.text) // 2)::INT AS ordinal FROM paragraphs p""",
)
def b05b(spark, sf):
    ends = F.transform(S.match_spans(F.col("text"), S.SENTENCE), lambda m: m["end"])
    half = F.expr("char_length(text) div 2")
    return paragraphs(spark, sf).select("doc_id", "paragraph", S.sentence_ordinal(ends, half).alias("ordinal"))


@query("b06_match_spans", 'SELECT doc_id, paragraph, n, "start", "end", "match" FROM (' + sql_matches("paragraphs", r"[!%*#&$|]{2,}", "doc_id, paragraph") + ") m")
def b06(spark, sf):
    return S.explode_matches(paragraphs(spark, sf), r"[!%*#&$|]{2,}", ["doc_id", "paragraph"])


@query(
    "b07_labels_and_credits",
    r"""SELECT doc_id, paragraph, (len(parts) >= 2 AND regexp_matches(text, '[\p{L}\p{N}]\s*$') AND len(list_filter(parts, lambda w: NOT regexp_matches(w, '^[\p{Lu}\p{Nd}]'))) = 0) AS label,
 (regexp_full_match(trim(text), '[\p{L}\p{Nl}\p{No}]+(?:\s+[\p{L}\p{Nl}\p{No}]+){0,3}') AND len(list_filter(parts, lambda w: NOT (w IN ('de','da','do','dos','das','e') OR regexp_matches(w, '^\p{Lu}')))) = 0) AS credit
FROM (SELECT doc_id, paragraph, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS parts FROM paragraphs) p""",
)
def b07(spark, sf):
    text = F.col("text")
    return paragraphs(spark, sf).select(
        "doc_id", "paragraph", T.is_list_or_label(text).alias("label"), T.is_credit_line(text).alias("credit")
    )


@query(
    "b08_expressive",
    r"""SELECT word, count(*) AS times FROM words WHERE
 len(list_filter(range(1, length(word) - 1), lambda i: substr(lower(word), i::INT, 1) = substr(lower(word), i::INT + 1, 1) AND substr(lower(word), i::INT, 1) = substr(lower(word), i::INT + 2, 1))) > 0
 OR regexp_matches(word, '(?i)^(?:h+u*m+|h+a+m+|a+h+[mn]*|a+h+a+|h+[mn]+|hã+|u+é|u+h+|o+h+|a+i+)$')
 OR (length(word) >= 3 AND regexp_matches(word, '^\p{L}+$') AND regexp_matches(word, '\p{Lu}') AND NOT regexp_matches(word, '[\p{Ll}\p{Lt}]')) GROUP BY word""",
)
def b08(spark, sf):
    counted = words(spark, sf).groupBy("word").agg(F.count("*").alias("times"))
    return counted.where(T.is_expressive(F.col("word")))


@query(
    "b09_marked_parts",
    """SELECT doc_id, paragraph, substr(text, 1, a) AS before, substr(text, a + 1, b - a) AS marked, substr(text, b + 1) AS after,
  substr(text, 1, a) || '⟦' || substr(text, a + 1, b - a) || '⟧' || substr(text, b + 1) AS target
FROM (SELECT doc_id, paragraph, text, length(text) // 3 AS a, length(text) // 2 AS b FROM paragraphs) p""",
)
def b09(spark, sf):
    a, b, text = F.expr("char_length(text) div 3").cast("int"), F.expr("char_length(text) div 2").cast("int"), F.col("text")
    parts = T.marked_parts(text, a, b)
    pair = T.marker_pair(F.array("text", "source", "lang"))
    return paragraphs(spark, sf).select(
        "doc_id",
        "paragraph",
        parts["before"].alias("before"),
        parts["marked"].alias("marked"),
        parts["after"].alias("after"),
        T.mark_target(text, a, b, pair).alias("target"),
    )


@query(
    "b10_utf16_offsets",
    """SELECT doc_id, paragraph, (length(text) // 2)::INT AS code_points,
  ((length(text) // 2) + length(substr(text, 1, length(text) // 2)) - length(replace(substr(text, 1, length(text) // 2), 'e', '')))::INT AS units FROM paragraphs""",
)
def b10(spark, sf):
    wide = paragraphs(spark, sf).withColumn("text", F.replace("text", F.lit("e"), F.lit("😀")))
    half = F.expr("char_length(text) div 2").cast("int")
    units = (F.octet_length(F.encode(F.substring("text", F.lit(1), half), "UTF-16LE")) / 2).cast("int")
    return wide.withColumn("units", units).select(
        "doc_id", "paragraph", T.utf16_to_codepoint(F.col("text"), F.col("units")).alias("code_points"), "units"
    )


@query(
    "b11_occurrence_ordinal",
    r"""WITH t AS (SELECT doc_id, paragraph, n, "start", word, count(*) OVER (PARTITION BY doc_id, paragraph) AS total_words FROM tokens_w),
target AS (SELECT doc_id, paragraph, word, "start" FROM t WHERE n = total_words // 2)
SELECT g.doc_id, g.paragraph, g.word AS target, count(*) FILTER (WHERE t."start" <= g."start")::INT AS which, count(*)::INT AS total
FROM target g JOIN t ON t.doc_id = g.doc_id AND t.paragraph = g.paragraph AND t.word = g.word GROUP BY ALL""".replace(
        "tokens_w", "(" + sql_matches("paragraphs", r"[\p{L}\p{N}_]+", "doc_id, paragraph").replace('"match"', "word") + ") w"
    ),
)
def b11(spark, sf):
    tokens = S.match_spans(F.col("text"), r"[\p{L}\p{N}_]+")
    picked = (
        paragraphs(spark, sf)
        .withColumn("_t", tokens)
        .where(F.size("_t") > 0)
        .withColumn("_w", F.element_at("_t", (F.expr("size(_t) div 2") + 1).cast("int")))
    )
    place = T.occurrence_ordinal(F.col("text"), F.col("_w.start"), F.col("_w.end"))
    return picked.withColumn("_p", place).select(
        "doc_id", "paragraph", F.col("_w.text").alias("target"), F.col("_p.which").alias("which"), F.col("_p.total").alias("total")
    )


@query(
    "b12_find_excerpt",
    """SELECT doc_id, paragraph, (len(string_split(lower(text), f)) - 1)::INT AS places, (strpos(lower(text), f) - 1)::INT AS first_start
FROM (SELECT doc_id, paragraph, text, trim(lower(substr(text, length(text) // 2, 12))) AS f FROM paragraphs) p WHERE f <> ''""",
)
def b12(spark, sf):
    fragment = F.upper(F.trim(F.substring("text", F.expr("char_length(text) div 2").cast("int"), F.lit(12))))
    # Sharp s has no one-letter capital, so the capitals are only put on plain letters.
    fragment = F.translate(F.trim(F.substring("text", F.expr("char_length(text) div 2").cast("int"), F.lit(12))), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    places = T.find_excerpt(F.col("text"), F.col("_f"))
    return (
        paragraphs(spark, sf)
        .withColumn("_f", fragment)
        .where("_f <> ''")
        .withColumn("_p", places)
        .select("doc_id", "paragraph", F.size("_p").alias("places"), F.try_element_at("_p", F.lit(1))["start"].alias("first_start"))
    )


@query(
    "b16_cased_like",
    r"""SELECT doc_id, paragraph, CASE WHEN regexp_matches(w, '\p{Lu}') AND NOT regexp_matches(w, '[\p{Ll}\p{Lt}]') THEN 'ALÉM DISSO' WHEN regexp_matches(w, '^\p{Lu}') THEN 'Além disso' ELSE 'além disso' END AS suggestion
FROM (SELECT doc_id, paragraph, word AS w FROM words WHERE n = 0) t""",
)
def b16(spark, sf):
    first = F.regexp_extract("text", S.WORD, 0)
    return paragraphs(spark, sf).where(first != "").select(
        "doc_id", "paragraph", T.cased_like(first, F.lit("além disso")).alias("suggestion")
    )


@query(
    "c07_speech_openers",
    r"""SELECT doc_id, paragraph, regexp_matches(text, '^\s*(?:[—–]|- )') AS opens, regexp_matches(text, '^\s*[-–—]\s') AS strict, regexp_matches(substr(text, 1, length(text) // 2), '[—–]\s*$') AS after_dash FROM dialogue""",
)
def c07(spark, sf):
    text = F.col("text")
    half = F.substring(text, F.lit(1), F.expr("char_length(text) div 2").cast("int"))
    return dialogue(spark, sf).select(
        "doc_id",
        "paragraph",
        T.opens_speech(text).alias("opens"),
        T.opens_speech(text, strict=True).alias("strict"),
        T.ends_in_dash(half).alias("after_dash"),
    )


@query(
    "d18_scene_marks",
    r"""SELECT doc_id, paragraph, regexp_matches(text, '^\s*([*#~]\s*){1,5}$') AS scene_break, regexp_matches(text, '(?i)^\s*(?:\*{3}|—{3}|no dia seguinte\b|dias depois\b|na manhã seguinte\b)') AS cut
FROM (SELECT doc_id, paragraph, regexp_replace(text, '[^*#]{40,}', '***', 'g') AS text FROM paragraphs) p""",
)
def d18(spark, sf):
    text = F.regexp_replace("text", r"[^*#]{40,}", "***")
    return paragraphs(spark, sf).withColumn("text", text).select(
        "doc_id", "paragraph", T.scene_break(F.col("text")).alias("scene_break"), T.cut_marker(F.col("text")).alias("cut")
    )


# ---- C: segmentation --------------------------------------------------------------------------
stage(
    "quoted_p",
    r"""SELECT doc_id, paragraph, text, (len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 10
            AND length(text) <= 100 AND regexp_matches(text, '\p{Lu}') AND NOT regexp_matches(text, '[\p{Ll}\p{Lt}]')
            AND NOT regexp_matches(text, '[.!?…,:;"“”]')) AS heading
FROM (SELECT doc_id, paragraph, replace(replace(text, ', ', ', “'), '!', '!”') AS text FROM paragraphs) p""",
)


@query(
    "c01_quote_state",
    """WITH signs AS (SELECT doc_id, paragraph, heading, text, unnest(list_concat([''], regexp_extract_all(text, '[“”«»"‘’]'))) AS sign,
    generate_subscripts(list_concat([''], regexp_extract_all(text, '[“”«»"‘’]')), 1) AS k FROM quoted_p),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, k) AS seq FROM signs),
walk AS (
  SELECT doc_id, seq, paragraph, k, heading, '' AS entry, '' AS state FROM ordered WHERE seq = 1
  UNION ALL
  SELECT o.doc_id, o.seq, o.paragraph, o.k, o.heading, CASE WHEN o.k = 1 THEN w.state ELSE w.entry END,
    CASE WHEN o.heading THEN ''
         WHEN o.k = 1 THEN CASE WHEN w.state <> '' AND starts_with(ltrim(o.text), CASE w.state WHEN '”' THEN '“' WHEN '»' THEN '«' WHEN '"' THEN '"' ELSE '‘' END)
              AND contains(substr(ltrim(o.text), 2), w.state) THEN '' ELSE w.state END
         WHEN w.state <> '' THEN CASE WHEN o.sign = w.state THEN '' ELSE w.state END
         ELSE CASE o.sign WHEN '“' THEN '”' WHEN '«' THEN '»' WHEN '"' THEN '"' WHEN '‘' THEN '’' ELSE '' END END
  FROM walk w JOIN ordered o ON o.doc_id = w.doc_id AND o.seq = w.seq + 1)
SELECT doc_id, paragraph, arg_max(entry, k) AS entry, arg_max(state, k) AS exit FROM walk GROUP BY doc_id, paragraph""",
)
def c01(spark, sf):
    state = G.quote_state(quoted(spark, sf))
    closer = lambda c: F.translate(F.col(c).cast("string"), "12340", "”»\"’")
    return state.select("doc_id", "paragraph", closer("entry").alias("entry"), closer("exit").alias("exit"))


@query("c01_quote_spans")
def c01b(spark, sf):
    state = G.quote_state(quoted(spark, sf))
    inside = F.aggregate("quote_spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return state.select(
        "doc_id", "paragraph", F.size("quote_spans").alias("spans"), inside.alias("quoted"), F.array_join("quote_warnings", ",").alias("warnings")
    )


@query(
    "c02_dash_turns",
    'SELECT doc_id, paragraph, "start", "end", role FROM dialogue_roles WHERE role <> \'narracao\'',
)
def c02(spark, sf):
    return (
        dialogue(spark, sf)
        .select("doc_id", "paragraph", F.explode(G.dash_spans(F.col("text"))).alias("s"))
        .select("doc_id", "paragraph", "s.start", "s.end", "s.role")
    )


@query("c03_classify_roles")
def c03(spark, sf):
    roles = G.classify_roles(quoted(spark, sf))
    return roles.select("doc_id", "paragraph", F.explode("roles").alias("s")).select("doc_id", "paragraph", "s.*")


@query(
    "c04_role_spans",
    'SELECT doc_id, paragraph, "start", "end", role, substr(full_text, "start" + 1, "end" - "start") AS text FROM dialogue_roles WHERE role IN (\'narracao\', \'dialogo\')',
)
def c04(spark, sf):
    runs = G.role_spans(G.classify_roles(dialogue(spark, sf), G.SegmentRules(quotes_role=G.NARRATION)), [G.NARRATION, G.SPEECH])
    return runs.select("doc_id", "paragraph", "start", "end", "role", "text")


@query(
    "c05_mask_text",
    """SELECT doc_id, paragraph, string_agg(CASE WHEN role = 'narracao' THEN substr(full_text, "start" + 1, "end" - "start") ELSE repeat(' ', "end" - "start") END, '' ORDER BY "start") AS mask FROM dialogue_roles GROUP BY ALL""",
)
def c05(spark, sf):
    roles = G.classify_roles(dialogue(spark, sf), G.SegmentRules(quotes_role=G.NARRATION))
    return roles.select("doc_id", "paragraph", G.mask_text(F.col("text"), F.col("roles"), [G.NARRATION]).alias("mask"))


@query("c06_narrative_mask")
def c06(spark, sf):
    return G.narrative_mask(quoted(spark, sf)).select("doc_id", "paragraph", "mask", F.size("closing").alias("closing"))


@query(
    "c08_span_role",
    """SELECT s.doc_id, s.paragraph, s."start", s."end", CASE WHEN count(DISTINCT r.role) = 1 THEN min(r.role) END AS span_role
FROM dsent s LEFT JOIN dialogue_roles r ON r.doc_id = s.doc_id AND r.paragraph = s.paragraph AND r."start" < s."end" AND r."end" > s."start" AND r.role <> 'separador'
GROUP BY ALL""",
)
def c08(spark, sf):
    lines = dialogue(spark, sf)
    targets = S.sentences(lines).select("doc_id", "paragraph", "start", "end")
    return G.span_role(targets, G.classify_roles(lines, G.SegmentRules(quotes_role=G.NARRATION)))


@query(
    "c09_scenes",
    """WITH RECURSIVE r AS (SELECT doc_id, paragraph, chapter, heading OR regexp_matches(text, '^\\s*([*#~]\\s*){1,5}$') AS skip, length(text) AS size,
   row_number() OVER (PARTITION BY doc_id ORDER BY paragraph) AS seq, coalesce(lag(chapter) OVER (PARTITION BY doc_id ORDER BY paragraph) <> chapter, false) AS cut FROM structured),
w AS (SELECT doc_id, seq, paragraph, NOT skip AS open, CASE WHEN skip THEN 0 ELSE 1 END AS scene, CASE WHEN skip THEN 0 ELSE size END AS total, skip FROM r WHERE seq = 1
 UNION ALL SELECT r.doc_id, r.seq, r.paragraph, NOT r.skip, w.scene + CASE WHEN NOT r.skip AND (NOT w.open OR r.cut OR w.total + r.size > 3500) THEN 1 ELSE 0 END,
   CASE WHEN r.skip THEN 0 WHEN NOT w.open OR r.cut OR w.total + r.size > 3500 THEN r.size ELSE w.total + r.size END, r.skip
 FROM w JOIN r ON r.doc_id = w.doc_id AND r.seq = w.seq + 1)
SELECT doc_id, paragraph, scene FROM w WHERE NOT skip""",
)
def c09(spark, sf):
    return G.scenes(structured(spark, sf))


@query(
    "c10_chapter_groups",
    r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_paragraph)::INT AS chapter_order,
  slug || CASE WHEN row_number() OVER (PARTITION BY doc_id, slug ORDER BY first_paragraph) > 1 THEN '-' || row_number() OVER (PARTITION BY doc_id, slug ORDER BY first_paragraph) ELSE '' END AS chapter_id,
  chapter AS title, first_paragraph, last_paragraph, paragraphs, hash FROM (
 SELECT *, CASE WHEN s = '' THEN 'sem-titulo' ELSE s END AS slug FROM (SELECT *, substr(regexp_replace(regexp_replace(lower(replace(chapter, '—', '-')), '[^\p{L}\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS s FROM (
  SELECT doc_id, island, chapter, min(paragraph) AS first_paragraph, max(paragraph) AS last_paragraph, count(*) AS paragraphs, sha256(string_agg(text, chr(10) ORDER BY paragraph)) AS hash
  FROM (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY paragraph ROWS UNBOUNDED PRECEDING) AS island FROM structured) a WHERE NOT heading GROUP BY doc_id, island, chapter) b) b2) c""",
)
def c10(spark, sf):
    return G.chapter_groups(structured(spark, sf))


@query("c11_review_windows")
def c11(spark, sf):
    return G.review_windows(structured(spark, sf), max_chars=4000)


@query(
    "c12_context_window",
    """SELECT a.doc_id, a.paragraph, count(*)::INT AS neighbours, sum(b.paragraph)::BIGINT AS paragraph_sum, sum(length(b.text))::BIGINT AS chars
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph) AS seq FROM structured) a
JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph) AS seq FROM structured) b
  ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq - 2 AND a.seq + 2 AND a.chapter = b.chapter GROUP BY ALL""",
)
def c12(spark, sf):
    df = G.context_window(structured(spark, sf))
    return df.select(
        "doc_id",
        "paragraph",
        F.size("context").alias("neighbours"),
        F.aggregate("context", F.lit(0).cast("long"), lambda a, r: a + r["paragraph"]).alias("paragraph_sum"),
        F.aggregate("context", F.lit(0).cast("long"), lambda a, r: a + F.char_length(r["text"])).alias("chars"),
    )


@query("c12_scene_window")
def c12b(spark, sf):
    return G.scene_window(structured(spark, sf)).select("doc_id", "paragraph", F.array_join(F.transform("context", lambda n: n.cast("string")), ",").alias("context"))


@query(
    "c13_extraction_context",
    """WITH p AS (SELECT doc_id, paragraph, text, length(text) AS size FROM paragraphs),
pairs AS (SELECT doc_id, min(paragraph) AS a, paragraph AS b FROM (SELECT doc_id, paragraph FROM p) x GROUP BY doc_id, b),
firsts AS (SELECT doc_id, min(paragraph) AS a FROM p GROUP BY doc_id),
pr AS (SELECT p.doc_id, f.a, p.paragraph AS b FROM p JOIN firsts f ON f.doc_id = p.doc_id WHERE p.paragraph <= f.a + 4),
mid AS (SELECT pr.doc_id, pr.a, pr.b, coalesce(sum(m.size), 0) AS between_size FROM pr LEFT JOIN p m ON m.doc_id = pr.doc_id AND m.paragraph > pr.a AND m.paragraph < pr.b GROUP BY ALL)
SELECT mid.doc_id, mid.b AS pair, string_agg('[§' || p.paragraph || '] ' || p.text, chr(10) ORDER BY p.paragraph) AS context
FROM mid JOIN p ON p.doc_id = mid.doc_id AND (p.paragraph IN (mid.a, mid.b) OR (between_size <= 2500 AND p.paragraph > mid.a AND p.paragraph < mid.b)) GROUP BY ALL""",
)
def c13(spark, sf):
    lines = paragraphs(spark, sf).select("doc_id", "paragraph", "text")
    firsts = lines.groupBy("doc_id").agg(F.min("paragraph").alias("a"))
    pairs = lines.select("doc_id", F.col("paragraph").alias("b")).join(firsts, "doc_id").where("b <= a + 4").select("doc_id", "a", "b", F.col("b").alias("pair"))
    return G.extraction_context(pairs, lines)


stage("dsent", sql_matches("dialogue", SENT_SQL, "doc_id, paragraph").replace('"match"', "sentence"))
