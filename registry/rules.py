"""Surface rules, repetition, names and the external checker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import editorial as E
from palimpsest.operators import rules as R
from palimpsest.sources import config as C

from .core import query, sql_matches, stage
from .structure import WORD_SQL, paragraphs, words, words_in_place

# ---- inputs -----------------------------------------------------------------------------------
# The same slips typed into every text: doubled signs, spaces, a wrong locution, questions.
_NOISE = [(", ", " ,, "), (". ", ".. "), (" de ", "  de "), (" the ", " Além de disso "), ("!", "? ela "), (" und ", " que, não "), (" que ", " que? ")]


def noisy(spark, sf) -> DataFrame:
    text = F.col("text")
    for old, new in _NOISE:
        text = F.replace(text, F.lit(old), F.lit(new))
    return paragraphs(spark, sf).withColumn("text", text)


_text = "text"
for _old, _new in _NOISE:
    _text = f"replace({_text}, '{_old}', '{_new}')"
stage("noisy", f"SELECT doc_id, paragraph, lang, source, {_text} AS text FROM paragraphs")


def narration(df: DataFrame) -> DataFrame:
    """Whole paragraphs as narration: no dashes or quotations in these texts."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.char_length("text").alias("end"), F.lit("narracao").alias("role")))
    return df.withColumn("roles", whole)


def lexicon(spark, sf) -> DataFrame:
    """Words found in five documents or more; the last letter stands in for the part of speech."""
    low = F.lower("word")
    last = F.substring("word", -1, 1)
    flags = F.when(last == "e", 5).when(last == "d", 3).when(last == "r", 17).otherwise(32)
    seen = words(spark, sf).select("doc_id", low.alias("word")).distinct().groupBy("word").agg(F.count("*").alias("_docs"))
    return seen.where("_docs >= 5").select("word", flags.alias("flags"))


stage(
    "lexicon",
    """SELECT word, CASE right(word, 1) WHEN 'e' THEN 5 WHEN 'd' THEN 3 WHEN 'r' THEN 17 ELSE 32 END::INT AS flags FROM (
SELECT lower(word) AS word FROM words GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5) w""",
)

stage("finite_words", "SELECT word FROM lexicon WHERE flags & 1 <> 0")
stage("before_verb", "SELECT unnest(['me','te','lhe','lhes','nos','vos','o','a','os','as','não','nunca','já']) AS word")

# ---- D: surface rules -------------------------------------------------------------------------
stage("noisy_comma", sql_matches("noisy", ",{2,}|;{2,}", "doc_id, paragraph").replace('"match"', "hit_text"))
stage("noisy_dots", sql_matches("noisy", r"\.+", "doc_id, paragraph").replace('"match"', "hit_text"))
stage("noisy_spaces", sql_matches("noisy", " +", "doc_id, paragraph", carry="text").replace('"match"', "hit_text"))
stage("noisy_wrong", sql_matches("noisy", r"(?i)além[ \t]+de[ \t]+disso", "doc_id, paragraph", carry="text").replace('"match"', "hit_text"))
stage("noisy_words", sql_matches("noisy", r"[\p{L}\p{N}_]+", "doc_id, paragraph", carry="text").replace('"match"', "word"))
stage(
    "surface_findings",
    r"""SELECT doc_id, paragraph, "start", "end", 'pontuacao_duplicada' AS rule, 'Pontuação duplicada' AS category, 'confirmed_error' AS severity, 'alta' AS confidence, substr(hit_text, 1, 1) AS suggestion FROM noisy_comma
UNION ALL SELECT doc_id, paragraph, "start", "end", 'pontuacao_duplicada', 'Dois pontos finais', 'probable_error', 'alta', NULL FROM noisy_dots WHERE length(hit_text) = 2
UNION ALL SELECT doc_id, paragraph, "start", "end", 'espacamento', 'Espaço repetido', 'probable_error', 'alta', ' ' FROM noisy_spaces
  WHERE length(hit_text) >= 2 AND "start" > 0 AND regexp_matches(substr(text, "start", 1), '[\p{L}\p{N}_]') AND regexp_matches(substr(text, "end" + 1, 1), '[\p{L}\p{N}_]')
UNION ALL SELECT doc_id, paragraph, "start", "end", 'espacamento', 'Espaço antes de pontuação', 'probable_error', 'alta', '' FROM noisy_spaces
  WHERE "start" > 0 AND regexp_matches(substr(text, "start", 1), '[\p{L}\p{N}_]') AND substr(text, "end" + 1, 1) IN (',', ';')
UNION ALL SELECT doc_id, paragraph, "start", "end", 'construcao_invalida', 'Construção inválida', 'confirmed_error', 'alta',
    CASE WHEN regexp_matches(hit_text, '\p{Lu}') AND NOT regexp_matches(hit_text, '\p{Ll}') THEN 'ALÉM DISSO' WHEN regexp_matches(hit_text, '^\p{Lu}') THEN 'Além disso' ELSE 'além disso' END FROM noisy_wrong
  WHERE NOT regexp_matches(substr(text, "start", 1), '[\p{L}\p{N}_]') AND NOT regexp_matches(substr(text, "end" + 1, 1), '[\p{L}\p{N}_]')
UNION ALL SELECT doc_id, paragraph, "start", "end", 'que_tonico_interrogativo', 'Acento em ‘quê’ interrogativo', 'probable_error', 'alta',
    CASE WHEN word = 'QUE' THEN 'QUÊ' WHEN regexp_matches(word, '^\p{Lu}') THEN 'Quê' ELSE 'quê' END FROM noisy_words
  WHERE lower(word) = 'que' AND regexp_matches(substr(text, "end" + 1), '^[ \t]*[?!]')
UNION ALL SELECT doc_id, paragraph, "start", "end", rule, category, severity, 'média', suggestion FROM (
  SELECT doc_id, paragraph, ("start" - length(gap_ws))::INT AS "start", "end", 'capitalizacao_contextual' AS rule, 'Inicial após pergunta ou exclamação' AS category, 'probable_error' AS severity,
    gap_ws || upper(substr(word, 1, 1)) || substr(word, 2) AS suggestion, head, gap_ws FROM (
      SELECT *, substr(text, 1, "start") AS head, regexp_extract(substr(text, 1, "start"), '[ \t]+$', 0) AS gap_ws FROM noisy_words
      WHERE word IN ('eu','tu','ele','ela','nós','vós','eles','elas','você','vocês')) x
    WHERE gap_ws <> '' AND right(substr(head, 1, length(head) - length(gap_ws)), 1) IN ('?', '!')
      AND NOT regexp_matches(substr(head, 1, length(head) - length(gap_ws)), '(?i)(?:^|[.!?…:;—–"“«]\s*)(?:ah|oh|ó|ai|ui|eh|ei|olá|ufa|puxa|nossa|hein|ora|oba|opa|psiu|credo|oxalá|céus)[!?]$')) y
UNION ALL SELECT doc_id, paragraph, "start", stop, 'virgula_que_nao', 'Vírgula após ‘que’', 'probable_error', 'média', replace(substr(text, "start" + 1, stop - "start"), ',', '') FROM (
  SELECT *, lead(word) OVER w AS next_word, lead("start") OVER w AS next_start, (lead("end") OVER w)::INT AS stop FROM noisy_words WINDOW w AS (PARTITION BY doc_id, paragraph ORDER BY "start")) z
  WHERE lower(word) = 'que' AND lower(next_word) = 'não' AND regexp_full_match(substr(text, "end" + 1, next_start - "end"), ',[ \t]+')
    AND NOT regexp_matches(substr(text, 1, "start"), '(?i)(?:^|[^\p{L}\p{N}_])(?:pelo|de\s+(?:modo|maneira|forma|sorte))\s+$')
    AND NOT regexp_matches(substr(text, stop + 1), '(?i)^\s*(?:obstante|só|apenas)(?:[^\p{L}\p{N}_]|$)|^\s*,')""",
)

_FIELDS = ["doc_id", "paragraph", "start", "end", "rule", "category", "severity", "confidence", "suggestion"]
_SELECT = 'SELECT doc_id, paragraph, "start", "end", rule, category, severity, confidence, suggestion FROM surface_findings'


def _surface(spark, sf, *rules_: str) -> DataFrame:
    return R.apply_rules(narration(noisy(spark, sf)), enabled=rules_ or None).select(*_FIELDS)


@query("d01_rule_catalog", _SELECT)
def d01(spark, sf):
    return _surface(spark, sf)


def _one(name: str, rule: str):
    @query(name, f"{_SELECT} WHERE rule = '{rule}'")
    def run(spark, sf):
        return _surface(spark, sf, rule)


_one("d02_doubled_punctuation", "pontuacao_duplicada")
_one("d03_spacing", "espacamento")
_one("d04_invalid_phrase", "construcao_invalida")
_one("d05_interrogative_word", "que_tonico_interrogativo")
_one("d06_comma_before_negation", "virgula_que_nao")
_one("d07_capital_after_question", "capitalizacao_contextual")

# Portuguese slips put in place of frequent words, for the locution rules.
_SLIPS = [
    (" the ", " as vezes "), (" of ", " a toa "), (" la ", " de baixo da "), (" der ", " mau educado "), (" and ", ", mais não "),
    (" die ", " encima da "), (" los ", " ao invés de "), (" und ", " as seis horas da manhã "), (" les ", " todas as vezes "), ("!", " porque?"),
]
_slip = "text"
for _old, _new in _SLIPS:
    _slip = f"replace({_slip}, '{_old}', '{_new}')"
stage("slips", f"SELECT doc_id, paragraph, {_slip} AS text FROM paragraphs")
stage("slip_words", sql_matches("slips", r"[\p{L}\p{N}_]+", "doc_id, paragraph", carry="text").replace('"match"', "word"))
stage(
    "slip_rows",
    """SELECT *, lower(word) AS w0, lead(lower(word)) OVER w AS w1, lead(lower(word), 2) OVER w AS w2, lead(lower(word), 3) OVER w AS w3, lead(lower(word), 4) OVER w AS w4,
  lag(lower(word)) OVER w AS p1, lead("start") OVER w AS s1, (lead("end") OVER w)::INT AS e1, substr(text, "end" + 1, 1) AS sign_after, lag("end") OVER w AS prev_end
FROM slip_words WINDOW w AS (PARTITION BY doc_id, paragraph ORDER BY "start")""",
)


def slips(spark, sf) -> DataFrame:
    text = F.col("text")
    for old, new in _SLIPS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return paragraphs(spark, sf).withColumn("text", text)


def _grammar(spark, sf, rule: str) -> DataFrame:
    return R.apply_rules(narration(slips(spark, sf)), R.GRAMMAR_RULES, [rule]).select("doc_id", "paragraph", "start", "end", "category", "suggestion")


@query(
    "d09_accent_locutions",
    r"""SELECT doc_id, paragraph, "start", e1 AS "end", 'Crase em locução' AS category, CASE WHEN regexp_matches(word, '^\p{Lu}') THEN 'À' ELSE 'à' END || CASE WHEN w1 = 'vezes' THEN 's vezes' ELSE ' toa' END AS suggestion
FROM slip_rows WHERE s1 = "end" + 1 AND substr(text, "end" + 1, 1) = ' ' AND (
  (w0 = 'a' AND w1 = 'toa') OR (w0 = 'as' AND w1 = 'vezes'
    AND NOT regexp_matches(substr(text, e1 + 1), '(?i)^\s+(?:que|em)(?:[^\p{L}\p{N}_]|$)')
    AND NOT regexp_matches(substr(text, 1, "start"), '(?i)(?:^|\s)[^\p{L}\p{N}_]*(?:todas|poucas|muitas|várias|algumas|das|nas|pelas|quantas|raras|duas|três|tantas|mesmas|outras|demais)[^\p{L}\p{N}_]*$')))
UNION ALL SELECT doc_id, paragraph, "start", "end", 'Crase antes de horas', CASE WHEN regexp_matches(word, '^\p{Lu}') THEN 'Às' ELSE 'às' END FROM slip_rows
 WHERE w0 = 'as' AND regexp_matches(substr(text, "end" + 1), '(?i)^\s+seis horas da manhã(?:[^\p{L}\p{N}_]|$)')
  AND NOT regexp_matches(substr(text, 1, "start"), '(?i)(?:^|\s)[^\p{L}\p{N}_]*(?:todas|durante|por|das|nas|pelas|as|entre)[^\p{L}\p{N}_]*$')""",
)
def d09(spark, sf):
    return _grammar(spark, sf, "crase")


@query(
    "d10_homophones",
    r"""SELECT doc_id, paragraph, "start", "end", 'Por que / porque' AS category, CASE WHEN regexp_matches(word, '^\p{Lu}') THEN 'Por quê' ELSE 'por quê' END AS suggestion FROM slip_rows
  WHERE w0 = 'porque' AND regexp_matches(substr(text, "end" + 1), '^\s*\?')
UNION ALL SELECT doc_id, paragraph, "start", "end", 'Mas / mais', CASE WHEN regexp_matches(word, '^\p{Lu}') THEN 'Mas' ELSE 'mas' END FROM slip_rows
  WHERE w0 = 'mais' AND w1 IN ('não','nunca','ninguém','nada','ele','ela','eles','elas','eu','nós','você','vocês','isso','aquilo','logo','então','também','agora','quando','sem')
   AND regexp_matches(substr(text, 1, "start"), ',\s+$') AND regexp_full_match(substr(text, "end" + 1, s1 - "end"), '\s+')
UNION ALL SELECT doc_id, paragraph, "start", e1, 'Mal / mau', CASE WHEN regexp_matches(word, '^\p{Lu}') THEN 'Mal' ELSE 'mal' END || substr(text, "start" + 4, e1 - "start" - 3) FROM slip_rows
  WHERE w0 = 'mau' AND s1 = "end" + 1 AND substr(text, "end" + 1, 1) IN (' ', '-') AND regexp_full_match(w1, '.+(?:ad|id)[oa]s?') AND w1 <> 'olhado'
UNION ALL SELECT doc_id, paragraph, "start", e1, 'Grafia de locução', CASE WHEN regexp_matches(word, '^\p{Lu}') THEN 'D' ELSE 'd' END || 'ebaixo' FROM slip_rows
  WHERE w0 = 'de' AND w1 = 'baixo' AND s1 = "end" + 1 AND substr(text, "end" + 1, 1) = ' ' AND regexp_matches(substr(text, e1 + 1), '(?i)^\s+d[aoe]s?(?:[^\p{L}\p{N}_]|$)')
UNION ALL SELECT doc_id, paragraph, "start", "end", 'Grafia de locução', CASE WHEN regexp_matches(word, '^\p{Lu}') THEN 'E' ELSE 'e' END || 'm cima' FROM slip_rows
  WHERE w0 = 'encima' AND regexp_matches(substr(text, "end" + 1), '(?i)^\s+d[aoe]s?(?:[^\p{L}\p{N}_]|$)')""",
)
def d10(spark, sf):
    return _grammar(spark, sf, "homofonos")


@query(
    "d11_open_endings",
    rf"""SELECT doc_id, paragraph, "start", "end", 'Frase cortada' AS category, NULL::VARCHAR AS suggestion FROM slip_rows
WHERE regexp_full_match(w0, '(?:{R.OPEN_ENDINGS})') AND regexp_matches(substr(text, "end" + 1), '^\s*(?:[!?]|\.(?:[^.]|$))')""",
)
def d11(spark, sf):
    return _grammar(spark, sf, "frase_cortada")


@query(
    "d13_locution_replacement",
    r"""SELECT doc_id, paragraph, "start", e1 AS "end", 'Locução' AS category, CASE WHEN regexp_matches(word, '^\p{Lu}') THEN 'E' ELSE 'e' END || 'm vez' AS suggestion FROM slip_rows
WHERE w0 = 'ao' AND w1 = 'invés' AND regexp_full_match(substr(text, "end" + 1, s1 - "end"), '\s+') AND regexp_matches(substr(text, e1 + 1), '(?i)^\s+d')""",
)
def d13(spark, sf):
    return _grammar(spark, sf, "locucoes")


@query(
    "d12_final_punctuation",
    r"""SELECT doc_id, paragraph, (length(t) - length(last))::INT AS "start", length(t)::INT AS "end", last || '.' AS suggestion FROM (
  SELECT doc_id, paragraph, t, regexp_extract(t, '[\p{L}\p{Nl}\p{No}]+$', 0) AS last, list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '') AS parts FROM (SELECT doc_id, paragraph, rtrim(text) AS t FROM paragraphs) p) q
WHERE last <> '' AND len(regexp_extract_all(t, '[\p{L}\p{Nl}\p{No}]+')) >= 4 AND regexp_matches(t, '[\p{L}\p{N}]$')
  AND NOT (len(parts) >= 2 AND len(list_filter(parts, lambda w: NOT regexp_matches(w, '^[\p{Lu}\p{Nd}]'))) = 0)""",
)
def d12(spark, sf):
    return R.missing_final_punctuation(paragraphs(spark, sf)).select("doc_id", "paragraph", "start", "end", "suggestion")


stage(
    "doubled",
    r"""SELECT doc_id, paragraph, lang, source, p_start::INT AS "start", "end", key AS word, rest, following, substr(text, p_start + 1, "end" - p_start) AS excerpt, text FROM (
  SELECT w.doc_id, w.paragraph, w.lang, w.source, w."start", w."end", lower(w.word) AS key, lag(lower(w.word)) OVER o AS p_key, lag(w."start") OVER o AS p_start, lag(w."end") OVER o AS p_end, p.text,
    substr(p.text, w."end" + 1, 1) AS rest, [lead(lower(w.word), 1) OVER o, lead(lower(w.word), 2) OVER o, lead(lower(w.word), 3) OVER o, lead(lower(w.word), 4) OVER o] AS following
  FROM words w JOIN paragraphs p USING (doc_id, paragraph) WINDOW o AS (PARTITION BY w.doc_id, w.paragraph ORDER BY w.n)) d
WHERE key = p_key AND regexp_full_match(substr(text, p_end + 1, "start" - p_end), '\s+')
  AND NOT (key IN ('a','o','as','os') AND p_start > 0 AND substr(text, p_start, 1) = '-') AND NOT (length(key) = 1 AND rest = '.')""",
)


@query("d14_doubled_words", 'SELECT doc_id, paragraph, "start", "end", excerpt, word FROM doubled')
def d14(spark, sf):
    return R.doubled_words(paragraphs(spark, sf).drop("lang", "source"))


@query(
    "d14_doubled_known_words",
    """SELECT doc_id, paragraph, "start", "end", word FROM doubled WHERE word IN (SELECT word FROM lexicon WHERE flags <> 0) AND (word <> 'se' OR NOT coalesce(
  following[1] IN (SELECT word FROM finite_words) OR (following[1] IN (SELECT word FROM before_verb) AND (following[2] IN (SELECT word FROM finite_words) OR (following[2] IN (SELECT word FROM before_verb)
   AND (following[3] IN (SELECT word FROM finite_words) OR (following[3] IN (SELECT word FROM before_verb) AND following[4] IN (SELECT word FROM finite_words)))))), false))""",
)
def d14b(spark, sf):
    known = R.doubled_words(paragraphs(spark, sf).drop("lang", "source"), lexicon(spark, sf))
    return known.select("doc_id", "paragraph", "start", "end", "word")


@query(
    "b13_lookup_flags",
    "SELECT w.word, coalesce(l.flags, 0)::INT AS flags, w.times FROM (SELECT word, count(*) AS times FROM words GROUP BY word) w LEFT JOIN lexicon l ON l.word = lower(w.word)",
)
def b13(spark, sf):
    counted = words(spark, sf).groupBy("word").agg(F.count("*").alias("times"))
    return R.lookup_flags(counted, lexicon(spark, sf)).select("word", "flags", "times")


@query(
    "a13_build_lexicon",
    """SELECT lower(word) AS word, bit_or(CASE WHEN length(word) % 3 = 0 THEN 32 ELSE 0 END | CASE right(lower(word), 1) WHEN 'e' THEN 1 | 4 WHEN 'd' THEN 1 | 2 WHEN 'r' THEN 16 WHEN 'n' THEN 1 | 8 WHEN 't' THEN 1 ELSE 0 END)::INT AS flags
FROM words GROUP BY ALL""",
)
def a13(spark, sf):
    seen = words(spark, sf).select("word").distinct()
    tag = F.when(F.char_length("word") % 3 == 0, "NOUN VERB").otherwise("VERB AUX")
    last = F.substring(F.lower("word"), -1, 1)
    feats = (
        F.when(last == "e", "VerbForm=Fin|Mood=Ind|Tense=Pres")
        .when(last == "d", "VerbForm=Fin|Mood=Ind|Tense=Imp")
        .when(last == "r", "VerbForm=Inf")
        .when(last == "n", "VerbForm=Fin|Mood=Ind|Tense=Fut")
        .when(last == "t", "VerbForm=Fin|Mood=Sub|Tense=Past")
    )
    lines = seen.select(F.concat_ws(",", "word", tag).alias("value"))
    verbs = seen.select("word", F.col("word").alias("lemma"), feats.alias("features")).where("features IS NOT NULL")
    return C.build_lexicon(lines, verbs)[0]


@query(
    "d15_speech_verbs",
    rf"""SELECT word, count(*) AS times FROM words WHERE lower(word) IN ({", ".join(f"'{w}'" for w in R.SPEECH_IRREGULAR)})
 OR regexp_full_match(lower(word), '(?:{"|".join(sorted({v[:-2] for v in R.SPEECH_VERBS if len(v) >= 5}))})(?:{R.VERB_ENDINGS}|{R.PLUPERFECT_ENDINGS})') GROUP BY word""",
)
def d15(spark, sf):
    return words(spark, sf).groupBy("word").agg(F.count("*").alias("times")).where(R.speech_verb(F.col("word")))


@query("d08_vocatives")
def d08(spark, sf):
    text = F.col("text")
    for old, new in ((". ", ". Não senhora. Carlos você sabe. Ana minha filha "),):
        text = F.replace(text, F.lit(old), F.lit(new))
    return R.vocatives(paragraphs(spark, sf).drop("lang", "source").withColumn("text", text), lexicon(spark, sf))


@query("d17_accent_candidates")
def d17(spark, sf):
    # Every known word in -i gains the endings of the imperfect, accented in the lexicon only.
    known = lexicon(spark, sf)
    stems = known.where(F.col("word").rlike("[aeou]$")).select(F.col("word").alias("stem"))
    accented = stems.select(F.concat("stem", F.lit("ía")).alias("word"), F.lit(3).alias("flags"))
    return R.accent_candidates(stems.select(F.concat("stem", F.lit("ia")).alias("word")), accented)


# ---- E: repetition and names ------------------------------------------------------------------
stage(
    "long_sentences",
    rf"""SELECT doc_id, paragraph, "start", "end", key, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, "start") AS ordinal FROM (
 SELECT doc_id, paragraph, "start", "end", array_to_string(regexp_extract_all(lower(sentence), '{WORD_SQL}'), ' ') AS key FROM sentences) s
WHERE len(string_split(key, ' ')) >= 6""",
)


def long_sentences(spark, sf) -> DataFrame:
    units = paragraphs(spark, sf).select(
        "doc_id", "paragraph", F.lit(0).alias("section"), F.lit("narracao").alias("role"), F.lit(0).alias("base"), "text"
    )
    return E.eligible_sentences(units)


@query(
    "e01_repeated_sentences",
    """SELECT doc_id, paragraph, "start", "end", earlier_paragraph, earlier_start FROM (
 SELECT a.doc_id, a.paragraph, a."start", a."end", b.paragraph AS earlier_paragraph, b."start" AS earlier_start, row_number() OVER (PARTITION BY a.doc_id, a.ordinal ORDER BY b.ordinal DESC) AS k
 FROM long_sentences a JOIN long_sentences b ON a.doc_id = b.doc_id AND a.key = b.key AND b.ordinal BETWEEN a.ordinal - 8 AND a.ordinal - 1) x WHERE k = 1""",
)
def e01(spark, sf):
    found = E.repeated_sentences(long_sentences(spark, sf))
    return found.select("doc_id", "paragraph", "start", "end", "earlier_paragraph", "earlier_start")


@query("e02_similar_sentences")
def e02(spark, sf):
    found = E.similar_sentences(long_sentences(spark, sf), 0.8)
    return found.select("doc_id", "paragraph", "start", "end", "earlier_paragraph", "earlier_start", F.round("ratio", 6).alias("ratio"))


_COMMON = ", ".join(f"'{w}'" for w in E.COMMON_WORDS)
stage(
    "names",
    rf"""SELECT doc_id, word, lower(word) AS low, count(*) AS times, min((paragraph, "start")) AS first_at FROM words
WHERE length(word) >= 4 AND regexp_matches(word, '^\p{{Lu}}') AND regexp_matches(word, '[\p{{Ll}}\p{{Lt}}]') AND lower(word) NOT IN ({_COMMON})
 AND NOT regexp_full_match(lower(word), 'h+[aeiou]*m*') AND len(list_distinct(list_filter(string_split(lower(word), ''), lambda c: c <> ''))) > 2
 AND len(list_filter(range(1, length(word) - 1), lambda i: substr(lower(word), i::INT, 1) = substr(lower(word), i::INT + 1, 1) AND substr(lower(word), i::INT, 1) = substr(lower(word), i::INT + 2, 1))) = 0
GROUP BY doc_id, word""",
)


@query(
    "e03_name_variants",
    """SELECT a.doc_id, a.word, b.word AS other, a.times, b.times AS other_times FROM names a JOIN names b ON a.doc_id = b.doc_id AND substr(a.low, 1, 1) = substr(b.low, 1, 1) AND a.word < b.word
WHERE greatest(a.times, b.times) >= 2 AND a.low <> b.low AND abs(length(a.low) - length(b.low)) <= 1
 AND len(list_filter(range(1, length(a.low) + 2), lambda i: (length(a.low) = length(b.low) AND substr(a.low, 1, i::INT - 1) = substr(b.low, 1, i::INT - 1) AND substr(a.low, i::INT + 1) = substr(b.low, i::INT + 1))
   OR (length(a.low) = length(b.low) + 1 AND substr(a.low, 1, i::INT - 1) || substr(a.low, i::INT + 1) = b.low)
   OR (length(b.low) = length(a.low) + 1 AND substr(b.low, 1, i::INT - 1) || substr(b.low, i::INT + 1) = a.low))) > 0""",
)
def e03(spark, sf):
    found = E.name_variants(E.name_occurrences(words(spark, sf)))
    return found.select("doc_id", "word", "other", "times", "other_times")


stage("term_rows", sql_matches("paragraphs", WORD_SQL + "(?:-" + WORD_SQL + ")*", "doc_id, paragraph", carry="text").replace('"match"', "word"))
stage(
    "placed_words",
    r"""SELECT doc_id, paragraph, n, "start", "end", word, right(regexp_replace(substr(text, 1, "start"), '\s+$', ''), 1) AS before FROM term_rows""",
)


@query(
    "e04_case_oscillation",
    r"""SELECT doc_id, lower(word) AS term, count(*) FILTER (WHERE regexp_matches(word, '^\p{Lu}')) AS capital_times, count(*) FILTER (WHERE NOT regexp_matches(word, '^\p{Lu}')) AS plain_times FROM placed_words
WHERE before <> '' AND NOT contains('.!?…:;—–"“”«»‘’(', before) AND NOT (regexp_matches(word, '\p{Lu}') AND NOT regexp_matches(word, '[\p{Ll}\p{Lt}]')) AND length(word) >= 3
GROUP BY ALL HAVING capital_times > 0 AND plain_times > 0""",
)
def e04(spark, sf):
    located = paragraphs(spark, sf).repartition("doc_id").withColumn("heading", F.lit(False))
    return E.case_oscillation(E.terms(located)).select("doc_id", "term", "capital_times", "plain_times")


stage("before_words", sql_matches("paragraphs", WORD_SQL, "doc_id, paragraph", carry="text").replace('"match"', "word"))


@query(
    "e05_proper_names",
    r"""WITH w AS (SELECT doc_id, word, right(regexp_replace(substr(text, 1, "start"), '\s+$', ''), 1) AS before FROM before_words),
c AS (SELECT doc_id, lower(word) AS name, count(*) FILTER (WHERE cap) AS capitals, count(*) FILTER (WHERE cap AND before <> '' AND NOT contains('.!?…"“”«»—–:', before)) AS middles, count(*) FILTER (WHERE NOT regexp_matches(word, '^\p{Lu}')) AS lowers
  FROM (SELECT *, regexp_matches(word, '^\p{Lu}') AND NOT (length(word) > 1 AND NOT regexp_matches(word, '[\p{Ll}\p{Lt}]')) AS cap FROM w) x GROUP BY ALL),
credits AS (SELECT doc_id, lower(part) AS name FROM (SELECT doc_id, unnest(parts) AS part FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS parts FROM paragraphs) p
  WHERE regexp_full_match(trim(text), '[\p{L}\p{Nl}\p{No}]+(?:\s+[\p{L}\p{Nl}\p{No}]+){0,3}') AND len(list_filter(parts, lambda w: NOT (w IN ('de','da','do','dos','das','e') OR regexp_matches(w, '^\p{Lu}')))) = 0) q WHERE part NOT IN ('de','da','do','dos','das','e')),
base AS (SELECT doc_id, name FROM c WHERE middles > 0 OR (capitals >= 2 AND lowers = 0) UNION SELECT doc_id, name FROM credits)
SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest([name, name || 's', name || 'es', CASE WHEN ends_with(name, 'es') THEN substr(name, 1, length(name) - 2) END, CASE WHEN ends_with(name, 's') THEN substr(name, 1, length(name) - 1) END]) AS name FROM base) v WHERE name IS NOT NULL""",
)
def e05(spark, sf):
    located = paragraphs(spark, sf).repartition("doc_id").withColumn("heading", F.lit(False))
    return E.proper_names(located)[0]


@query(
    "e06_recurring_unknown",
    "SELECT doc_id, lower(word) AS word, count(*) AS times FROM words WHERE lower(word) NOT IN (SELECT word FROM lexicon) GROUP BY ALL HAVING count(*) >= 3",
)
def e06(spark, sf):
    return E.recurring_unknown(words(spark, sf), lexicon(spark, sf))


# External checker rows: doubled words and every long lower-case word.
stage(
    "checker_rows",
    r"""SELECT doc_id, paragraph, "start", "end", 'PORTUGUESE_WORD_REPEAT_RULE' AS rule_id, 'duplication' AS issue_type, 'MISC' AS category_id, [word] AS replacements FROM doubled
UNION ALL SELECT doc_id, paragraph, "start", "end", 'MORFOLOGIK_RULE_PT', 'misspelling', 'TYPOS', [reverse(word)] || CASE WHEN length(word) % 2 = 0 THEN [substr(word, 1, length(word) - 1)] ELSE [] END FROM words
 WHERE length(word) >= 12 AND regexp_full_match(word, '\p{Ll}+')""",
)


def checker_matches(spark, sf) -> DataFrame:
    lines = paragraphs(spark, sf).drop("lang", "source")
    doubled = R.doubled_words(lines).select(
        "doc_id", "paragraph", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"),
        F.lit("PORTUGUESE_WORD_REPEAT_RULE").alias("rule_id"), F.lit("duplication").alias("issue_type"), F.lit("MISC").alias("category_id"),
        F.array("word").alias("replacements"), F.lit("").alias("message"),
    )
    long_words = words_in_place(spark, sf).where((F.char_length("word") >= 12) & F.col("word").rlike(r"^\p{Ll}+$"))
    offers = F.when(F.char_length("word") % 2 == 0, F.array(F.reverse("word"), F.substring("word", F.lit(1), F.char_length("word") - 1))).otherwise(F.array(F.reverse("word")))
    spelling = long_words.select(
        "doc_id", "paragraph", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"),
        F.lit("MORFOLOGIK_RULE_PT").alias("rule_id"), F.lit("misspelling").alias("issue_type"), F.lit("TYPOS").alias("category_id"),
        offers.alias("replacements"), F.lit("").alias("message"),
    )
    return doubled.unionByName(spelling)


def checker_findings(spark, sf) -> DataFrame:
    located = paragraphs(spark, sf).repartition("doc_id").withColumn("heading", F.lit(False))
    spelling, comma = E.proper_names(located)
    known = lexicon(spark, sf)
    return E.filter_checker_matches(
        checker_matches(spark, sf), paragraphs(spark, sf), spelling, comma, E.recurring_unknown(words(spark, sf), known), known
    )


@query("e07_checker_matches")
def e07(spark, sf):
    return checker_findings(spark, sf).select("doc_id", "paragraph", "start", "end", "rule_id", "suggestion", "confidence")


@query("e08_edit_scars")
def e08(spark, sf):
    """Each document against itself without the lines that mention a sentence of pure junk."""
    lines = paragraphs(spark, sf).withColumn("heading", F.lit(False)).withColumn("chapter", F.lit("1"))
    revised = lines.withColumn("text", F.regexp_replace("text", r"(?<=\. )[^.!?…]{60,}[.!?…]+ ", "Isso foi assim. "))
    return E.edit_scars(lines, revised).select("doc_id", "paragraph", "start", "end", "word", "removed")

