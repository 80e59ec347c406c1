"""Surface pattern rules: a catalogue kept as data and one pass that applies it.

A cheap literal test decides which rules touch a text; offsets are computed for
those pairs only.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import WORD, let, match_spans
from ..functions.text import cased_like, excerpt, is_list_or_label, lexicon_key, starts_upper
from .segments import NARRATION, SPEECH, THOUGHT

# ---- fixed values -----------------------------------------------------------------------------
FINITE, PAST, PRESENT, FUTURE, NONFINITE, NONVERB = 1, 2, 4, 8, 16, 32
ALL_SCOPES = (NARRATION, SPEECH, THOUGHT)
INTERJECTIONS = "ah|oh|ó|ai|ui|eh|ei|olá|ufa|puxa|nossa|hein|ora|oba|opa|psiu|credo|oxalá|céus"
NUMBERS = (
    r"uma|um|duas|dois|três|quatro|cinco|seis|sete|oito|nove|dez|onze|doze|treze|catorze|quatorze|quinze|dezesseis|"
    r"dezessete|dezoito|dezenove|vinte|trinta|quarenta|cinquenta|sessenta|setenta|oitenta|noventa|cem|\d{1,4}"
)
OPEN_ENDINGS = "de|em|com|sem|do|da|dos|das|no|na|nos|nas|pelo|pela|pelos|pelas|ao|aos|num|numa|duma|dum"
# What every open ending looks like, so that few places are compared with the list: its initials, then a short word before a closing sign.
_OPEN_AHEAD = r"(?=(?-iu:[acdenpsACDENPS\u017f]))\b(?=\w{2,5}+\s*+[!?.])"
ENCLITIC_HOMOGRAPHS = ("a", "o", "as", "os")
BEFORE_VERB = ("me", "te", "lhe", "lhes", "nos", "vos", "o", "a", "os", "as", "não", "nunca", "já")
NAME = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ\u0300-\u036f]+"
# Up to and with the signs that end a sentence.
VOCATIVE_STRETCH = r"[^.!?…]*[.!?…]+|[^.!?…]+"
INTRODUCERS = (
    "mas e ou nem porém pois contudo todavia aliás senão hoje amanhã ontem agora atualmente talvez assim então aqui ali "
    "lá depois antes sempre nunca ainda quando enquanto como onde aonde donde porque entretanto portanto logo caso se "
    "embora somente apenas até sim não bem ora ei olá oi quem qual quais quanto quanta quantos quantas que"
).split()
IMPERATIVES = (
    "faça|façam|diga|digam|vá|vão|venha|venham|toque|toquem|entre|entrem|saia|saiam|olhe|olhem"
)
# Speech-verb profiles: irregular forms, verbs recognised by stem and ending.
SPEECH_VERBS = (
    "dizer informar perguntar responder murmurar gritar sussurrar comentar retrucar afirmar falar exclamar replicar "
    "declarar indagar confessar explicar acrescentar argumentar insistir ordenar pedir protestar avisar pensar refletir "
    "ponderar admitir lembrar concluir continuar completar interromper balbuciar resmungar cochichar implorar vociferar "
    "anunciar observar sugerir repetir garantir negar confirmar questionar reclamar ironizar brincar saudar chamar ler "
    "recitar citar ditar cantar declamar terminar"
).split()
COMPLETIVE_VERBS = (
    "prometer jurar avisar contar achar saber acreditar garantir sentir perceber imaginar esperar temer lembrar "
    "esquecer decidir admitir"
).split()
REPORT_VERBS = (
    "dizer explicar contar afirmar saber aprender ensinar descobrir lembrar perceber entender ler ouvir achar pensar "
    "acreditar notar garantir"
).split()
ANNOUNCING_VERBS = "contar narrar relatar explicar falar dizer começar descrever mostrar resumir apresentar".split()
ATTESTING_VERBS = "confirmar afirmar garantir dizer atestar".split()
SPEECH_IRREGULAR = (
    "disse disseram diz dizem dizia diziam dirá pediu pediram pede pedia dissera disseras disséramos dissereis"
).split()
VERB_ENDINGS = (
    "o|a|as|amos|ais|am|ei|aste|ou|astes|aram|ava|avas|ávamos|avam|e|es|emos|em|i|este|eu|estes|eram|ia|ias|íamos|iam|"
    "iu|imos|iram|ará|arão|erá|erão|irá|irão|ando|endo|indo"
)
PLUPERFECT_ENDINGS = (
    "ara|aras|áramos|áreis|era|eras|êramos|éramos|êreis|éreis|ira|iras|íramos|íreis"
)
# -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """One row of the catalogue.

    ``unit`` is the text a pattern sees: one role span, or the paragraph with the
    role taken at the match.  ``mode`` says how the suggestion is written.
    ``not_before`` / ``not_after`` cancel a match by the text around it.
    """

    rule: str
    pattern: str
    category: str
    severity: str
    score: float
    replacement: str | None = None
    mode: str = "fixed"
    scopes: tuple[str, ...] = (NARRATION,)
    unit: str = "span"
    not_before: str | None = None
    not_after: str | None = None

    @property
    def confidence(self) -> str:
        return "alta" if self.score >= 0.9 else "média" if self.score >= 0.6 else "baixa"


_LEFT_OF_SOMETIMES = "todas|poucas|muitas|várias|algumas|das|nas|pelas|quantas|raras|duas|três|tantas|mesmas|outras|demais"
_LEFT_OF_HOURS = "todas|durante|por|das|nas|pelas|as|entre"
_HOUR_TAIL = r"(?:\s+horas?)?(?:\s+e\s+\w+)?(?=\s+(?:horas?\s+)?(?:da manhã|da tarde|da noite|da madrugada|em ponto)\b)"
_TAG_QUESTION = r"(?iuU)^[^.!?…]*,\s*(?:hein|né|viu|sabe|entende|entendeu|certo|ok|tá|não é|não)\s*\?"
_AFTER_MORE = "não|nunca|ninguém|nada|ele|ela|eles|elas|eu|nós|você|vocês|isso|aquilo|logo|então|também|agora|quando|sem"


def _left_word(words: str) -> str:
    return rf"(?iuU)(?:^|\s)\W*(?:{words})\W*\s*$"


SURFACE_RULES: tuple[Rule, ...] = (
    Rule("capitalizacao_contextual", r"(?U)(?<=[?!])[ \t]+(?:eu|tu|ele|ela|nós|vós|eles|elas|você|vocês)\b",
         "Inicial após pergunta ou exclamação", "probable_error", 0.85, mode="capital_word", scopes=ALL_SCOPES,
         not_before=rf"(?iuU)(?:^|[.!?…:;—–\"“«]\s*)(?:{INTERJECTIONS})[!?]$"),
    Rule("construcao_invalida", r"(?iuU)\balém[ \t]+de[ \t]+disso\b", "Construção inválida", "confirmed_error", 0.99,
         "além disso", "cased"),
    Rule("pontuacao_duplicada", r",{2,}|;{2,}", "Pontuação duplicada", "confirmed_error", 0.98, mode="first_sign", scopes=ALL_SCOPES),
    Rule("pontuacao_duplicada", r"(?<!\.)\.{2}(?!\.)", "Dois pontos finais", "probable_error", 0.9, mode="none", scopes=ALL_SCOPES),
    Rule("que_tonico_interrogativo", r"(?iuU)\bque(?=[ \t]*[?!])", "Acento em ‘quê’ interrogativo", "probable_error", 0.95,
         "quê", "cased", ALL_SCOPES),
    Rule("espacamento", r"(?U)(?<=\w) {2,}(?=\w)", "Espaço repetido", "probable_error", 0.9, " ", scopes=ALL_SCOPES),
    Rule("espacamento", r"(?U)(?<=\w) +(?=[,;])", "Espaço antes de pontuação", "probable_error", 0.9, "", scopes=ALL_SCOPES),
    Rule("virgula_que_nao", r"(?iuU)\bque,[ \t]+não\b", "Vírgula após ‘que’", "probable_error", 0.85, mode="drop_comma",
         not_before=r"(?iuU)\b(?:pelo|de\s+(?:modo|maneira|forma|sorte))\s+$",
         not_after=r"(?iuU)^\s*(?:obstante\b|só\b|apenas\b|,)"),
)

GRAMMAR_RULES: tuple[Rule, ...] = (
    *(
        Rule("crase", rf"(?iuU)\b{wrong}\b", "Crase em locução", "probable_error", 0.9, right, "initial", ALL_SCOPES, "paragraph")
        for wrong, right in (
            ("as pressas", "às pressas"), ("as escondidas", "às escondidas"), ("as avessas", "às avessas"),
            ("a toa", "à toa"), ("a beça", "à beça"),
        )
    ),
    Rule("crase", r"(?iuU)\bas vezes\b(?!\s+(?:que|em)\b)", "Crase em locução", "probable_error", 0.85, "às vezes", "initial",
         ALL_SCOPES, "paragraph", not_before=_left_word(_LEFT_OF_SOMETIMES)),
    Rule("crase", rf"(?iuU)\bas(?=\s+(?:{NUMBERS}){_HOUR_TAIL})", "Crase antes de horas", "probable_error", 0.9, "às", "initial",
         ALL_SCOPES, "paragraph", not_before=_left_word(_LEFT_OF_HOURS)),
    Rule("crase", rf"(?iuU)\ba(?=\s+uma{_HOUR_TAIL})", "Crase antes de horas", "probable_error", 0.9, "à", "initial",
         ALL_SCOPES, "paragraph", not_before=_left_word(_LEFT_OF_HOURS)),
    Rule("homofonos", r"(?U)Porque\b(?=[^.!?…]*\?)", "Por que / porque", "probable_error", 0.9,
         "Por que", "fixed", ALL_SCOPES, "paragraph", not_before=r"(?U)(?:[^\s—–.!?…]\s*|[.!?…])\z", not_after=_TAG_QUESTION),
    Rule("homofonos", r"(?iuU)\bporque(?=\s*\?)", "Por que / porque", "probable_error", 0.85, "por quê", "initial", ALL_SCOPES, "paragraph"),
    Rule("homofonos", rf"(?iuU)(?<=\s)mais(?=\s+(?:{_AFTER_MORE})\b)", "Mas / mais", "probable_error", 0.85, "mas",
         "initial", ALL_SCOPES, "paragraph", not_before=r"(?U)(?:^|[^,\s])\s*\z"),
    Rule("homofonos", r"(?iuU)\bmau[- ](?!olhado\b)\w+?(?:ad|id)[oa]s?\b", "Mal / mau", "probable_error", 0.9, "mal", "head",
         ALL_SCOPES, "paragraph"),
    Rule("homofonos", r"(?iuU)\bde baixo(?=\s+d[aoe]s?\b)", "Grafia de locução", "probable_error", 0.9, "debaixo", "initial",
         ALL_SCOPES, "paragraph"),
    Rule("homofonos", r"(?iuU)\bem baixo(?=\s+d[aoe]s?\b|\s*(?:[.,;:!?…—–]|$))", "Grafia de locução", "probable_error", 0.9,
         "embaixo", "initial", ALL_SCOPES, "paragraph"),
    Rule("homofonos", r"(?iuU)\bencima(?=\s+d[aoe]s?\b)", "Grafia de locução", "probable_error", 0.9, "em cima", "initial",
         ALL_SCOPES, "paragraph"),
    Rule("frase_cortada", rf"(?iuU){_OPEN_AHEAD}(?:{OPEN_ENDINGS})\b(?=\s*(?:[!?]|\.(?!\.)))", "Frase cortada", "probable_error", 0.75,
         mode="none", scopes=ALL_SCOPES, unit="paragraph"),
    Rule("locucoes", r"(?iuU)\bao\s+invés(?=\s+d)", "Locução", "editorial_attention", 0.6, "em vez", "initial", (NARRATION,), "paragraph"),
)

# Language-neutral row: the same symbol typed twice or more.
DOUBLED_SYMBOL = Rule("simbolo_dobrado", r"([!%#*&$|])\1+", "Símbolo dobrado", "probable_error", 0.9, mode="first_sign",
                      scopes=ALL_SCOPES)


def _literal(rule: Rule, order: int) -> Column:
    return F.struct(
        F.lit(order).alias("rule_order"),
        F.lit(rule.rule).alias("rule"),
        F.lit(rule.pattern).alias("pattern"),
        F.lit(rule.category).alias("category"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.score).alias("score"),
        F.lit(rule.confidence).alias("confidence"),
        F.lit(rule.replacement).cast("string").alias("replacement"),
        F.lit(rule.mode).alias("mode"),
        F.lit(rule.not_before).cast("string").alias("not_before"),
        F.lit(rule.not_after).cast("string").alias("not_after"),
    )


def _suggest(hit: Column, rule: Column) -> Column:
    mode, replacement = rule["mode"], rule["replacement"]
    rest = F.substring(hit, F.lit(4), F.char_length(hit))
    initial = F.when(starts_upper(hit), F.initcap(F.substring(replacement, 1, 1))).otherwise(F.substring(replacement, 1, 1))
    with_initial = F.concat(initial, F.substring(replacement, F.lit(2), F.char_length(replacement)))
    word = F.regexp_extract(hit, WORD, 0)
    return (
        F.when(mode == "fixed", replacement)
        .when(mode == "cased", cased_like(hit, replacement))
        .when(mode == "initial", with_initial)
        .when(mode == "head", F.concat(with_initial, rest))
        .when(mode == "first_sign", F.substring(hit, 1, 1))
        .when(mode == "drop_comma", F.regexp_replace(hit, ",", ""))
        .when(mode == "capital_word", F.concat(F.substring(hit, F.lit(1), F.char_length(hit) - F.char_length(word)), F.initcap(word)))
    )


def apply_rules(classified: DataFrame, rules: Sequence[Rule] = SURFACE_RULES, enabled: Sequence[str] | None = None) -> DataFrame:
    """Findings of every enabled rule, in paragraph coordinates.

    ``classified`` carries ``text`` and ``roles``.  In speech and thought a
    confirmed error is only probable.
    """
    active = [r for r in rules if enabled is None or r.rule in enabled]
    keep = [c for c in classified.columns if c not in ("roles", "italic")]
    if not active:
        return apply_rules(classified, rules[:1]).where(F.lit(False))
    span_units = F.transform(
        F.filter("roles", lambda s: s["role"].isin(*ALL_SCOPES)),
        lambda s: F.struct(
            F.lit("span").alias("unit"),
            s["start"].alias("base"),
            s["role"].alias("role"),
            excerpt(F.col("text"), s["start"], s["end"]).alias("body"),
        ),
    )
    whole = F.array(F.struct(F.lit("paragraph").alias("unit"), F.lit(0).alias("base"), F.lit(NARRATION).alias("role"), F.col("text").alias("body")))
    kinds = {r.unit for r in active}
    units = F.concat(*([span_units] if "span" in kinds else []), *([whole] if "paragraph" in kinds else []))
    body, unit, role = F.col("_u.body"), F.col("_u.unit"), F.col("_u.role")
    # Alphabetic content is required outside narration.
    usable = (unit == "paragraph") | (role == NARRATION) | body.rlike(r"\p{L}")

    def touches(rule: Rule) -> Column:
        # The text is searched last, only where the rule applies.
        due = unit == rule.unit
        return (due & role.isin(*rule.scopes) if rule.unit == "span" else due) & body.rlike(rule.pattern)

    touched = F.array_compact(F.array(*[F.when(touches(r), F.lit(i)) for i, r in enumerate(active)]))
    catalogue = F.array(*[_literal(r, i) for i, r in enumerate(active)])
    scopes = F.array(*[F.array(*[F.lit(s) for s in r.scopes]) for r in active])
    hits = (
        classified.where(~F.exists("roles", lambda s: s["role"] == "titulo"))
        .select(*keep, "roles", F.explode(units).alias("_u"))
        .where(usable)
        .select(*keep, "roles", "_u", F.explode(touched).alias("_i"))
        .withColumn("_r", F.element_at(catalogue, F.col("_i") + 1))
        .withColumn("_scopes", F.element_at(scopes, F.col("_i") + 1))
        .select(*keep, "roles", "_u", "_r", "_scopes", F.explode(match_spans(F.col("_u.body"), F.col("_r.pattern"))).alias("_m"))
        .withColumn("start", (F.col("_u.base") + F.col("_m.start")).cast("int"))
        .withColumn("end", (F.col("_u.base") + F.col("_m.end")).cast("int"))
        .withColumn(
            "role",
            F.when(unit == "span", role).otherwise(
                F.try_element_at(F.filter("roles", lambda s: (s["start"] <= F.col("start")) & (s["end"] > F.col("start"))), F.lit(1))["role"]
            ),
        )
        .where(F.array_contains("_scopes", F.col("role")))
        # The text around a match is read only for the rules that ask for it.
        .where(F.col("_r.not_before").isNull() | ~F.regexp_like(F.substring(body, F.lit(1), F.col("_m.start")), F.col("_r.not_before")))
        .where(F.col("_r.not_after").isNull() | ~F.regexp_like(F.substring(body, F.col("_m.end") + 1, F.char_length(body)), F.col("_r.not_after")))
    )
    severity = F.when(F.col("role") != NARRATION, F.lit("probable_error")).otherwise(F.col("_r.severity"))
    return hits.select(
        *keep,
        "start",
        "end",
        "role",
        F.col("_m.text").alias("excerpt"),
        F.col("_r.rule_order").alias("rule_order"),
        F.col("_r.rule").alias("rule"),
        F.col("_r.category").alias("category"),
        severity.alias("severity"),
        F.col("_r.confidence").alias("confidence"),
        F.col("_r.score").alias("confidence_score"),
        _suggest(F.col("_m.text"), F.col("_r")).alias("suggestion"),
        F.when(severity == "confirmed_error", "required").otherwise("possible").alias("suggestion_kind"),
    )


def missing_final_punctuation(paras: DataFrame) -> DataFrame:
    """Paragraphs of four words or more that end in a letter or digit and are not labels."""
    text = F.regexp_replace("text", r"(?U)\s+$", "")
    last = F.regexp_extract(text, WORD + "$", 0)
    ok = (
        (F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))) >= 4)
        & text.rlike(r"[\p{L}\p{N}]$")
        & ~is_list_or_label(text)
        & (last != "")
    )
    size = F.char_length(text)
    # One look at the last sign leaves few paragraphs to read; ``when`` keeps the rest from being computed ahead.
    open_end = F.substring("text", -1, 1).rlike(r"(?U)[\p{L}\p{N}\s]")
    return paras.where(F.when(open_end, ok).otherwise(False)).select(
        *paras.columns,
        (size - F.char_length(last)).alias("start"),
        size.alias("end"),
        last.alias("excerpt"),
        F.lit("frase_cortada").alias("rule"),
        F.lit("Pontuação final ausente").alias("category"),
        F.lit("probable_error").alias("severity"),
        F.lit("média").alias("confidence"),
        F.lit(0.8).alias("confidence_score"),
        F.concat(last, F.lit(".")).alias("suggestion"),
    )


# A whole word followed, after white space only, by the same word.
# The possessive quantifier spares the engine every shorter reading of each word.
DOUBLED_WORD = rf"(?iu)(?<![\p{{L}}\p{{Nl}}\p{{No}}])({WORD}+)(?=[\s\u00a0\u2000-\u200a\u202f\u3000]++\1(?![\p{{L}}\p{{Nl}}\p{{No}}]))"


def doubled_words(units: DataFrame, lexicon: DataFrame | None = None, boundary: str = "span") -> DataFrame:
    """The same word twice in a row.

    ``units`` has ``text`` (a role span) and optionally ``base``, its position in
    the paragraph.  With a lexicon only known words count, and a reflexive pair
    before a verb is accepted.  Candidates are found row by row; only they meet
    the lexicon.
    """
    keep = [c for c in units.columns if c not in ("text",)]
    body = F.col("text")
    base = F.col("base") if "base" in units.columns else F.lit(0)
    # What follows a match up to the next one: the white space, then the second word unless it opens a pair itself.
    gap = F.regexp_extract("_m.then", r"(?U)^\s+", 0)
    found = (
        units.select(*keep, "text", F.explode(match_spans(body, DOUBLED_WORD, following=True)).alias("_m"))
        .withColumn("_gap", gap)
        .withColumn("_stop", F.col("_m.end") + F.char_length("_gap") + F.char_length("_m.text"))
        .withColumn("word", F.lower("_m.text"))
        .withColumn("_next", F.substring(F.col("_m.then"), F.char_length("_gap") + F.char_length("_m.text") + 1, F.lit(1)))
    )
    if boundary == "sentence":
        found = found.where(~F.contains("_gap", F.lit("\n")))
    enclitic = F.col("word").isin(*ENCLITIC_HOMOGRAPHS) & (F.col("_m.start") > 0) & (F.substring(body, F.col("_m.start"), F.lit(1)) == "-")
    abbreviation = (F.char_length("word") == 1) & (F.col("_next") == ".")
    kept = found.where(~enclitic & ~abbreviation)
    rest = F.substring(body, F.col("_stop") + 1, F.char_length(body))
    result = kept.select(
        *keep,
        (base + F.col("_m.start")).cast("int").alias("start"),
        (base + F.col("_stop")).cast("int").alias("end"),
        F.concat("_m.text", "_gap", F.substring(body, F.col("_m.end") + F.char_length("_gap") + 1, F.char_length("_m.text"))).alias("excerpt"),
        "word",
        # "se se": only these rows look further.
        F.when(F.col("word") == "se", rest).alias("_rest"),
    )
    if lexicon is None:
        return result.drop("_rest")
    known = lexicon.where("flags <> 0").select("word", F.col("flags").alias("_flags"))
    result = result.withColumn("_key", lexicon_key(F.col("word"))).join(known.withColumnRenamed("word", "_key"), "_key", "left_semi").drop("_key")
    # "se se": the following words decide, so only those rows look further.
    pair = result.where(F.col("word") == "se")
    others = result.where(F.col("word") != "se").drop("_rest")
    ahead = F.slice(F.regexp_extract_all(F.lower("_rest"), F.lit(WORD), F.lit(0)), 1, 4)
    keys = [*keep, "start", "end"]
    looked = (
        pair.select(*keys, F.posexplode_outer(ahead).alias("_at", "_key"))
        .withColumn("_key", lexicon_key(F.col("_key")))
        .join(known.withColumnRenamed("word", "_key"), "_key", "left")
        .withColumn("_verb", F.col("_flags").bitwiseAND(FINITE) != 0)
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col("_verb"), F.col("_at"))).alias("_first_verb"),
            F.min(F.when(~F.coalesce("_verb", F.lit(False)) & ~F.col("_key").isin(*BEFORE_VERB), F.col("_at"))).alias("_first_stop"),
        )
        .where(F.col("_first_verb").isNull() | (F.col("_first_verb") > F.coalesce("_first_stop", F.lit(99))))
        .select(*keys)
    )
    return others.unionByName(pair.drop("_rest").join(looked, keys, "left_semi"))


def lookup_flags(words: DataFrame, lexicon: DataFrame, column: str = "word") -> DataFrame:
    """Adds ``flags`` (0 when unknown).  The join strategy is left to the optimiser's size estimate."""
    keyed = words.withColumn("_key", lexicon_key(F.col(column)))
    entries = lexicon.select(F.col("word").alias("_key"), F.col("flags").alias("flags"))
    return keyed.join(entries, "_key", "left").drop("_key").withColumn("flags", F.coalesce("flags", F.lit(0)))


def vocatives(units: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Calls without a comma: name + pronoun or prohibition, answer or greeting + address,
    name + affectionate apposition + imperative."""
    body = F.col("text")
    keep = [c for c in units.columns if c != "text"]
    base = F.col("base") if "base" in units.columns else F.lit(0)
    called = rf"(?U){NAME}(?:[ \t]+{NAME}){{0,2}}(?=[ \t]+(?:vocês?\b|tu\b|não[ \t]+(?:{IMPERATIVES})\b))"
    answered = (
        r"(?U)(?:Sim|Não|Obrigad[oa]|Olá|Oi|Bom dia|Boa tarde|Boa noite|Adeus|Tchau)[ \t]+"
        r"(?:senhor(?:a|es|as)?|moç[oa]|mãe|pai|vovó|vovô|doutor(?:a)?|professor(?:a)?|chefe|mestre|madame|querid[oa]|amor|"
        rf"filh[oa]|(?:dona|seu)[ \t]+{NAME}|{NAME})(?=[ \t]*(?:[.!?…,—–]|$))"
    )
    apposed = (
        rf"(?U){NAME}[ \t]+(?:(?:meu|minha|meus|minhas)[ \t]+[a-zà-öø-ÿ]+|querid[oa]s?|amad[oa]s?)"
        r"(?=[ \t]+[a-zà-öø-ÿ]+\b)"
    )
    # The text before that rules a shape out: each has to open its sentence, after any amount of space.
    inside = (
        F.when(F.col("shape") == "apposition", F.lit(r"^[ \t]+\z|[^ \t.!?…][ \t]*\z|[.!?…]\z"))
        .when(F.col("shape") == "call", F.lit(r"[^ \t.!?][ \t]*\z|[.!?]\z"))
        .otherwise(F.lit(r"(?U)[^\s—–.!?…]\s*\z"))
    )
    shapes = F.array(
        *[
            F.struct(F.lit(name).alias("shape"), match_spans(F.col("_t.text"), pattern).alias("hits"))
            for name, pattern in (("apposition", apposed), ("call", called), ("answer", answered))
        ]
    )
    # No shape reaches over the end of a sentence, so each sentence is searched by itself; of the one before, its last sign counts.
    stretches = let(
        match_spans(body, VOCATIVE_STRETCH),
        lambda spans: F.transform(
            spans,
            lambda m, i: F.struct(m["start"].alias("start"), m["text"].alias("text"), F.when(i > 0, F.substring(F.get(spans, i - 1)["text"], -1, 1)).otherwise("").alias("sign")),
        ),
    )
    # From the last sign of the match before on: what lies before that decides nothing.
    led = lambda hits: F.transform(
        hits,
        lambda m, i: F.struct(
            m.alias("m"),
            let(
                F.when(i > 0, F.get(hits, i - 1)["end"] - 1).otherwise(0),
                lambda since: F.concat(F.when(since > 0, "").otherwise(F.col("_t.sign")), F.substring(F.col("_t.text"), since + 1, m["start"] - since)),
            ).alias("led"),
        ),
    )
    rest = F.substring(F.col("_t.text"), F.col("_m.end") + 1, F.char_length("_t.text"))
    # What moves to the lexicon is short: no text goes along.
    found = (
        units.select(*keep, F.explode(stretches).alias("_t"))
        .select(*keep, "_t", F.explode(shapes).alias("_s"))
        .select(*keep, "_t", F.col("_s.shape").alias("shape"), F.explode(led(F.col("_s.hits"))).alias("_l"))
        .where(~F.regexp_like("_l.led", inside))
        .select(*keep, "_t", "shape", F.col("_l.m").alias("_m"))
        .withColumn("_first", F.lower(F.regexp_extract("_m.text", r"^\S+", 0)))
        .where((F.col("shape") != "call") | ~F.col("_first").isin(*INTRODUCERS))
        .select(
            *keep,
            "shape",
            "_first",
            F.col("_m.text").alias("_hit"),
            (base + F.col("_t.start") + F.col("_m.start")).cast("int").alias("start"),
            (base + F.col("_t.start") + F.col("_m.end")).cast("int").alias("end"),
            F.lower(F.regexp_extract(rest, r"^[ \t]+([a-zà-öø-ÿ]+)", 1)).alias("_verb"),
            (F.regexp_extract("_t.text", r"[.!?…]", 0) == "?").alias("_asks"),
        )
    )
    flags = lexicon.select("word", "flags")
    both = (
        found.join(flags.select(F.col("word").alias("_first"), F.col("flags").alias("_ff")), "_first", "left")
        .join(flags.select(F.col("word").alias("_verb"), F.col("flags").alias("_vf")), "_verb", "left")
        .withColumn("_ff", F.coalesce("_ff", F.lit(0)))
        .withColumn("_vf", F.coalesce("_vf", F.lit(0)))
    )
    name_verb = F.col("_ff").bitwiseAND(FINITE) != 0
    name_noun = F.col("_ff").bitwiseAND(NONVERB) != 0
    request = (F.col("_vf").bitwiseAND(FINITE) != 0) & (F.col("_vf").bitwiseAND(NONVERB | PAST | FUTURE) == 0)
    ok = (
        F.when(F.col("shape") == "apposition", request & ~name_verb)
        .when(F.col("shape") == "call", ~(name_verb & ~name_noun) & ~(name_verb & F.col("_asks")))
        .otherwise(F.lit(True))
    )
    hit = F.col("_hit")
    suggestion = (
        F.when(F.col("shape") == "apposition", F.concat(F.regexp_replace(hit, rf"^({NAME})[ \t]+", "$1, "), F.lit(",")))
        .when(F.col("shape") == "call", F.concat(hit, F.lit(",")))
        .otherwise(F.regexp_replace(hit, r"^(Bom dia|Boa tarde|Boa noite|\S+)[ \t]+", "$1, "))
    )
    return both.where(ok).select(
        *keep,
        "start",
        "end",
        hit.alias("excerpt"),
        "shape",
        F.lit("vocativo").alias("rule"),
        F.lit("Possível vocativo sem vírgula").alias("category"),
        F.lit("probable_error").alias("severity"),
        F.lit("média").alias("confidence"),
        F.lit(0.85).alias("confidence_score"),
        suggestion.alias("suggestion"),
    )


def verb_by_stem(word: Column, verbs: Sequence[str]) -> Column:
    """The form is one of the verbs: stem of three letters or more and a verbal ending."""
    stems = "|".join(sorted({v[:-2] for v in verbs if len(v) >= 5}))
    return F.lower(word).rlike(rf"(?U)^(?:{stems})(?:{VERB_ENDINGS}|{PLUPERFECT_ENDINGS})(?:-\w+)?$")


def speech_verb(word: Column) -> Column:
    """A verb that opens the narrator's aside after speech, by its written form."""
    form = F.lower(word)
    bare = lexicon_key(word)
    return form.isin(*SPEECH_IRREGULAR) | bare.isin(*SPEECH_IRREGULAR) | verb_by_stem(word, SPEECH_VERBS)


def takes_completive(word: Column) -> Column:
    return speech_verb(word) | verb_by_stem(word, COMPLETIVE_VERBS)


def accent_candidates(words: DataFrame, lexicon: DataFrame, column: str = "word") -> DataFrame:
    """Words in -ia… whose only accented reading known to the lexicon is a past form.

    One row per word with exactly one proposal.
    """
    w = F.lower(column)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(w), F.lit(1))), lambda i: F.substring(w, i, F.lit(1)) == "i")
    proposals = F.transform(at, lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.lit("í"), F.substring(w, i + 1, F.char_length(w))))
    shaped = words.select(column).distinct().where(w.rlike(r"i(?:a|as|am|amos|eis)$"))
    past = (F.col("flags").bitwiseAND(PAST) != 0) & (F.col("flags").bitwiseAND(PRESENT | FUTURE) == 0)
    accepted = lexicon.where(past).select(F.col("word").alias("_p"))
    return (
        shaped.select(column, F.explode(proposals).alias("_p"))
        .join(accepted, "_p", "left_semi")
        .groupBy(column)
        .agg(F.min("_p").alias("_p"), F.count("*").alias("_n"))
        .where("_n = 1")
        .select(column, cased_like(F.col(column), F.col("_p")).alias("proposal"))
    )


