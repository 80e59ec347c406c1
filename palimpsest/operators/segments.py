"""Speech, thought and narration as spans; never one row per character.

A quotation left open at the end of a paragraph continues in the next one, so
the state at the start of each paragraph is needed.  Every paragraph is reduced
to a five-letter transition (entry state -> exit state, one digit per possible
open quote); composing those digits along a document gives every entry state,
and the spans themselves are then built row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import let, match_spans, scanned
from ..functions.text import excerpt, is_blank

# ---- fixed values -----------------------------------------------------------------------------
NARRATION, SPEECH, THOUGHT, SEPARATOR, TITLE = "narracao", "dialogo", "pensamento", "separador", "titulo"
OPENERS = ["“", "«", '"', "‘"]
CLOSERS = ["”", "»", '"', "’"]
QUOTE_SIGNS = '[“”«»"‘’]'
# -----------------------------------------------------------------------------------------------

SPAN = "array<struct<start:int,end:int,role:string>>"


@dataclass(frozen=True)
class SegmentRules:
    """Reading of dialogue marks.

    ``repeat_opening``: an opener that repeats the open quotation at the start of
    a paragraph continues it.  ``per_line``: every manual line may open speech.
    ``hyphen``: a hyphen between spaces works as a dash.
    """

    dashes: bool = True
    quotes_role: str = SPEECH
    italic_thoughts: bool = True
    repeat_opening: bool = False
    per_line: bool = True
    hyphen: bool = True


def _span(start: Column, end: Column, role: str | Column) -> Column:
    label = F.lit(role) if isinstance(role, str) else role
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("role"))


def _empty() -> Column:
    return F.array().cast(SPAN)


def _state_of(opener: Column) -> Column:
    """Digit of the quotation opened by a sign, 0 when it opens none."""
    return F.array_position(F.array(*[F.lit(o) for o in OPENERS]), opener).cast("int")


def _closer_of(state: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(c) for c in CLOSERS]), state)


def _opener_of(state: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(c) for c in OPENERS]), state)


def _restarts(body: Column, state: Column) -> Column:
    """The paragraph starts with a complete pair of the quotation still open."""
    rest = F.substring(body, F.lit(2), F.char_length(body))
    return F.coalesce(
        (state > 0) & F.startswith(body, _opener_of(state)) & F.contains(rest, _closer_of(state)), F.lit(False)
    )


def _next_state(state: Column, sign: Column) -> Column:
    return F.when(state > 0, F.when(sign == _closer_of(state), F.lit(0)).otherwise(state)).otherwise(_state_of(sign))


def _is_repeat(mark: Column, state: Column, lead: Column, rules: SegmentRules) -> Column:
    if not rules.repeat_opening:
        return F.lit(False)
    return F.coalesce((state > 0) & (mark["start"] == lead) & (mark["text"] == _opener_of(state)), F.lit(False))


def quote_state(paras: DataFrame, rules: SegmentRules = SegmentRules()) -> DataFrame:
    """Adds ``entry`` (open quotation at the start), ``exit``, ``quote_spans`` and ``quote_warnings``.

    ``quote_spans`` holds ``open``, ``inside``, ``close`` and ``repeat`` ranges.
    A heading closes any open quotation.
    """
    body = F.regexp_replace("text", r"(?U)^\s+", "")
    prepared = (
        paras.withColumn("_marks", match_spans(F.col("text"), QUOTE_SIGNS))
        .withColumn("_body", F.when(F.size("_marks") > 0, body).otherwise(F.lit("")))
        .withColumn("_lead", F.char_length("text") - F.char_length(body))
    )

    def exit_from(entry: int) -> Column:
        start = F.lit(entry) if entry == 0 else F.when(_restarts(F.col("_body"), F.lit(entry)), F.lit(0)).otherwise(F.lit(entry))
        return F.aggregate(
            "_marks",
            start.cast("int"),
            lambda s, m: F.when(_is_repeat(m, s, F.col("_lead"), rules), s).otherwise(_next_state(s, m["text"])),
        )

    identity = F.lit("01234")
    transition = (
        F.when(F.col("heading"), F.lit("00000"))
        .when(F.size("_marks") == 0, identity)
        .otherwise(F.concat(*[exit_from(s).cast("string") for s in range(5)]))
    )
    moved = prepared.withColumn("_t", transition).drop("_marks", "_body", "_lead")
    rows = F.sort_array(F.collect_list(F.struct("paragraph", *[c for c in moved.columns if c not in ("doc_id", "paragraph")])))
    # One digit per paragraph: composing transitions along the document.
    entries = F.aggregate(
        "_rows",
        F.lit("0"),
        lambda acc, r: F.concat(acc, F.substring(r["_t"], F.substring(acc, -1, 1).cast("int") + 1, F.lit(1))),
    )
    flat = (
        moved.groupBy("doc_id")
        .agg(rows.alias("_rows"))
        .withColumn("_entries", entries)
        .select("doc_id", "_entries", F.posexplode("_rows").alias("_i", "_r"))
        .select(
            "doc_id",
            "_r.*",
            F.substring(F.col("_entries"), F.col("_i") + 1, F.lit(1)).cast("int").alias("entry"),
            F.substring(F.col("_entries"), F.col("_i") + 2, F.lit(1)).cast("int").alias("exit"),
            (F.col("_i") + 2 == F.char_length("_entries")).alias("_last"),
        )
        .drop("_t")
    )
    marks = match_spans(F.col("text"), QUOTE_SIGNS)
    restart = _restarts(F.regexp_replace("text", r"(?U)^\s+", ""), F.col("entry")) & ~F.col("heading")
    lead = F.char_length("text") - F.char_length(F.regexp_replace("text", r"(?U)^\s+", ""))

    def step(acc: Column, m: Column) -> Column:
        kept = F.when(_is_repeat(m, acc["state"], lead, rules), acc["state"]).otherwise(_next_state(acc["state"], m["text"]))
        return F.struct(kept.cast("int").alias("state"), m["end"].cast("int").alias("pos"))

    def build(acc: Column, m: Column) -> Column:
        gap = F.when((acc["state"] > 0) & (m["start"] > acc["pos"]), F.array(_span(acc["pos"], m["start"], "inside"))).otherwise(_empty())
        after = _next_state(acc["state"], m["text"])
        repeat = _is_repeat(m, acc["state"], lead, rules)
        label = (
            F.when(repeat, F.lit("repeat"))
            .when((acc["state"] > 0) & (after == 0), F.lit("close"))
            .when(acc["state"] > 0, F.lit("inside"))
            .when(after > 0, F.lit("open"))
        )
        here = F.when(label.isNotNull(), F.array(_span(m["start"], m["end"], label))).otherwise(_empty())
        return F.concat(gap, here)

    begin = F.struct(
        F.when(F.col("_restart"), F.lit(0)).otherwise(F.col("entry")).cast("int").alias("state"),
        F.lit(0).alias("pos"),
    )
    size = F.char_length("text")
    tail = lambda acc: F.when(
        (acc["state"] > 0) & (acc["pos"] < size), F.array(_span(acc["pos"], size, "inside"))
    ).otherwise(_empty())
    warnings = F.array_compact(
        F.array(
            F.when(F.col("heading") & (F.col("entry") > 0), F.lit("open_before_heading")),
            F.when(F.col("_restart"), F.lit("restarted")),
            F.when(F.col("_last") & (F.col("exit") > 0), F.lit("open_at_end")),
        )
    )
    return (
        flat.withColumn("_restart", restart)
        .withColumn("_marks", marks)
        .withColumn(
            "quote_spans",
            F.when(F.col("heading"), _empty()).otherwise(F.concat(scanned(F.col("_marks"), begin, step, build, SPAN), F.aggregate("_marks", begin, step, tail))),
        )
        .withColumn("quote_warnings", warnings)
        .drop("_restart", "_marks", "_last")
    )


def dash_spans(text: Column, rules: SegmentRules = SegmentRules()) -> Column:
    """Speech and separator ranges opened by a dash (or a dialogue hyphen)."""
    lines = F.split(text, "\n") if rules.per_line else F.array(text)

    def line_step(acc: Column, line: Column) -> Column:
        dash_open = line.rlike(r"(?U)^\s*[—–]")
        hyphen_open = line.rlike(r"(?U)^\s*- ") if rules.hyphen else F.lit(False)
        opens = dash_open | hyphen_open
        hyphen = F.when(opens, hyphen_open).otherwise(acc["hyphen"])
        seps = F.when(hyphen, match_spans(line, r"(?U)[—–]|(?<!\S)-(?!\S)")).otherwise(match_spans(line, "[—–]"))

        def with_seps(s: Column) -> Column:
            count = F.size(s)
            begin, length = acc["base"], F.char_length(line)
            # After separator number i of an opening line, speech runs when i is even.
            opened = F.flatten(
                F.transform(
                    s,
                    lambda m, i: let(
                        F.coalesce(F.try_element_at(s, i + 2)["start"], length),
                        lambda stop: F.concat(
                            F.array(_span(begin + m["start"], begin + m["end"], SEPARATOR)),
                            F.when((i % 2 == 0) & (stop > m["end"]), F.array(_span(begin + m["end"], begin + stop, SPEECH))).otherwise(_empty()),
                        ),
                    ),
                )
            )
            first = F.try_element_at(s, F.lit(1))
            continued = F.concat(
                F.when(first["start"] > 0, F.array(_span(begin, begin + first["start"], SPEECH))).otherwise(_empty()),
                F.array(_span(begin + first["start"], begin + first["end"], SEPARATOR)),
            )
            out = F.when(opens, opened).when(acc["spoken"] & (count > 0), continued).otherwise(_empty())
            spoken = F.when(is_blank(line), acc["spoken"]).when(opens, count % 2 == 1).otherwise(F.lit(False))
            return F.struct(
                F.coalesce(spoken, F.lit(False)).alias("spoken"),
                hyphen.alias("hyphen"),
                (begin + length + 1).cast("int").alias("base"),
                F.concat(acc["out"], out).alias("out"),
            )

        return let(seps, with_seps)

    start = F.struct(
        F.lit(False).alias("spoken"), F.lit(False).alias("hyphen"), F.lit(0).alias("base"), _empty().alias("out")
    )
    has_dash = text.rlike(r"[—–]|(?U)(?:^|\n)\s*- ")
    return F.when(has_dash, F.aggregate(lines, start, line_step, lambda acc: acc["out"])).otherwise(_empty())


def _overlay(layers: list[Column], size: Column) -> Column:
    """Maximal runs after painting the layers in order over narration."""
    # Starts and ends of all layers in order; ends come first, so that neighbours of a layer do not overlap.
    event = lambda pos, layer, change, role: F.struct(
        pos.cast("int").alias("pos"), F.lit(change).alias("change"), F.lit(layer).alias("layer"), role.cast("string").alias("role")
    )
    edges = [F.array(event(F.lit(0), -1, 0, F.lit(None)), event(size, -1, 0, F.lit(None)))]
    opening = lambda n: lambda s: event(s["start"], n, 1, s["role"])
    closing = lambda n: lambda s: event(s["end"], n, -1, F.lit(None))
    for n, layer in enumerate(layers):
        edges += [F.transform(layer, opening(n)), F.transform(layer, closing(n))]
    ordered = F.array_sort(F.concat(*edges))
    paired = let(
        ordered,
        lambda es: F.zip_with(
            es, F.slice(es, F.lit(2), F.size(es)),
            lambda e, after: F.struct(*[e[c].alias(c) for c in ("pos", "change", "layer", "role")], after["pos"].alias("next")),
        ),
    )
    nothing = F.struct(*[x for n in range(len(layers)) for x in (F.lit(0).alias(f"n{n}"), F.lit(None).cast("string").alias(f"r{n}"))])

    def step(state: Column, e: Column) -> Column:
        return F.struct(*[
            x
            for n in range(len(layers))
            for x in (
                (state[f"n{n}"] + F.when(e["layer"] == n, e["change"]).otherwise(0)).alias(f"n{n}"),
                F.when((e["layer"] == n) & (e["change"] == 1), e["role"]).otherwise(state[f"r{n}"]).alias(f"r{n}"),
            )
        ])

    def emit(state: Column, e: Column) -> Column:
        painted = lambda now: F.coalesce(*[F.when(now[f"n{n}"] > 0, now[f"r{n}"]) for n in reversed(range(len(layers)))], F.lit(NARRATION))
        piece = let(step(state, e), lambda now: _span(e["pos"], e["next"], painted(now)))
        return F.when(e["next"] > e["pos"], F.array(piece)).otherwise(_empty())

    def merged(pieces: Column) -> Column:
        opens = F.filter(pieces, lambda p, i: F.when(i == 0, True).otherwise(F.element_at(pieces, F.greatest(i, F.lit(1)))["role"] != p["role"]))
        return let(opens, lambda os: F.transform(os, lambda p, i: _span(p["start"], F.coalesce(F.try_element_at(os, i + 2)["start"], F.element_at(pieces, -1)["end"]), p["role"])))

    return F.when(size == 0, _empty()).otherwise(let(scanned(paired, nothing, step, emit, SPAN), merged))


def classify_roles(paras: DataFrame, rules: SegmentRules = SegmentRules()) -> DataFrame:
    """Adds ``roles``: spans that tile the paragraph.

    Heading, then italic thought, then quotations, then dashes, then narration.
    Input needs ``heading``; ``italic`` (array of start/end) is optional.
    """
    quotes = rules.quotes_role != NARRATION
    df = quote_state(paras, rules).drop("entry", "exit", "quote_warnings") if quotes else paras
    layers: list[Column] = []
    if rules.dashes:
        df = df.withColumn("_dashes", dash_spans(F.col("text"), rules))
        layers.append(F.col("_dashes"))
    if quotes:
        painted = F.transform(
            "quote_spans",
            lambda s: _span(s["start"], s["end"], F.when(s["role"].isin("inside"), F.lit(rules.quotes_role)).otherwise(F.lit(SEPARATOR))),
        )
        df = df.withColumn("_quotes", F.filter(painted, lambda s: s["end"] > s["start"]))
        layers.append(F.col("_quotes"))
    if rules.italic_thoughts and "italic" in df.columns:
        df = df.withColumn("_italic", F.transform("italic", lambda s: _span(s["start"], s["end"], THOUGHT)))
        layers.append(F.col("_italic"))
    size = F.char_length("text")
    whole = lambda role: F.array(_span(F.lit(0), size, role))
    plain = F.lit(True)
    for layer in layers:
        plain = plain & (F.size(layer) == 0)
    roles = F.when(F.col("heading"), whole(TITLE)).when(plain, whole(NARRATION))
    if layers:
        roles = roles.otherwise(_overlay(layers, size))
    return df.withColumn("roles", roles).drop("_dashes", "_quotes", "_italic", "quote_spans")


def role_spans(classified: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """One row per role run, with its text; optionally only some roles."""
    runs = F.col("roles")
    if allowed is not None:
        runs = F.filter(runs, lambda s: s["role"].isin(allowed))
    keep = [c for c in classified.columns if c not in ("roles", "text", "italic")]
    return classified.select(*keep, F.col("text").alias("paragraph_text"), F.explode(runs).alias("_s")).select(
        *keep,
        "paragraph_text",
        F.col("_s.start").alias("start"),
        F.col("_s.end").alias("end"),
        F.col("_s.role").alias("role"),
        excerpt(F.col("paragraph_text"), F.col("_s.start"), F.col("_s.end")).alias("text"),
    )


def mask_text(text: Column, roles: Column, allowed: list[str], keep_breaks: bool = True) -> Column:
    """Same length; characters outside the allowed roles are blank, line feeds stay."""
    hidden = r"[^\n]" if keep_breaks else r"(?s)."
    parts = F.transform(
        roles,
        lambda s: F.when(s["role"].isin(allowed), excerpt(text, s["start"], s["end"])).otherwise(
            F.regexp_replace(excerpt(text, s["start"], s["end"]), hidden, " ")
        ),
    )
    return F.array_join(parts, "")


def narrative_mask(paras: DataFrame, protect_italics: bool = True) -> DataFrame:
    """Older reading of narration: quotations are always speech, a repeated opener
    continues them, dashes open speech only at the paragraph start."""
    rules = SegmentRules(per_line=False, hyphen=False, repeat_opening=True, italic_thoughts=protect_italics)
    closed = quote_state(paras, rules)
    closers = F.transform(F.filter("quote_spans", lambda s: s["role"] == "close"), lambda s: s["start"])
    df = closed.withColumn("closing", F.when(F.col("heading"), F.array().cast("array<int>")).otherwise(closers))
    layers = [
        F.filter(F.transform("quote_spans", lambda s: _span(s["start"], s["end"], SPEECH)), lambda s: s["end"] > s["start"]),
        dash_spans(F.col("text"), rules),
    ]
    if protect_italics and "italic" in paras.columns:
        layers.append(F.transform("italic", lambda s: _span(s["start"], s["end"], THOUGHT)))
    size = F.char_length("text")
    named = []
    for i, layer in enumerate(layers):
        df = df.withColumn(f"_l{i}", layer)
        named.append(F.col(f"_l{i}"))
    roles = F.when(F.col("heading"), F.array(_span(F.lit(0), size, TITLE))).otherwise(_overlay(named, size))
    return (
        df.withColumn("roles", roles)
        .withColumn("mask", mask_text(F.col("text"), F.col("roles"), [NARRATION], keep_breaks=False))
        .drop("entry", "exit", "quote_spans", *[f"_l{i}" for i in range(len(layers))])
    )


def span_role(findings: DataFrame, classified: DataFrame) -> DataFrame:
    """Adds ``span_role``: the only speech, thought or narration role over the range, else null."""
    runs = classified.select("doc_id", "paragraph", "roles")
    touching = F.array_distinct(
        F.transform(
            F.filter(
                "roles",
                lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")) & s["role"].isin(NARRATION, SPEECH, THOUGHT),
            ),
            lambda s: s["role"],
        )
    )
    return (
        findings.join(runs, ["doc_id", "paragraph"], "left")
        .withColumn("_seen", touching)
        .withColumn("span_role", F.when(F.size("_seen") == 1, F.element_at("_seen", 1)))
        .drop("_seen", "roles")
    )


def _pack(rows: Column, size_of, breaks, cap: int) -> Column:
    """Greedy packing: ordinal of the pack of every row.  A pack is closed by a
    break or when the next row would pass the cap; skipped rows get ordinal 0."""

    def step(acc: Column, r: Column) -> Column:
        skip, cut = breaks(r)
        size = size_of(r)
        fresh = ~acc["open"] | cut | (acc["size"] + size > cap)
        number = F.when(fresh, acc["number"] + 1).otherwise(acc["number"])
        taken = F.struct(
            F.lit(True).alias("open"),
            number.cast("int").alias("number"),
            F.when(fresh, size).otherwise(acc["size"] + size).cast("long").alias("size"),
            F.concat(acc["out"], F.array(number.cast("int"))).alias("out"),
        )
        skipped = F.struct(
            F.lit(False).alias("open"),
            acc["number"].alias("number"),
            F.lit(0).cast("long").alias("size"),
            F.concat(acc["out"], F.array(F.lit(0))).alias("out"),
        )
        return F.when(skip, skipped).otherwise(taken)

    start = F.struct(
        F.lit(False).alias("open"),
        F.lit(0).alias("number"),
        F.lit(0).cast("long").alias("size"),
        F.array().cast("array<int>").alias("out"),
    )
    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def _packed(paras: DataFrame, columns: list[str], size_of, breaks, cap: int, name: str) -> DataFrame:
    """Only numbers and flags are gathered per document, never its text."""
    return (
        paras.groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("paragraph", *columns))).alias("_rows"))
        .withColumn("_packs", _pack(F.col("_rows"), size_of, breaks, cap))
        .select("doc_id", F.explode(F.arrays_zip(F.col("_rows.paragraph").alias("paragraph"), F.col("_packs").alias("pack"))).alias("_z"))
        .select("doc_id", F.col("_z.paragraph").alias("paragraph"), F.col("_z.pack").alias(name))
        .where(F.col(name) > 0)
    )


def scenes(paras: DataFrame, max_chars: int = 3500) -> DataFrame:
    """Scene number of every text paragraph: a heading, a break line, another chapter or
    the size cap opens a new one.  Headings and break lines belong to none."""
    w = Window.partitionBy("doc_id").orderBy("paragraph")
    marked = (
        paras.withColumn("_skip", F.col("heading") | F.col("text").rlike(r"^\s*([*#~]\s*){1,5}$"))
        .withColumn("_cut", F.coalesce(F.lag("chapter").over(w) != F.col("chapter"), F.lit(False)))
        .withColumn("_size", F.char_length("text"))
    )
    return _packed(marked, ["_skip", "_cut", "_size"], lambda r: r["_size"], lambda r: (r["_skip"], r["_cut"]), max_chars, "scene")


def chapter_groups(paras: DataFrame) -> DataFrame:
    """Contiguous text paragraphs per chapter title: order, id (slug, then ``-2``, ``-3`` …), range and hash."""
    from ..functions.text import normalize_quotes

    w = Window.partitionBy("doc_id").orderBy("paragraph")
    opened = F.col("heading").cast("int")
    tagged = paras.withColumn("_island", F.sum(opened).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    body = tagged.where(~F.col("heading"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("paragraph", "text"))), lambda r: r["text"]), "\n")
    groups = body.groupBy("doc_id", "_island", "chapter").agg(
        F.min("paragraph").alias("first_paragraph"),
        F.max("paragraph").alias("last_paragraph"),
        F.count("*").alias("paragraphs"),
        F.sha2(text, 256).alias("hash"),
    )
    slug = F.substring(F.regexp_replace(F.regexp_replace(normalize_quotes(F.col("chapter")), r"[^\p{L}\p{N}_]+", "-"), r"^-+|-+$", ""), 1, 60)
    order = Window.partitionBy("doc_id").orderBy("first_paragraph")
    same = Window.partitionBy("doc_id", "_slug").orderBy("first_paragraph")
    return (
        groups.withColumn("_slug", F.when(slug == "", F.lit("sem-titulo")).otherwise(slug))
        .withColumn("chapter_order", F.row_number().over(order))
        .withColumn("_n", F.row_number().over(same))
        .withColumn("chapter_id", F.when(F.col("_n") == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", F.col("_n").cast("string"))))
        .select("doc_id", "chapter_order", "chapter_id", F.col("chapter").alias("title"), "first_paragraph", "last_paragraph", "paragraphs", "hash")
    )


def review_windows(paras: DataFrame, max_chars: int = 40_000, context: int = 2) -> DataFrame:
    """Whole paragraphs packed per chapter, plus the previous ones of the chapter as context.

    One row per (window, paragraph); ``own`` tells context from paragraphs to review.
    """
    w = Window.partitionBy("doc_id").orderBy("paragraph")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = (
        paras.withColumn("_island", F.sum(F.col("heading").cast("int")).over(running))
        .where(~F.col("heading"))
        .withColumn("_size", F.char_length("text"))
        .withColumn("_cut", F.coalesce(F.lag("_island").over(w) != F.col("_island"), F.lit(False)))
        .withColumn("_skip", F.lit(False))
    )
    packs = _packed(body, ["_skip", "_cut", "_size"], lambda r: r["_size"], lambda r: (r["_skip"], r["_cut"]), max_chars, "window")
    placed = body.select("doc_id", "paragraph", "_island").join(packs, ["doc_id", "paragraph"])
    chapter = Window.partitionBy("doc_id", "_island").orderBy("paragraph")
    # A paragraph is context of the next window when that window starts within reach.
    followers = [
        F.when((F.lead("window", k).over(chapter) > F.col("window")), F.lead("window", k).over(chapter)) for k in range(1, context + 1)
    ]
    owned = placed.withColumn(
        "_in", F.concat(
            F.array(F.struct(F.col("window").alias("window"), F.lit(True).alias("own"))),
            F.transform(F.array_distinct(F.array_compact(F.array(*followers))), lambda v: F.struct(v.alias("window"), F.lit(False).alias("own"))),
        ),
    )
    return owned.select("doc_id", "paragraph", F.explode("_in").alias("_w")).select(
        "doc_id", "paragraph", F.col("_w.window").alias("window"), F.col("_w.own").alias("own")
    )


def context_window(paras: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """Adds ``context``: neighbouring paragraph numbers and texts of the same chapter."""
    w = Window.partitionBy("doc_id").orderBy("paragraph").rowsBetween(-before, after)
    near = F.collect_list(F.struct("paragraph", "chapter", "text")).over(w)
    return paras.withColumn("_near", near).withColumn(
        "context", F.filter("_near", lambda r: r["chapter"] == F.col("chapter"))
    ).drop("_near")


def scene_window(paras: DataFrame, before: int = 1, after: int = 3) -> DataFrame:
    """Adds ``context``: −1…+3 paragraph numbers, cut at headings, chapter changes and cut markers."""
    from ..functions.text import cut_marker

    w = Window.partitionBy("doc_id").orderBy("paragraph")
    item = F.struct("paragraph", "chapter", "heading", cut_marker(F.col("text")).alias("cut"))
    ahead = F.collect_list(item).over(w.rowsBetween(1, after))
    behind = F.collect_list(item).over(w.rowsBetween(-before, -1))
    stops = lambda r: r["heading"] | (r["chapter"] != F.col("chapter")) | r["cut"]
    stop_at = F.array_position(F.transform("_ahead", stops), True)
    reach = F.when(stop_at > 0, F.slice("_ahead", F.lit(1), (stop_at - 1).cast("int"))).otherwise(F.col("_ahead"))
    back = F.when(cut_marker(F.col("text")), F.slice("_behind", 1, 0)).otherwise(
        F.filter("_behind", lambda r: ~r["heading"] & (r["chapter"] == F.col("chapter")))
    )
    return (
        paras.withColumn("_ahead", ahead)
        .withColumn("_behind", behind)
        .withColumn(
            "context",
            F.concat(
                F.transform(back, lambda r: r["paragraph"]), F.array("paragraph"), F.transform(reach, lambda r: r["paragraph"])
            ),
        )
        .drop("_ahead", "_behind")
    )


def extraction_context(pairs: DataFrame, paras: DataFrame, limit: int = 2500) -> DataFrame:
    """Text around each pair (``a`` and ``b`` paragraph numbers): both, and those between when short enough."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    keyed = pairs.withColumn("_low", low).withColumn("_high", high)
    # Running size before each paragraph tells the size of a stretch without reading it.
    w = Window.partitionBy("doc_id").orderBy("paragraph").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = paras.withColumn("_upto", F.sum(F.char_length("text")).over(w)).withColumn("_len", F.char_length("text"))
    ends = sized.select("doc_id", "paragraph", "_upto", "_len")
    first = ends.select("doc_id", F.col("paragraph").alias("_low"), F.col("_upto").alias("_ulow"))
    last = ends.select("doc_id", F.col("paragraph").alias("_high"), (F.col("_upto") - F.col("_len")).alias("_uhigh"))
    measured = keyed.join(first, ["doc_id", "_low"]).join(last, ["doc_id", "_high"])
    whole = (F.col("_uhigh") - F.col("_ulow")) <= limit
    wanted = F.when(whole, F.sequence("_low", "_high")).otherwise(F.array_distinct(F.array("_low", "_high")))
    rows = measured.select("doc_id", "pair", F.explode(wanted).alias("paragraph"))
    lines = F.sort_array(F.collect_list(F.struct("paragraph", "text")))
    return (
        rows.join(paras.select("doc_id", "paragraph", "text"), ["doc_id", "paragraph"])
        .groupBy("doc_id", "pair")
        .agg(F.array_join(F.transform(lines, lambda r: F.concat(F.lit("[§"), r["paragraph"].cast("string"), F.lit("] "), r["text"])), "\n").alias("context"))
    )
