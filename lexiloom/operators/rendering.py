"""Review and output files as rows, and edited review files back to rows.

A file of a large project is never one value: it is a table of parts in source order, written
with a range partitioning so that the part files follow each other. Reading works on numbered
lines and the markers of known blocks, of which those are taken that rise in the expected order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.functions import text as X
from lexiloom.operators import scale
from lexiloom.operators.source_qa import effective_text
from lexiloom.operators.validation import effective_translation
from lexiloom.session import settle


def _marker(kind: str, block: Column) -> Column:
    return F.concat(F.lit(f"[{kind} "), block, F.lit("]")) if kind != "END" else F.concat(F.lit("[[END "), block, F.lit("]]"))


def _source_locator() -> Column:
    page = F.when(F.col("source_type") == "pdf", F.col("page"))
    return X.locator_line(page, F.col("source_file"))


def _header(rows: DataFrame, line: str) -> DataFrame:
    return rows.select("project_id").distinct().select(
        "project_id", F.lit(0).cast("long").alias("source_order"), F.concat(F.lit(line), F.lit("\n")).alias("part")
    )


def render_source_review(blocks: DataFrame) -> DataFrame:
    """Parts (project_id, source_order, part); part 0 is the file header."""
    body = blocks.select(
        "project_id", "source_order",
        F.concat_ws(
            "\n", _source_locator(), _marker("BLOCK", F.col("id")), X.strip(effective_text()), _marker("END", F.col("id")),
            F.lit(""), F.lit(K.REVIEW_SEPARATOR), F.lit(""),
        ).alias("part"),
    )
    return _header(blocks, K.SOURCE_REVIEW_HEADER).unionByName(body)


def render_problems(blocks: DataFrame, text: Column) -> DataFrame:
    """Blocks that cannot be rendered: no text, or a line that is their own end marker."""
    clean = X.strip(text)
    reserved = F.array_contains(F.split(clean, "\n"), _marker("END", F.col("id")))
    return blocks.withColumn(
        "problem", F.when(clean == "", "empty_text").when(reserved, "reserved_marker")
    ).filter(F.col("problem").isNotNull())


def locator_change(rows: DataFrame, span: int = scale.SPAN) -> DataFrame:
    """Adds ``locator``, ``first`` (no earlier row) and ``changed`` (new page or source)."""
    place = X.locator_line(F.col("page"), F.col("source_file"))
    marked = scale.previous(rows.withColumn("locator", place), ["project_id"], "source_order", F.col("locator"), "_before", span)
    return (
        marked.withColumn("first", F.col("_before").isNull())
        .withColumn("changed", ~F.col("locator").eqNullSafe(F.col("_before")))
        .drop("_before")
    )


def render_translation_review(segments: DataFrame, translation: Column) -> DataFrame:
    marked = locator_change(segments)
    opening = F.when(F.col("changed") & ~F.col("first"), F.concat(F.lit("\n" + K.REVIEW_SEPARATOR + "\n\n"), F.col("locator"))).when(
        F.col("changed"), F.col("locator")
    )
    block = F.col("source_block_id")
    body = marked.select(
        "project_id", "source_order",
        F.concat_ws(
            "\n", opening, _marker("BLOCK", block), F.lit("[ORIGINAL]"), F.col("source_text"), F.lit("[TRANSLATION]"),
            translation, _marker("END", block), F.lit(""),
        ).alias("part"),
    )
    return _header(segments, K.TRANSLATION_REVIEW_HEADER).unionByName(body)


def render_final_translation(approved: DataFrame) -> DataFrame:
    """Parts of the approved text, with a heading where the page or image changes."""
    marked = locator_change(approved)
    title = F.when(F.col("page").isNotNull(), F.col("locator")).otherwise(
        F.concat(F.lit("["), X.file_name("source_file"), F.lit("]"))
    )
    opening = F.when(F.col("changed") & ~F.col("first"), F.concat(F.lit(K.FINAL_SEPARATOR + "\n\n"), title, F.lit("\n"))).when(
        F.col("changed"), F.concat(title, F.lit("\n"))
    )
    return marked.select(
        "project_id", "source_order",
        F.concat_ws("\n", opening, X.strip(effective_translation()), F.lit("")).alias("part"),
    )


def output_path(source_file: Column) -> Column:
    """``05_output/<folders>/<stem>_kor.txt`` of an image below the image folder."""
    below = F.substr(source_file, F.lit(len(K.IMAGE_ROOT) + 2))
    folder = F.regexp_extract(below, "^(.*/)[^/]*$", 1)
    return F.concat(F.lit(K.OUTPUT_ROOT + "/"), folder, X.file_stem(below), F.lit("_kor.txt"))


def per_source_outputs(approved: DataFrame) -> DataFrame:
    """Parts (project_id, out_path, source_order, part) of one text per image."""
    images = approved.filter(F.startswith("source_file", F.lit(K.IMAGE_ROOT + "/")))
    return images.select(
        "project_id", output_path(F.col("source_file")).alias("out_path"), "source_file", "source_order",
        F.concat(X.strip(effective_translation()), F.lit("\n")).alias("part"),
    )


def path_collisions(files: DataFrame, path: str = "path") -> DataFrame:
    """Input paths that are equal but for case, or whose outputs are."""
    p = F.col(path)
    named = files.select("project_id", p.alias("path")).distinct()
    keys = F.array(
        F.struct(F.lit("input").alias("kind"), F.lower("path").alias("key")),
        F.struct(F.lit("output").alias("kind"), F.lower(F.concat(F.regexp_replace("path", r"\.[^./]+$", ""), F.lit(".txt"))).alias("key")),
    )
    return (
        named.select("project_id", "path", F.inline(keys))
        .groupBy("project_id", "kind", "key")
        .agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"))
        .filter("files > 1")
    )


# --- Reading review files back --------------------------------------------------------------


def _neighbours(rows: DataFrame, span: int) -> DataFrame:
    """Adds ``lo`` and ``hi``: the lines of the nearest rows before and behind, in the expected order, that have a ``line_no``."""
    held = F.col("line_no").isNotNull()
    # a carried value reads its rows three times, so each is written before the next
    before = settle(scale.carry_last(settle(rows), ["project_id"], "ordinal", F.col("line_no"), "lo", held, span=span))
    back = before.withColumn("_back", -F.col("ordinal"))
    return scale.carry_last(back, ["project_id"], "_back", F.col("line_no"), "hi", held, span=span).drop("_back")


def _rising(rows: DataFrame, span: int) -> DataFrame:
    """Rows (project_id, ordinal, line_no) whose lines rise with the expected order.

    A row that stands out of the order of its two neighbours, which agree without it, is left out
    first, so that one moved or quoted marker costs no other; then what is behind a later line goes.
    """
    near = _neighbours(rows, span)
    lo, hi, at = F.coalesce("lo", F.lit(0)), F.coalesce("hi", F.lit(2**62)), F.col("line_no")
    steady = near.filter(~(((at < lo) | (at > hi)) & (lo < hi))).select("project_id", "ordinal", "line_no")
    topped = scale.running_max(settle(steady), ["project_id"], "ordinal", at, "_top", span)
    return topped.filter((at > F.col("_top")) | F.col("_top").isNull()).drop("_top")


def _anchored(lines: DataFrame, want: DataFrame, placed: Column, skip: Column, span: int) -> DataFrame:
    """Where each expected block opens and ends (null where it does not), and what opens next.

    ``want``: project_id, ordinal, block_id and what ``placed`` and ``skip`` use. A line is an opening
    or an end of the block that it names. Openings that stand where they should (``placed``, over the
    lines ``before`` and ``after`` them) and occur once fix the order; a block without such a one
    opens at its best marker between its neighbours. A block ends at its own first end marker behind
    its ``skip`` lines, and before the next opening. All other markers are text.
    """
    name = lambda pattern: F.regexp_extract("line", pattern, 1)
    marks = lines.filter(F.col("line").rlike(K.BLOCK_MARKER) | F.col("line").rlike(K.END_MARKER)).select(
        "project_id", "line_no", F.col("line").rlike(K.BLOCK_MARKER).alias("opens"),
        F.when(F.col("line").rlike(K.BLOCK_MARKER), name(K.BLOCK_MARKER)).otherwise(name(K.END_MARKER)).alias("block_id"),
    )
    # of the lines beside a marker only place lines and the mark of the original decide
    notes = lines.filter(F.startswith("line", F.lit("[PAGE ")) | F.startswith("line", F.lit("[SOURCE ")) | (F.col("line") == "[ORIGINAL]"))
    beside = lambda by, out: notes.select("project_id", (F.col("line_no") + by).alias("line_no"), F.col("line").alias(out))
    known = marks.join(want, ["project_id", "block_id"])
    found = known.filter("opens").join(beside(1, "before"), ["project_id", "line_no"], "left").join(beside(-1, "after"), ["project_id", "line_no"], "left")
    openings = settle(found.select("project_id", "ordinal", "line_no", "before", F.coalesce(placed, F.lit(False)).alias("placed")))
    ends = known.filter(~F.col("opens")).select("project_id", "ordinal", F.col("line_no").alias("end_no"))

    once = openings.filter("placed").groupBy("project_id", "ordinal").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no")).filter("n = 1").drop("n")
    fixed = _rising(once, span)
    blocks = settle(_neighbours(want.join(fixed, ["project_id", "ordinal"], "left"), span))
    spare = blocks.filter(F.col("line_no").isNull()).select("project_id", "ordinal", "lo", "hi").join(openings, ["project_id", "ordinal"])
    between = (F.col("line_no") > F.coalesce("lo", F.lit(0))) & (F.col("line_no") < F.coalesce("hi", F.lit(2**62)))
    best = spare.filter(between).groupBy("project_id", "ordinal").agg(F.min_by("line_no", F.struct(~F.col("placed"), "line_no")).alias("line_no"))
    opened = settle(_rising(fixed.unionByName(best), span).join(openings.select("project_id", "ordinal", "line_no", "before"), ["project_id", "ordinal", "line_no"]))
    last = scale.carry_last(
        opened.withColumn("_back", -F.col("ordinal")), ["project_id"], "_back", F.struct(F.col("line_no").alias("open_no"), "ordinal"), "next", span=span
    ).drop("_back")
    both = want.join(last, ["project_id", "ordinal"], "left").withColumnRenamed("line_no", "open_no")
    closed = both.select("project_id", "ordinal", "open_no", "next", skip.alias("_skip")).join(ends, ["project_id", "ordinal"]).filter(
        (F.col("end_no") > F.col("open_no") + F.col("_skip")) & (F.col("next").isNull() | (F.col("end_no") < F.col("next.open_no")))
    )
    return settle(both.join(closed.groupBy("project_id", "ordinal").agg(F.min("end_no").alias("end_no")), ["project_id", "ordinal"], "left"))


def _spread_over(lines: DataFrame, blocks: DataFrame, span: int, *more: str) -> DataFrame:
    """Lines with ``own``, the block that opened last, its ends and ``more`` of it; null before the first.

    An opening is a row of its own just before its line, so the lines are dealt out once, without a join.
    """
    own = blocks.filter(F.col("open_no").isNotNull()).select(
        "project_id", (F.col("open_no") * 2).alias("_at"), F.struct("ordinal", "block_id", "open_no", "end_no", *more).alias("_own")
    )
    rows = lines.select("project_id", "line", (F.col("line_no") * 2 + 1).alias("_at")).unionByName(own, allowMissingColumns=True)
    carried = scale.carry_last(rows, ["project_id"], "_at", F.col("_own"), "own", F.col("_own").isNotNull(), inclusive=True, span=2 * span)
    at_line = carried.filter(F.col("_at") % 2 == 1)
    return settle(at_line.select("project_id", ((F.col("_at") - 1) / 2).cast("long").alias("line_no"), "line", "own"))


def _blank() -> Column:
    return F.col("line").isin("", K.REVIEW_SEPARATOR)


def _between(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Lines that lie in no block: project_id, line_no, line, ``behind`` (ordinal of the block before, 0 at first).

    ``places``: project_id, line_no of the place lines that open a block. Lines behind a block that
    lost its end marker are its own.
    """
    gap = rows.filter(~_blank() & (F.col("own").isNull() | (F.col("line_no") > F.col("own.end_no"))))
    free = gap.join(places, ["project_id", "line_no"], "left_anti")
    return free.select("project_id", "line_no", "line", F.coalesce("own.ordinal", F.lit(0).cast("long")).alias("behind"))


def _judged(blocks: DataFrame, between: DataFrame, span: int) -> DataFrame:
    """Adds ``intruded`` (foreign lines stand before the block) and ``place_left`` (the place line of a block without an opening is there)."""
    opened = F.col("open_no").isNotNull()
    rows = scale.carry_last(blocks, ["project_id"], "ordinal", F.col("ordinal"), "_last", opened, span=span).withColumn("_last", F.coalesce("_last", F.lit(0)))
    # lines behind a block stand before all blocks up to the next that opens
    foreign = between.select("project_id", F.col("behind").alias("_last")).distinct().withColumn("_foreign", F.lit(True))
    places = between.select("project_id", F.col("behind").alias("_last"), F.col("line").alias("want_place")).distinct().withColumn("_place", F.lit(True))
    both = rows.join(foreign, ["project_id", "_last"], "left").join(places, ["project_id", "_last", "want_place"], "left")
    intruded = F.col("_foreign").isNotNull() & opened & (F.col("_last") == F.col("ordinal") - 1)
    return both.withColumns({"intruded": intruded, "place_left": F.col("_place").isNotNull()}).drop("_last", "_foreign", "_place")


def _header_problems(lines: DataFrame, header: str) -> DataFrame:
    bad = lines.filter((F.col("line_no") == 1) & ~F.col("line").rlike(header))
    return bad.select("project_id", F.lit(0).cast("long").alias("ordinal"), F.lit(None).cast("string").alias("block_id"), F.lit("invalid_header").alias("code"))


def _tail_problems(between: DataFrame, totals: DataFrame) -> DataFrame:
    """Content behind the last expected block."""
    tail = between.join(totals, "project_id").filter(F.col("behind") == F.col("total"))
    code = F.when(F.col("line").rlike(K.BLOCK_MARKER), "unknown_block").otherwise("unexpected_content")
    return tail.groupBy("project_id").agg(
        (F.first("total") + 1).alias("ordinal"), F.lit(None).cast("string").alias("block_id"), F.min_by(code, "line_no").alias("code")
    )


def _body(inside: DataFrame, good: DataFrame) -> DataFrame:
    """``lines`` and ``ordinals`` of each block in ``good``; its body lines (bounded by the block itself) move once."""
    bodies = inside.groupBy("project_id", F.col("own.block_id").alias("block_id")).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line", F.col("own.ordinal").alias("ordinal")))).alias("_rows")
    )
    kept = good.groupBy("project_id", "block_id").agg(F.collect_list("ordinal").alias("ordinals"))
    own = lambda rows: F.filter(rows, lambda r: F.array_contains(F.col("ordinals"), r["ordinal"]))
    listed = F.transform(own(F.coalesce("_rows", F.array())), lambda r: r["line"])
    return kept.join(bodies, ["project_id", "block_id"], "left").select("project_id", "block_id", "ordinals", listed.alias("lines"))


def _text() -> Column:
    return X.strip(F.array_join("lines", "\n"))


def first_problem(problems: DataFrame) -> DataFrame:
    """Only the first structural problem of each project."""
    return problems.groupBy("project_id").agg(
        F.min_by(F.struct("block_id", "code"), F.col("ordinal")).alias("_p")
    ).select("project_id", "_p.block_id", "_p.code")


def parse_source_review(lines: DataFrame, expected: DataFrame, span: int = scale.SPAN) -> tuple[DataFrame, DataFrame]:
    """(texts, problems) of an edited source review.

    ``lines``: project_id, line_no, line, read several times, so best a stored table. ``expected``:
    project_id, source_order (1..n), id, source_type, page, source_file. A damaged block is a problem of its own and costs no other its
    text; markers that are not the next own marker of a block are text of the block they stand in.
    """
    want = expected.select(
        "project_id", F.col("source_order").alias("ordinal"), F.col("id").alias("block_id"), _source_locator().alias("want_place")
    )
    own_place = F.col("before") == F.col("want_place")
    content = lines.filter(F.col("line_no") > 1)
    blocks = _anchored(content, want, own_place, F.lit(0), span)
    rows = _spread_over(content, blocks, span)
    places = blocks.filter(own_place).select("project_id", (F.col("open_no") - 1).alias("line_no"))
    between = settle(_between(rows, places))
    inside = rows.filter((F.col("line_no") > F.col("own.open_no")) & (F.col("line_no") < F.col("own.end_no")))
    written = inside.filter(~X.is_blank("line")).select("project_id", F.col("own.ordinal").alias("ordinal")).distinct().withColumn("_text", F.lit(True))
    judged = settle(_judged(blocks, between, span).join(written, ["project_id", "ordinal"], "left").withColumn(
        "code",
        F.when(F.col("open_no").isNull() & F.col("place_left"), "block_order_changed")
        .when(~F.coalesce(own_place, F.lit(False)) | F.col("intruded"), "location_changed")
        .when(F.col("end_no").isNull(), "end_marker_changed")
        .when(F.col("_text").isNull(), "empty_text"),
    ).select("project_id", "ordinal", "block_id", "code"))
    good = judged.filter(F.col("code").isNull()).select("project_id", "ordinal", "block_id")
    texts = _body(inside, good).filter(F.size("lines") > 0).select("project_id", "block_id", _text().alias("text"))
    totals = want.groupBy("project_id").agg(F.max("ordinal").alias("total"))
    problems = (
        judged.filter(F.col("code").isNotNull())
        .unionByName(_header_problems(lines, K.SOURCE_REVIEW_HEADERS).select("project_id", "ordinal", "block_id", "code"))
        .unionByName(_tail_problems(between, totals))
    )
    return texts, problems


def parse_translation_review(lines: DataFrame, segments: DataFrame, span: int = scale.SPAN) -> tuple[DataFrame, DataFrame]:
    """(translations, problems) of an edited translation review.

    ``segments``: project_id, source_order (1..n), source_block_id, page, source_file, source_text.
    Damage is handled as in ``parse_source_review``.
    """
    # a source text is known by its digest and its number of lines; it does not move itself
    digest = lambda text: F.unhex(F.sha2(text, 256))
    told = segments.select(
        "project_id", "source_order", "source_block_id", "page", "source_file",
        digest(F.col("source_text")).alias("digest"), F.size(F.split("source_text", "\n")).alias("n"),
    )
    want = settle(locator_change(told, span).select(
        "project_id", F.col("source_order").alias("ordinal"), F.col("source_block_id").alias("block_id"),
        F.col("locator").alias("want_place"), "changed", "digest", "n",
    ))
    content = lines.filter(F.col("line_no") > 1)
    blocks = _anchored(content, want.drop("digest"), F.col("after") == "[ORIGINAL]", F.col("n") + 2, span)
    own_place = F.col("changed") & (F.col("before") == F.col("want_place"))
    rows = _spread_over(content, blocks, span, "n").withColumn("offset", F.col("line_no") - F.col("own.open_no")).withColumn("ordinal", F.col("own.ordinal"))
    places = blocks.filter(own_place).select("project_id", (F.col("open_no") - 1).alias("line_no"))
    between = settle(_between(rows, places))
    original = F.col("offset").between(2, F.col("own.n") + 1)
    at = lambda n: F.max(F.when(F.col("offset") == n, F.col("line")))
    seen = rows.filter(F.col("offset") <= F.col("own.n") + 2).groupBy("project_id", "ordinal").agg(
        at(1).alias("o_mark"), at(F.col("own.n") + 2).alias("t_mark"),
        digest(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(original, F.struct("line_no", "line")))), lambda p: p["line"]), "\n")).alias("_source"),
    )
    judged = settle(_judged(blocks, between, span).join(seen, ["project_id", "ordinal"], "left").join(want.select("project_id", "ordinal", F.col("digest").alias("_digest")), ["project_id", "ordinal"]).withColumn(
        "code",
        F.when(F.col("open_no").isNull() & (F.col("place_left") | ~F.col("changed")), "block_order_changed")
        .when(F.col("changed") & (~F.coalesce(own_place, F.lit(False)) | F.col("intruded")), "location_changed")
        .when(F.col("intruded"), "block_order_changed")
        .when(~F.col("o_mark").eqNullSafe(F.lit("[ORIGINAL]")), "original_marker_changed")
        .when(~F.col("_source").eqNullSafe(F.col("_digest")), "source_changed")
        .when(~F.col("t_mark").eqNullSafe(F.lit("[TRANSLATION]")), "translation_marker_changed")
        .when(F.col("end_no").isNull(), "end_marker_changed"),
    ).select("project_id", "ordinal", "block_id", "code"))
    good = judged.filter(F.col("code").isNull()).select("project_id", "ordinal", "block_id")
    inside = rows.filter((F.col("offset") >= F.col("own.n") + 3) & (F.col("line_no") < F.col("own.end_no")))
    # an accepted block without body lines has an empty translation
    each = F.when(F.size("lines") > 0, F.array(_text())).otherwise(F.array_repeat(F.lit(""), F.size("ordinals")))
    texts = _body(inside, good).select("project_id", "block_id", F.explode(each).alias("text"))
    totals = want.groupBy("project_id").agg(F.max("ordinal").alias("total"))
    problems = (
        judged.filter(F.col("code").isNotNull())
        .unionByName(_header_problems(lines, K.TRANSLATION_REVIEW_HEADERS).select("project_id", "ordinal", "block_id", "code"))
        .unionByName(_tail_problems(between, totals))
    )
    return texts, problems


# --- Reports --------------------------------------------------------------------------------

def source_qa_report(issues: DataFrame) -> DataFrame:
    """Numbered report entries Q-0001.. per project in issue order, one row each."""
    numbered = scale.number_rows(issues, ["project_id"], "source_order", ["code", "id"], "number")
    place = F.concat(F.col("source_file"), F.when(F.col("page").isNotNull(), F.concat(F.lit(", page "), F.col("page").cast("string"))).otherwise(""))
    quoted = F.replace(X.collapse(F.coalesce("evidence", F.lit(""))), F.lit("`"), F.lit("'"))
    entry = F.format_string("### Q-%04d [%s] %s\nin %s\nblock %s\n> %s\n", "number", "severity", "code", place, "block_id", quoted)
    return numbered.select("project_id", "number", entry.alias("entry"))


def translation_qa_report(issues: DataFrame) -> DataFrame:
    """Table rows of the translation report: block, code, severity, detail; pipes and line ends are escaped."""
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("|"), F.concat_ws("|", F.coalesce("block_id", F.lit("all")), "code", "severity", cell(F.col("detail"))), F.lit("|"))
    return issues.select("project_id", "block_id", "code", line.alias("line"))
