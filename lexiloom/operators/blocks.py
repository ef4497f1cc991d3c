"""Block tables: one shape for both source kinds, numbering, page choice, human edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.functions import items as I
from lexiloom.functions import text as X
from lexiloom.operators import scale
from lexiloom.operators.source_qa import effective_text
from lexiloom.session import settle


def unify_blocks(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def assign_source_order(blocks: DataFrame, position: str = "source_pos", order: str = "block_order") -> DataFrame:
    """Running block number per project over its pages or images, then blocks.

    The blocks are written once first: numbering reads them twice, the second time only the keys.
    """
    return scale.number_rows(settle(blocks), ["project_id"], position, [order], "source_order")


def included_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("include_in_text"))


def merge_warnings(stored: Column, found: Column) -> Column:
    return F.array_distinct(F.concat(stored, found))


def parse_pages(expression: str | None, page_count: int) -> list[tuple[int, int]]:
    """``"1,3-5"`` as inclusive page ranges; None means all pages."""
    if page_count < 1:
        raise ValueError("page count must be positive")
    if not expression:
        return [(1, page_count)]
    ranges = []
    for item in (part.strip() for part in expression.split(",")):
        if not item:
            continue
        low, _, high = item.partition("-")
        first, last = int(low), int(high or low)
        if not 1 <= first <= last <= page_count:
            raise ValueError(f"page range out of bounds: {item}")
        ranges.append((first, last))
    if not ranges:
        raise ValueError("page selection is empty")
    return ranges


def select_pages(df: DataFrame, expression: str | None, page_count: int, column: str = "page") -> DataFrame:
    """Rows of the chosen pages; ranges stay ranges, so they reach the scan as filters."""
    chosen = F.lit(False)
    for first, last in parse_pages(expression, page_count):
        chosen = chosen | F.col(column).between(first, last)
    return df.filter(chosen)


def unresolved_blocks(blocks: DataFrame, text: Column | None = None) -> DataFrame:
    """Not excluded blocks with an open icon, an illegible mark or a replacement character."""
    c = effective_text() if text is None else text
    icon = c.rlike(K.ICON)
    unread = F.contains(F.upper(c), F.lit(K.ILLEGIBLE)) | F.contains(c, F.lit(K.REPLACEMENT_CHAR))
    open_rows = blocks if "excluded" not in blocks.columns else blocks.filter(~F.col("excluded"))
    return open_rows.withColumn("icon", icon).withColumn("illegible", unread).filter("icon OR illegible")


def unresolved_counts(unresolved: DataFrame) -> DataFrame:
    return unresolved.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if("icon").alias("icons"), F.count_if("illegible").alias("illegible")
    )


def layout_warning_count(warnings: Column) -> Column:
    return F.size(F.filter(warnings, lambda w: F.startswith(w, F.lit(K.RECOVERY_PREFIX))))


def layout_warnings_by_group(blocks: DataFrame) -> DataFrame:
    place = X.locator(F.col("source_type"), F.col("page"), F.col("source_file"))
    return blocks.groupBy("project_id", place.alias("location")).agg(
        F.sum(layout_warning_count(F.col("warnings"))).cast("long").alias("layout_warnings")
    )


def apply_review_edits(originals: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(review rows, violations) for submitted edits.

    ``edits``: project_id, position, id, text, excluded, and for new blocks source_type,
    source_file, page, bbox. Every original must come back, kept or excluded.
    """
    base = originals.select(
        "project_id", "id", "source_type", "source_file", "page", "block_type", "raw_text", "bbox", "warnings",
        "source_hash", F.col("source_order").alias("original_order"),
    )
    sent = edits.select(
        "project_id", "id", "position", "text", F.coalesce("excluded", F.lit(False)).alias("excluded"),
        F.col("source_type").alias("new_type"), F.col("source_file").alias("new_file"),
        F.col("page").alias("new_page"), F.col("bbox").alias("new_bbox"),
    )
    both = base.withColumn("_o", F.lit(True)).join(sent.withColumn("_s", F.lit(True)), ["project_id", "id"], "full_outer")
    original, submitted = F.col("_o").isNotNull(), F.col("_s").isNotNull()
    clean = X.strip("text")
    flat = both.filter(submitted & (original | ~F.col("excluded"))).select(
        "project_id",
        F.when(original, F.col("id"))
        .otherwise(X.manual_block_id(F.col("new_type"), F.col("new_page"), F.col("new_file"), F.col("new_bbox"), clean))
        .alias("id"),
        F.coalesce("source_type", "new_type").alias("source_type"),
        F.coalesce("source_file", "new_file").alias("source_file"),
        F.when(original, F.col("page")).when(F.col("new_type") == "pdf", F.col("new_page")).alias("page"),
        F.coalesce("block_type", F.lit("paragraph")).alias("block_type"),
        F.coalesce("raw_text", clean).alias("raw_text"),
        F.when(original & (clean != F.col("raw_text")), clean).alias("corrected_text"),
        F.coalesce("bbox", "new_bbox").alias("bbox"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        clean.alias("text"),
        "position", "excluded", "original_order",
        (~original).alias("manual"),
    )
    missing = both.filter(original & ~submitted).select("project_id", "id", F.lit("missing_block").alias("code"))
    repeated = (
        sent.groupBy("project_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("project_id", "id", F.lit("duplicate_block").alias("code"))
    )
    empty = flat.filter(~F.col("excluded") & (F.col("text") == "")).select("project_id", "id", F.lit("empty_text").alias("code"))
    places = base.select("project_id", "source_file", F.col("page").alias("_p")).distinct().withColumn("_known", F.lit(True))
    manual = flat.filter("manual")
    strange = (
        manual.join(
            places, (manual.project_id == places.project_id) & (manual.source_file == places.source_file)
            & manual.page.eqNullSafe(places["_p"]), "left_anti",
        ).select("project_id", "id", F.lit("unknown_place").alias("code"))
    )
    box = F.col("bbox")
    flat_box = manual.filter(
        ~F.coalesce((F.size(box) == 4) & (F.get(box, F.lit(0)) < F.get(box, F.lit(2))) & (F.get(box, F.lit(1)) < F.get(box, F.lit(3))), F.lit(False))
    ).select("project_id", "id", F.lit("bad_box").alias("code"))
    alive = flat.groupBy("project_id").agg(F.count_if(~F.col("excluded")).alias("n")).filter("n = 0").select(
        "project_id", F.lit(None).cast("string").alias("id"), F.lit("nothing_left").alias("code")
    )
    return flat, missing.unionByName(repeated).unionByName(empty).unionByName(strange).unionByName(flat_box).unionByName(alive)


def place_order(blocks: DataFrame) -> DataFrame:
    """First original order of each page or image: the rank pages must keep."""
    return blocks.groupBy("project_id", "source_file", "page").agg(F.min("source_order").alias("place_rank"))


def group_order_check(rows: DataFrame, places: DataFrame, span: int = scale.SPAN) -> DataFrame:
    """Rows whose page or image comes before the page of an earlier row (``position`` order)."""
    p = places.select(
        F.col("project_id").alias("_pid"), F.col("source_file").alias("_f"), F.col("page").alias("_pg"), "place_rank"
    )
    ranked = rows.join(
        p, (rows.project_id == p["_pid"]) & (rows.source_file == p["_f"]) & rows.page.eqNullSafe(p["_pg"])
    ).drop("_pid", "_f", "_pg")
    return scale.previous(ranked, ["project_id"], "position", F.col("place_rank"), "previous_rank", span).filter(
        F.col("previous_rank") > F.col("place_rank")
    )


def layout_state_equal(state: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per project: does the ordered id list hold every block exactly once?

    ``state``: project_id, id, excluded. ``blocks``: project_id, id, manual.
    """
    have = blocks.select("project_id", "id", F.lit(1).alias("b"), F.lit(0).alias("s"), F.col("manual").alias("m"), F.lit(False).alias("x"))
    said = state.select("project_id", "id", F.lit(0).alias("b"), F.lit(1).alias("s"), F.lit(False).alias("m"), F.col("excluded").alias("x"))
    per_id = have.unionByName(said).groupBy("project_id", "id").agg(
        F.sum("b").alias("b"), F.sum("s").alias("s"), F.bool_or("m").alias("m"), F.bool_or("x").alias("x")
    )
    return per_id.groupBy("project_id").agg(
        F.count_if((F.col("b") > 0) & (F.col("s") == 0)).alias("missing"),
        F.count_if((F.col("b") == 0) & (F.col("s") > 0)).alias("unknown"),
        F.count_if(F.col("s") > 1).alias("repeated"),
        F.count_if(F.col("x") & (F.col("m") | (F.col("b") == 0))).alias("bad_exclusions"),
    ).withColumn("valid", (F.col("missing") + F.col("unknown") + F.col("repeated") + F.col("bad_exclusions")) == 0)


def review_rows(rows: DataFrame) -> DataFrame:
    """Originals and manual blocks without the excluded ones."""
    return rows.filter(~F.col("excluded"))


def renumber_approved(rows: DataFrame) -> DataFrame:
    """Approved blocks with new source order and a new order inside each page or image."""
    kept = review_rows(rows)
    numbered = scale.number_rows(kept, ["project_id"], "position", [], "source_order")
    # Places keep their order, so each is one run of source orders and its first order suffices.
    place = F.concat_ws("|", "source_file", F.coalesce(F.col("page").cast("string"), F.lit("")))
    placed = numbered.withColumn("_place", place)
    first = placed.groupBy("project_id", "_place").agg(F.min("source_order").alias("_first"))
    return (
        placed.join(first, ["project_id", "_place"])
        .withColumn("block_order", F.col("source_order") - F.col("_first") + 1)
        .withColumn("corrected_text", F.when(F.col("text") != F.col("raw_text"), F.col("text")))
        .withColumn("status", F.lit("approved"))
        .drop("_place", "_first")
    )


def review_summary(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """Counts shown above a source review."""
    per_block = rows.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(~F.col("excluded")).alias("included"),
        F.count_if("excluded").alias("excluded"),
        F.count_if("manual").alias("manual"),
        F.count_if(F.col("manual") | (F.col("text") != F.col("raw_text"))).alias("changed"),
        F.sum(F.size("warnings")).cast("long").alias("warnings"),
        F.sum(layout_warning_count(F.col("warnings"))).cast("long").alias("layout_warnings"),
    )
    found = issues.groupBy("project_id").agg(F.count(F.lit(1)).alias("issues"))
    return per_block.join(found, "project_id", "left").withColumn("issues", F.coalesce("issues", F.lit(0)))


def attach_issues(blocks: DataFrame, issues: DataFrame) -> DataFrame:
    """Blocks with their issues as an array; a block's issues are bounded by its own text."""
    per_block = issues.groupBy("project_id", F.col("block_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("code", "severity", "evidence"))).alias("issues")
    )
    none = F.array().cast("array<struct<code:string,severity:string,evidence:string>>")
    return blocks.join(per_block, ["project_id", "id"], "left").withColumn("issues", F.coalesce("issues", none))


def source_finalize_gate(
    rows: DataFrame, tokens: DataFrame, allow_token_changes: bool = False, allow_icons: bool = False
) -> DataFrame:
    """Codes that forbid approval, per block (``id, raw_text, text``)."""
    from lexiloom.operators.source_qa import with_unknown_tokens

    text = F.col("text")
    known = with_unknown_tokens(rows.withColumn("corrected_text", F.col("text")), tokens)
    used, before = I.find_all(text, K.TOKEN, 1), I.find_all(F.col("raw_text"), K.TOKEN, 1)
    manual = F.startswith(F.col("id"), F.lit("manual-"))
    codes = {
        "replacement_character": F.contains(text, F.lit(K.REPLACEMENT_CHAR)),
        "illegible": F.contains(F.upper(text), F.lit(K.ILLEGIBLE)),
        "unresolved_icon": F.lit(not allow_icons) & text.rlike(K.ICON),
        "malformed_token": F.regexp_replace(text, K.TOKEN, "").rlike("[{}]"),
        "unknown_token": F.coalesce(F.size("unknown") > 0, F.lit(False)),
        "token_changed": F.lit(not allow_token_changes) & ~manual & ~I.multiset_equal(used, before),
    }
    found = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in codes.items()]))
    return known.withColumn("violations", found).filter(F.size("violations") > 0)
