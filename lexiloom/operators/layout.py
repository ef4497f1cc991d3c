"""Page layout: coverage of a model's block structure, repair of omissions, block text.

``fragments``: project_id, page, id, pos (1-based place on the page), text, bbox, block_index, page_size.
``refs``: project_id, page, block_pos, ref_pos, fragment_id, type, include_in_text, reason.
A page is the unit of work; its windows are partitioned by (project_id, page).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.functions import geometry as G
from lexiloom.functions import items as I
from lexiloom.functions import text as X

PAGE = ["project_id", "page"]


def number_fragments(lines: DataFrame) -> DataFrame:
    """Fragment ids ``P001-F001`` in extraction order (``lines`` has ``line`` per page)."""
    order = Window.partitionBy(*PAGE).orderBy("line")
    return lines.withColumn("pos", F.row_number().over(order).cast("long")).withColumn(
        "id", F.format_string("P%03d-F%03d", F.col("page"), F.col("pos"))
    )


def layout_coverage(fragments: DataFrame, refs: DataFrame) -> DataFrame:
    """Per page: counts, and the missing, unknown and repeated fragment ids."""
    expected = fragments.select(*PAGE, F.col("id").alias("fragment_id"), F.lit(1).alias("_e"), F.lit(0).alias("_r"))
    returned = refs.select(*PAGE, "fragment_id", F.lit(0).alias("_e"), F.lit(1).alias("_r"))
    per_id = expected.unionByName(returned).groupBy(*PAGE, "fragment_id").agg(F.sum("_e").alias("e"), F.sum("_r").alias("r"))
    e, r, fid = F.col("e"), F.col("r"), F.col("fragment_id")
    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, fid)))
    return (
        per_id.groupBy(*PAGE)
        .agg(
            F.sum("e").alias("expected_count"),
            F.sum("r").alias("returned_count"),
            listed((e > 0) & (r == 0)).alias("missing"),
            listed((e == 0) & (r > 0)).alias("unknown"),
            listed(r > 1).alias("duplicates"),
        )
        .withColumn(
            "valid",
            (F.size("missing") == 0) & (F.size("unknown") == 0) & (F.size("duplicates") == 0)
            & (F.col("expected_count") == F.col("returned_count")),
        )
    )


def first_reference(fragments: DataFrame, refs: DataFrame) -> DataFrame:
    """References that name a known fragment for the first time in reading order."""
    order = Window.partitionBy(*PAGE, "fragment_id").orderBy("block_pos", "ref_pos")
    known = fragments.select(*PAGE, F.col("id").alias("fragment_id"), F.col("pos"), F.col("block_index"))
    return (
        refs.withColumn("_n", F.row_number().over(order))
        .filter("_n = 1")
        .drop("_n")
        .join(known, [*PAGE, "fragment_id"])
    )


def missing_groups(fragments: DataFrame, refs: DataFrame) -> DataFrame:
    """Fragments no block names; neighbours of one native block share a group number."""
    named = refs.select(*PAGE, F.col("fragment_id").alias("id")).distinct()
    lost = fragments.join(named, [*PAGE, "id"], "left_anti")
    order = Window.partitionBy(*PAGE).orderBy("pos")
    joined = (F.lag("pos").over(order) == F.col("pos") - 1) & F.lag("block_index").over(order).eqNullSafe(F.col("block_index"))
    return lost.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn(
        "group_no", F.sum("_new").over(order).cast("long")
    ).drop("_new")


def recover_layout(fragments: DataFrame, refs: DataFrame) -> DataFrame:
    """References repaired so that every fragment is named exactly once.

    A lost group goes before the block of the next surviving fragment, else behind the block of
    the previous one; groups keep their own order.
    """
    kept = first_reference(fragments, refs)
    lost = missing_groups(fragments, refs)
    rows = kept.select(
        *PAGE, "pos", "fragment_id", "block_pos", "ref_pos", "type", "include_in_text", "reason",
        F.lit(None).cast("long").alias("group_no"),
    ).unionByName(
        lost.select(
            *PAGE, "pos", F.col("id").alias("fragment_id"), F.lit(None).cast("long").alias("block_pos"),
            F.lit(None).cast("long").alias("ref_pos"), F.lit("paragraph").alias("type"),
            F.lit(True).alias("include_in_text"), F.lit("Restored after omission.").alias("reason"), "group_no",
        )
    )
    # the next anchor is the last one seen when the page is walked backwards, which keeps the window's state to one row
    ahead = Window.partitionBy(*PAGE).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*PAGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.last("block_pos", ignorenulls=True).over(ahead)
    prev = F.last("block_pos", ignorenulls=True).over(behind)
    lost_row = F.col("group_no").isNotNull()
    placed = (
        rows.withColumn("_next", nxt)
        .withColumn("_prev", prev)
        .withColumn("_anchor", F.coalesce("block_pos", "_next", "_prev", F.lit(-1).cast("long")))
        .withColumn("_side", F.when(~lost_row, 1).when(F.col("_next").isNotNull(), 0).otherwise(2))
        .withColumn("_group", F.coalesce("group_no", F.lit(0).cast("long")))
    )
    key = ["_anchor", "_side", "_group"]
    block_order = Window.partitionBy(*PAGE).orderBy(*key)
    inner = Window.partitionBy(*PAGE, *key).orderBy(F.coalesce("ref_pos", "pos"))
    return placed.select(
        *PAGE,
        F.dense_rank().over(block_order).cast("long").alias("block_pos"),
        F.row_number().over(inner).cast("long").alias("ref_pos"),
        "fragment_id", "type", "include_in_text", "reason", lost_row.alias("recovered"),
    )


def reconstruct_blocks(fragments: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per block: text of its fragments in listed order, union box, warnings."""
    parts = fragments.select(*PAGE, F.col("id").alias("fragment_id"), "text", "bbox", "page_size")
    recovered = F.col("recovered") if "recovered" in refs.columns else F.lit(False)
    rows = refs.withColumn("recovered", recovered).join(parts, [*PAGE, "fragment_id"])
    corner = lambda i, fn: fn(F.get("bbox", F.lit(i)))
    listed = F.array_sort(F.collect_list(F.struct("ref_pos", "fragment_id", "text")))
    grouped = rows.groupBy(*PAGE, "block_pos").agg(
        F.first("type").alias("type"),
        F.first("include_in_text").alias("include_in_text"),
        F.bool_or("recovered").alias("recovered"),
        F.first("page_size").alias("page_size"),
        F.array(corner(0, F.min), corner(1, F.min), corner(2, F.max), corner(3, F.max)).alias("bbox"),
        listed.alias("_parts"),
    )
    note = lambda fid: F.concat(F.lit(K.RECOVERY_PREFIX + ": "), fid, F.lit(" — " + K.RECOVERY_SUFFIX))
    ids = F.transform("_parts", lambda p: p["fragment_id"])
    none = F.array().cast("array<string>")
    folded = grouped.withColumn("fragment_ids", ids).withColumn("_join", I.join_fragments(F.transform("_parts", lambda p: p["text"])))
    return folded.select(
        *PAGE, "block_pos", "type", "include_in_text", "recovered", "page_size", "bbox", "fragment_ids",
        F.col("_join.text").alias("text"),
        F.concat(F.when(F.col("recovered"), F.transform("fragment_ids", note)).otherwise(none), F.col("_join.warnings")).alias("warnings"),
    )


def merge_continuations(blocks: DataFrame) -> DataFrame:
    """Paragraphs that go on in the next block (no end mark, lower-case start) become one."""
    order = Window.partitionBy(*PAGE).orderBy("block_pos")
    start = F.regexp_replace("text", "^[\"'‘’“”(]+", "")
    open_end = lambda text: ~text.rlike("[.!?:;][\"'’”)]?$")
    plain = lambda: (F.col("type") == "paragraph") & F.col("include_in_text") & ~F.col("recovered")
    marked = blocks.withColumn("_plain", plain())
    joins = (
        F.lag("_plain").over(order) & F.col("_plain") & open_end(F.lag("text").over(order)) & start.rlike(r"^\p{Ll}")
    )
    islands = marked.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn(
        "_island", F.sum("_new").over(order)
    )
    member = F.struct("block_pos", "text", "fragment_ids", "warnings", "type", "include_in_text", "recovered", "bbox", "page_size")
    grouped = islands.groupBy(*PAGE, "_island").agg(F.array_sort(F.collect_list(member)).alias("_m"))
    head = F.col("_m")[0]
    rest = F.slice("_m", F.lit(2), F.size("_m"))

    def step(state: Column, nxt: Column) -> Column:
        pair = I.join_fragments(F.array(state["text"], nxt["text"]))
        return F.struct(pair["text"].alias("text"), F.concat(state["warnings"], nxt["warnings"], pair["warnings"]).alias("warnings"))

    start_state = F.struct(head["text"].alias("text"), head["warnings"].alias("warnings"))
    folded = F.when(F.size("_m") > 1, F.aggregate(rest, start_state, step)).otherwise(start_state)
    box = lambda i: F.transform("_m", lambda b: F.get(b["bbox"], F.lit(i)))
    return grouped.select(
        *PAGE,
        head["block_pos"].alias("block_pos"),
        head["type"].alias("type"),
        head["include_in_text"].alias("include_in_text"),
        head["recovered"].alias("recovered"),
        head["page_size"].alias("page_size"),
        F.array(F.array_min(box(0)), F.array_min(box(1)), F.array_max(box(2)), F.array_max(box(3))).alias("bbox"),
        F.flatten(F.transform("_m", lambda b: b["fragment_ids"])).alias("fragment_ids"),
        folded["text"].alias("text"),
        folded["warnings"].alias("warnings"),
        (F.size("_m") > 1).alias("merged"),
    )


def page_text(blocks: DataFrame, order: str = "block_pos") -> DataFrame:
    """Included non-empty block texts of a page, joined by a blank line."""
    used = blocks.filter(F.col("include_in_text") & (F.col("text") != ""))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    return used.groupBy(*PAGE).agg(X.strip(F.array_join(F.transform(listed, lambda p: p["t"]), "\n\n")).alias("text"))


def combined_text(pages: DataFrame) -> DataFrame:
    """Page sections as rows; written in page order they are the combined file."""
    return pages.select(*PAGE, F.concat(F.lit("[PAGE "), F.col("page").cast("string"), F.lit("]\n"), F.col("text")).alias("section"))


def combined_ocr_text(images: DataFrame) -> DataFrame:
    """Image sections as rows (``source_file``, ``text``), each closed by the separator."""
    head = F.concat(F.lit("["), F.col("source_file"), F.lit("]\n"), F.coalesce("text", F.lit("")))
    return images.select(
        "project_id", "source_file",
        F.concat(F.regexp_replace(head, r"\s+\z", ""), F.lit("\n\n" + K.REVIEW_SEPARATOR)).alias("section"),
    )


def fragment_blocks(blocks: DataFrame, source_file: Column) -> DataFrame:
    """Included layout blocks in the common Block shape (not yet numbered)."""
    raw = X.strip("text")
    seen = F.array_distinct("warnings")
    size = F.col("page_size")
    return blocks.filter(F.col("include_in_text") & ~X.is_blank("text")).select(
        "project_id",
        F.lit(K.SCHEMA_VERSION).alias("schema_version"),
        X.block_id(F.lit("pdf"), source_file, F.col("page"), F.col("block_order")).alias("id"),
        F.lit("pdf").alias("source_type"),
        source_file.alias("source_file"),
        F.col("page"),
        F.col("page").alias("source_pos"),
        "block_order",
        F.coalesce("type", F.lit("other")).alias("block_type"),
        raw.alias("raw_text"),
        F.lit(None).cast("string").alias("corrected_text"),
        G.normalize_box(F.col("bbox"), F.get(size, F.lit(0)), F.get(size, F.lit(1))).alias("bbox"),
        F.lit(None).cast("string").alias("legibility"),
        F.when(F.size(seen) > 0, "flagged").otherwise("raw").alias("status"),
        seen.alias("warnings"),
        F.col("fragment_ids").alias("source_refs"),
        X.text_sha256(raw, prefix=True).alias("source_hash"),
    )


def image_blocks(ocr: DataFrame) -> DataFrame:
    """Transcribed blocks in the common Block shape (not yet numbered).

    ``ocr``: project_id, source_file, source_pos, block_order, type, text, bbox, legibility, warnings.
    """
    raw = X.strip("text")
    doubt = (F.col("legibility") == "uncertain") | (F.size("warnings") > 0)
    return ocr.select(
        "project_id",
        F.lit(K.SCHEMA_VERSION).alias("schema_version"),
        X.block_id(F.lit("image"), F.col("source_file"), F.lit(None).cast("long"), F.col("block_order")).alias("id"),
        F.lit("image").alias("source_type"),
        "source_file",
        F.lit(None).cast("long").alias("page"),
        "source_pos",
        "block_order",
        F.coalesce("type", F.lit("other")).alias("block_type"),
        raw.alias("raw_text"),
        F.lit(None).cast("string").alias("corrected_text"),
        G.round_box(F.col("bbox")).alias("bbox"),
        "legibility",
        F.when(doubt, "flagged").otherwise("raw").alias("status"),
        "warnings",
        F.array().cast("array<string>").alias("source_refs"),
        X.text_sha256(raw, prefix=True).alias("source_hash"),
    )


def layout_request(fragments: DataFrame) -> DataFrame:
    """Per page, the JSON list of fragments a layout model is asked to order."""
    item = F.struct("id", "text", "bbox")
    listed = F.array_sort(F.collect_list(F.struct("pos", item.alias("f"))))
    return fragments.groupBy(*PAGE).agg(F.to_json(F.transform(listed, lambda p: p["f"])).alias("fragments"))
