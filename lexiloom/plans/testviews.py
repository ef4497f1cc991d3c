"""Localization tables derived from the general-purpose driver tables.

The driver tables hold no localization data, so whole documents become pages and blocks, and
fixed arithmetic on their ids adds tokens, markers, hashes and review edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.functions import text as X
from lexiloom.operators import layout as L
from lexiloom.operators import scale
from lexiloom.operators.source_qa import effective_text
from lexiloom.session import settle, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their project (the source) and its number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return spread(docs, "doc_id").select(
        F.col("source").alias("project_id"),
        "doc_id",
        "text",
        F.substring("source", 4, 20).cast("long").alias("snum"),
    )


def lines(docs: DataFrame) -> DataFrame:
    """One row per non-blank line of a document."""
    return (
        docs.select("project_id", "doc_id", "snum", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
        .select("project_id", "doc_id", "snum", (F.col("pos") + 1).cast("long").alias("line"), X.strip("t").alias("t"))
        .filter(F.col("t") != "")
    )


def _h() -> Column:
    return F.col("doc_id") * 31 + F.col("line") * 7


def _every(n: int, value: Column | str) -> Column:
    item = F.lit(value) if isinstance(value, str) else value
    return F.when(_h() % n == 0, item).otherwise(F.lit(""))


def decoration() -> Column:
    doc = F.col("doc_id")
    return F.concat(
        _every(17, " {DMGR}"),
        _every(19, F.concat(F.lit(" {UNK_"), (doc % 7).cast("string"), F.lit("}"))),
        _every(23, " [ICON: star]"),
        _every(29, " [illegible]"),
        _every(31, " " + K.REPLACEMENT_CHAR),
        _every(37, " {BAD"),
        _every(41, " sword.png"),
        _every(43, " l0 DE-O5"),
        _every(47, "\t   end"),
        _every(53, F.concat(F.lit(" <b>"), (doc % 100).cast("string"), F.lit("</b>"))),
    )


def source_file() -> Column:
    return F.when(F.col("snum") % 2 == 0, F.concat(F.lit("01_input/"), F.col("project_id"), F.lit(".pdf"))).otherwise(
        F.concat(F.lit(K.IMAGE_ROOT + "/"), F.col("project_id"), F.lit("/Card "), F.col("doc_id").cast("string"), F.lit(".png"))
    )


def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source blocks without ``source_order``: every line, and one identifier per document."""
    docs = documents(spark, sf_dir)
    mod = _h() % 13
    words = F.size(F.split("t", " +"))
    text_rows = lines(docs).select(
        "project_id", "doc_id", "snum", "line",
        F.concat("t", decoration()).alias("raw_text"),
        F.when((words <= 6) & ~F.col("t").rlike("[.!?]$"), F.lit("heading"))
        .when(mod == 1, F.lit("list_item"))
        .when(mod == 2, F.lit("ability"))
        .when(mod == 3, F.lit("label"))
        .when(mod == 4, F.lit("title"))
        .otherwise(F.lit("paragraph"))
        .alias("block_type"),
    )
    doc, number = F.col("doc_id"), (F.col("doc_id") % 40).cast("string")
    head = F.upper("project_id")
    ids = docs.select(
        "project_id", "doc_id", "snum", F.lit(0).cast("long").alias("line"),
        F.when(doc % 5 == 0, F.concat(head, F.lit(" C8 "), number))
        .when(doc % 5 == 1, F.lit("{Dark}"))
        .otherwise(F.concat(head, F.lit("-"), number))
        .alias("raw_text"),
        F.lit("identifier").alias("block_type"),
    )
    k = doc + F.col("line")
    pdf = F.col("snum") % 2 == 0
    kind = F.when(pdf, F.lit("pdf")).otherwise(F.lit("image"))
    page = F.when(pdf, doc + 1)
    rows = text_rows.unionByName(ids).withColumn("source_file", source_file()).withColumn("page", page)
    top = ((F.col("line") * 7) % 900).cast("double")
    none = F.array().cast("array<string>")
    return rows.select(
        "project_id", "doc_id", "snum", "line",
        F.lit(1).alias("schema_version"),
        X.block_id(kind, F.col("source_file"), F.col("page"), F.col("line") + 1).alias("id"),
        kind.alias("source_type"),
        "source_file",
        "page",
        (F.col("line") + 1).alias("block_order"),
        "block_type",
        "raw_text",
        F.when(k % 67 == 0, F.concat("raw_text", F.lit(" fixed"))).alias("corrected_text"),
        F.array(F.lit(50.0), top, F.lit(950.0), top + 12.5).alias("bbox"),
        F.when(~pdf, F.when(k % 53 == 0, F.lit("uncertain")).otherwise(F.lit("clear"))).alias("legibility"),
        F.when((k % 59 == 0) | (k % 61 == 0) | (~pdf & (k % 53 == 0)), F.lit("flagged")).otherwise(F.lit("raw")).alias("status"),
        F.when(k % 59 == 0, F.array(F.concat(F.lit(K.RECOVERY_PREFIX + ": F"), F.col("line").cast("string")), F.lit("second note")))
        .otherwise(none)
        .alias("warnings"),
        none.alias("source_refs"),
        F.when(doc % 97 == 0, F.concat(F.lit("sha256:"), F.repeat(F.lit("0"), 64)))
        .otherwise(X.text_sha256("raw_text", prefix=True))
        .alias("source_hash"),
    )


def blocks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Source blocks numbered within their project; only with ``columns`` where some are named."""
    rows = block_rows(spark, sf_dir)
    kept = rows.select("project_id", "doc_id", "line", *columns) if columns else rows
    return settle(scale.number_rows(kept, ["project_id"], "doc_id", ["line"], "source_order"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcription instructions that name the allowed tokens of two projects in three."""
    doc = F.col("doc_id")
    extra = F.when(doc % 7 < 4, F.concat(F.lit(" and {UNK_"), (doc % 7).cast("string"), F.lit("}"))).otherwise(F.lit(""))
    return (
        documents(spark, sf_dir)
        .filter(F.col("snum") % 3 != 0)
        .select("project_id", F.concat(F.lit("Use {DMGR}\r\nor {Dark}"), extra).alias("prompt"))
    )


def _fragment_text() -> Column:
    k = (F.col("doc_id") + F.col("pos")) % 9
    return (
        F.when(k == 0, F.concat("t", F.lit("-")))
        .when(k.isin(1, 3), F.lower("t"))
        .when(k == 2, F.regexp_replace("t", "[.!?]+$", ""))
        .otherwise(F.col("t"))
    )


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a page, every line a fragment on it."""
    rows = L.number_fragments(lines(documents(spark, sf_dir)).withColumn("page", F.col("doc_id") + 1))
    pos = F.col("pos")
    x, y = (pos % 50 + 10).cast("double"), (pos * 5).cast("double")
    return rows.select(
        "project_id", "page", "doc_id", "pos", "id",
        _fragment_text().alias("text"),
        F.floor((pos - 1) / 3).cast("long").alias("block_index"),
        ((pos - 1) % 3).alias("line_index"),
        F.array(x, y, x + 290 + (pos % 200).cast("double"), y + 4.5).alias("bbox"),
        F.array(F.lit(600.0), F.lit(800.0)).alias("page_size"),
    )


def refs(fragments: DataFrame) -> DataFrame:
    """A model's block structure with left-out, repeated and unknown fragment ids."""
    k, pos = F.col("doc_id") + F.col("pos"), F.col("pos")
    block = F.floor((pos - 1) / 2).cast("long") + 1
    entry = lambda cond, place, name: F.when(cond, F.struct(place.cast("long").alias("ref_pos"), name.alias("fragment_id")))
    listed = F.array_compact(
        F.array(
            entry(k % 7 != 0, (pos - 1) % 2 + 1, F.col("id")),
            entry(k % 11 == 0, F.lit(10), F.col("id")),
            entry(k % 13 == 0, F.lit(20), F.format_string("P999-F%03d", pos)),
        )
    )
    kind = F.col("block_pos") % 9
    return (
        fragments.withColumn("block_pos", block)
        .select("project_id", "page", "block_pos", F.inline(listed))
        .withColumn("type", F.when(kind == 1, "heading").when(kind == 5, "list_item").when(kind == 8, "page_number").otherwise("paragraph"))
        .withColumn("include_in_text", kind != 8)
        .withColumn("reason", F.lit(""))
    )


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired, joined and merged blocks with their order on the page."""
    frags = fragments(spark, sf_dir)
    whole = L.merge_continuations(L.reconstruct_blocks(frags, L.recover_layout(frags, refs(frags))))
    order = Window.partitionBy("project_id", "page").orderBy("block_pos")
    return whole.withColumn("block_order", F.row_number().over(order).cast("long"))


def ocr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is an image, every line a transcribed block; some are malformed."""
    k, y = F.col("doc_id") + F.col("line"), ((F.col("line") * 3) % 900).cast("double")
    none = F.array().cast("array<string>")
    box = F.array(F.lit(10.126), y, F.lit(500.0), y + 2.0)
    return lines(documents(spark, sf_dir)).select(
        F.concat(F.lit("img-"), "project_id").alias("project_id"),
        F.concat(F.lit(K.IMAGE_ROOT + "/"), "project_id", F.lit("/Card "), F.col("doc_id").cast("string"), F.lit(".png")).alias("source_file"),
        F.col("doc_id").alias("source_pos"),
        F.col("line").alias("block_order"),
        F.when(k % 17 == 0, "stamp").when(F.col("line") == 1, "title").otherwise("body").alias("type"),
        F.concat(F.lit("  "), "t", F.when(k % 19 == 0, " [ILLEGIBLE]").otherwise("")).alias("text"),
        F.when(k % 23 == 0, F.reverse(box)).otherwise(box).alias("bbox"),
        F.when(k % 29 == 0, "uncertain").otherwise("clear").alias("legibility"),
        F.when(F.col("doc_id") % 10 == 0, F.array(F.lit("glare"))).otherwise(none).alias("warnings"),
    )


def termbase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of every document as a term of its project, and one icon term."""
    first = documents(spark, sf_dir).select("project_id", "doc_id", F.regexp_extract("text", K.TERM_WORD, 0).alias("w"))
    words = (
        first.filter(F.col("w") != "")
        .groupBy("project_id", F.lower("w").alias("lw"))
        .agg(F.min("w").alias("source_term"), F.min("doc_id").alias("d"))
    )
    state = F.col("d") % 3
    rows = words.select(
        "project_id",
        X.term_id(F.col("lw")).alias("candidate_id"),
        "source_term",
        F.when(state == 0, F.concat(F.upper("lw"), F.lit("Z"))).when(state == 1, F.col("source_term")).otherwise("").alias("translation"),
        F.when(F.length("lw") > 6, "proper_noun").otherwise("term").alias("category"),
        F.when(state == 0, "approved").when(state == 1, "keep").otherwise("rejected").alias("status"),
        F.array("lw", F.concat("lw", F.lit("s"))).alias("variants"),
    )
    icons = documents(spark, sf_dir).select("project_id").distinct().select(
        "project_id", F.lit("term-icon").alias("candidate_id"), F.lit("icon").alias("source_term"), F.lit("icon").alias("translation"),
        F.lit("ui").alias("category"), F.lit("keep").alias("status"), F.array(F.lit("[ICON:"), F.lit("(icon")).alias("variants"),
    )
    return rows.unionByName(icons)


def _ascii_upper(text: Column) -> Column:
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _translated(k: Column, eff: Column) -> Column:
    return (
        F.when(k == 0, "")
        .when(k == 1, eff)
        .when(k == 2, F.replace(eff, F.lit("{DMGR}"), F.lit("")))
        .when(k == 3, F.replace(eff, F.lit("<b>"), F.lit("<i>")))
        .when(k == 4, F.concat(eff, F.lit(" 1 7")))
        .when(k == 5, F.regexp_replace(eff, "[0-9]", "9"))
        .when(k == 6, F.concat(F.lit("가 "), _ascii_upper(eff)))
        .when(k == 7, F.concat(eff, F.lit(" " + K.REPLACEMENT_CHAR)))
        .when(k == 8, F.concat(F.lit("가나 "), eff, F.lit(" [illegible]")))
        .when(k == 9, F.lit("한글"))
        .otherwise(F.concat(_ascii_upper(eff), F.lit("Z")))
    )


def pairs(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Every block as source text with a translation that breaks some of the rules."""
    k, eff = (F.col("doc_id") + F.col("line")) % 11, effective_text()
    return (block_rows(spark, sf_dir) if rows is None else rows).select(
        "*", F.col("id").alias("block_id"), eff.alias("source_text"), X.strip(_translated(k, eff)).alias("translated_text")
    )


def segments(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Translated segments of every block (or of ``rows``); an empty translation gets the source text."""
    p = pairs(spark, sf_dir, blocks(spark, sf_dir) if rows is None else rows)
    text = F.when(F.col("translated_text") == "", F.col("source_text")).otherwise(F.col("translated_text"))
    return p.select(
        "project_id", "doc_id", "line", F.lit(1).alias("schema_version"), F.col("id").alias("source_block_id"), "source_file", "page",
        "source_order", "block_type", "source_text", X.text_sha256("source_text").alias("source_sha256"),
        text.alias("translated_text"), X.text_sha256(text).alias("translation_sha256"),
        F.when((F.col("doc_id") + F.col("line")) % 11 == 1, "flagged").otherwise("translated").alias("status"),
        F.lit("stub-model").alias("model"), F.sha2(F.lit("prompt"), 256).alias("prompt_sha256"),
        F.sha2(F.lit("termbase"), 256).alias("termbase_sha256"),
    )


def reviewed(segments: DataFrame) -> DataFrame:
    """Reviewed translations: one block in seven was corrected by hand."""
    return segments.select(
        "project_id", "source_block_id",
        F.when((F.col("doc_id") + F.col("line")) % 7 == 0, F.concat("translated_text", F.lit(" 수정"))).otherwise(F.col("translated_text")).alias("text"),
    )
