"""Readers: files in, typed tables out. Bad rows come back beside the good ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom import constants as K
from lexiloom import schemas
from lexiloom.functions import items as I
from lexiloom.functions import text as X


def allowed_tokens(prompts: DataFrame, text: str = "prompt") -> DataFrame:
    """Distinct ``{TOKEN}`` names per project."""
    found = I.find_all(X.normalize_newlines(text), K.TOKEN, 1)
    return prompts.select("project_id", F.explode(found).alias("token")).distinct()


def _project(df: DataFrame) -> DataFrame:
    """Adds ``project_id``, the folder a file lies in, unless the data or a partition has it."""
    if "project_id" in df.columns:
        return df
    return df.withColumn("project_id", F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)))


def _json_lines(spark: SparkSession, path: str, schema: T.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType(), True)])
    rows = spark.read.schema(wide).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = _project(rows)
    broken = rows.filter(F.col("_corrupt").isNotNull() | F.col(key).isNull()).select(
        "project_id", F.col(key).alias("key"), F.lit("malformed").alias("problem")
    )
    fine = rows.filter(F.col("_corrupt").isNull() & F.col(key).isNotNull()).drop("_corrupt")
    repeated = (
        fine.groupBy("project_id", key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        .select("project_id", F.col(key).alias("key"), F.lit("duplicate").alias("problem"))
    )
    return fine, broken.unionByName(repeated)


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, problems) of block JSON lines; blank lines are skipped."""
    return _json_lines(spark, path, schemas.BLOCK, "id")


def read_segments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _json_lines(spark, path, schemas.SEGMENT, "source_block_id")


def read_termbase(spark: SparkSession, path: str, active_only: bool = True, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, problems) of JSON lines, each a document with any number of entries.

    With ``whole_files`` each file is one document over several lines. Entries of an unknown status
    and active entries with a gap are problems.
    """
    documents = spark.read.schema(schemas.TERMBASE).json(path, multiLine=whole_files)
    rows = documents.select("project_id", F.inline("entries"))
    active = F.col("status").isin("approved", "keep")
    gap = X.is_blank("source_term") | X.is_blank("translation")
    unknown = ~F.coalesce(F.col("status").isin(*K.GLOSSARY_STATUSES), F.lit(False))
    problem = F.when(unknown, "status").when(active & gap, "incomplete")
    problems = rows.select("project_id", F.col("candidate_id").alias("key"), problem.alias("problem")).filter("problem is not null")
    return (rows.filter(active & ~gap) if active_only else rows), problems


def read_glossary_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with record_no, problems) of review tables with the exact ten-column header."""
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in (*K.GLOSSARY_COLUMNS, "_corrupt")])
    raw = (
        spark.read.schema(schema).option("sep", "\t").option("multiLine", True).option("escape", '"')
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    rows = _project(raw).withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id())
    start = rows.groupBy("_file").agg(F.min("_at").alias("_start"))
    rows = rows.join(start, "_file").withColumn("record_no", F.col("_at") - F.col("_start") + 1)
    first = F.concat_ws("\t", F.regexp_replace("status", "^\ufeff", ""), *K.GLOSSARY_COLUMNS[1:])
    wrong_head = (F.col("record_no") == 1) & (F.col("_corrupt").isNotNull() | (first != "\t".join(K.GLOSSARY_COLUMNS)))
    blank = X.is_blank(F.concat_ws("", *K.GLOSSARY_COLUMNS, "_corrupt"))
    wrong_size = (F.col("record_no") > 1) & ~blank & F.col("_corrupt").isNotNull()
    problem = F.when(wrong_head, "header").when(wrong_size, "field_count")
    bad = rows.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("project_id", "record_no", "problem")
    good = rows.filter((F.col("record_no") > 1) & ~blank & F.col("_corrupt").isNull())
    return good.select("project_id", "record_no", *[F.coalesce(c, F.lit("")).alias(c) for c in K.GLOSSARY_COLUMNS]), bad


def source_inventory(spark: SparkSession, root: str, hash_content: bool = True) -> DataFrame:
    """Supported, not hidden image files below a folder with size, hash and natural sort key."""
    columns = ["path", "length", "content"] if hash_content else ["path", "length"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(*columns)
    base = root.rstrip("/")
    relative = F.substring_index("path", base + "/", -1)
    rows = files.withColumn("relative", relative).filter(
        F.lower("relative").rlike(r"\.(" + "|".join(K.IMAGE_SUFFIXES) + ")$") & ~F.col("relative").rlike(r"(^|/)\.")
    )
    digest = F.sha2("content", 256) if hash_content else F.lit(None).cast("string")
    return rows.select(F.col("relative").alias("path"), "length", digest.alias("sha256"), X.natural_key("relative").alias("sort_key"))


def read_page_fragments(spark: SparkSession, path: str) -> DataFrame:
    """One row per fragment of the per-page JSON files."""
    pages = _project(spark.read.schema(schemas.PAGE_FRAGMENTS).json(path, multiLine=True))
    return pages.select("project_id", "page", "page_size", F.posexplode("fragments").alias("i", "f")).select(
        "project_id", "page", "page_size", (F.col("i") + 1).cast("long").alias("pos"), "f.*"
    )


def read_page_layouts(spark: SparkSession, path: str) -> DataFrame:
    """One row per reconstructed block of the per-page JSON files."""
    pages = _project(spark.read.schema(schemas.PAGE_LAYOUT).json(path, multiLine=True))
    return pages.select("project_id", "page", F.posexplode("reconstructed_blocks").alias("i", "b")).select(
        "project_id", "page", (F.col("i") + 1).cast("long").alias("block_order"), "b.*"
    )


def successful_pages(rows: DataFrame, acquisition: DataFrame) -> DataFrame:
    """Rows of pages that a complete run without failures lists (``pages`` array per project)."""
    from lexiloom.operators.validation import acquisition_gate

    good = acquisition_gate(acquisition).select("project_id", F.explode("pages").alias("page"))
    return rows.join(good, ["project_id", "page"], "left_semi")


def read_ocr_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(transcribed blocks, problems); the stored image must be the one the file name implies."""
    files = _project(spark.read.schema(schemas.OCR_RESULT).json(path, multiLine=True))
    rows = files.withColumn("_stem", F.url_decode(X.file_stem(F.col("_metadata.file_path"))))
    fits = X.clean_path("source_image") & (X.file_stem("source_image") == F.col("_stem"))
    problems = rows.filter(~F.coalesce(fits, F.lit(False))).select("project_id", F.col("source_image").alias("key"), F.lit("source_mismatch").alias("problem"))
    blocks = rows.filter(fits).select("project_id", F.col("source_image").alias("source_file"), F.col("ocr.warnings").alias("warnings"), F.posexplode("ocr.blocks").alias("i", "b"))
    return blocks.select("project_id", "source_file", "warnings", (F.col("i") + 1).cast("long").alias("block_order"), "b.*"), problems


def scan_projects(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(manifests, warnings) of ``<root>/<project>/project.json``; a broken one is only a warning."""
    from lexiloom.operators.validation import validate_manifests

    texts = spark.read.text(f"{root.rstrip('/')}/*/project.json", wholetext=True).withColumn(
        "folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    ).filter(~F.startswith("folder", F.lit(".")))
    parsed = texts.withColumn("m", F.from_json("value", schemas.MANIFEST, {"mode": "PERMISSIVE"})).select("folder", "m.*")
    checked = validate_manifests(parsed)
    good = checked.filter((F.size("violations") == 0) & (F.col("folder") == F.col("project_id"))).drop("violations")
    bad = checked.filter((F.size("violations") > 0) | ~F.col("folder").eqNullSafe(F.col("project_id"))).select("folder", "violations")
    return good.orderBy(F.lower("project_id")), bad


def read_job_records(spark: SparkSession, path: str) -> DataFrame:
    """Latest valid record per project and kind; records still active count as interrupted."""
    from lexiloom.operators.jobs import latest_job, mark_interrupted
    from lexiloom.operators.validation import validate_jobs

    rows = validate_jobs(spark.read.schema(schemas.JOB).json(path))
    return mark_interrupted(latest_job(rows.filter(F.size("violations") == 0).drop("violations"), kind=True))


def read_review_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of part files in file-name order (one folder per project)."""
    from lexiloom.operators import scale
    from lexiloom.session import settle

    lines = _project(spark.read.text(path)).select(
        "project_id", F.regexp_replace("value", "^﻿", "").alias("line"),
        F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    kept = settle(lines)
    # Dense numbers for (file, split), then lines inside each: the order of the joined parts.
    splits = kept.groupBy("project_id", "_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    from pyspark.sql import Window

    order = Window.partitionBy("project_id").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    # the ids of a split follow each other, so its lines need no sort; there is one row of ``starts`` per split of a file
    return (
        kept.join(F.broadcast(starts.select("project_id", "_file", "_block", "_before", "_first")), ["project_id", "_file", "_block"])
        .select("project_id", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "line")
    )
