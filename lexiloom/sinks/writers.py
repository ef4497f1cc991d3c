"""Writers: tables to the file formats of the review workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom import schemas


def _in_order(df: DataFrame, *keys: str) -> DataFrame:
    """Range-partitioned and sorted, so part files follow each other; a large project spans many."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_blocks(df: DataFrame, path: str) -> None:
    """Block JSON lines in source order, one folder per project."""
    columns = ["project_id", *schemas.BLOCK.fieldNames()]
    _in_order(df.select(*columns), "project_id", "source_order").write.partitionBy("project_id").option("ignoreNullFields", False).json(path)


def write_segments(df: DataFrame, path: str, mode: str = "append") -> None:
    """Segments appended to a Parquet table; the commit protocol makes each append whole."""
    df.select("project_id", *schemas.SEGMENT.fieldNames()).write.mode(mode).partitionBy("project_id").parquet(path)


def write_glossary_tsv(df: DataFrame, path: str) -> None:
    """Review tables with byte-order mark and header, one folder per project."""
    cells = df.select("project_id", *[F.col(c).cast("string").alias(c) for c in K.GLOSSARY_COLUMNS])
    marked = cells.withColumnRenamed("status", "﻿status")
    marked.write.partitionBy("project_id").option("sep", "\t").option("header", True).option("escape", '"').option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_termbase(entries: DataFrame, path: str) -> None:
    """One JSON document per line with a single entry, so a termbase of any size is rows."""
    fields = schemas.TERM_ENTRY.fieldNames()
    document = F.struct(
        F.lit(K.SCHEMA_VERSION).alias("schema_version"), F.col("project_id").alias("project_id"), F.array(F.struct(*fields)).alias("entries")
    )
    entries.select(F.to_json(document).alias("value")).write.text(path)


def write_parts(parts: DataFrame, path: str, *folders: str) -> None:
    """Rendered parts in source order as text, below ``project_id`` (and ``folders``)."""
    keys = ("project_id", *folders)
    ordered = _in_order(parts.select(*keys, "source_order", "part"), *keys, "source_order")
    ordered.drop("source_order").write.partitionBy(*keys).text(path)


def snapshot_revision(df: DataFrame, path: str, reason: str, revision: str) -> None:
    """Rows of the revision log under a caller-given revision; written again, a revision replaces itself only."""
    log = df.withColumn("reason", F.lit(reason)).withColumn("revision", F.lit(revision))
    log.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "revision").parquet(path)
