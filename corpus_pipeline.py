"""The corpus pipeline: documents -> identified -> lines cleaned -> one of each group of copies -> clean of benchmarks -> mixed.

Each stage takes (spark, docs, sf_dir); its result is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, language_id, line_dedup, mixing, near_dups
from lexiloom.llm.common import Scratch, fresh, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    return language_id.keep_identified(docs)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites carry."""
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; documents without an id or without words stay."""
    return near_dups.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their tokens, domain posteriors, rates and copies; those of no copy go."""
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"))
    return mixed.filter(F.col(fresh(docs, "copies")) > 0)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", clean_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Compression, minwise sketches and tiling have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
