"""The incremental forms: same columns as the batch operators over unbounded tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import source_qa as Q
from lexiloom.operators.jobs import mark_interrupted


def stream_source_qa(blocks: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Per-block issues of a block stream; a token vocabulary joins as a static table."""
    if tokens is None:
        return Q.block_issues(blocks)
    return Q.block_issues(Q.with_unknown_tokens(blocks, tokens), token_findings=True)


def content_key() -> list:
    """What makes a block the same work: project, place and text."""
    return [F.col("project_id"), F.col("id"), X.text_sha256(Q.effective_text()).alias("content_sha256")]


def new_blocks_batch(path: str, handle: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps only content not stored at ``path`` yet.

    Each batch writes its own folder, so a batch run again after a failure replaces itself.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("content_sha256", X.text_sha256(Q.effective_text()))
        keys = ["project_id", "id", "content_sha256"]
        # dealt by key first, so that rows are sorted once, where they are compared
        fresh = keyed.repartition(*keys).dropDuplicates(keys)
        if number > 0:
            earlier = spark.read.parquet(path).filter(F.col("batch") < number)
            fresh = fresh.join(earlier.select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if handle is not None:
            handle(spark.read.parquet(f"{path}/batch={number}"))

    return run


def stream_new_blocks(blocks: DataFrame, time_column: str, delay: str = "1 hour") -> DataFrame:
    """Bounded-state form: repeats within the delay are dropped."""
    return (
        blocks.withColumn("content_sha256", X.text_sha256(Q.effective_text()))
        .withWatermark(time_column, delay)
        .dropDuplicatesWithinWatermark(["project_id", "id", "content_sha256"])
    )


def stream_duplicate_identifiers(blocks: DataFrame) -> DataFrame:
    """Identifiers with their block count so far (update mode); more than one is a duplicate.

    The state per identifier is one counter, whatever the number of its blocks.
    """
    text = Q.effective_text()
    ids = blocks.filter((F.lower("block_type") == "identifier") & ~Q.token_only(text))
    return ids.groupBy("project_id", text.alias("identifier")).agg(F.count(F.lit(1)).alias("copies"))


def stream_job_progress(events: DataFrame) -> DataFrame:
    """Latest record per project (update mode): one struct of state per project."""
    rest = [c for c in events.columns if c != "project_id"]
    newest = events.groupBy("project_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "job_id")).alias("_j"))
    return newest.select("project_id", "_j.*")


def interrupted(latest: DataFrame, now, silence: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Active jobs whose last event is older than the allowed silence are interrupted."""
    stale = F.col("created_at").cast("timestamp") < F.lit(now).cast("timestamp") - F.expr(silence)
    marked = mark_interrupted(latest.filter(stale))
    return marked.unionByName(latest.filter(~stale).withColumn("interrupted", F.lit(False)))
