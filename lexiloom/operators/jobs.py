"""Background job records and acquisition outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom import constants as K

FAILURES = {
    "key_or_request": "API_KEY_OR_REQUEST_INVALID",
    "permission": "PERMISSION_DENIED",
    "model": "MODEL_NOT_FOUND",
    "quota": "QUOTA_EXCEEDED",
    "temporary": "TEMPORARILY_UNAVAILABLE",
    "network": "NETWORK_ERROR",
}


def _code(kind: str) -> Column:
    return F.concat(F.upper("provider"), F.lit("_" + FAILURES[kind]))


def classify_failure(log: DataFrame) -> DataFrame:
    """Failure code and retry flag of a log (``provider``, ``http_status``, ``error_kind``)."""
    status = F.col("http_status")
    code = (
        F.when(status.isin(400, 401), _code("key_or_request"))
        .when(status == 403, _code("permission"))
        .when(status == 404, _code("model"))
        .when(status == 429, _code("quota"))
        .when((status == 408) | status.between(500, 599), _code("temporary"))
        .when(status.isNull() & F.col("error_kind").isin("connection", "timeout"), _code("network"))
        .otherwise("SOURCE_PROCESSING_FAILED")
    )
    again = status.isNull() | status.isin(408, 429) | ((status == 409) & (F.col("provider") == "openai")) | ~status.between(400, 499)
    return log.withColumn("failure_code", code).withColumn("retryable", again)


def latest_job(jobs: DataFrame, kind: bool = False) -> DataFrame:
    """Newest job per project (and kind); one partial aggregate, no window."""
    keys = ["project_id", "kind"] if kind else ["project_id"]
    rest = [c for c in jobs.columns if c not in keys]
    newest = jobs.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("created_at", "job_id")).alias("_j"))
    return newest.select(*keys, "_j.*")


def mark_interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs still active in a stored record were cut off."""
    active = F.col("status").isin(*K.ACTIVE_JOB_STATUSES)
    return jobs.withColumn("interrupted", active).withColumn("status", F.when(active, "interrupted").otherwise(F.col("status")))


def acquisition_outcome(items: DataFrame) -> DataFrame:
    """Per run: succeeded, partial or failed, with counts (``ok, cached, needs_review, failure_code``)."""
    counts = items.groupBy("project_id", "run_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("ok").alias("successful"),
        F.count_if(F.col("ok") & F.col("cached")).alias("cached"),
        F.count_if(F.col("ok") & F.col("needs_review")).alias("needs_review"),
        F.count_if(~F.col("ok")).alias("failures"),
    )
    return counts.withColumn(
        "outcome",
        F.when(F.col("failures") == 0, "succeeded").when(F.col("successful") == 0, "failed").otherwise("partial"),
    )


def failure_counts(items: DataFrame) -> DataFrame:
    return items.filter(~F.col("ok")).groupBy("project_id", "run_id", "failure_code").agg(F.count(F.lit(1)).alias("n"))
