"""A user's model function over a table of requests, with one informed second try."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import translation as T
from lexiloom.session import settle

Answer = Callable[[list[str], list[str]], list[str | None]]
Check = Callable[[str, str], tuple[str, str]]


def apply_model(requests: DataFrame, answer: Answer, check: Check, request: str = "request", max_attempts: int = 2) -> DataFrame:
    """Adds ``response``, ``attempts`` and ``problems`` to every request row.

    ``answer`` maps requests and feedback texts to responses, a batch at a time. ``check`` returns
    (structural problem, content problem). A structurally valid answer with content problems is
    kept for review; one without structure is null. Requests are spread by Spark, in Arrow batches. An
    exception of ``answer`` becomes the problem of the requests it was given, so that answers of other
    batches are not lost with it. The result calls the model each time it is read: store it first.
    """
    columns = requests.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch[request].tolist()
            size = len(asked)
            best: list[str | None] = [None] * size
            issues, tries = [""] * size, [0] * size
            open_rows = list(range(size))
            for _ in range(max_attempts):
                if not open_rows:
                    break
                try:
                    replies = answer([asked[i] for i in open_rows], [issues[i] for i in open_rows])
                    failed = "no answer"
                except Exception as error:  # noqa: BLE001  (a user's function; its failure is a problem of these rows)
                    replies, failed = [None] * len(open_rows), f"model error: {type(error).__name__}: {error}"
                again = []
                for i, reply in zip(open_rows, replies):
                    tries[i] += 1
                    shape, content = check(asked[i], reply) if reply is not None else (failed, "")
                    if not shape:
                        best[i] = reply
                    issues[i] = shape or content
                    if issues[i]:
                        again.append(i)
                open_rows = again
            yield batch.assign(response=best, attempts=tries, problems=issues)

    extra = "response string, attempts long, problems string"
    fields = ", ".join(f"`{c}` {t}" for c, t in requests.select(*columns).dtypes)
    return requests.mapInPandas(run, f"{fields}, {extra}")


def retry_failed(segments: DataFrame, issues: DataFrame, answer: Answer, check: Check) -> tuple[DataFrame, DataFrame]:
    """Failed blocks translated again, one request each with its errors as feedback.

    A project in which one answer stays bad keeps all its texts. Returns (segments, change log).
    """
    failed = T.failed_blocks(segments, issues)
    told = issues.filter(F.col("severity") == "error").groupBy("project_id", F.col("block_id").alias("source_block_id")).agg(
        F.array_join(F.array_sort(F.collect_set("code")), "\n").alias("feedback")
    )
    body = F.to_json(F.struct("source_block_id", "source_text", "feedback"))
    asked = failed.join(told, ["project_id", "source_block_id"]).select("project_id", "source_block_id", body.alias("request"))
    # read by the segments and by the log: stored, so that the model is called once and both agree
    answered = settle(apply_model(asked, answer, check))
    clean = (F.col("problems") == "") & ~X.is_blank("response")
    retried = answered.select("project_id", "source_block_id", F.when(clean, X.strip("response")).alias("new_text"))
    return T.merge_retries(segments, retried)
