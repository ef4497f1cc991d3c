"""What is current, stale or missing in each project: stored hashes against present ones.

A project row holds, per stage, the recorded state (null when the stage never ran) and the
hashes of the files as they are now (null when a file is missing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.operators import scale
from lexiloom.functions import text as X


def _same(*pairs: tuple[str, str]) -> Column:
    fine = F.lit(True)
    for stored, present in pairs:
        fine = fine & F.col(stored).eqNullSafe(F.col(present))
    return fine


def _is(name: str, value: str) -> Column:
    return F.col(name).eqNullSafe(F.lit(value))


def source_status(p: DataFrame) -> DataFrame:
    """Adds source_acquired, review_source_ready, qa_status, human_review."""
    return (
        p.withColumn("source_acquired", _is("acq_status", "complete") & (F.coalesce("acq_failures", F.lit(0)) == 0))
        .withColumn("review_source_ready", F.col("source_hash").isNotNull())
        .withColumn(
            "qa_status",
            F.when(~F.col("qa_ran"), "not_run")
            .when(~_is("qa_version", K.SOURCE_QA_VERSION) | ~_same(("qa_source_hash", "source_hash")), "stale")
            .otherwise("complete"),
        )
        .withColumn(
            "human_review",
            F.when(F.col("review_hash").isNull() | ~F.col("review_ran"), "not_ready")
            .when(~_same(("review_source_hash", "source_hash")), "stale")
            .when(
                _is("review_status", "approved")
                & _same(("review_stored_hash", "review_hash"), ("final_stored_hash", "final_hash"), ("approved_stored_hash", "approved_hash")),
                "approved",
            )
            .otherwise("pending"),
        )
    )


def glossary_status(p: DataFrame) -> DataFrame:
    """Adds glossary_status and termbase_status (needs ``human_review``)."""
    approved = F.col("human_review") == "approved"
    with_glossary = p.withColumn(
        "glossary_status",
        F.when(F.col("glossary_hash").isNull() | ~F.col("glossary_ran"), F.when(approved, "not_built").otherwise("not_ready"))
        .when(
            ~approved | ~_is("glossary_state", "complete") | ~_is("glossary_version", K.GLOSSARY_BUILD_VERSION)
            | ~_same(("glossary_approved_hash", "approved_hash")),
            "stale",
        )
        .otherwise("current"),
    )
    current = F.col("glossary_status") == "current"
    return with_glossary.withColumn(
        "termbase_status",
        F.when(F.col("termbase_hash").isNull() | ~F.col("termbase_ran"), F.when(current, "not_built").otherwise("not_ready"))
        .when(
            ~current | ~_is("termbase_state", "complete") | ~_is("termbase_version", K.TERMBASE_IMPORT_VERSION)
            | ~_same(("termbase_approved_hash", "approved_hash"), ("termbase_glossary_hash", "glossary_hash"), ("termbase_stored_hash", "termbase_hash")),
            "stale",
        )
        .otherwise("current"),
    )


def translation_status(p: DataFrame) -> DataFrame:
    ready = F.col("termbase_status") == "current"
    return p.withColumn(
        "translation_status",
        F.when(~F.col("translation_ran"), F.when(ready, "not_run").otherwise("not_ready"))
        .when(
            ~ready | ~_is("translation_version", K.TRANSLATION_RUN_VERSION)
            | ~_same(("translation_approved_hash", "approved_hash"), ("translation_termbase_hash", "termbase_hash"), ("translation_prompt_hash", "prompt_hash")),
            "stale",
        )
        .when(_is("translation_state", "partial"), "partial")
        .when(
            ~_is("translation_state", "complete") | F.col("translation_hash").isNull() | ~_same(("translation_stored_hash", "translation_hash")),
            "stale",
        )
        .otherwise("current"),
    )


def review_status(p: DataFrame) -> DataFrame:
    """Adds translation_review (needs ``translation_status``)."""
    has_review = F.col("tr_review_hash").isNotNull() | F.col("tr_ran")
    matching = _same(
        ("tr_output_stored", "translation_hash"), ("tr_termbase_stored", "termbase_hash"),
        ("tr_draft_stored", "draft_hash"), ("tr_review_stored", "tr_review_hash"),
    )
    return p.withColumn(
        "translation_review",
        F.when(F.col("translation_status") != "current", F.when(has_review, "stale").otherwise("not_ready"))
        .when(~_is("base_review_status", "current") | ~_same(("base_draft_hash", "draft_hash")), "stale")
        .when(~F.col("tr_ran"), "pending")
        .when(~_is("tr_version", K.TRANSLATION_REVIEW_VERSION) | ~matching, "stale")
        .when(_is("tr_state", "qa_failed"), "qa_failed")
        .when(_is("tr_state", "qa_passed"), "qa_passed")
        .when(_is("tr_state", "approved") & F.col("outputs_current"), "approved")
        .otherwise("stale"),
    )


def pipeline_status(p: DataFrame) -> DataFrame:
    return review_status(translation_status(glossary_status(source_status(p))))


def project_stage(p: DataFrame) -> DataFrame:
    """Adds ``stage`` and ``progress``: the furthest stage, by fixed priority."""
    review, run = F.col("translation_review"), F.col("translation_status")
    stage = (
        F.when(review == "approved", "completed")
        .when(run == "partial", "translation_partial")
        .when(review == "qa_failed", "translation_qa_failed")
        .when(review.isin("pending", "stale", "qa_passed") | (run == "current"), "translation_review")
        .when(F.col("termbase_status") == "current", "ready_to_translate")
        .when(F.col("glossary_status").isin("current", "stale"), "glossary_review")
        .when(F.col("human_review") == "approved", "glossary")
        .when(F.col("review_source_ready") | F.col("source_acquired"), "source_review")
        .otherwise("not_started")
    )
    table = F.create_map(*[F.lit(x) for pair in K.STAGE_PROGRESS.items() for x in pair])
    return p.withColumn("stage", stage).withColumn("progress", table[F.col("stage")].cast("long"))


def review_availability(p: DataFrame) -> DataFrame:
    """Which of the three reviews can be opened, and a reason code for each."""
    human, glossary = F.col("human_review"), F.col("glossary_status")
    run, review = F.col("translation_status"), F.col("translation_review")
    open_tr = (run == "current") & ~review.isin("not_ready", "stale")
    return (
        p.withColumn("source_open", human.isin("pending", "approved"))
        .withColumn("source_reason", F.when(F.col("source_open"), "open").when(human == "stale", "stale").otherwise("not_ready"))
        .withColumn("glossary_open", glossary == "current")
        .withColumn("glossary_reason", F.when(F.col("glossary_open"), "open").when(glossary == "stale", "stale").otherwise("not_ready"))
        .withColumn("translation_open", open_tr)
        .withColumn(
            "translation_reason",
            F.when(review == "qa_failed", "qa_failed").when(open_tr, "open").when(review == "stale", "stale").otherwise("not_ready"),
        )
    )


def portfolio_summary(p: DataFrame) -> DataFrame:
    """One row over all projects (``stage``, ``workspace_ready``)."""
    return p.agg(
        F.count(F.lit(1)).alias("projects"),
        F.count_if(~F.col("stage").isin("not_started", "completed")).alias("in_progress"),
        F.count_if(F.col("stage") == "completed").alias("completed"),
        F.count_if((F.col("stage") == "translation_qa_failed") | ~F.col("workspace_ready")).alias("needs_attention"),
    )


def detect_source_type(files: DataFrame) -> DataFrame:
    """pdf, images, mixed or null per project from its input paths; whether work has begun."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    inside = lambda folder: F.startswith("path", F.lit(folder))
    pdf = inside("01_input/") & (suffix == "pdf")
    image = inside(K.IMAGE_ROOT + "/") & suffix.isin(*K.IMAGE_SUFFIXES)
    derived = ~inside("01_input/") & (F.col("path") != "04_translation/prompt.txt")
    found = files.groupBy("project_id").agg(
        F.bool_or(pdf).alias("_pdf"), F.bool_or(image).alias("_image"), F.bool_or(derived).alias("processing_started")
    )
    kind = F.when(F.col("_pdf") & F.col("_image"), "mixed").when(F.col("_pdf"), "pdf").when(F.col("_image"), "images")
    return found.select("project_id", kind.alias("source_type"), "processing_started")


def invalidate_on_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Projects whose instructions changed, and whether that invalidates a translation run."""
    joined = before.select("project_id", "translation_status", F.col("prompt_hash").alias("old_hash")).join(
        after.select("project_id", F.col("prompt_hash").alias("new_hash")), "project_id"
    )
    return joined.filter(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).withColumn(
        "invalidated", F.col("translation_status").isin("partial", "current", "stale")
    )


def draft_vs_review_base(p: DataFrame) -> DataFrame:
    """A review file is made when missing, kept when its base is the present draft, else stale."""
    made = F.col("tr_review_hash").isNull()
    fits = _is("base_review_status", "current") & _same(("base_draft_hash", "draft_hash"))
    return p.withColumn("created", made).withColumn("base_status", F.when(made | fits, "current").otherwise("stale"))


def build_reuse(requests: DataFrame, builds: DataFrame, keys: list[str]) -> DataFrame:
    """``reuse``, ``stale`` (built from something else) or ``build`` per project."""
    have = builds.select("project_id", *[F.col(k).alias(f"_{k}") for k in keys]).withColumn("_built", F.lit(True))
    joined = requests.join(have, "project_id", "left")
    equal = F.lit(True)
    for k in keys:
        equal = equal & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return joined.withColumn(
        "action", F.when(F.col("_built").isNull(), "build").when(equal, "reuse").otherwise("stale")
    ).drop("_built", *[f"_{k}" for k in keys])


def verify_outputs(approved: DataFrame, files: DataFrame) -> DataFrame:
    """Approved outputs with ``state``: ok, bad_path, missing or changed."""
    have = files.select("project_id", "path", F.col("sha256").alias("_actual"))
    inside = X.clean_path("path") & F.startswith("path", F.lit(K.OUTPUT_ROOT + "/"))
    return approved.join(have, ["project_id", "path"], "left").withColumn(
        "state",
        F.when(~inside, "bad_path").when(F.col("_actual").isNull(), "missing")
        .when(F.col("_actual") != F.col("sha256"), "changed").otherwise("ok"),
    ).drop("_actual")


def order_outputs(outputs: DataFrame) -> DataFrame:
    name = F.substr("path", F.lit(len(K.OUTPUT_ROOT) + 2))
    return outputs.withColumn("name", name).orderBy("project_id", F.col("name") != K.COMBINED_OUTPUT, F.lower("name"))


def natural_order(files: DataFrame) -> DataFrame:
    return files.orderBy("project_id", X.natural_key("path"), "path")


def sidecar_prompts(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images with the hash of their ``<image>.prompt.txt`` file (null when there is none)."""
    prompts = files.select("project_id", F.col("path").alias("_p"), F.col("sha256").alias("prompt_hash"))
    return images.withColumn("_p", F.concat("path", F.lit(".prompt.txt"))).join(prompts, ["project_id", "_p"], "left").drop("_p")


def dataset_fingerprint(files: DataFrame, version: str = K.SOURCE_BLOCK_VERSION) -> DataFrame:
    return scale.content_fingerprint(files, ["project_id"], F.col("path"), F.col("sha256"), version)
