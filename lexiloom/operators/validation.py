"""Row validation: every rule a row breaks is listed in ``violations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.functions import text as X


def with_violations(df: DataFrame, rules: dict[str, Column], out: str = "violations") -> DataFrame:
    """``rules`` maps a code to the condition under which the row is bad."""
    found = [F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in rules.items()]
    return df.withColumn(out, F.array_compact(F.array(*found)))


def invalid(df: DataFrame) -> DataFrame:
    return df.filter(F.size("violations") > 0)


def _c(name: str) -> Column:
    return F.col(name)


def _not_in(name: str, values: tuple[str, ...]) -> Column:
    return ~F.coalesce(_c(name).isin(*values), F.lit(False))


def _not_like(name: str, pattern: str) -> Column:
    return ~F.coalesce(_c(name).rlike(pattern), F.lit(False))


def _not_positive(name: str) -> Column:
    return ~F.coalesce(_c(name) > 0, F.lit(False))


def bad_box(box: Column) -> Column:
    """Null boxes are fine; others need four ordered numbers within 0..1000."""
    inside = F.forall(box, lambda v: v.isNotNull() & v.between(0, 1000))
    ordered = (F.get(box, F.lit(0)) <= F.get(box, F.lit(2))) & (F.get(box, F.lit(1)) <= F.get(box, F.lit(3)))
    return box.isNotNull() & ~F.coalesce((F.size(box) == 4) & inside & ordered, F.lit(False))


def _has_null(name: str) -> Column:
    return _c(name).isNull() | F.exists(_c(name), lambda v: v.isNull())


def validate_blocks(df: DataFrame) -> DataFrame:
    return with_violations(
        df,
        {
            "schema_version": ~F.coalesce(_c("schema_version") == K.SCHEMA_VERSION, F.lit(False)),
            "id": _not_like("id", K.BLOCK_ID),
            "source_type": _not_in("source_type", K.SOURCE_TYPES),
            "source_file": X.is_blank("source_file"),
            "page": _c("page").isNotNull() & (_c("page") <= 0),
            "source_order": _not_positive("source_order"),
            "block_order": _not_positive("block_order"),
            "block_type": X.is_blank("block_type"),
            "raw_text": X.is_blank("raw_text"),
            "bbox": bad_box(_c("bbox")),
            "legibility": _c("legibility").isNotNull() & _not_in("legibility", K.LEGIBILITY),
            "status": _not_in("status", K.BLOCK_STATUSES),
            "warnings": _has_null("warnings"),
            "source_refs": _has_null("source_refs") | F.exists(_c("source_refs"), lambda v: v == ""),
            "source_hash": _not_like("source_hash", K.SHA256_PREFIXED),
        },
    )


def validate_issues(df: DataFrame) -> DataFrame:
    return with_violations(
        df,
        {
            "id": _not_like("id", K.ISSUE_ID),
            "block_id": F.coalesce(_c("block_id"), F.lit("")) == "",
            "severity": _not_in("severity", K.SEVERITIES),
            "code": _not_like("code", K.ISSUE_CODE),
            "message": F.coalesce(_c("message"), F.lit("")) == "",
            "evidence": F.coalesce(_c("evidence"), F.lit("")) == "",
            "source_file": F.coalesce(_c("source_file"), F.lit("")) == "",
            "page": _c("page").isNotNull() & (_c("page") <= 0),
            "bbox": _c("bbox").isNotNull() & (F.size("bbox") != 4),
        },
    )


def _segment_rules(df: DataFrame, digests: tuple[str, ...], texts: tuple[str, ...]) -> dict[str, Column]:
    rules = {
        "schema_version": ~F.coalesce(_c("schema_version") == K.SCHEMA_VERSION, F.lit(False)),
        "source_block_id": _not_like("source_block_id", K.BLOCK_ID),
        "source_file": F.coalesce(_c("source_file"), F.lit("")) == "",
        "page": _c("page").isNotNull() & (_c("page") <= 0),
        "source_order": _not_positive("source_order"),
    }
    rules.update({name: X.is_blank(name) for name in texts})
    rules.update({name: _not_like(name, K.SHA256_HEX) for name in digests})
    return rules


def _wrong_hash(text: Column, digest: str) -> Column:
    return ~F.coalesce(X.text_sha256(text) == _c(digest), F.lit(False))


def validate_segments(df: DataFrame) -> DataFrame:
    rules = _segment_rules(
        df,
        ("source_sha256", "translation_sha256", "prompt_sha256", "termbase_sha256"),
        ("block_type", "source_text", "translated_text", "model"),
    )
    rules["source_text_hash"] = _wrong_hash(_c("source_text"), "source_sha256")
    rules["translated_text_hash"] = _wrong_hash(_c("translated_text"), "translation_sha256")
    rules["status"] = _not_in("status", K.SEGMENT_STATUSES)
    return with_violations(df, rules)


def effective_translation() -> Column:
    return F.coalesce(F.nullif(_c("corrected_translation"), F.lit("")), _c("draft_translation"))


def validate_approved(df: DataFrame) -> DataFrame:
    rules = _segment_rules(
        df,
        ("source_sha256", "draft_translation_sha256", "final_translation_sha256", "prompt_sha256", "termbase_sha256"),
        ("block_type", "source_text", "draft_translation", "model"),
    )
    corrected = _c("corrected_translation")
    rules["corrected_blank"] = corrected.isNotNull() & X.is_blank("corrected_translation")
    rules["corrected_unchanged"] = F.coalesce(corrected == _c("draft_translation"), F.lit(False))
    rules["source_text_hash"] = _wrong_hash(_c("source_text"), "source_sha256")
    rules["draft_translation_hash"] = _wrong_hash(_c("draft_translation"), "draft_translation_sha256")
    rules["effective_translation_hash"] = _wrong_hash(effective_translation(), "final_translation_sha256")
    rules["status"] = ~F.coalesce(_c("status") == "approved", F.lit(False))
    return with_violations(df, rules)


def validate_ocr(df: DataFrame) -> DataFrame:
    """Rows of OCR blocks (``type, text, bbox, legibility``)."""
    return with_violations(
        df.withColumn("text", X.strip("text")),
        {
            "type": _not_in("type", K.OCR_TYPES),
            "text": X.is_blank("text"),
            "bbox": _c("bbox").isNull() | bad_box(_c("bbox")),
            "legibility": _not_in("legibility", K.LEGIBILITY),
        },
    )


def ocr_status(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """One status per image; an image without blocks arrives as a row with a null text."""
    doubt = (_c("legibility") == "uncertain") | F.contains(_c("text"), F.lit(K.ILLEGIBLE))
    return blocks.groupBy(*keys).agg(
        F.count("text").alias("blocks"),
        F.when((F.count("text") == 0) | F.coalesce(F.bool_or(doubt), F.lit(False)), F.lit("needs_review"))
        .otherwise(F.lit("complete"))
        .alias("status"),
    )


def validate_layout_shape(df: DataFrame) -> DataFrame:
    """Rows of model answers with a parsed ``layout`` struct (null when it is not an object)."""
    blocks = _c("layout")["blocks"]
    any_bad = lambda test: F.coalesce(F.exists(blocks, test), F.lit(False))
    return with_violations(
        df,
        {
            "blocks": blocks.isNull(),
            "fragment_ids": any_bad(lambda b: b["fragment_ids"].isNull() | F.coalesce(F.exists(b["fragment_ids"], lambda v: v.isNull()), F.lit(False))),
            "type": any_bad(lambda b: ~F.coalesce(b["type"].isin(*K.LAYOUT_TYPES), F.lit(False))),
            "include_in_text": any_bad(lambda b: b["include_in_text"].isNull()),
            "reason": any_bad(lambda b: b["reason"].isNull()),
        },
    )


def validate_glossary_rows(df: DataFrame, compatibility: bool = True) -> DataFrame:
    """Checks on hand-reviewed rows; keep rows come back with translation = source term."""
    norm = (lambda c: X.normalized_term(c)) if compatibility else (lambda c: F.lower(X.collapse(c)))
    clean = df.select(
        *[c for c in df.columns if c not in K.GLOSSARY_COLUMNS],
        X.strip("status").alias("status"),
        X.collapse("source_term").alias("source_term"),
        X.strip("translation").alias("translation"),
        X.strip("category").alias("category"),
        X.strip("note").alias("note"),
        "variants", "occurrences", "locations", "example",
        X.strip("candidate_id").alias("candidate_id"),
    )
    keep_differs = (_c("status") == "keep") & (_c("translation") != "") & (norm(_c("translation")) != norm(_c("source_term")))
    checked = with_violations(
        clean,
        {
            "invalid_status": _not_in("status", K.GLOSSARY_STATUSES),
            "review_incomplete": _c("status") == "review",
            "empty_term": _c("source_term") == "",
            "protected_token": _c("source_term").rlike(r"[{}]"),
            "invalid_category": _not_in("category", K.GLOSSARY_CATEGORIES),
            "approved_without_translation": (_c("status") == "approved") & (_c("translation") == ""),
            "keep_differs": keep_differs,
        },
    )
    return checked.withColumn(
        "translation", F.when(_c("status") == "keep", _c("source_term")).otherwise(_c("translation"))
    )


def _bad_timestamp(name: str, optional: bool, need_zone: bool) -> Column:
    c = _c(name)
    bad = F.try_to_timestamp(c).isNull()
    if need_zone:
        bad = bad | ~c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return c.isNotNull() & bad if optional else c.isNull() | bad


def validate_manifests(df: DataFrame, compatibility: bool = True) -> DataFrame:
    return with_violations(
        df,
        {
            "schema_version": ~F.coalesce(_c("schema_version") == K.PROJECT_SCHEMA_VERSION, F.lit(False)),
            "project_id": ~F.coalesce(X.normalize_project_id("project_id", compatibility) == _c("project_id"), F.lit(False)),
            "name": X.is_blank("name"),
            "profile": X.is_blank("profile"),
            "source_language": _not_like("source_language", K.LANGUAGE_CODE),
            "target_language": _not_like("target_language", K.LANGUAGE_CODE),
            "source_file": _c("source_file").isNotNull() & ~X.clean_path("source_file"),
            "created_at": _bad_timestamp("created_at", False, False),
        },
    )


def acquisition_gate(df: DataFrame) -> DataFrame:
    """Runs that finished completely (``status``, ``failures`` array)."""
    return df.filter((_c("status") == "complete") & (F.coalesce(F.size("failures"), F.lit(0)) <= 0))


def assert_keys(df: DataFrame, key: str = "id", group: str = "project_id") -> DataFrame:
    """Per project: row count, distinct ids, order range, and whether the keys are sound.

    Counting ids per value first keeps the aggregate small on the hot project.
    """
    per_id = df.groupBy(group, key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("source_order").alias("_lo"), F.max("source_order").alias("_hi")
    )
    agg = per_id.groupBy(group).agg(
        F.sum("_n").cast("long").alias("rows"),
        F.count(F.lit(1)).alias("ids"),
        F.min("_lo").alias("first_order"),
        F.max("_hi").alias("last_order"),
    )
    return agg.withColumn(
        "sound", (_c("rows") == _c("ids")) & (_c("first_order") == 1) & (_c("last_order") == _c("rows"))
    )


def validate_jobs(df: DataFrame) -> DataFrame:
    statuses = K.ACTIVE_JOB_STATUSES + K.TERMINAL_JOB_STATUSES
    rules = {name: F.coalesce(_c(name), F.lit("")) == "" for name in ("job_id", "project_id", "progress_message")}
    rules["status"] = _not_in("status", statuses)
    for name in ("progress_current", "progress_total"):
        rules[name] = _c(name).isNotNull() & (_c(name) < 0)
    rules["progress_range"] = F.coalesce(_c("progress_current") > _c("progress_total"), F.lit(False))
    for name in ("created_at", "updated_at"):
        rules[name] = _bad_timestamp(name, False, True)
    for name in ("started_at", "finished_at"):
        rules[name] = _bad_timestamp(name, True, True)
    return with_violations(df, rules)
