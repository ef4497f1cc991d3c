"""Checks on (source, translation) pairs: one pass per pair after one term look-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.functions import items as I
from lexiloom.functions import text as X
from lexiloom.operators.translation import active_variants, index_hits

# code: severity
RULES = {
    "curly_token_changed": "error", "square_token_changed": "error", "html_tag_changed": "error",
    "number_changed": "error", "approved_term_missing": "error", "keep_term_changed": "error",
    "empty_translation": "error", "replacement_character": "error", "unresolved_illegible": "error",
    "keep_rule_applied": "info", "unchanged_translation": "warning", "target_script_missing": "warning",
}
# Script a translation is expected to use, per target language.
TARGET_SCRIPT = {"ko": K.HANGUL}


def _finding(code: str, detail: Column) -> Column:
    return F.struct(F.lit(RULES[code]).alias("severity"), F.lit(code).alias("code"), detail.cast("string").alias("detail"))


def _one(code: str, bad: Column, detail: Column | None = None) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(_finding(code, F.lit(None) if detail is None else detail)))


def _changed(code: str, bad: Column, source: Column, target: Column) -> Column:
    return _one(code, bad, F.concat(I.format_multiset(source), F.lit(" / "), I.format_multiset(target)))


PRESERVED = {"curly_token_changed": K.CURLY, "square_token_changed": K.SQUARE, "html_tag_changed": K.HTML_TAG, "number_changed": K.NUMBER}
# The sign without which a text has no such item.
OPENS_WITH = {"curly_token_changed": "{", "square_token_changed": "[", "html_tag_changed": "<"}


def _items(code: str, text: Column) -> Column:
    found = I.find_all(text, PRESERVED[code])
    if code not in OPENS_WITH:
        return found
    return F.when(F.contains(text, F.lit(OPENS_WITH[code])), found).when(text.isNotNull(), F.array().cast("array<string>"))


def with_items(pairs: DataFrame) -> DataFrame:
    """``pairs`` (text, target) with what the rules look at many times: the items of both sides, the lower-case target and the scripts."""
    items = {f"_{code}_{side}": _items(code, F.col(side)) for code in PRESERVED for side in ("text", "target")}
    return pairs.withColumns({**items, "_low": F.lower("target"), "_latin": F.col("text").rlike(K.LATIN), "_hangul": F.col("target").rlike(K.HANGUL)})


def preserved_findings(source: Column) -> list[Column]:
    """Tokens, tags and numbers that the translation must repeat."""
    found = []
    for code in PRESERVED:
        a, b = F.col(f"_{code}_text"), F.col(f"_{code}_target")
        bad = I.numbers_changed(a, b, I.number_words(source)) if code == "number_changed" else ~I.multiset_equal(a, b)
        found.append(_changed(code, bad, a, b))
    return found


def qa_index(termbase: DataFrame) -> DataFrame:
    """One row per active variant, with an entry ``e`` that holds what the rules ask of each hit, made once a term.

    ``expected``: what the lower-case target must contain. ``signs``: whether a kept variant has other signs than one word's,
    ``open``: whether it has them at both ends. Hits of an approved term are one, whichever variant was met.
    """
    kept = F.col("status") == "keep"
    own = lambda column: F.when(kept, column)
    entry = F.struct(
        "candidate_id", "source_term", "status", F.lower(X.strip(F.when(kept, F.col("variant")).otherwise(F.col("translation")))).alias("expected"),
        own(F.col("variant")).alias("variant"), own(~I.single_word(X.strip("variant"))).alias("signs"), own(I.open_variant(X.strip("variant"))).alias("open"),
    )
    return active_variants(termbase).select("project_id", "variant", entry.alias("e"))


def _expected(hit: Column, field: str) -> Column:
    return F.lower(X.strip(hit[field]))


def term_findings(low: Column, expected: Callable[[Column, str], Column] = _expected) -> list[Column]:
    """Approved terms need their translation once; keep terms one of the variants found. ``low``: the lower-case target.

    ``hits`` are sorted by term; ``expected`` gives what a hit's field (translation or variant) asks of the target.
    """
    hits = F.col("hits")
    named = lambda h, field: F.contains(low, expected(h, field))
    terms = lambda found: I.each_once(F.transform(found, lambda h: F.struct(h["candidate_id"].alias("id"), h["source_term"].alias("term"))))
    approved = terms(F.filter(hits, lambda h: (h["status"] == "approved") & ~named(h, "translation")))
    kept_ids = lambda keep: F.transform(F.filter(keep, lambda h: named(h, "variant")), lambda h: h["candidate_id"])
    without = lambda keep, ids: terms(F.filter(keep, lambda h: ~F.array_contains(ids, h["candidate_id"])))
    # the ids found are listed once a text, not once for every hit
    lost = X.once(F.filter(hits, lambda h: h["status"] == "keep"), lambda keep: X.once(kept_ids(keep), lambda ids: without(keep, ids)))
    return [
        F.transform(approved, lambda t: _finding("approved_term_missing", t["term"])),
        F.transform(lost, lambda t: _finding("keep_term_changed", t["term"])),
    ]


def may_be_kept(source: Column, keep: Column) -> Column:
    """False where ``latin_fully_kept`` is sure to be: a Latin word, the first or a later one, is in no kept hit, and none makes new words."""
    low = X.fold(source)
    first = lambda w: F.exists(keep, lambda h: h["open"] | F.when(h["signs"], F.contains(X.fold(h["expected"]), w)).otherwise(X.fold(h["expected"]) == w))
    later = F.size(F.array_except(I.find_all(low, I.LATIN_WORD), F.transform(keep, lambda h: X.fold(h["expected"])))) == 0
    return X.once(F.regexp_extract(low, I.LATIN_WORD, 0), first) & (F.exists(keep, lambda h: h["signs"]) | later)


def script_findings(source: Column, target: Column, language: str) -> list[Column]:
    """At most one of: kept on purpose, left untranslated, wrong script."""
    keep = F.filter("hits", lambda h: h["status"] == "keep")
    variants = F.transform(keep, lambda h: h["variant"])
    kept = ~F.col("_hangul") & may_be_kept(source, keep) & I.latin_fully_kept(source, variants)
    script = TARGET_SCRIPT.get(language.lower())
    wrong = F.lit(False) if not script else ~F.col("_hangul") if script == K.HANGUL else ~target.rlike(script)
    found = (
        F.when(kept, F.array(_finding("keep_rule_applied", F.lit(None))))
        .when(target == source, F.array(_finding("unchanged_translation", F.lit(None))))
        .when(wrong, F.array(_finding("target_script_missing", F.lit(None))))
    )
    return [F.when(F.col("_latin"), found)]


def run_translation_qa(pairs: DataFrame, termbase: DataFrame, language: str = "ko") -> DataFrame:
    """Issues of all rules. ``pairs``: project_id, block_id, source_text, translated_text."""
    texts = pairs.select(
        "project_id", F.col("block_id").alias("text_id"), F.col("source_text").alias("text"),
        F.col("translated_text").alias("target"),
    )
    with_terms = with_items(index_hits(texts, qa_index(termbase)))
    source, target = F.col("text"), F.col("target")
    rules = [
        _one("replacement_character", F.contains(target, F.lit(K.REPLACEMENT_CHAR))),
        _one("unresolved_illegible", F.contains(target, F.lit("[")) & F.contains(F.upper(target), F.lit(K.ILLEGIBLE))),
        *preserved_findings(source),
        *term_findings(F.col("_low"), lambda hit, _: hit["expected"]),
        *script_findings(source, target, language),
    ]
    blank = F.coalesce(target, F.lit("")) == ""
    filled = [F.when(~blank, rule) for rule in rules]
    return (
        with_terms.withColumn("_rule", F.explode(F.array(_one("empty_translation", blank), *filled)))
        .withColumn("f", F.explode("_rule"))
        .select(
            "project_id", F.col("text_id").alias("block_id"), F.col("f.severity").alias("severity"),
            F.col("f.code").alias("code"), F.col("f.detail").alias("detail"),
        )
    )


def qa_summary(issues: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts per project and whether it passed (no errors)."""
    totals = pairs.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_blocks"))
    counts = issues.groupBy("project_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"),
        F.count_if((F.col("severity") == "error") & F.col("code").isin(*K.NON_OVERRIDABLE)).alias("blocking_errors"),
    )
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    joined = totals.join(counts, "project_id", "left").select(
        "project_id", "total_blocks", zero("errors"), zero("warnings"), zero("infos"), zero("blocking_errors")
    )
    return joined.withColumn("passed", F.col("errors") == 0)


def translation_finalize_gate(summary: DataFrame, overrides: DataFrame) -> DataFrame:
    """Decision per project. ``overrides``: project_id, reason (null for none)."""
    reason = X.strip(F.coalesce("reason", F.lit("")))
    joined = summary.join(overrides, "project_id", "left").withColumn("_reason", reason)
    asked = F.col("_reason") != ""
    return joined.withColumn(
        "decision",
        F.when(F.length("_reason") > K.MAX_OVERRIDE_REASON, "reason_too_long")
        .when(asked & (F.col("errors") == 0), "override_without_errors")
        .when(asked & (F.col("blocking_errors") > 0), "blocked")
        .when(F.col("errors") == 0, "finalized")
        .when(asked, "overridden")
        .otherwise("qa_failed"),
    ).drop("_reason")
