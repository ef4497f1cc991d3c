"""Queries for block tables: validation, source QA and its counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.catalog import sqlviews as S
from lexiloom.catalog.registry import register
from lexiloom.catalog.sqlviews import view
from lexiloom.functions import text as X
from lexiloom.operators import source_qa as Q
from lexiloom.operators import validation as VAL
from lexiloom.plans import testviews as V
from lexiloom.sources import readers as R


def joined(name: str):
    return F.array_join(name, ",").alias(name)


# --- Source QA ------------------------------------------------------------------------------

def _issue(code: str, where: str, evidence: str = "eff", source: str = "v_block") -> str:
    severity = Q.RULES[code][0]
    return (
        f"SELECT project_id, id AS block_id, source_order, '{severity}' AS severity, '{code}' AS code, "
        f"{S.evidence(evidence)} AS evidence FROM {source} WHERE {where}"
    )


_TOKEN = r"\{([A-Za-z][A-Za-z0-9_]*)\}"
_ONLY = r"regexp_matches(eff, '^\{[A-Za-z][A-Za-z0-9_]*\}$')"
_CONFUSED = (
    r"list_sort(list_distinct(list_filter(regexp_extract_all(eff, '[A-Za-z0-9]+(?:[/-][A-Za-z0-9]+)*'), "
    r"lambda w: regexp_matches(w, '[0-9]') AND regexp_matches(w, '[OIl]'))))"
)
_SQL = {
    "SOURCE_HASH_MISMATCH": _issue("SOURCE_HASH_MISMATCH", "source_hash <> 'sha256:' || sha256(raw_text)"),
    "OCR_UNCERTAIN": _issue("OCR_UNCERTAIN", "legibility = 'uncertain'"),
    "SOURCE_WARNING": _issue("SOURCE_WARNING", "len(warnings) > 0", "array_to_string(warnings, ' | ')"),
    "OCR_ILLEGIBLE": _issue("OCR_ILLEGIBLE", "contains(upper(eff), '[ILLEGIBLE]')"),
    "ICON_UNRESOLVED": _issue(
        "ICON_UNRESOLVED", r"regexp_matches(eff, '(?i)\[ICON:\s*[^\]]+\]')",
        r"array_to_string(regexp_extract_all(eff, '(?i)\[ICON:\s*[^\]]+\]'), ', ')",
    ),
    "UNICODE_REPLACEMENT": _issue("UNICODE_REPLACEMENT", f"contains(eff, '{K.REPLACEMENT_CHAR}')"),
    "TOKEN_MALFORMED": _issue("TOKEN_MALFORMED", rf"regexp_matches(regexp_replace(eff, '{_TOKEN}', '', 'g'), '[{{}}]')"),
    "TOKEN_UNKNOWN": _issue("TOKEN_UNKNOWN", "TRUE", "'{' || token || '}'", "v_unknown_token"),
    "ICON_FILENAME_LITERAL": _issue(
        "ICON_FILENAME_LITERAL", "TRUE", "stem",
        r"(SELECT *, unnest(regexp_extract_all(eff, '(?i)\b([A-Za-z][A-Za-z0-9_]*)\.(?:png|jpe?g|webp|gif|bmp)\b', 1)) AS stem FROM v_block)",
    ),
    "OCR_ALNUM_CONFUSION": _issue("OCR_ALNUM_CONFUSION", f"len({_CONFUSED}) > 0", f"array_to_string({_CONFUSED}, ', ')"),
    "IDENTIFIER_FORMAT": _issue(
        "IDENTIFIER_FORMAT",
        rf"block_type = 'identifier' AND NOT {_ONLY} AND NOT regexp_matches(eff, '^[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*$')",
    ),
    "WHITESPACE_SUSPICIOUS": _issue("WHITESPACE_SUSPICIOUS", "regexp_matches(eff, chr(9) || '| {3,}')"),
    "BLOCK_TOO_LONG": _issue("BLOCK_TOO_LONG", "length(eff) > 5000"),
    "IDENTIFIER_DUPLICATE": _issue(
        "IDENTIFIER_DUPLICATE", "copies > 1", "eff",
        f"(SELECT *, count(*) OVER (PARTITION BY project_id, eff) AS copies FROM v_block WHERE block_type = 'identifier' AND NOT {_ONLY})",
    ),
}
view(
    "v_unknown_token",
    rf"""SELECT b.*, u.token FROM (SELECT DISTINCT project_id, id, unnest(regexp_extract_all(eff, '{_TOKEN}', 1)) AS token FROM v_block) u
  JOIN v_block b ON b.project_id = u.project_id AND b.id = u.id
  WHERE u.project_id IN (SELECT project_id FROM v_token)
    AND NOT EXISTS (SELECT 1 FROM v_token k WHERE k.project_id = u.project_id AND k.token = u.token)""",
)
_PER_BLOCK = " UNION ALL ".join(v for k, v in _SQL.items() if k != "IDENTIFIER_DUPLICATE")
view("v_rule", _PER_BLOCK)
_SQL["SOURCE_PRE_FLAGGED"] = _issue(
    "SOURCE_PRE_FLAGGED",
    "status = 'flagged' AND NOT EXISTS (SELECT 1 FROM v_rule r WHERE r.project_id = b.project_id AND r.block_id = b.id "
    "AND r.severity <> 'info')",
    source="v_block b",
)
view("v_issue0", f"SELECT * FROM v_rule UNION ALL {_SQL['SOURCE_PRE_FLAGGED']} UNION ALL {_SQL['IDENTIFIER_DUPLICATE']}")
view(
    "v_issue",
    "SELECT *, 'qa-' || substr(sha256(block_id || '|' || code || '|' || evidence), 1, 16) AS id FROM v_issue0",
)


def issues(spark, sf_dir):
    return Q.run_source_qa(V.blocks(spark, sf_dir), R.allowed_tokens(V.prompts(spark, sf_dir), "prompt"))


def unordered_issues(spark, sf_dir):
    return Q.run_source_qa(V.block_rows(spark, sf_dir), R.allowed_tokens(V.prompts(spark, sf_dir), "prompt"))


_COLUMNS = ("project_id", "block_id", "severity", "code", "evidence", "id")
register(
    "run_source_qa",
    lambda s, d: Q.order_issues(issues(s, d)).select(*_COLUMNS, "source_order"),
    "SELECT project_id, block_id, severity, code, evidence, id, source_order FROM v_issue",
)


def _rule(code: str) -> None:
    def query(spark, sf_dir):
        if code == "IDENTIFIER_DUPLICATE":
            found = Q.duplicate_issues(V.block_rows(spark, sf_dir))
        elif code in ("TOKEN_UNKNOWN", "SOURCE_PRE_FLAGGED"):
            found = unordered_issues(spark, sf_dir)
        else:
            found = Q.block_issues(V.block_rows(spark, sf_dir))
        return found.filter(F.col("code") == code).select(*_COLUMNS)

    register(
        "rule_" + code.lower(), query,
        f"SELECT project_id, block_id, severity, code, evidence, id FROM v_issue WHERE code = '{code}'",
    )


for _code in Q.RULES:
    _rule(_code)

register(
    "unknown_tokens",
    lambda s, d: Q.unknown_tokens(V.block_rows(s, d), R.allowed_tokens(V.prompts(s, d), "prompt")),
    "SELECT project_id, id AS block_id, token FROM v_unknown_token",
)
register(
    "allowed_tokens",
    lambda s, d: R.allowed_tokens(V.prompts(s, d), "prompt"),
    "SELECT project_id, token FROM v_token",
)
register(
    "duplicate_identifiers",
    lambda s, d: Q.duplicate_identifiers(V.block_rows(s, d)).select("project_id", "id", "identifier", "copies"),
    f"SELECT * FROM (SELECT project_id, id, eff AS identifier, count(*) OVER (PARTITION BY project_id, eff) AS copies FROM v_block "
    f"WHERE block_type = 'identifier' AND NOT {_ONLY}) WHERE copies > 1",
)
register(
    "severity_counts",
    lambda s, d: Q.severity_counts(unordered_issues(s, d)),
    "SELECT project_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, "
    "count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'error') AS overridable_errors, 0 AS blocking_errors "
    "FROM v_issue GROUP BY project_id",
)
register(
    "flagged_blocks",
    lambda s, d: Q.flagged_blocks(unordered_issues(s, d)),
    "SELECT project_id, count(DISTINCT block_id) AS flagged_blocks FROM v_issue WHERE severity <> 'info' GROUP BY project_id",
)
register(
    "order_issues",
    lambda s, d: Q.order_issues(issues(s, d)).select("project_id", "source_order", "code", "id"),
    "SELECT project_id, source_order, code, id FROM v_issue ORDER BY ALL",
)
register(
    "reviewable_issues",
    lambda s, d: Q.reviewable_issues(unordered_issues(s, d)).select("project_id", "block_id", "code", "id"),
    "SELECT project_id, block_id, code, id FROM v_issue WHERE code <> 'SOURCE_WARNING'",
)
register(
    "validation_issue_counts",
    lambda s, d: Q.issue_counts(unordered_issues(s, d)),
    "SELECT project_id, count(*) AS issues, count(DISTINCT block_id) AS issue_blocks FROM v_issue GROUP BY project_id",
)

# --- Validation -----------------------------------------------------------------------------


def broken_blocks(spark, sf_dir):
    n = F.col("doc_id") + F.col("line")
    return (
        V.blocks(spark, sf_dir)
        .withColumn("id", F.when(n % 71 == 0, F.concat(F.lit("Bad "), "id")).otherwise(F.col("id")))
        .withColumn("page", F.when(n % 73 == 0, F.lit(0)).otherwise(F.col("page")))
        .withColumn("bbox", F.when(n % 79 == 0, F.reverse("bbox")).when(n % 83 == 0, F.slice("bbox", 1, 3)).otherwise(F.col("bbox")))
        .withColumn("status", F.when(n % 89 == 0, F.lit("open")).otherwise(F.col("status")))
        .withColumn("raw_text", F.when(n % 101 == 0, F.lit(" \t")).otherwise(F.col("raw_text")))
        .withColumn("source_refs", F.when(n % 103 == 0, F.array(F.lit(""))).otherwise(F.col("source_refs")))
    )


register(
    "validate_blocks",
    lambda s, d: VAL.invalid(VAL.validate_blocks(broken_blocks(s, d))).select("project_id", "source_order", joined("violations")),
    """SELECT project_id, source_order, violations FROM (SELECT project_id, source_order, concat_ws(',',
      CASE WHEN (doc_id + line) % 71 = 0 THEN 'id' END, CASE WHEN (doc_id + line) % 73 = 0 THEN 'page' END,
      CASE WHEN (doc_id + line) % 101 = 0 THEN 'raw_text' END,
      CASE WHEN (doc_id + line) % 79 = 0 OR (doc_id + line) % 83 = 0 THEN 'bbox' END,
      CASE WHEN (doc_id + line) % 89 = 0 THEN 'status' END,
      CASE WHEN (doc_id + line) % 103 = 0 THEN 'source_refs' END) AS violations FROM v_block) WHERE violations <> ''""",
)
register(
    "assert_keys",
    lambda s, d: VAL.assert_keys(V.blocks(s, d).unionByName(V.blocks(s, d).filter("doc_id % 400 = 7"))),
    """SELECT project_id, count(*) AS rows, count(DISTINCT id) AS ids, min(source_order) AS first_order, max(source_order) AS last_order,
      count(*) = count(DISTINCT id) AND min(source_order) = 1 AND max(source_order) = count(*) AS sound
      FROM (SELECT * FROM v_block UNION ALL SELECT * FROM v_block WHERE doc_id % 400 = 7) GROUP BY project_id""",
)


def broken_issues(spark, sf_dir):
    n = F.pmod(F.length("evidence"), F.lit(5))
    return (
        unordered_issues(spark, sf_dir)
        .withColumn("code", F.when(n == 1, F.lower("code")).otherwise(F.col("code")))
        .withColumn("evidence", F.when(n == 2, F.lit("")).otherwise(F.col("evidence")))
        .withColumn("severity", F.when(n == 3, F.lit("fatal")).otherwise(F.col("severity")))
    )


register(
    "validate_issues",
    lambda s, d: VAL.invalid(VAL.validate_issues(broken_issues(s, d))).select("project_id", "block_id", "id", joined("violations")),
    """SELECT project_id, block_id, id, CASE length(evidence) % 5 WHEN 1 THEN 'code' WHEN 2 THEN 'evidence' ELSE 'severity' END AS violations
      FROM v_issue WHERE length(evidence) % 5 IN (1, 2, 3)""",
)
