"""Quality rules on source text: all rules of a block in one pass over the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.functions import items as I
from lexiloom.functions import text as X
from lexiloom.operators import scale

# code: (severity, message)
RULES = {
    "SOURCE_HASH_MISMATCH": ("error", "Stored hash does not match the source text."),
    "OCR_UNCERTAIN": ("error", "Transcription marked this block as hard to read."),
    "SOURCE_WARNING": ("warning", "Extraction gave warnings for this block."),
    "OCR_ILLEGIBLE": ("error", "Text contains the illegible marker."),
    "ICON_UNRESOLVED": ("warning", "An icon has no known token."),
    "UNICODE_REPLACEMENT": ("error", "Text contains the replacement character."),
    "TOKEN_MALFORMED": ("error", "A brace is left outside a valid token."),
    "TOKEN_UNKNOWN": ("warning", "Token is not in the allowed list."),
    "ICON_FILENAME_LITERAL": ("warning", "An image file name stands where a token should."),
    "OCR_ALNUM_CONFUSION": ("warning", "Letters O, I, l may be digits."),
    "IDENTIFIER_FORMAT": ("warning", "Identifier has an unexpected character."),
    "WHITESPACE_SUSPICIOUS": ("info", "Tab or three blanks in a row."),
    "BLOCK_TOO_LONG": ("warning", "Block is unusually long."),
    "SOURCE_PRE_FLAGGED": ("warning", "Extraction flagged this block."),
    "IDENTIFIER_DUPLICATE": ("warning", "The same identifier is in more than one block."),
}


def effective_text() -> Column:
    return F.coalesce(F.col("corrected_text"), F.col("raw_text"))


def token_only(text: Column) -> Column:
    return text.rlike("^(?:" + K.TOKEN + r")\z")


def _finding(code: str, evidence: Column) -> Column:
    severity, message = RULES[code]
    return F.struct(
        F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message"),
        X.evidence(evidence).alias("evidence"),
    )


def _one(code: str, bad: Column, evidence: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(_finding(code, evidence)))


def block_findings(text: Column, unknown: Column | None) -> list[Column]:
    """One array of findings per rule (null when the rule is silent)."""
    icons = I.find_all(text, K.ICON)
    files = I.find_all(text, K.IMAGE_FILE, 1)
    rest = F.regexp_replace(text, K.TOKEN, "")
    # a text without a digit, or without any of these letters, is not cut into words
    words = F.when(text.rlike("[0-9]") & text.rlike("[OIl]"), F.array_sort(
        F.array_distinct(F.filter(I.find_all(text, K.ALNUM_WORD), lambda w: w.rlike("[0-9]") & w.rlike("[OIl]")))
    ))
    identifier = F.lower(F.col("block_type")) == "identifier"
    bad_form = identifier & ~token_only(text) & ~text.rlike(K.IDENTIFIER.replace("$", r"\z"))
    # code: (condition, evidence); all of these count as an error or a warning
    single = {
        "SOURCE_HASH_MISMATCH": (F.col("source_hash") != X.text_sha256("raw_text", prefix=True), text),
        "OCR_UNCERTAIN": (F.col("legibility") == "uncertain", text),
        "SOURCE_WARNING": (F.size("warnings") > 0, F.array_join("warnings", " | ")),
        "OCR_ILLEGIBLE": (F.contains(F.upper(text), F.lit(K.ILLEGIBLE)), text),
        "ICON_UNRESOLVED": (text.rlike(K.ICON), F.array_join(icons, ", ")),
        "UNICODE_REPLACEMENT": (F.contains(text, F.lit(K.REPLACEMENT_CHAR)), text),
        "TOKEN_MALFORMED": (rest.rlike("[{}]"), text),
        "OCR_ALNUM_CONFUSION": (F.size(words) > 0, F.array_join(words, ", ")),
        "IDENTIFIER_FORMAT": (bad_form, text),
        "BLOCK_TOO_LONG": (F.length(text) > K.MAX_BLOCK_CHARS, text),
    }
    found = [_one(code, bad, proof) for code, (bad, proof) in single.items()]
    found.append(F.transform(files, lambda stem: _finding("ICON_FILENAME_LITERAL", stem)))
    loud = text.rlike(K.IMAGE_FILE)
    for bad, _ in single.values():
        loud = loud | F.coalesce(bad, F.lit(False))
    if unknown is not None:
        name = lambda t: F.concat(F.lit("{"), t, F.lit("}"))
        found.append(F.transform(F.array_sort(unknown), lambda t: _finding("TOKEN_UNKNOWN", name(t))))
        loud = loud | F.coalesce(F.size(unknown) > 0, F.lit(False))
    found.append(_one("WHITESPACE_SUSPICIOUS", text.rlike("\t| {3,}"), text))
    found.append(_one("SOURCE_PRE_FLAGGED", (F.col("status") == "flagged") & ~loud, text))
    return found


def _issue_columns() -> list[Column]:
    f = F.col("f")
    return [
        F.col("project_id"),
        F.lit(K.SCHEMA_VERSION).alias("schema_version"),
        X.issue_id(F.col("block_id"), f["code"], f["evidence"]).alias("id"),
        F.col("block_id"),
        f["severity"].alias("severity"),
        f["code"].alias("code"),
        f["message"].alias("message"),
        f["evidence"].alias("evidence"),
        F.col("source_file"),
        F.col("page"),
        F.col("bbox"),
        F.lit(False).alias("auto_fixable"),
        F.col("source_order"),
    ]


def _carrier(blocks: DataFrame) -> DataFrame:
    order = F.col("source_order") if "source_order" in blocks.columns else F.lit(None).cast("long")
    return blocks.withColumn("block_id", F.col("id")).withColumn("source_order", order)


def block_issues(blocks: DataFrame, token_findings: bool = False) -> DataFrame:
    """Issues of the per-block rules; ``unknown`` (array of tokens) is read when ``token_findings``.

    The rules sit inside one generator over the row, so each block is scanned once and its text
    is not copied into filters.
    """
    rules = block_findings(effective_text(), F.col("unknown") if token_findings else None)
    return (
        _carrier(blocks)
        .withColumn("_rule", F.explode(F.array(*rules)))
        .withColumn("f", F.explode("_rule"))
        .select(*_issue_columns())
    )


def unknown_tokens(blocks: DataFrame, tokens: DataFrame) -> DataFrame:
    """(project_id, block_id, token): tokens of a block that its project's vocabulary lacks.

    A project without vocabulary has no unknown tokens.
    """
    used = (
        blocks.select("project_id", F.col("id").alias("block_id"), effective_text().alias("_t"))
        .filter(F.contains(F.col("_t"), F.lit("{")))
        .select("project_id", "block_id", F.explode(F.array_distinct(I.find_all(F.col("_t"), K.TOKEN, 1))).alias("token"))
    )
    known = tokens.select("project_id", "token").distinct()
    having = known.select("project_id").distinct()
    return used.join(having, "project_id", "left_semi").join(known, ["project_id", "token"], "left_anti")


def duplicate_identifiers(blocks: DataFrame) -> DataFrame:
    """Identifier blocks whose text is in more than one block of the project.

    Texts are counted with map-side combine and joined back, so a text shared by many blocks
    is never gathered in one place.
    """
    text = effective_text()
    ids = (
        _carrier(blocks)
        .filter((F.lower("block_type") == "identifier") & ~token_only(text))
        .withColumn("identifier", text)
    )
    repeated = ids.groupBy("project_id", "identifier").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return ids.join(repeated, ["project_id", "identifier"])


def duplicate_issues(blocks: DataFrame) -> DataFrame:
    return (
        duplicate_identifiers(blocks)
        .withColumn("f", _finding("IDENTIFIER_DUPLICATE", F.col("identifier")))
        .select(*_issue_columns())
    )


def with_unknown_tokens(blocks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Blocks with ``unknown``: the sorted tokens their project's vocabulary lacks (null: none).

    Tokens meet the vocabulary by equality, as rows, and are gathered per block again. A stream cannot
    gather its rows without waiting for more, so its blocks meet their project's vocabulary, which is a
    static table there, as one list; blocks without tokens do not look into it.
    """
    if blocks.isStreaming:
        known = tokens.groupBy("project_id").agg(F.collect_set("token").alias("_known"))
        used = F.array_distinct(I.find_all(effective_text(), K.TOKEN, 1))
        missing = F.when((F.size(used) > 0) & F.col("_known").isNotNull(), F.array_except(used, F.col("_known")))
        return blocks.join(known, "project_id", "left").withColumn("unknown", missing).drop("_known")
    unknown = unknown_tokens(blocks, tokens).groupBy("project_id", F.col("block_id").alias("id")).agg(
        F.collect_set("token").alias("unknown")
    )
    return blocks.join(unknown, ["project_id", "id"], "left")


def run_source_qa(blocks: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """All source rules: one scan for the block rules plus the duplicate-identifier join."""
    if tokens is None:
        return block_issues(blocks).unionByName(duplicate_issues(blocks))
    return block_issues(with_unknown_tokens(blocks, tokens), token_findings=True).unionByName(duplicate_issues(blocks))


def order_issues(issues: DataFrame) -> DataFrame:
    return issues.orderBy("project_id", "source_order", "code", "id")


def severity_counts(issues: DataFrame) -> DataFrame:
    error = F.col("severity") == "error"
    blocking = error & F.col("code").isin(*K.NON_OVERRIDABLE)
    return issues.groupBy("project_id").agg(
        F.count_if(error).alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"),
        F.count_if(error & ~F.col("code").isin(*K.NON_OVERRIDABLE)).alias("overridable_errors"),
        F.count_if(blocking).alias("blocking_errors"),
    )


def flagged_blocks(issues: DataFrame) -> DataFrame:
    """Distinct blocks with an error or warning, counted in two steps."""
    marked = issues.filter(F.col("severity").isin("error", "warning")).select("project_id", "block_id").distinct()
    return marked.groupBy("project_id").agg(F.count(F.lit(1)).alias("flagged_blocks"))


def reviewable_issues(issues: DataFrame) -> DataFrame:
    return issues.filter(F.col("code") != "SOURCE_WARNING")


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues and distinct blocks with issues per project; blocks are combined first."""
    per_block = issues.groupBy("project_id", "block_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_block.groupBy("project_id").agg(
        F.sum("_n").cast("long").alias("issues"), F.count(F.lit(1)).alias("issue_blocks")
    )
