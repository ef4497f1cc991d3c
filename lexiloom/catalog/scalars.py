"""Queries for the scalar functions, over all blocks of the driver documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.catalog import sqlviews as S
from lexiloom.catalog.registry import register
from lexiloom.functions import geometry as G
from lexiloom.functions import items as I
from lexiloom.functions import text as X
from lexiloom.operators.source_qa import effective_text
from lexiloom.plans import testviews as V


def per_block(name: str, column: Callable[[], Column], expression: str) -> None:
    def query(spark, sf_dir) -> DataFrame:
        return V.block_rows(spark, sf_dir).select("project_id", "id", column().alias("value"))

    register(name, query, f"SELECT project_id, id, {expression} AS value FROM v_block")


def _raw() -> Column:
    return F.col("raw_text")


_eff = effective_text


def _words() -> Column:
    return F.regexp_extract_all(_eff(), F.lit(K.TERM_WORD), F.lit(0))


per_block("effective_text", lambda: X.text_sha256(_eff()), "sha256(eff)")
per_block(
    "normalize_newlines",
    lambda: X.text_sha256(X.normalize_newlines(F.replace(_raw(), F.lit(" "), F.lit("\r\n")))),
    "sha256(replace(raw_text, ' ', chr(10)))",
)
per_block("text_sha256", lambda: X.text_sha256(_eff(), prefix=True), "'sha256:' || sha256(eff)")
per_block("slug", lambda: X.slug("source_file"), S.slug("source_file"))
per_block(
    "block_id",
    lambda: X.block_id(F.col("source_type"), F.col("source_file"), F.col("page"), F.col("block_order")),
    S.block_id("source_type", "source_file", "page", "block_order"),
)
per_block("evidence", lambda: X.evidence(_eff()), S.evidence("eff"))
per_block(
    "issue_id",
    lambda: X.issue_id(F.col("id"), F.lit("SOURCE_WARNING"), X.evidence(_eff())),
    f"'qa-' || substr(sha256(id || '|SOURCE_WARNING|' || {S.evidence('eff')}), 1, 16)",
)
per_block(
    "locator",
    lambda: X.locator(F.col("source_type"), F.col("page"), F.col("source_file")),
    f"CASE WHEN source_type = 'pdf' THEN 'p' || page::VARCHAR ELSE substr(source_file, {len(K.IMAGE_ROOT) + 2}) END",
)
per_block(
    "natural_key",
    lambda: F.array_join(F.transform(X.natural_key("source_file"), lambda p: F.concat(p["kind"].cast("string"), F.lit(":"), p["digits"], p["text"])), "~"),
    "array_to_string(list_transform(regexp_extract_all(lower(source_file), '[0-9]+|[^0-9]+'), lambda p: "
    "CASE WHEN regexp_matches(p, '^[0-9]') THEN '0:' || lpad(len(regexp_replace(p, '^0+([0-9])', '\\1'))::VARCHAR, 10, '0') || regexp_replace(p, '^0+([0-9])', '\\1') ELSE '1:' || p END), '~')",
)
per_block(
    "protected_tokens",
    lambda: F.concat_ws("#", *[F.array_join(I.protected_tokens(_eff())[k], ",") for k in ("curly", "square", "html", "number")]),
    r"concat_ws('#', array_to_string(regexp_extract_all(eff, '\{[A-Za-z][A-Za-z0-9_]*\}'), ','), "
    r"array_to_string(regexp_extract_all(eff, '\[[^\]\n]+\]'), ','), "
    r"array_to_string(regexp_extract_all(eff, '</?[^>\n]+>'), ','), "
    r"array_to_string(regexp_extract_all(eff, '[0-9]+(?:[.,][0-9]+)*%?'), ','))",
)
_WORDS = "', '".join(K.NUMBER_WORDS)
_DIGITS = "MAP {" + ", ".join(f"'{w}': '{d}'" for w, d in K.NUMBER_WORDS.items()) + "}"
_COUNTED = "concat(eff, ' one Two twenty-one'" + ")"
per_block(
    "number_words",
    lambda: F.array_join(I.number_words(F.concat(_eff(), F.lit(" one Two twenty-one"))), ","),
    rf"array_to_string(list_transform(list_filter(regexp_extract_all(lower({_COUNTED}), '[\p{{L}}\p{{N}}_]+'), "
    rf"lambda w: w IN ('{_WORDS}')), lambda w: ({_DIGITS})[w]), ',')",
)
per_block(
    "format_multiset",
    lambda: I.format_multiset(I.find_all(_eff(), K.NUMBER)),
    r"(SELECT coalesce(string_agg(CASE WHEN n > 1 THEN v || '×' || n::VARCHAR ELSE v END, ', ' ORDER BY v), '" + K.EMPTY_MULTISET + "') "
    r"FROM (SELECT v, count(*) AS n FROM (SELECT unnest(regexp_extract_all(eff, '[0-9]+(?:[.,][0-9]+)*%?')) AS v) GROUP BY v))",
)
_WORDY = "regexp_extract_all(eff, '[A-Za-z][A-Za-z0-9''’-]*')"
per_block(
    "singularize",
    lambda: F.array_join(F.transform(_words(), X.singularize), " "),
    f"array_to_string(list_transform(list_transform({_WORDY}, lambda y: lower(y)), lambda w: {S.singular('w')}), ' ')",
)
per_block(
    "term_key",
    lambda: X.term_key(_eff()),
    f"CASE WHEN len({_WORDY}) = 0 THEN '' ELSE array_to_string(list_transform({_WORDY}[:-2], lambda y: lower(y)) || "
    f"list_transform([lower({_WORDY}[-1])], lambda w: {S.singular('w')}), ' ') END",
)
per_block("normalized_term", lambda: X.normalized_term(F.concat(_raw(), F.lit("ＡB"))), f"replace(lower({S.collapse('raw_text')}), 'ß', 'ss') || 'ab'")
per_block("nfkc", lambda: X.text_sha256(X.nfkc(F.concat(_raw(), F.lit(" ﬁＡ①")))), "sha256(raw_text || ' fiA1')")
_KEY = (
    "(CASE WHEN len({w}) = 0 THEN '' ELSE array_to_string(list_transform({w}[:-2], lambda y: lower(y)) || "
    "list_transform([lower({w}[-1])], lambda x: {s}), ' ') END)"
).format(w=_WORDY.replace("eff", "raw_text"), s=S.singular("x"))
per_block("term_id", lambda: X.term_id(X.term_key(_raw(), False)), f"'term-' || substr(sha256({_KEY}), 1, 12)")
per_block(
    "manual_term_id",
    lambda: X.manual_term_id(_raw(), False),
    f"'manual-' || substr(sha256(CASE WHEN {_KEY} = '' THEN lower({S.collapse('raw_text')}) ELSE {_KEY} END), 1, 12)",
)
_TITLE = r"(regexp_matches(regexp_replace(w, '[^\p{L}]', '', 'g'), '^\p{Lu}{2,}$') OR regexp_matches(w, '^\p{Lu}.*\p{Ll}'))"
_LINKS = "lower(w) IN ('" + "', '".join(K.CONNECTORS) + "')"
per_block(
    "is_title_phrase",
    lambda: X.is_title_phrase(_words()),
    f"len(list_filter({_WORDY}, lambda w: NOT ({_LINKS}))) > 0 AND "
    f"len(list_filter({_WORDY}, lambda w: NOT ({_TITLE} OR {_LINKS}))) = 0",
)
per_block(
    "bbox_normalize",
    lambda: F.array_join(F.transform(G.normalize_box(F.col("bbox"), F.lit(640.0), F.lit(480.0)), lambda v: F.format_string("%.2f", v)), "|"),
    "concat_ws('|', " + ", ".join(
        f"printf('%.2f', greatest(0.0, least(1000.0, bbox[{i}] / {d} * 1000)))" for i, d in ((1, 640.0), (2, 480.0), (3, 640.0), (4, 480.0))
    ) + ")",
)
per_block(
    "normalize_project_id",
    lambda: X.normalize_project_id(F.concat("project_id", F.lit(" Ünit #"), F.substring("id", 1, 9), F.lit("!"))),
    "regexp_replace(regexp_replace(lower(project_id || ' Ünit #' || substr(id, 1, 9) || '!'), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')",
)
per_block(
    "term_variants",
    lambda: F.array_join(I.term_variants(F.col("block_type"), F.array(F.lit("body"), F.upper("block_type"), F.lit(" "), F.concat("block_type", F.lit(" ")))), "|"),
    "concat_ws('|', block_type, 'body', upper(block_type))",
)
per_block(
    "json_fingerprint",
    lambda: X.json_fingerprint(F.col("block_type"), F.col("id"), F.col("source_type")),
    "sha256('{\"block_type\":\"' || block_type || '\",\"id\":\"' || id || '\",\"source_type\":\"' || source_type || '\"}')",
)
per_block(
    "clean_cell",
    lambda: F.concat_ws("|", X.collapse("raw_text"), X.strip(F.concat(F.lit(" \n"), _raw(), F.lit("\n")))),
    f"{S.collapse('raw_text')} || '|' || {S.strip('raw_text')}",
)
