"""Registered queries against their DuckDB statements (all of them with ALL_QUERIES=1)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUICK = (
    "run_source_qa", "validate_blocks", "layout_coverage", "term_stats", "run_translation_qa", "pack_chunks", "renumber_approved",
    "project_stage", "latest_job", "stream_source_qa", "write_glossary_tsv", "dataset_fingerprint",
)
NAMES = sorted(entry.queries()) if os.environ.get("ALL_QUERIES") else QUICK
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no sample tables")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_statement(spark, name):
    state, note, _ = compare.compare(spark, compare.connect(SF_DIR), SF_DIR, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert state in ("ok", "rows"), note


def test_statements_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5
