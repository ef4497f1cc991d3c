"""Files and answers that are written and read back, model calls, and inputs without bounds."""

from pyspark.sql import functions as F

from lexiloom import schemas
from lexiloom.functions import text as X
from lexiloom.operators import models as M
from lexiloom.operators import rendering as RE
from lexiloom.operators import source_qa as Q
from lexiloom.operators import translation as TR
from lexiloom.sinks import writers as W
from lexiloom.sources import readers as R


def test_termbase_is_read_as_written(spark, tmp_path):
    none = F.array().cast("array<string>")
    rows = [("p", f"t{i}", f"term {i}", f"뜻 {i}", "approved" if i % 2 else "keep") for i in range(6)] + [("p", "odd", "x", "y", "maybe"), ("p", "gap", "x", "", "approved")]
    entries = spark.createDataFrame(rows, "project_id string, candidate_id string, source_term string, translation string, status string").select(
        "*", F.lit("term").alias("category"), F.lit("").alias("note"), none.alias("variants"), F.lit(0).cast("long").alias("occurrences"), none.alias("block_ids"),
        none.alias("locations"), F.lit("").alias("example"), F.lit("auto").alias("origin"), F.lit(True).alias("source_verified"),
    )
    assert {*schemas.TERM_ENTRY.fieldNames()} <= {*entries.columns}
    W.write_termbase(entries.coalesce(1), str(tmp_path / "t"))
    good, bad = R.read_termbase(spark, str(tmp_path / "t"))
    assert sorted(r.candidate_id for r in good.collect()) == [f"t{i}" for i in range(6)]
    assert sorted((r.key, r.problem) for r in bad.collect()) == [("gap", "incomplete"), ("odd", "status")]


def test_a_revision_written_twice_is_there_once(spark, tmp_path):
    rows = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c")], "project_id string, id string")
    path = str(tmp_path / "log")
    W.snapshot_revision(rows, path, "first", "r1")
    W.snapshot_revision(rows, path, "second", "r2")
    W.snapshot_revision(rows, path, "again", "r1")
    got = sorted((r.revision, r.id, r.reason) for r in spark.read.parquet(path).collect())
    assert got == [("r1", i, "again") for i in "abc"] + [("r2", i, "second") for i in "abc"]


def test_natural_keys_of_long_numbers_differ(spark):
    names = ["x" + "1" * 26, "x" + "1" * 25 + "2", "x2", "x10", "x002"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.natural_key("n").alias("k")).orderBy("k", "n").collect()
    assert [r.n for r in rows] == ["x002", "x2", "x10", "x" + "1" * 26, "x" + "1" * 25 + "2"]
    assert len({tuple(r.k) for r in rows if len(r.n) > 20}) == 2


def test_each_failed_block_is_asked_for_once(spark, tmp_path):
    segments = spark.createDataFrame([("p", f"b{i}", f"text {i}", f"old {i}", "h") for i in range(5)], "project_id string, source_block_id string, source_text string, translated_text string, translation_sha256 string")
    issues = spark.createDataFrame([("p", f"b{i}", "number_changed", "error") for i in range(5)], "project_id string, block_id string, code string, severity string")
    calls = str(tmp_path / "calls")

    def answer(requests, feedback):
        with open(calls, "a") as out:
            out.write("x" * len(requests))
        return [f"new {len(r)}" for r in requests]

    after, log = M.retry_failed(segments, issues, answer, lambda request, reply: ("", ""))
    texts = {r.source_block_id: r.translated_text for r in after.collect()}
    logged = {r.source_block_id: r.retried_translation for r in log.collect()}
    assert texts == logged and len(texts) == 5 and len(open(calls).read()) == 5


def test_an_exception_of_the_model_is_a_problem(spark):
    requests = spark.createDataFrame([(i, f"r{i}") for i in range(3)], "id int, request string")

    def answer(asked, feedback):
        raise RuntimeError("no line")

    out = M.apply_model(requests, answer, lambda request, reply: ("", "")).collect()
    assert all(r.response is None and r.attempts == 2 and "no line" in r.problems for r in out)


def test_a_foreign_end_marker_is_text(spark):
    body = ["head\n[[END zz]]\ntail", "second"]
    blocks = spark.createDataFrame([("p", i + 1, f"b{i}", "pdf", 1, "a.pdf", t) for i, t in enumerate(body)], "project_id string, source_order long, id string, source_type string, page long, source_file string, raw_text string").withColumn("corrected_text", F.lit(None).cast("string"))
    parts = RE.render_source_review(blocks).orderBy("source_order").collect()
    lines = "\n".join(p.part for p in parts).split("\n")
    table = spark.createDataFrame([("p", i + 1, line) for i, line in enumerate(lines)], "project_id string, line_no long, line string")
    texts, problems = RE.parse_source_review(table, blocks)
    assert problems.count() == 0 and {r.block_id: r.text for r in texts.collect()} == {f"b{i}": t for i, t in enumerate(body)}


def test_unreviewed_segments_stay(spark):
    segments = spark.createDataFrame([("p", "a", "x"), ("p", "b", "y")], "project_id string, source_block_id string, translated_text string")
    reviewed = spark.createDataFrame([("p", "a", "z")], "project_id string, source_block_id string, text string")
    got = {r.source_block_id: (r.reviewed, r.changed, r.correction) for r in TR.diff_review(segments, reviewed).collect()}
    assert got == {"a": ("z", True, "z"), "b": (None, None, None)}


def test_large_vocabularies_give_the_same_issues(spark):
    tokens = spark.range(200_050).select(F.lit("p").alias("project_id"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("token"))
    block = spark.createDataFrame([("p", "b1", "See {T7} and {Nope}.", "flagged")], "project_id string, id string, raw_text string, status string").select(
        "*", F.lit(None).cast("string").alias("corrected_text"), F.lit("body").alias("block_type"), F.lit("pdf").alias("source_type"), F.lit("a.pdf").alias("source_file"), F.lit(1).cast("long").alias("page"),
        F.lit(None).cast("array<double>").alias("bbox"), F.array().cast("array<string>").alias("warnings"), F.lit(None).cast("string").alias("legibility"), X.text_sha256("raw_text", prefix=True).alias("source_hash"), F.lit(1).cast("long").alias("source_order"),
    )
    assert [(r.code, r.evidence) for r in Q.run_source_qa(block, tokens).collect()] == [("TOKEN_UNKNOWN", "{Nope}")]
