"""Queries that write derived tables to files, read them back, stream them, or call a model."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from lexiloom import schemas
from lexiloom.catalog import translation as CT
from lexiloom.catalog.blocks import _COLUMNS
from lexiloom.catalog.registry import register
from lexiloom.functions import text as X
from lexiloom.operators import models as M
from lexiloom.operators import rendering as RE
from lexiloom.operators import source_qa as Q
from lexiloom.operators import validation as VAL
from lexiloom.plans import testviews as V
from lexiloom.session import settle, work_dir
from lexiloom.sinks import writers as W
from lexiloom.sources import readers as R
from lexiloom.streaming import streams as ST


def fresh(spark, name: str) -> str:
    return work_dir(spark, f"{name}-{uuid.uuid4().hex}")


def _counts(good, bad):
    g = good.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("good"))
    b = bad.groupBy("project_id", F.col("problem").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return g.unionByName(b)


def _read_blocks(s, d):
    """Blocks as JSON lines; some lines are cut off and some blocks written twice."""
    path = fresh(s, "blocks")
    rows = V.blocks(s, d)
    line = F.to_json(F.struct(*schemas.BLOCK.fieldNames()))
    k = F.col("doc_id") + F.col("line")
    text = rows.select("project_id", F.when(k % 61 == 0, F.lit('{"id": "cut')).otherwise(line).alias("value"))
    twice = rows.filter("doc_id % 50 = 3").select("project_id", line.alias("value"))
    text.unionByName(twice).write.partitionBy("project_id").text(path)
    return _counts(*R.read_blocks(s, path))


register(
    "read_blocks",
    _read_blocks,
    """SELECT project_id, 'good' AS state, count(*) AS n FROM (SELECT project_id FROM v_block WHERE (doc_id + line) % 61 <> 0 UNION ALL SELECT project_id FROM v_block WHERE doc_id % 50 = 3) GROUP BY 1
      UNION ALL SELECT project_id, 'malformed', count(*) FROM v_block WHERE (doc_id + line) % 61 = 0 GROUP BY 1
      UNION ALL SELECT project_id, 'duplicate', count(*) FROM v_block WHERE doc_id % 50 = 3 AND (doc_id + line) % 61 <> 0 GROUP BY 1""",
)


def _write_blocks(s, d):
    path = fresh(s, "blocks-out")
    W.write_blocks(V.blocks(s, d), path)
    return R.read_blocks(s, path)[0].select("project_id", "id", "source_order", "block_type", X.text_sha256("raw_text").alias("hash"))


register("write_blocks", _write_blocks, "SELECT project_id, id, source_order, block_type, sha256(raw_text) AS hash FROM v_block")


def _write_segments(s, d):
    path = fresh(s, "segments")
    seg = V.segments(s, d)
    W.write_segments(seg.filter("doc_id % 2 = 0"), path)
    W.write_segments(seg.filter("doc_id % 2 = 1"), path)
    return s.read.parquet(path).select("project_id", "source_block_id", "source_order", "translation_sha256")


register("write_segments", _write_segments, "SELECT project_id, source_block_id, source_order, translation_sha256 FROM v_segment")


def _read_segments(s, d):
    path = fresh(s, "segment-lines")
    V.segments(s, d).select("project_id", *schemas.SEGMENT.fieldNames()).write.partitionBy("project_id").json(path)
    return R.read_segments(s, path)[0].groupBy("project_id", "status").agg(F.count(F.lit(1)).alias("n"), F.max("source_order").alias("last"))


register("read_segments", _read_segments, "SELECT project_id, status, count(*) AS n, max(source_order) AS last FROM v_segment GROUP BY ALL")


def _entries(s, d):
    terms = V.termbase(s, d)
    none = F.array().cast("array<string>")
    return terms.select(
        "project_id", "candidate_id", "source_term", "translation", "category", "status", F.lit("").alias("note"), "variants",
        F.lit(0).cast("long").alias("occurrences"), none.alias("block_ids"), none.alias("locations"), F.lit("").alias("example"),
        F.lit("auto").alias("origin"), F.lit(True).alias("source_verified"),
    )


def _termbase(s, d):
    path = fresh(s, "termbase")
    W.write_termbase(_entries(s, d), path)
    rows, _ = R.read_termbase(s, path)
    return rows.select("project_id", "candidate_id", "source_term", "translation", "status", F.array_join("variants", "|").alias("variants"))


_ACTIVE = "SELECT project_id, candidate_id, source_term, translation, status, array_to_string(variants, '|') AS variants FROM v_termbase WHERE status IN ('approved', 'keep')"
register("write_termbase", _termbase, _ACTIVE)


def _read_termbase(s, d):
    """Termbase documents of a few entries each, many to a file."""
    path = fresh(s, "termbase-docs")
    fields = F.struct(*schemas.TERM_ENTRY.fieldNames())
    part = F.substring(F.sha2("candidate_id", 256), 1, 3)
    docs = _entries(s, d).groupBy("project_id", part.alias("part")).agg(F.collect_list(fields).alias("entries"))
    docs.select("project_id", F.lit(1).alias("schema_version"), "entries").write.json(path)
    rows, _ = R.read_termbase(s, path)
    return rows.select("project_id", "candidate_id", "source_term", "translation", "status", F.array_join("variants", "|").alias("variants"))


register("read_termbase", _read_termbase, _ACTIVE)


def _tsv(s, d):
    from lexiloom.catalog.glossary import rows

    path = fresh(s, "glossary")
    W.write_glossary_tsv(rows(s, d), path)
    good, bad = R.read_glossary_tsv(s, path)
    return good.select("project_id", "status", "source_term", "translation", "locations", "candidate_id")


register("write_glossary_tsv", _tsv, "SELECT project_id, status, CASE WHEN doc_id % 11 = 3 THEN ' ' ELSE source_term END AS source_term, translation, locations, candidate_id FROM v_grow")


def _parts(s, d):
    path = fresh(s, "review")
    blocks = V.blocks(s, d, "id", "source_type", "source_file", "page", "raw_text", "corrected_text")
    W.write_parts(RE.render_source_review(blocks), path)
    lines = R.read_review_lines(s, path)
    texts, problems = RE.parse_source_review(lines, blocks)
    return texts.select("project_id", "block_id", X.text_sha256("text").alias("hash"))


register("write_and_read_review", _parts, r"SELECT project_id, id AS block_id, sha256(regexp_replace(eff, '^\s+|\s+$', '', 'g')) AS hash FROM v_block")


def _pages(s, d):
    path = fresh(s, "fragments")
    f = V.fragments(s, d)
    item = F.struct("id", "text", "bbox", "block_index", "line_index")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("f")))), lambda p: p["f"])
    f.groupBy("project_id", "page").agg(F.first("page_size").alias("page_size"), listed.alias("fragments")).repartition(8).write.partitionBy("project_id").json(path)
    acq = V.documents(s, d).groupBy("project_id").agg(F.collect_list(F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") + 1)).alias("pages")).withColumn("status", F.lit("complete")).withColumn("failures", F.array().cast("array<string>"))
    schema = schemas.PAGE_FRAGMENTS
    rows = s.read.schema(schema).json(path).select("project_id", "page", "page_size", F.posexplode("fragments").alias("i", "f"))
    return R.successful_pages(rows, acq).select("project_id", "page", F.col("f.id").alias("id"), X.text_sha256(F.col("f.text")).alias("hash"))


register("read_page_fragments", _pages, "SELECT project_id, page, id, sha256(text) AS hash FROM v_fragment WHERE doc_id % 4 <> 0")


def _snapshot(s, d):
    path = fresh(s, "revisions")
    seg = V.segments(s, d).select("project_id", "source_block_id", "translation_sha256")
    W.snapshot_revision(seg, path, "restart", "r1")
    W.snapshot_revision(seg, path, "retry", "r2")
    return s.read.parquet(path).groupBy("project_id", "revision", "reason").agg(F.count(F.lit(1)).alias("n"))


register(
    "snapshot_revision", _snapshot,
    "SELECT project_id, revision, reason, count(*) AS n FROM v_segment, (VALUES ('r1', 'restart'), ('r2', 'retry')) t(revision, reason) GROUP BY ALL",
)
register(
    "validate_layout_shape",
    lambda s, d: VAL.validate_layout_shape(
        V.documents(s, d).select("project_id", "doc_id", F.from_json(
            F.when(F.col("doc_id") % 5 == 0, '{"x": 1}').when(F.col("doc_id") % 5 == 1, '{"blocks": [{"type": "poem", "fragment_ids": ["a"], "include_in_text": true, "reason": ""}]}')
            .when(F.col("doc_id") % 5 == 2, '{"blocks": [{"type": "label", "include_in_text": true}]}')
            .otherwise('{"blocks": [{"type": "label", "fragment_ids": ["a"], "include_in_text": false, "reason": "x"}]}'), schemas.LAYOUT).alias("layout"))
    ).select("project_id", "doc_id", F.array_join("violations", ",").alias("violations")),
    "SELECT project_id, doc_id, CASE doc_id % 5 WHEN 0 THEN 'blocks' WHEN 1 THEN 'type' WHEN 2 THEN 'fragment_ids,reason' ELSE '' END AS violations FROM v_doc",
)

# --- Streams, replayed to their end ---------------------------------------------------------


def _stream(s, df):
    """The rows as a file stream of two micro-batches, in files enough for every core to write and read some."""
    path = fresh(s, "stream-in")
    files = max(4, 2 * s.sparkContext.defaultParallelism)
    df.repartition(files).write.parquet(path)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", files // 2).parquet(path)


def _run(s, stream, mode: str, sink) -> None:
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", fresh(s, "stream-state")).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()


def _append(path: str):
    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def _stream_qa(s, d):
    out = fresh(s, "stream-out")
    tokens = R.allowed_tokens(V.prompts(s, d), "prompt")
    _run(s, ST.stream_source_qa(_stream(s, V.block_rows(s, d)), tokens), "append", _append(out))
    return s.read.parquet(out).select(*_COLUMNS)


register("stream_source_qa", _stream_qa, "SELECT project_id, block_id, severity, code, evidence, id FROM v_issue WHERE code <> 'IDENTIFIER_DUPLICATE'")


def _stream_new(s, d):
    out = fresh(s, "stream-new")
    rows = V.block_rows(s, d)
    _run(s, _stream(s, rows.unionByName(rows.filter("doc_id % 3 = 1"))), "append", ST.new_blocks_batch(out))
    return s.read.parquet(out).select("project_id", "id", "content_sha256")


register("stream_new_blocks", _stream_new, "SELECT project_id, id, sha256(eff) AS content_sha256 FROM v_block")


def _last(s, out: str, keys: list[str]):
    rows = s.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def _stream_ids(s, d):
    out = fresh(s, "stream-ids")
    _run(s, ST.stream_duplicate_identifiers(_stream(s, V.block_rows(s, d))), "update", _append(out))
    return _last(s, out, ["project_id", "identifier"]).filter("copies > 1")


register(
    "stream_duplicate_identifiers", _stream_ids,
    r"SELECT project_id, eff AS identifier, count(*) AS copies FROM v_block WHERE block_type = 'identifier' AND NOT regexp_matches(eff, '^\{[A-Za-z][A-Za-z0-9_]*\}$') "
    "GROUP BY ALL HAVING count(*) > 1",
)


def _stream_jobs(s, d):
    from lexiloom.catalog.projects import jobs

    out = fresh(s, "stream-jobs")
    _run(s, ST.stream_job_progress(_stream(s, jobs(s, d).select("project_id", "job_id", "status", "created_at"))), "update", _append(out))
    return _last(s, out, ["project_id"]).select("project_id", "job_id", "status")


register(
    "stream_job_progress", _stream_jobs,
    "SELECT project_id, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) AS r FROM v_job) WHERE r = 1",
)

# --- A stub model ---------------------------------------------------------------------------


def stub_answer(requests, feedback):
    """Translates by a prefix; longer requests fail the first time, some always."""
    out = []
    for text, told in zip(requests, feedback):
        if len(text) % 7 == 0 and not told:
            out.append("not json")
        elif len(text) % 11 == 0:
            out.append(None)
        else:
            out.append(json.dumps({"text": "가 " + str(len(text))}))
    return out


def stub_check(request, response):
    try:
        return "", "" if json.loads(response)["text"] else "empty"
    except (ValueError, KeyError):
        return "malformed", ""


def _model(s, d):
    asked = V.block_rows(s, d).select("project_id", "id", Q.effective_text().alias("request"))

    def answer(requests, feedback, fn=_portable(stub_answer)):
        return fn(requests, feedback)

    def check(request, response, fn=_portable(stub_check)):
        return fn(request, response)

    rows = M.apply_model(asked, answer, check)
    return rows.select("project_id", "id", "attempts", F.col("response").isNotNull().alias("answered"), F.get_json_object("response", "$.text").alias("text"))


def _portable(fn):
    """A copy of a module function that is sent to workers by value."""
    import types

    return types.FunctionType(fn.__code__, {"json": json, "__builtins__": __builtins__}, fn.__name__ + "_copy")


register(
    "apply_model", _model,
    """SELECT project_id, id, CASE WHEN n % 7 = 0 OR n % 11 = 0 THEN 2 ELSE 1 END AS attempts, n % 11 <> 0 AS answered, CASE WHEN n % 11 <> 0 THEN '가 ' || n::VARCHAR END AS text
      FROM (SELECT project_id, id, length(eff) AS n FROM v_block)""",
)


def _retry(s, d):
    def answer(requests, feedback):
        return ["다시 " + json.loads(r)["source_block_id"] for r in requests]

    def check(request, response):
        return "", ""

    after, log = M.retry_failed(V.segments(s, d), settle(CT.tissues(s, d)), answer, check)
    return after.select("project_id", "source_block_id", X.text_sha256("translated_text").alias("hash"))


register(
    "retry_failed", _retry,
    """SELECT project_id, source_block_id, sha256(CASE WHEN EXISTS (SELECT 1 FROM v_tissue t WHERE t.project_id = s.project_id AND t.block_id = s.source_block_id AND t.severity = 'error')
      THEN '다시 ' || source_block_id ELSE translated_text END) AS hash FROM v_segment s""",
)
