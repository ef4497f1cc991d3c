"""Queries over many projects: freshness, stages, jobs, files. Every document is a project."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.catalog.blocks import joined
from lexiloom.catalog.registry import register
from lexiloom.catalog.sqlviews import view
from lexiloom.functions import text as X
from lexiloom.operators import jobs as J
from lexiloom.operators import lineage as L
from lexiloom.operators import validation as VAL
from lexiloom.plans import testviews as V

# name: (modulus, remainder) on doc_id under which the stored value is off; hashes derive from the text.
_OFF = {
    "qa_source_hash": (5, 1), "review_source_hash": (7, 2), "review_stored_hash": (11, 3), "final_stored_hash": (13, 4),
    "approved_stored_hash": (17, 5), "glossary_approved_hash": (19, 6), "termbase_approved_hash": (23, 7), "termbase_glossary_hash": (29, 8),
    "termbase_stored_hash": (31, 9), "translation_approved_hash": (37, 10), "translation_termbase_hash": (41, 11), "translation_prompt_hash": (43, 12),
    "translation_stored_hash": (47, 13), "base_draft_hash": (53, 14), "tr_output_stored": (59, 15), "tr_termbase_stored": (61, 16),
    "tr_draft_stored": (67, 17), "tr_review_stored": (71, 18),
}
_GONE = {
    "source_hash": (101, 1), "review_hash": (103, 2), "final_hash": (0, 0), "approved_hash": (0, 0), "glossary_hash": (3, 2), "termbase_hash": (107, 5),
    "prompt_hash": (0, 0), "translation_hash": (109, 6), "draft_hash": (0, 0), "tr_review_hash": (10, 7),
}
_RAN = {"qa_ran": (9, 4), "review_ran": (97, 3), "glossary_ran": (89, 2), "termbase_ran": (4, 1), "translation_ran": (6, 5), "tr_ran": (8, 6)}


def states(s, d):
    n = F.col("doc_id")
    h = X.text_sha256("text")
    rows = V.documents(s, d).select(F.concat(F.lit("doc"), n.cast("string")).alias("project_id"), n.alias("doc_id"), h.alias("h"))
    h = F.col("h")
    pick = lambda m, r: (n % m == r) if m else F.lit(False)
    cols = [F.when(pick(*v), F.lit("old")).otherwise(h).alias(k) for k, v in _OFF.items()]
    cols += [F.when(~pick(*v), h).alias(k) for k, v in _GONE.items()]
    cols += [(~pick(*v)).alias(k) for k, v in _RAN.items()]
    cols += [
        F.when(n % 83 == 0, "partial").otherwise("complete").alias("acq_status"), (n % 79 == 1).cast("int").alias("acq_failures"),
        F.when(n % 73 == 1, "v0").otherwise(K.SOURCE_QA_VERSION).alias("qa_version"),
        F.when(n % 14 == 1, "prepared").otherwise("approved").alias("review_status"),
        F.lit("complete").alias("glossary_state"), F.lit(K.GLOSSARY_BUILD_VERSION).alias("glossary_version"),
        F.lit("complete").alias("termbase_state"), F.lit(K.TERMBASE_IMPORT_VERSION).alias("termbase_version"),
        F.when(n % 15 == 4, "partial").otherwise("complete").alias("translation_state"), F.lit(K.TRANSLATION_RUN_VERSION).alias("translation_version"),
        F.lit("current").alias("base_review_status"), F.lit(K.TRANSLATION_REVIEW_VERSION).alias("tr_version"),
        F.when(n % 12 == 0, "qa_failed").when(n % 12 == 4, "qa_passed").otherwise("approved").alias("tr_state"),
        (n % 33 != 0).alias("outputs_current"), (n % 35 != 0).alias("workspace_ready"),
    ]
    return rows.select("project_id", "doc_id", *cols)


def _bad(*names: str) -> str:
    return " OR ".join(f"doc_id % {_OFF[n][0]} = {_OFF[n][1]}" for n in names)


def _gone(name: str) -> str:
    m, r = _GONE[name]
    return f"doc_id % {m} = {r}" if m else "FALSE"


def _idle(name: str) -> str:
    m, r = _RAN[name]
    return f"doc_id % {m} = {r}"


def _differs(stored: str, present: str) -> str:
    """A missing present file differs from any stored hash."""
    return f"({_bad(stored)} OR {_gone(present)})"


view(
    "v_state",
    f"""SELECT 'doc' || doc_id::VARCHAR AS project_id, doc_id, doc_id % 83 <> 0 AND doc_id % 79 <> 1 AS source_acquired, NOT ({_gone('source_hash')}) AS review_source_ready,
      CASE WHEN {_idle('qa_ran')} THEN 'not_run' WHEN doc_id % 73 = 1 OR {_differs('qa_source_hash', 'source_hash')} THEN 'stale' ELSE 'complete' END AS qa_status,
      CASE WHEN {_gone('review_hash')} OR {_idle('review_ran')} THEN 'not_ready' WHEN {_differs('review_source_hash', 'source_hash')} THEN 'stale'
        WHEN doc_id % 14 <> 1 AND NOT ({_bad('review_stored_hash', 'final_stored_hash', 'approved_stored_hash')}) THEN 'approved' ELSE 'pending' END AS human_review FROM v_doc""",
)
view(
    "v_state2",
    f"""SELECT *, CASE WHEN {_gone('termbase_hash')} OR {_idle('termbase_ran')} THEN CASE WHEN glossary_status = 'current' THEN 'not_built' ELSE 'not_ready' END
        WHEN glossary_status <> 'current' OR {_bad('termbase_approved_hash', 'termbase_glossary_hash', 'termbase_stored_hash')} THEN 'stale' ELSE 'current' END AS termbase_status FROM (
      SELECT *, CASE WHEN {_gone('glossary_hash')} OR {_idle('glossary_ran')} THEN CASE WHEN human_review = 'approved' THEN 'not_built' ELSE 'not_ready' END
        WHEN human_review <> 'approved' OR {_bad('glossary_approved_hash')} THEN 'stale' ELSE 'current' END AS glossary_status FROM v_state)""",
)
view(
    "v_state3",
    f"""SELECT *, CASE WHEN translation_status <> 'current' THEN CASE WHEN NOT ({_gone('tr_review_hash')}) OR NOT ({_idle('tr_ran')}) THEN 'stale' ELSE 'not_ready' END
        WHEN {_bad('base_draft_hash')} THEN 'stale' WHEN {_idle('tr_ran')} THEN 'pending'
        WHEN {_bad('tr_output_stored', 'tr_termbase_stored', 'tr_draft_stored')} OR {_differs('tr_review_stored', 'tr_review_hash')} THEN 'stale'
        WHEN doc_id % 12 = 0 THEN 'qa_failed' WHEN doc_id % 12 = 4 THEN 'qa_passed' WHEN doc_id % 33 <> 0 THEN 'approved' ELSE 'stale' END AS translation_review FROM (
      SELECT *, CASE WHEN {_idle('translation_ran')} THEN CASE WHEN termbase_status = 'current' THEN 'not_run' ELSE 'not_ready' END
        WHEN termbase_status <> 'current' OR {_bad('translation_approved_hash', 'translation_termbase_hash', 'translation_prompt_hash')} THEN 'stale'
        WHEN doc_id % 15 = 4 THEN 'partial' WHEN {_differs('translation_stored_hash', 'translation_hash')} THEN 'stale' ELSE 'current' END AS translation_status FROM v_state2)""",
)
_PROGRESS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in K.STAGE_PROGRESS.items()) + "}"
view(
    "v_stage",
    f"""SELECT *, ({_PROGRESS})[stage]::BIGINT AS progress FROM (SELECT *, CASE WHEN translation_review = 'approved' THEN 'completed' WHEN translation_status = 'partial' THEN 'translation_partial'
      WHEN translation_review = 'qa_failed' THEN 'translation_qa_failed' WHEN translation_review IN ('pending', 'stale', 'qa_passed') OR translation_status = 'current' THEN 'translation_review'
      WHEN termbase_status = 'current' THEN 'ready_to_translate' WHEN glossary_status IN ('current', 'stale') THEN 'glossary_review' WHEN human_review = 'approved' THEN 'glossary'
      WHEN review_source_ready OR source_acquired THEN 'source_review' ELSE 'not_started' END AS stage FROM v_state3)""",
)


def status(name, build, columns, source):
    register(name, lambda s, d: build(states(s, d)).select("project_id", *columns), f"SELECT project_id, {', '.join(columns)} FROM {source}")


status("source_status", L.source_status, ["source_acquired", "review_source_ready", "qa_status", "human_review"], "v_state")
status("glossary_status", lambda p: L.glossary_status(L.source_status(p)), ["glossary_status", "termbase_status"], "v_state2")
status("translation_status", L.pipeline_status, ["translation_status"], "v_state3")
status("review_status", L.pipeline_status, ["translation_review"], "v_state3")
status("project_stage", lambda p: L.project_stage(L.pipeline_status(p)), ["stage", "progress"], "v_stage")
register(
    "review_availability",
    lambda s, d: L.review_availability(L.pipeline_status(states(s, d))).select("project_id", "source_open", "source_reason", "glossary_open", "glossary_reason", "translation_open", "translation_reason"),
    """SELECT project_id, source_open, CASE WHEN source_open THEN 'open' WHEN human_review = 'stale' THEN 'stale' ELSE 'not_ready' END AS source_reason, glossary_open,
      CASE WHEN glossary_open THEN 'open' WHEN glossary_status = 'stale' THEN 'stale' ELSE 'not_ready' END AS glossary_reason, translation_open,
      CASE WHEN translation_review = 'qa_failed' THEN 'qa_failed' WHEN translation_open THEN 'open' WHEN translation_review = 'stale' THEN 'stale' ELSE 'not_ready' END AS translation_reason FROM (
      SELECT *, human_review IN ('pending', 'approved') AS source_open, glossary_status = 'current' AS glossary_open,
        translation_status = 'current' AND translation_review NOT IN ('not_ready', 'stale') AS translation_open FROM v_state3)""",
)
register(
    "portfolio_summary",
    lambda s, d: L.portfolio_summary(L.project_stage(L.pipeline_status(states(s, d)))),
    "SELECT count(*) AS projects, count(*) FILTER (stage NOT IN ('not_started', 'completed')) AS in_progress, count(*) FILTER (stage = 'completed') AS completed, "
    "count(*) FILTER (stage = 'translation_qa_failed' OR doc_id % 35 = 0) AS needs_attention FROM v_stage",
)
register(
    "invalidate_on_change",
    lambda s, d: (lambda p: L.invalidate_on_change(p, p.select("project_id", F.when(F.col("doc_id") % 4 == 0, F.lit("new")).otherwise(F.col("prompt_hash")).alias("prompt_hash"))))(L.pipeline_status(states(s, d))).select("project_id", "translation_status", "invalidated"),
    "SELECT project_id, translation_status, translation_status IN ('partial', 'current', 'stale') AS invalidated FROM v_state3 WHERE doc_id % 4 = 0",
)
register(
    "draft_vs_review_base",
    lambda s, d: L.draft_vs_review_base(states(s, d)).select("project_id", "created", "base_status"),
    f"SELECT 'doc' || doc_id::VARCHAR AS project_id, {_gone('tr_review_hash')} AS created, CASE WHEN {_gone('tr_review_hash')} OR NOT ({_bad('base_draft_hash')}) THEN 'current' ELSE 'stale' END AS base_status FROM v_doc",
)


def _reuse(s, d, keys):
    p = states(s, d)
    want = p.select("project_id", F.col("approved_hash").alias(keys[0]), F.lit("2|4|500").alias(keys[1]))
    built = p.filter("doc_id % 3 <> 0").select("project_id", F.col("glossary_approved_hash").alias(keys[0]), F.when(F.col("doc_id") % 8 == 1, "3|4|500").otherwise("2|4|500").alias(keys[1]))
    return L.build_reuse(want, built, keys).select("project_id", "action")


_REUSE = f"SELECT 'doc' || doc_id::VARCHAR AS project_id, CASE WHEN doc_id % 3 = 0 THEN 'build' WHEN {_bad('glossary_approved_hash')} OR doc_id % 8 = 1 THEN 'stale' ELSE 'reuse' END AS action FROM v_doc"
register("candidate_build_reuse", lambda s, d: _reuse(s, d, ["approved_source_sha256", "parameters"]), _REUSE)
register("termbase_reuse", lambda s, d: _reuse(s, d, ["review_tsv_sha256", "termbase_sha256"]), _REUSE)

# --- Files ----------------------------------------------------------------------------------


def files(s, d):
    n = F.col("doc_id")
    name = F.concat(F.lit(K.OUTPUT_ROOT + "/"), F.when(n % 10 == 0, K.COMBINED_OUTPUT).otherwise(F.concat(F.lit("Card "), n.cast("string"), F.lit("_kor.txt"))))
    return V.documents(s, d).select("project_id", n.alias("doc_id"), name.alias("path"), X.text_sha256("text").alias("sha256"))


view(
    "v_file",
    f"SELECT project_id, doc_id, '{K.OUTPUT_ROOT}/' || CASE WHEN doc_id % 10 = 0 THEN '{K.COMBINED_OUTPUT}' ELSE 'Card ' || doc_id::VARCHAR || '_kor.txt' END AS path, sha256(text) AS sha256 FROM v_doc",
)


def _verify(s, d):
    f = files(s, d).withColumn("path", F.concat("path", F.lit("."), F.col("doc_id").cast("string")))
    n = F.col("doc_id")
    approved = f.withColumn("path", F.when(n % 6 == 1, F.concat(F.lit("05_output/../"), "path")).otherwise(F.col("path"))).withColumn(
        "sha256", F.when(n % 6 == 2, "old").otherwise(F.col("sha256"))
    )
    return L.verify_outputs(approved, f.filter("doc_id % 6 <> 3")).select("project_id", "doc_id", "state")


register("verify_outputs", _verify,
         "SELECT project_id, doc_id, CASE doc_id % 6 WHEN 1 THEN 'bad_path' WHEN 2 THEN 'changed' WHEN 3 THEN 'missing' ELSE 'ok' END AS state FROM v_doc")
register("order_outputs", lambda s, d: L.order_outputs(files(s, d)).select("project_id", "name"),
         f"SELECT project_id, substr(path, {len(K.OUTPUT_ROOT) + 2}) AS name FROM v_file")
register("natural_order", lambda s, d: L.natural_order(files(s, d)).select("project_id", "path"), "SELECT project_id, path FROM v_file")
_LANES = ", ".join(f"sum(('0x' || substr(r, {1 + 8 * i}, 8))::UBIGINT)::VARCHAR AS s{i}" for i in range(8))
register(
    "dataset_fingerprint",
    lambda s, d: L.dataset_fingerprint(files(s, d)),
    f"SELECT project_id, items, sha256(concat_ws('|', '{K.SOURCE_BLOCK_VERSION}', items::VARCHAR, s0, s1, s2, s3, s4, s5, s6, s7)) AS fingerprint FROM ("
    f"SELECT project_id, count(*) AS items, {_LANES} FROM (SELECT project_id, sha256(length(path)::VARCHAR || '|' || path || '|' || sha256) AS r FROM v_file) GROUP BY 1)",
)
register(
    "sidecar_prompts",
    lambda s, d: L.sidecar_prompts(files(s, d).drop("sha256"), files(s, d).filter("doc_id % 4 = 1").withColumn("path", F.concat("path", F.lit(".prompt.txt")))).select("project_id", "doc_id", F.col("prompt_hash").isNotNull().alias("has_prompt")),
    "SELECT project_id, doc_id, doc_id % 4 = 1 AS has_prompt FROM v_doc",
)


def _inputs(s, d):
    n = F.col("doc_id")
    path = (
        F.when(n % 4 == 0, "01_input/book.PDF").when(n % 4 == 1, K.IMAGE_ROOT + "/a/b.webp").when(n % 4 == 2, "01_input/notes.txt").otherwise("04_translation/prompt.txt")
    )
    base = V.documents(s, d).select(F.concat("project_id", F.lit("/"), (n % 50).cast("string")).alias("project_id"), n.alias("doc_id"), path.alias("path"))
    return base.unionByName(base.filter("doc_id % 7 = 0").withColumn("path", F.lit("02_source/x.json")))


register(
    "detect_source_type",
    lambda s, d: L.detect_source_type(_inputs(s, d)),
    """SELECT project_id, CASE WHEN bool_or(m = 0) AND bool_or(m = 1) THEN 'mixed' WHEN bool_or(m = 0) THEN 'pdf' WHEN bool_or(m = 1) THEN 'images' END AS source_type,
      bool_or(doc_id % 7 = 0) AS processing_started FROM (SELECT project_id || '/' || (doc_id % 50)::VARCHAR AS project_id, doc_id, doc_id % 4 AS m FROM v_doc) GROUP BY 1""",
)

# --- Jobs -----------------------------------------------------------------------------------


def jobs(s, d):
    kind = F.col("event_type")
    return V.table(s, d, "events").select(
        F.col("user_id").cast("string").alias("project_id"), F.col("event_id").cast("string").alias("job_id"),
        F.when(kind.isin("view", "click"), "source").otherwise("translation").alias("kind"),
        F.when(kind == "view", "running").when(kind == "click", "queued").when(kind == "error", "failed").when(kind == "signup", "partial").otherwise("succeeded").alias("status"),
        F.when(kind == "signup", "").otherwise("working").alias("progress_message"),
        F.floor("value").cast("long").alias("progress_current"), F.lit(20).cast("long").alias("progress_total"),
        F.lit(None).cast("string").alias("error"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("_t"), F.col("ts").alias("ts"), F.col("event_id").alias("event_id"),
    ).withColumn("created_at", F.concat("_t", F.when(F.col("event_id") % 50 == 0, "").otherwise("Z"))).withColumn("updated_at", F.concat("_t", F.lit("Z"))).withColumn(
        "started_at", F.lit(None).cast("string")
    ).withColumn("finished_at", F.when(F.col("event_id") % 70 == 0, "soon").otherwise(F.col("updated_at"))).drop("_t")


view(
    "v_job",
    """SELECT user_id::VARCHAR AS project_id, event_id::VARCHAR AS job_id, event_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'source' ELSE 'translation' END AS kind,
      CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'succeeded' END AS status,
      event_type, value, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || CASE WHEN event_id % 50 = 0 THEN '' ELSE 'Z' END AS created_at FROM events""",
)
register(
    "validate_jobs",
    lambda s, d: VAL.invalid(VAL.validate_jobs(jobs(s, d))).select("job_id", joined("violations")),
    """SELECT job_id, violations FROM (SELECT job_id, concat_ws(',', CASE WHEN event_type = 'signup' THEN 'progress_message' END,
      CASE WHEN floor(value) < 0 THEN 'progress_current' END, CASE WHEN floor(value) > 20 THEN 'progress_range' END,
      CASE WHEN event_id % 50 = 0 THEN 'created_at' END, CASE WHEN event_id % 70 = 0 THEN 'finished_at' END) AS violations FROM v_job) WHERE violations <> ''""",
)
register(
    "latest_job",
    lambda s, d: J.latest_job(jobs(s, d), kind=True).select("project_id", "kind", "job_id", "status"),
    "SELECT project_id, kind, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY project_id, kind ORDER BY created_at DESC, job_id DESC) AS r FROM v_job) WHERE r = 1",
)
register(
    "read_job_records",
    lambda s, d: J.mark_interrupted(J.latest_job(jobs(s, d))).select("project_id", "job_id", "status", "interrupted"),
    "SELECT project_id, job_id, CASE WHEN status IN ('queued', 'running') THEN 'interrupted' ELSE status END AS status, status IN ('queued', 'running') AS interrupted FROM ("
    "SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) AS r FROM v_job) WHERE r = 1",
)


def _log(s, d):
    codes = [200, 400, 401, 403, 404, 408, 409, 429, 500, 599, 600]
    n = F.col("event_id")
    return V.table(s, d, "events").select(
        "event_id", F.col("user_id").cast("string").alias("project_id"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.when(n % 2 == 0, "gemini").otherwise("openai").alias("provider"),
        F.element_at(F.array(*[F.lit(c) for c in codes], F.lit(None).cast("int")), (n % 12 + 1).cast("int")).alias("http_status"),
        F.when(n % 5 == 0, "connection").when(n % 5 == 1, "timeout").otherwise("parse").alias("error_kind"),
        (F.col("event_type") != "error").alias("ok"), (n % 3 == 0).alias("cached"), (n % 4 == 0).alias("needs_review"),
    )


view(
    "v_log",
    """SELECT *, CASE WHEN http_status IN (400, 401) THEN p || 'API_KEY_OR_REQUEST_INVALID' WHEN http_status = 403 THEN p || 'PERMISSION_DENIED' WHEN http_status = 404 THEN p || 'MODEL_NOT_FOUND'
      WHEN http_status = 429 THEN p || 'QUOTA_EXCEEDED' WHEN http_status = 408 OR http_status BETWEEN 500 AND 599 THEN p || 'TEMPORARILY_UNAVAILABLE'
      WHEN http_status IS NULL AND event_id % 5 IN (0, 1) THEN p || 'NETWORK_ERROR' ELSE 'SOURCE_PROCESSING_FAILED' END AS failure_code,
      http_status IS NULL OR http_status IN (408, 429) OR (http_status = 409 AND p = 'OPENAI_') OR http_status NOT BETWEEN 400 AND 499 AS retryable FROM (
      SELECT event_id, user_id::VARCHAR AS project_id, strftime(ts, '%Y-%m-%d') AS run_id, CASE WHEN event_id % 2 = 0 THEN 'GEMINI_' ELSE 'OPENAI_' END AS p,
        ([200, 400, 401, 403, 404, 408, 409, 429, 500, 599, 600, NULL])[event_id % 12 + 1] AS http_status, event_type <> 'error' AS ok FROM events)""",
)
register("classify_failure", lambda s, d: J.classify_failure(_log(s, d)).select("event_id", "failure_code", "retryable"), "SELECT event_id, failure_code, retryable FROM v_log")
register(
    "acquisition_outcome",
    lambda s, d: J.acquisition_outcome(_log(s, d)),
    """SELECT *, CASE WHEN failures = 0 THEN 'succeeded' WHEN successful = 0 THEN 'failed' ELSE 'partial' END AS outcome FROM (
      SELECT project_id, run_id, count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (ok AND event_id % 3 = 0) AS cached,
        count(*) FILTER (ok AND event_id % 4 = 0) AS needs_review, count(*) FILTER (NOT ok) AS failures FROM v_log GROUP BY ALL)""",
)
register(
    "failure_counts",
    lambda s, d: J.failure_counts(J.classify_failure(_log(s, d))),
    "SELECT project_id, run_id, failure_code, count(*) AS n FROM v_log WHERE NOT ok GROUP BY ALL",
)
register(
    "acquisition_gate",
    lambda s, d: VAL.acquisition_gate(V.documents(s, d).select("project_id", "doc_id", F.when(F.col("doc_id") % 4 == 0, "partial").otherwise("complete").alias("status"), F.when(F.col("doc_id") % 6 == 1, F.array(F.lit("p1"))).when(F.col("doc_id") % 6 == 2, F.array().cast("array<string>")).alias("failures"))).select("project_id", "doc_id"),
    "SELECT project_id, doc_id FROM v_doc WHERE doc_id % 4 <> 0 AND doc_id % 6 <> 1",
)


def _manifests(s, d):
    n = F.col("doc_id")
    return V.documents(s, d).select(
        "doc_id", F.when(n % 9 == 0, 2).otherwise(3).alias("schema_version"),
        F.when(n % 11 == 0, "Doc 1").when(n % 23 == 1, "con").otherwise(F.concat(F.lit("doc_"), n.cast("string"))).alias("project_id"),
        F.when(n % 13 == 0, " ").otherwise("name").alias("name"), F.lit("default").alias("profile"), F.lit("en").alias("source_language"),
        F.when(n % 17 == 0, "k").otherwise("pt-BR").alias("target_language"), F.when(n % 19 == 0, "/abs.pdf").when(n % 19 == 1, "a/../b.pdf").alias("source_file"),
        F.when(n % 21 == 0, "yesterday").otherwise("2026-07-26T10:00:00Z").alias("created_at"),
    )


register(
    "validate_manifests",
    lambda s, d: VAL.validate_manifests(_manifests(s, d)).select("doc_id", joined("violations")),
    """SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 9 = 0 THEN 'schema_version' END, CASE WHEN doc_id % 11 = 0 OR doc_id % 23 = 1 THEN 'project_id' END,
      CASE WHEN doc_id % 13 = 0 THEN 'name' END, CASE WHEN doc_id % 17 = 0 THEN 'target_language' END, CASE WHEN doc_id % 19 IN (0, 1) THEN 'source_file' END,
      CASE WHEN doc_id % 21 = 0 THEN 'created_at' END) AS violations FROM v_doc""",
)
