"""Queries for review files, reports, human edits and outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.catalog import sqlviews as S
from lexiloom.catalog import translation as CT
from lexiloom.catalog.blocks import issues, joined, unordered_issues
from lexiloom.catalog.registry import register
from lexiloom.catalog.sqlviews import view
from lexiloom.functions import text as X
from lexiloom.operators import blocks as B
from lexiloom.operators import rendering as R
from lexiloom.operators import scale
from lexiloom.operators.source_qa import effective_text
from lexiloom.plans import testviews as V
from lexiloom.session import settle
from lexiloom.sources import readers

_NL = "chr(10)"
_PLACE = "CASE WHEN page IS NOT NULL THEN '[PAGE ' || page::VARCHAR || ']' ELSE '[SOURCE ' || source_file || ']' END"


def hashed(df, *keys):
    return df.select(*keys, X.text_sha256("part").alias("hash"))


register(
    "render_source_review",
    lambda s, d: hashed(R.render_source_review(V.blocks(s, d)), "project_id", "source_order"),
    f"""SELECT project_id, source_order, sha256({_PLACE} || {_NL} || '[BLOCK ' || id || ']' || {_NL} || {S.strip('eff')} || {_NL} || '[[END ' || id || ']]'
      || {_NL} || {_NL} || '{K.REVIEW_SEPARATOR}' || {_NL}) AS hash FROM v_block
      UNION ALL SELECT DISTINCT project_id, 0, sha256('{K.SOURCE_REVIEW_HEADER}' || {_NL}) FROM v_block""",
)
register(
    "render_problems",
    lambda s, d: R.render_problems(
        V.block_rows(s, d), F.when(F.col("line") % 9 == 2, " \n").when(F.col("line") % 9 == 4, F.concat("raw_text", F.lit("\n[[END "), "id", F.lit("]]"))).otherwise(F.col("raw_text"))
    ).select("project_id", "id", "problem"),
    "SELECT project_id, id, CASE line % 9 WHEN 2 THEN 'empty_text' ELSE 'reserved_marker' END AS problem FROM v_block WHERE line % 9 IN (2, 4)",
)
view(
    "v_marked",
    f"""SELECT *, lag(place) OVER (PARTITION BY project_id ORDER BY source_order) IS NULL AS first,
      lag(place) OVER (PARTITION BY project_id ORDER BY source_order) IS DISTINCT FROM place AS changed FROM (SELECT *, {_PLACE} AS place FROM v_reviewed)""",
)
register(
    "locator_change",
    lambda s, d: R.locator_change(V.segments(s, d)).select("project_id", "source_block_id", "changed", "first"),
    "SELECT project_id, source_block_id, changed, first FROM v_marked",
)
register(
    "render_translation_review",
    lambda s, d: hashed(R.render_translation_review(V.segments(s, d), F.col("translated_text")), "project_id", "source_order"),
    f"""SELECT project_id, source_order, sha256(CASE WHEN changed THEN CASE WHEN first THEN '' ELSE {_NL} || '{K.REVIEW_SEPARATOR}' || {_NL} || {_NL} END || place || {_NL} ELSE '' END
      || '[BLOCK ' || source_block_id || ']' || {_NL} || '[ORIGINAL]' || {_NL} || source_text || {_NL} || '[TRANSLATION]' || {_NL} || translated_text || {_NL}
      || '[[END ' || source_block_id || ']]' || {_NL}) AS hash FROM v_marked
      UNION ALL SELECT DISTINCT project_id, 0, sha256('{K.TRANSLATION_REVIEW_HEADER}' || {_NL}) FROM v_marked""",
)
register(
    "render_final_translation",
    lambda s, d: hashed(R.render_final_translation(CT.approved(s, d)), "project_id", "source_order"),
    f"""SELECT project_id, source_order, sha256(CASE WHEN changed THEN CASE WHEN first THEN '' ELSE '{K.FINAL_SEPARATOR}' || {_NL} || {_NL} END
      || CASE WHEN page IS NOT NULL THEN place ELSE '[' || split_part(source_file, '/', -1) || ']' END || {_NL} || {_NL} ELSE '' END
      || {S.strip('reviewed')} || {_NL}) AS hash FROM v_marked""",
)
_BELOW = f"substr(source_file, {len(K.IMAGE_ROOT) + 2})"
_OUT = f"'{K.OUTPUT_ROOT}/' || regexp_extract({_BELOW}, '^(.*/)[^/]*$', 1) || {S.stem(_BELOW)} || '_kor.txt'"
register(
    "per_source_outputs",
    lambda s, d: hashed(R.per_source_outputs(CT.approved(s, d)), "project_id", "out_path", "source_order"),
    f"SELECT project_id, {_OUT} AS out_path, source_order, sha256({S.strip('reviewed')} || {_NL}) AS hash FROM v_reviewed WHERE starts_with(source_file, '{K.IMAGE_ROOT}/')",
)


def _files(s, d):
    n = F.floor(F.col("doc_id") / 20)
    ext = F.when(n % 2 == 0, ".png").otherwise(".JPG")
    name = F.concat(F.when(n % 3 == 0, "Card ").otherwise("card "), F.floor(n / 3).cast("string"), ext)
    return V.documents(s, d).select("project_id", F.concat("project_id", F.lit("/"), name).alias("path"))


view(
    "v_path",
    """SELECT DISTINCT project_id, project_id || '/' || CASE WHEN n % 3 = 0 THEN 'Card ' ELSE 'card ' END || (n // 3)::VARCHAR ||
      CASE WHEN n % 2 = 0 THEN '.png' ELSE '.JPG' END AS path FROM (SELECT *, doc_id // 20 AS n FROM v_doc)""",
)
register(
    "path_collisions",
    lambda s, d: R.path_collisions(_files(s, d)),
    r"""SELECT project_id, kind, key, count(*) AS files, min(path) AS first_path FROM (
      SELECT project_id, path, 'input' AS kind, lower(path) AS key FROM v_path UNION ALL
      SELECT project_id, path, 'output', lower(regexp_replace(path, '\.[^./]+$', '') || '.txt') FROM v_path) GROUP BY project_id, kind, key HAVING count(*) > 1""",
)

# --- Reading reviews back: every document is a project of its own ---------------------------


def _numbered(rows):
    """What reviews read of block rows, numbered within their documents."""
    named = rows.withColumn("project_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).select(
        "project_id", "doc_id", "line", "id", "source_type", "source_file", "page", "block_type", "raw_text", "corrected_text"
    )
    return settle(scale.number_rows(named, ["project_id"], "line", [], "source_order"))


def doc_segments(s, d):
    return V.segments(s, d, _numbered(V.block_rows(s, d).filter("project_id IS NOT NULL")))


def doc_blocks(s, d):
    return _numbered(V.block_rows(s, d))


def numbered_lines(parts):
    """Lines of parts with their numbers: the lines of each part are counted, so parts move once, and as a whole."""
    lines = F.split("part", "\n")
    counted = parts.select("project_id", "source_order", "part", F.when(F.col("part").isNull(), 0).otherwise(F.size(lines)).alias("n"))
    placed = scale.running_total(counted, ["project_id"], "source_order", [], F.col("n"), "last")
    split = placed.select("project_id", "source_order", (F.col("last") - F.col("n")).alias("before"), F.posexplode(lines).alias("i", "line"))
    return settle(split.select("project_id", "source_order", "line", (F.col("before") + F.col("i") + 1).alias("line_no")))


def edited(lines):
    """One kind of damage per document number; 0 and 4 stay well formed."""
    kind = F.substring("project_id", 4, 20).cast("long") % 5
    is_end = F.col("line").rlike(K.END_MARKER) & (F.col("source_order") == 2)
    return lines.select(
        "project_id", "line_no",
        F.when((kind == 1) & (F.col("line_no") == 1), "no header")
        .when((kind == 2) & is_end, "[[END other]]")
        .when((kind == 3) & (F.col("source_order") == 2) & F.startswith("line", F.lit("[BLOCK")), "[BLOCK strange]")
        .otherwise(F.col("line")).alias("line"),
    )


view(
    "v_doc_block",
    "SELECT 'doc' || doc_id::VARCHAR AS project_id, doc_id, id, line, eff, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM v_block",
)
_CODE = "CASE doc_id % 5 WHEN 1 THEN 'invalid_header' WHEN 2 THEN 'end_marker_changed' WHEN 3 THEN 'block_order_changed' END"


def source_review(s, d):
    b = doc_blocks(s, d)
    return R.parse_source_review(edited(numbered_lines(R.render_source_review(b))), b)


register(
    "parse_source_review",
    lambda s, d: source_review(s, d)[0].select("project_id", "block_id", X.text_sha256("text").alias("hash")),
    f"SELECT project_id, id AS block_id, sha256({S.strip('eff')}) AS hash FROM v_doc_block WHERE NOT (doc_id % 5 IN (2, 3) AND n = 2)",
)
view(
    "v_review_problem",
    f"""SELECT project_id, CASE WHEN doc_id % 5 = 1 THEN NULL ELSE id END AS block_id, {_CODE} AS code
      FROM v_doc_block WHERE (doc_id % 5 = 1 AND n = 1) OR (doc_id % 5 IN (2, 3) AND n = 2)""",
)
register("source_review_problems", lambda s, d: R.first_problem(source_review(s, d)[1]), "SELECT * FROM v_review_problem")


def translation_review(s, d):
    seg = doc_segments(s, d)
    return R.parse_translation_review(edited(numbered_lines(settle(R.render_translation_review(seg, F.col("translated_text"))))), seg)


register(
    "parse_translation_review",
    lambda s, d: translation_review(s, d)[0].select("project_id", "block_id", X.text_sha256("text").alias("hash")),
    "SELECT 'doc' || doc_id::VARCHAR AS project_id, source_block_id AS block_id, sha256(translated_text) AS hash FROM v_segment s "
    "WHERE NOT EXISTS (SELECT 1 FROM v_doc_block b WHERE b.id = s.source_block_id AND b.doc_id % 5 IN (2, 3) AND b.n = 2)",
)
register("translation_review_problems", lambda s, d: R.first_problem(translation_review(s, d)[1]), "SELECT * FROM v_review_problem")

# --- Reports --------------------------------------------------------------------------------

register(
    "source_qa_report",
    lambda s, d: R.source_qa_report(issues(s, d)).select("project_id", "number", X.text_sha256("entry").alias("hash")),
    f"""SELECT project_id, number, sha256(printf('### Q-%04d [%s] %s', number, severity, code) || {_NL} || 'in ' || source_file ||
      CASE WHEN page IS NOT NULL THEN ', page ' || page::VARCHAR ELSE '' END || {_NL} || 'block ' || block_id || {_NL} || '> ' || replace(evidence, '`', '''') || {_NL}) AS hash FROM (
      SELECT i.*, b.page, b.source_file, row_number() OVER (PARTITION BY i.project_id ORDER BY i.source_order, i.code, i.id) AS number
      FROM v_issue i JOIN v_block b ON b.project_id = i.project_id AND b.id = i.block_id)""",
)
register(
    "translation_qa_report",
    lambda s, d: R.translation_qa_report(CT.tissues(s, d)).select("project_id", "line"),
    r"SELECT project_id, '|' || block_id || '|' || code || '|' || severity || '|' || replace(replace(coalesce(detail, ''), '|', '\|'), chr(10), ' ') || '|' AS line FROM v_tissue",
)

# --- Human edits ----------------------------------------------------------------------------


def edits(rows):
    """Review edits: some texts changed, some blocks excluded, some lost, one new block per document."""
    k = F.col("doc_id") + F.col("line")
    text = F.when(k % 6 == 0, F.concat("raw_text", F.lit(" edited"))).otherwise(F.col("raw_text"))
    kept = rows.filter(k % 101 != 0).select(
        "project_id", (F.col("source_order") * 2).alias("position"), "id", text.alias("text"), (k % 10 == 3).alias("excluded"),
        F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("string").alias("source_file"),
        F.lit(None).cast("long").alias("page"), F.lit(None).cast("array<double>").alias("bbox"),
    )
    new = rows.filter("line = 0").select(
        "project_id", (F.col("source_order") * 2 + 1).alias("position"), F.concat(F.lit("new-"), "id").alias("id"),
        F.concat(F.lit("Added by hand "), F.col("doc_id").cast("string")).alias("text"), F.lit(False).alias("excluded"),
        "source_type", "source_file", "page",
        F.array(F.lit(1.0), F.lit(2.0), F.when(F.col("doc_id") % 8 == 0, 1.0).otherwise(9.0), F.lit(9.0)).alias("bbox"),
    )
    return kept.unionByName(new)


def _edited(s, d):
    """Review rows and violations; the rows are not stored, for flows that read them once."""
    rows = V.blocks(s, d)
    return B.apply_review_edits(rows, edits(rows))


def reviewed_rows(s, d):
    flat, problems = _edited(s, d)
    return settle(flat), problems


view(
    "v_edit",
    """SELECT project_id, doc_id, line, source_type, source_file, page, id, raw_text, warnings, source_order * 2 AS position,
      CASE WHEN (doc_id + line) % 6 = 0 THEN raw_text || ' edited' ELSE raw_text END AS text, (doc_id + line) % 10 = 3 AS excluded, FALSE AS manual
      FROM v_block WHERE (doc_id + line) % 101 <> 0
    UNION ALL SELECT project_id, doc_id, line, source_type, source_file, page, NULL, 'Added by hand ' || doc_id::VARCHAR, [], source_order * 2 + 1,
      'Added by hand ' || doc_id::VARCHAR, FALSE, TRUE FROM v_block WHERE line = 0""",
)
_TEXT = S.strip("text")
register(
    "apply_review_edits",
    lambda s, d: reviewed_rows(s, d)[0].select("project_id", "position", "manual", "excluded", X.text_sha256("text").alias("hash"), F.col("corrected_text").isNotNull().alias("corrected")),
    f"SELECT project_id, position, manual, excluded, sha256({_TEXT}) AS hash, NOT manual AND {_TEXT} <> raw_text AS corrected FROM v_edit",
)
register(
    "review_edit_problems",
    lambda s, d: reviewed_rows(s, d)[1].groupBy("project_id", "code").agg(F.count(F.lit(1)).alias("n")),
    "SELECT project_id, code, count(*) AS n FROM (SELECT project_id, 'missing_block' AS code FROM v_block WHERE (doc_id + line) % 101 = 0 "
    "UNION ALL SELECT project_id, 'bad_box' FROM v_edit WHERE manual AND doc_id % 8 = 0) GROUP BY ALL",
)
register("review_rows", lambda s, d: B.review_rows(reviewed_rows(s, d)[0]).select("project_id", "position"), "SELECT project_id, position FROM v_edit WHERE NOT excluded")
register(
    "renumber_approved",
    lambda s, d: B.renumber_approved(reviewed_rows(s, d)[0]).select("project_id", "position", "source_order", "block_order", "status"),
    "SELECT project_id, position, row_number() OVER (PARTITION BY project_id ORDER BY position) AS source_order, "
    "row_number() OVER (PARTITION BY project_id, source_file, page ORDER BY position) AS block_order, 'approved' AS status FROM v_edit WHERE NOT excluded",
)


def _moved(s, d):
    rows = reviewed_rows(s, d)[0]
    shifted = F.col("position") * 100 - F.when(F.pmod(F.col("position"), F.lit(46)) == 0, 4150).otherwise(0)
    places = B.place_order(V.blocks(s, d))
    return B.group_order_check(rows.withColumn("position", shifted), places)


register(
    "group_order_check",
    lambda s, d: _moved(s, d).select("project_id", "position", "place_rank", "previous_rank"),
    """SELECT * FROM (SELECT project_id, position, place_rank, lag(place_rank) OVER (PARTITION BY project_id ORDER BY position) AS previous_rank FROM (
      SELECT e.project_id, e.position * 100 - CASE WHEN e.position % 46 = 0 THEN 4150 ELSE 0 END AS position, p.place_rank FROM v_edit e JOIN (
        SELECT project_id, source_file, page, min(source_order) AS place_rank FROM v_block GROUP BY ALL) p
        ON p.project_id = e.project_id AND p.source_file = e.source_file AND p.page IS NOT DISTINCT FROM e.page)) WHERE previous_rank > place_rank""",
)


def _state(s, d):
    rows = V.block_rows(s, d)
    k = F.col("doc_id") + F.col("line")
    return B.layout_state_equal(
        rows.filter(k % 97 != 0).select("project_id", F.when(k % 89 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"), (k % 10 == 3).alias("excluded")),
        rows.select("project_id", "id", (k % 20 == 13).alias("manual")),
    )


register(
    "layout_state_equal",
    _state,
    """SELECT *, missing + unknown + repeated + bad_exclusions = 0 AS valid FROM (
      SELECT project_id, count(*) FILTER (k % 97 = 0 OR k % 89 = 0) AS missing, count(*) FILTER (k % 89 = 0 AND k % 97 <> 0) AS unknown, 0 AS repeated,
        count(*) FILTER (k % 97 <> 0 AND k % 10 = 3 AND (k % 89 = 0 OR k % 20 = 13)) AS bad_exclusions
      FROM (SELECT *, doc_id + line AS k FROM v_block) GROUP BY project_id)""",
)
register(
    "review_summary",
    lambda s, d: B.review_summary(_edited(s, d)[0], unordered_issues(s, d)),
    f"""SELECT e.project_id, blocks, included, excluded, manual, changed, warnings, layout_warnings, issues FROM (
      SELECT project_id, count(*) AS blocks, count(*) FILTER (NOT excluded) AS included, count(*) FILTER (excluded) AS excluded, count(*) FILTER (manual) AS manual,
        count(*) FILTER (manual OR {_TEXT} <> raw_text) AS changed, sum(len(warnings))::BIGINT AS warnings,
        sum(len(list_filter(warnings, lambda w: starts_with(w, '{K.RECOVERY_PREFIX}'))))::BIGINT AS layout_warnings FROM v_edit GROUP BY 1) e
      JOIN (SELECT project_id, count(*) AS issues FROM v_issue GROUP BY 1) i ON i.project_id = e.project_id""",
)
register(
    "attach_issues",
    lambda s, d: B.attach_issues(V.block_rows(s, d), unordered_issues(s, d)).select("project_id", "id", F.array_join(F.transform("issues", lambda i: F.concat(i["code"], F.lit(":"), i["severity"])), ",").alias("issues")),
    "SELECT b.project_id, b.id, coalesce(string_agg(code || ':' || severity, ',' ORDER BY code, severity, evidence), '') AS issues FROM v_block b "
    "LEFT JOIN v_issue i ON i.project_id = b.project_id AND i.block_id = b.id GROUP BY b.project_id, b.id",
)


def _finalize(s, d):
    k = F.col("doc_id") + F.col("line")
    text = F.when(k % 7 == 2, F.replace("raw_text", F.lit("{DMGR}"), F.lit("{Dark}"))).otherwise(effective_text())
    rows = V.block_rows(s, d).withColumn("text", text)
    return B.source_finalize_gate(rows, readers.allowed_tokens(V.prompts(s, d), "prompt"))


_TOK = r"\{([A-Za-z][A-Za-z0-9_]*)\}"
register(
    "source_finalize_gate",
    lambda s, d: _finalize(s, d).select("project_id", "id", joined("violations")),
    rf"""SELECT project_id, id, violations FROM (SELECT project_id, id, concat_ws(',', CASE WHEN contains(x, '{K.REPLACEMENT_CHAR}') THEN 'replacement_character' END,
      CASE WHEN contains(upper(x), '[ILLEGIBLE]') THEN 'illegible' END, CASE WHEN regexp_matches(x, '(?i)\[ICON:\s*[^\]]+\]') THEN 'unresolved_icon' END,
      CASE WHEN regexp_matches(regexp_replace(x, '{_TOK}', '', 'g'), '[{{}}]') THEN 'malformed_token' END,
      CASE WHEN known IS NOT NULL AND len(list_filter(regexp_extract_all(x, '{_TOK}', 1), lambda t: NOT list_contains(known, t))) > 0 THEN 'unknown_token' END,
      CASE WHEN list_sort(regexp_extract_all(x, '{_TOK}', 1)) <> list_sort(regexp_extract_all(raw_text, '{_TOK}', 1)) THEN 'token_changed' END) AS violations FROM (
        SELECT b.*, CASE WHEN (doc_id + line) % 7 = 2 THEN replace(raw_text, '{{DMGR}}', '{{Dark}}') ELSE eff END AS x, k.known FROM v_block b
        LEFT JOIN (SELECT project_id, list(token) AS known FROM v_token GROUP BY 1) k ON k.project_id = b.project_id)) WHERE violations <> ''""",
)
