"""Queries for page layout, transcription results and block numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.catalog import sqlviews as S
from lexiloom.catalog.blocks import joined
from lexiloom.catalog.registry import register
from lexiloom.catalog.sqlviews import view
from lexiloom.functions import text as X
from lexiloom.operators import blocks as B
from lexiloom.operators import layout as L
from lexiloom.operators import validation as VAL
from lexiloom.plans import testviews as V

view(
    "v_fragment",
    r"""SELECT project_id, page, doc_id, pos, printf('P%03d-F%03d', page, pos) AS id,
    CASE WHEN (doc_id + pos) % 9 = 0 THEN t || '-' WHEN (doc_id + pos) % 9 IN (1, 3) THEN lower(t)
         WHEN (doc_id + pos) % 9 = 2 THEN regexp_replace(t, '[.!?]+$', '') ELSE t END AS text,
    (pos - 1) // 3 AS block_index, (pos % 50 + 10)::DOUBLE AS x0, (pos * 5)::DOUBLE AS y0,
    (pos % 50 + 10)::DOUBLE + 290 + (pos % 200)::DOUBLE AS x1, (pos * 5)::DOUBLE + 4.5 AS y1
  FROM (SELECT *, doc_id + 1 AS page, row_number() OVER (PARTITION BY project_id, doc_id ORDER BY line) AS pos FROM v_line)""",
)
_KIND = "CASE block_pos % 9 WHEN 1 THEN 'heading' WHEN 5 THEN 'list_item' WHEN 8 THEN 'page_number' ELSE 'paragraph' END"
view(
    "v_ref",
    f"""SELECT *, {_KIND} AS type, block_pos % 9 <> 8 AS include_in_text FROM (
    SELECT project_id, page, (pos - 1) // 2 + 1 AS block_pos, (pos - 1) % 2 + 1 AS ref_pos, id AS fragment_id FROM v_fragment WHERE (doc_id + pos) % 7 <> 0
    UNION ALL SELECT project_id, page, (pos - 1) // 2 + 1, 10, id FROM v_fragment WHERE (doc_id + pos) % 11 = 0
    UNION ALL SELECT project_id, page, (pos - 1) // 2 + 1, 20, printf('P999-F%03d', pos) FROM v_fragment WHERE (doc_id + pos) % 13 = 0)""",
)
view(
    "v_coverage",
    """SELECT project_id, page, sum(e)::BIGINT AS expected_count, sum(r)::BIGINT AS returned_count,
    coalesce(string_agg(CASE WHEN e > 0 AND r = 0 THEN fid END, ',' ORDER BY fid), '') AS missing,
    coalesce(string_agg(CASE WHEN e = 0 THEN fid END, ',' ORDER BY fid), '') AS unknown,
    coalesce(string_agg(CASE WHEN r > 1 THEN fid END, ',' ORDER BY fid), '') AS duplicates FROM (
      SELECT project_id, page, fid, sum(e) AS e, sum(r) AS r FROM (
        SELECT project_id, page, id AS fid, 1 AS e, 0 AS r FROM v_fragment UNION ALL
        SELECT project_id, page, fragment_id, 0, 1 FROM v_ref) GROUP BY ALL) GROUP BY ALL""",
)
view(
    "v_first",
    """SELECT r.*, f.pos FROM (SELECT *, row_number() OVER (PARTITION BY project_id, page, fragment_id ORDER BY block_pos, ref_pos) AS n FROM v_ref) r
  JOIN v_fragment f ON f.project_id = r.project_id AND f.page = r.page AND f.id = r.fragment_id WHERE n = 1""",
)
view(
    "v_lost",
    """SELECT *, sum(fresh) OVER (PARTITION BY project_id, page ORDER BY pos)::BIGINT AS group_no FROM (
    SELECT f.*, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(block_index) OVER w = block_index THEN 0 ELSE 1 END AS fresh FROM v_fragment f
    WHERE NOT EXISTS (SELECT 1 FROM v_ref r WHERE r.project_id = f.project_id AND r.page = f.page AND r.fragment_id = f.id)
    WINDOW w AS (PARTITION BY project_id, page ORDER BY pos))""",
)
view(
    "v_recover",
    """SELECT project_id, page, dense_rank() OVER (PARTITION BY project_id, page ORDER BY anchor, side, grp) AS block_pos,
    row_number() OVER (PARTITION BY project_id, page, anchor, side, grp ORDER BY coalesce(ref_pos, pos)) AS ref_pos,
    fragment_id, type, include_in_text, group_no IS NOT NULL AS recovered FROM (
      SELECT *, coalesce(block_pos, nxt, prev, -1) AS anchor, CASE WHEN group_no IS NULL THEN 1 WHEN nxt IS NOT NULL THEN 0 ELSE 2 END AS side,
        coalesce(group_no, 0) AS grp FROM (
        SELECT *, (SELECT b.block_pos FROM v_first b WHERE b.project_id = a.project_id AND b.page = a.page AND b.pos > a.pos ORDER BY b.pos LIMIT 1) AS nxt,
          (SELECT b.block_pos FROM v_first b WHERE b.project_id = a.project_id AND b.page = a.page AND b.pos < a.pos ORDER BY b.pos DESC LIMIT 1) AS prev
        FROM (SELECT project_id, page, pos, fragment_id, block_pos, ref_pos, type, include_in_text, NULL AS group_no FROM v_first UNION ALL
              SELECT project_id, page, pos, id, NULL, NULL, 'paragraph', TRUE, group_no FROM v_lost) a))""",
)
_FOLD = (
    r"lambda a, x: CASE WHEN ends_with(a, '-') AND regexp_matches(x, '^\p{Ll}') THEN substr(a, 1, length(a) - 1) || x "
    r"WHEN regexp_matches(a, '[/(\[{‘“]$') THEN a || x ELSE a || ' ' || x END"
)
_HYPHENS = r"len(list_filter(range(2, len({l}) + 1), lambda i: ends_with({l}[i - 1], '-') AND regexp_matches({l}[i], '^\p{{Ll}}')))"
view(
    "v_rebuilt",
    f"""SELECT project_id, page, block_pos, type, include_in_text, recovered, ids, x0, y0, x1, y1,
    {S.collapse(f'list_reduce(parts, {_FOLD})')} AS text, CASE WHEN recovered THEN len(ids) ELSE 0 END + {_HYPHENS.format(l='parts')} AS notes FROM (
      SELECT r.project_id, r.page, r.block_pos, any_value(type) AS type, any_value(include_in_text) AS include_in_text, bool_or(recovered) AS recovered,
        list(r.fragment_id ORDER BY ref_pos) AS ids, list({S.strip('f.text')} ORDER BY ref_pos) AS parts,
        min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
      FROM v_recover r JOIN v_fragment f ON f.project_id = r.project_id AND f.page = r.page AND f.id = r.fragment_id GROUP BY r.project_id, r.page, r.block_pos)""",
)
view(
    "v_merged",
    rf"""SELECT project_id, page, row_number() OVER (PARTITION BY project_id, page ORDER BY block_pos) AS block_order, type, include_in_text, ids, x0, y0, x1, y1,
    {S.collapse(f'list_reduce(parts, {_FOLD})')} AS text, notes + {_HYPHENS.format(l='parts')} AS notes, len(parts) > 1 AS merged FROM (
    SELECT project_id, page, island, min(block_pos) AS block_pos, any_value(type) AS type, any_value(include_in_text) AS include_in_text,
      string_agg(array_to_string(ids, ','), ',' ORDER BY block_pos) AS ids, list(text ORDER BY block_pos) AS parts, sum(notes)::BIGINT AS notes,
      min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY project_id, page ORDER BY block_pos) AS island FROM (
        SELECT *, CASE WHEN plain AND lag(plain) OVER w AND NOT regexp_matches(lag(text) OVER w, '[.!?:;]["''’”)]?$')
          AND regexp_matches(regexp_replace(text, '^["''‘’“”(]+', ''), '^\p{{Ll}}') THEN 0 ELSE 1 END AS fresh
        FROM (SELECT *, type = 'paragraph' AND include_in_text AND NOT recovered AS plain FROM v_rebuilt)
        WINDOW w AS (PARTITION BY project_id, page ORDER BY block_pos))) GROUP BY project_id, page, island)""",
)


def frags(s, d):
    return V.fragments(s, d)


def both(s, d):
    f = frags(s, d)
    return f, V.refs(f)


register("number_fragments", lambda s, d: frags(s, d).select("project_id", "page", "pos", "id", X.text_sha256("text").alias("hash")),
         "SELECT project_id, page, pos, id, sha256(text) AS hash FROM v_fragment")
register(
    "layout_coverage",
    lambda s, d: L.layout_coverage(*both(s, d)).select("project_id", "page", "expected_count", "returned_count", joined("missing"), joined("unknown"), joined("duplicates"), "valid"),
    "SELECT *, missing = '' AND unknown = '' AND duplicates = '' AND expected_count = returned_count AS valid FROM v_coverage",
)
register("first_reference", lambda s, d: L.first_reference(*both(s, d)).select("project_id", "page", "fragment_id", "block_pos", "ref_pos"),
         "SELECT project_id, page, fragment_id, block_pos, ref_pos FROM v_first")
register("missing_groups", lambda s, d: L.missing_groups(*both(s, d)).select("project_id", "page", "id", "group_no"),
         "SELECT project_id, page, id, group_no FROM v_lost")
register("recover_layout", lambda s, d: L.recover_layout(*both(s, d)).drop("reason"), "SELECT * FROM v_recover")


def rebuilt(s, d):
    f, r = both(s, d)
    return L.reconstruct_blocks(f, L.recover_layout(f, r))


register(
    "reconstruct_blocks",
    lambda s, d: rebuilt(s, d).select("project_id", "page", "block_pos", "type", joined("fragment_ids"), "text", F.size("warnings").cast("long").alias("notes")),
    "SELECT project_id, page, block_pos, type, array_to_string(ids, ',') AS fragment_ids, text, notes FROM v_rebuilt",
)
register(
    "bbox_union",
    lambda s, d: rebuilt(s, d).select("project_id", "page", "block_pos", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]),
    "SELECT project_id, page, block_pos, x0, y0, x1, y1 FROM v_rebuilt",
)
register(
    "join_fragments",
    lambda s, d: rebuilt(s, d).select("project_id", "page", "block_pos", X.text_sha256("text").alias("hash")),
    "SELECT project_id, page, block_pos, sha256(text) AS hash FROM v_rebuilt",
)
register(
    "merge_continuations",
    lambda s, d: V.layout_blocks(s, d).select("project_id", "page", "block_order", "type", joined("fragment_ids"), "text", "merged", F.size("warnings").cast("long").alias("notes")),
    "SELECT project_id, page, block_order, type, ids AS fragment_ids, text, merged, notes FROM v_merged",
)
register("included_blocks", lambda s, d: B.included_blocks(V.layout_blocks(s, d)).select("project_id", "page", "block_order", "type"),
         "SELECT project_id, page, block_order, type FROM v_merged WHERE include_in_text")
register("page_text", lambda s, d: L.page_text(V.layout_blocks(s, d)),
         "SELECT project_id, page, string_agg(text, chr(10) || chr(10) ORDER BY block_order) AS text FROM v_merged WHERE include_in_text AND text <> '' GROUP BY ALL")
register(
    "combined_text",
    lambda s, d: L.combined_text(L.page_text(V.layout_blocks(s, d))),
    "SELECT project_id, page, '[PAGE ' || page::VARCHAR || ']' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY block_order) AS section "
    "FROM v_merged WHERE include_in_text AND text <> '' GROUP BY project_id, page",
)

view(
    "v_ocr",
    f"""SELECT 'img-' || project_id AS project_id, '{K.IMAGE_ROOT}/' || project_id || '/Card ' || doc_id::VARCHAR || '.png' AS source_file,
    doc_id AS source_pos, line AS block_order, CASE WHEN (doc_id + line) % 17 = 0 THEN 'stamp' WHEN line = 1 THEN 'title' ELSE 'body' END AS type,
    t || CASE WHEN (doc_id + line) % 19 = 0 THEN ' [ILLEGIBLE]' ELSE '' END AS text, (doc_id + line) % 23 = 0 AS reversed, (line * 3) % 900 AS y,
    CASE WHEN (doc_id + line) % 29 = 0 THEN 'uncertain' ELSE 'clear' END AS legibility, doc_id % 10 = 0 AS glare FROM v_line""",
)
view(
    "v_image_block",
    f"""SELECT *, {S.block_id("'image'", 'source_file', 'NULL', 'block_order')} AS id,
      CASE WHEN legibility = 'uncertain' OR glare THEN 'flagged' ELSE 'raw' END AS status FROM v_ocr""",
)
register(
    "validate_ocr",
    lambda s, d: VAL.invalid(VAL.validate_ocr(V.ocr_rows(s, d))).select("project_id", "source_pos", "block_order", joined("violations")),
    "SELECT project_id, source_pos, block_order, concat_ws(',', CASE WHEN type = 'stamp' THEN 'type' END, CASE WHEN reversed THEN 'bbox' END) AS violations "
    "FROM v_ocr WHERE type = 'stamp' OR reversed",
)
register(
    "ocr_status",
    lambda s, d: VAL.ocr_status(V.ocr_rows(s, d), ["project_id", "source_file"]),
    "SELECT project_id, source_file, count(*) AS blocks, CASE WHEN bool_or(legibility = 'uncertain' OR contains(text, '[ILLEGIBLE]')) "
    "THEN 'needs_review' ELSE 'complete' END AS status FROM v_ocr GROUP BY ALL",
)
register(
    "image_blocks",
    lambda s, d: L.image_blocks(V.ocr_rows(s, d)).select("project_id", "id", "status", "block_type", "source_hash", F.format_string("%.2f", F.col("bbox")[0]).alias("x0")),
    "SELECT project_id, id, status, type AS block_type, 'sha256:' || sha256(text) AS source_hash, "
    "CASE WHEN reversed THEN printf('%.2f', y + 2.0) ELSE '10.13' END AS x0 FROM v_image_block",
)
register(
    "combined_ocr_text",
    lambda s, d: L.combined_ocr_text(
        V.ocr_rows(s, d).groupBy("project_id", "source_file").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_order", X.strip("text").alias("t")))), lambda b: b["t"]), "\n\n").alias("text")
        )
    ),
    "SELECT project_id, source_file, '[' || source_file || ']' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY block_order) || chr(10) || chr(10) || "
    f"'{K.REVIEW_SEPARATOR}' AS section FROM v_ocr GROUP BY project_id, source_file",
)


def pdf_source():
    return F.concat(F.lit("01_input/"), F.col("project_id"), F.lit(".pdf"))


def all_blocks(s, d):
    return B.unify_blocks(L.fragment_blocks(V.layout_blocks(s, d), pdf_source()), L.image_blocks(V.ocr_rows(s, d)))


_RND = "printf('%.2f', round_even(greatest(0.0, least(1000.0, {v} / {s} * 1000)), 2))"
view(
    "v_pdf_block",
    f"""SELECT *, {S.block_id("'pdf'", 'source_file', 'page', 'block_order')} AS id, CASE WHEN notes > 0 THEN 'flagged' ELSE 'raw' END AS status,
    concat_ws('|', {_RND.format(v='x0', s='600')}, {_RND.format(v='y0', s='800')}, {_RND.format(v='x1', s='600')}, {_RND.format(v='y1', s='800')}) AS box
    FROM (SELECT *, '01_input/' || project_id || '.pdf' AS source_file FROM v_merged WHERE include_in_text AND text <> '')""",
)
register(
    "fragment_blocks",
    lambda s, d: L.fragment_blocks(V.layout_blocks(s, d), pdf_source()).select(
        "project_id", "id", "status", "block_type", "source_hash", joined("source_refs"),
        F.array_join(F.transform("bbox", lambda v: F.format_string("%.2f", v)), "|").alias("box"),
    ),
    "SELECT project_id, id, status, type AS block_type, 'sha256:' || sha256(text) AS source_hash, ids AS source_refs, box FROM v_pdf_block",
)
_UNIFIED = (
    "SELECT project_id, id, page AS source_pos, block_order, 'pdf' AS source_type FROM v_pdf_block UNION ALL "
    "SELECT project_id, id, source_pos, block_order, 'image' FROM v_image_block"
)
register("unify_blocks", lambda s, d: all_blocks(s, d).select("project_id", "id", "source_pos", "block_order", "source_type"), _UNIFIED)
register(
    "assign_source_order",
    lambda s, d: B.assign_source_order(all_blocks(s, d)).select("project_id", "id", "source_order"),
    f"SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY source_pos, block_order) AS source_order FROM ({_UNIFIED})",
)
register(
    "select_pages",
    lambda s, d: B.select_pages(V.fragments(s, d), "1, 3-7,20-160,90", 100_000_000).select("project_id", "page", "id"),
    "SELECT project_id, page, id FROM v_fragment WHERE page = 1 OR page BETWEEN 3 AND 7 OR page BETWEEN 20 AND 160",
)
register(
    "merge_warnings",
    lambda s, d: V.block_rows(s, d).select("project_id", "id", F.array_join(B.merge_warnings(F.col("warnings"), F.array(F.lit("second note"), F.col("block_type"))), "|").alias("warnings")),
    "SELECT project_id, id, array_to_string(CASE WHEN len(warnings) > 0 THEN warnings || [block_type] ELSE ['second note', block_type] END, '|') AS warnings FROM v_block",
)
register(
    "unresolved_blocks",
    lambda s, d: B.unresolved_blocks(V.block_rows(s, d)).select("project_id", "id", "icon", "illegible"),
    r"SELECT * FROM (SELECT project_id, id, regexp_matches(eff, '(?i)\[ICON:\s*[^\]]+\]') AS icon, "
    f"contains(upper(eff), '[ILLEGIBLE]') OR contains(eff, '{K.REPLACEMENT_CHAR}') AS illegible FROM v_block) WHERE icon OR illegible",
)
register(
    "unresolved_counts",
    lambda s, d: B.unresolved_counts(B.unresolved_blocks(V.block_rows(s, d))),
    r"SELECT project_id, count(*) AS blocks, count(*) FILTER (icon) AS icons, count(*) FILTER (illegible) AS illegible FROM (SELECT project_id, id, "
    r"regexp_matches(eff, '(?i)\[ICON:\s*[^\]]+\]') AS icon, "
    f"contains(upper(eff), '[ILLEGIBLE]') OR contains(eff, '{K.REPLACEMENT_CHAR}') AS illegible FROM v_block) WHERE icon OR illegible GROUP BY project_id",
)
register(
    "layout_warnings_by_group",
    lambda s, d: B.layout_warnings_by_group(V.block_rows(s, d)),
    f"SELECT project_id, CASE WHEN source_type = 'pdf' THEN 'p' || page::VARCHAR ELSE substr(source_file, {len(K.IMAGE_ROOT) + 2}) END AS location, "
    f"sum(len(list_filter(warnings, lambda w: starts_with(w, '{K.RECOVERY_PREFIX}'))))::BIGINT AS layout_warnings FROM v_block GROUP BY ALL",
)
register("layout_request", lambda s, d: L.layout_request(V.fragments(s, d)).select("project_id", "page", F.get_json_object("fragments", "$[0].id").alias("first_id")))
