"""Queries for chunk packing, term look-up, translation checks and approval."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom import schemas
from lexiloom.catalog import sqlviews as S
from lexiloom.catalog.blocks import joined
from lexiloom.catalog.registry import register
from lexiloom.catalog.sqlviews import view
from lexiloom.functions import items as I
from lexiloom.functions import text as X
from lexiloom.operators import translation as T
from lexiloom.operators import translation_qa as TQ
from lexiloom.operators import validation as VAL
from lexiloom.operators.source_qa import effective_text
from lexiloom.plans import testviews as V
from lexiloom.session import settle

view(
    "v_termbase",
    """SELECT project_id, 'term-' || substr(sha256(lw), 1, 12) AS candidate_id, source_term,
    CASE d % 3 WHEN 0 THEN upper(lw) || 'Z' WHEN 1 THEN source_term ELSE '' END AS translation,
    CASE WHEN length(lw) > 6 THEN 'proper_noun' ELSE 'term' END AS category,
    CASE d % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'keep' ELSE 'rejected' END AS status, [lw, lw || 's'] AS variants FROM (
      SELECT project_id, lower(w) AS lw, min(w) AS source_term, min(doc_id) AS d FROM (
        SELECT project_id, doc_id, regexp_extract(text, '[A-Za-z][A-Za-z0-9''’-]*') AS w FROM v_doc) WHERE w <> '' GROUP BY ALL)
  UNION ALL SELECT DISTINCT project_id, 'term-icon', 'icon', 'icon', 'ui', 'keep', ['[ICON:', '(icon'] FROM v_doc""",
)
view(
    "v_variant",
    r"""SELECT project_id, candidate_id, source_term, translation, status, variant,
    '(?i)' || CASE WHEN regexp_matches(variant, '^[\p{L}\p{N}]') THEN '(^|[^\p{L}\p{N}_])' ELSE '()' END || '(' || regexp_escape(variant) || ')'
      || CASE WHEN regexp_matches(variant, '[\p{L}\p{N}]$') THEN '($|[^\p{L}\p{N}_])' ELSE '()' END AS pattern FROM (
    SELECT *, unnest(list_distinct([source_term] || variants)) AS variant FROM v_termbase WHERE status IN ('approved', 'keep'))""",
)
_UP = "translate(eff, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_TR = (
    "CASE (doc_id + line) % 11 WHEN 0 THEN '' WHEN 1 THEN eff WHEN 2 THEN replace(eff, '{DMGR}', '') WHEN 3 THEN replace(eff, '<b>', '<i>') "
    "WHEN 4 THEN eff || ' 1 7' WHEN 5 THEN regexp_replace(eff, '[0-9]', '9', 'g') WHEN 6 THEN '가 ' || " + _UP + " "
    f"WHEN 7 THEN eff || ' {K.REPLACEMENT_CHAR}' WHEN 8 THEN '가나 ' || eff || ' [illegible]' WHEN 9 THEN '한글' ELSE {_UP} || 'Z' END"
)
view("v_pair", f"SELECT *, id AS block_id, eff AS source_text, {S.strip(_TR)} AS translated_text FROM v_block")
# Variants that start with a word meet the blocks that have this word; the pattern decides.
view(
    "v_word",
    r"SELECT DISTINCT project_id, id, unnest(regexp_extract_all(lower(eff), '[\p{L}\p{N}_]+')) AS token FROM v_block",
)
view(
    "v_meet",
    r"""SELECT w.project_id, w.id, v.candidate_id, v.source_term, v.translation, v.status, v.variant, v.pattern
    FROM (SELECT *, regexp_extract(lower(variant), '^[\p{L}\p{N}_]+') AS token FROM v_variant) v JOIN v_word w ON w.project_id = v.project_id AND w.token = v.token
  UNION ALL SELECT b.project_id, b.id, v.candidate_id, v.source_term, v.translation, v.status, v.variant, v.pattern
    FROM v_variant v JOIN v_block b ON v.project_id = b.project_id AND NOT regexp_matches(v.variant, '^[\p{L}\p{N}]') AND contains(lower(b.eff), lower(v.variant))""",
)
view(
    "v_hit",
    """SELECT m.project_id, m.id AS text_id, m.candidate_id, m.source_term, m.translation, m.status, m.variant, m.pattern
  FROM v_meet m JOIN v_block b ON b.project_id = m.project_id AND b.id = m.id WHERE regexp_matches(b.eff, m.pattern)""",
)


def texts(s, d):
    return V.block_rows(s, d).select("project_id", F.col("id").alias("text_id"), effective_text().alias("text"))


register("relevant_terms", lambda s, d: T.relevant_terms(texts(s, d), V.termbase(s, d)),
         "SELECT DISTINCT project_id, text_id, candidate_id, status FROM v_hit")
register(
    "contains_term",
    lambda s, d: T.term_hits(texts(s, d), V.termbase(s, d)).select("project_id", "text_id", F.explode("hits").alias("h")).select(
        "project_id", "text_id", F.col("h.candidate_id").alias("candidate_id"), F.col("h.variant").alias("variant")
    ),
    "SELECT project_id, text_id, candidate_id, variant FROM v_hit",
)

# --- Translation QA -------------------------------------------------------------------------

_ITEMS = {
    "curly_token_changed": r"\{[A-Za-z][A-Za-z0-9_]*\}",
    "square_token_changed": r"\[[^\]\n]+\]",
    "html_tag_changed": r"</?[^>\n]+>",
}
_NUM = r"[0-9]+(?:[.,][0-9]+)*%?"
_WORDS = "', '".join(K.NUMBER_WORDS)
_DIGITS = "MAP {" + ", ".join(f"'{w}': '{d}'" for w, d in K.NUMBER_WORDS.items()) + "}"


def _formatted(x: str, pattern: str) -> str:
    return (
        f"(SELECT coalesce(string_agg(CASE WHEN n > 1 THEN v || '×' || n::VARCHAR ELSE v END, ', ' ORDER BY v), '{K.EMPTY_MULTISET}') FROM "
        f"(SELECT v, count(*) AS n FROM (SELECT unnest(regexp_extract_all({x}, '{pattern}')) AS v) GROUP BY v))"
    )


def _tq(code: str, where: str, detail: str = "NULL::VARCHAR", source: str = "v_filled") -> str:
    return f"SELECT project_id, block_id, '{TQ.RULES[code]}' AS severity, '{code}' AS code, {detail} AS detail FROM {source} WHERE {where}"


view("v_filled", "SELECT * FROM v_pair WHERE translated_text <> ''")
view(
    "v_number",
    rf"""SELECT p.*, list_filter(regexp_extract_all(source_text, '{_NUM}'), lambda x: TRUE) AS a, regexp_extract_all(translated_text, '{_NUM}') AS b,
    list_transform(list_filter(regexp_extract_all(lower(source_text), '[\p{{L}}\p{{N}}_]+'), lambda w: w IN ('{_WORDS}')), lambda w: ({_DIGITS})[w]) AS c FROM v_filled p""",
)
_COUNT = "len(list_filter({l}, lambda y: y = x))"
_NUMBER_BAD = (
    f"len(list_filter(a, lambda x: {_COUNT.format(l='a')} > {_COUNT.format(l='b')})) > 0 OR "
    f"len(list_filter(b, lambda x: x <> '1' AND {_COUNT.format(l='b')} - {_COUNT.format(l='a')} > {_COUNT.format(l='c')})) > 0"
)
view(
    "v_contract",
    """SELECT p.project_id, p.block_id, h.candidate_id, any_value(h.source_term) AS source_term, any_value(h.status) AS status,
    bool_or(contains(lower(p.translated_text), lower(CASE WHEN h.status = 'approved' THEN h.translation ELSE h.variant END))) AS fine
  FROM v_filled p JOIN v_hit h ON h.project_id = p.project_id AND h.text_id = p.block_id GROUP BY p.project_id, p.block_id, h.candidate_id""",
)
# Removing twice takes neighbours that share a boundary character.
_REMOVE = "regexp_replace(regexp_replace({a}, {p}, '\\1\\3', 'g'), {p}, '\\1\\3', 'g')"
view(
    "v_keep_text",
    rf"""SELECT f.project_id, f.block_id, list_reduce([f.source_text] || list(h.pattern ORDER BY length(h.variant) DESC, h.variant),
      lambda acc, p: {_REMOVE.format(a='acc', p='p')}) AS rest FROM v_pair f JOIN v_hit h ON h.project_id = f.project_id AND h.text_id = f.block_id
      WHERE h.status = 'keep' GROUP BY f.project_id, f.block_id, f.source_text""",
)
view(
    "v_script",
    f"""SELECT f.*, regexp_matches(source_text, '[A-Za-z]') AS latin, regexp_matches(translated_text, '{K.HANGUL}') AS hangul,
    k.rest IS NOT NULL AND NOT regexp_matches(k.rest, '[A-Za-z]') AS kept FROM v_filled f
    LEFT JOIN v_keep_text k ON k.project_id = f.project_id AND k.block_id = f.block_id""",
)
_TQ = {
    code: _tq(
        code,
        f"list_sort(regexp_extract_all(source_text, '{p}')) <> list_sort(regexp_extract_all(translated_text, '{p}'))",
        f"{_formatted('source_text', p)} || ' / ' || {_formatted('translated_text', p)}",
    )
    for code, p in _ITEMS.items()
}
_TQ["number_changed"] = _tq("number_changed", _NUMBER_BAD, f"{_formatted('source_text', _NUM)} || ' / ' || {_formatted('translated_text', _NUM)}", "v_number")
_TQ["approved_term_missing"] = _tq("approved_term_missing", "status = 'approved' AND NOT fine", "source_term", "v_contract")
_TQ["keep_term_changed"] = _tq("keep_term_changed", "status = 'keep' AND NOT fine", "source_term", "v_contract")
_TQ["empty_translation"] = _tq("empty_translation", "translated_text = ''", source="v_pair")
_TQ["replacement_character"] = _tq("replacement_character", f"contains(translated_text, '{K.REPLACEMENT_CHAR}')")
_TQ["unresolved_illegible"] = _tq("unresolved_illegible", "contains(upper(translated_text), '[ILLEGIBLE]')")
_TQ["keep_rule_applied"] = _tq("keep_rule_applied", "latin AND kept AND NOT hangul", source="v_script")
_TQ["unchanged_translation"] = _tq("unchanged_translation", "NOT (latin AND kept AND NOT hangul) AND latin AND translated_text = source_text", source="v_script")
_TQ["target_script_missing"] = _tq(
    "target_script_missing", "NOT (latin AND kept AND NOT hangul) AND NOT (latin AND translated_text = source_text) AND latin AND NOT hangul", source="v_script"
)
view("v_tissue", " UNION ALL ".join(_TQ.values()))


def tissues(s, d):
    return TQ.run_translation_qa(V.pairs(s, d), V.termbase(s, d))


register("run_translation_qa", tissues, "SELECT * FROM v_tissue")
for _code in TQ.RULES:
    register(
        "rule_" + _code,
        lambda s, d, code=_code: tissues(s, d).filter(F.col("code") == code),
        _TQ[_code],
    )
register(
    "term_contract",
    lambda s, d: tissues(s, d).filter(F.col("code").isin("approved_term_missing", "keep_term_changed")).select("project_id", "block_id", "code", F.col("detail").alias("source_term")),
    "SELECT project_id, block_id, CASE status WHEN 'approved' THEN 'approved_term_missing' ELSE 'keep_term_changed' END AS code, source_term FROM v_contract WHERE NOT fine",
)
register(
    "multiset_diff",
    lambda s, d: V.pairs(s, d).select("project_id", "block_id", F.explode(I.multiset_minus(I.find_all(F.col("source_text"), K.NUMBER), I.find_all(F.col("translated_text"), K.NUMBER))).alias("m")).select(
        "project_id", "block_id", F.col("m.value").alias("value"), F.col("m.n").cast("long").alias("n")
    ),
    f"""SELECT project_id, block_id, value, n FROM (SELECT project_id, block_id, value, count(*) FILTER (side = 1) - count(*) FILTER (side = 2) AS n FROM (
      SELECT project_id, block_id, 1 AS side, unnest(regexp_extract_all(source_text, '{_NUM}')) AS value FROM v_pair UNION ALL
      SELECT project_id, block_id, 2, unnest(regexp_extract_all(translated_text, '{_NUM}')) FROM v_pair) GROUP BY ALL) WHERE n > 0""",
)
register(
    "latin_fully_kept",
    lambda s, d: T.term_hits(texts(s, d), V.termbase(s, d)).select(
        "project_id", "text_id", I.latin_fully_kept(F.col("text"), F.transform(F.filter("hits", lambda h: h["status"] == "keep"), lambda h: h["variant"])).alias("kept")
    ),
    "SELECT b.project_id, b.id AS text_id, k.rest IS NOT NULL AND NOT regexp_matches(k.rest, '[A-Za-z]') AS kept FROM v_block b "
    "LEFT JOIN v_keep_text k ON k.project_id = b.project_id AND k.block_id = b.id",
)
register(
    "translation_qa_summary",
    lambda s, d: TQ.qa_summary(tissues(s, d), V.pairs(s, d)),
    """SELECT p.project_id, total_blocks, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(infos, 0) AS infos,
      coalesce(blocking, 0) AS blocking_errors, coalesce(errors, 0) = 0 AS passed FROM (SELECT project_id, count(*) AS total_blocks FROM v_pair GROUP BY 1) p LEFT JOIN (
      SELECT project_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
      count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (code = 'empty_translation') AS blocking FROM v_tissue GROUP BY 1) i ON i.project_id = p.project_id""",
)


def _gate(s, d):
    """Every document is decided on its own: issues are counted per document."""
    doc = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    p = V.pairs(s, d).withColumn("project_id", doc)
    blank = p.filter("translated_text = ''").select("project_id", "block_id", F.lit("error").alias("severity"), F.lit("empty_translation").alias("code"))
    gone = p.filter(F.contains("translated_text", F.lit(K.REPLACEMENT_CHAR))).select("project_id", "block_id", F.lit("error").alias("severity"), F.lit("replacement_character").alias("code"))
    over = V.documents(s, d).select(
        doc.alias("project_id"),
        F.when(F.col("doc_id") % 4 == 1, " checked by hand ").when(F.col("doc_id") % 4 == 2, F.repeat(F.lit("x"), 1001)).alias("reason"),
    )
    return TQ.translation_finalize_gate(TQ.qa_summary(blank.unionByName(gone), p), over)


register(
    "translation_finalize_gate",
    lambda s, d: _gate(s, d).select("project_id", "errors", "blocking_errors", "decision"),
    f"""SELECT 'doc' || doc_id::VARCHAR AS project_id, errors, blocking_errors, CASE WHEN doc_id % 4 = 2 THEN 'reason_too_long'
      WHEN doc_id % 4 = 1 AND errors = 0 THEN 'override_without_errors' WHEN doc_id % 4 = 1 AND blocking_errors > 0 THEN 'blocked'
      WHEN errors = 0 THEN 'finalized' WHEN doc_id % 4 = 1 THEN 'overridden' ELSE 'qa_failed' END AS decision FROM (
      SELECT doc_id, count(*) FILTER (translated_text = '' OR contains(translated_text, '{K.REPLACEMENT_CHAR}')) AS errors,
        count(*) FILTER (translated_text = '') AS blocking_errors FROM v_pair GROUP BY doc_id)""",
)

# --- Chunks ---------------------------------------------------------------------------------

LIMIT = 2000
view(
    "v_walk",
    f"""/*RECURSIVE_MARK*/SELECT project_id, source_order, size, size AS acc, 1::BIGINT AS chunk_no FROM v_size WHERE source_order = 1
  UNION ALL SELECT n.project_id, n.source_order, n.size, CASE WHEN w.acc + 2 + n.size > {LIMIT} THEN n.size ELSE w.acc + 2 + n.size END,
    w.chunk_no + CASE WHEN w.acc + 2 + n.size > {LIMIT} THEN 1 ELSE 0 END
  FROM v_walk w JOIN v_size n ON n.project_id = w.project_id AND n.source_order = w.source_order + 1""",
)
view("v_size", "SELECT project_id, source_order, length(eff) AS size FROM v_block")
view(
    "v_chunk",
    """SELECT b.project_id, w.chunk_no, 'chunk-' || substr(sha256(string_agg(b.id || ':' || sha256(b.eff), chr(10) ORDER BY b.source_order)), 1, 12) AS chunk_id,
    string_agg(b.id, ',' ORDER BY b.source_order) AS block_ids, count(*) AS blocks, (sum(w.size) + 2 * (count(*) - 1))::BIGINT AS character_count
  FROM v_walk w JOIN v_block b ON b.project_id = w.project_id AND b.source_order = w.source_order GROUP BY b.project_id, w.chunk_no""",
)


def packed(s, d):
    b = V.blocks(s, d)
    return b, settle(T.pack_chunks(b, effective_text(), LIMIT, span=512))


register(
    "pack_chunks",
    lambda s, d: T.chunk_table(*packed(s, d), effective_text()).select("project_id", "chunk_no", "chunk_id", joined("block_ids"), "blocks", "character_count"),
    "SELECT * FROM v_chunk",
)


def chunk_blocks(s, d):
    b, p = packed(s, d)
    return b.join(p.select("project_id", "source_order", "chunk_no"), ["project_id", "source_order"])


def _requests(s, d):
    rows = chunk_blocks(s, d).select(
        "project_id", "chunk_no", "source_order", "id", "block_type", "source_file", "page", F.col("id").alias("text_id"), effective_text().alias("text")
    )
    return T.keep_patterns(T.term_hits(rows, V.termbase(s, d)))


register("translation_request", lambda s, d: T.translation_request(_requests(s, d)))


def responses(rows):
    """Answers per chunk, some of them wrong."""
    k = F.col("doc_id") + F.col("line") * 3
    pos = F.col("source_order") * 2 - F.when(k % 73 == 0, 3).otherwise(0)
    item = lambda cond, p, name, text: F.when(cond, F.struct(p.cast("long").alias("p"), name.alias("id"), text.alias("text")))
    text = F.when(k % 79 == 0, F.lit(" ")).otherwise(F.concat(F.lit("가 "), effective_text()))
    return rows.select(
        "project_id", "chunk_no",
        F.inline(F.array_compact(F.array(
            item(k % 83 != 0, pos, F.when(k % 97 == 0, F.lit("zzz")).otherwise(F.col("id")), text),
            item(k % 89 == 0, pos + 1, F.col("id"), text),
        ))),
    )


def _answers(s, d):
    """The items as model answers: one JSON string per chunk."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p", "id", "text"))), lambda i: F.struct(i["id"].alias("id"), i["text"].alias("text")))
    return responses(chunk_blocks(s, d)).groupBy("project_id", "chunk_no").agg(F.to_json(F.struct(listed.alias("translations"))).alias("response"))


def parsed_answers(s, d):
    return T.parse_model_response(_answers(s, d), "response", schemas.TRANSLATION_RESPONSE)


view(
    "v_answer",
    """SELECT * FROM (
    SELECT w.project_id, w.chunk_no, w.source_order * 2 - CASE WHEN (doc_id + line * 3) % 73 = 0 THEN 3 ELSE 0 END AS p,
      CASE WHEN (doc_id + line * 3) % 97 = 0 THEN 'zzz' ELSE id END AS id, CASE WHEN (doc_id + line * 3) % 79 = 0 THEN '' ELSE '가 ' || eff END AS text
      FROM v_walk w JOIN v_block b ON b.project_id = w.project_id AND b.source_order = w.source_order WHERE (doc_id + line * 3) % 83 <> 0
    UNION ALL
    SELECT w.project_id, w.chunk_no, w.source_order * 2 - CASE WHEN (doc_id + line * 3) % 73 = 0 THEN 3 ELSE 0 END + 1, id,
      CASE WHEN (doc_id + line * 3) % 79 = 0 THEN '' ELSE '가 ' || eff END
      FROM v_walk w JOIN v_block b ON b.project_id = w.project_id AND b.source_order = w.source_order WHERE (doc_id + line * 3) % 89 = 0)""",
)
view(
    "v_judged",
    """SELECT *, known AND before AS duplicate, known AND NOT before AND text = '' AS hollow, known AND NOT before AND text <> '' AS accepted FROM (
    SELECT *, coalesce(bool_or(text <> '') OVER (PARTITION BY project_id, chunk_no, id ORDER BY p, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS before FROM (
      SELECT a.*, w.id IS NOT NULL AS known FROM v_answer a LEFT JOIN (SELECT w.project_id, w.chunk_no, b.id FROM v_walk w JOIN v_block b
        ON b.project_id = w.project_id AND b.source_order = w.source_order) w ON w.project_id = a.project_id AND w.chunk_no = a.chunk_no AND w.id = a.id))""",
)
register(
    "parse_model_response",
    lambda s, d: T.answer_items(parsed_answers(s, d)).groupBy("project_id", "chunk_no").agg(F.count(F.lit(1)).alias("items")),
    "SELECT project_id, chunk_no, count(*) AS items FROM v_answer GROUP BY ALL",
)


def matched(s, d):
    return T.match_responses(chunk_blocks(s, d), T.answer_items(parsed_answers(s, d)))


register(
    "match_responses",
    lambda s, d: matched(s, d)[1],
    """SELECT c.project_id, c.chunk_no, coalesce(unknown, 0) AS unknown, coalesce(duplicate, 0) AS duplicate, coalesce(hollow, 0) AS empty,
      c.blocks - coalesce(accepted, 0) AS missing, coalesce(took, '') <> c.block_ids AS order_changed, coalesce(items, 0) <> c.blocks AS count_changed,
      coalesce(unknown, 0) + coalesce(duplicate, 0) + coalesce(hollow, 0) + c.blocks - coalesce(accepted, 0) = 0
        AND coalesce(took, '') = c.block_ids AND coalesce(items, 0) = c.blocks AS valid
      FROM v_chunk c LEFT JOIN (SELECT project_id, chunk_no, count(*) AS items, count(*) FILTER (NOT known) AS unknown, count(*) FILTER (duplicate) AS duplicate,
        count(*) FILTER (hollow) AS hollow, count(*) FILTER (accepted) AS accepted, string_agg(CASE WHEN accepted THEN id END, ',' ORDER BY p) AS took
        FROM v_judged GROUP BY ALL) j ON j.project_id = c.project_id AND j.chunk_no = c.chunk_no""",
)


def _stored(rows):
    keep = (F.col("chunk_no") % 3 == 0) | ((F.col("chunk_no") % 3 == 1) & ((F.col("doc_id") + F.col("line")) % 2 == 0))
    digest = F.when((F.col("doc_id") + F.col("line")) % 90 == 0, F.lit("old")).otherwise(X.text_sha256(effective_text()))
    return rows.filter(keep).select("project_id", F.col("id").alias("source_block_id"), digest.alias("source_sha256"))


def _pending(s, d):
    rows = chunk_blocks(s, d)
    return T.pending_chunks(rows.withColumn("source_sha256", X.text_sha256(effective_text())), _stored(rows))


register(
    "pending_chunks",
    _pending,
    """SELECT project_id, chunk_no, blocks, stored, changed, CASE WHEN changed > 0 THEN 'stale' WHEN stored = blocks THEN 'complete' WHEN stored > 0 THEN 'partial' ELSE 'pending' END AS state FROM (
      SELECT w.project_id, w.chunk_no, count(*) AS blocks, count(*) FILTER (keep) AS stored, count(*) FILTER (keep AND (doc_id + line) % 90 = 0) AS changed FROM (
        SELECT w.*, b.doc_id, b.line, w.chunk_no % 3 = 0 OR (w.chunk_no % 3 = 1 AND (b.doc_id + b.line) % 2 = 0) AS keep
        FROM v_walk w JOIN v_block b ON b.project_id = w.project_id AND b.source_order = w.source_order) w GROUP BY ALL)""",
)

# --- Keep-term placeholders -----------------------------------------------------------------

KEEP = ("The", "le", "the en", "und")
_KEEP = r"'(?i)(^|[^\p{L}\p{N}_])(the en|the|und|le)($|[^\p{L}\p{N}_])'"


def _protected(s, d):
    pattern = I.keep_pattern(F.array(*[F.lit(k) for k in KEEP]))
    return V.block_rows(s, d).withColumn("text", effective_text()).select(
        "project_id", "id", "text", I.keep_spans(F.col("text"), pattern).alias("spans"), I.protect_keep_terms(F.col("text"), pattern).alias("protected")
    )


register(
    "protect_keep_terms",
    lambda s, d: _protected(s, d).select("project_id", "id", F.length(F.regexp_replace("protected", r"\{KEEP_[0-9]+\}", "")).cast("long").alias("rest")),
    "SELECT project_id, id, length(" + _REMOVE.format(a="eff", p=_KEEP) + ") AS rest FROM v_block",
)
register(
    "restore_keep_terms",
    lambda s, d: _protected(s, d).select("project_id", "id", X.text_sha256(I.restore_keep_terms(F.col("protected"), F.col("spans"))).alias("hash")),
    "SELECT project_id, id, sha256(eff) AS hash FROM v_block",
)

# --- Segments and approval ------------------------------------------------------------------

view(
    "v_segment",
    """SELECT *, sha256(source_text) AS source_sha256, sha256(translated_text) AS translation_sha256 FROM (
    SELECT project_id, doc_id, line, id AS source_block_id, source_file, page, source_order, block_type, eff AS source_text,
      CASE WHEN translated_text = '' THEN eff ELSE translated_text END AS translated_text,
      CASE WHEN (doc_id + line) % 11 = 1 THEN 'flagged' ELSE 'translated' END AS status FROM v_pair)""",
)
view("v_reviewed", "SELECT *, CASE WHEN (doc_id + line) % 7 = 0 THEN translated_text || ' 수정' ELSE translated_text END AS reviewed FROM v_segment")


def approved(s, d):
    seg = V.segments(s, d)
    return T.approve_translations(seg, V.reviewed(seg))


register(
    "build_segments",
    lambda s, d: T.build_segments(
        V.pairs(s, d, V.blocks(s, d)).select("project_id", "id", "source_file", "page", "source_order", "block_type", "source_text", "translated_text"),
        tissues(s, d).filter(F.col("severity") == "error"), "stub", "p", "t",
    ).select("project_id", "source_block_id", "source_order", "source_sha256", "translation_sha256", "status"),
    """SELECT project_id, id AS source_block_id, source_order, sha256(source_text) AS source_sha256, sha256(translated_text) AS translation_sha256,
      CASE WHEN EXISTS (SELECT 1 FROM v_tissue t WHERE t.project_id = p.project_id AND t.block_id = p.id AND t.severity = 'error') THEN 'flagged' ELSE 'translated' END AS status FROM v_pair p""",
)
register(
    "diff_review",
    lambda s, d: (lambda seg: T.diff_review(seg, V.reviewed(seg)))(V.segments(s, d)).select("project_id", "source_block_id", "changed", "correction"),
    "SELECT project_id, source_block_id, reviewed <> translated_text AS changed, CASE WHEN reviewed <> translated_text THEN reviewed END AS correction FROM v_reviewed",
)
register(
    "approve_translations",
    lambda s, d: approved(s, d).select("project_id", "source_block_id", "draft_translation_sha256", "final_translation_sha256", F.col("corrected_translation").isNotNull().alias("corrected")),
    "SELECT project_id, source_block_id, translation_sha256 AS draft_translation_sha256, sha256(reviewed) AS final_translation_sha256, reviewed <> translated_text AS corrected FROM v_reviewed",
)


def _broken_segments(s, d):
    k = F.col("doc_id") + F.col("line")
    return (
        V.segments(s, d)
        .withColumn("source_sha256", F.when(k % 31 == 0, F.lit("xyz")).when(k % 37 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("source_sha256")))
        .withColumn("status", F.when(k % 41 == 0, "done").otherwise(F.col("status")))
        .withColumn("model", F.when(k % 43 == 0, " ").otherwise(F.col("model")))
    )


register(
    "validate_segments",
    lambda s, d: VAL.invalid(VAL.validate_segments(_broken_segments(s, d))).select("project_id", "source_block_id", joined("violations")),
    """SELECT project_id, source_block_id, concat_ws(',', CASE WHEN k % 43 = 0 THEN 'model' END, CASE WHEN k % 31 = 0 THEN 'source_sha256' END,
      CASE WHEN k % 31 = 0 OR k % 37 = 0 THEN 'source_text_hash' END, CASE WHEN k % 41 = 0 THEN 'status' END) AS violations
      FROM (SELECT *, doc_id + line AS k FROM v_segment) WHERE k % 31 = 0 OR k % 37 = 0 OR k % 41 = 0 OR k % 43 = 0""",
)


def _broken_approved(s, d):
    k = F.col("source_order")
    return (
        approved(s, d)
        .withColumn("corrected_translation", F.when(k % 29 == 0, F.lit(" ")).when(k % 31 == 0, F.col("draft_translation")).otherwise(F.col("corrected_translation")))
        .withColumn("status", F.when(k % 37 == 0, "translated").otherwise(F.col("status")))
    )


register(
    "validate_approved",
    lambda s, d: VAL.invalid(VAL.validate_approved(_broken_approved(s, d))).select("project_id", "source_block_id", joined("violations")),
    """SELECT project_id, source_block_id, concat_ws(',', CASE WHEN k % 29 = 0 THEN 'corrected_blank' END, CASE WHEN k % 29 <> 0 AND k % 31 = 0 THEN 'corrected_unchanged' END,
      CASE WHEN k % 29 = 0 OR (k % 31 = 0 AND reviewed <> translated_text) THEN 'effective_translation_hash' END,
      CASE WHEN k % 37 = 0 THEN 'status' END) AS violations
      FROM (SELECT *, source_order AS k FROM v_reviewed) WHERE k % 29 = 0 OR k % 31 = 0 OR k % 37 = 0""",
)
register(
    "effective_translation",
    lambda s, d: approved(s, d).withColumn("corrected_translation", F.when(F.col("source_order") % 3 == 0, "").otherwise(F.col("corrected_translation"))).select(
        "project_id", "source_block_id", X.text_sha256(VAL.effective_translation()).alias("hash")
    ),
    "SELECT project_id, source_block_id, sha256(CASE WHEN source_order % 3 = 0 THEN translated_text ELSE reviewed END) AS hash FROM v_reviewed",
)
register(
    "failed_blocks",
    lambda s, d: T.failed_blocks(V.segments(s, d), tissues(s, d)).select("project_id", "source_block_id"),
    "SELECT DISTINCT project_id, block_id AS source_block_id FROM v_tissue WHERE severity = 'error'",
)


def _retried(s, d):
    """One block in nine was translated again; in projects with snum % 5 = 0 an answer is missing."""
    k = F.col("doc_id") + F.col("line")
    lost = (F.substring("project_id", 4, 20).cast("long") % 5 == 0) & (k % 27 == 0)
    return V.segments(s, d).filter(k % 9 == 0).select(
        "project_id", "source_block_id", F.when(~lost, F.concat(F.lit("다시 "), "translated_text")).alias("new_text")
    )


view(
    "v_retry",
    """SELECT *, k % 9 = 0 AND NOT coalesce(bool_or(k % 27 = 0 AND snum % 5 = 0) OVER (PARTITION BY project_id), FALSE) AS used FROM (
    SELECT *, doc_id + line AS k, CAST(substr(project_id, 4) AS BIGINT) AS snum FROM v_segment)""",
)
register(
    "merge_retries",
    lambda s, d: T.merge_retries(V.segments(s, d), _retried(s, d))[0].select("project_id", "source_block_id", "translation_sha256"),
    "SELECT project_id, source_block_id, sha256(CASE WHEN used THEN '다시 ' || translated_text ELSE translated_text END) AS translation_sha256 FROM v_retry",
)
register(
    "retry_log",
    lambda s, d: T.merge_retries(V.segments(s, d), _retried(s, d))[1],
    "SELECT project_id, source_block_id, translated_text AS previous_translation, '다시 ' || translated_text AS retried_translation FROM v_retry WHERE used",
)
register(
    "block_id_mismatch",
    lambda s, d: (lambda b: T.block_id_mismatch(b.select("project_id", "id"), b.select("project_id", F.when(F.col("line") % 8 == 3, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"))))(V.block_rows(s, d)),
    "SELECT project_id, id, 'missing' AS kind FROM v_block WHERE line % 8 = 3 UNION ALL SELECT project_id, id || 'x', 'unknown' FROM v_block WHERE line % 8 = 3",
)


def _cache(s, d):
    keys = ["source_sha256", "model", "version"]
    rows = V.documents(s, d).select(
        "project_id", "doc_id", X.text_sha256("text").alias("source_sha256"), F.lit("m1").alias("model"), F.lit(K.POSTPROCESS_VERSION).alias("version")
    )
    stored = rows.filter(F.col("doc_id") % 3 != 0).select(
        "source_sha256", "model", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("version")).alias("version"), F.col("source_sha256").alias("result")
    ).distinct()
    return T.cache_lookup(rows, stored, keys, "result").select("project_id", "doc_id", "hit")


register(
    "cache_lookup",
    _cache,
    "SELECT project_id, doc_id, EXISTS (SELECT 1 FROM v_doc c WHERE c.text = d.text AND c.doc_id % 3 <> 0 AND c.doc_id % 5 <> 0) AS hit FROM v_doc d",
)
