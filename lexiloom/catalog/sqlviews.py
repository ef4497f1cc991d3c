"""The derived tables again, as DuckDB common table expressions."""

from __future__ import annotations

import re

from lexiloom import constants as K

_VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    _VIEWS[name] = body


def _needed(body: str, seen: list[str], inside: tuple[str, ...] = ()) -> list[str]:
    for name in _VIEWS:
        if name not in seen and name not in inside and re.search(rf"\b{name}\b", body):
            _needed(_VIEWS[name], seen, (*inside, name))
            if name not in seen:
                seen.append(name)
    return seen


def sql(body: str) -> str:
    """The statement with a WITH clause for every derived table it mentions."""
    names = _needed(body, [])
    keep = lambda n: "" if "RECURSIVE_MARK" in _VIEWS[n] else "MATERIALIZED "
    clause = ",\n".join(f"{n} AS {keep(n)}({_VIEWS[n]})" for n in names)
    recursive = "RECURSIVE " if any("RECURSIVE_MARK" in _VIEWS[n] for n in names) else ""
    text = f"WITH {recursive}{clause}\n{body}" if names else body
    return text.replace("/*RECURSIVE_MARK*/", "")


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def evidence(x: str) -> str:
    c = collapse(x)
    return f"(CASE WHEN length({c}) <= 240 THEN {c} ELSE substr({c}, 1, 239) || '…' END)"


def slug(x: str) -> str:
    s = rf"substr(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 32)"
    return f"coalesce(nullif({s}, ''), 'source')"


def stem(x: str) -> str:
    return rf"regexp_replace(split_part({x}, '/', -1), '^(.+)\.[^.]+$', '\1')"


def block_id(kind: str, file: str, page: str, order: str) -> str:
    return (
        f"(CASE WHEN {kind} = 'pdf' THEN printf('pdf-p%04d', {page}) ELSE 'image-' || {slug(stem(file))} END"
        f" || printf('-b%04d-', {order}) || substr(sha256({kind} || '|' || {file} || '|' || "
        f"coalesce({page}::VARCHAR, '') || '|' || ({order})::VARCHAR), 1, 10))"
    )


def singular(x: str) -> str:
    return (
        f"(CASE WHEN length({x}) > 4 AND ends_with({x}, 'ies') THEN substr({x}, 1, length({x}) - 3) || 'y'"
        f" WHEN length({x}) > 4 AND regexp_matches({x}, '(ches|shes|xes|zes)$') THEN substr({x}, 1, length({x}) - 2)"
        f" WHEN length({x}) > 3 AND ends_with({x}, 's') AND NOT regexp_matches({x}, '(ss|us|is)$')"
        f" THEN substr({x}, 1, length({x}) - 1) ELSE {x} END)"
    )


view("v_doc", "SELECT source AS project_id, doc_id, text, CAST(substr(source, 4) AS BIGINT) AS snum FROM documents")
view(
    "v_line",
    f"""SELECT project_id, doc_id, snum, line, {strip('t0')} AS t FROM (
  SELECT project_id, doc_id, snum, unnest(string_split(text, chr(10))) AS t0,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM v_doc)
  WHERE {strip('t0')} <> ''""",
)
_H = "(doc_id * 31 + line * 7)"
_DECO = " || ".join(
    f"(CASE WHEN {_H} % {n} = 0 THEN {v} ELSE '' END)"
    for n, v in (
        (17, "' {DMGR}'"),
        (19, "' {UNK_' || (doc_id % 7)::VARCHAR || '}'"),
        (23, "' [ICON: star]'"),
        (29, "' [illegible]'"),
        (31, f"' {K.REPLACEMENT_CHAR}'"),
        (37, "' {BAD'"),
        (41, "' sword.png'"),
        (43, "' l0 DE-O5'"),
        (47, "chr(9) || '   end'"),
        (53, "' <b>' || (doc_id % 100)::VARCHAR || '</b>'"),
    )
)
view(
    "v_block_raw",
    f"""SELECT project_id, doc_id, snum, line, t || {_DECO} AS raw_text,
    CASE WHEN len(regexp_split_to_array(t, ' +')) <= 6 AND NOT regexp_matches(t, '[.!?]$') THEN 'heading'
         WHEN {_H} % 13 = 1 THEN 'list_item' WHEN {_H} % 13 = 2 THEN 'ability' WHEN {_H} % 13 = 3 THEN 'label'
         WHEN {_H} % 13 = 4 THEN 'title' ELSE 'paragraph' END AS block_type
  FROM v_line
  UNION ALL
  SELECT project_id, doc_id, snum, 0 AS line,
    CASE WHEN doc_id % 5 = 0 THEN upper(project_id) || ' C8 ' || (doc_id % 40)::VARCHAR
         WHEN doc_id % 5 = 1 THEN '{{Dark}}' ELSE upper(project_id) || '-' || (doc_id % 40)::VARCHAR END, 'identifier'
  FROM v_doc""",
)
view(
    "v_block",
    f"""SELECT *, {block_id('source_type', 'source_file', 'page', 'block_order')} AS id,
    coalesce(corrected_text, raw_text) AS eff FROM (
  SELECT project_id, doc_id, snum, line, 1 AS schema_version,
    CASE WHEN snum % 2 = 0 THEN 'pdf' ELSE 'image' END AS source_type,
    CASE WHEN snum % 2 = 0 THEN '01_input/' || project_id || '.pdf'
         ELSE '{K.IMAGE_ROOT}/' || project_id || '/Card ' || doc_id::VARCHAR || '.png' END AS source_file,
    CASE WHEN snum % 2 = 0 THEN doc_id + 1 END AS page,
    row_number() OVER (PARTITION BY project_id ORDER BY doc_id, line) AS source_order,
    line + 1 AS block_order, block_type, raw_text,
    CASE WHEN (doc_id + line) % 67 = 0 THEN raw_text || ' fixed' END AS corrected_text,
    [50.0::DOUBLE, ((line * 7) % 900)::DOUBLE, 950.0::DOUBLE, ((line * 7) % 900)::DOUBLE + 12.5] AS bbox,
    CASE WHEN snum % 2 = 1 THEN CASE WHEN (doc_id + line) % 53 = 0 THEN 'uncertain' ELSE 'clear' END END AS legibility,
    CASE WHEN (doc_id + line) % 59 = 0 OR (doc_id + line) % 61 = 0 OR (snum % 2 = 1 AND (doc_id + line) % 53 = 0)
         THEN 'flagged' ELSE 'raw' END AS status,
    CASE WHEN (doc_id + line) % 59 = 0 THEN ['{K.RECOVERY_PREFIX}: F' || line::VARCHAR, 'second note'] ELSE [] END AS warnings,
    CASE WHEN doc_id % 97 = 0 THEN 'sha256:' || repeat('0', 64) ELSE 'sha256:' || sha256(raw_text) END AS source_hash
  FROM v_block_raw)""",
)
view(
    "v_token",
    r"""SELECT DISTINCT project_id, unnest(regexp_extract_all(prompt, '\{([A-Za-z][A-Za-z0-9_]*)\}', 1)) AS token FROM (
  SELECT project_id, 'Use {DMGR} or {Dark}' || CASE WHEN doc_id % 7 < 4 THEN ' and {UNK_' || (doc_id % 7)::VARCHAR || '}' ELSE '' END AS prompt
  FROM v_doc WHERE snum % 3 <> 0)""",
)
