"""Queries for term extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.catalog import sqlviews as S
from lexiloom.catalog.registry import register
from lexiloom.catalog.sqlviews import view
from lexiloom.operators import terms as T
from lexiloom.plans import testviews as V


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_W = "'[A-Za-z][A-Za-z0-9''’-]*'"
view(
    "v_part",
    rf"""SELECT project_id, source_order, block_id, location, example, block_type, segment, words, n, primary_segment,
    headed AND segment = primary_segment AND n <= 6 AS whole FROM (
  SELECT *, len(words) AS n, min(CASE WHEN len(words) > 0 THEN segment END) OVER (PARTITION BY project_id, source_order) AS primary_segment FROM (
    SELECT project_id, source_order, block_id, location, example, block_type, headed, segment, regexp_extract_all(part, {_W}) AS words FROM (
      SELECT *, unnest(parts) AS part, unnest(range(0, len(parts))) AS segment FROM (
        SELECT project_id, source_order, id AS block_id, {S.evidence('eff')} AS example, block_type,
          CASE WHEN source_type = 'pdf' THEN 'p' || page::VARCHAR ELSE substr(source_file, {len(K.IMAGE_ROOT) + 2}) END AS location,
          block_type IN {_in(K.HEADING_TYPES)} OR (block_type = 'list_item' AND (contains(eff, ':') OR regexp_matches(eff, '^\s*[0-9]+[A-Za-z]?\.\s*'))) AS headed,
          regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(eff, '^\s*[0-9]+[A-Za-z]?\.\s*', ''),
            '(?i)(^|[^A-Za-z0-9])[0-9]+\s*[x×](\s|$)', '\1 \2', 'g'), '\{{[A-Za-z][A-Za-z0-9_]*\}}', ' ', 'g'), '[\n.!?;:,()\[\]{{}}]+') AS parts
        FROM v_block)))) WHERE n > 0""",
)
_TITLE = r"(regexp_matches(regexp_replace(w, '[^\p{L}]', '', 'g'), '^\p{Lu}{2,}$') OR regexp_matches(w, '^\p{Lu}.*\p{Ll}'))"
_LINK = f"lower(w) IN {_in(K.CONNECTORS)}"


def runs_up_to(longest: str) -> str:
    """Runs of up to ``longest`` words (a number or a scalar query)."""
    return f"""SELECT project_id, source_order, block_id, location, example, block_type, segment, st AS start, st + l AS "end", l AS length,
    array_to_string(list_transform(ws[:-2], lambda y: replace(lower(y), '’', '''')) || [{S.singular("replace(lower(ws[-1]), '’', '''')")}], ' ') AS key,
    array_to_string(ws, ' ') AS surface, whole AND st = 0 AND l = n AS heading,
    (st > 0 OR whole) AND len(list_filter(ws, lambda w: NOT ({_LINK}))) > 0
      AND len(list_filter(ws, lambda w: NOT ({_TITLE} OR {_LINK}))) = 0 AS title
  FROM (SELECT *, words[st + 1 : st + l] AS ws FROM (
    SELECT *, unnest(range(1, least({longest}, n - st) + 1)) AS l FROM (SELECT *, unnest(range(0, n)) AS st FROM v_part)))"""


view("v_occ", runs_up_to("4"))
view(
    "v_occ_term",
    f"""SELECT * FROM v_occ WHERE length(key) >= 3
   AND NOT (length = 1 AND (regexp_matches(key, '{K.ROMAN}') OR key IN {_in(K.STOPWORDS)}))
   AND NOT (length > 1 AND split_part(key, ' ', 1) IN {_in(K.ARTICLES)})""",
)
view(
    "v_stat",
    f"""SELECT * FROM (SELECT project_id, key, count(*) AS occurrences, count(DISTINCT source_order) AS blocks, bool_or(heading) AS heading,
    bool_or(title) AS title, bool_or(block_type = 'ability') AS in_ability, bool_or(block_type IN {_in(K.UI_TYPES)}) AS in_ui,
    string_split(key, ' ') AS ws, len(string_split(key, ' ')) > 1 AS many FROM v_occ_term GROUP BY project_id, key)
  WHERE NOT (many AND NOT heading AND NOT title AND (ws[1] IN {_in(K.STOPWORDS)} OR ws[-1] IN {_in(K.STOPWORDS)}
      OR len(list_filter(ws, lambda w: w IN {_in(K.STOPWORDS)})) > len(ws) // 2))
    AND CASE WHEN heading THEN TRUE WHEN many AND title THEN blocks >= 2 ELSE occurrences >= 2 AND blocks >= 2 END""",
)
view(
    "v_span",
    "SELECT o.project_id, o.source_order, o.segment, o.start, o.\"end\", o.length, o.key FROM v_occ_term o JOIN v_stat s "
    "ON s.project_id = o.project_id AND s.key = o.key",
)
view(
    "v_kept",
    """SELECT s.* FROM v_stat s JOIN (
    SELECT project_id, key FROM (
      SELECT a.project_id, a.key, a.source_order, a.segment, a.start, bool_or(b.key IS NOT NULL) AS covered FROM v_span a
      LEFT JOIN v_span b ON b.project_id = a.project_id AND b.source_order = a.source_order AND b.segment = a.segment
        AND b.start <= a.start AND b."end" >= a."end" AND b.length > a.length AND contains(' ' || b.key || ' ', ' ' || a.key || ' ')
      GROUP BY ALL) GROUP BY project_id, key HAVING NOT bool_and(covered)) f
  ON f.project_id = s.project_id AND f.key = s.key""",
)
view("v_surface", "SELECT project_id, key, surface, count(*) AS n FROM v_occ_term GROUP BY ALL")
view(
    "v_rep",
    "SELECT project_id, key, surface AS source_term FROM (SELECT *, row_number() OVER (PARTITION BY project_id, key "
    "ORDER BY n DESC, len(string_split(surface, ' ')), length(surface), lower(surface), surface) AS r FROM v_surface) WHERE r = 1",
)
_SCORE = (
    "round_even(log2(occurrences + 1) * 2 + least(blocks, 8) * 0.5 + CASE WHEN heading THEN 3.0 ELSE 0.0 END "
    "+ CASE WHEN title THEN 1.5 ELSE 0.0 END + CASE WHEN contains(key, ' ') THEN 0.5 ELSE 0.0 END, 3)::DOUBLE"
)
_TW = f"regexp_extract_all(source_term, {_W})"
_CATEGORY = (
    f"CASE WHEN in_ability THEN 'ability' WHEN len(list_filter({_TW}, lambda w: lower(w) IN {_in(K.COMPONENT_WORDS)})) > 0 THEN 'component' "
    f"WHEN in_ui THEN 'ui' WHEN len(list_filter({_TW}, lambda w: NOT ({_LINK}))) > 0 AND len(list_filter({_TW}, lambda w: NOT ({_TITLE} OR {_LINK}))) = 0 "
    f"THEN 'proper_noun' WHEN len(list_distinct(list_transform({_TW}, lambda w: lower(w)))) > 1 THEN 'phrase' ELSE 'term' END"
)
view(
    "v_cand",
    f"""SELECT k.project_id, k.key, occurrences, blocks, heading, title, source_term, {_SCORE.replace('key', 'k.key')} AS score,
    {_CATEGORY} AS category, 'term-' || substr(sha256(k.key), 1, 12) AS candidate_id
  FROM v_kept k JOIN v_rep r ON r.project_id = k.project_id AND r.key = k.key""",
)
view(
    "v_top",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, occurrences DESC, lower(source_term), key) "
    "AS rank FROM v_cand) WHERE rank <= 500",
)


def occurrences(spark, sf_dir):
    return T.term_occurrences(V.blocks(spark, sf_dir, *T.READ))


def stats(spark, sf_dir):
    return T.term_stats(occurrences(spark, sf_dir))


def candidates(spark, sf_dir, *carry: str):
    """Statistics of the candidates, and their occurrences with the columns ``carry``."""
    found = T.candidate_occurrences(occurrences(spark, sf_dir), carry=carry)
    return T.term_stats(found), found


def top(spark, sf_dir, k: int = 500):
    return T.top_terms(T.term_candidates(V.blocks(spark, sf_dir, *T.READ)), k)


_OCC = ["project_id", "source_order", "segment", "start", "end", "key", "surface", "heading", "title"]
register(
    "term_occurrences",
    lambda s, d: occurrences(s, d).groupBy("project_id", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("start") + F.col("end") * 3 + F.col("segment") * 7).alias("places"),
        F.count_if("heading").alias("headings"),
        F.count_if("title").alias("titles"),
        F.sum(F.length("surface")).alias("chars"),
    ),
    'SELECT project_id, key, count(*) AS n, sum(start + "end" * 3 + segment * 7)::BIGINT AS places, count(*) FILTER (heading) AS headings, '
    "count(*) FILTER (title) AS titles, sum(length(surface))::BIGINT AS chars FROM v_occ GROUP BY ALL",
)
register(
    "primary_segment",
    lambda s, d: T.segments(V.blocks(s, d)).groupBy("project_id", "source_order").agg(
        F.min("segment").cast("long").alias("primary_segment"), F.max("whole").alias("whole")
    ),
    "SELECT project_id, source_order, min(primary_segment) AS primary_segment, bool_or(whole) AS whole FROM v_part GROUP BY ALL",
)
register(
    "term_stats",
    lambda s, d: stats(s, d),
    "SELECT project_id, key, occurrences, blocks, heading, title, in_ability, in_ui FROM v_stat",
)
register(
    "term_score",
    lambda s, d: stats(s, d).select("project_id", "key", T.term_score().alias("score")),
    f"SELECT project_id, key, {_SCORE} AS score FROM v_stat",
)
register(
    "representative_surface",
    lambda s, d: T.representative_surface(T.surface_counts(occurrences(s, d).filter(T.can_qualify()))),
    "SELECT * FROM v_rep",
)
register(
    "prune_nested_terms",
    lambda s, d: T.prune_nested_terms(*candidates(s, d)).select("project_id", "key", "occurrences"),
    "SELECT project_id, key, occurrences FROM v_kept",
)
register(
    "term_category",
    lambda s, d: T.term_candidates(V.blocks(s, d, *T.READ)).select("project_id", "key", "category"),
    "SELECT project_id, key, category FROM v_cand",
)
register(
    "top_terms",
    lambda s, d: top(s, d).select("project_id", "rank", "candidate_id", "source_term", "category", "occurrences", "score"),
    "SELECT project_id, rank, candidate_id, source_term, category, occurrences, score FROM v_top",
)
register(
    "term_surfaces",
    lambda s, d: (lambda kept, found: T.term_variants(found, kept))(*candidates(s, d, "surface")).select("project_id", "key", "surface", "n"),
    "SELECT f.project_id, f.key, surface, n FROM v_surface f JOIN v_stat s ON s.project_id = f.project_id AND s.key = f.key",
)
register(
    "term_locations",
    lambda s, d: (lambda kept, found: T.term_locations(found, kept))(*candidates(s, d, "location")),
    "SELECT o.project_id, o.key, location, min(source_order) AS first_order FROM v_occ o JOIN v_stat s "
    "ON s.project_id = o.project_id AND s.key = o.key GROUP BY ALL",
)
