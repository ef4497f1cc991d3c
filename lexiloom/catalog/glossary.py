"""Queries for glossary review and termbase import."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.catalog import sqlviews as S
from lexiloom.catalog.blocks import joined
from lexiloom.catalog.registry import register
from lexiloom.catalog.sqlviews import view
from lexiloom.catalog.terms import runs_up_to
from lexiloom.functions import text as X
from lexiloom.operators import glossary as G
from lexiloom.operators import terms as T
from lexiloom.operators import validation as VAL
from lexiloom.plans import testviews as V
from lexiloom.session import settle

register(
    "glossary_review_rows",
    lambda s, d: (lambda occ: G.review_rows(settle(T.top_terms(T.term_candidates(V.blocks(s, d, *T.READ)))), occ))(T.term_occurrences(V.blocks(s, d, *T.READ))).select(
        "project_id", "status", "source_term", "category", "variants", "occurrences", X.text_sha256("locations").alias("locations"), "candidate_id"
    ),
    """SELECT t.project_id, 'review' AS status, source_term, category, variants, occurrences::VARCHAR AS occurrences, sha256(locations) AS locations, candidate_id FROM v_top t
      JOIN (SELECT project_id, key, string_agg(surface, ' | ' ORDER BY lower(surface), surface) AS variants FROM v_surface GROUP BY ALL) v ON v.project_id = t.project_id AND v.key = t.key
      JOIN (SELECT project_id, key, string_agg(location, ',' ORDER BY o, location) AS locations FROM (
        SELECT project_id, key, location, min(source_order) AS o FROM v_occ_term GROUP BY ALL) GROUP BY project_id, key) l ON l.project_id = t.project_id AND l.key = t.key""",
)

# Hand-reviewed rows: one per document, from its first words.
_STATUS = ("approved", "keep", "rejected", "review", "open")


def rows(s, d):
    n = F.col("doc_id")
    pick = F.element_at(F.array(*[F.lit(x) for x in _STATUS]), (n % 5 + 1).cast("int"))
    term = X.collapse(F.regexp_extract("text", r"^\s*(\S+(?:\s+\S+)?)", 1))
    return V.documents(s, d).select(
        "project_id", "doc_id", (n + 2).alias("record_no"), n.alias("row_no"), pick.alias("status"),
        F.when(n % 11 == 3, " ").when(n % 11 == 4, F.concat(term, F.lit(" {HP}"))).otherwise(term).alias("source_term"),
        F.when(n % 4 == 0, "").when(n % 4 == 1, F.lower(term)).otherwise("번역").alias("translation"),
        F.when(n % 17 == 0, "misc").otherwise("term").alias("category"),
        F.lit(" note ").alias("note"),
        F.lower(term).alias("variants"), (n % 9).cast("string").alias("occurrences"),
        F.concat(F.lit("p"), (n % 30).cast("string"), F.lit(",p99")).alias("locations"), term.alias("example"),
        F.when(n % 3 == 0, "").when(n % 3 == 1, X.manual_term_id(term)).otherwise(X.term_id(X.term_key(term))).alias("candidate_id"),
    )


_T0 = S.collapse(r"regexp_extract(text, '^\s*(\S+(?:\s+\S+)?)', 1)")
_W = "regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9''’-]*')"
_KEY = "(CASE WHEN len({w}) = 0 THEN '' ELSE array_to_string(list_transform({w}[:-2], lambda y: lower(y)) || list_transform([lower({w}[-1])], lambda z: {s}), ' ') END)"


def key(x: str) -> str:
    return _KEY.format(w=_W.format(x=x), s=S.singular("z"))


def folded(x: str) -> str:
    """Case folding of the letters that the sample texts have."""
    return f"replace(lower({x}), 'ß', 'ss')"


def manual(x: str) -> str:
    return f"('manual-' || substr(sha256(CASE WHEN {key(x)} = '' THEN {folded(S.collapse(x))} ELSE {key(x)} END), 1, 12))"


view(
    "v_grow",
    f"""SELECT project_id, doc_id, doc_id + 2 AS record_no, doc_id AS row_no, (['approved', 'keep', 'rejected', 'review', 'open'])[doc_id % 5 + 1] AS status,
    CASE WHEN doc_id % 11 = 3 THEN '' WHEN doc_id % 11 = 4 THEN t || ' {{HP}}' ELSE t END AS source_term,
    CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN lower(t) ELSE '번역' END AS translation, CASE WHEN doc_id % 17 = 0 THEN 'misc' ELSE 'term' END AS category,
    lower(t) AS variants, (doc_id % 9)::VARCHAR AS occurrences, 'p' || (doc_id % 30)::VARCHAR || ',p99' AS locations, t AS example,
    CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN {manual('t')} ELSE 'term-' || substr(sha256({key('t')}), 1, 12) END AS candidate_id
  FROM (SELECT *, {_T0} AS t FROM v_doc)""",
)
register(
    "validate_glossary_rows",
    lambda s, d: VAL.validate_glossary_rows(rows(s, d)).select("project_id", "record_no", "translation", joined("violations")),
    """SELECT project_id, record_no, CASE WHEN status = 'keep' THEN source_term ELSE translation END AS translation, concat_ws(',',
      CASE WHEN status = 'open' THEN 'invalid_status' END, CASE WHEN status = 'review' THEN 'review_incomplete' END, CASE WHEN source_term = '' THEN 'empty_term' END,
      CASE WHEN regexp_matches(source_term, '[{}]') THEN 'protected_token' END, CASE WHEN category = 'misc' THEN 'invalid_category' END,
      CASE WHEN status = 'approved' AND translation = '' THEN 'approved_without_translation' END,
      CASE WHEN status = 'keep' AND translation <> '' AND replace(lower(translation), 'ß', 'ss') <> replace(lower(source_term), 'ß', 'ss') THEN 'keep_differs' END) AS violations FROM v_grow""",
)


def expected(s, d):
    return rows(s, d).filter((F.col("doc_id") % 3 == 2) & (F.col("doc_id") % 7 != 0)).select("project_id", "candidate_id").distinct()


view("v_expected", "SELECT DISTINCT project_id, candidate_id FROM v_grow WHERE doc_id % 3 = 2 AND doc_id % 7 <> 0")
view(
    "v_identity",
    f"""SELECT *, min(record_no) OVER (PARTITION BY project_id, norm) AS f1, min(record_no) OVER (PARTITION BY project_id, key) AS f2,
      min(record_no) OVER (PARTITION BY project_id, final_id) AS f3 FROM (
      SELECT *, CASE WHEN auto THEN 'auto' WHEN starts_with(candidate_id, 'manual-') OR candidate_id = '' THEN 'manual' END AS origin,
        CASE WHEN candidate_id = '' THEN mid ELSE candidate_id END AS final_id FROM (
        SELECT g.*, {folded('source_term')} AS norm, {key('source_term')} AS key, {manual('source_term')} AS mid,
          EXISTS (SELECT 1 FROM v_expected e WHERE e.project_id = g.project_id AND e.candidate_id = g.candidate_id) AS auto FROM v_grow g))""",
)
register(
    "glossary_duplicates",
    lambda s, d: G.glossary_duplicates(rows(s, d).withColumn("source_term", X.collapse("source_term")), expected(s, d)).select("project_id", "record_no", "origin", "final_id", joined("problems")),
    """SELECT project_id, record_no, origin, final_id, concat_ws(',', CASE WHEN norm <> '' AND record_no > f1 THEN 'duplicate_term' END,
      CASE WHEN key <> '' AND record_no > f2 THEN 'duplicate_key' END,
      CASE WHEN NOT auto AND starts_with(candidate_id, 'manual-') AND candidate_id <> mid THEN 'changed_manual_id' END,
      CASE WHEN origin IS NULL THEN 'unknown_id' END, CASE WHEN record_no > f3 THEN 'duplicate_id' END) AS problems FROM v_identity""",
)


def evidence(s, d):
    terms = rows(s, d).select("project_id", "record_no", "source_term", F.when(F.col("doc_id") % 3 == 2, "auto").otherwise("manual").alias("origin"))
    return G.term_evidence(terms, V.blocks(s, d, *T.READ))


view("v_occ_long", runs_up_to(f"(SELECT max(len(string_split({key('source_term')}, ' '))) FROM v_grow)"))
view(
    "v_evidence",
    f"""SELECT g.project_id, record_no, source_term, CASE WHEN doc_id % 3 = 2 THEN 'auto' ELSE 'manual' END AS origin, coalesce(o.n, 0) AS occurrences,
      coalesce(o.blocks, 0) AS blocks, o.n IS NOT NULL AS source_verified, g.status, coalesce(o.example, '') AS example,
      coalesce(o.variants, source_term) AS variants, coalesce(o.block_ids, '') AS block_ids, coalesce(o.locations, '') AS locations FROM (SELECT *, {key('source_term')} AS key FROM v_grow) g
      LEFT JOIN (SELECT project_id, key, count(*) AS n, count(DISTINCT source_order) AS blocks, arg_min(example, source_order) AS example,
        array_to_string(list_transform(list_sort(list(DISTINCT [lower(surface), surface])), lambda x: x[2]), ' | ') AS variants,
        array_to_string(list_transform(list_sort(list(DISTINCT {{'o': source_order, 'v': block_id}})), lambda x: x.v), ',') AS block_ids,
        array_to_string(list_transform(list_sort(list(DISTINCT {{'o': first_order, 'v': location}})), lambda x: x.v), ',') AS locations
        FROM (SELECT *, min(source_order) OVER (PARTITION BY project_id, key, location) AS first_order FROM v_occ_long
          SEMI JOIN (SELECT project_id, {key('source_term')} AS key FROM v_grow) USING (project_id, key)) GROUP BY ALL) o
      ON o.project_id = g.project_id AND o.key = g.key""",
)
register(
    "term_evidence",
    lambda s, d: evidence(s, d).select(
        "project_id", "record_no", "origin", "occurrences", "blocks", "source_verified", "example", F.array_join("variants", " | ").alias("variants"),
        F.array_join("block_ids", ",").alias("block_ids"), F.array_join("locations", ",").alias("locations"),
    ),
    "SELECT project_id, record_no, origin, occurrences, blocks, source_verified, example, variants, block_ids, locations FROM v_evidence",
)
register(
    "unverified_terms",
    lambda s, d: G.unverified_terms(evidence(s, d), allow_missing_terms=True).select("project_id", "record_no", "problem"),
    "SELECT project_id, record_no, 'term_not_in_source' AS problem FROM v_evidence WHERE NOT source_verified AND origin <> 'manual'",
)
register(
    "import_summary",
    lambda s, d: G.import_summary(evidence(s, d).join(rows(s, d).select("project_id", "record_no", "status"), ["project_id", "record_no"])),
    "SELECT project_id, count(*) AS entries, count(*) FILTER (status IN ('approved', 'keep')) AS active, count(*) FILTER (status = 'rejected') AS rejected, "
    "count(*) FILTER (origin = 'manual') AS manual, count(*) FILTER (NOT source_verified) AS unverified FROM v_evidence GROUP BY project_id",
)
register(
    "deleted_candidates",
    lambda s, d: G.deleted_candidates(expected(s, d), rows(s, d).filter("doc_id % 5 <> 4")),
    "SELECT project_id, candidate_id FROM v_expected e WHERE NOT EXISTS (SELECT 1 FROM v_grow g WHERE g.project_id = e.project_id AND g.candidate_id = e.candidate_id AND doc_id % 5 <> 4)",
)


def merged(s, d):
    """Current rows have one row per id; edits change status and, for some, the term."""
    base = rows(s, d).withColumn("candidate_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "term-").otherwise("manual-"), F.col("doc_id").cast("string")))
    sent = base.withColumn("status", F.when(F.col("doc_id") % 3 == 0, "keep").when(F.col("doc_id") % 3 == 1, "rejected").otherwise("approved")).withColumn(
        "source_term", F.when(F.col("doc_id") % 5 == 2, F.concat(F.lit("new "), F.col("source_term"))).otherwise(F.col("source_term"))
    )
    return G.merge_glossary_edits(base, sent)


register(
    "merge_glossary_edits",
    lambda s, d: merged(s, d).select("project_id", "row_no", "status", "source_term", "translation", "variants", "candidate_id"),
    """SELECT project_id, row_no, status, term AS source_term, CASE status WHEN 'keep' THEN term WHEN 'rejected' THEN '' ELSE translation END AS translation,
      CASE WHEN gone THEN '' ELSE variants END AS variants, CASE WHEN gone THEN '' ELSE cid END AS candidate_id FROM (
      SELECT project_id, row_no, variants, translation, CASE doc_id % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'rejected' ELSE 'approved' END AS status,
        CASE WHEN doc_id % 5 = 2 AND doc_id % 2 = 1 THEN trim('new ' || source_term) ELSE CASE WHEN doc_id % 2 = 0 AND doc_id % 11 = 3 THEN ' ' ELSE source_term END END AS term,
        doc_id % 5 = 2 AND doc_id % 2 = 1 AS gone, CASE WHEN doc_id % 2 = 0 THEN 'term-' ELSE 'manual-' END || doc_id::VARCHAR AS cid FROM v_grow)""",
)
register(
    "search_glossary",
    lambda s, d: G.search_glossary(rows(s, d), "Th", "all", "approved", "term").select("project_id", "record_no"),
    "SELECT project_id, record_no FROM v_grow WHERE status = 'approved' AND category = 'term' AND "
    "contains(lower(concat_ws(chr(10), source_term, translation, category, variants, locations, example)), 'th')",
)
register(
    "sort_glossary",
    lambda s, d: G.sort_glossary(rows(s, d), "occurrences-desc").select("project_id", "occurrences", "row_no"),
    "SELECT project_id, occurrences, row_no FROM v_grow ORDER BY project_id, occurrences::BIGINT DESC, row_no",
)
register(
    "glossary_summary",
    lambda s, d: G.glossary_summary(rows(s, d)),
    "SELECT project_id, count(*) AS rows, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'approved') AS approved, "
    "count(*) FILTER (status = 'keep') AS keep, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (candidate_id = '' OR starts_with(candidate_id, 'manual-')) AS manual, "
    "count(*) FILTER (status = 'approved' AND translation = '') AS missing_translation FROM v_grow GROUP BY project_id",
)
