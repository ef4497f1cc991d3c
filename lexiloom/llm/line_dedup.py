"""Boilerplate lines, by the number of distinct sites that carry them.

A line's spread is the number of distinct values of ``source`` whose documents hold it. HyperLogLog
sketches per line hash are built on the map side and merged by the aggregation, so a line that a
third of all rows carry stays one small sketch per task. Estimates far from the bound decide alone;
lines near it get exact distinct counts.

Widespread lines are boilerplate in a page that says something of its own. A document none of whose
lines is its own, as each is widespread or an edited form of a widespread line, is a copy or near copy
that travels between sites: it stays whole, for near-duplicate removal to keep one of them. A line is
taken for an edited form where its first or its last words are those of a widespread line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import Scratch, fresh

#: Distinct sites from which on a line is boilerplate.
SITES = 10
#: log2 of a sketch's buckets; its relative error is about 1.04 / sqrt(2 ** LG_K), here 1.6 %.
LG_K = 12
#: Estimates within this share of the bound are counted exactly (six standard errors).
NEAR = 0.1


#: Shorter lines are compared as a whole only; of longer ones, the beginning and the end also are.
LONG_LINE = 8


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "")


def _ends(words: Column) -> Column:
    """The number of words in the beginning and in the end of a line: the largest power of two in half of its words."""
    return F.pow(F.lit(2), F.length(F.bin(F.size(words).cast("long"))) - 2).cast("int")


def widespread_lines(lines: DataFrame, scratch: Scratch, sites: int = SITES) -> DataFrame:
    """(line): hashes of ``lines`` (line, site) that at least ``sites`` distinct sites carry."""
    carried = lines.filter("line is not null and site is not null")
    sketched = scratch.save(
        carried.groupBy("line")
        .agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
        .filter(F.col("n") >= sites)
        .select("line", F.hll_sketch_estimate("sketch").alias("estimate"))
        .filter(F.col("estimate") >= sites * (1 - NEAR))
    )
    clear = sketched.filter(F.col("estimate") > sites * (1 + NEAR)).select("line")
    unclear = sketched.filter(F.col("estimate") <= sites * (1 + NEAR)).select("line")
    exact = carried.join(unclear, "line", "left_semi").distinct().groupBy("line").count().filter(F.col("count") >= sites).select("line")
    return clear.unionByName(exact)


def _exploded(docs: DataFrame) -> DataFrame:
    """(whole, n, site, pos, line, head, tail): hashes of each line that is not blank and of its ends."""
    text = docs.select(F.xxhash64("text").alias("whole"), F.length("text").alias("n"), F.col("source").cast("string").alias("site"), F.posexplode(_lines(F.col("text"))).alias("pos", "content"))
    trimmed = text.withColumn("content", _trimmed(F.col("content"))).filter("content <> ''").withColumn("words", F.split("content", r"[\x09-\x0D\x20]+"))
    long = F.size("words") >= LONG_LINE
    line, many = F.xxhash64("content"), _ends(F.col("words"))
    head, tail = F.slice("words", 1, many), F.slice("words", F.size("words") - many + 1, many)
    return trimmed.select(
        "whole", "n", "site", "pos", line.alias("line"), F.when(long, F.xxhash64(head)).otherwise(line).alias("head"), F.when(long, F.xxhash64(tail)).otherwise(line).alias("tail")
    )


def mark_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(whole, n, drop): per distinct text that loses lines, the positions of those lines."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    lines = scratch.save(_exploded(docs.select("text", "source").filter("text is not null")))
    spread = scratch.save(widespread_lines(lines.select("line", "site"), scratch, sites))
    texts = lines.drop("site").distinct()
    held = texts.join(spread, "line", "left_semi")
    heads, tails = (scratch.save(held.select(c).distinct()) for c in ("head", "tail"))
    loose = texts.join(spread, "line", "left_anti")
    own = loose.join(heads, "head", "left_anti").join(tails, "tail", "left_anti").select("whole", "n").distinct()
    marked = held.groupBy("whole", "n").agg(F.sort_array(F.collect_list("pos")).alias("drop"))
    return marked.join(own, ["whole", "n"], "left_semi")


def _cleaned(docs: DataFrame, sites: int, removed: str) -> DataFrame:
    """``docs`` without widespread lines, and a column ``removed`` with the number of lines cut."""
    whole, n, drop = (fresh(docs, f"_line_{c}") for c in ("whole", "n", "drop"))
    marked = mark_lines(docs, sites).toDF(whole, n, drop)
    keyed = docs.withColumns({whole: F.xxhash64("text"), n: F.length("text")})
    kept = F.filter(_lines(F.col("text")), lambda _, i: ~F.array_contains(F.col(drop), i))
    changed = F.col(drop).isNotNull()
    new = {"text": F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text")), removed: F.when(changed, F.size(drop)).otherwise(0).cast("long")}
    joined = keyed.join(marked, [whole, n], "left").withColumns(new)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns, removed)


def dedup_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """``docs`` with widespread lines cut out of ``text``; all rows and all columns stay.

    ``docs`` has text and source (the site). Lines end at \\n and are compared without white space
    around them; blank lines are kept and never counted. A null source carries no line to its
    spread, but its document is cleaned. Null and empty texts and texts without a line of their own stay
    as they are. ``n_chars``, where there is such a column, is set to the new length
    for texts that changed. Repeated rows are all kept and treated alike; a line twice in one document
    is cut twice. An empty table gives none.
    """
    removed = fresh(docs, "_line_removed")
    return _cleaned(docs, sites, removed).drop(removed)


def report(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): each document after its widespread lines went."""
    before = docs.select("doc_id", "text", "source").withColumn("n_lines", F.size(_lines(F.coalesce("text", F.lit("")))).cast("long"))
    return _cleaned(before, sites, "n_removed").select("doc_id", "n_lines", "n_removed", "text")


_WORDS = "regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')"
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, * FROM documents),
lines AS (
  SELECT r, source, i AS pos, string_split(text, chr(10))[i] AS content
  FROM docs, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)
  WHERE text IS NOT NULL),
trimmed AS (SELECT *, trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM lines),
counted AS (SELECT *, {_WORDS} AS w, CAST(pow(2, length(bin(len({_WORDS}))) - 2) AS BIGINT) AS k FROM trimmed),
ended AS (
  SELECT r, source, pos, content, line,
         CASE WHEN len(w) >= {LONG_LINE} THEN array_to_string(w[:k], ' ') || chr(10) ELSE line END AS head,
         CASE WHEN len(w) >= {LONG_LINE} THEN array_to_string(w[len(w) - k + 1:], ' ') || chr(10) ELSE line END AS tail
  FROM counted),
spread AS (SELECT line FROM trimmed WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {SITES}),
heads AS (SELECT DISTINCT head FROM ended SEMI JOIN spread USING (line)),
tails AS (SELECT DISTINCT tail FROM ended SEMI JOIN spread USING (line)),
own AS (
  SELECT DISTINCT r FROM ended ANTI JOIN spread USING (line) ANTI JOIN heads USING (head) ANTI JOIN tails USING (tail)
  WHERE line <> ''),
marked AS (
  SELECT e.r, e.pos, e.content, s.line IS NOT NULL AND o.r IS NOT NULL AS gone
  FROM ended e LEFT JOIN spread s ON s.line = e.line LEFT JOIN own o ON o.r = e.r),
rebuilt AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(content, chr(10) ORDER BY pos) FILTER (NOT gone) AS text
  FROM marked GROUP BY r)
SELECT d.doc_id, coalesce(n_lines, 1) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(b.text, '') END AS text
FROM docs d LEFT JOIN rebuilt b ON b.r = d.r
"""
