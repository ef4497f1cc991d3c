"""Glossary review rows: import into the termbase, edits, search, order and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.functions import text as X
from lexiloom.operators import terms as T
from lexiloom.session import settle


def review_rows(candidates: DataFrame, occurrences: DataFrame) -> DataFrame:
    """The ten review columns of generated candidates; arrays become cells only here.

    Surfaces, places and examples come from their own aggregates over the chosen candidates.
    """
    keys = candidates.select(*T.KEY)
    occurrences = settle(
        occurrences.join(keys.distinct(), T.KEY, "left_semi").select(*T.KEY, "surface", "location", "source_order", "example")
    )
    surfaces = T.term_variants(occurrences, keys).groupBy(*T.KEY).agg(
        F.array_sort(F.collect_list(F.struct(F.lower("surface").alias("l"), F.col("surface").alias("v")))).alias("_v")
    )
    places = T.term_locations(occurrences, keys).groupBy(*T.KEY).agg(
        F.array_sort(F.collect_list(F.struct("first_order", "location"))).alias("_p")
    )
    examples = T.term_examples(occurrences, keys).select(*T.KEY, "example")
    joined = candidates.join(surfaces, T.KEY).join(places, T.KEY).join(examples, T.KEY)
    return joined.select(
        "project_id", F.lit("review").alias("status"), "source_term", F.lit("").alias("translation"), "category",
        F.lit("").alias("note"),
        F.array_join(F.transform("_v", lambda p: p["v"]), " | ").alias("variants"),
        F.col("occurrences").cast("string").alias("occurrences"),
        F.array_join(F.transform("_p", lambda p: p["location"]), ",").alias("locations"),
        "example", "candidate_id",
    )


def glossary_duplicates(rows: DataFrame, expected: DataFrame, compatibility: bool = True) -> DataFrame:
    """Reviewed rows with origin, id and identity problems (``record_no`` names the row).

    The first record of every term, key and id is found by aggregation and joined back.
    """
    norm = X.normalized_term(F.col("source_term")) if compatibility else F.lower(X.collapse("source_term"))
    manual_id = X.manual_term_id(F.col("source_term"), compatibility)
    auto = expected.select("project_id", "candidate_id").distinct().withColumn("_auto", F.lit(True))
    base = (
        rows.withColumn("_norm", norm)
        .withColumn("_key", X.term_key(F.col("source_term"), compatibility))
        .join(auto, ["project_id", "candidate_id"], "left")
    )
    given = F.col("candidate_id")
    is_auto = F.coalesce(F.col("_auto"), F.lit(False))
    manual = F.startswith(given, F.lit("manual-"))
    tagged = base.withColumn("origin", F.when(is_auto, "auto").when(manual | (given == ""), "manual")).withColumn(
        "final_id", F.when(is_auto, given).when(given == "", manual_id).otherwise(given)
    )

    def first_of(name: str) -> DataFrame:
        return tagged.filter(F.col(name) != "").groupBy("project_id", name).agg(F.min("record_no").alias(f"_first{name}"))

    joined = tagged
    for name in ("_norm", "_key", "final_id"):
        joined = joined.join(first_of(name), ["project_id", name], "left")
    codes = {
        "duplicate_term": F.col("record_no") > F.col("_first_norm"),
        "duplicate_key": F.col("record_no") > F.col("_first_key"),
        "changed_manual_id": ~is_auto & manual & (given != manual_id),
        "unknown_id": F.col("origin").isNull(),
        "duplicate_id": F.col("record_no") > F.col("_firstfinal_id"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in codes.items()]))
    return joined.withColumn("problems", found)


def evidence_width(terms: DataFrame, compatibility: bool = True) -> int:
    """Words of the longest key of ``terms``: as wide must occurrences be that ``term_evidence`` gets ready-made."""
    return terms.agg(F.max(F.size(F.split(X.term_key(F.col("source_term"), compatibility), " ")))).first()[0] or 1


def term_evidence(terms: DataFrame, blocks: DataFrame, compatibility: bool = True) -> DataFrame:
    """Evidence of reviewed terms in the source: counts, first example, surfaces, blocks and places.

    ``blocks`` may also be occurrences of keys as ``terms.term_occurrences`` gives them.

    ``terms``: project_id, record_no, source_term, origin. Terms without any evidence, those without
    words among them, are unverified and their own only variant. ``variants`` are the surfaces by lower case, ``block_ids`` and ``locations``
    follow the source; these lists are the cells of the glossary entry of the term, as its format asks.
    """
    keyed = terms.withColumn("key", X.term_key(F.col("source_term"), compatibility))
    if "key" in blocks.columns:
        named = blocks.join(keyed.select(*T.KEY).distinct(), T.KEY, "left_semi")
        places = blocks.select("project_id", "source_order", "block_id", "location", "example").distinct()
    else:
        named, places = T.known_runs(blocks, keyed), T.block_places(blocks)
    found = settle(named.select(*T.KEY, "source_order", "surface"))
    counted = found.groupBy(*T.KEY, "source_order").agg(F.count(F.lit(1)).alias("_n"))
    per_block = settle(counted.join(places.drop("example"), ["project_id", "source_order"]))
    listed = lambda what: F.array_sort(F.collect_list(F.struct("source_order", what)))
    totals = per_block.groupBy(*T.KEY).agg(
        F.sum("_n").cast("long").alias("occurrences"), F.count(F.lit(1)).alias("blocks"),
        F.min("source_order").alias("source_order"), listed("block_id").alias("_b"),
    )
    # only the first block of a term has its text read
    firsts = totals.select(*T.KEY, "source_order").join(places.select("project_id", "source_order", "example"), ["project_id", "source_order"])
    counts = totals.drop("source_order").join(firsts.select(*T.KEY, "example"), T.KEY)
    surfaces = found.select(*T.KEY, "surface").distinct().groupBy(*T.KEY).agg(
        F.array_sort(F.collect_list(F.struct(F.lower("surface").alias("low"), F.col("surface").alias("surface")))).alias("_v")
    )
    places = per_block.groupBy(*T.KEY, "location").agg(F.min("source_order").alias("source_order")).groupBy(*T.KEY).agg(listed("location").alias("_p"))
    joined = keyed.join(counts, T.KEY, "left").join(surfaces, T.KEY, "left").join(places, T.KEY, "left")
    none, itself = F.array().cast("array<string>"), F.array(X.collapse("source_term"))
    values = lambda column, name, other: F.coalesce(F.transform(column, lambda x: x[name]), other)
    return joined.select(
        "project_id", "record_no", "source_term", "origin",
        F.coalesce("occurrences", F.lit(0).cast("long")).alias("occurrences"),
        F.coalesce("blocks", F.lit(0).cast("long")).alias("blocks"),
        F.coalesce("example", F.lit("")).alias("example"),
        values("_v", "surface", itself).alias("variants"), values("_b", "block_id", none).alias("block_ids"),
        values("_p", "location", none).alias("locations"),
        F.col("occurrences").isNotNull().alias("source_verified"),
    )


def unverified_terms(evidence: DataFrame, allow_missing_terms: bool = False) -> DataFrame:
    """Problems of terms without evidence; generated ones always, manual ones unless they may be missing."""
    bad = ~F.col("source_verified") & ((F.col("origin") != "manual") | F.lit(not allow_missing_terms))
    return evidence.filter(bad).select("project_id", "record_no", "source_term", F.lit("term_not_in_source").alias("problem"))


def deleted_candidates(expected: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Generated candidate ids that the reviewed table no longer has."""
    return expected.select("project_id", "candidate_id").join(
        reviewed.select("project_id", "candidate_id"), ["project_id", "candidate_id"], "left_anti"
    )


def merge_glossary_edits(current: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows after an edit: generated rows keep their term and evidence, manual rows their evidence
    unless the term changed (then the id is cleared)."""
    editable = ("status", "translation", "category", "note")
    sent = edits.select(
        "project_id", "candidate_id", "row_no",
        X.collapse("status").alias("n_status"), X.strip("translation").alias("n_translation"),
        X.collapse("category").alias("n_category"), X.strip("note").alias("n_note"), X.collapse("source_term").alias("n_term"),
    )
    have = current.select("project_id", "candidate_id", *[c for c in K.GLOSSARY_COLUMNS if c not in (*editable, "candidate_id")]).withColumn("_have", F.lit(True))
    both = sent.join(have, ["project_id", "candidate_id"], "left")
    generated = F.col("_have").isNotNull() & ~F.startswith("candidate_id", F.lit("manual-"))
    same = F.coalesce(F.col("n_term") == X.collapse("source_term"), F.lit(False))
    keeps = generated | same
    term = F.when(generated, F.col("source_term")).otherwise(F.col("n_term"))
    evidence = lambda name: F.when(keeps, F.col(name)).otherwise("").alias(name)
    return both.select(
        "project_id", "row_no", F.col("n_status").alias("status"), term.alias("source_term"),
        status_translation(F.col("n_status"), term, F.col("n_translation")).alias("translation"),
        F.col("n_category").alias("category"), F.col("n_note").alias("note"),
        evidence("variants"), evidence("occurrences"), evidence("locations"), evidence("example"),
        F.when(keeps, F.col("candidate_id")).otherwise("").alias("candidate_id"),
    )


def status_translation(status: Column, term: Column, translation: Column) -> Column:
    return F.when(status == "keep", term).when(status == "rejected", "").otherwise(translation)


SEARCH_FIELDS = {
    "source": ("source_term", "variants"),
    "translation": ("translation",),
    "context": ("locations", "example"),
    "all": ("source_term", "translation", "category", "variants", "locations", "example"),
}


def search_glossary(rows: DataFrame, query: str = "", field: str = "source", status: str = "all", category: str = "all") -> DataFrame:
    hit = F.lit(True)
    if status != "all":
        hit = hit & (F.col("status") == status)
    if category != "all":
        hit = hit & (F.col("category") == category)
    wanted = query.strip().lower()
    if wanted:
        hit = hit & F.contains(F.lower(F.concat_ws("\n", *SEARCH_FIELDS[field])), F.lit(wanted))
    return rows.filter(hit)


def sort_key(by: str) -> list[Column]:
    """Sort columns of a review order; the row index breaks ties."""
    first = F.trim(F.substring_index(F.coalesce("locations", F.lit("")), ",", 1))
    count = F.when(F.col("occurrences").rlike("^[0-9]+$"), F.col("occurrences").cast("long"))
    rank = F.array_position(F.array(*[F.lit(s) for s in K.GLOSSARY_STATUSES]), F.col("status"))
    keys = {
        "default": [],
        "context": [F.when(first != "", X.natural_key(first)).asc_nulls_last()],
        "occurrences-desc": [count.desc_nulls_last()],
        "occurrences-asc": [count.asc_nulls_last()],
        "source": [X.natural_key("source_term").asc()],
        "status": [rank.asc()],
    }
    return [*keys[by], F.col("row_no").asc()]


def sort_glossary(rows: DataFrame, by: str = "default") -> DataFrame:
    return rows.orderBy("project_id", *sort_key(by))


def glossary_summary(rows: DataFrame) -> DataFrame:
    status, cid = F.col("status"), F.trim("candidate_id")
    return rows.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(status == s).alias(s) for s in K.GLOSSARY_STATUSES],
        F.count_if((cid == "") | F.startswith("candidate_id", F.lit("manual-"))).alias("manual"),
        F.count_if((status == "approved") & (F.trim("translation") == "")).alias("missing_translation"),
    )


def import_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("status").isin("approved", "keep")).alias("active"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(F.col("origin") == "manual").alias("manual"),
        F.count_if(~F.col("source_verified")).alias("unverified"),
    )
