"""Term candidates: n-grams of the approved source, their statistics, pruning and ranking.

Every step is keyed by (project, key) or by the place of a word in its block, so a frequent
term or a large project is spread over many tasks; nothing is collected per term but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.functions import text as X
from lexiloom.operators import phrases, scale
from lexiloom.operators.source_qa import effective_text
from lexiloom.session import finer, settle

KEY = ["project_id", "key"]
PLACE = ["project_id", "source_order", "segment", "start"]
# What terms are mined from, besides the place of a block.
READ = ["id", "source_type", "page", "source_file", "block_type", "raw_text", "corrected_text"]


def segments(blocks: DataFrame) -> DataFrame:
    """One row per sentence-like segment that has words, with its position evidence."""
    text = effective_text()
    enumerated = text.rlike(K.LIST_ENUMERATOR)
    clean = F.regexp_replace(text, K.LIST_ENUMERATOR, "")
    clean = F.regexp_replace(F.regexp_replace(clean, K.QUANTITY_PREFIX, " "), K.TOKEN, " ")
    kind = F.lower(F.col("block_type"))
    headed = kind.isin(*K.HEADING_TYPES) | ((kind == "list_item") & (F.contains(text, F.lit(":")) | enumerated))
    split = F.transform(
        F.split(clean, K.SEGMENT_SPLIT, -1),
        lambda part: F.regexp_extract_all(part, F.lit(K.TERM_WORD), F.lit(0)),
    )
    return (
        blocks.select(
            "project_id",
            "source_order",
            F.col("id").alias("block_id"),
            X.locator(F.col("source_type"), F.col("page"), F.col("source_file")).alias("location"),
            X.evidence(text).alias("example"),
            kind.alias("block_type"),
            headed.alias("headed"),
            split.alias("_parts"),
        )
        .withColumn("primary", F.array_position(F.transform("_parts", lambda p: F.size(p) > 0), True) - 1)
        .select("*", F.posexplode("_parts").alias("segment", "words"))
        .filter(F.size("words") > 0)
        .withColumn("whole", F.col("headed") & (F.col("segment") == F.col("primary")) & (F.size("words") <= 6))
        .drop("_parts", "primary", "headed")
    )


def with_key_words(segments: DataFrame) -> DataFrame:
    """Segments with ``_low``, their words as keys have them, and ``_one``, the same as last words."""
    low = F.transform("words", lambda w: F.lower(F.replace(w, F.lit("’"), F.lit("'"))))
    one = F.transform("_low", lambda w: F.when(F.endswith(w, F.lit("s")), X.singularize(w)).otherwise(w))
    return segments.withColumn("_low", low).withColumn("_one", one)


def known_runs(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences of the keys of ``terms`` (project_id, key): place and surface of each.

    A segment only makes the runs that start with a known first word and have a length that some key
    of this first word has, so one long key does not lengthen the runs of all others. A key of one word is
    that word as a last word. Marks of first words and keys tell nearly all other runs before any row is dealt out;
    the join with the keys decides.
    """
    keys = settle(terms.filter("key <> ''").select(*KEY).distinct())
    words = F.split("key", " ")
    several = keys.filter(F.size(words) > 1).select("project_id", F.element_at(words, 1).alias("first"), F.size(words).alias("length")).distinct()
    is_key, is_first, begins = phrases.marks(keys, *KEY), phrases.marks(several, "project_id", "first"), phrases.marks(several, "project_id", "first", "length")
    lengths = F.array(*[F.lit(r.length) for r in several.select("length").distinct().collect()]).cast("array<int>")
    project, at, length = F.col("project_id"), F.col("at"), F.col("length")
    prepared = with_key_words(segments(blocks).select("project_id", "source_order", "segment", "words"))
    low, one = F.get("_low", at), F.get("_one", at)
    began = prepared.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("at")).filter(is_key(project, one) | is_first(project, low))
    # one word, and the lengths that some key has
    lone = F.when(is_key(project, one), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    longer = F.when(is_first(project, low), lengths).otherwise(F.array().cast("array<int>"))
    sized = began.select("*", F.explode(F.concat(lone, longer)).alias("length"))
    runs = sized.filter((at + length <= F.size("words")) & ((length == 1) | begins(project, low, length)))
    cut = runs.select(
        "project_id", "source_order", "segment", at.alias("start"), "length",
        F.concat_ws(" ", F.slice("_low", at + 1, length - 1), F.get("_one", at + length - 1)).alias("key"),
        F.array_join(F.slice("words", at + 1, length), " ").alias("surface"),
    )
    return cut.filter(is_key(project, F.col("key"))).join(keys, KEY, "left_semi")


def known_occurrences(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """``known_runs`` with the id, place and example of their blocks."""
    return known_runs(blocks, terms).join(block_places(blocks), ["project_id", "source_order"])


def block_places(blocks: DataFrame) -> DataFrame:
    """Where each block is (project_id, source_order): its id, place and example text."""
    return blocks.select(
        "project_id", "source_order", F.col("id").alias("block_id"),
        X.locator(F.col("source_type"), F.col("page"), F.col("source_file")).alias("location"),
        X.evidence(effective_text()).alias("example"),
    )


# Blocks whose runs a task counts at once; a block of 200 characters has about 130 runs.
TASK_BLOCKS = 20_000


def term_occurrences(blocks: DataFrame, max_words: int = 4, task_blocks: int = TASK_BLOCKS) -> DataFrame:
    """Every run of 1..max_words words of a segment, with its key, span and evidence.

    Words are prepared once per segment; the runs are then cut from those arrays inside the
    generated code of the two generators, so a row costs no more than its own few words.
    """
    if max_words < 1:
        raise ValueError("max_words must be at least 1")
    upper_first = lambda w: F.ascii(w).between(65, 90)
    code = lambda w: F.when(F.lower(w).isin(*K.CONNECTORS), 2).when(upper_first(w) & X.is_title_token(w), 1).otherwise(0)
    prepared = with_key_words(segments(finer(blocks, task_blocks))).withColumn("_code", F.transform("words", code)).withColumn("_n", F.size("words"))
    runs = prepared.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("start")).select(
        "*", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_words), F.col("_n") - F.col("start")))).alias("length")
    )
    start, length = F.col("start"), F.col("length")
    codes = F.slice("_code", start + 1, length)
    titled = ~F.array_contains(codes, 0) & F.array_contains(codes, 1)
    return runs.select(
        "project_id", "source_order", "block_id", "location", "example", "block_type", "segment", "start",
        (start + length).alias("end"),
        length.alias("length"),
        F.concat_ws(" ", F.slice("_low", start + 1, length - 1), F.get("_one", start + length - 1)).alias("key"),
        F.array_join(F.slice("words", start + 1, length), " ").alias("surface"),
        (F.col("whole") & (start == 0) & (length == F.col("_n"))).alias("heading"),
        (titled & ((start > 0) | F.col("whole"))).alias("title"),
    )


def can_qualify() -> Column:
    """False for keys that no evidence can make a term; safe to drop before the shuffle."""
    key, single = F.col("key"), F.col("length") == 1
    first = F.substring_index(key, " ", 1)
    return (
        (F.length(key) >= 3)
        & ~(single & (key.rlike(K.ROMAN) | key.isin(*K.STOPWORDS)))
        & ~(~single & first.isin(*K.ARTICLES))
    )


def term_stats(occurrences: DataFrame, min_frequency: int = 2) -> DataFrame:
    """Counts and evidence of every key that qualifies as a candidate.

    Keys are counted per block first, so the distinct block count needs no set per key.
    """
    per_block = (
        occurrences.filter(can_qualify())
        .groupBy(*KEY, "source_order")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max("heading").alias("_h"),
            F.max("title").alias("_t"),
            F.max(F.col("block_type") == "ability").alias("_a"),
            F.max(F.col("block_type").isin(*K.UI_TYPES)).alias("_u"),
        )
    )
    stats = per_block.groupBy(*KEY).agg(
        F.sum("_n").cast("long").alias("occurrences"),
        F.count(F.lit(1)).alias("blocks"),
        F.max("_h").alias("heading"),
        F.max("_t").alias("title"),
        F.max("_a").alias("in_ability"),
        F.max("_u").alias("in_ui"),
    )
    return stats.filter(_qualifies(F.col("occurrences"), F.col("blocks") >= 2, F.col("heading"), F.col("title"), min_frequency))


def _qualifies(occurrences: Column, two: Column, heading: Column, title: Column, min_frequency: int) -> Column:
    """Whether a key is a candidate; ``two``: it is in two blocks at least."""
    words = F.split("key", " ")
    many = F.size(words) > 1
    stop = lambda w: w.isin(*K.STOPWORDS)
    loose = (
        stop(F.element_at(words, 1))
        | stop(F.element_at(words, -1))
        | (F.size(F.filter(words, stop)) > F.floor(F.size(words) / 2))
    )
    enough = (
        F.when(heading, True)
        .when(many & title, two)
        .when(~many & title & two, True)
        .otherwise((occurrences >= min_frequency) & two)
    )
    return ~(many & ~heading & ~title & loose) & enough


def candidate_occurrences(occurrences: DataFrame, min_frequency: int = 2, carry: tuple[str, ...] = ("surface",)) -> DataFrame:
    """All occurrences of the keys that ``term_stats`` keeps, written once, with the columns ``carry``.

    Most runs of a text are found nowhere else. They are dropped here, after the one shuffle by key that
    every occurrence takes part in; a key's rows lie together, so later counts by key meet few rows.
    """
    key = Window.partitionBy(*KEY)
    order = F.col("source_order")
    evidence = {
        "_n": F.count(F.lit(1)).over(key), "_h": F.max("heading").over(key), "_t": F.max("title").over(key),
        "_first": F.min(order).over(key), "_last": F.max(order).over(key), "_placed": F.count(order).over(key),
    }
    two = F.coalesce(F.col("_first") != F.col("_last"), F.lit(False)) | ((F.col("_placed") > 0) & (F.col("_placed") < F.col("_n")))
    kept = ["project_id", "key", "source_order", "segment", "start", "length", "block_type", "heading", "title", *carry]
    rows = occurrences.filter(can_qualify()).select(*kept).withColumns(evidence)
    return settle(rows.filter(_qualifies(F.col("_n"), two, F.col("_h"), F.col("_t"), min_frequency)).select(*kept))


def term_score() -> Column:
    return F.bround(
        F.log2(F.col("occurrences") + 1) * 2
        + F.least(F.col("blocks"), F.lit(8)) * 0.5
        + F.when(F.col("heading"), 3.0).otherwise(0.0)
        + F.when(F.col("title"), 1.5).otherwise(0.0)
        + F.when(F.contains(F.col("key"), F.lit(" ")), 0.5).otherwise(0.0),
        3,
    )


def surface_counts(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy(*KEY, "surface").agg(F.count(F.lit(1)).alias("n"))


def _surface_rank() -> Column:
    s = F.col("surface")
    return F.struct(-F.col("n"), F.size(F.split(s, " ")), F.length(s), F.lower(s), s)


def representative_surface(counts: DataFrame) -> DataFrame:
    """Most frequent surface per key; ties: fewer words, shorter, then by text."""
    return counts.groupBy(*KEY).agg(F.min_by("surface", _surface_rank()).alias("source_term"))


def term_category() -> Column:
    words = F.regexp_extract_all(F.col("source_term"), F.lit(K.TERM_WORD), F.lit(0))
    low = F.transform(words, F.lower)
    component = F.arrays_overlap(low, F.array(*[F.lit(w) for w in K.COMPONENT_WORDS]))
    return (
        F.when(F.col("in_ability"), "ability")
        .when(component, "component")
        .when(F.col("in_ui"), "ui")
        .when(X.is_title_phrase(words), "proper_noun")
        .when(F.size(F.array_distinct(low)) > 1, "phrase")
        .otherwise("term")
    )


def prune_nested_terms(stats: DataFrame, occurrences: DataFrame, max_words: int = 4) -> DataFrame:
    """Drop candidates that only ever occur inside a longer candidate whose words contain theirs.

    Candidate spans are laid out per start word; each start looks back over at most
    ``max_words - 1`` earlier starts of its own segment, so no pairs are built.
    """
    spans = occurrences.filter(can_qualify()).select(*PLACE, "length", "key").join(
        stats.select(*KEY), KEY, "left_semi"
    )
    # one shuffle by segment serves the starts and the looks back
    here = spans.repartition("project_id", "source_order", "segment").groupBy(*PLACE).agg(F.collect_list(F.struct("length", "key")).alias("spans"))
    segment = Window.partitionBy("project_id", "source_order", "segment").orderBy("start")
    empty = F.array().cast("array<struct<ends:int,length:int,key:string>>")
    reach = F.transform(
        "spans", lambda s: F.struct((F.col("start") + s["length"]).cast("int").alias("ends"), s["length"].cast("int").alias("length"), s["key"].alias("key"))
    )
    laid = here.withColumn("_reach", reach)
    lagged = [F.coalesce(F.lag("_reach", i).over(segment), empty) for i in range(1, max_words)]
    around = laid.withColumn("_around", F.concat("_reach", *lagged) if lagged else F.col("_reach"))
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    inside = F.exists(
        "_around",
        lambda big: (big["length"] > F.col("s.length"))
        & (big["ends"] >= F.col("start") + F.col("s.length"))
        & F.contains(pad(big["key"]), pad(F.col("s.key"))),
    )
    free = (
        around.select("project_id", "start", "_around", F.explode("spans").alias("s"))
        .select("project_id", F.col("s.key").alias("key"), inside.alias("covered"))
        .groupBy(*KEY)
        .agg(F.bool_and("covered").alias("_covered"))
        .filter(~F.col("_covered"))
    )
    return stats.join(free.select(*KEY), KEY, "left_semi")


def term_candidates(blocks: DataFrame, min_frequency: int = 2, max_words: int = 4) -> DataFrame:
    """All pruned candidates with score, representative surface and category."""
    if not 1 <= max_words <= 6:
        raise ValueError("mined terms have 1 to 6 words")
    occurrences = candidate_occurrences(term_occurrences(blocks, max_words), min_frequency)
    stats = settle(term_stats(occurrences, min_frequency))
    kept = prune_nested_terms(stats, occurrences, max_words)
    # The surface counts are joined to the kept keys only after their own aggregation.
    surfaces = representative_surface(surface_counts(occurrences))
    return (
        kept.join(surfaces, KEY)
        .withColumn("score", term_score())
        .withColumn("category", term_category())
        .withColumn("candidate_id", X.term_id(F.col("key")))
        .drop("in_ability", "in_ui")
    )


def top_terms(candidates: DataFrame, k: int = 500) -> DataFrame:
    """Best ``k`` candidates per project by score, occurrences and term."""
    order = [F.desc("score"), F.desc("occurrences"), F.lower("source_term"), F.col("key")]
    return scale.top_per_group(candidates, ["project_id"], order, k, ["key"])


def term_variants(occurrences: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct surfaces of each term as rows, in text order."""
    return surface_counts(occurrences.join(terms.select(*KEY).distinct(), KEY, "left_semi"))


def term_locations(occurrences: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct places of each term as rows, with the first block order of each place."""
    return (
        occurrences.join(terms.select(*KEY).distinct(), KEY, "left_semi")
        .groupBy(*KEY, "location")
        .agg(F.min("source_order").alias("first_order"))
    )


def term_examples(occurrences: DataFrame, terms: DataFrame) -> DataFrame:
    """Example text of the first block of each term."""
    return (
        occurrences.join(terms.select(*KEY).distinct(), KEY, "left_semi")
        .groupBy(*KEY)
        .agg(F.min_by("example", "source_order").alias("example"), F.count(F.lit(1)).alias("occurrences"))
    )
