"""Translation requests: term look-up, chunk packing, prompts, answers, segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.functions import items as I
from lexiloom.functions import text as X
from lexiloom.operators import phrases, scale

# --- Which terms occur in which text --------------------------------------------------------


def term_index(termbase: DataFrame) -> DataFrame:
    """One row per active variant, with its entry as ``e``."""
    entry = F.struct("candidate_id", "source_term", "translation", "status", "variant")
    return active_variants(termbase).select("project_id", "variant", entry.alias("e"))


def active_variants(termbase: DataFrame) -> DataFrame:
    """The rows of approved and kept terms, once for each ``variant``."""
    active = termbase.filter(F.col("status").isin("approved", "keep"))
    return active.withColumn("variant", F.explode(I.term_variants(F.col("source_term"), F.col("variants"))))


def term_hits(texts: DataFrame, termbase: DataFrame) -> DataFrame:
    """Texts with ``hits``: the active term variants that occur in them, each once.

    Whole runs meet whole variants (``phrases``), so a row lists what is found and nothing unproven.
    What a text can hit is bounded by the text.
    """
    return index_hits(texts, term_index(termbase))


def index_hits(texts: DataFrame, index: DataFrame) -> DataFrame:
    """Texts with ``hits``: the entries ``e`` of ``index`` (project_id, variant, e) that occur in them, each once."""
    return phrases.with_variants(texts, index).withColumnRenamed("found", "hits")


def relevant_terms(texts: DataFrame, termbase: DataFrame) -> DataFrame:
    """(project_id, text_id, candidate_id, status) for every active term found in a text."""
    found = phrases.variants_in_texts(texts, term_index(termbase))
    return found.select("project_id", "text_id", F.col("e.candidate_id").alias("candidate_id"), F.col("e.status").alias("status")).distinct()


# --- Packing blocks into chunks -------------------------------------------------------------
#
# Packing is greedy along the project, so the state at a block is the size of the open chunk.
# Each slice of a project is reduced to a table "open size on entry -> open size on exit"; the
# tables are chained per project, and each slice is then packed on its own from its known entry.

PACK_SPAN = 65_536


def _transfer_table(sizes: np.ndarray, limit: int) -> list[tuple[int, int, int, bool]]:
    """Rows (low, high, exit, add): entries low..high leave with ``exit``, or entry + exit if add."""
    count = len(sizes)
    reach = np.cumsum(sizes + 2)
    after = np.empty(count, dtype=np.int64)
    jump = np.maximum(np.searchsorted(reach, limit - sizes + reach, side="right"), np.arange(count) + 1)
    for i in range(count - 1, -1, -1):
        after[i] = sizes[i] + reach[-1] - reach[i] if jump[i] >= count else after[jump[i]]
    rows = [(-1, -1, int(after[0]), False)]
    high = limit
    for i in range(count):
        low = max(limit - int(reach[i]) + 1, 0)
        if low <= high:
            if len(rows) > 1 and rows[-1][2] == after[i]:
                rows[-1] = (low, rows[-1][1], int(after[i]), False)
            else:
                rows.append((low, high, int(after[i]), False))
            high = low - 1
        if high < 0:
            break
    if high >= 0:
        rows.append((0, high, int(reach[-1]), True))
    return rows


def chunk_starts(sizes: DataFrame, limit: int, span: int = PACK_SPAN) -> DataFrame:
    """``sizes`` (project_id, source_order, size) with ``starts``: 1 where a new chunk begins."""
    sliced = sizes.select("project_id", "source_order", "size", F.floor(F.col("source_order") / span).cast("long").alias("slice"))

    def make_tables(limit=limit, table=_transfer_table):
        def tables(key, part):
            ordered = part.sort_values("source_order")["size"].to_numpy(dtype="int64")
            rows = [(key[0], key[1], *row) for row in table(ordered, limit)]
            return pd.DataFrame(rows, columns=["project_id", "slice", "low", "high", "leave", "add"])

        return tables

    def make_chain(limit=limit):
        def chain(key, part):
            state, out = -1, []
            for number, rows in part.sort_values("slice").groupby("slice", sort=True):
                out.append((key[0], number, state))
                entry = min(state, limit)
                row = rows[(rows["low"] <= entry) & (rows["high"] >= entry)].iloc[0]
                state = entry + int(row["leave"]) if row["add"] else int(row["leave"])
            return pd.DataFrame(out, columns=["project_id", "slice", "entry"])

        return chain

    def make_mark(limit=limit):
        def mark(key, part):
            part = part.sort_values("source_order")
            state, flags = int(part["entry"].iloc[0]), []
            for size in part["size"].tolist():
                fits = state >= 0 and state + 2 + size <= limit
                flags.append(0 if fits else 1)
                state = state + 2 + size if fits else size
            return pd.DataFrame(
                {"project_id": part["project_id"], "source_order": part["source_order"], "size": part["size"], "starts": flags}
            )

        return mark

    tables = sliced.groupBy("project_id", "slice").applyInPandas(
        make_tables(), "project_id string, slice long, low long, high long, leave long, add boolean"
    )
    entries = tables.groupBy("project_id").applyInPandas(make_chain(), "project_id string, slice long, entry long")
    return (
        sliced.join(entries, ["project_id", "slice"])
        .groupBy("project_id", "slice")
        .applyInPandas(make_mark(), "project_id string, source_order long, size long, starts long")
    )


def pack_chunks(blocks: DataFrame, text: Column, max_characters: int = 10_000, span: int = PACK_SPAN) -> DataFrame:
    """(project_id, source_order, size, chunk_no): greedy packing in source order."""
    if max_characters <= 0:
        raise ValueError("max_characters must be positive")
    sizes = blocks.select("project_id", "source_order", F.length(text).cast("long").alias("size"))
    starts = chunk_starts(sizes, max_characters, span)
    return scale.running_total(starts, ["project_id"], "source_order", [], F.col("starts"), "chunk_no").drop("starts")


def chunk_table(blocks: DataFrame, packed: DataFrame, text: Column) -> DataFrame:
    """One row per chunk: id, ordered block ids, size. A chunk holds at most the size limit."""
    rows = blocks.select("project_id", "source_order", "id", X.text_sha256(text).alias("hash")).join(
        packed, ["project_id", "source_order"]
    )
    listed = F.array_sort(F.collect_list(F.struct("source_order", "id", "hash")))
    grouped = rows.groupBy("project_id", "chunk_no").agg(
        listed.alias("_b"), F.sum("size").alias("_size"), F.count(F.lit(1)).alias("blocks")
    )
    identity = F.array_join(F.transform("_b", lambda b: F.concat(b["id"], F.lit(":"), b["hash"])), "\n")
    return grouped.select(
        "project_id", "chunk_no",
        F.concat(F.lit("chunk-"), X.short_hash(identity, 12)).alias("chunk_id"),
        F.transform("_b", lambda b: b["id"]).alias("block_ids"),
        "blocks",
        (F.col("_size") + 2 * (F.col("blocks") - 1)).cast("long").alias("character_count"),
    )


# --- Requests and answers -------------------------------------------------------------------


def keep_patterns(hits: DataFrame) -> DataFrame:
    """Texts with ``keep_pattern``: an alternation of the keep variants that occur in them."""
    keep = F.transform(F.filter("hits", lambda h: h["status"] == "keep"), lambda h: h["variant"])
    return hits.withColumn("keep_pattern", I.keep_pattern(keep))


def translation_request(chunks: DataFrame, instructions: str = "") -> DataFrame:
    """Per chunk, the JSON request: protected block texts and the terms found in the chunk.

    ``chunks``: project_id, chunk_no, source_order, id, block_type, source_file, page, text, hits, keep_pattern.
    """
    block = F.struct(
        "id", F.col("block_type").alias("type"), "source_file", "page",
        I.protect_keep_terms(F.col("text"), F.col("keep_pattern")).alias("source"),
    )
    listed = F.array_sort(F.collect_list(F.struct("source_order", block.alias("b"))))
    terms = F.array_sort(F.array_distinct(F.flatten(F.collect_list(
        F.transform("hits", lambda h: F.struct(h["source_term"].alias("source_term"), h["translation"].alias("translation"), h["status"].alias("status")))
    ))))
    body = F.struct(
        F.lit(instructions).alias("instructions"),
        F.col("_t").alias("terms"),
        F.transform("_l", lambda e: e["b"]).alias("blocks"),
    )
    grouped = chunks.groupBy("project_id", "chunk_no").agg(listed.alias("_l"), terms.alias("_t"))
    return grouped.select("project_id", "chunk_no", F.to_json(body).alias("request"), F.size("_t").alias("terms"))


def parse_model_response(df: DataFrame, column: str, schema) -> DataFrame:
    """Adds ``parsed`` and ``malformed`` (the answer is no object of the wanted shape)."""
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    first = schema.fields[0].name
    return df.withColumn("parsed", parsed).withColumn("malformed", F.col("parsed").isNull() | F.col("parsed")[first].isNull())


def answer_items(responses: DataFrame) -> DataFrame:
    """One row per answered item: project_id, chunk_no, item_pos, id, text."""
    return responses.select("project_id", "chunk_no", F.posexplode("parsed.translations").alias("item_pos", "i")).select(
        "project_id", "chunk_no", "item_pos", F.col("i.id").alias("id"), F.col("i.text").alias("text")
    )


def match_responses(requests: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted items, one verdict per chunk) for asked blocks and answered items.

    ``requests``: project_id, chunk_no, source_order, id. Windows are bounded by the chunk.
    """
    asked = requests.select("project_id", "chunk_no", "id", "source_order")
    clean = X.strip(F.coalesce("text", F.lit("")))
    tagged = items.withColumn("text", clean).join(asked, ["project_id", "chunk_no", "id"], "left")
    known = F.col("source_order").isNotNull()
    per_id = Window.partitionBy("project_id", "chunk_no", "id").orderBy("item_pos").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.col("text") != ""
    judged = (
        tagged.withColumn("_before", F.coalesce(F.max(filled).over(per_id), F.lit(False)))
        .withColumn("unknown", ~known)
        .withColumn("duplicate", known & F.col("_before"))
        .withColumn("empty", known & ~F.col("_before") & ~filled)
        .withColumn("accepted", known & ~F.col("_before") & filled)
    )
    took = F.transform(F.array_sort(F.collect_list(F.when(F.col("accepted"), F.struct("item_pos", "id")))), lambda p: p["id"])
    answered = judged.groupBy("project_id", "chunk_no").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if("unknown").alias("unknown"),
        F.count_if("duplicate").alias("duplicate"),
        F.count_if("empty").alias("empty"),
        took.alias("took"),
    )
    wanted = asked.groupBy("project_id", "chunk_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("source_order", "id"))), lambda p: p["id"]).alias("wanted")
    )
    none = F.array().cast("array<string>")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    verdict = (
        wanted.join(answered, ["project_id", "chunk_no"], "left")
        .withColumn("took", F.coalesce("took", none))
        .select(
            "project_id", "chunk_no", zero("unknown"), zero("duplicate"), zero("empty"),
            F.size(F.array_except("wanted", "took")).cast("long").alias("missing"),
            (F.col("took") != F.col("wanted")).alias("order_changed"),
            (F.coalesce("items", F.lit(0)) != F.size("wanted")).alias("count_changed"),
        )
        .withColumn(
            "valid",
            ((F.col("unknown") + F.col("duplicate") + F.col("empty") + F.col("missing")) == 0)
            & ~F.col("order_changed") & ~F.col("count_changed"),
        )
    )
    accepted = judged.filter("accepted").select("project_id", "chunk_no", "id", "source_order", "text")
    return accepted, verdict


def pending_chunks(chunk_blocks: DataFrame, stored: DataFrame) -> DataFrame:
    """Per chunk: complete, partial (an error) or pending, from the segments stored so far.

    ``chunk_blocks``: project_id, chunk_no, id, source_sha256. A stored segment counts only when
    its source hash is still the block's.
    """
    have = stored.select("project_id", F.col("source_block_id").alias("id"), F.col("source_sha256").alias("_stored"))
    joined = chunk_blocks.join(have, ["project_id", "id"], "left")
    return joined.groupBy("project_id", "chunk_no").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count("_stored").alias("stored"),
        F.count_if(F.col("_stored") != F.col("source_sha256")).alias("changed"),
    ).withColumn(
        "state",
        F.when(F.col("changed") > 0, "stale")
        .when(F.col("stored") == F.col("blocks"), "complete")
        .when(F.col("stored") > 0, "partial")
        .otherwise("pending"),
    )


def cache_lookup(inputs: DataFrame, cache: DataFrame, keys: list[str], result: str) -> DataFrame:
    """Inputs with the cached result of an equal key, and whether there was one; of several results the least."""
    have = cache.groupBy(*keys).agg(F.min(result).alias(result)).withColumn("hit", F.lit(True))
    return inputs.join(have, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def build_segments(accepted: DataFrame, issues: DataFrame, model: str, prompt_hash: str, termbase_hash: str) -> DataFrame:
    """Segment rows from source blocks with their translation; flagged when an issue names them.

    ``accepted``: project_id, id, source_file, page, source_order, block_type, source_text, translated_text.
    """
    bad = issues.select("project_id", F.col("block_id").alias("id")).distinct().withColumn("_bad", F.lit(True))
    return accepted.join(bad, ["project_id", "id"], "left").select(
        "project_id", F.lit(K.SCHEMA_VERSION).alias("schema_version"), F.col("id").alias("source_block_id"),
        "source_file", "page", "source_order", "block_type", "source_text",
        X.text_sha256("source_text").alias("source_sha256"),
        "translated_text",
        X.text_sha256("translated_text").alias("translation_sha256"),
        F.when(F.col("_bad"), "flagged").otherwise("translated").alias("status"),
        F.lit(model).alias("model"), F.lit(prompt_hash).alias("prompt_sha256"), F.lit(termbase_hash).alias("termbase_sha256"),
    )


def diff_review(segments: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Segments with the reviewed text, whether it changed, and the correction (null if not).

    A segment without a reviewed text stays, with a null ``reviewed`` and ``changed``.
    """
    new = reviewed.select("project_id", "source_block_id", F.col("text").alias("reviewed"))
    changed = F.col("reviewed") != F.col("translated_text")
    return segments.join(new, ["project_id", "source_block_id"], "left").withColumn("changed", changed).withColumn(
        "correction", F.when(changed, F.col("reviewed"))
    )


def approve_translations(segments: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Approved rows of all segments; one without a reviewed text is marked ``unreviewed`` and has no final hash."""
    return diff_review(segments, reviewed).select(
        "project_id", "schema_version", "source_block_id", "source_file", "page", "source_order", "block_type",
        "source_text", "source_sha256",
        F.col("translated_text").alias("draft_translation"),
        F.col("translation_sha256").alias("draft_translation_sha256"),
        F.col("correction").alias("corrected_translation"),
        X.text_sha256("reviewed").alias("final_translation_sha256"),
        F.when(F.col("reviewed").isNull(), "unreviewed").otherwise("approved").alias("status"), "model", "prompt_sha256", "termbase_sha256",
    )


def failed_blocks(segments: DataFrame, issues: DataFrame) -> DataFrame:
    """Segments with an error; a project with a structural error (no block id) is left out."""
    errors = issues.filter(F.col("severity") == "error")
    broken = errors.filter(F.col("block_id").isNull()).select("project_id").distinct()
    named = errors.select("project_id", F.col("block_id").alias("source_block_id")).distinct()
    return segments.join(named, ["project_id", "source_block_id"], "left_semi").join(broken, "project_id", "left_anti")


def merge_retries(current: DataFrame, retried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments after the retry, change log). A project with an unanswered retry keeps its text.

    ``retried``: project_id, source_block_id, new_text (null when the retry failed).
    """
    failed = retried.filter(F.col("new_text").isNull()).select("project_id").distinct()
    usable = retried.join(failed, "project_id", "left_anti")
    merged = current.join(usable, ["project_id", "source_block_id"], "left")
    after = merged.withColumn("translated_text", F.coalesce("new_text", "translated_text")).withColumn(
        "translation_sha256", X.text_sha256("translated_text")
    )
    log = merged.filter(F.col("new_text").isNotNull()).select(
        "project_id", "source_block_id", F.col("translated_text").alias("previous_translation"),
        F.col("new_text").alias("retried_translation"),
    )
    return after.drop("new_text"), log


def block_id_mismatch(expected: DataFrame, submitted: DataFrame) -> DataFrame:
    """(project_id, id, kind): ids only one side has."""
    missing = expected.select("project_id", "id").join(submitted, ["project_id", "id"], "left_anti").withColumn("kind", F.lit("missing"))
    unknown = submitted.select("project_id", "id").join(expected, ["project_id", "id"], "left_anti").withColumn("kind", F.lit("unknown"))
    return missing.unionByName(unknown).distinct()
