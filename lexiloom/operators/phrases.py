"""Phrases of a dictionary in texts, by equality of whole runs.

A phrase is a run of words whose length is kept by its first word. A text only emits the runs that
start with a known first word and are as long as some phrase that starts with it, so a long phrase
costs nothing where its first word does not occur, and a first word that thousands of phrases share
costs a text one row per place and length. Runs and phrases then meet by equality of the whole run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexiloom import constants as K
from lexiloom.functions import items as I
from lexiloom.functions import text as X
from lexiloom.session import settle

# A sign that is neither letter, digit nor white space, with the character beside it; and such a sign alone.
SIGN = r"[^\p{L}\p{N}\s]"
SIGN_PAIR = rf"(?s)(?=({SIGN}.|.{SIGN}))"


def fold(text: Column | str) -> Column:
    """Lower case, with one form for the letters that have two."""
    return X.fold(text)


def lengths(phrases: DataFrame) -> DataFrame:
    """``phrases`` (project_id, first, length) -> per first word the distinct lengths."""
    return phrases.groupBy("project_id", F.col("first").alias("token")).agg(F.array_sort(F.collect_set("length")).alias("lengths"))


def distinct_words(texts: DataFrame, words: Column, key: list[str]) -> DataFrame:
    """The distinct words of each text (by ``key``) as ``token``; the text itself is not carried."""
    return texts.select(*key, F.explode(F.array_distinct(words)).alias("token"))


def known_words(tokens: DataFrame, phrases: DataFrame, key: list[str]) -> DataFrame:
    """Texts (by ``key``) with ``known``: the first words of phrases that occur in them, with the lengths."""
    met = tokens.join(lengths(phrases), ["project_id", "token"])
    return met.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("token", "lengths"))).alias("known"))


# Bits of ``marks`` for each row, and at most: 8 MB of them pass through the driver, however many rows there are.
MARK_BITS, MOST_BITS = 16, 1 << 26


def marks(rows: DataFrame, *values: Column | str) -> Callable[..., Column]:
    """A test of ``values``: true for those of any of the ``rows``, and for few others as long as the rows fit in the bits.

    It thins out what is then joined, and never decides alone.
    """
    spark, size = rows.sparkSession, 64
    wanted = rows.count() * MARK_BITS
    while size < min(wanted, MOST_BITS):
        size *= 2
    slot = lambda *values: F.pmod(F.xxhash64(*values), F.lit(size))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_at", F.lit(64)).cast("int"))
    longs = rows.select(slot(*values).alias("_at")).groupBy(F.shiftright("_at", 6).alias("id")).agg(F.bit_or(bit).alias("_bits"))
    dense = spark.range(size >> 6).join(longs, "id", "left").select("id", F.coalesce("_bits", F.lit(0).cast("long")).alias("_bits"))
    listed = settle(dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "_bits"))), lambda x: x["_bits"]).alias("_marks"))).scalar()
    return lambda *values: F.getbit(F.get(listed, F.shiftright(slot(*values), 6).cast("int")), (slot(*values) % 64).cast("int")) == 1


def starts(firsts: Column, known: Column, count: Column) -> Column:
    """(at, length) of each run of a text that may be a phrase; ``at`` counts words from 0."""
    of_word = lambda w, i: F.transform(
        F.filter(F.try_element_at(known, w), lambda n: i + n <= count), lambda n: F.struct(i.alias("at"), n.alias("length"))
    )
    return F.flatten(F.filter(F.transform(firsts, of_word), lambda found: found.isNotNull()))


# --- Variants of terms in texts ---------------------------------------------------------------


def variant_phrases(variants: DataFrame) -> DataFrame:
    """``variants`` with ``first``, ``length``, ``phrase``, ``lead`` and ``tail``, and ``gram`` for the rest.

    The phrase reaches from the first word to the last, signs between them included; ``lead`` and
    ``tail`` are the signs around it. A variant without words, or with an underscore at an edge, where
    a word of the text may go on, has no phrase but a ``gram``: the first sign with its neighbour.
    """
    variant = fold(X.strip(F.col("variant")))
    words = I.find_all(variant, K.WORD_RUN)
    open_edge = variant.rlike("^_|_$")
    bare = open_edge | (F.size(words) == 0)
    cut = "(?s)^([^\\p{L}\\p{N}_]*)(.*?)([^\\p{L}\\p{N}_]*)$"
    part = lambda group: F.when(~bare, F.regexp_extract(variant, cut, group))
    pair = F.regexp_extract(variant, rf"(?s)({SIGN}.|.{SIGN})", 1)
    return variants.filter(variant != "").withColumns({
        "first": F.when(~bare, F.element_at(words, 1)), "length": F.when(~bare, F.size(words)),
        "lead": part(1), "phrase": part(2), "tail": part(3),
        "gram": F.when(bare, F.when(F.length(variant) == 1, variant).otherwise(pair)),
    })


def text_tokens(texts: DataFrame) -> DataFrame:
    """The distinct words of each ``text`` as ``token``, with the other columns of ``texts``."""
    return distinct_words(texts, I.find_all(fold("text"), K.WORD_RUN), [c for c in texts.columns if c != "text"])


def text_runs(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(project_id, text_id, phrase, before, after): distinct runs that may be phrases, and the signs around them."""
    low = fold("text")
    known = known_words(text_tokens(texts), phrases, ["project_id", "text_id"])
    read = texts.join(known, ["project_id", "text_id"]).withColumn("_words", I.find_all(low, K.WORD_RUN)).withColumn("_gaps", F.split(low, K.WORD_RUN, -1))
    # words and the signs behind them in turn: a run of n words is a slice of 2 n - 1 of them
    turns = read.withColumn("_turns", F.flatten(F.zip_with("_words", F.slice("_gaps", F.lit(2), F.size("_words")), lambda w, g: F.array(w, g))))
    cut = F.transform(
        starts(F.col("_words"), F.col("known"), F.size("_words")),
        lambda s: F.struct(
            F.array_join(F.slice("_turns", s["at"] * 2 + 1, s["length"] * 2 - 1), "").alias("phrase"),
            F.get("_gaps", s["at"]).alias("before"), F.get("_gaps", s["at"] + s["length"]).alias("after"),
        ),
    )
    return turns.select("project_id", "text_id", F.explode(F.array_distinct(cut)).alias("r")).select("project_id", "text_id", "r.*")


def text_grams(texts: DataFrame) -> DataFrame:
    """(project_id, text_id, gram): distinct signs of a text, alone and with each neighbour."""
    low = fold("text")
    grams = F.array_union(I.find_all(low, SIGN_PAIR, 1), I.find_all(low, SIGN))
    return texts.select("project_id", "text_id", F.explode(grams).alias("gram"))


def text_key(df: DataFrame) -> DataFrame:
    """``df`` with ``at``, a number of (project_id, text_id) put before them: rows are sorted and dealt by numbers, not long ids."""
    return df.withColumn("at", F.xxhash64("project_id", "text_id"))


def word_entries(keyed: DataFrame) -> DataFrame:
    """(project_id, token, entries): the variants that are one word, listed under it.

    With signs around the word an entry has a ``pattern``, which the folded text must match.
    """
    plain = (F.col("lead") == "") & (F.col("tail") == "")
    pattern = F.when(~plain, X.term_pattern(fold(F.col("variant"))))
    entry = F.struct("e", pattern.alias("pattern"))
    return keyed.filter(F.col("length") == 1).groupBy("project_id", F.col("phrase").alias("token")).agg(F.collect_set(entry).alias("entries"))


def other_variants(texts: DataFrame, keyed: DataFrame) -> list[DataFrame]:
    """Rows (project_id, text_id, e) of the variants of several words, and of signs; nothing is read for kinds that are not there."""
    columns, found = ["project_id", "text_id", "e"], []
    phrases = keyed.filter(F.col("length") > 1)
    if not phrases.isEmpty():
        around = F.endswith("before", F.col("lead")) & F.startswith("after", F.col("tail"))
        runs = text_runs(texts, phrases.select("project_id", "first", "length"))
        found.append(runs.join(phrases, ["project_id", "phrase"]).filter(around).select(columns))
    signs = keyed.filter(F.col("gram").isNotNull()).select("project_id", "gram", "variant", "e")
    if not signs.isEmpty():
        met = text_grams(texts).join(signs, ["project_id", "gram"])
        by_sign = met.join(texts, ["project_id", "text_id"]).filter(X.contains_term(F.col("text"), F.col("variant")))
        found.append(by_sign.select(columns))
    return found


# Texts whose words meet the variants together: 2 to the power of this, at most.
PART_BITS = 14


def in_parts(texts: DataFrame) -> DataFrame:
    """``texts`` written once, with ``_part``: up to 16,384 texts that lie together.

    Its last six bits tell eight neighbouring parts of eight neighbouring tasks apart.
    """
    row = F.monotonically_increasing_id()  # the task times 2 to the power of 33, and the row in it
    task, nth = F.shiftright(row, 33), F.shiftright(row % (1 << 33), PART_BITS)
    high = F.shiftleft(F.shiftright(nth, 3), 31) + F.shiftright(task, 3)
    return settle(texts.withColumn("_part", F.shiftleft(high, 6) + (task % 8) * 8 + nth % 8))


def with_entries(parts: DataFrame, entries: DataFrame) -> DataFrame:
    """``parts`` (``in_parts``) with ``_entries``: the ``entries`` (project_id, token, entries) of the words of each text, in a list.

    What is dealt out for a word is its entries once a part and project, however many texts of the part have it. A text
    without an id has none.
    """
    group = ["_part", "project_id"]
    tokens = text_tokens(parts.filter(F.col("text_id").isNotNull()).select(*group, "text"))
    # 64 parts are a number's bits, so that tokens are counted by hash; a list of parts would have them sorted
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_part") % 64).cast("int"))
    where = tokens.groupBy("project_id", "token", F.shiftright("_part", 6).alias("_high")).agg(F.bit_or(bit).alias("_bits"))
    parts_of = F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("_bits", b) == 1), lambda b: F.col("_high") * 64 + b)
    near = where.join(entries, ["project_id", "token"]).select(F.explode(parts_of).alias("_near"), F.col("project_id").alias("_project"), "token", "entries")
    # the texts are dealt out before they are cut into words, which are longer
    dealt = parts.repartition(*group).withColumn("_words", F.when(F.col("text_id").isNotNull(), I.find_all(fold("text"), K.WORD_RUN)))

    def listed(texts, near):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words, lists = texts["_words"].combine_chunks(), near["entries"].combine_chunks()
        at = pc.index_in(words.flatten(), value_set=near["token"].combine_chunks())
        known, many = pc.is_valid(at), max(1, len(lists))
        # a word that comes twice in a text counts once
        pairs = np.unique(pc.list_parent_indices(words).filter(known).to_numpy().astype("int64") * many + at.filter(known).to_numpy())
        met = lists.take(pa.array(pairs % many))
        sizes = np.bincount(pairs // many, weights=pc.list_value_length(met).to_numpy(), minlength=len(words))
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"))
        return texts.drop_columns(["_words"]).append_column("_entries", pa.ListArray.from_arrays(ends, met.flatten(), type=lists.type))

    schema = StructType([*parts.schema.fields, StructField("_entries", entries.schema["entries"].dataType)])
    return dealt.groupBy(*group).cogroup(near.groupBy("_near", "_project")).applyInArrow(listed, schema)


def with_variants(texts: DataFrame, variants: DataFrame) -> DataFrame:
    """``texts`` (project_id, text_id, text, ...) with ``found``: ``e`` of the ``variants`` (project_id, e, variant) in them.

    Each ``e`` once, in order; it may be any column that can be sorted. Null texts have none; a null or blank
    variant is nowhere. Letters are compared in lower case. Words of the texts meet the variants that are one
    word as they are; signs around such a word are looked for in the texts that have it.
    """
    keyed = settle(variant_phrases(variants))
    key = ["at", "project_id", "text_id"]
    parts = in_parts(texts)
    listed = with_entries(parts, word_entries(keyed))
    shown = F.filter("_entries", lambda n: n["pattern"].isNull() | F.regexp_like(fold(F.col("text")), n["pattern"]))
    none = F.array().cast(f"array<{variants.schema['e'].dataType.simpleString()}>")
    found = F.coalesce(F.transform(shown, lambda n: n["e"]), none)
    for i, rows in enumerate(other_variants(parts.select("project_id", "text_id", "text"), keyed)):
        more = text_key(rows).groupBy(*key).agg(F.collect_set("e").alias(f"_more{i}"))
        listed = text_key(listed).join(more, key, "left")
        found = F.concat(found, F.coalesce(f"_more{i}", none))
    return listed.select(*texts.columns, I.each_once(F.sort_array(found)).alias("found"))


def variants_in_texts(texts: DataFrame, variants: DataFrame) -> DataFrame:
    """(project_id, text_id, e): what ``with_variants`` finds, a row each."""
    return with_variants(texts.select("project_id", "text_id", "text"), variants).select("project_id", "text_id", F.explode("found").alias("e"))
