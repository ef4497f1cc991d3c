"""Phrase look-up against the pattern of a term, text by text."""

import random

from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import phrases
from lexiloom.operators import translation as T

VARIANTS = [
    "Fire Bolt", "fire", "bolt", "Fire  Bolt", "fire-bolt", "bolt of fire", "[ICON:", "(icon", "icon)", "++", "+", "a_b", "_x", "x_", "C++", "c#",
    "É", "naïve word", "d20", "20", "→", "–", "+ +", "_", "Σοφός", "ΣΟΦΟΣ", "'s", "rock 'n' roll", "...", ". .", "it's", "  spaced  ", "🔥 up", "🔥", "end.",
]
TEXTS = [
    "Fire Bolt and fire-bolt, bolt of fire", "FIRE  BOLT", "firebolt", "a [ICON:x] (icon) icons", "x++ + y", "+ + +", "C++ c# c", "a_b a_bc _x x_ x_y a_x",
    "É é naïve word naïve words", "d20 120 20", "go → on – off", "σοφος ΣΟΦΌΣ σοφός", "rock 'n' roll's it's", "wait... . . .", "spaced", "🔥 up🔥", "the end. end", "_", "", "Fire\nBolt", None,
]


def both(spark, texts, variants):
    left = spark.createDataFrame([(p, i, t) for p in ("p", "q") for i, t in enumerate(texts)], "project_id string, text_id int, text string")
    right = spark.createDataFrame([("p", v, v) for v in variants], "project_id string, variant string, e string")
    got = {(r.project_id, r.text_id, r.e) for r in phrases.variants_in_texts(left, right).collect()}
    want = left.join(right, "project_id").filter(X.contains_term(F.col("text"), F.col("variant")))
    return got, {(r.project_id, r.text_id, r.e) for r in want.collect()}


def test_found_variants_are_those_of_the_pattern(spark):
    got, want = both(spark, TEXTS, VARIANTS)
    assert got == want and len(want) > 40


def test_random_texts_and_variants(spark):
    draw = random.Random(5)
    make = lambda n: "".join(draw.choices(["a", "b", "ab", "B", " ", " ", "-", "_", "[", ".", "7", "\n"], k=n))
    got, want = both(spark, [make(draw.randrange(0, 40)) for _ in range(150)], sorted({make(draw.randrange(1, 6)) for _ in range(200)}))
    assert got == want and len(want) > 500


def test_one_first_word_of_many_variants(spark):
    variants = [f"the w{i} x{i % 7}" for i in range(20_000)]
    texts = spark.createDataFrame([("p", i, f"Now the w{i} x{i % 7} and the w{i} y, the end") for i in range(200)], "project_id string, text_id int, text string")
    index = spark.createDataFrame([("p", v, v) for v in variants], "project_id string, variant string, e string")
    runs = phrases.text_runs(texts, phrases.variant_phrases(index).select("project_id", "first", "length"))
    assert runs.count() == 200 * 2  # "the w. x." and "the w. y"; "the end" is too short
    assert phrases.variants_in_texts(texts, index).count() == 200


def test_long_phrases_cost_only_where_they_begin(spark):
    long = " ".join(f"z{i}" for i in range(60))
    texts = spark.createDataFrame([("p", i, " ".join(f"w{j}" for j in range(100)) + (" " + long if i == 3 else "")) for i in range(20)], "project_id string, text_id int, text string")
    index = spark.createDataFrame([("p", long, "long"), ("p", "w5", "short")], "project_id string, variant string, e string")
    assert phrases.text_runs(texts, phrases.variant_phrases(index).select("project_id", "first", "length")).count() == 21
    assert {(r.text_id, r.e) for r in phrases.variants_in_texts(texts, index).collect()} == {(i, "short") for i in range(20)} | {(3, "long")}


def test_hits_are_each_once_and_all_texts_stay(spark):
    base = spark.createDataFrame(
        [("p", "t1", "Fire Bolt", "X", "approved", ["fire bolts", "Fire Bolt"]), ("p", "t2", "Ice", "Ice", "keep", None), ("p", "t3", "no", "", "rejected", [])],
        "project_id string, candidate_id string, source_term string, translation string, status string, variants array<string>",
    )
    texts = spark.createDataFrame([("p", 1, "Fire Bolt, fire bolt (ICE) no", 9), ("p", 2, None, 8), ("q", 1, "ice", 7)], "project_id string, text_id int, text string, variant int")
    rows = {(r.project_id, r.text_id): [h.variant for h in r.hits] for r in T.term_hits(texts, base).collect()}
    assert rows == {("p", 1): ["Fire Bolt", "Ice"], ("p", 2): [], ("q", 1): []}
    assert {(r.text_id, r.candidate_id) for r in T.relevant_terms(texts, base).collect()} == {(1, "t1"), (1, "t2")}
