import re
import time

from pyspark.sql import functions as F

from lexiloom.functions import items as I
from lexiloom.functions import text as X
from lexiloom.operators.blocks import parse_pages
import pytest


def values(spark, rows, *columns, names=("a", "b")):
    df = spark.createDataFrame(rows, [*names[: len(rows[0])]])
    return [tuple(r) if len(r) > 1 else r[0] for r in df.select(*columns).collect()]


def test_singular_and_key(spark):
    words = [("Cards",), ("Abilities",), ("boxes",), ("Class",), ("status",), ("axis",), ("gas",), ("ies",)]
    assert values(spark, words, X.singularize(F.col("a"))) == ["card", "ability", "box", "class", "status", "axis", "gas", "ies"]
    assert values(spark, [("Ｈunters’ Cards",), ("12 %",)], X.term_key("a")) == ["hunters' card", ""]


def test_natural_key_orders_numbers_first(spark):
    names = [("page 10.png",), ("page 9.png",), ("page.png",), ("2.png",)]
    df = spark.createDataFrame(names, ["a"]).orderBy(X.natural_key("a"))
    assert [r[0] for r in df.collect()] == ["2.png", "page 9.png", "page 10.png", "page.png"]


def test_term_boundaries(spark):
    pairs = [
        ("a player acts", "player", True), ("éplayer", "player", False), ("multiplayer", "player", False), ("C++ code", "C++", True),
        ("xC++", "C++", False), ("C++x", "C++", True), ("PLAYER_2", "player", False), ("(Icon", "(icon", True), ("a\\Eb", "a\\Eb", True),
    ]
    df = spark.createDataFrame(pairs, ["t", "v", "want"])
    assert all(r[0] == r[1] for r in df.select(X.contains_term(F.col("t"), F.col("v")), "want").collect())


def test_join_fragments(spark):
    df = spark.createDataFrame([(["multi-", "player", "", "  rule   text  "],), (["Cost /", "value"],), ([" ", ""],)], ["p"])
    rows = [r[0] for r in df.select(I.join_fragments(F.col("p"))).collect()]
    assert [r["text"] for r in rows] == ["multiplayer rule text", "Cost /value", ""]
    assert [len(r["warnings"]) for r in rows] == [1, 0, 0]


def test_keep_terms_round_trip(spark):
    texts = [("Hunter and Hunters, hunter's Dark Hunter. {X}",), ("none here",), ("",)]
    pattern = I.keep_pattern(F.array(F.lit("Hunter"), F.lit("Hunters"), F.lit("Dark Hunter")))
    text = F.col("a")
    protected = I.protect_keep_terms(text, pattern)
    back = I.restore_keep_terms(protected, I.keep_spans(text, pattern))
    got = values(spark, texts, protected, back)
    assert [g[1] for g in got] == [t[0] for t in texts]
    assert got[0][0] == "{KEEP_0001} and {KEEP_0002}, {KEEP_0003}'s {KEEP_0004}. {X}"


def test_compatibility_form(spark):
    assert values(spark, [("ﬁＡ①",), ("plain",), (None,)], X.nfkc("a")) == ["fiA1", "plain", None]
    assert values(spark, [("  Straße  Ａ ",)], X.normalized_term("a")) == ["strasse a"]
    assert values(spark, [("My  Gäme!",), ("con",), ("!!",)], X.normalize_project_id("a")) == ["my_g_me", None, None]


def test_page_ranges():
    assert parse_pages("1, 3-5", 9) == [(1, 1), (3, 5)]
    assert parse_pages(None, 4) == [(1, 4)]
    for bad in ("0", "5-3", "2-10", ","):
        with pytest.raises(ValueError):
            parse_pages(bad, 9)


def cut_one_by_one(text, variants):
    """Keep variants removed longest first, by plain regular expressions."""
    rest, hit = text, False
    for v in sorted({v.strip() for v in variants} - {""}, key=lambda v: (-len(v), v)):
        left = r"(?<![^\W])" if v[0].isalnum() else ""
        right = r"(?![^\W])" if v[-1].isalnum() else ""
        found = re.compile(left + re.escape(v) + right, re.I)
        rest, hit = found.sub("", rest), hit or bool(found.search(rest))
    return hit and not re.search("[A-Za-z]", rest)


def test_latin_kept_by_sets_is_latin_kept_by_cutting(spark):
    texts = ["The tide", "tide, the TIDE 12", "the lamp", "12", "", "don't the", "[ICON: the]", "fo##o the", "a_the", "the_", "é the", "C++ the"]
    lists = [["the"], ["The", "tide", "tides"], ["don't", "the", "t"], ["[ICON:", "the"], ["##", "the", "foo"], ["the_"], ["C++", "the"], [" ", "12"], []]
    rows = [(t, v) for t in texts for v in lists]
    got = values(spark, rows, I.latin_fully_kept(F.col("a"), F.col("b")))
    assert [g for (t, v), g in zip(rows, got, strict=True) if g != cut_one_by_one(t, v)] == []
    assert sum(got) > 8


def test_long_texts_are_not_cut_term_by_term(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(6000)]
    start = time.monotonic()
    assert values(spark, [(" ".join(words), words)], I.latin_fully_kept(F.col("a"), F.col("b"))) == [True]
    assert time.monotonic() - start < 5
