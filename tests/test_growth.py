"""Steps that must not do more than their rows ask for, as tables grow."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import items as I
from lexiloom.operators import phrases
from lexiloom.operators import translation_qa as TQ


def test_signs_are_looked_up_only_for_variants_of_signs(spark, monkeypatch):
    texts = spark.createDataFrame([("p", "1", "The [ICON: star] shines"), ("p", "2", "{x} ++")], "project_id string, text_id string, text string")
    words = spark.createDataFrame([("p", 1, "star"), ("p", 2, "[ICON:"), ("p", 3, "the [icon")], "project_id string, e int, variant string")
    signs = words.unionByName(spark.createDataFrame([("p", 4, "++")], words.schema))
    found = lambda variants: {(r.text_id, r.e) for r in phrases.variants_in_texts(texts, variants).collect()}
    assert found(signs) == {("1", 1), ("1", 2), ("1", 3), ("2", 4)}

    def grams(texts):
        raise AssertionError("no variant needs the signs of the texts")

    monkeypatch.setattr(phrases, "text_grams", grams)
    assert found(words) == {("1", 1), ("1", 2), ("1", 3)}


@pytest.mark.parametrize("code", list(TQ.PRESERVED))
def test_items_are_those_of_the_pattern(spark, code):
    rows = [(1, "{A} {B} {A}", "[x] 1,5"), (2, "plain", ""), (3, None, "<b>"), (4, "<b>7</b> [ICON: a]", None)]
    pairs = spark.createDataFrame(rows, "n int, text string, target string")
    for side in ("text", "target"):
        same = TQ.with_items(pairs).select((F.col(f"_{code}_{side}")).eqNullSafe(I.find_all(F.col(side), TQ.PRESERVED[code])).alias("same"))
        assert all(r.same for r in same.collect())


def test_kept_latin_is_judged_by_all_words(spark):
    rows = [
        (1, "Alpha beta", ["alpha", "beta"], True), (2, "Alpha beta", ["alpha"], False), (3, "Alpha beta", ["beta"], False), (4, "12 34", ["34"], True),
        (5, "12 34", ["alpha"], False), (6, "Alpha [beta]", ["alpha", "[beta]"], True), (7, "gamma [beta]", ["[beta]"], False), (8, "[beta] gamma", ["[beta]"], False), (9, None, ["alpha"], False),
    ]
    df = spark.createDataFrame(rows, "n int, text string, variants array<string>, kept boolean")
    got = df.select("n", "kept", I.latin_fully_kept(F.col("text"), F.col("variants")).alias("got")).collect()
    assert [(r.n, r.got) for r in got] == [(r.n, r.kept) for r in got]


def _stored_texts(spark, monkeypatch, run):
    """The tables that ``run`` stores with all lines or texts (``behind``: only lines between blocks)."""
    from lexiloom.operators import rendering as R

    stored, settle = [], R.settle

    def watch(df):
        stored.append(df.columns)
        return settle(df)

    monkeypatch.setattr(R, "settle", watch)
    run(R)
    return [c for c in stored if {"line", "source_text", "part"} & set(c) and "behind" not in c]


def test_a_review_is_read_with_its_text_stored_once(spark, monkeypatch):
    lines = [("p", i + 1, x) for i, x in enumerate(["[[REVIEW version=2]]", "[SOURCE a.png]", "[BLOCK b1]", "one", "", "two", "[[END b1]]", "", "[SOURCE a.png]", "[BLOCK b2]", "three", "[[END b2]]"])]
    lines = spark.createDataFrame(lines, "project_id string, line_no long, line string")
    blocks = spark.createDataFrame([("p", i, f"b{i}", "image", None, "a.png") for i in (1, 2)], "project_id string, source_order long, id string, source_type string, page long, source_file string")
    got = {}
    stored = _stored_texts(spark, monkeypatch, lambda R: got.update({r.block_id: r.text for r in R.parse_source_review(lines, blocks, span=4)[0].collect()}))
    assert got == {"b1": "one\n\ntwo", "b2": "three"} and len(stored) == 1


def test_a_translation_review_tells_changed_sources_by_digest(spark, monkeypatch):
    text = ["[[TRANSLATION_REVIEW version=1]]", "[SOURCE a.png]"]
    for i, source in ((1, ["a", "b"]), (2, ["c"]), (3, ["d"])):
        text += [f"[BLOCK b{i}]", "[ORIGINAL]", *source, "[TRANSLATION]", *([f"new {i}"] if i < 3 else []), f"[[END b{i}]]"]
    lines = spark.createDataFrame([("p", i + 1, x) for i, x in enumerate(text)], "project_id string, line_no long, line string")
    segments = spark.createDataFrame([("p", 1, "b1", None, "a.png", "a\nb"), ("p", 2, "b2", None, "a.png", "other"), ("p", 3, "b3", None, "a.png", "d")], "project_id string, source_order long, source_block_id string, page long, source_file string, source_text string")
    got = []

    def run(R):
        texts, problems = R.parse_translation_review(lines, segments, span=4)
        got.extend([{r.block_id: r.text for r in texts.collect()}, [(r.block_id, r.code) for r in problems.collect()]])

    stored = _stored_texts(spark, monkeypatch, run)
    assert got == [{"b1": "new 1", "b3": ""}, [("b2", "source_changed")]] and len(stored) == 1


def test_parts_are_numbered_by_their_lines(spark):
    from lexiloom.catalog.reviews import numbered_lines

    parts = spark.createDataFrame([("p", 0, "head\n"), ("p", 1, "a\nb\n"), ("p", 5000, ""), ("p", 5001, "c"), ("q", 3, "x")], "project_id string, source_order long, part string")
    got = sorted((r.project_id, r.line_no, r.line) for r in numbered_lines(parts).collect())
    assert got == [("p", 1, "head"), ("p", 2, ""), ("p", 3, "a"), ("p", 4, "b"), ("p", 5, ""), ("p", 6, ""), ("p", 7, "c"), ("q", 1, "x")]


def test_a_generator_gets_even_tasks(spark):
    from lexiloom.session import finer

    one = spark.range(0, 100, 1, 1)
    assert finer(one, 200) is one
    cut = finer(one, 10)
    assert cut.rdd.getNumPartitions() == 10 and cut.count() == 100


def test_a_replayed_stream_has_files_for_every_core(spark, monkeypatch, tmp_path):
    from lexiloom.catalog import files

    monkeypatch.setattr(files, "fresh", lambda s, name: str(tmp_path / name))
    stream = files._stream(spark, spark.range(1000))
    assert stream.isStreaming and len(list((tmp_path / "stream-in").glob("part-*"))) == 2 * spark.sparkContext.defaultParallelism


def _base(spark, rows):
    return spark.createDataFrame(rows, "project_id string, candidate_id string, source_term string, translation string, status string, variants array<string>")


def _qa(spark, pairs, base):
    pairs = spark.createDataFrame(pairs, "project_id string, block_id string, source_text string, translated_text string")
    return sorted((r.block_id, r.code, r.detail or "") for r in TQ.run_translation_qa(pairs, base).collect())


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    cuts, tokens = [], phrases.text_tokens

    def watch(texts):
        cuts.append(texts)
        return tokens(texts)

    monkeypatch.setattr(phrases, "text_tokens", watch)
    texts = spark.createDataFrame([("p", "1", "The [ICON: star] shines (icon)"), ("p", "2", "icon: (icons"), ("p", "2", "icon: (icons"), ("q", "1", "[icon:"), (None, "3", "icon"), ("p", None, "icon")], "project_id string, text_id string, text string")
    words = [("p", 1, "star"), ("p", 2, "[ICON:"), ("p", 3, "(icon"), ("p", 4, "Icon"), ("p", 4, "icon"), ("p", 5, "STAR]"), ("p", 6, "<star")]
    found = phrases.variants_in_texts(texts, spark.createDataFrame(words, "project_id string, e int, variant string"))
    assert sorted((r.text_id, r.e) for r in found.collect()) == [("1", 1), ("1", 2), ("1", 3), ("1", 4), ("1", 5), ("2", 4), ("2", 4)] and len(cuts) == 1


def test_blocks_that_come_twice_are_checked(spark):
    base = _base(spark, [("p", "t1", "Icon", "아이콘", "approved", ["[icon:"]), ("p", "t2", "icon", "", "keep", ["(icon"])])
    same = ("p", "b", "an (icon of [icon: x]", "그림 [icon: x]")
    once, twice = _qa(spark, [same], base), _qa(spark, [same, same], base)
    assert twice == sorted(once * 2) and ("b", "approved_term_missing", "Icon") in once


def test_hits_of_an_approved_term_are_one(spark):
    base = _base(spark, [("p", "t1", "Fire", " 불 ", "approved", ["fire", "fires", "fire bolt"]), ("p", "t2", "ice", None, "approved", []), ("p", "t3", "Bolt", "", "keep", ["bolts"])])
    hits = TQ.index_hits(spark.createDataFrame([("p", "b", "Fire, fires and a fire bolt; ice")], "project_id string, text_id string, text string"), TQ.qa_index(base)).first().hits
    assert [(h.candidate_id, h.expected, h.variant) for h in hits] == [("t1", "불", None), ("t2", None, None), ("t3", "bolt", "Bolt")]
    pairs = [("p", "1", "Fire, fires, fire bolt; ice", "화염 BOLT"), ("p", "2", "fires", "불들"), ("p", "3", "bolts", "화살")]
    assert _qa(spark, pairs, base) == [("1", "approved_term_missing", "Fire"), ("3", "keep_term_changed", "Bolt")]


def test_kept_texts_are_told_early_as_by_the_whole_rule(spark):
    words = ["alpha", "beta", "[gamma]", "(delta", "-", "a_b", "x_", "ſun", "the cat", "12", "ΣΟΦΟΣ"]
    base = _base(spark, [("p", f"t{i}", w, "", "keep", [w.upper()]) for i, w in enumerate(words)])
    texts = ["Alpha beta", "alpha other", "other alpha", "[gamma] beta", "gamma", "al-pha", "alpha-beta", "a_b alpha", "x_y", "x_ alpha", "Sun", "the cat", "cat the", "12 alpha", "12", "σοφος alpha", "(delta) alpha", "(deltas", ""]
    given = spark.createDataFrame([("p", str(i), t) for i, t in enumerate(texts)], "project_id string, text_id string, text string")
    hit = TQ.index_hits(given, TQ.qa_index(base))
    kept = I.latin_fully_kept(F.col("text"), F.transform("hits", lambda h: h["variant"]))
    rows = hit.filter(F.col("text").rlike("[A-Za-z]")).select("text", TQ.may_be_kept(F.col("text"), F.col("hits")).alias("may"), kept.alias("kept")).collect()
    assert sum(r.kept for r in rows) > 6 and all(r.may for r in rows if r.kept)
    assert {r.text for r in rows if not r.may and not r.kept} >= {"alpha other", "other alpha", "gamma", "cat the"}


def test_entries_reach_a_part_once_however_many_texts_have_the_word(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PART_BITS", 5)
    texts = spark.range(0, 1000, 1, 3).selectExpr("concat('p', id % 2) project_id", "id text_id", "concat('Fire and ice ', id % 10, if(id % 100 = 7, ' lone', '')) text", "id * 2 other")
    variants = spark.createDataFrame([("p0", 1, "fire"), ("p0", 2, "(ice"), ("p0", 3, "3"), ("p1", 4, "ICE"), ("p1", 5, "3"), ("p1", 6, "lone"), ("p1", 7, "7 lone")], "project_id string, e int, variant string")
    parts = phrases.in_parts(texts)
    sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 32 and len(sizes) >= 32
    dealt, with_entries = [], phrases.with_entries

    def watch(parts, entries):
        dealt.append(entries)
        return with_entries(parts, entries)

    monkeypatch.setattr(phrases, "with_entries", watch)
    rows = phrases.with_variants(texts, variants).collect()
    want = lambda i: ([4] + [5] * (i % 10 == 3) + [6] * (i % 100 == 7) + [7] * (i % 100 == 7) if i % 2 else [1])
    assert {r.text_id: (r.found, r.other) for r in rows} == {i: (want(i), 2 * i) for i in range(1000)} and len(rows) == 1000
    assert [r.token for r in dealt[0].filter("project_id = 'p1'").orderBy("token").collect()] == ["3", "ice", "lone"]
