"""Source and translation rules, term extraction and layout repair on small fixtures."""

import random

from pyspark.sql import functions as F

from lexiloom import constants as K
from lexiloom.functions import text as X
from lexiloom.operators import glossary as G
from lexiloom.operators import layout as L
from lexiloom.operators import source_qa as Q
from lexiloom.operators import terms as T
from lexiloom.operators import translation_qa as TQ

BLOCK = (
    "project_id string, id string, source_type string, source_file string, page long, source_order long, block_type string, raw_text string, "
    "corrected_text string, legibility string, status string, warnings array<string>, bbox array<double>"
)


def blocks(spark, rows):
    data = []
    for i, row in enumerate(rows, start=1):
        kind, text, extra = row[0], row[1], (row[2] if len(row) > 2 else {})
        data.append(("p", extra.get("id", f"b{i}"), "pdf", "a.pdf", i, i, kind, text, None, extra.get("legibility"), extra.get("status", "raw"), extra.get("warnings", []), None))
    return spark.createDataFrame(data, BLOCK).withColumn("source_hash", X.text_sha256("raw_text", prefix=True))


def tokens(spark, *names):
    return spark.createDataFrame([("p", n) for n in names], "project_id string, token string")


def test_clean_source_has_no_issue(spark):
    df = blocks(spark, [("body", "Take 3 {GEM} from the bag."), ("identifier", "XY-7/12-A"), ("identifier", "{Moon}")])
    assert Q.run_source_qa(df, tokens(spark, "GEM", "Moon")).count() == 0


# one block per rule, and what it gives: (block, codes)
DIRTY = [
    (("body", "Pay 1O coins."), {"OCR_ALNUM_CONFUSION"}),
    (("body", "Roll {GEMS} twice."), {"TOKEN_UNKNOWN"}),
    (("body", "See [ICON: leaf] above."), {"ICON_UNRESOLVED"}),
    (("identifier", "no id at all", {"legibility": "uncertain"}), {"IDENTIFIER_FORMAT", "OCR_UNCERTAIN"}),
    (("body", "smudge", {"warnings": ["dark scan"]}), {"SOURCE_WARNING"}),
    (("body", "half {GEM"), {"TOKEN_MALFORMED"}),
    (("body", "odd \ufffd sign"), {"UNICODE_REPLACEMENT"}),
    (("body", "then [ILLEGIBLE]"), {"OCR_ILLEGIBLE"}),
    (("identifier", "TWYN-9"), {"IDENTIFIER_DUPLICATE"}),
    (("identifier", "TWYN-9"), {"IDENTIFIER_DUPLICATE"}),
    (("body", "other bytes"), {"SOURCE_HASH_MISMATCH"}),
    (("body", "nothing wrong", {"status": "flagged"}), {"SOURCE_PRE_FLAGGED"}),
    (("body", "{GEMS} flagged", {"status": "flagged"}), {"TOKEN_UNKNOWN"}),
]


def test_each_source_rule_has_its_block(spark):
    df = blocks(spark, [b for b, _ in DIRTY])
    bad = [i for i, (_, codes) in enumerate(DIRTY, start=1) if "SOURCE_HASH_MISMATCH" in codes][0]
    df = df.withColumn("source_hash", F.when(F.col("id") == f"b{bad}", F.lit("sha256:" + "f" * 64)).otherwise(F.col("source_hash")))
    got: dict = {f"b{i}": set() for i in range(1, len(DIRTY) + 1)}
    for r in Q.run_source_qa(df, tokens(spark, "GEM")).collect():
        got[r.block_id].add(r.code)
    assert got == {f"b{i}": codes for i, (_, codes) in enumerate(DIRTY, start=1)}


def test_terms_of_a_small_source(spark):
    df = blocks(
        spark,
        [
            ("title", "Moonfen"), ("body", "A Warden guards 4 Lanterns."), ("body", "Wardens relight Lanterns at dawn near a Warden."),
            ("heading", "SILVER TIDE"), ("body", "During the Silver Tide a Warden drops Lanterns and {GEM}."),
        ],
    )
    got = {r.key: r for r in T.top_terms(T.term_candidates(df)).collect()}
    assert {"moonfen", "warden", "lantern", "silver tide"} <= set(got) and "gem" not in got
    assert got["moonfen"].category == "proper_noun" and got["warden"].occurrences >= 3
    surfaces = {r.surface for r in T.term_variants(T.term_occurrences(df), spark.createDataFrame([("p", "warden")], "project_id string, key string")).collect()}
    assert "Wardens" in surfaces


def test_evidence_of_long_terms(spark):
    df = blocks(spark, [("body", "They kept the old lamp of the quiet harbour lit."), ("body", "No such words.")])
    terms = spark.createDataFrame([("p", 1, "old lamp of the quiet harbour lit", "manual"), ("p", 2, "old lamp of a", "manual")], "project_id string, record_no long, source_term string, origin string")
    width = G.evidence_width(terms)
    got = {r.record_no: (r.occurrences, r.source_verified) for r in G.term_evidence(terms, T.term_occurrences(df, width)).collect()}
    assert width == 7 and got == {1: (1, True), 2: (0, False)}


TERMS = [
    ("p", "w", "Warden", "파수꾼", "approved", ["Warden", "Wardens"]), ("p", "g", "guard", "경계", "approved", ["guards"]),
    ("p", "t", "tide", "tide", "keep", ["tides"]), ("p", "f", "fen", "", "rejected", []), ("p", "n", "N##", "N##", "keep", []),
]
PAIRS = [
    ("Take {gem} [ICON:moon] <i>1,200</i> at 30%.", "{rock} [ICON:sun] <b>4,500</b> 20% 얻기", {"curly_token_changed", "square_token_changed", "html_tag_changed", "number_changed"}),
    ("Swap {gem} with {gem}.", "{gem} 하나를 바꾼다.", {"curly_token_changed"}),
    ("Light two lamps and wait seven days.", "등불 2개를 켜고 7일 기다린다.", set()),
    ("Open the north gate.", "북문 1개를 연다.", set()),
    ("The Warden sleeps.", "그는 잔다.", {"approved_term_missing"}),
    ("Both tides rise.", "두 tide가 오른다.", {"keep_term_changed"}),
    ("An untidetable here.", "여기에 그것이 있다.", set()),
    ("Lamp oil", "Lamp oil", {"unchanged_translation"}),
    ("tide", "tide", {"keep_rule_applied"}),
    ("Lamp oil", "oil lamp", {"target_script_missing"}),
    ("Wait 9", "", {"empty_translation"}),
    ("Read N##x.", "N## 읽기", set()),
]


def test_translation_rules(spark):
    pairs = spark.createDataFrame([("p", str(i), s, t) for i, (s, t, _) in enumerate(PAIRS)], "project_id string, block_id string, source_text string, translated_text string")
    base = spark.createDataFrame(TERMS, "project_id string, candidate_id string, source_term string, translation string, status string, variants array<string>")
    got = {str(i): set() for i in range(len(PAIRS))}
    for r in TQ.run_translation_qa(pairs, base).collect():
        got[r.block_id].add(r.code)
    assert got == {str(i): want for i, (_, _, want) in enumerate(PAIRS)}


# (fragments in page order with their native group, listed blocks, repaired blocks), worked by hand
REPAIRS = [
    ([("a", 1), ("b", 1), ("c", 2)], [["a", "b", "c"]], [["a", "b", "c"]]),
    ([("a", 1), ("b", 1), ("c", 2)], [], [["a", "b"], ["c"]]),
    ([("a", 1), ("b", 2), ("c", 3)], [["b"]], [["a"], ["b"], ["c"]]),
    ([("a", 1), ("b", 1), ("c", 1), ("d", 2)], [["d"], ["a"]], [["b", "c"], ["d"], ["a"]]),
    ([("a", 1), ("b", 1)], [["b", "b", "zz"], ["b", "a"]], [["b"], ["a"]]),
    ([("a", 1), ("b", 2), ("c", 3), ("d", 3)], [["a", "c"]], [["b"], ["a", "c"], ["d"]]),
]


def layout_tables(spark, cases):
    fragments = [("p", page, n, i + 1, n, [1.0, 1.0, 2.0, 2.0], g, [10.0, 10.0]) for page, (names, _, _) in enumerate(cases) for i, (n, g) in enumerate(names)]
    refs = [("p", page, b + 1, r + 1, n, "paragraph", True, "") for page, (_, layout, _) in enumerate(cases) for b, block in enumerate(layout) for r, n in enumerate(block)]
    f = spark.createDataFrame(fragments, "project_id string, page long, id string, pos long, text string, bbox array<double>, block_index long, page_size array<double>")
    r = spark.createDataFrame(refs, "project_id string, page long, block_pos long, ref_pos long, fragment_id string, type string, include_in_text boolean, reason string")
    return f, r


def repaired_pages(fixed):
    got: dict = {}
    for row in fixed.orderBy("page", "block_pos", "ref_pos").collect():
        got.setdefault(row.page, {}).setdefault(row.block_pos, []).append((row.fragment_id, row.recovered))
    return {p: list(b.values()) for p, b in got.items()}


def test_layout_repair_by_hand(spark):
    f, r = layout_tables(spark, REPAIRS)
    got = repaired_pages(L.recover_layout(f, r))
    assert {p: [[n for n, _ in block] for block in blocks_] for p, blocks_ in got.items()} == {i: want for i, (_, _, want) in enumerate(REPAIRS)}


def test_layout_repair_names_every_fragment_once(spark):
    rng = random.Random(29)
    cases = []
    for _ in range(60):
        names = [(f"n{i}", rng.randrange(2)) for i in range(rng.randint(1, 9))]
        cases.append((names, [[rng.choice([n for n, _ in names] + ["other"]) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(0, 3))], None))
    f, r = layout_tables(spark, cases)
    fixed = L.recover_layout(f, r)
    assert L.layout_coverage(f, fixed).filter("NOT valid").count() == 0
    for page, blocks_ in repaired_pages(fixed).items():
        order = {n: i for i, (n, _) in enumerate(cases[page][0])}
        flat = [n for block in blocks_ for n, _ in block]
        assert sorted(flat) == sorted(order)
        found = [n for block in blocks_ for n, lost in block if not lost]
        listed = list(dict.fromkeys(n for block in cases[page][1] for n in block if n in order))
        assert found == listed  # what the layout had keeps its order
        for block in blocks_:  # a lost group is whole, in page order, and not mixed with others
            assert len({lost for _, lost in block}) == 1
            if block[0][1]:
                at = [order[n] for n, _ in block]
                assert at == list(range(at[0], at[0] + len(at)))


def test_merge_continuations(spark):
    texts = [("They cross the", True, False), ("long bridge.", True, False), ("then rest", True, False), ("Then", True, False), ("or", False, False), ("not", True, True)]
    rows = [("p", 1, i + 1, "paragraph", inc, rec, [9.0, 9.0], [1.0, 1.0, 2.0, 2.0], [f"F{i}"], t, ["w"] if i == 1 else []) for i, (t, inc, rec) in enumerate(texts)]
    df = spark.createDataFrame(rows, "project_id string, page long, block_pos long, type string, include_in_text boolean, recovered boolean, page_size array<double>, bbox array<double>, fragment_ids array<string>, text string, warnings array<string>")
    got = [(r.text, r.merged) for r in L.merge_continuations(df).orderBy("block_pos").collect()]
    assert got == [("They cross the long bridge.", True), ("then rest", False), ("Then", False), ("or", False), ("not", False)]
    assert K.RECOVERY_PREFIX
