"""Evidence of reviewed terms, against runs of every length."""

from pyspark.sql import functions as F

from lexiloom.operators import glossary as G
from lexiloom.operators import phrases
from lexiloom.operators import terms as T

LONG = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
TEXTS = ["Fire bolt hits. Fire Bolts hit", "FIRE BOLT", "a " + LONG + "s end", "Stress test; bus stop", "the buses stop", "boss's key", ""]
TERMS = ["fire bolt", "Fire Bolts", "bolt", LONG, "stress", "bus", "Boss's Keys", "missing thing", "", "123", "hit", "hits. Fire"]


def tables(spark):
    rows = [("p", i, f"b{i}", "pdf", 1 + i // 2, "f.pdf", "body", t, None, "approved") for i, t in enumerate(TEXTS)]
    blocks = spark.createDataFrame(rows, "project_id string, source_order long, id string, source_type string, page int, source_file string, block_type string, raw_text string, corrected_text string, status string")
    terms = spark.createDataFrame([("p", i, t, "manual" if i % 2 else "auto") for i, t in enumerate(TERMS)] + [("q", 0, "fire bolt", "manual")], "project_id string, record_no int, source_term string, origin string")
    return blocks, terms


def test_known_runs_are_those_of_all_runs(spark):
    blocks, terms = tables(spark)
    keyed = terms.withColumn("key", T.X.term_key(F.col("source_term")))
    columns = ["project_id", "source_order", "segment", "start", "length", "key", "surface", "block_id", "location", "example"]
    every = T.term_occurrences(blocks, 60).join(keyed.select(*T.KEY).distinct(), T.KEY, "left_semi").select(columns)
    known = T.known_occurrences(blocks, keyed).select(columns)
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, every.collect()))
    assert known.filter("length = 60").count() == 1
    # a long term adds no runs but its own
    assert known.count() < 20 < T.term_occurrences(blocks, 60).count()


def test_evidence_lists(spark):
    blocks, terms = tables(spark)
    found = {(r.project_id, r.record_no): r for r in G.term_evidence(terms, blocks).collect()}
    assert len(found) == len(TERMS) + 1
    bolt = found["p", 0]
    assert (bolt.occurrences, bolt.blocks, bolt.block_ids, bolt.source_verified) == (3, 2, ["b0", "b1"], True)
    assert bolt.variants == ["FIRE BOLT", "Fire bolt", "Fire Bolts"] and bolt.example == TEXTS[0] and len(bolt.locations) == 1
    assert found["p", 1].variants == bolt.variants
    assert found["p", 3].occurrences == 1 and found["p", 3].block_ids == ["b2"]
    for none in (("p", 7), ("p", 8), ("p", 9), ("q", 0)):
        row = found[none]
        assert (row.occurrences, row.block_ids, row.locations, row.example, row.source_verified) == (0, [], [], "", False)
    assert found["p", 7].variants == ["missing thing"]


def test_missing_terms_may_be_manual(spark):
    blocks, terms = tables(spark)
    evidence = G.term_evidence(terms, blocks)
    strict = {(r.project_id, r.record_no) for r in G.unverified_terms(evidence).collect()}
    loose = {(r.project_id, r.record_no) for r in G.unverified_terms(evidence, allow_missing_terms=True).collect()}
    assert {("p", 7), ("p", 8), ("p", 9), ("q", 0)} <= strict
    assert loose == {key for key in strict if key == ("p", 8) or (key[0] == "p" and key[1] % 2 == 0)}


def test_candidate_occurrences_are_all_those_of_the_candidates(spark):
    rows = [("p", i, f"b{i}", "pdf", 1, "f.pdf", "body", t, None, "approved") for i, t in enumerate([*TEXTS, "a fire bolt", "fire and fire", "Lone Word"])]
    blocks = spark.createDataFrame([*rows, ("q", 0, "b0", "pdf", 1, "f.pdf", "title", "Moonfen", None, "approved")], tables(spark)[0].schema)
    every = T.term_occurrences(blocks)
    stats = T.term_stats(every)
    found = T.candidate_occurrences(every)
    assert sorted(map(tuple, T.term_stats(found).collect())) == sorted(map(tuple, stats.collect()))
    kept = ["project_id", "key", "source_order", "segment", "start", "surface"]
    wanted = every.join(stats.select(*T.KEY), T.KEY, "left_semi").select(kept)
    assert 0 < found.count() < every.count()
    assert sorted(map(tuple, found.select(kept).collect())) == sorted(map(tuple, wanted.collect()))


def test_runs_of_known_terms_carry_no_example(spark):
    blocks, terms = tables(spark)
    keyed = terms.withColumn("key", T.X.term_key(F.col("source_term")))
    assert not {"example", "location", "_low", "_one"} & set(T.known_runs(blocks, keyed).columns)


def test_marks_hold_all_rows_and_few_others(spark):
    rows = spark.range(5000).selectExpr("concat('p', id % 3) project_id", "concat('key ', id) key", "cast(id % 5 as int) n")
    every = spark.range(20_000).selectExpr("concat('p', id % 3) project_id", "concat('key ', id) key", "cast(id % 5 as int) n", "id")
    marked = phrases.marks(rows, *T.KEY, "n")
    told = {r.id for r in every.filter(marked(F.col("project_id"), F.col("key"), F.col("n"))).collect()}
    assert set(range(5000)) <= told and len(told) < 6500
    none = phrases.marks(rows.limit(0), *T.KEY)
    assert every.filter(none(F.col("project_id"), F.col("key"))).isEmpty()


def test_more_rows_than_bits_lose_no_run(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    test_known_runs_are_those_of_all_runs(spark)


def test_words_of_texts_are_not_dealt_out_for_known_terms(spark, monkeypatch):
    def dealt(*given):
        raise AssertionError("every word of every segment is shuffled")

    monkeypatch.setattr(phrases, "known_words", dealt)
    blocks, terms = tables(spark)
    blocks = blocks.unionByName(blocks.withColumn("project_id", F.lit(None).cast("string")))
    found = {(r.project_id, r.record_no): r.occurrences for r in G.term_evidence(terms, blocks).collect()}
    assert found["p", 0] == 3 and found["p", 3] == 1 and found["q", 0] == 0
