"""Values of a row that are made once, and results that must not change by it."""

import time

from pyspark.sql import functions as F

from lexiloom.functions import items as I
from lexiloom.functions import text as X
from lexiloom.llm import near_dups
from lexiloom.operators import translation_qa as TQ


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_key_are_found_once(spark):
    df = spark.createDataFrame([("Old Boxes",), ("",), ("--",), (None,), ("the Ladies’",)], "t string")
    for column in (X.term_key("t", False), X.manual_term_id(F.col("t"), False)):
        assert plan(df.select(column.alias("k"))).count("regexp_extract_all") == 1
    assert [r.k for r in df.select(X.term_key("t", False).alias("k")).collect()] == ["old box", "", "", "", "the ladies'"]
    ids = [r.k for r in df.select(X.manual_term_id(F.col("t"), False).alias("k")).collect()]
    assert ids[3] is None and len(set(ids)) == 5 and ids[0] == spark.range(1).select(F.concat(F.lit("manual-"), X.short_hash(F.lit("old box"), 12))).first()[0]


def test_strip_takes_what_the_pattern_takes(spark):
    codes = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(chr(c) + "\n x y " + chr(c),) for c in codes] + [(" \t",), ("",)], "t string")
    pattern = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
    assert df.filter(X.strip("t") != F.regexp_replace("t", pattern, "")).count() == 0


def hits(n):
    return [(f"term-{i}", f"w{i}", "", "keep", f"w{i}") for i in range(n)]


def test_many_kept_terms_are_listed_once(spark):
    kind = "hits array<struct<candidate_id:string,source_term:string,translation:string,status:string,variant:string>>, _low string"
    low = " ".join(f"w{i}" for i in range(0, 4000, 2))
    df = spark.createDataFrame([(hits(4000), low)], kind)
    start = time.time()
    lost = df.select(TQ.term_findings(F.col("_low"))[1].alias("f")).first().f
    assert time.time() - start < 20
    assert len(lost) == len({h for h in range(4000) if f"w{h}" not in low})
    assert plan(df.select(TQ.term_findings(F.col("_low"))[1].alias("f"))).count("candidate_id") <= 6


def in_turn(text, spans):
    for i, span in enumerate(spans):
        text = text.replace(f"{{KEEP_{i + 1:04d}}}", span)
    return text


def test_placeholders_are_restored_in_one_cut(spark):
    cases = [
        ("a {KEEP_0001} b {KEEP_0002}{KEEP_0001}", ["x", "y"]), ("{KEEP_0000} {KEEP_0003} {KEEP_00001} {DMGR} {KEEP_1}", ["x", "y"]),
        ("{KEEP_{KEEP_0001}} z", ["0002", "y"]), ("{KEEP_0001} {KEEP_0002}", ["{KEEP_0002}", "y"]), ("{KEEP_0001}KEEP_0002}", ["{", "y"]),
        ("none", ["x"]), ("{KEEP_0001}", []), ("", ["x"]), ("{KEEP_99999999999999999999}", ["x"]), ("{KEEP_0001}", ["{DMGR}"]),
    ]
    df = spark.createDataFrame(cases, "t string, s array<string>")
    restored = df.select("t", "s", I.restore_keep_terms(F.col("t"), F.col("s")).alias("r")).collect()
    assert [r.r for r in restored] == [in_turn(r.t, r.s) for r in restored]


def test_long_text_of_many_placeholders(spark):
    n = 40_000
    df = spark.createDataFrame([("the word " * n,)], "t string")
    pattern = I.keep_pattern(F.array(F.lit("the")))
    made = df.select("t", I.keep_spans(F.col("t"), pattern).alias("s"), I.protect_keep_terms(F.col("t"), pattern).alias("p")).localCheckpoint()
    start = time.time()
    assert made.filter(I.restore_keep_terms(F.col("p"), F.col("s")) == F.col("t")).count() == 1
    assert time.time() - start < 8


def test_near_duplicates_leave_few_shuffle_files(spark):
    def stored():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))

    body = lambda i: " ".join(f"w{(i * 7919 + k * k) % 5003}" for k in range(400))
    docs = spark.createDataFrame([(i, body(i // 2) + (" end" if i % 2 else "")) for i in range(200)], "doc_id long, text string").repartition(4).localCheckpoint()
    size = sum(len(r.text) for r in docs.collect())
    before = stored()
    assert near_dups.keep_one(docs).count() == 100
    assert stored() - before < 1.5 * size
