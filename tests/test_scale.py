"""The sliced operators against plain windows, and packing against a plain loop."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.operators import scale
from lexiloom.operators import translation as T


def sample(spark, n=600):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", i * rng.randrange(1, 3) + i, rng.randrange(0, 9)) for i in range(n)]
    rows = list({(g, o): (g, o, v) for g, o, v in rows}.values())
    return spark.createDataFrame(rows, "g string, o long, v long")


def test_running_total_and_numbers(spark):
    df = sample(spark)
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = {tuple(r) for r in df.select("g", "o", F.sum("v").over(w), F.row_number().over(Window.partitionBy("g").orderBy("o"))).collect()}
    got = scale.number_rows(scale.running_total(df, ["g"], "o", [], F.col("v"), "t", span=7), ["g"], "o", [], "n", span=7)
    assert {tuple(r) for r in got.select("g", "o", "t", "n").collect()} == want


def test_carry_last(spark):
    df = sample(spark)
    w = Window.partitionBy("g").orderBy("o")
    keep = F.col("v") == 4
    want = df.select(
        "g", "o", F.lag("v").over(w).alias("p"),
        F.last(F.when(keep, F.col("o")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("f"),
    )
    got = scale.carry_last(scale.previous(df, ["g"], "o", F.col("v"), "p", span=5), ["g"], "o", F.col("o"), "f", keep, True, span=5)
    assert {tuple(r) for r in got.select("g", "o", "p", "f").collect()} == {tuple(r) for r in want.collect()}


def test_top_per_group(spark):
    df = sample(spark)
    order = [F.desc("v"), F.col("o")]
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter("rank <= 4")
    got = scale.top_per_group(df, ["g"], order, 4, ["o"], fan=3)
    assert {tuple(r) for r in got.select("g", "o", "rank").collect()} == {tuple(r) for r in want.select("g", "o", "rank").collect()}


def packed(sizes, limit):
    chunk, size, out = 0, -1, []
    for s in sizes:
        if size < 0 or size + 2 + s > limit:
            chunk, size = chunk + 1, s
        else:
            size += 2 + s
        out.append(chunk)
    return out


def test_packing_matches_loop_for_any_slice_width(spark):
    rng = random.Random(5)
    groups = {"a": [rng.randrange(1, 30) for _ in range(300)], "b": [rng.choice([1, 2, 70, 51, 49]) for _ in range(120)], "c": [99]}
    rows = [(g, i + 1, "x" * s) for g, sizes in groups.items() for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "project_id string, source_order long, t string")
    want = {(g, i + 1): c for g, sizes in groups.items() for i, c in enumerate(packed(sizes, 50))}
    for span in (4, 37, 1000):
        got = T.pack_chunks(df, F.col("t"), 50, span=span)
        assert {(r.project_id, r.source_order): r.chunk_no for r in got.collect()} == want


def test_transfer_table_covers_every_entry():
    rng = random.Random(1)
    import numpy as np

    for _ in range(40):
        sizes = [rng.randrange(1, 25) for _ in range(rng.randrange(1, 30))]
        rows = T._transfer_table(np.array(sizes, dtype="int64"), 40)
        for entry in range(-1, 41):
            state = entry
            for s in sizes:
                state = s if state < 0 or state + 2 + s > 40 else state + 2 + s
            low_high = [r for r in rows if r[0] <= entry <= r[1]]
            assert len(low_high) == 1
            leave = low_high[0][2] + (entry if low_high[0][3] else 0)
            assert leave == state
