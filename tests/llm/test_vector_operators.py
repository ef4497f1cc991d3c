"""Hard negatives and centroid clusters against plain loops, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import hard_negatives, pivot_clusters

# columns named as the operators name their own
SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, rank int, cluster int, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 7, 7, "y") for i, v, label in rows], SCHEMA).repartition(3)


def vectors(n, width, seed, labels=3):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.05, 0.3) for _ in range(width)], rng.randrange(labels)) for i in range(n)]
    rows[3] = (3, rows[1][1], rows[1][2])  # equal vectors tie
    return rows


def odd(width):
    return [
        (None, [0.1] * width, 1), (900, None, 1), (901, [0.1] * width, None), (902, [math.nan] * width, 1), (903, [math.inf] + [0.1] * (width - 1), 2),
        (904, [None] + [0.1] * (width - 1), 1), (910, [], 1),
    ]


# products and heaps -----------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (37, 17, 65), (128, 64, 100), (0, 4, 3)])
def test_products_are_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(m + n)
    for high in (2**9, 2**31, 2**62):
        a, b = rng.integers(-high, high, (m, k)), rng.integers(-high, high, (k, n))
        assert (hard_negatives.product(a, b, 4) == a.astype(object) @ b.astype(object)).all()


def test_heaps_merge_like_a_sort():
    rng = np.random.default_rng(4)
    scores, heaps = rng.integers(0, 9, (5, 300)), hard_negatives.Heaps(5, 6)
    for at in np.array_split(rng.permutation(300), 7):
        heaps.push(scores[:, at] % 3 > 0, scores[:, at], at)
    got = {r: [] for r in range(5)}
    for r, s, i in zip(heaps.rows.tolist(), heaps.scores.tolist(), heaps.ids.tolist(), strict=True):
        got[r].append((s, i))
    assert got == {r: sorted(((s, i) for i, s in enumerate(scores[r].tolist()) if s % 3), key=lambda x: (-x[0], x[1]))[:6] for r in range(5)}


# hard negatives ---------------------------------------------------------------------------------


def brute_negatives(rows, step, scale=256, positives=5, negatives=10):
    good = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i, tuple(math.floor(scale * float(np.float32(x))) for x in v), label] = None
    out = []
    for i, v, label in good:
        if i % step:
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, w, other in good if j != i), key=lambda x: (-x[0], x[1]))
        for p, j in [(s, j) for s, j, other in scored if other == label][:positives]:
            near = [(s, k) for s, k, other in scored if other != label and 30 * p <= 100 * s <= 90 * p][:negatives]
            out += [(i, j, r, k, p, s) for r, (s, k) in enumerate(near, 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in hard_negatives.mine(df, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives_equal_brute_force(spark):
    rows = vectors(160, 9, 1) + odd(9) + [(911, [0.4, 0.4], 1)]
    rows += [rows[20], rows[20]]  # repeats count once
    expected = brute_negatives(rows, 10)
    assert mined(table(spark, rows), step=10) == expected and len({x[0] for x in expected}) > 10
    assert mined(table(spark, rows), step=10, block=16) == expected  # many pairs of blocks


def test_negatives_of_large_components_and_moved_labels(spark):
    rows = [(0, [3e12, 1.0], 0), (1, [1e12, 5.0], 0), (2, [1e12, 7.0], 1), (3, [1e38, 0.0], 1), (4, [0.5, 0.5], 0), (7, [1.5e12, 0.0], 0)]
    moved = F.when(F.col("vec_id") % 7 == 0, F.col("label") + 1).otherwise(F.col("label"))
    found = mined(table(spark, rows), step=7, shift=moved)
    top = 2**63 - 1  # scores beyond a long; the window is judged before they are held to one
    assert (0, 7, 1, 1, top, top) in found


def test_negatives_of_nothing(spark):
    assert mined(table(spark, [])) == [] and mined(table(spark, odd(4))) == []
    assert mined(table(spark, [(0, [1.0], 1), (1, [1.0], 1)])) == []  # no row of another label


# clusters ---------------------------------------------------------------------------------------


def brute_clusters(rows, width, k, rounds, scale=1024):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"3:{x[0]}".encode()).hexdigest(), x[1]))
    centroids = [v for _, v in start[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, centroids, strict=True)]
    placed = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, d, c in placed if c == j) for j in range(len(centroids))]
    top = 2**63 - 1
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, min(d, top), min(inertia[c], top), min(sum(inertia), top), name[c]) for i, d, c in placed), key=str)


def clustered(df, **options):
    return sorted((tuple(r) for r in pivot_clusters.clusters(df, **options).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_clusters_equal_brute_force(spark):
    rows = vectors(150, 6, 2) + odd(6) + [(5, [0.25] * 6, 1), (5, [0.25] * 6, 1), (912, [0.1] * 7, 1)]
    assert clustered(table(spark, rows), width=6, k=5, rounds=4) == brute_clusters(rows, 6, 5, 4)


def test_few_equal_and_no_vectors(spark):
    rows = [(i, [0.5, -0.25], 0) for i in range(7)]
    assert clustered(table(spark, rows), width=2, rounds=2) == brute_clusters(rows, 2, 8, 2)
    assert clustered(table(spark, rows[:3]), width=2, rounds=2) == brute_clusters(rows[:3], 2, 8, 2)
    assert clustered(table(spark, [])) == [] and clustered(table(spark, odd(64)[3:]), rounds=1) == []


def test_large_components_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1e9, -3e12, 4e14]) * rng.random(), rng.random()], 0) for i in range(12)]
    assert clustered(table(spark, rows), width=2, k=3, rounds=2) == brute_clusters(rows, 2, 3, 2)


def test_bounds_spare_distances_and_lose_none():
    rng = np.random.default_rng(8)
    centres = rng.integers(-9000, 9000, (8, 64))
    data = centres[rng.integers(0, 8, 500)] + rng.integers(-300, 300, (500, 64))
    pivots = pivot_clusters.choose_pivots(data[:100], 6)
    cluster, best, measured = pivot_clusters.assign(data, pivot_clusters.to_pivots(data, pivots), centres, pivot_clusters.to_pivots(centres, pivots))
    exact = ((data[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert measured < 0.3 * exact.size
