"""Clusters of integer vectors around centroids, with a pivot table that spares distances.

The distances of every vector to a few fixed pivots are measured once and stored (a LAESA table).
In each round the pivots are also measured against the centroids: by the triangle inequality, the
largest difference of two distances to one pivot is a lower bound of the distance between a vector
and a centroid. Only centroids whose bound does not exceed the best distance so far are measured,
in exact integers. A task sums its vectors by cluster, so a round moves a few rows per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import Scratch, per_batch

#: Components of a vector; a component x is the integer floor(SCALE * x).
WIDTH, SCALE = 64, 1024
#: Centroids, rounds, pivots, and the rows of least hash that pivots are chosen from.
CENTROIDS, ROUNDS, PIVOTS, POOL = 8, 10, 8, 256
#: Components are held to this size, which one reaches at 2^52, and are below SMALL in all usual tables.
LARGEST, SMALL = 2**62, 2**27
#: Rounding of a measured distance, as a share.
ROUNDING = 1e-12

LONG_MAX = np.iinfo(np.int64).max


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to the row(s) ``b``; Python integers where int64 could overflow."""
    if max((int(abs(int(v))) for x in (a, b) if x.size for v in (x.min(), x.max())), default=0) >= SMALL:
        a, b = a.astype(object), b.astype(object)
    gap = a - b
    return (gap * gap).sum(axis=-1)


def _roots(exact: np.ndarray) -> np.ndarray:
    return np.sqrt(exact.astype(np.float64))


def to_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of each vector to each pivot."""
    return np.stack([_roots(squares(vectors, p)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(vectors), 0))


def choose_pivots(pool: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Vectors of a pool that lie far apart: each next one has the largest sum of distances to those before."""
    if not len(pool):
        return pool
    chosen, far = [0], _roots(squares(pool, pool[0]))
    while len(chosen) < min(n, len(pool)):
        far[chosen] = -1.0
        chosen.append(int(np.argmax(far)))
        far = far + _roots(squares(pool, pool[chosen[-1]]))
    return pool[chosen]


def assign(vectors: np.ndarray, pivot_distances: np.ndarray, centroids: np.ndarray, centroid_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, distances measured): the nearest centroid of each vector, ties to the smaller number."""
    n = len(vectors)
    bound = np.zeros((n, len(centroids)))
    for j in range(pivot_distances.shape[1]):
        x, c = pivot_distances[:, j, None], centroid_pivots[None, :, j]
        bound = np.maximum(bound, np.abs(x - c) - ROUNDING * (x + c))
    guess = np.argmin(bound, axis=1)
    cluster, best, measured = guess.copy(), squares(vectors, centroids[guess]), n
    for c in range(len(centroids)):
        left = np.flatnonzero((guess != c) & (bound[:, c] * bound[:, c] <= best.astype(np.float64) * (1 + ROUNDING)))
        if len(left):
            measured += len(left)
            own = squares(vectors[left], centroids[c])
            nearer = (own < best[left]) | ((own == best[left]) & (c < cluster[left]))
            best = best.astype(object) if own.dtype == object else best
            best[left[nearer]], cluster[left[nearer]] = own[nearer], c
    return cluster, best, measured


# Batches ---------------------------------------------------------------------------------------


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _measured(pivots: np.ndarray):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        far = to_pivots(_rows(batch.column("v"), np.int64), pivots)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1]), pa.array(far.ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "far"])

    return per_batch(run)


def _found(batch: pa.RecordBatch, centroids: np.ndarray, centroid_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = _rows(batch.column("v"), np.int64)
    return (vectors, *assign(vectors, _rows(batch.column("far"), np.float64), centroids, centroid_pivots)[:2])


def _sums(centroids: np.ndarray, centroid_pivots: np.ndarray):
    """A task's vectors summed by cluster: one row for each cluster that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors, cluster, _ = _found(batch, centroids, centroid_pivots)
                wide = vectors.astype(object) if np.abs(vectors.astype(np.float64)).max() >= 2**40 else vectors
                for c in np.unique(cluster).tolist():
                    own = cluster == c
                    total[c] += wide[own].sum(axis=0).astype(object)
                    count[c] += int(own.sum())
        full = np.flatnonzero(count)
        if len(full):
            kind = pa.decimal128(38, 0)
            sums = [pa.array([Decimal(int(total[c][i])) for c in full], kind) for i in range(centroids.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(count[full]), *sums], names=["cluster", "n", *[f"s{i}" for i in range(len(sums))]])

    return run


def _assigned(centroids: np.ndarray, centroid_pivots: np.ndarray):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, cluster, best = _found(batch, centroids, centroid_pivots)
        held = np.minimum(best, LONG_MAX).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(held)], names=["vec_id", "cluster", "distance"])

    return per_batch(run)


# The operator ----------------------------------------------------------------------------------


def usable(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of ``width`` finite components, as integers."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.size("x") == width)
    rows = rows.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    held = lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c * scale))).cast("long")
    return rows.select("vec_id", F.transform("x", held).alias("v"))


def centroid_sha256(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def clusters(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that is kept.

    ``vectors`` has vec_id and embedding; other columns are not read. Kept are vectors of ``width``
    components, none null or non-finite. Centroids start as the ``k`` kept vectors of least sha256 of
    "seed:vec_id"; equal hashes go by the vector, and a vector without an id starts none as long as
    others do. With fewer vectors than ``k`` there are as many centroids. Rows that repeat are each
    assigned and summed. Distances and inertias beyond a long are given as the largest long. An empty
    table, or one without such vectors, gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "clusters")
    kept = usable(vectors, width, scale)
    by_hash = lambda salt: [F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("v")]
    first = lambda salt, n: np.array([r["v"] for r in kept.orderBy(*by_hash(salt)).limit(n).collect()], np.int64).reshape(-1, width)
    centroids = first(seed, k)
    pivots = choose_pivots(first("pivot", POOL))
    stored = scratch.save(kept.mapInArrow(_measured(pivots), "vec_id long, v array<long>, far array<double>"))
    sums = "cluster int, n long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(width))
    for _ in range(rounds if len(centroids) else 0):
        parts = stored.select("v", "far").mapInArrow(_sums(centroids, to_pivots(centroids, pivots)), sums)
        # one row per cluster reaches the driver
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).collect():
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    placed = scratch.save(stored.mapInArrow(_assigned(centroids, to_pivots(centroids, pivots)), "vec_id long, cluster int, distance long"))
    least = lambda c: F.least(c, F.lit(Decimal(int(LONG_MAX)))).cast("long")
    total = {r["cluster"]: r["t"] for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("t")).collect()}
    # a row per centroid, at most ``k``
    rows = [(c, Decimal(int(t)), Decimal(int(sum(total.values()))), centroid_sha256(centroids[c])) for c, t in total.items()]
    named = vectors.sparkSession.createDataFrame(rows, "cluster int, a decimal(38,0), b decimal(38,0), centroid_sha256 string")
    named = named.select("cluster", least(F.col("a")).alias("cluster_inertia"), least(F.col("b")).alias("inertia"), "centroid_sha256")
    return placed.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The same rounds in DuckDB, each a query of its own."""
    best = "SELECT v.vec_id, v.v, c.cluster, list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept v, c{i} c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY d, c.cluster) = 1"
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM kept ORDER BY sha256('3:' || vec_id) LIMIT {CENTROIDS})",
    ]
    for i in range(ROUNDS):
        parts.append(f"a{i} AS MATERIALIZED ({best.format(i=i)})")
        parts.append(
            f"m{i} AS MATERIALIZED (SELECT cluster, list(m ORDER BY j) AS c FROM (SELECT cluster, j, CAST(floor(sum(v[j])::DOUBLE / count(*)) AS BIGINT) AS near,"
            f" CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n, CASE WHEN near * n > s THEN near - 1 WHEN (near + 1) * n <= s THEN near + 1 ELSE near END AS m"
            f" FROM a{i}, unnest(range(1, {WIDTH + 1})) AS u(j) GROUP BY cluster, j) GROUP BY cluster)"
        )
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m USING (cluster))")
    return (
        "WITH " + ", ".join(parts) + f", last AS MATERIALIZED ({best.format(i=ROUNDS)})"
        " SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM last JOIN c{ROUNDS} c USING (cluster)"
    )


ORACLE = _oracle()
