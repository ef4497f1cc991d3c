"""Nearest neighbours by largest inner product, found by counting collisions on random lines.

Every index vector is projected on ``LINES`` random lines; each line keeps its projections sorted. A
query opens a window around its own projection on every line; a vector in enough of the windows is a
candidate and its inner product is computed. Windows widen by virtual rehashing, in steps of
``GROWTH``, reusing the sorted arrays, until the k-th best verified vector is nearer than the radius
that the windows stand for; the last step covers everything, so small blocks are searched whole.

Inner products become distances by one more component that gives all vectors the length of the
longest one; queries are stretched to that length with a zero there.

The index is cut into blocks of bounded size and queries into blocks too; each pair of blocks is one
task's work, and the best of all blocks are merged per query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
#: Lines, half window in units of the radius, share of the lines that makes a candidate.
LINES, HALF, SHARE = 16, 1.0, 0.66
#: First radius in units of the longest vector, and its growth.
FIRST, GROWTH = 0.5, 1.3
#: Index vectors and queries in a block.
INDEX_BLOCK, QUERY_BLOCK = 16384, 1024


class Block:
    """Sorted projections of the vectors of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        self.ids, self.vectors, self.longest = ids, vectors, longest
        rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0.0))
        self._lines = np.random.default_rng(7).standard_normal((vectors.shape[1] + 1, LINES))
        projected = np.hstack([vectors, rest[:, None]]) @ self._lines
        self._order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32).copy()
        self._sorted = np.sort(projected, axis=0).T.copy()

    def windows(self, queries: np.ndarray) -> tuple[list[float], np.ndarray, np.ndarray]:
        """Radii, and for each the window bounds of every query on every line (radius, query, line)."""
        scale = self.longest / np.sqrt((queries**2).sum(axis=1))
        at = (queries * scale[:, None]) @ self._lines[:-1]
        radii = [self.longest * FIRST * GROWTH**i for i in range(1 + math.ceil(math.log(2 / FIRST) / math.log(GROWTH)))]
        low, high = (np.zeros((len(radii) + 1, len(queries), LINES), np.int32) for _ in range(2))
        for j in range(LINES):
            for i, r in enumerate(radii):
                low[i, :, j] = np.searchsorted(self._sorted[j], at[:, j] - HALF * r, "left")
                high[i, :, j] = np.searchsorted(self._sorted[j], at[:, j] + HALF * r, "right")
        high[-1] = len(self.ids)
        return [*radii, math.inf], low, high

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score) of the best ``k`` found for each query in this block."""
        radii, low, high = self.windows(queries)
        need, n = math.ceil(SHARE * LINES), len(self.ids)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q, (name, query) in enumerate(zip(query_ids, queries, strict=True)):
            hits = np.zeros(n, np.int32)
            scores = np.full(n, -np.inf)
            waiting = self.ids != name
            stretched = 2 * self.longest / math.sqrt(float(query @ query))
            before = (low[0, q] * 0, low[0, q] * 0)
            for level, radius in enumerate(radii):
                a, b = low[level, q], high[level, q]
                if level:
                    pieces = [self._order[j, x:y] for j in range(LINES) for x, y in ((a[j], before[0][j]), (before[1][j], b[j])) if y > x]
                else:
                    pieces = [self._order[j, a[j] : b[j]] for j in range(LINES)]
                if pieces:
                    hits += np.bincount(np.concatenate(pieces), minlength=n).astype(np.int32)
                before = (a, b)
                met = np.flatnonzero(waiting & (hits >= need))
                scores[met] = self.vectors[met] @ query
                waiting[met] = False
                found = np.flatnonzero(scores > -np.inf)
                if len(found) >= k:
                    worst = np.partition(scores[found], len(found) - k)[len(found) - k]
                    if 2 * self.longest**2 - stretched * worst <= radius**2:
                        break
            best = found[np.lexsort((self.ids[found], -scores[found]))[:k]]
            out.append((np.full(len(best), name), self.ids[best], scores[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _search(index: pa.Table, queries: pa.Table, longest: float, k: int) -> pa.Table:
    names = ["query_id", "vec_id", "score"]
    if not index.num_rows or not queries.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
    dense = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
    block = Block(index.column("vec_id").to_numpy(), dense(index), longest)
    return pa.table(list(block.search(queries.column("vec_id").to_numpy(), dense(queries), k)), names=names)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): distinct vectors of the table's usual size that are finite and not zero."""
    v = F.col("embedding").cast("array<double>")
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = plain.filter(finite)
    usual = good.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return good.filter(F.size("v") == (usual["size"] if usual else 0)).distinct()


def nearest(vectors: DataFrame, step: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best found for each vector whose id ``step`` divides.

    ``vectors`` has vec_id and embedding. Candidates are all rows but those of the query's own id;
    score is the inner product in double precision of the vectors as they are; ties go to the smaller
    vec_id. Null, zero and non-finite vectors, vectors with null components, null ids and vectors of
    another size than most take no part. Rows that repeat count once; an id with several vectors
    stands for each of them, as a query for the one with the best scores. With fewer candidates than
    ``k`` all are returned; an empty table gives no rows.
    """
    good = usable(vectors)
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    size = good.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % step == 0, 1)).alias("q"), F.max(squares).alias("longest")).first()
    blocks, askers = max(1, -(-size["n"] // INDEX_BLOCK)), max(1, -(-size["q"] // QUERY_BLOCK))
    longest = math.sqrt(size["longest"] or 1.0) * (1 + 1e-12)
    part = lambda salt, n: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = good.select("vec_id", "v", part("index", blocks).alias("block"), every(askers).alias("asker"))
    queries = good.filter(F.col("vec_id") % step == 0).select("vec_id", "v", part("query", askers).alias("asker"), every(blocks).alias("block"))
    found = index.groupBy("block", "asker").cogroup(queries.groupBy("block", "asker")).applyInArrow(lambda a, b: _search(a, b, longest, k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
