"""Hard negatives of anchors: exact integer inner products by Strassen's multiplication, best rows by mergeable heaps.

Anchors and candidates are cut into blocks of bounded size. Every pair of an anchor block and a
candidate block is one task's group: it multiplies tiles of both blocks and keeps, for each anchor,
a heap of its best rows. Heaps of all blocks merge per anchor. Two passes are made: the first finds
the positives, the second the negatives inside the window of scores that each positive opens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import Scratch

#: A component x is the integer floor(SCALE * x).
SCALE = 256
#: Positives of an anchor, negatives of a positive, and the window of negatives in percent of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows of a block and of a tile, and the edge of a product that is no longer halved.
BLOCK, TILE, LEAF = 4096, 512, 16
#: Integers are held to this size, which a component reaches at 2^48.
LARGEST = 2**56
#: Bits of a score's lower part. Between tasks a score is two longs, high * 2^PART + low, so that none is too large.
PART = 60

LONGS = np.iinfo(np.int64)


# Products --------------------------------------------------------------------------------------


def _strassen(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf or m % 2 or k % 2 or n % 2:
        return a @ b
    a11, a12, a21, a22 = a[: m // 2, : k // 2], a[: m // 2, k // 2 :], a[m // 2 :, : k // 2], a[m // 2 :, k // 2 :]
    b11, b12, b21, b22 = b[: k // 2, : n // 2], b[: k // 2, n // 2 :], b[k // 2 :, : n // 2], b[k // 2 :, n // 2 :]
    m1 = _strassen(a11 + a22, b11 + b22, leaf)
    m2 = _strassen(a21 + a22, b11, leaf)
    m3 = _strassen(a11, b12 - b22, leaf)
    m4 = _strassen(a22, b21 - b11, leaf)
    m5 = _strassen(a11 + a12, b22, leaf)
    m6 = _strassen(a21 - a11, b11 + b12, leaf)
    m7 = _strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((m, n), a.dtype)
    out[: m // 2, : n // 2] = m1 + m4 - m5 + m7
    out[: m // 2, n // 2 :] = m3 + m5
    out[m // 2 :, : n // 2] = m2 + m4
    out[m // 2 :, n // 2 :] = m1 - m2 + m3 + m6
    return out


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of integer matrices by Strassen's seven products, after zero padding of every edge.

    Sums in int64 wrap around modulo 2^64, so the result is exact wherever it fits into int64, which
    the bound below proves; otherwise Python's integers are used, and the result is an object array.
    """
    largest = lambda x: max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0
    if largest(a) * largest(b) * max(a.shape[1], 1) > LONGS.max // 128:  # 128: the window multiplies by up to 100
        a, b = a.astype(object), b.astype(object)
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    levels = 0
    while min(m, k, n) > leaf << levels:
        levels += 1
    up = lambda x: -(-max(x, 1) >> levels) << levels
    pad_a, pad_b = np.zeros((up(m), up(k)), a.dtype), np.zeros((up(k), up(n)), b.dtype)
    pad_a[:m, :k], pad_b[:k, :n] = a, b
    return _strassen(pad_a, pad_b, leaf)[:m, :n]


# Heaps -----------------------------------------------------------------------------------------


class Heaps:
    """The best ``k`` (score, id) of each of ``n`` rows: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.rows, self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        #: What a score must reach to enter each row's heap; no bound yet for a heap with room.
        self.floor = np.full(n, LONGS.min)

    def push(self, good: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes the scores (row x id) at the places where ``good`` holds."""
        small = scores.dtype != object
        at, col = np.nonzero(good & (scores >= self.floor[:, None]) if small else good)
        if not len(at):
            return
        rows, new = np.concatenate([self.rows, at]), np.concatenate([self.scores, scores[at, col]])
        names = np.concatenate([self.ids, ids[col]])
        order = np.lexsort((names, -new, rows))
        rows, new, names = rows[order], new[order], names[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        self.rows, self.scores, self.ids = rows[keep], new[keep], names[keep]
        full = place[keep] == self.k - 1
        if new.dtype != object:
            self.floor[self.rows[full]] = self.scores[full]


# Groups of blocks ------------------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer vectors as rows, with zeros behind the shorter ones."""
    lists = column.combine_chunks()
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy(zero_copy_only=False)]))
    out = np.zeros((len(lists), width), np.int64)
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def _parts(scores: np.ndarray) -> list[pa.Array]:
    return [pa.array((scores >> PART).astype(np.int64)), pa.array((scores & (2**PART - 1)).astype(np.int64))]


def _whole(parts: list[dict[str, int]] | None) -> list[int]:
    return [(x["high"] << PART) + x["low"] for x in parts or []]


def _long(high: Column, low: Column) -> Column:
    """The score, or the nearest long."""
    top = 1 << 63 - PART
    return F.when(high >= top, LONGS.max).when(high < -top, LONGS.min).otherwise(high * (1 << PART) + low).cast("long")


def _tiles(anchors: pa.Table, rows: pa.Table, width: int):
    """(first anchor, scores, candidate ids, candidate labels, anchor ids, anchor labels) of each tile of two blocks."""
    a, b = _matrix(anchors.column("v"), width), np.ascontiguousarray(_matrix(rows.column("v"), width).T)
    names, labels = ([t.column(c).to_numpy() for t in (anchors, rows)] for c in ("vec_id", "label"))
    for i in range(0, len(a), TILE):
        for j in range(0, b.shape[1], TILE):
            cut, own = slice(j, j + TILE), slice(i, i + TILE)
            yield i, product(a[own], b[:, cut]), names[1][cut], labels[1][cut], names[0][own], labels[0][own]


def _positives(anchors: pa.Table, rows: pa.Table, width: int, k: int) -> pa.Table:
    """(anchor, positive_id, high, low): the best of one block for each anchor of another."""
    heaps = [Heaps(min(TILE, anchors.num_rows - i), k) for i in range(0, anchors.num_rows, TILE)]
    for i, scores, ids, labels, own, own_labels in _tiles(anchors, rows, width):
        heaps[i // TILE].push((own_labels[:, None] == labels) & (own[:, None] != ids), scores, ids)
    keys, names = anchors.column("anchor").to_numpy(), ["anchor", "positive_id", "high", "low"]
    parts = [pa.table([pa.array(keys[i * TILE + h.rows]), pa.array(h.ids), *_parts(h.scores)], names=names) for i, h in enumerate(heaps)]
    return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], pa.int64()) for c in names})


def _negatives(anchors: pa.Table, rows: pa.Table, width: int, k: int) -> pa.Table:
    """(anchor, place, negative_id, high, low): the best of one block in each positive's window."""
    windows = [_whole(x) for x in anchors.column("positive_scores").to_pylist()]
    most = max(map(len, windows), default=0)
    # per tile of anchors: which of them has a positive at a place, and a heap for each of these
    held = [[np.array([p < len(w) for w in windows[i : i + TILE]], bool) for p in range(most)] for i in range(0, len(windows), TILE)]
    heaps = [[Heaps(int(h.sum()), k) for h in tile] for tile in held]
    for i, scores, ids, labels, _, own_labels in _tiles(anchors, rows, width):
        for p, has in enumerate(held[i // TILE]):
            if has.any():
                near = scores[has]
                own = [w[p] for w in windows[i : i + TILE] if p < len(w)]
                of = np.array(own, object if max(map(abs, own)) > LONGS.max // 128 else near.dtype)
                good = (own_labels[has][:, None] != labels) & (LOW * of[:, None] <= 100 * near) & (100 * near <= HIGH * of[:, None])
                heaps[i // TILE][p].push(good.astype(bool), near, ids)
    keys, names = anchors.column("anchor").to_numpy(), ["anchor", "place", "negative_id", "high", "low"]
    parts = [
        pa.table([pa.array(keys[i * TILE + np.flatnonzero(held[i][p])[h.rows]]), pa.array(np.full(len(h.rows), p)), pa.array(h.ids), *_parts(h.scores)], names=names)
        for i, tile in enumerate(heaps)
        for p, h in enumerate(tile)
    ]
    return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], pa.int64()) for c in names})


# The operator ----------------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): distinct rows with a label and a finite vector, its components as integers."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    rows = rows.filter("vec_id is not null and label is not null and x is not null").filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    held = lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c * SCALE))).cast("long")
    return rows.select("vec_id", "label", F.transform("x", held).alias("v")).distinct()


def _spread(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to pairs of blocks: each row goes once to every block of the other side."""
    own, other = max(1, -(-n_anchors // block)), max(1, -(-n_rows // block))
    dealt = lambda key, n: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = anchors.withColumn("a_block", dealt(["anchor"], own)).withColumn("b_block", every(other))
    offered = rows.select(*[F.col(c).alias(c) for c in rows.columns], dealt(["vec_id", "label", "v"], other).alias("b_block"))
    return asked, offered.withColumn("a_block", every(own))


def mine(vectors: DataFrame, step: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, shift: Column | None = None, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label; other columns are not read. Anchors are the rows
    whose vec_id ``step`` divides; ``shift`` replaces the label, as a column over vec_id and label.
    Rows with a null id, label or vector or a component that is null or not finite take no part.
    Shorter vectors count as if zeros stood behind them; integers beyond 2^56 are held to it. Rows that repeat wholly count once. Where an
    id has several rows, each is an anchor of its own, a row never pairs with its own id, and equal
    (anchor_id, positive_id) of them rank apart. Scores beyond a long are given as the nearest long.
    A positive without a negative in its window has no row; an empty table gives none.
    """
    scratch = Scratch(vectors.sparkSession, "hard-negatives")
    good = usable(vectors)
    good = scratch.save(good if shift is None else good.withColumn("label", shift.cast("long")).filter("label is not null"))
    anchors = good.filter(F.col("vec_id") % step == 0).withColumn("anchor", F.xxhash64("vec_id", "label", "v"))
    size = good.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % step == 0, 1)).alias("q"), F.max(F.size("v")).alias("width")).first()
    width = max(size["width"] or 0, 1)
    blocks = ["a_block", "b_block"]

    asked, offered = _spread(anchors, good, size["q"], size["n"], block)
    first = asked.groupBy(*blocks).cogroup(offered.groupBy(*blocks)).applyInArrow(
        lambda a, b: _positives(a, b, width, positives), "anchor long, positive_id long, high long, low long"
    )
    best = Window.partitionBy("anchor").orderBy(F.desc("high"), F.desc("low"), "positive_id")
    first = first.withColumn("place", F.row_number().over(best) - 1).filter(F.col("place") < positives)
    found = scratch.save(first)
    listed = found.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "high", "low"))), lambda s: F.struct(s["high"], s["low"])).alias("positive_scores"))

    asked, offered = _spread(anchors.join(listed, "anchor"), good, size["q"], size["n"], block)
    second = asked.groupBy(*blocks).cogroup(offered.groupBy(*blocks)).applyInArrow(
        lambda a, b: _negatives(a, b, width, negatives), "anchor long, place long, negative_id long, high long, low long"
    )
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("high"), F.desc("low"), "negative_id")
    ranked = second.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    ranked = ranked.select("anchor", "place", "rank", "negative_id", _long(F.col("high"), F.col("low")).alias("negative_score"))
    named = ranked.join(found.withColumn("positive_score", _long(F.col("high"), F.col("low"))), ["anchor", "place"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same rows in DuckDB: every anchor against every row.
ORACLE = f"""
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM (SELECT DISTINCT vec_id, label, embedding FROM embeddings)
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
