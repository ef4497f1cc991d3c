"""Benchmark decontamination by greedy string tiling.

Shared runs of ``SEED`` words join documents to benchmark items. For each pair the longest common run
of unmarked words is found again and again, by Karp-Rabin hashes of windows, and marked in both
texts, until no run of ``SEED`` words is left. The share of the item's words under tiles decides, so
an item whose sentences were put in another order is caught too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import empty_text, many_word_hashes, per_batch, runs_hash, word_hashes

#: Words of a seed, which is also the least tile.
SEED = 5
#: Share of an item's words under tiles from which on a document is contaminated.
COVERAGE = 0.75
#: Bytes of benchmark text that one pass over the documents holds in memory. A longer benchmark takes several passes.
SLICE_BYTES = 8 << 20

SEPARATORS = np.array([not (re.match(r"[0-9A-Za-z]", chr(i)) or i >= 128) for i in range(256)])
_U = np.uint64
_STEP = 0x2545F4914F6CDD1D
_BACK = pow(_STEP, -1, 2**64)


def words(text: str | None) -> np.ndarray:
    """A hash per word: runs of letters and digits, in lower case."""
    return word_hashes((text or "").lower().encode(), SEPARATORS)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, base, _U)]))


class _Windows:
    """Karp-Rabin hashes of the unmarked windows of a sequence, for any length."""

    def __init__(self, seq: np.ndarray):
        with np.errstate(over="ignore"):
            self.seq, self.marked = seq, np.zeros(len(seq), bool)
            self._sums = np.concatenate([np.zeros(1, _U), np.cumsum(seq * _powers(_STEP, len(seq))[:-1], dtype=_U)])
            self._back = _powers(_BACK, len(seq))

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of ``length`` words that hold no marked word."""
        n = len(self.seq) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, _U)
        below = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.marked)])
        start = np.flatnonzero(below[length : length + n] == below[:n])
        with np.errstate(over="ignore"):
            return start, (self._sums[start + length] - self._sums[start]) * self._back[start]


def _common(doc: _Windows, item: _Windows, length: int) -> tuple[int, int] | None:
    """First position in the item, and there first in the document, of a common unmarked run."""
    at_item, in_item = item.of(length)
    at_doc, in_doc = doc.of(length)
    hit = np.flatnonzero(np.isin(in_item, in_doc))
    for i in hit:
        for j in np.flatnonzero(in_doc == in_item[i]):
            x, y = int(at_item[i]), int(at_doc[j])
            if np.array_equal(item.seq[x : x + length], doc.seq[y : y + length]):
                return x, y
    return None


def tiling(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(item position, document position, length) of greedy tiles: the longest first; ties to the earlier item position, then the earlier document position."""
    a, b = _Windows(doc), _Windows(item)
    tiles: list[tuple[int, int, int]] = []
    top = min(len(doc), len(item))
    while top >= least:
        low, found = least, None
        high = top
        while low <= high:  # a common run of some length holds common runs of every smaller one
            middle = high if found is None and high == top and tiles else (low + high) // 2
            hit = _common(a, b, middle)
            if hit:
                found, low = (*hit, middle), middle + 1
            else:
                high = middle - 1
        if found is None:
            break
        x, y, top = found
        tiles.append(found)
        b.marked[x : x + top] = True
        a.marked[y : y + top] = True
    return tiles


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """The benchmark's items, at most about ``SLICE_BYTES`` of text at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), empty_text().alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    passes = max(1, -(-size // SLICE_BYTES))
    for i in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).collect()
        yield [(r["item_id"], w) for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"])) if len(w := words(r["text"])) >= SEED]


class _Index:
    """Seeds of a slice of items."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.items = items
        seeds = [runs_hash(w, SEED) for _, w in items]
        flat = np.concatenate(seeds) if seeds else np.empty(0, _U)
        owner = np.repeat(np.arange(len(items)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else owner
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner, self.place = flat[order], owner[order], place[order]

    def scan(self, texts: list[str | None], coverage: float) -> Iterator[tuple[int, int | None, int, int, int]]:
        """(row, item_id, tiles, covered words, words of the item) of the items that each text covers."""
        hashes, bounds = many_word_hashes([(t or "").lower().encode() for t in texts], SEPARATORS)
        if len(hashes) < SEED or not len(self.seeds):
            return
        runs = runs_hash(hashes, SEED)
        near = np.minimum(np.searchsorted(self.seeds, runs), len(self.seeds) - 1)
        met = np.flatnonzero(self.seeds[near] == runs)
        row = np.searchsorted(bounds, met, "right") - 1
        inside = met + SEED <= bounds[row + 1]
        met, row = met[inside], row[inside]
        for r in np.unique(row):
            doc = hashes[bounds[r] : bounds[r + 1]]
            own = np.unique(runs[met[row == r]])
            for hit in self._covered(doc, own, coverage):
                yield int(r), *hit

    def _covered(self, doc: np.ndarray, shared: np.ndarray, coverage: float) -> Iterator[tuple[int | None, int, int, int]]:
        low, high = np.searchsorted(self.seeds, shared, "left"), np.searchsorted(self.seeds, shared, "right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
        for k in np.unique(self.owner[at]):
            item_id, item = self.items[k]
            # tiles lie inside the item's words that some shared seed covers: a bound before tiling
            spot = np.zeros(len(item) + 1, np.int64)
            for p in self.place[at][self.owner[at] == k]:
                spot[p] += 1
                spot[p + SEED] -= 1
            if np.count_nonzero(np.cumsum(spot[:-1])) < coverage * len(item):
                continue
            tiles = tiling(doc, item)
            covered = sum(n for _, _, n in tiles)
            if covered >= coverage * len(item):
                yield item_id, len(tiles), covered, len(item)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_tiles, n_covered, n_item, coverage) where a document covers an item.

    Documents with null or blank text cover nothing; items of fewer than ``SEED`` words, null ones
    among them, are not tested. Rows that repeat, in either table, are each tested. Null ids are
    carried. Other columns are not read; an empty table on either side gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text"))
    out: DataFrame | None = None
    for items in _slices(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = _Index(index.value)

            def rate(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[r], *hit) for r, *hit in own.scan(batch.column("text").to_pylist(), coverage)]
                if not rows:
                    return None
                doc_id, item_id, n, covered, size = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                return pa.RecordBatch.from_arrays([doc_id, item_id, n, covered, size], names=["doc_id", "item_id", "n_tiles", "n_covered", "n_item"])

            yield from per_batch(rate)(batches)

        part = plain.mapInArrow(run, "doc_id long, item_id long, n_tiles long, n_covered long, n_item long")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("coverage", F.col("n_covered") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Rows of ``docs`` that cover no benchmark item, with all their columns. Each row's own text decides."""
    place = docs.columns.index("text")
    for items in _slices(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = _Index(index.value)

            def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
                hit = {r for r, *_ in own.scan(batch.column(place).to_pylist(), coverage)}
                return batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

            yield from per_batch(clean)(batches)

        docs = docs.mapInArrow(run, docs.schema)
    return docs
