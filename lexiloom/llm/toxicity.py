"""Toxicity by a classifier chain.

Categories are predicted one after another: the linear model of each category sees the words of the
text, their beginnings, and the probabilities of the categories before it. While fitting, those come from
models that did not see the row (out-of-fold), so a later model learns how far to trust an earlier one.

The models are fitted on a bounded sample of labelled rows. Every text is then scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import empty_text, many_word_hashes, mix, per_batch
from lexiloom.llm.decontaminate import SEPARATORS

#: Labelled rows that are fitted on, at most about; chosen by a hash of the id.
FIT_ROWS = 8_000
#: Words and word beginnings that the chain sees, at most; the fewest sample rows that hold one; bytes of a beginning.
WORDS, LEAST_ROWS, HEAD = 256, 4, 6
FOLDS, RIDGE, ROUNDS = 5, 2.0, 25
#: Probability from which on a text is taken to be of a category.
CUT = 0.5
#: The chain of the registered query: label column, and whether its 1 or its 0 is the category.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))

#: Distinct words (sorted hashes), their counts, and the number of words of a text.
Bag = tuple[np.ndarray, np.ndarray, int]


@dataclass
class Chain:
    """Vocabulary and weights. Row i of ``weights``: intercept, earlier categories' log-odds, inputs of the words."""

    names: list[str]
    vocabulary: np.ndarray
    weights: list[np.ndarray]

    def score(self, inputs: np.ndarray) -> np.ndarray:
        """Probabilities (row, category) from the inputs of the vocabulary."""
        odds = np.zeros((len(inputs), 0))
        for w in self.weights:
            odds = np.hstack([odds, _design(inputs, odds) @ w[:, None]])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _design(inputs: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(inputs), 1)), np.clip(earlier, -8, 8), inputs])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is not shrunk."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[0] = 1e-6
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _telling(rows: list[np.ndarray], y: np.ndarray, words: int) -> np.ndarray:
    """The words whose presence tells most about y: the largest likelihood-ratio statistics."""
    if not rows:
        return np.empty(0, np.uint64)
    flat, owner = np.concatenate(rows) if rows else np.empty(0, np.uint64), np.repeat(y, [len(r) for r in rows])
    word, where = np.unique(flat, return_inverse=True)
    total = np.bincount(where, minlength=len(word)).astype(float)
    inside = np.bincount(where, weights=owner, minlength=len(word))
    n, base = len(rows), max(float(y.sum()), 0.5)
    gain = np.zeros(len(word))
    for seen, expected in ((inside, total * base / n), (total - inside, total * (1 - base / n))):
        gain += 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))
    gain[total < LEAST_ROWS] = 0
    best = np.lexsort((word, -gain))[:words]
    return word[best[gain[best] > 10.8]]  # beyond chance at one in a thousand


def _inputs(rows: list[Bag], vocabulary: np.ndarray) -> np.ndarray:
    """Per row and vocabulary word: whether it is there, and how dense, log(1 + 100 * share of the words)."""
    there, dense = (np.zeros((len(rows), len(vocabulary))) for _ in range(2))
    if len(vocabulary):
        for i, (words, counts, n) in enumerate(rows):
            at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            met = vocabulary[at] == words
            there[i, at[met]] = 1
            dense[i, at[met]] = np.log1p(100 * counts[met] / n)
    return np.hstack([there, dense])


def fit_chain(names: Sequence[str], rows: list[Bag], labels: np.ndarray, fold: np.ndarray, words: int = WORDS) -> Chain:
    """Fit on the words of each row and a 0/1 label matrix (row, category); nan is unknown."""
    known = ~np.isnan(labels)
    picks = [_telling([rows[i][0] for i in np.flatnonzero(k)], y[k], words // len(names)) for k, y in zip(known.T, labels.T, strict=True)]
    vocabulary = np.unique(np.concatenate([*picks, np.empty(0, np.uint64)]).astype(np.uint64))
    inputs = _inputs(rows, vocabulary)
    odds, weights = np.zeros((len(rows), 0)), []
    for k, y in zip(known.T, labels.T, strict=True):
        x, unseen = _design(inputs, odds), np.zeros(len(rows))
        weights.append(_logistic(x[k], y[k]) if k.any() else np.zeros(x.shape[1]))
        for f in range(FOLDS):
            train, test = k & (fold != f), fold == f
            unseen[test] = x[test] @ (_logistic(x[train], y[train]) if train.any() else weights[-1])
        odds = np.hstack([odds, unseen[:, None]])
    return Chain(list(names), vocabulary, weights)


def bags(texts: list[str]) -> list[Bag]:
    """Distinct words and word beginnings of each text, as hashes, with their counts and the number of words."""
    datas = [t.lower().encode() for t in texts]
    words, bounds = many_word_hashes(datas, SEPARATORS)
    heads, _ = many_word_hashes(datas, SEPARATORS, HEAD)
    heads = mix(heads ^ np.uint64(0x5BD1E995))
    return [(*np.unique(np.concatenate([words[a:b], heads[a:b]]), return_counts=True), b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def folds(ids: np.ndarray) -> np.ndarray:
    """The fold of each id, by a hash, so that ids which share a remainder still fill every fold."""
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)


def learn(docs: DataFrame, labels: DataFrame, chain: Sequence[tuple[str, str, int]] = CHAIN, rows: int = FIT_ROWS) -> Chain:
    """Fit the chain on about ``rows`` labelled documents; only their word hashes reach the driver."""
    of = [F.when(F.col(c).isNotNull(), (F.col(c) == v).cast("double")).alias(f"y{i}") for i, (_, c, v) in enumerate(chain)]
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *of).filter("doc_id is not null").distinct()
    marked = marked.filter(" or ".join(f"y{i} is not null" for i in range(len(chain))))
    part = 10**6 * rows // max(1, marked.count())
    chosen = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(10**6)) < part)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(chosen), "doc_id")

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = bags(batch.column("text").to_pylist())
        columns = [*batch.columns[:-1], pa.array([w.tobytes() for w, _, _ in own], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c, _ in own], pa.binary()), pa.array([n for *_, n in own], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "words", "counts", "n"])

    columns = ", ".join(f"y{i} double" for i in range(len(chain)))
    found = known.select("doc_id", *[f"y{i}" for i in range(len(chain))], "text").mapInArrow(per_batch(words), f"doc_id long, {columns}, words binary, counts binary, n long").toArrow().sort_by("doc_id")
    y = np.column_stack([found.column(f"y{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(chain))])
    fold = folds(found.column("doc_id").to_numpy())
    parts = zip(found.column("words").to_pylist(), found.column("counts").to_pylist(), found.column("n").to_pylist(), strict=True)
    return fit_chain([name for name, *_ in chain], [(np.frombuffer(w, np.uint64), np.frombuffer(c, np.int32), max(n, 1)) for w, c, n in parts], y, fold)


def score(docs: DataFrame, labels: DataFrame, chain: Sequence[tuple[str, str, int]] = CHAIN) -> DataFrame:
    """doc_id, toxic, and p_<category> for each row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and the chain's label columns; null labels are unknown and teach nothing.
    ``toxic`` says whether the last category of the chain reaches ``CUT``. Null and empty texts get the
    probabilities of a text without words. With no labelled document every probability is a half and
    nothing is toxic. Rows that repeat are each scored, null ids are carried, other columns are not
    read. An empty table gives no rows.
    """
    model = learn(docs, labels, chain)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    empty = not any(np.abs(w).any() for w in model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value

        def rate(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = own.score(_inputs(bags(batch.column("text").to_pylist()), own.vocabulary))
            toxic = pa.array((p[:, -1] >= CUT) & (not empty))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), toxic, *map(pa.array, p.T)], names=["doc_id", "toxic", *(f"p_{n}" for n in own.names)])

        yield from per_batch(rate)(batches)

    plain = docs.select("doc_id", empty_text().alias("text"))
    columns = ", ".join(f"p_{n} double" for n, *_ in chain)
    return plain.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic boolean, {columns}")
