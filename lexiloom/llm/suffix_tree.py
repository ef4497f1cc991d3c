"""Language-model scores of texts by a probabilistic suffix tree over words.

A state of the tree is a context of up to ``DEPTH`` words. Next-word counts of a context are smoothed
towards those of the context without its oldest word, down to the words' own counts. A context is
retained when its next words diverge from its parent's prediction by more than their number explains
(a description-length test), and with it every shorter suffix. A token is predicted by the longest
retained state that the words before it end in.

Texts are cut into parts of bounded size, written once. A part asks for the corpus counts of the
distinct word runs that it holds: their keys, sorted, cut into ranges and packed. A range is one
task's small group: it adds up the counts of all parts and answers each part in the order of its
keys. A frequent run is one key per part there, so no range is hot. Longer runs are only asked for
where the shorter ones are frequent. Contexts ask for their tree entries in the same way. Neither
the tree nor the counts are ever gathered: each part gets the entries that its own texts meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import Scratch, empty_text, many_word_hashes, mix, signed, slices, texts

#: Words of the longest context; training tokens that a context and a next word behind it must have at least.
DEPTH, LEAST_CONTEXT, LEAST_NEXT = 2, 16, 4
#: A context is retained when its divergence (nats) is this share of log(count) for each next word.
COST = 0.5
#: Added to each word's count, as the base score has it.
ADD = 0.1
#: Bytes of text in a part, about; a longer text is a part of its own. Tokens behind one range of keys, about.
PART, RANGE = 8 << 20, 1 << 20

_U = np.uint64
#: The key of the end of a text, which no word hashes to in practice.
END = mix(np.array([0x656E64], _U))[0]

#: What a part gives or gets: run counts, next-word numbers of contexts, retained contexts, statistics of contexts.
RUN, HOLD, KEEP, STATE = range(4)


# Packed numbers --------------------------------------------------------------------------------


def _pack(*columns: np.ndarray, rising: bool = False) -> bytes:
    """Columns of 64-bit numbers of one length, byte by byte; a first column of sorted keys as differences."""
    columns = [np.ascontiguousarray(x).view(_U) for x in columns]
    if rising and len(columns[0]):
        columns[0] = np.diff(columns[0], prepend=_U(0))
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() for x in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, columns: int, rising: bool = False) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    out = [np.ascontiguousarray(x.reshape(8, -1).T).view(_U).ravel() for x in raw.reshape(columns, -1)]
    if rising:
        out[0] = np.cumsum(out[0], dtype=_U)
    return [x.view(np.int64) for x in out]


_PACKED = [("bucket", pa.int64()), ("kind", pa.int32()), ("depth", pa.int32()), ("range", pa.int32()), ("blob", pa.binary())]
_STATS = [("key", pa.int64()), ("parent", pa.int64()), ("n", pa.int64()), ("d", pa.int64()), ("c", pa.int64()), ("s", pa.float64()), ("r", pa.float64())]
_GIVEN = "bucket long, kind int, depth int, range int, blob binary, key long, parent long, n long, d long, c long, s double, r double"
_ANSWER = "bucket long, kind int, depth int, range int, blob binary, known long"


def _table(fields: list[tuple[str, pa.DataType]], rows: int, **columns: object) -> pa.Table:
    """A table of the fields; those not given are null."""
    return pa.table([pa.array(columns[name], t) if name in columns else pa.nulls(rows, t) for name, t in fields], names=[name for name, _ in fields])


def _asks(bucket: int, kind: int, depth: int, bits: int, keys: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """A row for each range of the sorted keys: the range is a key's first ``bits`` bits."""
    of = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    ranges, first = np.unique(of, return_index=True)
    ends = [*first.tolist(), len(keys)][1:]
    blobs = [_pack(*[x[a:b] for x in (keys, *columns)], rising=True) for a, b in zip(first.tolist(), ends, strict=True)]
    full = lambda x: np.full(len(ranges), x)
    return _table(_PACKED + _STATS, len(ranges), bucket=full(bucket), kind=full(kind), depth=full(depth), range=ranges, blob=blobs)


def _answered(rows: pa.Table, blobs: list[bytes], known: list[int] | None = None) -> pa.Table:
    out = rows.select([name for name, _ in _PACKED[:-1]]).append_column("blob", pa.array(blobs, pa.binary()))
    return out.append_column("known", pa.array(known if known is not None else [0] * len(blobs), pa.int64()))


def _gathered(rows: pa.Table, columns: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The asks of all parts in a range: their columns, the row of each, and the bounds of the rows; lesser parts first."""
    parts = [_unpack(x, columns, rising=True) for x in rows.column("blob").to_pylist()]
    bounds = np.cumsum([0, *[len(x[0]) for x in parts]])
    every = [np.concatenate([x[i] for x in parts]) for i in range(columns)]
    return every, np.repeat(np.arange(len(parts)), np.diff(bounds)), bounds


def _counts(rows: pa.Table, least: int) -> pa.Table:
    """For each ask of a range, in its order, twice the corpus count (0 below ``least``), and one more where the part leads the run."""
    rows = rows.sort_by("bucket")
    (keys, n), _, bounds = _gathered(rows, 2)
    unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(inverse, n, len(unique)).astype(np.int64)
    total[total < max(least, 1)] = 0
    lead = np.zeros(len(keys), np.int64)
    lead[first[total > 0]] = 1
    answer = 2 * total[inverse] + lead
    cuts = list(zip(bounds[:-1], bounds[1:], strict=True))
    return _answered(rows, [_pack(answer[a:b]) for a, b in cuts], [int(lead[a:b].sum()) for a, b in cuts])


def _entries(rows: pa.Table, states: pa.Table, columns: list[str]) -> pa.Table:
    """For each context that a range's parts hold, its entries in the tree's table; zeros where it has none."""
    (keys,), _, bounds = _gathered(rows, 1) if rows.num_rows else (([np.empty(0, np.int64)]), None, np.zeros(1, np.int64))
    own = states.column("key").to_numpy()
    order = np.argsort(own)
    at = np.minimum(np.searchsorted(own[order], keys), max(len(own) - 1, 0))
    there = own[order][at] == keys if len(own) else np.zeros(len(keys), bool)
    found = [np.where(there, states.column(c).to_numpy()[order][at], 0) if len(own) else np.zeros(len(keys), np.int64) for c in columns]
    return _answered(rows, [_pack(*[x[a:b] for x in found]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])


# Parts -----------------------------------------------------------------------------------------


def _before(x: np.ndarray) -> np.ndarray:
    """Each place's value one place earlier."""
    return np.concatenate([x[-1:], x[:-1]])


class Part:
    """The tokens of a part's texts, and what the corpus has told about the runs at each of them.

    Places are tokens; the context of ``depth`` words is that before the token. Where less words are
    before it, the context reaches over the text's beginning and counts 0.
    """

    def __init__(self, row: pa.Table, answers: pa.Table | None, limits: tuple[int, int], depth: int = -1):
        get = lambda name: row.column(name)[0].as_py()
        self.bucket, self.limits = get("bucket"), limits
        self.vocabulary = _unpack(get("vocabulary"), 1, rising=True)[0].view(_U)
        self.ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(get("ids")), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()
        self.names, self.named, self.learns, lengths = _unpack(get("texts"), 4)
        self.starts = np.cumsum(lengths) - lengths
        self.place = np.arange(len(self.ids)) - np.repeat(self.starts, lengths)
        self.learned = np.repeat(self.learns, lengths) == 1
        self._runs = {0: self.vocabulary[self.ids]}
        self._told: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        if answers is not None:
            for kind, d, of, blob in zip(*[answers.column(c).to_pylist() for c in ("kind", "depth", "range", "blob")], strict=True):
                self._told.setdefault((kind, d), []).append((of, blob))
        self.counts, self.leads, self.entries = {}, {}, {}
        for d in range(depth + 1):
            self._learn(d)

    def _answer(self, kind: int, depth: int, columns: int, inverse: np.ndarray) -> list[np.ndarray]:
        """The answers to what was asked in order, at the places that asked."""
        parts = [_unpack(blob, columns) for _, blob in sorted(self._told.get((kind, depth), []))]
        return [np.concatenate([x[i] for x in parts])[inverse] if parts else np.zeros(len(inverse), np.int64) for i in range(columns)]

    def _learn(self, depth: int) -> None:
        places, _, inverse = self.asked(depth)
        (answer,) = self._answer(RUN, depth, 1, inverse)
        count, lead = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        count[places], lead[places] = answer >> 1, answer & 1 == 1
        self.counts[depth], self.leads[depth] = count, lead
        if depth == 1:  # asked before the words' counts were known
            rare = self.context_count(1) < self.limits[0]
            count[rare], lead[rare] = 0, False

    def run(self, depth: int) -> np.ndarray:
        """The key of ``depth`` words and the token behind them."""
        if depth not in self._runs:
            with np.errstate(over="ignore"):
                self._runs[depth] = mix(self.context(depth) * _U(0xD6E8FEB86659FD93) + self._runs[0] + _U(depth))
        return self._runs[depth]

    def context(self, depth: int) -> np.ndarray:
        return _before(self.run(depth - 1))

    def context_count(self, depth: int) -> np.ndarray:
        """Training count of the ``depth`` words before each token."""
        return np.where(self.place >= depth, _before(self.counts[depth - 1]), 0)

    def asked(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose run of ``depth`` words and a token may be frequent, its distinct keys, and the key of each place."""
        if depth == 0:
            return np.arange(len(self.ids)), self.vocabulary, self.ids
        places = np.flatnonzero(self.place >= 1 if depth == 1 else (self.context_count(depth) >= self.limits[0]) & (self.counts[depth - 1] >= self.limits[1]))
        return places, *np.unique(self.run(depth)[places], return_inverse=True)

    def held(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places behind a frequent context of ``depth`` words, the distinct contexts, and that of each place."""
        places = np.flatnonzero(self.context_count(depth) >= self.limits[0])
        return places, *np.unique(self.context(depth)[places], return_inverse=True)

    def told(self, kind: int, depth: int, columns: int) -> list[np.ndarray]:
        """What the tree says about each place's context; zeros where nothing."""
        places, _, inverse = self.held(depth)
        out = [np.zeros(len(self.ids), np.int64) for _ in range(columns)]
        for x, y in zip(out, self._answer(kind, depth, columns, inverse), strict=True):
            x[places] = y
        return out

    def predictions(self, size: tuple[int, int], depth: int) -> list[np.ndarray]:
        """For contexts of 0, 1 .. ``depth`` words, the smoothed probability of each token behind its own."""
        out = [(self.counts[0] + ADD) / (size[0] + ADD * (size[1] + 1))]
        for d in range(1, depth + 1):
            kinds, kept = self.told(HOLD, d, 2)
            c, q = self.context_count(d), out[-1]
            out.append(np.where(kinds > 0, (self.counts[d] + (kinds + c - kept) * q) / np.maximum(c + kinds, 1), q))
        return out


# Passes ----------------------------------------------------------------------------------------

_PART = "bucket long, tokens long, learned long, vocabulary binary, ids binary, texts binary"


def _cut(part: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The texts of a task as tokens, in parts of about ``part`` bytes."""

    def give(bucket: int, rows: list[pa.RecordBatch], hashed: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        lengths = np.concatenate([np.diff(bounds) for _, bounds in hashed]) + 1
        ends = np.cumsum(lengths)
        tokens, inside = np.full(int(ends[-1]), END, _U), np.ones(int(ends[-1]), bool)
        inside[ends - 1] = False
        tokens[inside] = np.concatenate([h for h, _ in hashed])
        vocabulary, ids = np.unique(tokens, return_inverse=True)
        planes = np.ascontiguousarray(ids.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()
        table = pa.Table.from_batches(rows)
        names, learned = table.column("doc_id"), table.column("learned").to_numpy().astype(np.int64)
        out = {
            "bucket": [bucket], "tokens": [len(tokens)], "learned": [int(lengths[learned == 1].sum())], "vocabulary": [_pack(vocabulary, rising=True)],
            "ids": [zstandard.ZstdCompressor(level=3).compress(planes)], "texts": [_pack(names.fill_null(0).to_numpy(), names.is_valid().to_numpy().astype(np.int64), learned, lengths)],
        }
        kinds = [pa.int64()] * 3 + [pa.binary()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, size, rows, hashed = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in slices(batches):
            data = texts(batch.column("text"))
            rows.append(batch.select(["doc_id", "learned"]))
            hashed.append(many_word_hashes(data))
            size += sum(map(len, data))
            if size >= part:
                yield from give(bucket, rows, hashed)
                bucket, size, rows, hashed = bucket + 1, 0, [], []
        if rows:
            yield from give(bucket, rows, hashed)

    return run


def _run_asks(part: Part, depth: int, bits: int) -> pa.Table:
    """The runs of a part that may be frequent, with how often its learned texts hold each."""
    places, keys, inverse = part.asked(depth)
    n = np.bincount(inverse[part.learned[places]], minlength=len(keys))
    return _asks(part.bucket, RUN, depth, bits, keys, n)


def _first_asks(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What each part asks first: its words, and its runs of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            part = Part(pa.Table.from_batches([batch]), None, (1, 1))
            for depth in (0, 1):
                yield from _run_asks(part, depth, bits).select([name for name, _ in _PACKED]).to_batches()

    return run


def _statistics(row: pa.Table, answers: pa.Table, depth: int, last: bool, bits: int, limits: tuple[int, int], size: tuple[int, int]) -> pa.Table:
    """Statistics of contexts of ``depth`` words from the runs that a part leads, the contexts that it holds, and asks for longer runs."""
    part = Part(row, answers, limits, depth)
    places = np.flatnonzero(part.leads[depth])
    places = places[np.unique(part.run(depth)[places], return_index=True)[1]]
    n, c, q = part.counts[depth][places], part.context_count(depth)[places], part.predictions(size, depth - 1)[-1][places]
    contexts, first, inverse = np.unique(part.context(depth)[places], return_index=True, return_inverse=True)
    total = lambda x: np.bincount(inverse, x, len(contexts))
    parent = signed(part.context(depth - 1)[places][first]) if depth > 1 else np.zeros(len(contexts), np.int64)
    full = lambda x: np.full(len(contexts), x)
    stats = _table(
        _PACKED + _STATS, len(contexts), bucket=full(part.bucket), kind=full(STATE), depth=full(depth), key=signed(contexts), parent=parent, n=c[first],
        d=np.bincount(inverse, minlength=len(contexts)), c=total(n).astype(np.int64), s=total(n * np.log(n / c / q)), r=total(q),
    )
    out = [stats, _asks(part.bucket, HOLD, depth, bits, part.held(depth)[1])]
    return pa.concat_tables(out if last else [*out, _run_asks(part, depth + 1, bits)])


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(row: pa.Table, answers: pa.Table, depth: int, limits: tuple[int, int], size: tuple[int, int]) -> pa.Table:
    part = Part(row, answers, limits, depth)
    chances = part.predictions(size, depth)
    best = chances[0]
    for d in range(1, depth + 1):
        best = np.where(part.told(KEEP, d, 1)[0] > 0, chances[d], best)
    each = lambda x: np.add.reduceat(x, part.starts)
    columns = [
        pa.array(part.names, mask=part.named == 0), pa.array(part.learns == 0), pa.array(each(np.ones(len(best), np.int64))), pa.array(each((part.counts[0] > 0).astype(np.int64))),
        pa.array(np.full(len(part.starts), size[0])), pa.array(each(np.log10(chances[0]))), pa.array(each(np.log10(best))),
    ]
    return pa.table(columns, names=[x.split()[0] for x in _SCORES.split(", ")])


# The operator ----------------------------------------------------------------------------------


def _states(given: DataFrame, cost: float) -> DataFrame:
    """(key, parent, d, c, own): next-word numbers of each context, and whether its divergence pays."""
    summed = given.filter(F.col("kind") == STATE).groupBy("key").agg(F.first("parent").alias("parent"), F.max("n").alias("n"), F.sum("d").alias("d"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("r").alias("r"))
    rest = F.col("n") - F.col("c")
    beyond = F.when(rest > 0, rest * F.log(rest / F.col("n") / F.greatest(1 - F.col("r"), F.lit(1e-12)))).otherwise(0.0)
    return summed.select("key", "parent", "d", "c", (F.col("s") + beyond >= cost * (F.col("d") + 1) * F.log("n")).alias("own"))


def score(docs: DataFrame, depth: int = DEPTH, least_context: int = LEAST_CONTEXT, least_next: int = LEAST_NEXT, cost: float = COST, part: int = PART, ranged: int = RANGE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text).

    Learns from rows whose crc32 of the id as text leaves a remainder other than 0 by 10; the others
    are held out, and so are rows without an id, which have no remainder. Words are lower-cased in
    A-Z and cut at white space; each text ends with one more token. ``base_score`` sums log10 of the
    words' own smoothed probabilities, ``score`` those of the tree; over all words and one unknown
    word, the predictions of each state add up to one. Null and blank texts are the end token alone.
    Repeated rows are each learned from and scored. With nothing to learn from, every token is unknown
    and has probability 1. Other columns are not read; an empty table gives no rows.
    """
    if least_next < 1 or least_context < least_next or depth < 1:
        raise ValueError("a context must be at least as frequent as a next word, and hold a word")
    scratch, limits = Scratch(docs.sparkSession, "suffix-tree"), (least_context, least_next)
    name = F.col("doc_id").cast("long")
    plain = docs.select(name.alias("doc_id"), empty_text().alias("text"), F.coalesce(F.crc32(name.cast("string")) % 10 != 0, F.lit(False)).alias("learned"))
    parts = scratch.save(plain.mapInArrow(_cut(part), _PART))
    found = parts.agg(F.sum("tokens").alias("tokens"), F.sum("learned").alias("learned")).first()
    bits = max(0, math.ceil(math.log2(max(1, found["tokens"] or 0) / ranged)))
    asks = ", ".join(_GIVEN.split(", ")[:5])

    def totals(given: DataFrame) -> DataFrame:
        runs = given.filter(F.col("kind") == RUN).groupBy("depth", "range").applyInArrow(lambda rows: _counts(rows, 1 if rows.column("depth")[0].as_py() == 0 else least_next), _ANSWER)
        return scratch.save(runs, lean=True)

    def entries(given: DataFrame, states: DataFrame, kind: int, columns: list[str]) -> DataFrame:
        of = F.when(F.lit(bits) > 0, F.shiftrightunsigned("key", 64 - bits)).otherwise(0).cast("int") if bits else F.lit(0)
        held = given.filter(F.col("kind") == HOLD).select("bucket", F.lit(kind).alias("kind"), "depth", "range", "blob")
        table = states.select("key", *columns, of.alias("range"))
        return scratch.save(held.groupBy("range").cogroup(table.groupBy("range")).applyInArrow(lambda a, b: _entries(a, b, columns), _ANSWER), lean=True)

    told = totals(parts.mapInArrow(_first_asks(bits), asks))
    size = (found["learned"] or 0, told.filter("depth = 0").agg(F.sum("known")).first()[0] or 0)

    def answered(run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        return parts.groupBy("bucket").cogroup(told.drop("known").groupBy("bucket")).applyInArrow(run, schema)

    given, states = {}, {}
    for d in range(1, depth + 1):
        given[d] = scratch.save(answered(lambda p, a: _statistics(p, a, d, d == depth, bits, limits, size), _GIVEN), lean=True)  # noqa: B023  runs before the next round
        states[d] = scratch.save(_states(given[d], cost), lean=True)
        told = told.unionByName(entries(given[d], states[d], HOLD, ["d", "c"]))
        if d < depth:
            told = told.unionByName(totals(given[d]))
    # a retained context retains its suffixes
    longer: DataFrame | None = None
    for d in range(depth, 0, -1):
        kept = states[d].filter("own").select("key", "parent")
        if longer is not None:
            kept = states[d].select("key", "parent").join(longer.select(F.col("parent").alias("key")).distinct(), "key", "left_semi").unionByName(kept).distinct()
        longer = scratch.save(kept.withColumn("one", F.lit(1).cast("long")))
        told = told.unionByName(entries(given[d], longer, KEEP, ["one"]))
    scratch.drop(*given.values(), *states.values())  # what is told holds all that the scores need
    return answered(lambda p, a: _score(p, a, depth, limits, size), _SCORES)


def nats_per_token(scored: DataFrame) -> DataFrame:
    """held_out, base, tree: mean negative log probabilities of a token, learned texts and others apart."""
    mean = lambda c: (-math.log(10) * F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(mean("base_score").alias("base"), mean("score").alias("tree"))
