"""Shared pieces of the corpus operators: scratch tables, Arrow slices, word hashes, key tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.session import checkpoint_dir

#: Text rows taken from an Arrow batch at a time, so that Python objects stay few.
ROWS = 128
#: Spark's setting that removes a statement's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a text hashed at a time, and the longest word hashed by powers.
PIECE, LONG_WORD = 1 << 16, 4096


class Scratch:
    """Tables written below the shared checkpoint folder; an executor's loss costs a read only.

    ``save`` writes a table and reads it back, which also cuts its lineage; ``drop`` removes one
    that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._next = 0

    def save(self, df: DataFrame, lean: bool = False) -> DataFrame:
        """With ``lean``, the shuffle files of the work behind the table go as soon as it is written."""
        path = f"{self.root}/{self._next}"
        self._next += 1
        before = self.spark.conf.get(_CLEANUP)
        try:
            self.spark.conf.set(_CLEANUP, "true" if lean else before)
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._scratch_path = path  # keeps the place with the table
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table in tables:
            place = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def per_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that works on small slices of its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = make(part)
            if out is not None and out.num_rows:
                yield out

    return run


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


# Word hashes -----------------------------------------------------------------------------------

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finish of a 64-bit hash: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(_U(seed) + np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2^64
_CODES = stream(11, 256)
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
_CACHE: dict[str, np.ndarray] = {}


def _powers(name: str, base: int) -> np.ndarray:
    if name not in _CACHE:
        with np.errstate(over="ignore"):
            _CACHE[name] = np.cumprod(np.concatenate([np.ones(1, _U), np.full(PIECE, base & (2**64 - 1), _U)]))
    return _CACHE[name]


def _long_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word.translate(_LOWER), digest_size=8).digest(), "little")


def _piece_hashes(raw: np.ndarray, gap: np.ndarray, data: bytes, at: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([np.ones(1, bool), gap, np.ones(1, bool)]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, _U), start
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(_CODES[raw] * _powers("up", _BASE)[: len(raw)], dtype=_U)])
        out = mix((total[end] - total[start]) * _powers("down", pow(_BASE, -1, 2**64))[start] + (end - start).astype(_U))
    for i in np.flatnonzero(end - start > LONG_WORD):
        out[i] = _long_hash(data[at + start[i] : at + end[i]])
    return out, start + at


def _heads(gap: np.ndarray, size: int) -> np.ndarray:
    """The gaps of a piece, widened to what lies beyond the first ``size`` bytes of each word."""
    at = np.arange(len(gap))
    return gap | (at - np.maximum.accumulate(np.where(gap, at, -1)) > size)


def words_at(data: bytes, blanks: np.ndarray = BLANKS, head: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the byte position of each word; A-Z count as a-z. Works in pieces of the text.

    With ``head``, the hash is of the first ``head`` bytes of each word.
    """
    raw = np.frombuffer(data, np.uint8)
    gap, out, at, n = blanks[raw], [], 0, len(raw)
    while at < n:
        stop = min(at + PIECE, n)
        if stop < n and not gap[stop]:
            last = np.flatnonzero(gap[at:stop])
            if len(last):
                stop = at + int(last[-1]) + 1
            else:  # one word longer than a piece
                while stop < n and not gap[stop]:
                    more = np.flatnonzero(gap[stop : stop + PIECE])
                    stop = stop + int(more[0]) if len(more) else min(stop + PIECE, n)
                if head:
                    out.append(_piece_hashes(raw[at : at + head], gap[at : at + head], data, at))
                else:
                    out.append((np.array([_long_hash(data[at:stop])], _U), np.array([at])))
                at = stop
                continue
        own = gap[at:stop]
        out.append(_piece_hashes(raw[at:stop], _heads(own, head) if head else own, data, at))
        at = stop
    if not out:
        return np.empty(0, _U), np.empty(0, np.int64)
    hashes, starts = zip(*out, strict=True)
    return np.concatenate(hashes), np.concatenate(starts)


def word_hashes(data: bytes, blanks: np.ndarray = BLANKS) -> np.ndarray:
    return words_at(data, blanks)[0]


def many_word_hashes(datas: list[bytes], blanks: np.ndarray = BLANKS, head: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts in a row, and the bounds of each text's words among them."""
    ends = np.cumsum([len(d) + 1 for d in datas])
    hashes, starts = words_at(b" ".join(datas), blanks, head)
    return hashes, np.concatenate([np.zeros(1, np.int64), np.searchsorted(starts, ends)])


def runs_hash(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words; for fewer words, one of the whole sequence."""
    n = len(words)
    if not n:
        return np.empty(0, _U)
    size = min(width, n)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, size, _U)
        for i in range(size):
            out = out * _U(0xD6E8FEB86659FD93) + words[i : n - size + 1 + i]
        return mix(out)


def shingle_set(data: bytes, width: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(runs_hash(word_hashes(data), width))


def shingle_sets(datas: list[bytes], width: int = 5) -> list[np.ndarray]:
    """``shingle_set`` of several texts."""
    hashes, bounds = many_word_hashes(datas)
    return [np.unique(runs_hash(hashes[a:b], width)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
