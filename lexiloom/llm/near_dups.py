"""Near-duplicate documents by a multi-index Hamming join over b-bit minwise signatures.

A document's set holds its distinct 5-word shingles. Each set gets a signature of symbols of b
bits (one permutation split into bins, empty bins filled from the full ones by a fixed minwise
choice). The first ``INDEX`` symbols are cut into chunks. With at most ``radius`` differing symbols
in all, the pigeonhole principle leaves one chunk within its share of errors, so every chunk gives a
key for each choice of that many symbols left out: **every pair whose signatures differ in at most
``radius`` symbols meets under a key**. A pair of similarity 0.75 differs in a quarter of the symbols
on average; the radius is four standard deviations above that.

Meeting pairs are compared on a longer signature, then confirmed on their whole sets. Work on groups
of copies stays linear: equal sets are one class; members of a key are first tied to one centre; what
these links join needs no more comparison; in key groups that still hold several components, the
members outside the largest one are compared with the rest, in tiles of bounded size that skip set
sizes which exclude the similarity. A tile confirms its pairs on whole sets and unites as it goes, so
it gives no more links than it has members, however many pairs are alike.

Signatures of small sets vary more than the radius allows for. Sets of up to ``SMALL`` shingles also
get a key for each of their first shingles by hash, as many as two sets of the similarity cannot both
lack (prefix filtering), and pairs of them are not judged by signatures: all their links are found.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import Scratch, empty_text, fresh, mix, per_batch, shingle_set, shingle_sets, signed, stream, texts

WIDTH, PERCENT = 5, 75
#: Symbols of the long signature, of its indexed part, of a chunk.
SYMBOLS, INDEX, CHUNK = 256, 64, 4
#: Standard deviations between the mean distance at the similarity bound and the radius.
MARGIN = 4.0
#: Shingles of a set that has keys by shingle; pairs whose smaller set is this small meet under them.
SMALL = 40
SMALL_PAIR = SMALL * PERCENT // 100
#: Members of a tile of a key group, and shingles of its members.
TILE, TILE_SHINGLES = 1024, 400_000

#: Bytes of a signature: two for each indexed symbol, one for each other.
BYTES = 2 * INDEX + SYMBOLS - INDEX

_U = np.uint64
_RANK = stream(23, SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS)


def radius(symbols: int, percent: int = PERCENT) -> int:
    """The signature distance under which pairs are guaranteed to meet."""
    p = 1 - percent / 100
    return int(np.ceil(symbols * p + MARGIN * np.sqrt(symbols * p * (1 - p))))


def chunk_errors(symbols: int = INDEX, chunk: int = CHUNK, within: int | None = None) -> list[int]:
    """Allowed errors of each chunk: their sum, with one more for each chunk, exceeds the radius."""
    within = radius(symbols) if within is None else within
    chunks = symbols // chunk
    low, rest = divmod(within + 1, chunks)
    return [low - (i >= rest) for i in range(chunks)]


def patterns(symbols: int = INDEX, chunk: int = CHUNK) -> list[tuple[int, tuple[int, ...]]]:
    """(key kind, symbols that must be equal) for every chunk and every choice of errors."""
    out: list[tuple[int, tuple[int, ...]]] = []
    for i, errors in enumerate(chunk_errors(symbols, chunk)):
        if errors >= 0:
            out += [(len(out) + k, kept) for k, kept in enumerate(combinations(range(i * chunk, (i + 1) * chunk), chunk - errors))]
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` 64-bit symbols of a sorted, non-empty set of hashes."""
    bins = np.arange(SYMBOLS, dtype=_U) << _U(56)
    at = np.searchsorted(shingles, bins)
    first = shingles[np.minimum(at, len(shingles) - 1)]
    full = (at < len(shingles)) & ((first >> _U(56)) == np.arange(SYMBOLS, dtype=_U))
    if not full.all():
        have, lack = np.flatnonzero(full), np.flatnonzero(~full)
        first = first.copy()
        first[lack] = first[have[np.argmin(_RANK[np.ix_(lack, have)], axis=1)]]
    return mix(first + np.arange(SYMBOLS, dtype=_U) * _U(0x9E3779B97F4A7C15))


_PATTERNS = patterns()
_SALT = stream(31, len(_PATTERNS))
#: One row per pattern, one at the symbols it keeps.
_KEPT = np.array([[i in kept for i in range(INDEX)] for _, kept in _PATTERNS], np.uint8)


def keys(symbols: np.ndarray) -> np.ndarray:
    """The keys of each signature: one row per signature, one column per pattern. Only 16 bits of a symbol count."""
    out = np.empty((len(symbols), len(_PATTERNS)), _U)
    short = symbols[:, :INDEX] & _U(0xFFFF)
    with np.errstate(over="ignore"):
        for kind, kept in _PATTERNS:
            x = np.full(len(symbols), _SALT[kind], _U)
            for i in kept:
                x = x * _U(0xD6E8FEB86659FD93) + short[:, i]
            out[:, kind] = x
    return mix(out)


def packed(symbols: np.ndarray) -> list[bytes]:
    """Signatures as bytes: 16 bits of each indexed symbol, then 8 bits of each other one."""
    head = symbols[:, :INDEX].astype(np.uint16).view(np.uint8)
    return [row.tobytes() for row in np.hstack([head, symbols[:, INDEX:].astype(np.uint8)])]


def first_shingles(shingles: np.ndarray) -> np.ndarray:
    """Keys of a small sorted set: any two sets of the similarity have one in common, if both are small."""
    n = len(shingles)
    return mix(shingles[: n - -(-PERCENT * n // 100) + 1] + _U(0xA5A5)) if n <= SMALL else np.empty(0, _U)


class Signatures:
    """Packed signatures of many sets, for comparison."""

    def __init__(self, column: list[bytes]):
        raw = np.frombuffer(b"".join(column), np.uint8).reshape(-1, BYTES)
        self.head, self.tail = np.ascontiguousarray(raw[:, : 2 * INDEX]).view(np.uint16), raw[:, 2 * INDEX :]

    def apart(self, other: Signatures, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        """Differing symbols of the pairs (i, j)."""
        return (self.head[i] != other.head[j]).sum(axis=1) + (self.tail[i] != other.tail[j]).sum(axis=1)

    def first_kind(self, i: int, j: np.ndarray) -> np.ndarray:
        """The first pattern under which each pair (i, j) meets."""
        equal = (self.head[i] == self.head[j]).astype(np.uint8)
        return np.argmax(equal @ _KEPT.T == _KEPT.sum(axis=1, dtype=np.uint8), axis=1)


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit name of a whole set: equal sets, and in practice no others, share it."""
    with np.errstate(over="ignore"):
        spread = mix(shingles + _U(len(shingles)))
        total, cross = spread.sum(dtype=_U), np.bitwise_xor.reduce(mix(spread))
        return int(signed(mix(np.array([total * _U(3) + cross], _U)))[0])


_SKETCH = pa.schema([("doc_id", pa.int64()), ("whole", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = shingle_sets(texts(batch.column("text")))
    full = [i for i, x in enumerate(sets) if len(x)]
    node, sig, key = ([None] * len(sets) for _ in range(3))
    if full:
        symbols = np.stack([signature(sets[i]) for i in full])
        for i, *rest in zip(full, packed(symbols), signed(keys(symbols)), strict=True):
            node[i], sig[i], key[i] = set_id(sets[i]), rest[0], np.concatenate([rest[1], signed(first_shingles(sets[i]))])
    columns = [batch.column("doc_id"), batch.column("whole"), pa.array([len(x) for x in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(key, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, schema=_SKETCH)


# Confirming ------------------------------------------------------------------------------------


def _confirm(batch: pa.RecordBatch) -> pa.RecordBatch:
    left, right = texts(batch.column("text_a")), texts(batch.column("text_b"))
    good = np.zeros(batch.num_rows, bool)
    last: tuple[bytes, np.ndarray] = (b"", np.empty(0, _U))
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        if last[0] != b:
            last = (b, shingle_set(b))
        x, y = shingle_set(a), last[1]
        both = len(np.intersect1d(x, y, assume_unique=True))
        good[i] = 100 * both >= PERCENT * (len(x) + len(y) - both)
    out = batch.select(["a", "b"])
    return pa.RecordBatch.from_arrays([*out.columns, pa.array(good)], names=["a", "b", "good"])


def _far(batch: pa.RecordBatch, within: int) -> pa.RecordBatch:
    a, b = Signatures(batch.column("sig_a").to_pylist()), Signatures(batch.column("sig_b").to_pylist())
    every = np.arange(batch.num_rows)
    apart = a.apart(b, every, every)
    keep = (apart <= within) | (batch.column("n").to_numpy() <= SMALL_PAIR)
    out = batch.select(["a", "b"]).filter(pa.array(keep))
    return pa.RecordBatch.from_arrays([*out.columns, pa.array(apart[keep].astype(np.int32))], names=["a", "b", "apart"])


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose long signatures are within the radius; sets of incompatible sizes go first."""
    within = radius(SYMBOLS, percent)
    side = nodes.select("node", "sig", "n_shingles")
    both = (
        pairs.join(side.toDF("a", "sig_a", "n_a"), "a")
        .join(side.toDF("b", "sig_b", "n_b"), "b")
        .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    )
    return both.select("a", "b", "sig_a", "sig_b", F.least("n_a", "n_b").alias("n")).mapInArrow(per_batch(lambda batch: _far(batch, within)), "a long, b long, apart int")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, good) for each pair, from the whole sets."""
    both = pairs.select("a", "b").join(sets.toDF("a", "text_a"), "a").join(sets.toDF("b", "text_b"), "b")
    return both.mapInArrow(per_batch(_confirm), "a long, b long, good boolean")


# Components ------------------------------------------------------------------------------------


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the least node reachable, for every node that has a link.

    Labels spread over links and are shortened by looking up the label of the label, so the number
    of rounds grows with the logarithm of the longest path. Nothing is gathered on the driver.
    """
    edges = scratch.save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        offered = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        hooked = labels.join(offered, "node").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        jump = labels.toDF("label", "further")
        after = scratch.save(hooked.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        scratch.drop(labels)
        labels = after.select("node", "label")
        labels._scratch_path = after._scratch_path
        if after.filter("old <> label").isEmpty():
            scratch.drop(edges)
            return labels


# Key groups that hold several components -------------------------------------------------------


def _tile(batch: pa.Table, within: int, percent: int) -> pa.Table:
    """Links of two tiles of one key group that join members not joined before: fewer than there are members.

    Pairs within the radius are confirmed on their whole sets, under the first key that they share;
    members that are joined already, by earlier links or by this tile's, are not compared.
    """
    node, label, size, asks = (batch.column(c).to_numpy() for c in ("node", "label", "n_shingles", "asks"))
    kind, bodies = batch.column("kind")[0].as_py(), batch.column("text")
    sig = Signatures(batch.column("sig").to_pylist())
    names, group = np.unique(label, return_inverse=True)
    root = np.arange(len(names))  # the group that each label's members are in, kept flat
    sets: dict[int, np.ndarray] = {}

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set((bodies[i].as_py() or "").encode())
        return sets[i]

    cols = np.flatnonzero(asks == 0)
    a, b = [], []
    for i in np.flatnonzero(asks == 1):
        fits = (root[group[cols]] != root[group[i]]) & (100 * np.minimum(size[cols], size[i]) >= percent * np.maximum(size[cols], size[i]))
        at = cols[fits]
        small = np.minimum(size[at], size[i]) <= SMALL_PAIR
        if len(at):
            near = small | (sig.apart(sig, i, at) <= within)
            at, small = at[near], small[near]
        if len(at):
            at = at[small | (sig.first_kind(i, at) == kind)]
        for j in at.tolist():
            if root[group[i]] == root[group[j]]:
                continue
            x, y = shingles(i), shingles(j)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                a.append(min(node[i], node[j]))
                b.append(max(node[i], node[j]))
                root[root == root[group[j]]] = root[group[i]]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _open_links(keyed: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, tile: int, scratch: Scratch) -> DataFrame:
    """Links between members that share a key and lie in different components, by tiles of each key group.

    The members outside a group's largest component ask; all members answer. Askers and answerers of
    a group are cut into tiles by set size (bands a factor of 100 / percent apart, of which only
    neighbours can hold similar sets) and by a hash, and every pair of tiles is a task's small group.
    """
    member = keyed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("key", "kind", "node", "label")
    counted = member.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = counted.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.count("*").alias("labels")).filter("labels > 1").select("key", "major")
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    held = member.join(mixed, "key").join(nodes.select("node", "n_shingles"), "node").withColumn("band", band).withColumn("minor", (F.col("label") != F.col("major")).cast("int"))
    held = scratch.save(held.select("key", "kind", "node", "label", "n_shingles", "band", "minor"), lean=True)
    full = lambda one: F.ceil(F.greatest(F.sum(one) / tile, F.sum(one * F.col("n_shingles")) / TILE_SHINGLES)).cast("int")
    counts = scratch.save(held.groupBy("key", "band").agg(full(F.lit(1)).alias("tiles"), full(F.col("minor")).alias("asking")))
    asking = counts.filter("asking > 0").select("key", F.col("band").alias("ask_band"), F.explode(F.expr("sequence(0, asking - 1)")).alias("ask_tile"))
    giving = counts.select("key", F.col("band").alias("give_band"), F.explode(F.expr("sequence(0, tiles - 1)")).alias("give_tile"))
    units = scratch.save(asking.join(giving, "key").filter("abs(ask_band - give_band) <= 1"))
    of_tile = lambda tiles: F.pmod(F.xxhash64("node", "key"), F.col(tiles)).cast("int")
    placed = held.join(counts, ["key", "band"])
    columns = ["key", "kind", "node", "label", "n_shingles", "minor", "ask_band", "ask_tile", "give_band", "give_tile", "asks"]
    gives = placed.withColumnRenamed("band", "give_band").withColumn("give_tile", of_tile("tiles")).join(units, ["key", "give_band", "give_tile"]).withColumn("asks", F.lit(0)).select(columns)
    asks = placed.filter("minor = 1").withColumnRenamed("band", "ask_band").withColumn("ask_tile", of_tile("asking")).join(units, ["key", "ask_band", "ask_tile"]).withColumn("asks", F.lit(1)).select(columns)
    rows = gives.unionByName(asks).join(nodes.select("node", "sig"), "node").join(sets, "node")
    within = radius(SYMBOLS, percent)
    return rows.groupBy("key", "ask_band", "ask_tile", "give_band", "give_tile").applyInArrow(lambda t: _tile(t, within, percent), "a long, b long")


# The operator ----------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document of ``docs`` (doc_id, text).

    Null and blank texts have no shingles and are their own component. Rows that repeat both doc_id
    and the set of shingles give one row. Rows with a null doc_id are returned unlinked, with null
    component_id and kept false. A doc_id with several texts has a row per set, each with its own
    component. Other columns are not read. An empty table gives no rows. A similarity above
    ``percent`` is asked for by raising it; the signature index is built for 0.75 and more.
    """
    rows = _classed(docs, percent, tile).select("doc_id", "n_shingles", "node", "component_id").distinct()
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _classed(docs: DataFrame, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """(doc_id, whole, n_shingles, node, component_id) of each row: its text's hash, its set, and its component."""
    if percent < PERCENT:
        raise ValueError("the index guarantees a similarity of 0.75 and more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dups")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text")).withColumn("whole", F.xxhash64("text"))
    sketch = scratch.save(plain.mapInArrow(per_batch(_sketch), "doc_id long, whole long, n_shingles long, node long, sig binary, keys array<long>"))
    plain = plain.drop("whole")
    filled = sketch.filter("node is not null and doc_id is not null")
    # one row per class of equal sets; sig and keys follow from the set, so any copy's will do
    nodes = scratch.save(filled.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("keys").alias("keys")), lean=True)
    keyed = nodes.select("node", F.posexplode("keys").alias("kind", "key"))
    met = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1").select("key", "centre")
    shared = scratch.save(keyed.join(met, "key"), lean=True)
    stars = shared.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    near = scratch.save(_near(stars, nodes, percent), lean=True)
    # texts of all classes that share a key with another, by any of their documents
    wanted = shared.groupBy("node").agg(F.first("centre").alias("_")).join(nodes.select("node", "doc_id"), "node").select("node", "doc_id")
    sets = scratch.save(_texts_of(wanted, plain), lean=True)

    best = near.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    tried = scratch.save(_links(best, sets), lean=True)
    labels = components(tried.filter("good"), scratch)
    open_stars = _between(near.join(tried.select("a", "b"), ["a", "b"], "left_anti").select("a", "b"), labels)
    more = scratch.save(_links(open_stars, sets), lean=True)
    good = tried.filter("good").select("a", "b").union(more.filter("good").select("a", "b"))
    labels = components(good, scratch)
    last = scratch.save(_open_links(shared.select("key", "kind", "node"), nodes, sets, labels, percent, tile, scratch), lean=True)
    labels = components(good.union(last), scratch)
    scratch.drop(sets, shared, near)

    # the least doc_id of each component, through its classes
    named = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(least, "label").select("node", "component_id")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return sketch.select("doc_id", "whole", "n_shingles", "node").join(of_node, "node", "left").withColumn("component_id", component)


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    return (
        pairs.join(labels.toDF("a", "label_a"), "a", "left")
        .join(labels.toDF("b", "label_b"), "b", "left")
        .filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
        .select("a", "b")
    )


def _texts_of(wanted: DataFrame, plain: DataFrame) -> DataFrame:
    """(node, text) of one document per wanted class. A doc_id may have several texts: the set decides."""

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [len(s) and set_id(s) for s in shingle_sets(texts(batch.column("text")))]
        keep = pa.array([n == o for n, o in zip(batch.column("node").to_pylist(), own, strict=True)])
        return batch.select(["node", "text"]).filter(keep)

    joined = plain.join(wanted, "doc_id").select("node", "text")
    return joined.mapInArrow(per_batch(pick), "node long, text string").dropDuplicates(["node"])


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are the first of their component, with all their columns.

    The first is the set of the least doc_id, and of several sets under this id the one of least
    hash; all rows of that id and that set stay. Rows with a null doc_id or without words stay, as
    they are linked with nothing.
    """
    found = _classed(docs).filter("doc_id is not null and node is not null")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("_first"))
    gone = found.join(first, "component_id").filter((F.col("doc_id") != F.col("_first.doc_id")) | (F.col("node") != F.col("_first.node")))
    name, whole = (fresh(docs, c) for c in ("_gone_id", "_gone_text"))
    gone = gone.select(F.col("doc_id").alias(name), F.col("whole").alias(whole)).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone[name]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == gone[whole]), "left_anti")
