"""Tokens of whole documents, attributed to their sections by offsets.

A document is encoded once, as a whole, so that its count is the one training sees. Its tokens' byte
spans are joined with the sections' spans, an interval join of two sorted lists inside the row. The rule
for a token that crosses a boundary: it belongs to the section that holds its first byte. So every
token belongs to exactly one section, and the sections' counts add up to the document's.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import empty_text, per_batch

#: Public byte-level vocabulary: lines of base64 bytes and rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's encoder cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern knows it, in runs from which on its search would need too deep a stack. Such a run is one
#: piece of the pattern, but for its last character where something follows, so it is cut out and encoded as that piece.
LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


class Encoder:
    """A byte-level encoder and the byte length of each of its tokens."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self._encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))

    def starts(self, text: str) -> np.ndarray:
        """The byte at which each token of a text begins."""
        tokens, at = [], 0
        for blank in LONG_BLANK.finditer(text):
            end = blank.end() - (blank.end() < len(text))
            tokens += self._encoding.encode_ordinary(text[at : blank.start()])
            tokens += self._encoding._encode_single_piece(text[blank.start() : end])
            at = end
        tokens += self._encoding.encode_ordinary(text[at:])
        sizes = self.sizes[np.asarray(tokens, np.int64)]
        return np.cumsum(sizes) - sizes


def sections_of(data: bytes) -> np.ndarray:
    """Byte positions at which the sections of a text begin: its lines, each with its line end."""
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.concatenate([np.zeros(1, np.int64), breaks[breaks < len(data)]])


def attribute(token_starts: np.ndarray, section_starts: np.ndarray) -> np.ndarray:
    """Tokens of each section, a token counting where it begins."""
    bounds = np.searchsorted(token_starts, section_starts, "left")
    return np.diff(np.concatenate([bounds, [len(token_starts)]]))


def code_points(data: bytes, at: np.ndarray) -> np.ndarray:
    """Code-point positions of byte positions that begin a character."""
    raw = np.frombuffer(data, np.uint8)
    heads = np.concatenate([np.zeros(1, np.int64), np.cumsum((raw & 0xC0) != 0x80)])
    return heads[at]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, sections for each row of ``docs`` (doc_id, text).

    ``sections`` lists (start, end, n_tokens) of each line of the text, in code points, ends
    exclusive and line ends included. Null and empty texts have no tokens and no sections; blank lines
    are sections. A character that the encoder cuts into several tokens gives all of them to its own
    section. Rows that repeat are each counted, null ids are carried, other columns are not read.
    ``vocabulary`` is read by Spark, so any path that the cluster reads will do. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = vocabulary if ":" in vocabulary else f"file://{vocabulary}"
    data = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    shared = spark.sparkContext.broadcast(bytes(data))
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)

        def rate(batch: pa.RecordBatch) -> pa.RecordBatch:
            total, parts = [], []
            for text in batch.column("text").to_pylist():
                raw = text.encode()
                starts = encoder.starts(text)
                total.append(len(starts))
                if not raw:
                    parts.append([])
                    continue
                begin = sections_of(raw)
                at = code_points(raw, np.concatenate([begin, [len(raw)]])).tolist()
                parts.append([{"start": a, "end": b, "n_tokens": n} for a, b, n in zip(at[:-1], at[1:], attribute(starts, begin).tolist(), strict=True)])
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(parts, kinds)], names=["doc_id", "n_tokens", "sections"])

        yield from per_batch(rate)(batches)

    plain = docs.select("doc_id", empty_text().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, n_tokens long, sections array<struct<start: long, end: long, n_tokens: long>>")


def section_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, section, start_char, end_char, n_tokens, doc_tokens): a row for each section of each document."""
    counted = count_tokens(docs, vocabulary)
    rows = counted.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.posexplode("sections").alias("section", "s"))
    return rows.select("doc_id", F.col("section").cast("long").alias("section"), F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), F.col("s.n_tokens").alias("n_tokens"), "doc_tokens")
