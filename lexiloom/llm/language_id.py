"""Language of whole texts by compression: the language whose dictionary codes the text shortest.

Each language gets a raw-content dictionary for zstandard, made of up to ``DICTIONARY_BYTES`` of sample
texts; of a text longer than its share, pieces spread evenly over the whole text are kept. A text is
compressed with each dictionary; the least size wins. A text longer than a window is compressed window
by window, each coded afresh and the sizes summed, as a coder that had read much of a text would know its
words from there, and the margin between the languages would shrink with its length. Texts and dictionaries are lower-cased and
all that is no letter becomes one space first, so that shouting and decoration do not hide the words.
Code lengths are turned into a confidence; very short texts, whose sizes tie, are told apart by how
many of their words the dictionaries hold. A narrow relative margin of the code lengths rejects the
text, and so does a lead of a few bytes, the step of short codes, unless known words support it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import empty_text, per_batch

#: The sample that a dictionary is made of: training texts per language, and bytes kept of them.
SAMPLE_TEXTS, DICTIONARY_BYTES = 64, 112 << 10
LEVEL = 5
#: Bytes of a text that are compressed at a time, and of a piece of a longer sample text.
WINDOW, PIECE = 8 << 10, 1 << 10
#: Bits of code length per unit of log-odds: below 1, as neighbouring bytes of a text repeat evidence.
SHARPNESS = 0.25
#: A text is rejected when its best code is shorter than the next by less than this share of the next one.
LEAST_MARGIN = 0.02
#: The lead must also be so many bytes. Codes below a length are short and pass without either when the
#: best language knows this share of the words and more of them than any other.
LEAST_LEAD, SHORT_CODE, KNOWN_SHARE = 6, 300, 0.5
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def plain_words(text: str) -> bytes:
    """Lower-case letters of a text, runs of anything else as one space; empty without a letter."""
    out = _OTHER.sub(" ", text.lower())
    return b"" if out in ("", " ") else out.encode()


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: remainder 2 of the checksum of their id by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def training_texts(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> list[tuple[str, str]]:
    """(lang, text): up to ``texts`` whole texts of each learned language, in a fixed order.

    Each language's training documents are dealt over ``texts`` cells by a hash of the id and each
    cell keeps its least one, so the pick is a plain partial aggregate of ids; the few texts are read
    by a second scan. The sample is bounded by ``texts`` documents for each distinct lang.
    """
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = usable.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id", "lang")
    cells = usable.groupBy("lang", F.pmod(order, F.lit(texts)).alias("cell")).agg(F.min(F.struct(order.alias("order"), F.col("doc_id").alias("doc_id"))).alias("first"))
    chosen = cells.select("lang", "first.order", "first.doc_id")
    found = usable.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "order").agg(F.min("text").alias("text")).collect()
    return [(r["lang"], r["text"]) for r in sorted(found, key=lambda r: (r["lang"], r["order"]))]


def spread_pieces(text: bytes, size: int, piece: int = PIECE) -> bytes:
    """``size`` bytes of a text at most: the whole of it, or pieces at even distances from its begin to its end."""
    if len(text) <= size:
        return text
    count = max(1, size // piece)
    width = max(0, size - (count - 1)) // count
    starts = [i * (len(text) - width) // max(1, count - 1) for i in range(count)]
    return b" ".join(text[a : a + width] for a in starts)


def dictionaries(samples: list[tuple[str, str]], size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Per language, an even share of every sample text; what shorter texts leave goes to longer ones."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in samples:
        by_lang.setdefault(lang, []).append(plain_words(text))
    out: dict[str, bytes] = {}
    for lang, own in sorted(by_lang.items()):
        left, pieces = size, []
        for i, text in enumerate(sorted(own, key=len)):
            share = spread_pieces(text, left // (len(own) - i))
            pieces.append(share)
            left -= len(share)
        out[lang] = b" ".join(pieces)
    return out


class Coders:
    """The compressors of the learned languages, by name; made once per task."""

    def __init__(self, learned: dict[str, bytes]):
        self.names = sorted(learned)
        self._coders = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(learned[name] or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self._coders.append(zstandard.ZstdCompressor(dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False))
        self._words = [frozenset(learned[name].split()) for name in self.names]

    def rate(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, confidence, relative margin of the code lengths, rejected) of a text."""
        data = plain_words(text or "")
        if not data or not self.names:
            return UNKNOWN, 0.0, 0.0, True
        parts = [data[a : a + WINDOW] for a in range(0, len(data), WINDOW)]
        sizes = np.array([sum(len(coder.compress(part)) for part in parts) for coder in self._coders], np.float64)
        weight = np.exp2(-8 * SHARPNESS * (sizes - sizes.min()))
        short = sizes.min() < SHORT_CODE
        tied = (sizes == sizes.min()).sum() > 1
        words = data.split() if short or tied else []
        known = np.array([sum(w in own for w in words) for own in self._words])
        if tied:
            weight *= 1 + known
        best = int(np.argmax(weight))
        others = np.delete(sizes, best)
        if not len(others):
            return self.names[best], 1.0, 1.0, False
        lead = others.min() - sizes[best]
        margin = float(lead / others.min())
        passes = margin >= LEAST_MARGIN and lead >= LEAST_LEAD
        if short and not passes:
            passes = known[best] >= KNOWN_SHARE * len(words) and known[best] > np.delete(known, best).max()
        return self.names[best], float(weight[best] / weight.sum()), margin, not bool(passes)


def predict(docs: DataFrame, learned: dict[str, bytes]) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, lang_pred, score, margin, rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Coders(learned)

        def rate(batch: pa.RecordBatch) -> pa.RecordBatch:
            rated = [coders.rate(text) for text in batch.column("text").to_pylist()]
            lang, score, margin, rejected = zip(*rated, strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (lang, score, margin, rejected))], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

        yield from per_batch(rate)(batches)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text"))
    return plain.mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected: one row for every row of ``docs``.

    Learns from lang and text of documents that are not held out; a prediction reads the text only.
    Null, empty or letterless text is ``und`` with score 0 and rejected; with no learned language
    every text is ``und``; with a single one nothing else is rejected, as there is no margin. Equal sizes: the first
    language by name. A null doc_id is not held out and not learned from. Repeated rows are each
    predicted. Other columns are not read.
    """
    out = predict(docs, dictionaries(training_texts(docs)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose language is not rejected, with all their columns.

    Each row's own text decides inside the scan, so there is no join, and rows that repeat an id
    with different texts are judged apart.
    """
    learned = dictionaries(training_texts(docs))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Coders(learned)
        good = lambda batch: pa.array([not coders.rate(t)[3] for t in batch.column(place).to_pylist()], pa.bool_())
        yield from per_batch(lambda batch: batch.filter(good(batch)))(batches)

    return docs.mapInArrow(run, docs.schema)
