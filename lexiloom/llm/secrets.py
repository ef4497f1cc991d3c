"""Secrets in whole texts: fixed patterns, and runs of high Shannon entropy.

Candidate strings are unbroken runs of an alphabet. A window slides over each; the counts of its
characters change by one in and one out, and with them the sum of c log2 c, so entropy costs a constant
step per character. Windows above the bound of their character class are merged to spans. An
allow-list suppresses what is known to be harmless; it never suppresses the fixed patterns.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import empty_text, per_batch

# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: Per character class of the entropy search: candidate runs, window, bound in bits per character.
CLASSES = {
    "entropy_hex": (re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])"), 32, 3.2),
    "entropy_base64": (re.compile(r"(?<![0-9A-Za-z+/_=-])[0-9A-Za-z+/_=-]{24,}"), 24, 3.9),
}
#: A span is suppressed when all parts between signs that it touches are harmless: inside a UUID or a named digest,
#: words with at most four digits behind, parts that hold a listed word; or when all are numbers.
HARMLESS = re.compile(r"(?<![0-9a-f])[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}(?![0-9a-f])|sha(?:256|384|512)-[0-9a-z+/_=-]+", re.IGNORECASE)
PART, WORD = re.compile(r"[^-_/=+]+"), re.compile(r"([A-Za-z]*)[0-9]{0,4}")
ALLOWED_WORDS = ("example", "placeholder", "xxxxxx", "0123456789")
#: Letters are a word when they are few, or change case seldom; a piece longer than the last number must also be pronounceable.
PIECE, CONSONANTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), re.compile(r"[b-df-hj-np-tv-xz]{5}")
FEW_LETTERS, LEAST_PIECE, LONG_PIECE = 8, 4.0, 20


def windows(run: str, width: int, bound: float) -> Iterator[tuple[int, int]]:
    """Merged (start, end) of the windows of ``run`` whose entropy reaches ``bound`` bits per character."""
    counts: dict[str, int] = {}
    weight = [0.0, 0.0, *(c * math.log2(c) for c in range(2, width + 2))]
    total, begin, end = 0.0, -1, -1
    for i, char in enumerate(run):
        c = counts.get(char, 0)
        total += weight[c + 1] - weight[c]
        counts[char] = c + 1
        if i >= width:
            old = run[i - width]
            c = counts[old]
            total += weight[c - 1] - weight[c]
            counts[old] = c - 1
        if i >= width - 1 and math.log2(width) - total / width >= bound - 1e-9:
            start = i - width + 1
            if start > end:
                if begin >= 0:
                    yield begin, end
                begin = start
            end = i + 1
    if begin >= 0:
        yield begin, end


def is_word(part: str) -> bool:
    found = WORD.fullmatch(part)
    if not found or len(found[1]) <= FEW_LETTERS:
        return bool(found)
    pieces = PIECE.findall(found[1])
    return len(found[1]) >= LEAST_PIECE * len(pieces) and not any(len(x) > LONG_PIECE and CONSONANTS.search(x.lower()) for x in pieces)


class Parts:
    """The parts of a run between its signs. Each is judged once, however many spans touch it."""

    def __init__(self, text: str, run: tuple[int, int]):
        self._text = text
        self._ranges = [m.span() for m in HARMLESS.finditer(text, max(0, run[0] - 7), run[1])]
        self._parts = [m.span() for m in PART.finditer(text, *run)]
        self._starts, self._ends = [a for a, _ in self._parts], [b for _, b in self._parts]
        self._range_starts = [a for a, _ in self._ranges]
        self._judged: dict[int, tuple[bool, bool]] = {}

    def _judge(self, i: int) -> tuple[bool, bool]:
        """Whether a part is harmless, and whether it is a number."""
        if i not in self._judged:
            start, end = self._parts[i]
            part, at = self._text[start:end], bisect_right(self._range_starts, start) - 1
            inside = at >= 0 and end <= self._ranges[at][1]
            self._judged[i] = (inside or is_word(part) or any(w in part.lower() for w in ALLOWED_WORDS), part.isdigit())
        return self._judged[i]

    def allowed(self, start: int, end: int) -> bool:
        """Whether a span of the run is known to be harmless."""
        touched = [self._judge(i) for i in range(bisect_right(self._ends, start), bisect_left(self._starts, end))]
        return all(harmless for harmless, _ in touched) or all(number for _, number in touched)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and not overlapping within a kind."""
    out: list[tuple[str, int, int]] = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def entropy_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of high-entropy stretches of candidate runs that are not allowed."""
    out: list[tuple[str, int, int]] = []
    for kind, (pattern, width, bound) in CLASSES.items():
        for m in pattern.finditer(text):
            found = [(m.start() + a, m.start() + b) for a, b in windows(m[0], width, bound)]
            parts = Parts(text, m.span()) if found else None
            out += [(kind, a, b) for a, b in found if not parts.allowed(a, b)]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for each row of ``docs``.

    Positions are code points, ends exclusive. Null text is empty: no spans, and the hash of the
    empty string. Rows that repeat are each scanned, null ids are carried, other columns are not read.
    An empty table gives no rows. A text is searched whole, whatever its length.
    """
    kinds = [*KINDS, *CLASSES]

    def rate(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], [], []]
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            more = entropy_spans(text)
            own = [kind for kind, *_ in base]
            every = sorted(base + more, key=lambda s: (s[1], kinds.index(s[0]))) if more else base
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            for column, value in zip(columns, (*map(own.count, KINDS), digest, joined(every), len(more)), strict=True):
                column.append(value)
        kinds_of = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds_of)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    plain = docs.select("doc_id", empty_text().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(per_batch(rate), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")
