"""Suffix-tree scores against a plain model that holds everything in dictionaries."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lexiloom.llm import suffix_tree

END = object()
SCHEMA = "doc_id long, text string, bucket int, score string, lang string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, "x", "en") for i, t in rows], SCHEMA).repartition(parts)


def tokens(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), END]


def learned(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 != 0


class Plain:
    """The same tree in dictionaries of tuples."""

    def __init__(self, rows, depth, least_context, least_next, cost):
        self.depth, runs = depth, Counter()
        for i, text in rows:
            if learned(i):
                t = tokens(text)
                runs.update(tuple(t[j - d : j + 1]) for j in range(len(t)) for d in range(min(depth, j) + 1))
        self.one = {r[0]: n for r, n in runs.items() if len(r) == 1}
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.next, counts = defaultdict(dict), {}
        for size in range(2, depth + 2):
            for r, n in runs.items():
                if len(r) == size and runs[r[:-1]] >= least_context and n >= least_next:
                    self.next[r[:-1]][r[-1]] = n
                    counts[r[:-1]] = runs[r[:-1]]
        self.counts = counts
        self.retained = set()
        for context in sorted(self.next, key=len):
            kept, n = self.next[context], counts[context]
            q = {a: self.chance(context[1:], a) for a in kept}
            gain, rest = sum(m * math.log(m / n / q[a]) for a, m in kept.items()), n - sum(kept.values())
            if rest:
                gain += rest * math.log(rest / n / max(1 - sum(q.values()), 1e-12))
            if gain >= cost * (len(kept) + 1) * math.log(n):
                self.retained |= {context[k:] for k in range(len(context))}

    def chance(self, context, a):
        if not context:
            return (self.one.get(a, 0) + 0.1) / (self.n + 0.1 * (self.v + 1))
        q = self.chance(context[1:], a)
        if context not in self.next:
            return q
        kept, n = self.next[context], self.counts[context]
        left = len(kept) + n - sum(kept.values())
        return (kept.get(a, 0) + left * q) / (n + len(kept))

    def score(self, i, text):
        t = tokens(text)
        base = sum(math.log10(self.chance((), a)) for a in t)
        best = 0.0
        for j, a in enumerate(t):
            context = max((c for d in range(min(self.depth, j) + 1) if not (c := tuple(t[j - d : j])) or c in self.retained), key=len)
            best += math.log10(self.chance(context, a))
        return i, not learned(i), len(t), sum(self.one.get(a, 0) > 0 for a in t), self.n, base, best


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    follows = {w: rng.choices("abcdefghij", k=3) for w in "abcdefghij"}
    out = []
    for i in range(n):
        word, text = rng.choice("abcdefghij"), []
        for _ in range(rng.randint(0, 40)):
            text.append(word.upper() if rng.random() < 0.1 else word)
            word = rng.choice(follows[word]) if len(text) < 2 or text[-2] != "c" else "j"
        out.append((i, " ".join(text)))
    return out


def close(spark, rows, part=suffix_tree.PART, parts=3, **options):
    model = Plain(rows, options.get("depth", 2), options["least_context"], options["least_next"], options.get("cost", suffix_tree.COST))
    found = suffix_tree.score(table(spark, rows, parts), part=part, **options).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    expected = sorted((model.score(i, t) for i, t in rows), key=order)
    found = sorted((tuple(r) for r in found), key=order)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for got, want in zip(found, expected, strict=True):
        assert got[5:] == pytest.approx(want[5:], rel=1e-9, abs=1e-12)
    return model


def test_scores_equal_the_plain_model(spark):
    rows = corpus() + [(500, None), (501, ""), (502, " \t\n"), (None, "a b c d"), (None, None), (503, "unseen ÄPFEL a b"), (3, "a b"), (3, "a b"), (504, "z " * 5000)]
    model = close(spark, rows, least_context=4, least_next=2)
    lengths = Counter(map(len, model.retained))
    assert lengths[1] and lengths[2] and len(model.retained) < len(model.next)
    for context in list(model.next)[:20]:  # predictions add up to one, unknown words included
        assert sum(model.chance(context, a) for a in model.one) + model.chance(context, "never seen") == pytest.approx(1)


def test_longer_contexts_and_many_parts(spark):
    close(spark, corpus(2), part=300, parts=5, depth=3, least_context=3, least_next=1, cost=0.2, ranged=64)


def test_tree_predicts_held_out_texts_better(spark):
    rows = corpus(3, 400)
    found = {r["held_out"]: r for r in suffix_tree.nats_per_token(suffix_tree.score(table(spark, rows), least_context=8, least_next=2)).collect()}
    assert found[True]["tree"] < 0.85 * found[True]["base"]


def test_nothing_to_learn_from(spark):
    assert suffix_tree.score(table(spark, [])).collect() == []
    held = next(i for i in range(100) if not learned(i))
    (row,) = suffix_tree.score(table(spark, [(held, "a b")])).collect()
    assert tuple(row) == (held, True, 3, 0, 0, 0.0, 0.0)
    with pytest.raises(ValueError):
        suffix_tree.score(table(spark, []), least_context=1, least_next=2)
