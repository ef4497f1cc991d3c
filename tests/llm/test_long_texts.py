"""Very long texts: the work stays in proportion and the results those of short texts."""

import os
import random
import time

import duckdb
import numpy as np
import pytest

from lexiloom.llm import language_id, secrets, token_counts, toxicity

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
TABLE = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def encoder():
    with open(token_counts.VOCABULARY, "rb") as file:
        return token_counts.Encoder(file.read())


@pytest.mark.parametrize("unit", [" ", "\n", " \n", "a", "7", "=", "漢"])
def test_five_megabytes_are_encoded(encoder, unit):
    text = unit * (5_000_000 // len(unit.encode()))
    begin = time.time()
    starts = encoder.starts(text)
    assert time.time() - begin < 60
    assert starts[0] == 0 and (np.diff(starts) > 0).all() and starts[-1] < len(text.encode())


@pytest.mark.parametrize("n", [4095, 4096, 4097, 70_001])
def test_long_white_space_is_cut_as_the_pattern_cuts_it(encoder, n):
    for text in (" " * n, "a" + " " * n + "b", "a\n" + "\n" * n + " 　 c" + "\t" * n, " " * n + "\x1c" + " " * n + "d"):
        tokens = encoder._encoding.encode_ordinary(text)
        sizes = encoder.sizes[np.asarray(tokens, np.int64)]
        assert (encoder.starts(text) == np.cumsum(sizes) - sizes).all()


def test_each_part_of_a_run_is_judged_once():
    draw = random.Random(1)
    pieces = [("".join(draw.choices(LETTERS, k=40)), "word" * 5, "12345678901234567890", "f81d4fae-7dec-11d0-a765-00a0c91e6bf6") for _ in range(2_000)]
    run = "/".join(p for four in pieces for p in four)
    begin = time.time()
    found = secrets.entropy_spans(run)
    assert time.time() - begin < 10
    keys, at = [], 0
    for four in pieces:
        keys.append((at, at + 40))
        at += sum(map(len, four)) + 4
    # nearly every random part is found, and no span lies apart from all of them
    met = [any(a < end and b > start for _, a, b in found) for start, end in keys[:50]]
    assert sum(met) >= 45
    starts = np.array([a for a, _ in keys])
    for _, a, b in found:
        near = keys[max(0, int(np.searchsorted(starts, b)) - 1)]
        assert near[0] < b and near[1] > a


def test_parts_are_harmless_inside_a_named_digest():
    digest = "sha256-" + "Qx7" * 14
    text = "see " + digest + "/word"
    parts = secrets.Parts(text, (4, len(text)))
    assert parts.allowed(11, 40) and parts.allowed(4, len(text))
    assert not secrets.Parts("see Qx7aZ9kLmPq2RtVw8Yb3Nc", (4, 26)).allowed(4, 26)


def test_pieces_are_spread_over_a_text():
    text = b"".join(b"%06d " % i for i in range(10_000))
    kept = language_id.spread_pieces(text, 10_000, 1_000)
    assert 9_000 <= len(kept) <= 10_000
    assert kept.startswith(text[:900]) and kept.endswith(text[-900:])
    assert language_id.spread_pieces(text, len(text)) == text
    assert len(language_id.spread_pieces(text, 500, 1_000)) == 500
    assert language_id.spread_pieces(text, 0) == b""


@pytest.mark.skipif(not os.path.exists(TABLE), reason="needs the given tables")
def test_long_texts_of_learned_languages_are_not_rejected():
    rows = duckdb.sql(f"SELECT doc_id, lang, text FROM '{TABLE}' WHERE lang IS NOT NULL AND text IS NOT NULL ORDER BY doc_id").fetchall()
    learned: dict[str, list[str]] = {}
    unseen: dict[str, list[str]] = {}
    for i, (_, lang, text) in enumerate(rows):
        (unseen if i % 4 == 0 else learned).setdefault(lang, []).append(text)
    coders = language_id.Coders(language_id.dictionaries([(lang, t) for lang, own in learned.items() for t in own[:64]]))
    draw = random.Random(2)
    for size in (10_000, 100_000, 1_000_000, 2_000_000):
        for lang, own in unseen.items():
            whole = " ".join(own)
            text = (" ".join([whole] * (size // len(whole) + 1)))[:size]
            name, _, margin, rejected = coders.rate(text)
            assert name == lang and not rejected and margin > 2 * language_id.LEAST_MARGIN
        noise = " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(size // 7))
        assert coders.rate(noise)[3]


def test_folds_do_not_follow_the_remainder_of_ids():
    ids = np.arange(0, 5_000, toxicity.FOLDS)
    folds = toxicity.folds(ids)
    assert set(folds.tolist()) == set(range(toxicity.FOLDS))
    assert np.bincount(folds).min() > len(ids) / toxicity.FOLDS / 2
