"""Posteriors of the mixing operator against the formula, and a whole pass of the pipeline's last stage."""

from __future__ import annotations

import math

import pytest

from lexiloom.llm import mixing


def test_posteriors_follow_the_weights_of_the_words_met(spark):
    odds = {"bad": [-1.5, 2.0], "#digits:none": [0.25, -0.5], "kind": [1.0, -1.0]}
    prior = [-0.2, -1.7]
    texts = {"": [], "Bad kind words": ["bad", "kind"], "bad BAD 77": ["bad"], "ÄÖ 12 &&": [], "plain": []}
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = mixing.with_posteriors(docs, "text", "p", ["plain", "toxic"], prior, odds).collect()
    for r in rows:
        met = texts[r.text] + ([] if any(c.isdigit() for c in r.text) else ["#digits:none"])
        powers = [math.exp(prior[i] + sum(odds[w][i] for w in met)) for i in range(2)]
        assert list(r.p) == pytest.approx([x / sum(powers) for x in powers])
    (row,) = mixing.with_posteriors(docs.limit(1), "text", "p", ["all"], [0.0], {}).collect()
    assert row.p == [1.0]
