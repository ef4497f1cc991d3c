"""Near duplicates where links are many, sets are small, or an id has several texts."""

from __future__ import annotations

import random

from lexiloom.llm import common, near_dups

DOCS = "doc_id long, text string, lang string"


def brute(rows, width=5, percent=75):
    sets = {i: set(common.shingle_set(t.encode(), width).tolist()) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in sets}


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS).repartition(4)
    return {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(table, **options).collect()}


def test_small_sets_lose_no_link(spark):
    rng, rows = random.Random(4), []
    for _ in range(450):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(7, 12))]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base, "tail"][rng.randint(0, 1) :]))]
    expected = brute(rows)
    assert found(spark, rows) == expected and sum(i != c for i, c in expected.items()) > 200


def test_a_group_at_the_bound_gives_few_links(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = []
    for i in range(700):
        words = list(base)
        for at in rng.sample(range(90), 2):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    links = []
    plain = near_dups._open_links
    monkeypatch.setattr(near_dups, "_open_links", lambda *a: (lambda df: links.append(df.count()) or df)(plain(*a)))
    assert found(spark, rows, tile=256) == brute(rows)
    assert links[0] < 20 * len(rows)


def test_one_row_of_each_group_stays_by_id_and_text(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(3, b), (5, a), (5, b), (6, a), (7, None), (None, a), (8, " "), (9, a + " tail"), (5, a)]
    table = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)
    left = sorted(((r["doc_id"], r["text"]) for r in near_dups.keep_one(table).collect()), key=str)
    assert left == sorted([(3, b), (5, a), (5, a), (7, None), (None, a), (8, " ")], key=str)
