"""The corpus operators on small fixtures: brute force, round trips, odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import common, decontaminate, html_text, language_id, line_dedup, mixing, near_dups, neighbours, secrets, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


def docs_of(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    full = [(i, t, lang, s, None if t is None else len(t), "x", 7) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS + ", component_id string, rate int").repartition(3)


def odd_rows():
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "word", None, "a"), (None, "one two three", "en", "a"), (5, "x " * 30000, "en", "b"), (5, "x " * 30000, "en", "b")]


# word hashes ----------------------------------------------------------------------------------


def test_word_hashes_are_of_the_words():
    rng = random.Random(1)
    text = words(rng, 30000) + "\t\n" + "Q" * 70000 + " end " + "É" * 3000
    data = text.encode()
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", data)
    own = common.word_hashes(data)
    alone = np.concatenate([common.word_hashes(w) for w in tokens])
    assert len(own) == len(tokens) and (own == alone).all()
    assert (common.word_hashes(b"AbC dE") == common.word_hashes(b"abc  De")).all()
    assert len(set(own.tolist())) == len({w.lower() if w.isascii() else w for w in tokens})


def test_word_heads_and_several_texts():
    heads, bounds = common.many_word_hashes([b"abcdefgh ij", b"", b"abcdefzz"], head=6)
    assert bounds.tolist() == [0, 2, 2, 3] and heads[0] == heads[2] == common.word_hashes(b"abcdef")[0]


def test_shingles_of_short_and_repeated_texts():
    assert len(common.shingle_set(b"")) == 0 and len(common.shingle_set(b"a b")) == 1
    assert common.shingle_set(b"a b").tolist() != common.shingle_set(b"b a").tolist()
    assert len(common.shingle_set(b"a " * 100)) == 1


# near duplicates ------------------------------------------------------------------------------


def test_signature_bound_is_kept_by_the_index():
    rng = np.random.default_rng(3)
    bound = near_dups.radius(near_dups.INDEX)
    a = np.sort(rng.integers(0, 2**63, (40, near_dups.SYMBOLS)).astype(np.uint64), axis=1)
    b = a.copy()
    for i in range(40):
        at = rng.permutation(near_dups.INDEX)[:bound]
        b[i, at] += np.uint64(1)
    assert (near_dups.keys(a) == near_dups.keys(b)).any(axis=1).all()


def test_first_kind_is_the_first_shared_key():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 3, (60, near_dups.SYMBOLS)).astype(np.uint64)
    sig, keys = near_dups.Signatures(near_dups.packed(a)), near_dups.keys(a)
    for i in range(1, 60):
        shared = np.flatnonzero(keys[0] == keys[i])
        if len(shared):
            assert sig.first_kind(0, np.array([i]))[0] == shared[0]


def brute_components(rows):
    sets = []
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        n = min(5, len(w))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            both = len(a & b)
            if i is not None and sets[y][0] is not None and a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return {(i, len(s), None if i is None else (least[find(x)] if s else i)) for x, (i, s) in enumerate(sets)}


def near_rows(seed=2, base=12, copies=12):
    rng = random.Random(seed)
    rows, n = [], 100
    for _ in range(base):
        text = words(rng, rng.choice([8, 30, 90, 300])).split(" ")
        for _ in range(copies):
            own = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, len(own) // 30, len(own) // 12])):
                own[rng.randrange(len(own))] = "".join(rng.choices("ijkl", k=5))
            rows.append((n, " ".join(own), "en", "a"))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [1024, 3])
def test_near_duplicates_are_those_of_brute_force(spark, tile):
    rows = near_rows() + odd_rows()
    out = near_dups.near_duplicates(docs_of(spark, rows), tile=tile).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out} == brute_components(rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in out)
    assert len(out) == len(set(rows))


def test_near_duplicates_of_nothing(spark):
    assert near_dups.near_duplicates(spark.createDataFrame([], EMPTY)).collect() == []


def test_one_of_each_group_stays(spark):
    rows = near_rows(base=4) + odd_rows()
    docs = docs_of(spark, rows)
    out = near_dups.keep_one(docs)
    assert out.columns == docs.columns
    kept = {(i, c) for i, _, c in brute_components(rows) if i is None or i == c}
    assert {r.doc_id for r in out.collect()} == {i for i, _ in kept}


# language ---------------------------------------------------------------------------------------


def language_rows(n=160):
    rng = random.Random(4)
    kinds = {"aa": "the of and water house ".split(), "bb": "der die und wasser haus ".split(), "cc": "le la et eau maison ".split()}
    out = []
    for i in range(n):
        lang = list(kinds)[i % 3]
        pool = [w + x for w in kinds[lang] for x in ("", "ing" if lang == "aa" else "ung" if lang == "bb" else "eux")]
        out.append((i, " ".join(rng.choices(pool, k=40)), lang, "s"))
    return out


def test_language_of_held_out_documents(spark):
    rows = language_rows()
    out = {r.doc_id: r for r in language_id.identify(docs_of(spark, rows)).collect()}
    import zlib

    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(out[i].held_out == (i in held) for i, *_ in rows)
    assert all(out[i].lang_pred == lang for i, _, lang, _ in rows if i in held)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_of_odd_rows(spark):
    out = language_id.identify(docs_of(spark, language_rows() + [(1000, None, "aa", "s"), (1001, "12 !?", "bb", "s"), (None, "the of", None, "s")])).collect()
    by_id = {r.doc_id: r for r in out}
    assert by_id[1000].lang_pred == by_id[1001].lang_pred == "und" and by_id[1000].score == 0.0 and by_id[None].held_out is False
    unlearned = language_id.identify(docs_of(spark, [(1, "some text", None, "s")])).first()
    assert unlearned.lang_pred == "und" and unlearned.rejected


def test_rejected_documents_go_and_columns_stay(spark):
    docs = docs_of(spark, language_rows(60) + [(1000, None, "aa", "s"), (1001, "12 !?", "bb", "s")])
    out = language_id.keep_identified(docs)
    assert out.schema == docs.schema and {r.doc_id for r in out.collect()} == set(range(60))


@pytest.mark.parametrize("learned", [("aa", "bb", "cc"), ("aa", "bb")])
def test_narrow_margins_reject(spark, learned):
    rng = random.Random(21)
    rows = [r for r in language_rows() if r[2] in learned]
    odd = [(1000 + n, words(rng, n, "abcdefghijklmnopqrstuvwxyz"), None, "s") for n in (1, 100, 500, 3000)]
    odd += [(9000, " ".join(rng.choices("il gatto e acqua casa rosso".split(), k=300)), None, "s")]
    out = {r.doc_id: r.rejected for r in language_id.identify(docs_of(spark, rows + odd)).collect()}
    assert not any(out[i] for i, *_ in rows) and all(out[i] for i, *_ in odd)


# lines ------------------------------------------------------------------------------------------


def line_rows():
    rng = random.Random(6)
    out = []
    for i in range(60):
        body = [words(rng, 12) for _ in range(3)]
        if i % 2:
            body.insert(1, "  all rights reserved ")
        if i % 6 == 0:
            body.append("few sites")
        out.append((i, "\n".join(body), "en", f"s{i % 12 if i % 6 else i % 3}"))
    copy = "\n".join(words(rng, 15) for _ in range(4))
    out += [(100 + i, copy, "en", f"s{i}") for i in range(14)]
    return out + [(200, None, "en", "s1"), (201, "", "en", "s1"), (202, "all rights reserved", "en", None), (203, "a\n\n\nb", "en", "s2")]


def test_lines_that_many_sites_carry_go(spark):
    rows = line_rows()
    docs = docs_of(spark, rows)
    out = line_dedup.dedup_lines(docs, sites=5)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    sites = {}
    for _, text, _, site in rows:
        for line in (text or "").split("\n"):
            if line.strip() and site:
                sites.setdefault(line.strip(), set()).add(site)
    wide = {k for k, v in sites.items() if len(v) >= 5}
    assert "all rights reserved" in wide and len(got) == len(rows)
    for i, text, *_ in rows:
        want = text
        if text and not {x.strip() for x in text.split("\n")} <= wide | {""}:
            want = "\n".join(x for x in text.split("\n") if x.strip() not in wide)
        assert got[i].text == want and got[i].n_chars == (None if want is None else len(want))


def test_short_pages_lose_their_boilerplate_and_copies_stay(spark):
    rng = random.Random(33)
    notice = "This notice is found on every site and is much longer than what the page says itself. " * 3
    own = [(i, f"own words {i}\n{notice}", "en", f"s{i % 15}") for i in range(30)]
    copies = [(100 + i, "an article\nthat many sites\ncarry word for word", "en", f"s{i % 15}") for i in range(45)]
    lines, near = [words(rng, rng.randint(9, 40)) for _ in range(8)], []
    for i in range(200):  # one word of one line replaced, put in or left out
        edited = [x.split() for x in lines]
        line = rng.choice(edited)
        at = rng.randrange(1, len(line) - 1)
        line[at : at + rng.randint(0, 1)] = [f"new{i}"] * (len(line) not in (16, 32) and rng.randint(0, 1) or 1)
        near.append((300 + i, "\n".join(map(" ".join, edited)), "en", f"s{i % 15}"))
    alone = [(200, notice, "en", "s0"), (201, notice + "\n" + notice, None, None), (202, lines[0] + "\nquoted here", "en", "s1")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.report(docs_of(spark, own + copies + near + alone)).collect()}
    assert all(got[i] == (2, 1, f"own words {i}") for i in range(30))
    assert all(got[100 + i] == (3, 0, copies[0][1]) for i in range(45))
    assert all(got[i] == (8, 0, text) for i, text, *_ in near)
    assert got[200][1] == got[201][1] == 0 and got[202] == (2, 1, "quoted here")


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(i, f"l{k}", f"site{j}") for k in range(8, 13) for i, j in enumerate([*range(k), *range(k)])]
    lines = spark.createDataFrame(rows, "i int, content string, site string").select(F.xxhash64("content").alias("line"), "site", "content")
    found = line_dedup.widespread_lines(lines, common.Scratch(spark, "t"), sites=10)
    assert {r.content for r in lines.join(found, "line", "left_semi").select("content").distinct().collect()} == {"l10", "l11", "l12"}


def test_lines_of_nothing(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], EMPTY)).collect() == []


# decontamination ----------------------------------------------------------------------------------


def plain_tiling(doc, item, least):
    marked_d, marked_i, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not marked_i[i + n] and not marked_d[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return tiles
        tiles.append(best)
        for k in range(best[2]):
            marked_i[best[0] + k] = marked_d[best[1] + k] = True


def test_tiling_is_greedy():
    rng = np.random.default_rng(8)
    for _ in range(120):
        doc, item = (rng.integers(0, 4, rng.integers(3, 50)).astype(np.uint64) for _ in range(2))
        got = decontaminate.tiling(doc, item, 3)
        assert got == plain_tiling(doc.tolist(), item.tolist(), 3)


def test_reordered_passages_are_found(spark):
    rng = random.Random(9)
    items = [words(rng, 40) for _ in range(6)]
    half = items[0].split(" ")
    rows = [
        (1, f"{words(rng, 50)} {' '.join(half[20:])}! {words(rng, 9)}\n{' '.join(half[:20]).upper()}", "en", "a"), (2, words(rng, 200), "en", "a"),
        (3, " ".join(items[1].split(" ")[:20]), "en", "a"), (4, items[2], "en", "a"), (4, items[2], "en", "a"), *odd_rows(),
    ]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, "too short"), (92, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_covered) for r in decontaminate.contaminated_pairs(docs_of(spark, rows), bench).collect())
    assert got == [(1, 0, 40), (4, 2, 40), (4, 2, 40)]
    docs = docs_of(spark, rows)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.schema == docs.schema and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 2, 3, 3, 4, 5, 5]
    assert decontaminate.contaminated_pairs(spark.createDataFrame([], EMPTY), bench).collect() == []
    assert decontaminate.contaminated_pairs(docs, bench.limit(0)).collect() == []


def test_a_long_benchmark_takes_several_passes(spark, monkeypatch):
    rng = random.Random(10)
    items = [words(rng, 30) for _ in range(9)]
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(items)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 400)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, bench).collect()) == [(i, i) for i in range(9)]
    assert decontaminate.drop_contaminated(docs, bench).count() == 0


# mixing -------------------------------------------------------------------------------------------


def mixing_tables(spark, n=300):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        kind = ("plain", "poor", "toxic")[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]
        text = words(rng, 40) + {"plain": "", "poor": " ### $$$ %%% &&&" * 6, "toxic": " vile scorn vile"}[kind]
        rows.append((i, text, "en", "a"))
        labels.append((i, 0 if kind == "poor" else 1, 1 if kind == "toxic" else 0))
    return docs_of(spark, rows + [(900, None, "en", "a"), (901, "", "en", "a")]), spark.createDataFrame(labels[: n // 2], "doc_id long, quality int, toxic int")


def test_expected_tokens_meet_the_targets(spark):
    docs, labels = mixing_tables(spark)
    targets = {"plain": 0.6, "poor": 0.3, "toxic": 0.1}
    out = mixing.mix(docs, labels, targets)
    assert out.columns[: len(docs.columns)] == docs.columns and "rate_" in out.columns
    rows = out.collect()
    assert len(rows) == docs.count()
    totals = {d: sum(r["rate_"] * r["n_tokens"] * r["posterior"][d] for r in rows) for d in targets}
    whole = sum(totals.values())
    assert all(abs(totals[d] / whole - share) < 2e-3 for d, share in targets.items())
    assert all(r["rate_"] >= 0 and abs(sum(r["posterior"].values()) - 1) < 1e-9 and r["copies"] in (math.floor(r["rate_"]), math.floor(r["rate_"]) + 1) for r in rows)
    assert all(r["rate_"] == 0 and r["n_tokens"] == 0 for r in rows if r["doc_id"] in (900, 901))
    best = {r["doc_id"]: max(r["posterior"], key=r["posterior"].get) for r in rows if r["doc_id"] < 300}
    right = sum(best[i] == ("plain" if i % 10 < 7 else "poor" if i % 10 < 9 else "toxic") for i in best)
    assert right > 285


def nearest_in_cone(p, wanted):
    """The least gap of nonnegative least squares: the wanted totals' projection on the cone of the rows."""
    some, gap = [int(np.argmax(p @ wanted))], None
    for _ in range(300):
        best = None
        for n in range(1, min(len(some), 3) + 1):
            for own in combinations(some, n):
                x = np.linalg.lstsq(p[list(own)].T, wanted, rcond=None)[0]
                left = x @ p[list(own)] - wanted
                if (x >= -1e-9).all() and (best is None or left @ left < best[0]):
                    best = (left @ left, left, list(own))
        _, gap, some = best
        worst = int(np.argmin(p @ gap))
        if worst in some or p[worst] @ gap > -1e-9 * wanted.sum():
            break
        some.append(worst)
    return gap


@pytest.mark.parametrize("most_toxic", [0.0, 0.002, 0.02, 0.2])
def test_rates_are_those_of_nonnegative_least_squares(spark, most_toxic):
    rng = np.random.default_rng(22)
    n = 2000
    sure = np.where(rng.random(n) < 0.3, 1 / (1 + np.exp(3 + rng.normal(0, 1, n))), 1 / (1 + np.exp(-3 + rng.normal(0, 1, n))))
    toxic = most_toxic * rng.random(n)
    p = np.stack([sure * (1 - toxic), (1 - sure) * (1 - toxic), toxic], 1)
    weight = np.floor(np.exp(rng.normal(5, 1, n))) + 1
    wanted = np.array([0.9, 0.08, 0.02]) * weight.sum()
    members = spark.createDataFrame([(float(w), x.tolist()) for w, x in zip(weight, p, strict=True)], "tokens double, p array<double>")
    shift = mixing.fit_rates(members, wanted.tolist())
    done = members.withColumn("rate", mixing.rate_of(F.col("p"), shift)).collect()
    gap = sum(r.rate * r.tokens * np.array(r.p) for r in done) - wanted
    assert min(r.rate for r in done) >= 0
    assert np.linalg.norm(gap) - np.linalg.norm(nearest_in_cone(p, wanted)) < 2e-4 * wanted.sum()


def test_mixing_without_labels_and_without_rows(spark):
    docs, labels = mixing_tables(spark, 20)
    out = mixing.mix(docs, labels.limit(0)).filter("n_tokens > 0").collect()
    assert out and all(r["rate_"] == 1.0 and r["posterior"] == {"all": 1.0} for r in out)
    assert mixing.mix(spark.createDataFrame([], EMPTY), labels).collect() == []


def test_mixing_has_no_python_in_its_plan(spark):
    docs, labels = mixing_tables(spark, 20)
    plan = mixing.mix(docs, labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_condition_on_copies_does_not_repeat_the_words_of_a_text(spark):
    docs, labels = mixing_tables(spark, 20)
    plan = mixing.mix(docs, labels).filter("copies > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "lower(" not in plan


# pages --------------------------------------------------------------------------------------------


def test_blocks_of_a_page():
    source = (
        '<html><head><title>no</title><style>p{}</style></head><body class="has-sidebar"><nav><ul><li>menu</ul></nav><!-- note --><div class="ad banner">buy</div>'
        "<article><h1>A &amp; B</h1><p><b>one\n  two<br><p>th&eacute; &#x41; &lt;i&gt;<p>x<ul><li>i<li>ii</ul><div class=comments><p>me too</div></article><footer>f</footer>"
    )
    assert html_text.main_text(html_text.parse(source), set()) == "A & B\none two\nthé A <i>\nx\ni\nii"


@pytest.mark.parametrize("source", ["", "<", "<p", "<!--", "</p></p>", "<table><td>a<td>b", "a < b", "<script>x", "<b><i>x</b>y</i>", "&#0; &nope; &amp", "<p>" * 3000])
def test_broken_markup_is_read(source):
    html_text.main_text(html_text.parse(source), set())


def test_site_templates_go(spark):
    rng = random.Random(12)
    box = "<div><p>Read our rules before you post.</p></div>"
    page = lambda body, i: f"<body>{box}<div><h2>{words(rng, 3)}</h2><p>{body}</p></div><section>Visit us <b>daily</b></section>"
    rows = [(i, f"https://User@One.example:80/p{i}", page(words(rng, 20), i)) for i in range(30)]
    same = page("the same page", 0)
    rows += [(100 + i, "https://two.example/", same) for i in range(30)] + [(200, None, None), (201, "::", ""), (202, None, "<p>alone")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, host int, trees string").repartition(3)
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert len(got) == len(rows)
    assert all("rules" not in got[i].text and "Visit" not in got[i].text and len(got[i].text.split("\n")) == 2 for i in range(30))
    assert all("rules" in got[100 + i].text for i in range(30))
    assert (got[200].text, got[200].n_chars, got[202].text, got[201].url) == ("", 0, "alone", "::")
    assert html_text.extract(pages.limit(0)).collect() == []


def plain_template_text(rows, least):
    """Texts by counting in plain Python: a subtree on ``least`` distinct pages of a host goes."""
    pages = [(html_text.host_of(url), html_text.parse(source or "")) for _, url, source in rows]
    seen = {}
    for host, page in pages:
        for tree in page.trees:
            seen.setdefault((host, tree), set()).add("\n".join(w for w, *_ in page.blocks))
    return [html_text.main_text(page, {t for t in page.trees if t and len(seen[host, t]) >= least}) for host, page in pages]


def test_templates_do_not_depend_on_the_size_of_a_host(spark):
    rng = random.Random(31)
    menu = "<div><a>Section one</a><ul><li>two<li>three</ul></div>"
    rows = [(i, "http://large.example/" + str(i), f"<body>{menu if i < 10 else ''}<div><p>{words(rng, 12)}</p></div>") for i in range(5000)]
    rows += [(9000 + i, "http://small.example/", f"<body>{menu if i < 7 else ''}<p>{words(rng, 9)}</p>") for i in range(20)]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert [out[i] for i, *_ in rows] == plain_template_text(rows, html_text.LEAST_PAGES)
    assert all("Section" not in out[i] and out[i] for i in range(10)) and sum("Section" in out[9000 + i] for i in range(20)) == 7


def test_subtrees_of_random_pages(spark):
    rng = random.Random(32)
    some = ["div", "ul", "li", "p", "b", "section", "table", "article", "nav", "h2"]

    def tree(depth):
        tag = rng.choice(some)
        inner = "".join(tree(depth - 1) if depth and rng.random() < 0.6 else rng.choice(["red ", "green ", "blue "]) for _ in range(rng.randint(1, 3)))
        return f"<{tag}>{inner}" + (f"</{tag}>" if rng.random() < 0.9 else "")

    rows = [(i, f"http://h{i % 3}.example/", "".join(tree(4) for _ in range(3))) for i in range(240)]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), least_pages=4).collect()}
    want = plain_template_text(rows, 4)
    assert [out[i] for i in range(240)] == want and want != [html_text.main_text(html_text.parse(r[2]), set()) for r in rows]


@pytest.mark.parametrize("part", ["<font>x<br>", "<font></b>", "<font><h2>y</h2>", "<select>", "<p>x", "<div>", "<ul><li>a", "<svg>", '<a "', "<"])
def test_long_markup_takes_time_in_proportion(part):
    html_text.main_text(html_text.parse(part * (1_000_000 // len(part))), set())


def test_copies_of_an_article_stay(spark):
    rng = random.Random(13)
    body = "".join(f"<p>{words(rng, 20)}</p>" for _ in range(4))
    rows = [(i, "https://one.example/", f"<article><h1>{words(rng, 2)}</h1>{body}</article>") for i in range(40)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(len(r.text.split("\n")) == 5 for r in out)


# toxicity -----------------------------------------------------------------------------------------


def test_chain_finds_held_out_toxic_texts(spark):
    rng = random.Random(14)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        rows.append((i, words(rng, rng.choice([5, 60, 400])) + (" Fool scum fool" if toxic else ""), "en", "a"))
        if i < 300:
            labels.append((i, 1 if i % 7 else 0, int(toxic) if i % 11 else None))
    docs = docs_of(spark, rows + odd_rows())
    out = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == docs.count() and all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in out)
    by_id = {i: r.toxic for r in out for i in [r.doc_id]}
    assert sum(by_id[i] == (i % 5 == 0) for i in range(300, 400)) >= 98


def test_chain_without_labels(spark):
    out = toxicity.score(docs_of(spark, odd_rows()), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert out and all(not r.toxic and r.p_toxic == 0.5 for r in out)


def test_later_models_use_out_of_fold_odds():
    rng = np.random.default_rng(15)
    first = rng.integers(0, 2, 400)
    rows = [(np.unique(np.array([1 + y, 10 + rng.integers(0, 9)], np.uint64)), np.ones(2, int), 2) for y in first]
    chain = toxicity.fit_chain(["a", "b"], rows, np.column_stack([first, first]).astype(float), np.arange(400) % 5)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and chain.weights[1][1] > 0


# neighbours ---------------------------------------------------------------------------------------


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", 300)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(16)
    v = rng.standard_normal((900, 16)) * rng.uniform(0.2, 2, (900, 1))
    rows = [(int(i), [float(x) for x in v[i]], 1) for i in range(900)]
    rows += [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [None] * 16, 1), (2080, [1.0, 2.0], 1), (None, [1.0] * 16, 1), rows[7], rows[20]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    out = {}
    for r in neighbours.nearest(table, k=10).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(out) == set(range(0, 900, 20))
    hits = 0
    for q, found in out.items():
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:10]
        assert [r for r, *_ in found] == list(range(1, 11)) and all(abs(score - s[i]) < 1e-9 for _, i, score in found)
        hits += len({i for _, i, _ in found} & set(order))
    assert hits / (10 * len(out)) >= 0.9


def test_few_and_no_neighbours(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(few).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert neighbours.nearest(few.limit(0)).collect() == []


# tokens -------------------------------------------------------------------------------------------


def test_tokens_are_attributed_once(spark):
    texts = ["one two\n\nthree  four\nfünf 日本語 🙂\n", "\n", "a\nb", " \n \n x", "no end", "z" * 5000 + "\n" + "y"]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(50, None, "en", "a"), (51, "", "en", "a"), (None, "q", "en", "a")]
    docs = docs_of(spark, rows)
    encoder = token_counts.Encoder(open(token_counts.VOCABULARY, "rb").read())
    for r in token_counts.count_tokens(docs).collect():
        text = next((t for i, t, *_ in rows if i == r.doc_id), None) or ""
        whole = encoder._encoding.encode_ordinary(text)
        assert r.n_tokens == len(whole) == sum(s["n_tokens"] for s in r.sections)
        assert "".join(text[s["start"] : s["end"]] for s in r.sections) == text and len(r.sections) == len(text.splitlines()) if "\n" in text else True
        at, owner = 0, []
        for token in whole:  # by walking the bytes
            owner.append(len(text.encode()[:at].decode(errors="ignore")))
            at += len(encoder._encoding.decode_single_token_bytes(token))
        assert [s["n_tokens"] for s in r.sections] == [sum(s["start"] <= o < s["end"] for o in owner) for s in r.sections]
    assert token_counts.section_counts(docs.limit(0)).collect() == []


# secrets ------------------------------------------------------------------------------------------


def plain_base(text):
    out = []
    rules = [("assign", r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6)]
    rules += [("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24)]
    for order, (kind, pattern, least) in enumerate(rules):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return ",".join(s for *_, s in sorted(out))


def test_base_spans_and_hash(spark):
    rng = random.Random(17)
    alphabet = ["password", "PassWD", "token", "api_key", "apikey", ": ", "=", "'", '"', "abc123", "AKIA", "ABCDEFGHIJ234567", "deadbeef", "0123456789abcdef", " ", "é🙂", "\n", "x", "ſecret", "toKen="]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randint(1, 40))), "en", "a") for i in range(300)] + odd_rows()
    for r in secrets.scan(docs_of(spark, rows)).collect():
        texts = {t or "" for i, t, *_ in rows if i == r.doc_id}
        want = {plain_base(t) for t in texts}
        assert r.base_sha256 in {hashlib.sha256(w.encode()).hexdigest() for w in want}
        own = [s for s in r.spans.split(",") if s and not s.startswith("entropy")]
        assert ",".join(own) in want and len(own) == r.n_assign + r.n_access + r.n_hex
    assert secrets.scan(docs_of(spark, odd_rows()).limit(0)).collect() == []


def test_windows_are_those_of_counting_anew():
    rng = random.Random(18)
    for _ in range(60):
        run = "".join(rng.choices("aaab" if rng.random() < 0.4 else "abcdef0123456789", k=rng.randint(1, 90)))
        marked = [False] * len(run)
        for i in range(len(run) - 31):
            part = run[i : i + 32]
            if -sum(part.count(c) / 32 * math.log2(part.count(c) / 32) for c in set(part)) >= 3.0 - 1e-9:
                marked[i : i + 32] = [True] * 32
        covered = [False] * len(run)
        for a, b in secrets.windows(run, 32, 3.0):
            covered[a:b] = [True] * (b - a)
        assert covered == marked


def test_entropy_finds_what_has_no_pattern_and_spares_words():
    key = "tH7q/9ZkP2+vLx8Rb3NwYc5JmU1sEd6G"
    assert secrets.entropy_spans(f"see {key} now") == [("entropy_base64", 4, 4 + len(key))]
    assert secrets.entropy_spans("thisisaverylongwordwithoutanynumberinit and/some/long/path/to/files2 123e4567-e89b-12d3-a456-426614174000 12345678901234567890123456789012345") == []


def test_entropy_finds_assigned_hex_and_random_letters():
    rng = random.Random(23)
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    keys = [before + pick("0123456789ABCDEF", 32) for before in ("KEY=", "a/", "hash=") for _ in range(100)]
    letters = [pick(upper + lower, 40) for _ in range(200)] + [f"example={pick(upper + lower + '0123456789', 40)}" for _ in range(200)]
    assert sum(bool(secrets.entropy_spans(x)) for x in keys) > 270 and sum(bool(secrets.entropy_spans(x)) for x in letters) > 390
    assert secrets.entropy_spans("src/main/java/AbstractQueryFactoryBuilder/HttpClientRequestHandler2 id=123e4567-e89b-12d3-a456-426614174000 sha256-" + key_of_digest()) == []


def key_of_digest():
    return "tH7q/9ZkP2+vLx8Rb3NwYc5JmU1sEd6GtH7q9ZkP2vL="


# pipeline -----------------------------------------------------------------------------------------


def test_pipeline_runs_stage_by_stage(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = common.table(spark, sf_dir, "documents")
    seen = [docs.count()]
    scratch = common.Scratch(spark, "pipeline-test")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.save(stage(spark, docs, sf_dir))
        seen.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    assert seen[2] == seen[1] and seen == sorted(seen, reverse=True) and seen[-1] > seen[0] // 2


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_nothing(spark, stage):
    import corpus_pipeline

    docs = common.table(spark, "/root/testdata/sf0.001", "documents").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, "/root/testdata/sf0.001").collect() == []
