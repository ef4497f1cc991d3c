"""Mixing documents to target token shares by soft domain membership.

Three steps, all of them DataFrame operations:

1. A classifier learned from a labelled table gives each document a posterior over domains. It is a
   Bernoulli naive Bayes over the words that tell the domains apart best, and over coarse shares of
   capitals, digits and signs. Words must be several times likelier in a domain than out of it, so
   that common words, which only tell a text's length, do not count.
2. Documents get nonnegative rates. The expected tokens of a domain are the sum over documents of
   rate * tokens * posterior; projected-gradient least squares brings these totals to the targets.
   Each step needs a few sums over the documents, which are partial aggregates.
3. A rate becomes a number of copies: its whole part, and one more by a fixed hash of the document.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import Scratch, fresh

#: Labelled rows that the classifier is fitted on, about, chosen by a hash of their id. The sample is broadcast.
FIT_ROWS = 6_000
#: Telling words of each domain.
WORDS = 40
#: Sample documents in which a telling word occurs at least, how many times likelier it is in a domain, and
#: the least logarithm of that ratio times the root of its documents, so that chance in a small sample does not tell.
LEAST_ROWS, LEAST_RATIO, LEAST_GAIN = 4, 3.0, 4.0
#: Weight of the rates' distance from 1 beside the squared error; the slope, in shares of all tokens, that ends
#: the steps; most steps; and the lengths that each step is tried with.
RIDGE, FLAT, STEPS = 1e-10, 1e-5, 60
LENGTHS = tuple(0.5**i for i in range(12))
#: Share of all tokens that each domain is to have; domains that are not named share the rest by what they have.
TARGETS = {"plain": 0.9, "poor": 0.08, "toxic": 0.02}


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled row; null without any label."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "poor").when(quality.isNotNull() | toxic.isNotNull(), "plain")


#: A feature that every row has, to count rows with.
_ROW = "#row"


#: Characters whose share of a text is a feature.
SIGNS = {"capitals": "[A-Z]", "digits": "[0-9]", "signs": r"[!#$%&*|<>{}=+~^\[\]]"}


def with_features(df: DataFrame, text: str, out: str, only: Sequence[str] | None = None) -> DataFrame:
    """Adds the distinct words of a text and the levels of its shares, all or those of a list.

    A level is the rounded logarithm of a share, written as a word that no text can hold. Values that
    are used more than once are columns of their own, so that Spark computes them once.
    """
    whole = F.greatest(F.length(text), F.lit(1))
    parts = {f"{out}_{name}": F.regexp_count(text, F.lit(sign)) / whole for name, sign in SIGNS.items()}
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    words = words if only is None else F.filter(words, lambda w: w.isin(list(only)))
    levels = [
        F.concat(F.lit(f"#{name}:"), F.when(F.col(c) == 0, "none").otherwise(F.greatest(F.lit(-8), F.floor(F.log2(c))).cast("string")))
        for name, c in zip(SIGNS, parts, strict=True)
    ]
    return df.withColumns(parts).withColumn(out, F.array_distinct(F.concat(words, F.array(*levels)))).drop(*parts)


def tokens(text: Column) -> Column:
    """Words of a text, by white space."""
    blank = r"[\x09-\x0D\x20]"
    edges = text.rlike(f"^{blank}").cast("int") + text.rlike(f"{blank}\\z").cast("int")
    return F.when(text == "", 0.0).otherwise((F.size(F.split(text, blank + "+")) - edges).cast("double"))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, rows: int = FIT_ROWS, words: int = WORDS) -> tuple[list[str], list[float], dict[str, list[float]]]:
    """(domains, log priors, log-odds weights of each telling word by domain) from the labelled documents.

    Fitted on about ``rows`` labelled rows; what reaches the driver is bounded by the number of
    domains times ``words``. Domains are taken by name.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).filter("doc_id is not null and domain is not null").distinct()
    part = 10**6 * rows // max(1, marked.count())
    chosen_rows = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(10**6)) < part)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    sample = with_features(known.join(F.broadcast(chosen_rows), "doc_id"), "text", "words")
    sample = sample.select("domain", F.explode(F.concat("words", F.array(F.lit(_ROW)))).alias("word"))
    counts = scratch.save(sample.filter("word <> ''").groupBy("word", "domain").agg(F.count("*").alias("n")))
    sizes = {r["domain"]: r["n"] for r in counts.filter(F.col("word") == _ROW).collect()}
    domains = sorted(sizes)
    if not domains:
        return [], [], {}
    total = sum(sizes.values())
    held = counts.filter(F.col("word") != _ROW).groupBy("word").agg(*[F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i, d in enumerate(domains)])
    rate = [(F.col(f"n{i}") + 0.5) / (sizes[d] + 1) for i, d in enumerate(domains)]
    everywhere = sum((F.col(f"n{i}") for i in range(1, len(domains))), F.col("n0"))
    held = held.filter(everywhere >= LEAST_ROWS)
    chosen: dict[str, list[float]] = {}
    largest = max(domains, key=lambda d: (sizes[d], d))
    for i, d in enumerate(domains):
        if d == largest and len(domains) > 1:
            continue  # the other domains are told apart from it
        others = (everywhere - F.col(f"n{i}") + 0.5) / (total - sizes[d] + 1)
        ratio = F.log(rate[i]) - F.log(others)
        gain = F.abs(ratio) * F.sqrt(everywhere)
        level = F.startswith("word", F.lit("#"))
        clear = (F.when(level, F.abs(ratio)).otherwise(ratio) >= math.log(LEAST_RATIO)) & (gain >= LEAST_GAIN)
        for r in held.filter(clear).select("word", gain.alias("gain"), *[x.alias(f"r{k}") for k, x in enumerate(rate)]).orderBy(F.desc("gain"), "word").limit(words).collect():
            chosen[r["word"]] = [min(r[f"r{k}"], 0.999) for k in range(len(domains))]
    # a word that is not there speaks too: its share goes into the prior, and a word that is there takes it back
    prior = [math.log(sizes[d] / total) + sum(math.log(1 - x[i]) for x in chosen.values()) for i, d in enumerate(domains)]
    return domains, prior, {w: [math.log(x / (1 - x)) for x in v] for w, v in sorted(chosen.items())}


def _numbers(values: Sequence[float]) -> Column:
    """An array constant. Generated code refers to it, so plans that differ in its numbers share their code."""
    return F.array(*[F.lit(float(x)) for x in values]) if len(values) else F.array().cast("array<double>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def with_posteriors(df: DataFrame, text: str, out: str, domains: Sequence[str], prior: Sequence[float], odds: dict[str, list[float]]) -> DataFrame:
    """Adds an array with the posterior of each domain; the weights of the words met are looked up in one map."""
    logs = f"{out}_logs"
    if odds:
        weights = F.create_map(*[x for w, v in odds.items() for x in (F.lit(w), _numbers(v))])
        met = f"{out}_met"
        df = with_features(df, text, met, list(odds))
        # levels of shares are met by every text, and not all of them tell
        telling = F.filter(met, lambda w: F.map_contains_key(weights, w))
        df = df.withColumn(logs, F.aggregate(telling, _numbers(prior), lambda sums, w: F.zip_with(sums, weights[w], lambda x, y: x + y))).drop(met)
    else:
        df = df.withColumn(logs, _numbers(prior))
    top = F.array_max(logs)
    df = df.withColumn(logs, F.transform(logs, lambda x: F.exp(x - top)))
    return df.withColumn(out, F.transform(logs, lambda x: x / F.aggregate(logs, F.lit(0.0), lambda s, y: s + y))).drop(logs)


def goals(targets: dict[str, float], domains: Sequence[str], held: Sequence[float]) -> list[float]:
    """Tokens wanted of each domain: shares of what there is; the rest goes to unnamed domains by what they hold."""
    total = sum(held)
    rest = max(0.0, 1.0 - sum(targets.get(d, 0.0) for d in domains))
    unnamed = sum(h for d, h in zip(domains, held, strict=True) if d not in targets)
    shares = [targets[d] if d in targets else (rest * h / unnamed if unnamed else 0.0) for d, h in zip(domains, held, strict=True)]
    return [s * total / (sum(shares) or 1.0) for s in shares]


def fit_rates(members: DataFrame, wanted: Sequence[float]) -> list[float]:
    """The shift, one number per domain, by which ``rate_of`` gives ``members`` (tokens, p) totals nearest to ``wanted``.

    Minimises the sum over domains of (total - wanted)^2 over rates >= 0 and, with a tiny weight, the
    rates' distance from 1, so that one of many solutions is meant. In the metric that weighs a
    document by its tokens, the gradient of a rate is p . gap, and the solution is the rate that a
    projected gradient step from 1 of length 1 / RIDGE leaves in place: max(0, 1 - p . shift) with shift
    = gap / RIDGE. That shift is the least point of a convex function of few numbers, found by Newton
    steps over the documents with a positive rate; the length that lowers the function most is taken,
    so targets out of reach end at their least error too. A step takes two passes of sums, which Spark
    adds up where the rows are.
    """
    k = len(wanted)
    shift = np.zeros(k)
    weight = max(members.agg(F.sum("tokens")).first()[0] or 0.0, 1.0)
    share = np.array(wanted, float) / weight

    def sums(df: DataFrame, columns: list[Column]) -> np.ndarray:
        return np.array([x or 0.0 for x in df.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()]) / weight

    def values(shifts: list[np.ndarray]) -> np.ndarray:
        every = F.array(*[_numbers(x) for x in shifts])
        rated = members.select("tokens", F.transform(every, lambda x: rate_of(F.col("p"), x)).alias("rates"))
        halves = sums(rated, [F.col("tokens") * F.col("rates")[i] * F.col("rates")[i] for i in range(len(shifts))]) / 2
        return halves + np.array([RIDGE / 2 * x @ x + share @ x for x in shifts])

    for _ in range(STEPS):
        own = members.select("tokens", "p", rate_of(F.col("p"), _numbers(shift)).alias("rate"))
        own = own.withColumn("live", F.when(F.col("rate") > 0, F.col("tokens")).otherwise(0.0))
        found = sums(own, [F.col("rate") * F.col("tokens") * F.col("p")[i] for i in range(k)] + [F.col("live") * F.col("p")[i] * F.col("p")[j] for i in range(k) for j in range(i + 1)])
        slope = RIDGE * shift - found[:k] + share
        if np.abs(slope).max() <= FLAT:
            break
        gram = np.zeros((k, k))
        gram[np.tril_indices(k)] = found[k:]
        gram += np.tril(gram, -1).T
        move = np.linalg.solve(gram + RIDGE * np.eye(k), slope)
        tried = [shift, *(shift - length * move for length in LENGTHS)]
        best = int(np.argmin(values(tried)))
        if best == 0:
            break  # as low as numbers tell
        shift = tried[best]
    return shift.tolist()


def rate_of(p: Column, shift: Column | Sequence[float]) -> Column:
    """The rate of a document with posteriors ``p``: the projected step from rate 1."""
    return F.greatest(F.lit(0.0), 1.0 - _dot(p, shift if isinstance(shift, Column) else _numbers(shift)))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with domain posteriors, rates and copies.

    ``docs`` has doc_id and text; ``labels`` has doc_id, quality (0/1) and toxic (0/1), any of them
    null. Adds n_tokens (long), posterior (map domain -> double), rate (double) and copies (long),
    under these names with a trailing _ where ``docs`` has them. All rows stay. Null and empty texts
    have no tokens, the prior as posterior, and rate 0. Repeated rows each get the same rate. Labels
    that repeat a document with different values teach each value. With no labelled document all
    texts are of one domain, "all", and every rate is 1. An empty table gives no rows.
    """
    targets = TARGETS if targets is None else targets
    scratch = Scratch(docs.sparkSession, "mixing")
    domains, prior, odds = fit(docs, labels, scratch)
    if not domains:
        domains, prior, odds = ["all"], [0.0], {}
    body, p, weight = fresh(docs, "_mix_text"), fresh(docs, "_mix_p"), fresh(docs, "_mix_tokens")
    judged = with_posteriors(docs.withColumn(body, F.coalesce(F.col("text").cast("string"), F.lit(""))), body, p, domains, prior, odds)
    # written once: a condition on the rows that come out would else repeat the words of a text for each use of a posterior
    judged = scratch.save(judged.withColumn(weight, tokens(F.col(body))).drop(body))
    members = judged.select(F.col(weight).alias("tokens"), F.col(p).alias("p"))
    held = members.agg(*[F.sum(F.col("tokens") * F.col("p")[i]).alias(f"h{i}") for i in range(len(domains))]).first()
    wanted = goals(targets, domains, [held[f"h{i}"] or 0.0 for i in range(len(domains))])
    shift = fit_rates(members, wanted) if len(domains) > 1 else [0.0]
    names = {c: fresh(docs, c) for c in ("n_tokens", "posterior", "rate", "copies")}
    n = names["n_tokens"]
    out = judged.withColumn(n, F.col(weight).cast("long"))
    out = out.withColumn(names["rate"], F.when(F.col(n) > 0, rate_of(F.col(p), shift)).otherwise(0.0))
    rate = F.col(names["rate"])
    spare = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor(rate) + F.when(spare < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return out.withColumns({names["posterior"]: F.map_from_arrays(F.array(*map(F.lit, domains)), F.col(p)), names["copies"]: copies}).select(*docs.columns, *names.values())
