"""Soft-membership mixing with built-in functions only.

A labelled table names the domain of some documents. A multinomial naive Bayes over hashed tokens, counted on a bounded sample of them (``labelled_rows``
documents), gives every document posteriors over the domains. Then nonnegative rates are fitted by projected
gradient least squares: expected tokens of each domain, sum of rate x tokens x posterior, are to equal the targets. The gradient lives in the space of domains, so a
step needs one distributed sum of a few numbers; it is preconditioned by the matrix of the documents that still have a
positive rate, and every document projects its own rate to zero or above. A rate is a function of the posteriors and the
steps so far, so nothing is kept between steps but the posteriors in the shared folder.

Defined results: null and empty texts have no tokens and the prior's posteriors, and their rate does not affect the totals; repeated rows keep
their number; a null doc_id is a document like any other; without labels all rates are 1; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, fresh, table

BUCKETS, SMOOTH, EVIDENCE = 1 << 16, 0.5, 8
# Marks that a word loses at both ends, and what separates words.
MARKS = ".,;:!?*#$%&|\"'()[]{}<>"
WIDE_SPACES = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def _words(text: Column) -> Column:
    """Words between white space. Few texts have other than ASCII white space, and a pattern for that alone is several times as fast."""
    plain = (F.octet_length(text) == F.length(text)) | ~reduce(or_, [F.contains(text, F.lit(c)) for c in WIDE_SPACES])
    return F.when(plain, F.split(text, "\\s+")).otherwise(F.split(text, SPACES))


def tokenized(docs: DataFrame) -> DataFrame:
    """(doc_id, key, place, bucket): the words of each row, at least one; bucket is null for an empty word, key a hash of id and text.

    Words stand between white space of any kind and lose the marks at their ends; one of marks alone stays as it is.
    """
    # Key and words are made before the words become rows, so that no text is hashed or carried once a word.
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), _words(text).alias("words")).select("doc_id", "key", F.posexplode("words").alias("place", "w"))
    bare = F.btrim("w", F.lit(MARKS))
    token = F.when(bare != "", bare).otherwise(F.col("w"))
    return rows.select("doc_id", "key", "place", F.when(F.col("w") != "", F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")).alias("bucket"))


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table with quality and toxic marks; repeated ids take their worst marks."""
    worst = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return worst.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("t") == 1, "toxic").when(F.col("q") == 1, "good").otherwise("low").alias("domain"))


def classifier(docs: DataFrame, labels: DataFrame, labelled_rows: int = 8000) -> tuple[list[str], DataFrame | None, list[float]]:
    """Domains, a table (bucket, w0, w1, ...: log weights by domain) of at most ``BUCKETS`` rows, and log priors."""
    counts = {r["domain"]: r["n"] for r in labels.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], None, []
    domains = sorted(counts)
    share = labelled_rows / len(domains)
    kept = F.create_map(*[x for d in domains for x in (F.lit(d), F.lit(min(1.0, share / counts[d])))])
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < kept[F.col("domain")] * 1_000_000)
    seen = tokenized(docs.join(chosen, "doc_id", "left_semi")).where("bucket is not null").groupBy("doc_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sums = [F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"c{i}") for i, d in enumerate(domains)]
    table_, _ = cut(seen.join(chosen, "doc_id").groupBy("bucket").agg(*sums), "token-counts")
    totals = table_.agg(*[F.sum(f"c{i}") for i in range(len(domains))]).first()
    logs = [F.log((F.col(f"c{i}") + SMOOTH) / F.lit(float((totals[i] or 0) + SMOOTH * BUCKETS))) for i in range(len(domains))]
    mean = sum(logs[1:], logs[0]) / len(logs)
    n = sum(counts.values())
    return domains, table_.select("bucket", *[(x - mean).alias(f"w{i}") for i, x in enumerate(logs)]), [float(np.log(counts[d] / n)) for d in domains]


def posteriors(docs: DataFrame, domains: list[str], weights: DataFrame, priors: list[float]) -> DataFrame:
    """(doc_id, key, copies, n_tokens, p): a row for each distinct document, p in the order of ``domains``.

    The weights have at most ``BUCKETS`` rows whatever the input, which bounds the broadcast.
    """
    scored = tokenized(docs).join(F.broadcast(weights), "bucket", "left")
    sums = [F.sum(F.coalesce(F.col(f"w{i}"), F.lit(0.0))).alias(f"s{i}") for i in range(len(domains))]
    rows = scored.groupBy("doc_id", "key").agg(F.count_if(F.col("place") == 0).alias("copies"), F.count("bucket").alias("all"), *sums)
    n = F.col("all") / F.col("copies")
    scale = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(n, F.lit(1.0))) / F.col("copies")
    rows = rows.select("doc_id", "key", "copies", n.cast("long").alias("n_tokens"), F.array(*[F.col(f"s{i}") * scale + priors[i] for i in range(len(domains))]).alias("z"))
    odds = F.transform("z", lambda x: F.exp(x - F.array_max("z")))
    return rows.withColumn("e", odds).select("doc_id", "key", "copies", "n_tokens", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("p"))


def rate(steps: list[np.ndarray]) -> Column:
    """A document's rate after the steps, each projected to zero or above."""
    r = F.lit(1.0)
    for z in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.col("p")[i] * float(x) for i, x in enumerate(z)), F.lit(0.0)))
    return r


def fit_rates(rows: DataFrame, targets: np.ndarray, rounds: int = 12, close: float = 1e-6) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps whose rates bring the domains' expected tokens to ``targets`` (shares of all tokens), and the shares they reach."""
    k, steps = len(targets), []
    mass = F.col("n_tokens") * F.col("copies")
    total, reached = 0.0, np.zeros(k)
    for _ in range(rounds + 1):
        r = rows.withColumn("r", rate(steps))
        sums = [F.sum(mass * F.col("r") * F.col("p")[i]) for i in range(k)]
        square = [F.sum(F.when(F.col("r") > 0, mass * F.col("p")[i] * F.col("p")[j]).otherwise(0.0)) for i in range(k) for j in range(i, k)]
        got = r.agg(F.sum(mass), *sums, *square).first()
        total = float(got[0] or 0)
        if not total:
            break
        reached = np.array([x or 0.0 for x in got[1 : k + 1]]) / total
        if np.abs(reached - targets).max() < close or len(steps) == rounds:
            break
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = [float(x or 0) / total for x in got[k + 1 :]]
        h = h + np.triu(h, 1).T
        steps.append(np.linalg.solve(h + 1e-9 * max(1e-9, np.trace(h)) * np.eye(k), reached - targets))
    return steps, reached


def wanted(domains: list[str], targets: dict[str, float]) -> np.ndarray:
    """Target shares in the order of ``domains``; domains without a target get none, and the rest is scaled to 1."""
    t = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    return t / t.sum() if t.sum() else np.full(len(domains), 1 / max(1, len(domains)))


# The mixture that the query aims at.
TARGETS = {"good": 0.85, "low": 0.1, "toxic": 0.05}


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> tuple[list[str], DataFrame]:
    """Domains, and (doc_id, key, copies, n_tokens, p, rate) of each distinct document; labels: (doc_id, domain)."""
    domains, weights, priors = classifier(docs, labels)
    if weights is None:
        rows = tokenized(docs).groupBy("doc_id", "key").agg(F.count_if(F.col("place") == 0).alias("copies"), F.count("bucket").alias("all"))
        return [], rows.select("doc_id", "key", "copies", (F.col("all") / F.col("copies")).cast("long").alias("n_tokens"), F.array().cast("array<double>").alias("p"), F.lit(1.0).alias("rate"))
    rows, _ = cut(posteriors(docs, domains, weights, priors), "posteriors")
    steps, _ = fit_rates(rows, wanted(domains, targets))
    return domains, rows.withColumn("rate", rate(steps))


def resampled(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """Each row of ``docs`` as often as its rate says: the whole part, and once more with the broken part as its chance, drawn by a hash of the document."""
    _, rates = mixed(docs, labels, targets)
    chance = F.pmod(F.xxhash64("key", F.lit("draw")), F.lit(1_000_000)) / F.lit(1e6)
    times = F.floor("rate").cast("int") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    i, k, n, copy = fresh(docs, "mix_id", "mix_key", "mix_times", "mix_copy")
    drawn = rates.select(F.col("doc_id").alias(i), F.col("key").alias(k), times.alias(n)).where(F.col(n) > 0)
    met = docs.join(drawn, F.xxhash64("doc_id", "text").eqNullSafe(F.col(k)) & F.col("doc_id").cast("long").eqNullSafe(F.col(i)))
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains, rows = mixed(table(spark, sf_dir, "documents").select("doc_id", "text"), domain_labels(table(spark, sf_dir, "labels")))
    each = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return each.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate")


QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}
