"""The quality discriminant: held-out accuracy, a plain log density, and defined rows."""

from __future__ import annotations

import zlib

import numpy as np

from acquimetra.llm import quality
from acquimetra.llm.registry import QUERIES

SHAPE = "doc_id long, text string, score string, x int"
MARKS = "doc_id long, quality int"
BIG = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(np.argsort(score))
    ones = y.sum()
    return (order[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))


def test_query(spark):
    """Every row has a score, labels of held-out rows are never needed, and held-out rows are told apart."""
    rows = QUERIES["op13_quality"](spark, BIG).collect()
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    own = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    s, p, y = map(np.array, zip(*own, strict=True))
    assert auc(s, y) > 0.99 and p[y == 1].mean() > 0.97 and p[y == 0].mean() < 0.1


def test_model_is_the_log_density_difference(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join("".join(rng.choice(list("abcDE#1 é"), 4)) for _ in range(rng.integers(0, 40))), None, i) for i in range(200)]
    labels = [(i, int(len(docs[i][1]) > 60)) for i in range(0, 200, 2)] + [(0, 1), (None, 1), (4, None), (999, 1)]
    stats = quality.statistics(spark.createDataFrame(docs, SHAPE))
    model = quality.fit(stats, quality.marks(spark.createDataFrame(labels, MARKS)))
    got = {r.doc_id: r.score for r in quality.scored(stats, model).collect()}
    x = {i: np.array(quality.measured(t.encode())) for i, t, *_ in docs}
    y = {}
    for i, q in labels:
        if i in x and q is not None:
            y[i] = min(q, y.get(i, 1))
    d, groups = len(quality.NAMES), [np.array([x[i] for i in y if y[i] == c]) for c in (0, 1)]
    mean = [g.mean(0) for g in groups]
    cov = [(g - m).T @ (g - m) / len(g) for g, m in zip(groups, mean, strict=True)]
    pooled = sum(len(g) * c for g, c in zip(groups, cov, strict=True)) / sum(map(len, groups))
    own = np.diag(np.maximum(np.diag(pooled), 1e-6))
    logs = []
    for i in sorted(x):
        dens = []
        for g, m, c in zip(groups, mean, cov, strict=True):
            a = 2 * d / (2 * d + len(g))
            s = (1 - a) * c + (a + quality.RIDGE) * own
            dens.append(-0.5 * (x[i] - m) @ np.linalg.inv(s) @ (x[i] - m) - 0.5 * np.linalg.slogdet(s)[1])
        logs.append((dens[1] - dens[0]) / quality.DAMPING + np.log((len(groups[1]) + 1) / (len(groups[0]) + 1)))
    want = 1 / (1 + np.exp(-np.clip(logs, -30, 30)))
    assert np.allclose([got[i] for i in sorted(x)], want, rtol=1e-6, atol=1e-9)


def test_statistics_by_plain_counting():
    text = "Ab cd!! 12 é.\nAb cd!! 12 é.\nrest"
    got = dict(zip(quality.NAMES, quality.measured(text.encode()), strict=True))
    odds = lambda a, b: np.log(a / b / (1 - a / b))
    assert np.isclose(got["upper"], odds(2, 12)) and np.isclose(got["digits"], odds(4, 34)) and np.isclose(got["symbols"], odds(4, 34)) and np.isclose(got["wide"], odds(4, 34))
    assert np.isclose(got["distinct"], odds(5, 9)) and np.isclose(got["marked"], odds(2, 9)) and np.isclose(got["repeated_lines"], odds(1, 3)) and np.isclose(got["words"], np.log(10))
    assert np.isclose(got["repeated_pairs"], odds(3, 8)) and len(quality.measured(b"")) == len(quality.NAMES)


def test_defined_rows(spark):
    """Nulls, empty and long texts, repeated rows, no labels, one class, empty tables."""
    docs = [(1, None, "a", 1), (2, "", "b", 2), (None, "words here", "c", 3), (4, "long text " * 60_000, "d", 4), (5, "same", "e", 5), (5, "same", "e", 5)]
    df = spark.createDataFrame(docs, SHAPE)
    stats = quality.statistics(df)
    none = quality.fit(stats, quality.marks(spark.createDataFrame([], MARKS)))
    assert sorted((r.doc_id or 0, r.score) for r in quality.scored(stats, none).collect()) == [(0, 0.5), (1, 0.5), (2, 0.5), (4, 0.5), (5, 0.5), (5, 0.5)]
    one = quality.fit(stats, quality.marks(spark.createDataFrame([(1, 1), (5, 1), (7, 1)], MARKS)))
    assert {round(r.score, 9) for r in quality.scored(stats, one).collect()} == {round(4 / 5, 9)}
    both = quality.fit(stats, quality.marks(spark.createDataFrame([(1, 1), (2, 1), (4, 0), (5, 0)], MARKS)))
    got = {r.doc_id: r.score for r in quality.scored(stats, both).collect()}
    assert got[1] == got[2] > 0.5 > got[4] and len(got) == 5
    assert quality.scored(quality.statistics(df.limit(0)), both).count() == 0
