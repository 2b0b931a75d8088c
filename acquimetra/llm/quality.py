"""Quality scores by a regularised quadratic discriminant on statistics of whole documents.

``statistics`` reduces every text to a few transformed numbers (sizes as logarithms, shares as log odds), computed once
and written, so that no text is shuffled. ``fit`` joins them to the labels and sums each class's moments on the
executors; only these sums reach the driver, so all labelled rows count and no sample is drawn. Each class's covariance is shrunk towards the
diagonal of the pooled one, more so the fewer rows it has, and its Cholesky factor is kept with the model. A score is the
posterior of label 1: the difference of the classes' log densities, from Mahalanobis distances by those factors, and of
their priors.

Defined results: null and empty texts have statistics like any other text; a null doc_id is scored and never learned from;
repeated rows count and are returned each; repeated labels of an id take the least quality; labels without a quality are ignored;
without labels every score is 0.5, with a single class its smoothed share; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, table

NAMES = ("size", "words", "word_length", "upper", "digits", "stops", "symbols", "wide", "distinct", "commonest", "marked", "short", "lines", "repeated_lines", "entropy", "repeated_pairs")
#: Least share in log odds, ridge in units of the pooled variance, score from which a document is predicted good, and the damping of the log density difference.
LEAST, RIDGE, THRESHOLD, DAMPING = 1e-3, 0.02, 0.3, 4.0
_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 6
_SYMBOLS = bytes(b for b in range(256) if _KIND[b] == 0)


def _odds(x: float) -> float:
    x = min(1 - LEAST, max(LEAST, x))
    return float(np.log(x / (1 - x)))


def measured(text: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of ``NAMES``."""
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    symbols, upper, lower, digits, wide, _, stops = np.bincount(_KIND, seen, minlength=7)[:7]
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))  # noqa: B905
    lines = [x for x in text.split(b"\n") if x.strip()]
    p = seen[seen > 0] / size
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        float(np.log1p(sum(map(len, words)) / n)),
        _odds(upper / max(1, upper + lower)),
        _odds(digits / size),
        _odds(stops / size),
        _odds(symbols / size),
        _odds(wide / size),
        _odds(len(counts) / n),
        _odds(max(counts.values(), default=0) / n),
        _odds(sum(w[-1:] in _SYMBOLS for w in words) / n),
        _odds(sum(len(w) <= 3 for w in words) / n),
        float(np.log1p(len(lines))),
        _odds(1 - len(set(lines)) / max(1, len(lines))),
        float(-(p * np.log2(p)).sum()),
        _odds(1 - pairs / max(1, len(words) - 1)) if len(words) > 1 else _odds(0),
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([measured(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), x], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """Per class (0, 1): mean, Cholesky factor, sum of the logarithms of its diagonal; and the log odds of label 1. Without means only the latter counts."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    half_logs: list[float]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of label 1 for every row of ``x``."""
        gap = np.full(len(x), self.prior)
        for sign, mean, factor, half in zip((-1, 1), self.means, self.factors, self.half_logs, strict=False):
            z = np.linalg.solve(factor, (x - mean).T)
            gap = gap - sign * (0.5 * (z * z).sum(axis=0) + half) / DAMPING
        return 1 / (1 + np.exp(-np.clip(gap, -30, 30)))


def moments(labelled: DataFrame) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of ``x`` for quality 0 and 1."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False)
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), d)
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
        at = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel())], names=["at", "v"])

    got = np.zeros((2, 1 + d + d * d))
    for r in labelled.select("x", "y").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        got.flat[r["at"]] = r["v"]
    return [(g[0], g[1 : 1 + d], g[1 + d :].reshape(d, d)) for g in got]


def discriminant(parts: list[tuple[float, np.ndarray, np.ndarray]]) -> Model:
    """The model of the classes' moments."""
    n0, n1 = parts[0][0], parts[1][0]
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    if not n0 or not n1:
        return Model([], [], [], prior)
    d = len(parts[0][1])
    means = [s / n for n, s, _ in parts]
    spread = [q / n - np.outer(m, m) for (n, _, q), m in zip(parts, means, strict=True)]
    pooled = (n0 * spread[0] + n1 * spread[1]) / (n0 + n1)
    own = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors = []
    for (n, _, _), c in zip(parts, spread, strict=True):
        shrink = 2 * d / (2 * d + n)
        factors.append(np.linalg.cholesky((1 - shrink) * c + (shrink + RIDGE) * own))
    return Model(means, factors, [float(np.log(np.diag(f)).sum()) for f in factors], prior)


def marks(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of a table of labels."""
    return labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """A model from the statistics of labelled rows; labels: (doc_id, y)."""
    return discriminant(moments(stats.join(labels, "doc_id")))


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose labels training never sees: 5 divides the crc32 of the id's text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, _ = cut(statistics(table(spark, sf_dir, "documents")), "statistics")
    model = fit(stats.where(~held_out()), marks(table(spark, sf_dir, "labels")))
    return scored(stats, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op13_quality": op13_quality}
ORACLES: dict[str, str] = {}
