"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np

from acquimetra.llm import ann, shared
from acquimetra.llm.registry import QUERIES
from acquimetra.llm.shared import table

SHAPE = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k=20):
    """{query: [(id, score)]} over rows (id, vector) that may take part."""
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in ok.items():
        if q % 20 == 0:
            out[q] = sorted(((i, float((w * v).sum())) for i, w in ok.items() if i != q), key=lambda x: (-x[1], x[0]))[:k]
    return out


def recall(got, want):
    hits = {}
    for r in got:
        hits.setdefault(r.query_id, []).append(r)
    found = 0
    for q, best in want.items():
        own = sorted(hits.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(best) + 1))
        assert [(r.score, -r.vec_id) for r in own] == sorted([(r.score, -r.vec_id) for r in own], reverse=True)
        floor = best[-1][1] if best else 0
        found += sum(r.score >= floor - 1e-9 for r in own)
    assert set(hits) <= set(want)
    return found / max(1, sum(map(len, want.values())))


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    assert recall(QUERIES["op10_ann"](spark, sf_dir).collect(), brute(rows)) >= 0.9


def test_several_blocks_and_shelves(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "ASKING", 10)
    vectors = table(spark, sf_dir, "embeddings")
    assert recall(ann.nearest(vectors).collect(), brute([(r.vec_id, r.embedding) for r in vectors.collect()])) >= 0.9


def test_odd_vectors_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).astype("float32").tolist(), 0, "clash") for i in range(1, 70)]
    same = rows[3][1]
    rows += [(i, same, 0, "") for i in range(100, 160)]
    rows += [(200, None, 0, ""), (220, [], 0, ""), (240, [0.0] * 4, 0, ""), (260, [1.0, None, 0.0, 0.0], 0, ""), (280, [float("nan"), 1.0, 1.0, 1.0], 0, ""), (300, [float("inf"), 1.0, 1.0, 1.0], 0, ""), (None, same, 0, "")]
    got = ann.nearest(spark.createDataFrame(rows, SHAPE)).collect()
    want = brute([r[:2] for r in rows])
    assert recall(got, want) >= 0.9
    exact = {(r.query_id, r.vec_id): r.score for r in got}
    vec = {i: np.array(v, float) for i, v, *_ in rows if i is not None and v is not None and None not in v}
    assert all(abs(s - (vec[a] * vec[b]).sum()) < 1e-12 for (a, b), s in exact.items())
    for q in (100, 120, 140):  # copies of a vector: the smallest ids come first at equal scores
        own = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        assert [i for _, i in own] == [i for i, _ in want[q]]


def test_few_candidates_and_empty(spark):
    got = ann.nearest(spark.createDataFrame([(20, [1.0, 0.0], 0, ""), (7, [0.5, 1.0], 0, "")], SHAPE)).collect()
    assert [tuple(r) for r in got] == [(20, 1, 7, 0.5, 2)]
    assert ann.nearest(spark.createDataFrame([], SHAPE)).count() == 0


def test_structured_vectors_meet_few_candidates(spark, monkeypatch):
    """Clusters: queries go to the places of their own prefixes, find at least 0.9 of brute force, and meet well under a fifth of all vectors."""
    monkeypatch.setattr(ann, "BLOCK", 1000)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(80, 32))
    v = centres[rng.integers(0, 80, 12_000)] + rng.normal(size=(12_000, 32)) * 0.15
    vectors = spark.createDataFrame([(i, x.tolist(), 0, "") for i, x in enumerate(v.astype("float32"))], SHAPE).cache()
    sample = v[:3000]
    trees, bits = ann.routed(sample, ann.Forest(sample, float(np.sqrt((v * v).sum(axis=1)).max())), 20, len(v))
    assert trees < 1 << bits
    got, path = shared.cut(ann.nearest(vectors), "found")
    rows = got.collect()
    assert recall(rows, brute([(r.vec_id, r.embedding) for r in vectors.collect()])) >= 0.9
    assert ann.recall(vectors, got, 30) >= 0.9
    assert np.mean([r.candidates for r in rows if r["rank"] == 1]) < 0.2 * len(v)
    shared.drop(spark, path)
    vectors.unpersist()
