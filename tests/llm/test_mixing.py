"""Mixing: posteriors against a plain classifier, rates against the totals they must meet."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from acquimetra.llm import mixing
from acquimetra.llm.registry import QUERIES
from acquimetra.llm.shared import table

DOC = "doc_id long, text string, rate string, p string, key int"


def fixture(spark):
    a, b, c = "alpha beta gamma " * 6, "delta eps zeta " * 5, "eta theta iota "
    rows = [(i, (a if i % 3 == 0 else b if i % 3 == 1 else c) + f"n{i}", "x", "y", 1) for i in range(60)]
    rows += [(100, None, "", "", 0), (101, "", "", "", 0), (None, "alpha delta", "", "", 0), (3, rows[3][1], "", "", 0)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame([(i, ["A", "B", "C"][i % 3]) for i in range(30)], "doc_id long, domain string")


def test_totals_meet_targets(spark):
    docs, labels = fixture(spark)
    targets = {"A": 0.2, "B": 0.5, "C": 0.3}
    domains, rows = mixing.mixed(docs, labels, targets)
    got = rows.collect()
    assert domains == ["A", "B", "C"]
    assert sum(r.copies for r in got) == 64
    total = sum(r.copies * r.n_tokens for r in got)
    reached = [sum(r.copies * r.n_tokens * r.rate * r.p[k] for r in got) / total for k in range(3)]
    assert reached == pytest.approx([0.2, 0.5, 0.3], abs=1e-5)
    assert min(r.rate for r in got) >= 0
    assert all(sum(r.p) == pytest.approx(1) for r in got)


def test_tokens_are_counted_per_copy(spark):
    docs, labels = fixture(spark)
    _, rows = mixing.mixed(docs, labels)
    by = {(r.doc_id, r.n_tokens): r.copies for r in rows.collect()}
    assert by[(3, 19)] == 2 and by[(100, 0)] == 1 and by[(101, 0)] == 1


def test_classifier_matches_plain_counts(spark):
    docs, labels = fixture(spark)
    domains, weights, priors = mixing.classifier(docs, labels)
    of = {r.doc_id: r.domain for r in labels.collect()}
    counts = {d: Counter() for d in domains}
    rows = mixing.tokenized(docs.join(labels, "doc_id", "left_semi")).where("bucket is not null").collect()
    for r in rows:
        counts[of[r.doc_id]][r.bucket] += 1
    logs = {b: [np.log((counts[d][b] + mixing.SMOOTH) / (sum(counts[d].values()) + mixing.SMOOTH * mixing.BUCKETS)) for d in domains] for b in {r.bucket for r in rows}}
    got = {r.bucket: [r.w0, r.w1, r.w2] for r in weights.collect()}
    assert set(got) == set(logs)
    for b, w in logs.items():
        assert got[b] == pytest.approx((np.array(w) - np.mean(w)).tolist())
    assert np.exp(priors) == pytest.approx([1 / 3] * 3)


def test_no_labels_and_empty_tables(spark):
    docs, labels = fixture(spark)
    domains, rows = mixing.mixed(docs, labels.limit(0))
    assert domains == [] and {r.rate for r in rows.collect()} == {1.0}
    _, none = mixing.mixed(docs.limit(0), labels)
    assert none.count() == 0
    assert mixing.resampled(docs.limit(0), labels).count() == 0


def test_labels_with_ties_and_nulls(spark):
    rows = [(1, 1, 0), (1, 1, 1), (2, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0)]
    got = mixing.domain_labels(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()
    assert sorted(map(tuple, got)) == [(1, "toxic"), (2, "good"), (3, "low")]


def test_rates_are_drawn(spark):
    docs, labels = fixture(spark)
    drawn = mixing.resampled(docs, labels, {"A": 0.1, "B": 0.1, "C": 0.8})
    assert drawn.columns == docs.columns
    of = {(r.doc_id, r.key_): r.rate for r in mixing.mixed(docs, labels, {"A": 0.1, "B": 0.1, "C": 0.8})[1].withColumnRenamed("key", "key_").collect()}
    counts = Counter(r.doc_id for r in drawn.collect())
    for (i, _), rate in of.items():
        copies = 2 if i == 3 else 1
        assert copies * int(rate) <= counts.get(i, 0) <= copies * (int(rate) + 1)


def test_query_meets_targets(spark, sf_dir):
    got = QUERIES["op8_mixing"](spark, sf_dir)
    assert got.count() == table(spark, sf_dir, "documents").count()
    names = [c for c in got.columns if c.startswith("p_")]
    sums = got.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * F.col("rate") * F.col(c)) for c in names]).first()
    want = mixing.wanted([c[2:] for c in names], mixing.TARGETS)
    assert [x / sums[0] for x in sums[1:]] == pytest.approx(want.tolist(), abs=1e-3)


def test_plan_has_no_python(spark, sf_dir):
    plan = QUERIES["op8_mixing"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_words_keep_their_identity_beside_marks_and_any_white_space(spark):
    texts = ["idiot! saint! end.", "idiot saint end", "(idiot)\t'saint,'\r\nend?!", "\u00a0idiot\u3000saint\x0bend ", "!!! ..."]
    rows = mixing.tokenized(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    of = [[r.bucket for r in sorted(rows, key=lambda r: r.place) if r.doc_id == i and r.bucket is not None] for i in range(len(texts))]
    assert of[0] == of[1] == of[2] == of[3] and len(set(of[0])) == 3
    assert len(set(of[4])) == 2 and not set(of[4]) & set(of[0])
