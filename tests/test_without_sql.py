"""Queries that SQL can't express, against plain loops."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from __spark_entry__ import QUERIES
from acquimetra.operators import matching, nearby
from acquimetra.sources.tables import Tables


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_fuzzy_match(spark, sf_dir):
    parts = [(r.p_partkey, r.p_brand, r.p_name) for r in Tables(spark, sf_dir).part.collect()]
    entity = {}
    for k, b, n in parts:
        entity[b, n] = min(k, entity.get((b, n), k))
    want = {}
    for k, b, n in parts:
        n = n.replace("e", "")
        scored = [(2 * lcs(n, m) / (len(n) + len(m)), -e) for (o, m), e in entity.items() if o == b]
        score, e = max(scored)
        if score >= 0.75:
            want[k] = (-e, round(score, 9))
    assert {r.id: (r.entity, round(r.score, 9)) for r in QUERIES["fuzzy_match"](spark, sf_dir).collect()} == want


def test_regional_clusters(spark):
    pts = [(i, i % 2, -30 + i * 37 % 50 / 10, -50 + i * 61 % 50 / 10, float(i * 7 % 11)) for i in range(40)]
    df = spark.createDataFrame(pts, "id long, region int, lat double, lon double, value double")
    want = {}
    for region in (0, 1):
        free = sorted((p for p in pts if p[1] == region), key=lambda p: (-p[4], p[0]))
        cluster = 0
        while free:
            seed, rest = free[0], []
            for p in free:
                a = math.sin(math.radians(p[2] - seed[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(seed[2])) * math.sin(math.radians(p[3] - seed[3]) / 2) ** 2
                if 2 * 6371.0 * math.asin(min(1, math.sqrt(a))) <= 150:
                    want[p[0]] = cluster
                else:
                    rest.append(p)
            free, cluster = rest, cluster + 1
    got = nearby.clusters(df, "id", "lat", "lon", "value", "region").collect()
    assert {r.id: r.cluster for r in got} == want


def test_greedy_dedup(spark):
    texts = ["one two three four five six seven", "one two three four five six seven", "one two three four five six eight", "completely different words here", ""]
    df = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], "id long, t string, block string")
    assert {r.id: r.dropped_for for r in matching.greedy_keep(df, "id", "t", ["block"]).collect()} == {0: None, 1: 0, 2: None, 3: None, 4: None}


def test_greedy_dedup_equals_a_loop(spark):
    """Chains in which a dropped row must not drop others, equal sets, and a null block."""
    texts = [" ".join(f"word{(i * 3 // 2 + k) % 60}" for k in range(20 + i % 2)) for i in range(60)] + ["", "word1 word2"]
    docs = [(i, texts[i % len(texts)], None if i % 5 == 0 else "b") for i in range(150)]
    want, kept = {}, []
    for i, t, b in docs:
        s = set(t.split())
        want[i] = next((k for k, o, c in kept if c == b and s and o and len(s & o) >= 0.85 * len(s | o)), None)
        if want[i] is None:
            kept.append((i, s, b))
    assert any(k is not None and texts[k % 62] != texts[i % 62] for i, k in want.items())
    df = spark.createDataFrame(docs, "id long, t string, block string")
    assert {r.id: r.dropped_for for r in matching.greedy_keep(df, "id", "t", ["block"]).collect()} == want
    assert matching.greedy_keep(df.limit(0), "id", "t", ["block"]).count() == 0


def test_stream_ingest_is_repeatable(spark, sf_dir):
    first, second = (sorted(map(str, QUERIES["stream_ingest"](spark, sf_dir).collect())) for _ in range(2))
    assert first and first == second


def test_links_do_not_depend_on_known_tokens(spark, monkeypatch):
    """All links are found whether all frequent tokens order the sets or only one does."""
    rows = [(i, " ".join(f"word{(i // 3 + j * (1 + i % 3 // 2)) % 11}" for j in range(8)), "x") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, text string, block string")
    sets = {i: set(t.split()) for i, t, _ in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.75}
    for known in (1, 100_000):
        monkeypatch.setattr(matching, "KNOWN", known)
        assert {(r.a, r.b) for r in matching.similar_pairs(df, "id", "text", ["block"]).collect()} == want


def test_similar_pairs_store_no_tokens(spark, monkeypatch):
    """Pairs of large sets just at and below the bound, copies of them, null texts and ids; no tokens are checkpointed."""
    kept = []
    monkeypatch.setattr(matching, "checkpointed", lambda df, real=matching.checkpointed: kept.append(df.dtypes) or real(df))
    base = [[f"w{(i * 211 + k * 7) % 1500:04d}" for k in range(210)] for i in range(12)]
    texts = base + [t[cut:] + [f"new{i}n{k}" for k in range(cut)] for i, t in enumerate(base) for cut in (5, 30, 31)] + base[:3] + [[], ["one", "two", "six"]]
    docs = [(i, " ".join(t), "xy"[i % 48 // 40]) for i, t in enumerate(texts)] + [(900, None, "x"), (None, " ".join(base[0]), "x")]
    sets = {i: (set((t or "").split()), b) for i, t, b in docs if i is not None}
    alike = lambda a, b: a[1] == b[1] and a[0] and 4 * len(a[0] & b[0]) >= 3 * len(a[0] | b[0])
    want = {(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])}
    got = matching.similar_pairs(spark.createDataFrame(docs, "id long, text string, block string"), "id", "text", ["block"]).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want and min(r.similarity for r in got) == 0.75 and (0, 48) in want
    assert kept and not any("array" in kind for columns in kept for _, kind in columns)


def test_equal_names_are_compared_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        seen.add(len(a))
        return pd.Series([matching.indel_ratio(x, y) for x, y in zip(a, b, strict=True)])

    monkeypatch.setattr(matching, "fuzzy_ratio", counted)
    left = spark.createDataFrame([(i, "b", "red bolt" if i % 2 else "blue rin") for i in range(400)], "id long, block string, name string")
    right = spark.createDataFrame([(9, "b", "red bolts"), (7, "b", "red bolts"), (3, "b", "blue ring"), (1, "c", "red bolt")], "entity long, block string, name string")
    got = {r.id: r.entity for r in matching.fuzzy_best(left, right, "id", "entity", "name", "block", 0.75).collect()}
    assert got == {i: 7 if i % 2 else 3 for i in range(400)} and seen.value <= 8
