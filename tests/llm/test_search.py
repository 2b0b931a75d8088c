"""Ranked search against its SQL and a plain loop."""

from __future__ import annotations

import math
import re
from collections import Counter

from acquimetra.llm import search
from acquimetra.llm.registry import ORACLES, QUERIES
from tests.compare import duck_rows, spark_rows

SHAPE = "doc_id long, text string, score string, rank int"
ITEMS = "item_id long, text string, doc_id int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=10):
    bags = [(d[0], Counter(words(d[1]))) for d in docs]
    bags = [(i, c) for i, c in bags if c]
    n, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    asked = {}
    for i, text, *_ in items:
        asked.setdefault(i, set()).update(words(text))
    out = set()
    for item, terms in asked.items():
        found = []
        for doc, c in bags:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out |= {(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:k])}
    return out


def got(df, index):
    rows = [(r["item"], r["rank"], r.doc_id, r.score) for r in df.collect()]
    search.drop(df.sparkSession, index.path)
    assert len({(r[0], r[1]) for r in rows}) == len(rows)
    return set(rows)


def made(n):
    vocabulary = [f"w{i}" for i in range(60)] + ["Élan", "naïve", "日本", "The", "THE", "the"]
    docs = [(i, " ".join(vocabulary[(i * i * 7 + k * (i % 5 + 1) * 3) % len(vocabulary)] for k in range(i * 13 % 50)), None, i) for i in range(n)]
    docs += [(None, "w1 w2 w3 the", "s", 0), (None, None, "s", 0), (7, "w1 w2 w3 the", "s", 1), (7, "w1 w2 w3 the", "s", 1), (n, "w5 " * 50_000 + "w6", "long", 2)]
    return docs + [(1000 + i, "copies of one text w9 w10", "copy", 3) for i in range(200)]


QUERY_ROWS = [(1, "w1 W2, w3!", 0), (2, "the the THE", 0), (3, None, 0), (4, "unknown words", 0), (None, "w9 w10 text", 0), (5, "élan Élan naïve 日本 w40", 0), (5, "w41", 1), (6, " ".join(f"w{i}" for i in range(60)), 2)]


def test_query_matches_sql(spark, duck, sf_dir):
    assert spark_rows(QUERIES["op12_search"](spark, sf_dir)) == duck_rows(duck, ORACLES["op12_search"])


def test_against_a_loop(spark, monkeypatch):
    docs, items = spark.createDataFrame(made(300), SHAPE), spark.createDataFrame(QUERY_ROWS, ITEMS)
    for block, queries in ((4096, 256), (7, 2)):
        monkeypatch.setattr(search, "BLOCK_DOCS", block)
        monkeypatch.setattr(search, "QUERY_BLOCK", queries)
        index = search.build(docs)
        assert got(search.search(index, items), index) == brute(made(300), QUERY_ROWS)
    index = search.build(docs)
    assert got(search.search(index, items, 3), index) == brute(made(300), QUERY_ROWS, 3)


def test_joins_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
    index = search.build(spark.createDataFrame(made(60), SHAPE))
    assert got(search.search(index, spark.createDataFrame(QUERY_ROWS, ITEMS)), index) == brute(made(60), QUERY_ROWS)


def test_bytes_bound_the_impacts(spark):
    """The upper level is never below the exact impact, and less than a step above it."""
    index = search.build(spark.createDataFrame(made(80), SHAPE))
    heads = {r.block: r.counts for r in index.postings.where("term is null").collect()}
    for r in index.postings.where("term is not null").collect():
        for place, tf, q in zip(r.places, r.counts, r.impacts, strict=True):
            x = 10**9 * tf // (1000 * tf + 8 * search.norm(heads[r.block][place], index.docs, index.total))
            assert q * search.STEP - search.STEP < x <= q * search.STEP
    search.drop(spark, index.path)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(made(30), SHAPE), spark.createDataFrame(QUERY_ROWS, ITEMS)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0))):
        index = search.build(d)
        assert got(search.search(index, i), index) == set()
