"""The divergence audit against its SQL and a plain loop."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from acquimetra.llm import divergence
from acquimetra.llm.registry import ORACLES, QUERIES
from tests.compare import duck_rows, spark_rows

SHAPE = "text string, lang string, source string, item int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=50):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source, *_ in rows]
    held, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        groups[lang].add(source)
        held[lang].update(set(words))
        count[lang, source].update(words)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        whole = sum((count[lang, s] for s in sources), Counter())

        def shares(c):
            base = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // base for t in kept}

        q, p = shares(whole), {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(ordered) if part == "pair" or i < top}
    return out


def got(df):
    rows = [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_matches_sql(spark, duck, sf_dir):
    assert spark_rows(QUERIES["op11_divergence"](spark, sf_dir)) == duck_rows(duck, ORACLES["op11_divergence"])


def test_against_a_loop(spark):
    """Nulls, empty groups, capitals beyond ASCII, ties, repeated rows, a column of a clashing name, a long text."""
    words = "alpha Beta GAMMA delta Élan élan ÉLAN x1y2 naïve 日本 o'clock".split()
    rows = [(" ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 9)), [None, "en", "de"][i % 3], ["s", "t", None, "Ü"][i % 4], i) for i in range(240)]
    rows += [(None, "en", "only-null", 0), ("", "en", ""  , 1), ("123 !!!", "xx", "a", 2), (None, "xx", "b", 3), ("rare", "yy", "solo", 4)]
    rows += [("alpha beta " * 40_000, "en", "long", 5)] + [("same text alpha", "en", "hot", 6)] * 300
    for least in (1, 12):
        assert got(divergence.audit(spark.createDataFrame(rows, SHAPE), least)) == brute(rows, least)
    assert got(divergence.audit(spark.createDataFrame(rows, SHAPE), 1, top_terms=2)) == brute(rows, 1, 2)


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FLUSH", 3)
    rows = [(f"w{i % 7} common v{i}", "en", f"s{i % 3}", 0) for i in range(90)]
    df = spark.createDataFrame(rows, SHAPE)
    exact = Counter()
    for r in divergence.term_counts(df).collect():
        exact[r.source, r.term] += r.n
    assert exact["s0", "common"] == 30 and sum(exact.values()) == 270 - 0
    assert got(divergence.audit(df, 30)) == brute(rows, 30)


def test_shuffled_source_lists(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    rows = [(f"a b{i % 4} c{i % 5}", f"l{i % 2}", f"s{i % 6}", 0) for i in range(80)]
    assert got(divergence.audit(spark.createDataFrame(rows, SHAPE), 2)) == brute(rows, 2)


def test_share_holds_large_counts(spark):
    for n, base in ((5, 5), (10**14 + 5, 9 * 10**14), (10**14, 10**14 + 1), (7, 9 * 10**15)):
        row = spark.range(1).select(divergence.share(divergence.F.lit(n), divergence.F.lit(base)).alias("p")).first()
        assert row.p == 1 + 10**9 * n // base


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SHAPE)).collect() == []
