"""URL verdicts against plain loops over rules and token sets."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from acquimetra.llm import urlrules
from acquimetra.llm.registry import QUERIES
from acquimetra.llm.shared import table

SHAPE = "page_id long, url string, host string, verdict string"


def plain(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = []
    for rule, verdict in urlrules.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/es/x", "https://example.org", "https://example.org/", "https://example.org?x=/", "https://example.org#a/b", "http://a.b.example.org/en/12?q=1#f", "http://notexample.org/es/", "http://x.com/de/y",
        "http://com/fr/", "http://x.com:80/de/", "http://x.com/fr/a b", "a://b://c.org/d", "http://É.org/", "http://.org/", "http://org", "http://user@x.org/", "http://x.net/" + "p" * 100_000, "http://x.com/de/y"]


def test_rules_match_plain_loops(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(URLS)]
    got = {r.page_id: r for r in urlrules.judge(spark.createDataFrame(rows, SHAPE), spark.createDataFrame(urlrules.RULES, "rule string, verdict string")).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")


def test_query_on_driver_pages(spark, sf_dir):
    urls = {r.page_id: r.url for r in table(spark, sf_dir, "pages").collect()}
    rows = QUERIES["op4_urlrules"](spark, sf_dir).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_mined_rules_match_counting(spark):
    rows = [(["a", "b"], "block")] * 30 + [(["a", "c"], "allow")] * 40 + [(["b", "c", "d"], "block")] * 25 + [(["d"], None)] * 9 + [(["a", "b"], "allow")] * 3
    least, sure = 20, 0.8
    labelled = [(set(t), v) for t, v in rows if v]
    want = {}
    for size in (1, 2, 3):
        for c in combinations("abcd", size):
            have = [v for t, v in labelled if set(c) <= t]
            for v in ("allow", "block"):
                n = have.count(v)
                if n >= least and n / len(have) >= sure:
                    want[(" ".join(c), v)] = (pytest.approx(n / len(have)), pytest.approx(n / len(labelled)))
    # A rule with a part one token shorter that leads to the same verdict at no less confidence is pruned.
    needless = {(k, v) for (k, v), (c, _) in want.items() for (m, w), (d, _) in want.items() if w == v and set(m.split()) < set(k.split()) and len(m) == len(k) - 2 and d.expected >= c.expected}
    assert needless
    full, want = want, {k: x for k, x in want.items() if k not in needless}
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    rules = urlrules.mine(df.groupBy(F.array_join("tokens", " ").alias("key"), "tokens", "label").agg(F.count(F.lit(1)).alias("n")), 0.01, sure, least)
    assert {(r.rule_id, r.verdict): (r.confidence, r.support) for r in rules.collect()} == want
    sets = df.select(F.array_join("tokens", " ").alias("key"), "tokens").distinct()
    got = {r.key: (r.mined, r.mined_verdict) for r in urlrules.matched(sets, rules).collect()}
    for r in sets.collect():
        fits = [(c, s, len(k.split()), k, v) for (k, v), (c, s) in ((x, (y[0].expected, y[1].expected)) for x, y in want.items()) if set(k.split()) <= set(r.tokens)]
        assert got.get(r.key) == (max(fits)[3:] if fits else None)
        every = [(c.expected, v) for (k, v), (c, _) in full.items() if set(k.split()) <= set(r.tokens)]
        assert not every or got[r.key][1] in {v for c, v in every if c == max(every)[0]}


def test_empty_tables(spark):
    rules = spark.createDataFrame(urlrules.RULES, "rule string, verdict string")
    assert urlrules.judge(spark.createDataFrame([], SHAPE), rules).count() == 0
    one = urlrules.judge(spark.createDataFrame([(1, "http://x.net/", "", "")], SHAPE), rules.limit(0)).first()
    assert (one.rule, one.verdict) == (None, "allow")


def test_repeated_long_urls_and_labels_of_ones_own(spark):
    """500 equal URLs of 60 segments beside others: the rules stay short, and their verdict follows the labels."""
    long = "http://x.net/" + "/".join(f"s{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(i, long, "", "") for i in range(500)] + [(500 + i, f"http://y{i % 7}.net/{'ok' if i % 2 else 'bad'}/{i}", "", "") for i in range(300)] + [(900, long + "/more", "", ""), (901, "http://z.net/bad/x", "", "")]
    labels = [(long, "block"), *[(u, "block" if "bad" in u else "allow") for u in {r[1] for r in rows[500:800]}]]
    none = spark.createDataFrame(urlrules.RULES, "rule string, verdict string").limit(0)
    got = {r.page_id: r for r in urlrules.judge(spark.createDataFrame(rows, SHAPE), none, spark.createDataFrame(labels, "url string, label string")).collect()}
    assert len(got) == len(rows) and all(got[i].verdict == "block" for i in range(500))
    assert got[900].verdict == "block" and got[901].verdict == "block" and got[501].verdict == "allow"
    assert max(len(r.mined.split(" ")) for r in got.values() if r.mined) <= urlrules.MOST


def test_long_baskets_are_mined_whole(spark):
    """Fourteen tokens that mostly occur together, and labels that hang on two of them: all rules against counting over all token sets."""
    rng, names = random.Random(3), "abcdefghijklmn"
    sets = [frozenset(t for t in names if rng.random() < 0.75) for _ in range(240)]
    labelled = [(t, "block" if {"m", "n"} <= t or rng.random() < 0.3 else "allow") for t in sets if t]
    least, sure = 48, 0.8
    assert max(map(len, sets)) > urlrules.MOST
    want = {}
    for size in range(1, len(names) + 1):
        for c in combinations(names, size):
            have = [v for t, v in labelled if t.issuperset(c)]
            for v in ("allow", "block"):
                if (n := have.count(v)) >= least and n / len(have) >= sure:
                    want[c, v] = n / len(have)
    want = {(c, v): p for (c, v), p in want.items() if not any(want.get((c[:i] + c[i + 1 :], v), 0) >= p for i in range(len(c)))}
    rows = [(f"{i}", sorted(t), v, 1) for i, (t, v) in enumerate(labelled)]
    got = urlrules.mine(spark.createDataFrame(rows, "key string, tokens array<string>, label string, n long"), 0.01, sure, least).collect()
    assert {(tuple(r.tokens), r.verdict) for r in got} == set(want) and any(len(c) > 1 for c, _ in want)


def test_a_token_of_one_label_is_a_rule_by_itself(spark):
    rows = [("1", ["a", "b"], "block", 30), ("2", ["b", "c"], "allow", 30), ("3", ["b"], "allow", 5), ("4", ["d"], "block", 3)]
    got = urlrules.mine(spark.createDataFrame(rows, "key string, tokens array<string>, label string, n long"), 0.01, 0.8, 20).collect()
    assert {(r.rule_id, r.verdict, r.confidence, r.support, r.rare) for r in got} == {("a", "block", 1.0, 30 / 68, "a"), ("c", "allow", 1.0, 30 / 68, "c")}
