"""Personal data against plain regular expressions in Python."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from acquimetra.llm import pii
from acquimetra.llm.registry import QUERIES
from acquimetra.llm.shared import table

A = re.ASCII


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def only(v):
    return re.sub("[^0-9]", "", v)


BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda v: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda v: 13 <= len(only(v)) <= 19 and luhn(only(v))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda v: 9 <= len(only(v)) <= 15),
)


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in p.finditer(text or "") if ok(m[0])]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def adversarial():
    rng = random.Random(3)
    bits = ["a@b.co", "x.y+z@host-1.example.org", "@", "a@b", ".", "..", "1.2.3.4", "256.1.1.1", "001.002.003.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", "+49 30 123456", " ", "-", "(", ")", "é", "😀", "_", "%", "\n", "9" * 25, "12345678901234567890", "GB82 WEST 1234 5698 7654 32", "078-05-1120", "my ssn is 078-05-1120", "iban DE89370400440532013000"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    chars = "a1.@+-_ %(9)4é"
    made += ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 40))) for _ in range(600)]
    return [None, "", *made]


def check(rows):
    for r in rows:
        text = r.text or ""
        want = base_spans(text)
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        base = [s for s in spans if s[0] in ("email", "ip", "card", "phone")]
        assert base == want, (text, base, want)
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        for k in ("email", "ip", "card", "phone"):
            assert r[f"n_{k}"] == sum(s[0] == k for s in want)


def query_on(spark, texts, tmp_path):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op5_pii"](spark, str(tmp_path))
    return got.join(df.select("doc_id", "text"), "doc_id").collect()


def test_base_spans_match_plain_patterns(spark, tmp_path):
    texts = adversarial()
    rows = query_on(spark, texts, tmp_path)
    assert len(rows) == len(texts)
    check(rows)


def test_very_long_texts(spark, tmp_path):
    texts = ["a" * 300_000, "1 " * 200_000, "1." * 4_000, "+1" * 100_000, "+1 " + " " * 200_000, "a@" * 100_000, "x " * 100_000 + "me@example.org"]
    rows = query_on(spark, texts, tmp_path)
    assert {r.doc_id: r.n_email for r in rows}[6] == 1
    spans = {r.doc_id: r.spans for r in rows}
    assert spans[0] == spans[3] == ""  # the plain patterns take quadratic time on these two
    check([r for r in rows if r.doc_id not in (0, 3)])


def test_driver_documents(spark, sf_dir):
    rows = QUERIES["op5_pii"](spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == table(spark, sf_dir, "documents").count()
    check(rows)
    assert sum(r.n_email for r in rows) > 0


def test_further_kinds_need_checks_and_context(spark):
    texts = ["account GB82 WEST 1234 5698 7654 32 here", "account GB82 WEST 1234 5698 7654 33 here", "my social security number is 078-05-1120", "part 078-05-1120 of a list", "666-12-1234 ssn"]
    got = pii.with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[s.kind for s in r.pii_spans if s.kind in ("iban", "ssn")] for r in got] == [["iban"], [], ["ssn"], [], []]
    assert got[0].pii_spans[0].value == "GB82 WEST 1234 5698 7654 32"


def test_context_raises_the_score(spark):
    got = pii.with_spans(spark.createDataFrame([(1, "the number +1 555 010 9999"), (2, "phone +1 555 010 9999")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].pii_spans[0].score < got[1].pii_spans[0].score


def test_redaction(spark):
    texts = ["write a@b.co or +1 555 010 9999 now", "none", None, "", "é 😀 1.2.3.4", "a@b.co"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, places int")
    got = pii.redacted(pii.with_spans(df)).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["write <EMAIL> or <PHONE> now", "none", None, "", "é 😀 <IP>", "<EMAIL>"]
    assert {r.places for r in got} == {7}


def test_overlaps_are_covered_by_one_mark(spark):
    df = spark.createDataFrame([(1, "x +4111 1111 1111 1111 y")], "doc_id long, text string")
    assert pii.redacted(pii.with_spans(df)).first().text == "x <CARD> y" or pii.redacted(pii.with_spans(df)).first().text in ("x +<CARD> y", "x <PHONE> y")


def test_plan_has_no_python(spark, sf_dir):
    plan = QUERIES["op5_pii"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert pii.with_spans(spark.createDataFrame([], "doc_id long, text string")).select(F.size("pii_spans")).count() == 0


def test_many_spans_take_time_in_proportion(spark):
    import time

    times = []
    for n in (4_000, 32_000):
        text = "a1@b.co +49 30 1234567 " * (n // 2) + "end"
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        r = pii.redacted(pii.with_spans(docs)).first()
        times.append(time.time() - began)
        assert r.text == "<EMAIL> <PHONE> " * (n // 2) + "end" and len(r.pii_spans) == n
        assert [s.start for s in r.pii_spans[: n // 2]] == list(range(0, 23 * (n // 2), 23))
    assert times[1] < 20


def test_context_lowers_a_score(spark):
    rows = [(1, "bank DE89 3704 0044 0532 0130 00"), (2, "serial DE89 3704 0044 0532 0130 00"), (3, "version 10.2.3.4"), (4, "ip 10.2.3.4")]
    got = {r.doc_id: [(s.kind, s.score) for s in r.pii_spans if s.kind != "card"] for r in pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [("iban", 1.0)], 2: [], 3: [("ip", 0.3)], 4: [("ip", 0.9)]}
