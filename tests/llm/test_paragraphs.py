"""Shared passages: planted copies are found, clean documents are left alone, links equal brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from acquimetra.llm import paragraphs
from acquimetra.llm.registry import QUERIES
from acquimetra.llm.shared import table

SHAPE = "doc_id long, text string, start string, low string"


def prose(rng, n):
    out = []
    while len(out) < n:
        out += ["W" + str(rng.randrange(10**6)), *[f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(6, 12))], f"e{rng.randrange(10**6)}."]
    return out[:n]


def planted():
    rng = random.Random(6)
    shared = [prose(rng, 90) for _ in range(5)]
    rows = []
    for i in range(60):
        words = prose(rng, 400)
        if i < 20:
            piece = list(shared[i % 5])
            if i >= 10:
                piece[60] = "altered"  # near copies, of which 60 words are equal
            at = rng.randrange(50, 300)
            words = words[:at] + piece + words[at:]
        rows.append((i, " ".join(words), "x", "y"))
    return rows


def test_planted_passages(spark):
    rows = planted()
    odd = [(None, rows[0][1], "", ""), (100, None, "", ""), (101, "", "", ""), (102, "too few words", "", ""), (rows[3][0], rows[3][1], "", "")]
    got = {r.doc_id: r for r in paragraphs.repeated(spark.createDataFrame(rows + odd, SHAPE)).collect()}
    assert {(i, r.class_id) for i, r in got.items()} == {(i, i % 5) for i in range(20)}
    for i, r in got.items():
        assert r.removed == (i != i % 5) and r.passages == len(r.spans) == 1
        (span,) = r.spans
        words = rows[i][1][span.start : span.stop].split()
        assert span.owner == i % 5 and 74 <= len(words) <= 90 and " ".join(words) in rows[i][1]


def test_long_text_copies_and_empty(spark):
    rng = random.Random(1)
    long = " ".join(prose(rng, 60_000))
    got = paragraphs.repeated(spark.createDataFrame([(5, long, "", ""), (2, long, "", ""), (9, " ".join(prose(rng, 500)), "", "")], SHAPE)).collect()
    assert {r.class_id for r in got if r.doc_id in (2, 5)} == {2} and 9 not in {r.doc_id for r in got}
    assert paragraphs.repeated(spark.createDataFrame([], SHAPE)).count() == 0


def test_bucket_links_equal_brute_force():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(12):
        base = rng.integers(0, 1 << 32, 16, dtype=np.uint32)
        for k in range(5):
            x = base.copy()
            x[rng.integers(0, 16, k)] = rng.integers(0, 1 << 32, k, dtype=np.uint32)
            rows.append(np.sort(x))
    sh = np.stack(rows)
    root = list(range(len(sh)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sh)):
        for j in range(i):
            a, b = set(sh[i].tolist()), set(sh[j].tolist())
            if len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    want = {frozenset(k for k in range(len(sh)) if find(k) == find(i)) for i in range(len(sh))}
    mine = list(range(len(sh)))
    n, links = len(sh), []
    for x in range(3):  # three blocks: each alone and each with each other
        for y in range(x, 3):
            at = [i for i in range(n) if i % 3 in (x, y)]
            links += paragraphs.bucket_links(at, [np.unique(sh[i]) for i in at], np.array([int(i % 3 != x) for i in at]), 0.8)
    assert len(paragraphs.bucket_links(list(range(n)), [np.unique(x) for x in sh], np.zeros(n, int), 0.8)) == n - len(want)
    for a, b in links:
        mine = [mine[a] if x == mine[b] else x for x in mine]
    assert {frozenset(k for k in range(len(sh)) if mine[k] == mine[i]) for i in range(len(sh))} == want


def test_units_are_their_words():
    texts = ["É ü " + " ".join(prose(random.Random(2), 200)), "one two three four five six", "", "a\n" + " ".join(f"x{i}" for i in range(60)) + "\nb"]
    windows, lines = paragraphs.units([t.encode() for t in texts])
    for d, w, a, b in zip(windows["text"], windows["word"], windows["start"], windows["stop"], strict=True):
        assert texts[d][a:b].split() == texts[d].split()[w:][: paragraphs.UNIT if d != 1 else 6]
    assert len(set(windows["content"].tolist())) == len(windows["content"])
    assert [(d, len(texts[d][a:b].split())) for d, a, b in zip(lines["text"], lines["start"], lines["stop"], strict=True)] == [(0, 202), (1, 6), (3, 60)]
    assert np.diff(lines["offsets"]).tolist() == [198, 2, 56] and lines["bands"].shape == (3, paragraphs.BANDS)


def test_query_equals_a_plain_search(spark, sf_dir):
    """Documents with 50 equal words in a row share a class; every span has a window that another document holds; all else is left out."""
    texts = {r.doc_id: r.text.lower().encode() for r in table(spark, sf_dir, "documents").collect() if r.text}
    words = {i: t.split() for i, t in texts.items()}
    got = {r.doc_id: r for r in QUERIES["op1_paragraphs"](spark, sf_dir).collect()}

    def runs(n):
        out = {}
        for i, w in words.items():
            for k in range(len(w) - n + 1):
                out.setdefault(b" ".join(w[k : k + n]), set()).add(i)
        return out

    for ids in runs(50).values():
        if len(ids) > 1:
            assert len({got[i].class_id for i in ids}) == 1
    whole = {}
    for i, w in words.items():
        if len(w) >= 5:
            whole.setdefault(b" ".join(w), set()).add(i)
    for ids in whole.values():
        if len(ids) > 1:
            assert len({got[i].class_id for i in ids}) == 1
    short = runs(5)
    shingles = {i: {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    for i, r in got.items():
        assert r.class_id <= i and r.removed == any(s.split(":")[2] != str(i) for s in r.spans.split(","))
        for s in r.spans.split(","):
            a, b, owner = map(int, s.split(":"))
            part = texts[i].decode()[a:b].encode().split()
            mine = {b" ".join(part[k : k + 5]) for k in range(len(part) - 4)}
            assert any(len(short[x] - {i}) for x in mine)
            if owner != i:
                assert mine & shingles[owner]


def test_exact_copies_of_every_length_are_found(spark):
    rows = []
    for n in range(5, 61):
        text = " ".join(f"t{n}x{i}" for i in range(n))
        rows += [(n, text, "", ""), (1000 + n, text, "", "")]
    got = {(r.doc_id, r.class_id) for r in paragraphs.repeated(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == {(i, n) for n in range(5, 61) for i in (n, 1000 + n)}
    windows, _ = paragraphs.units([t.encode() for _, t, *_ in rows])
    assert set(windows["text"].tolist()) == set(range(len(rows)))


def test_near_copies_with_a_changed_middle_word_are_found(spark):
    rng = random.Random(17)
    rows, want = [], set()
    for g in range(60):  # passages of 50 to 70 words in longer texts, one word changed, added or taken out at any place
        words = prose(rng, 70 if g % 3 == 0 else 50 + g % 21)
        at = 35 if g % 3 == 0 else g % len(words)
        near = words[:at] + [["altered"], ["altered", words[at]], []][g % 9 // 3] + words[at + 1 :]
        for k, piece in enumerate((words, near)):
            rows.append((2 * g + k, " ".join(prose(rng, 120) + piece + prose(rng, 100)), "", ""))
        want |= {(2 * g, 2 * g), (2 * g + 1, 2 * g)}
    assert {(r.doc_id, r.class_id) for r in paragraphs.repeated(spark.createDataFrame(rows, SHAPE)).collect()} == want


@pytest.mark.parametrize("gap", [" ", "", "\t"])
def test_runs_without_sentences_are_found(spark, gap):
    """50 words or more without capitals or marks; without spaces as well, where 200 words are 1,400 characters in a row."""
    rng = random.Random(18)
    plain = lambda n: [f"p{rng.randrange(10**5, 10**6)}" for _ in range(n)]
    rows = []
    for g in range(40):
        run = plain(50 + g if gap else 200)
        rows += [(2 * g + k, gap.join(plain(80) + run + plain(90)), "", "") for k in range(2)]
    got = {(r.doc_id, r.class_id) for r in paragraphs.repeated(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == {(2 * g + k, 2 * g) for g in range(40) for k in range(2)}


def test_shorter_runs_leave_documents_alone(spark):
    rng = random.Random(19)
    rows = []
    for g in range(30):
        run = [f"r{rng.randrange(10**6)}" for _ in range(33)]
        rows += [(2 * g + k, " ".join(prose(rng, 80) + run + prose(rng, 90)), "", "") for k in range(2)]
    assert paragraphs.repeated(spark.createDataFrame(rows, SHAPE)).count() == 0


def test_near_lines_are_found_by_bands(spark):
    """Lines of 150 words with a change every 30 words: no equal run is long, the Jaccard similarity is about 0.8 or more, as brute force says."""
    rng = random.Random(20)
    rows, want = [], set()
    for g in range(30):
        line = prose(rng, 180)
        near = [f"n{k}" if k in (45, 100, 150) else w for k, w in enumerate(line)]
        sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (line, near)]
        assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
        rows += [(2 * g, "first\n" + " ".join(line), "", ""), (2 * g + 1, " ".join(near) + "\nlast", "", "")]
        want |= {(2 * g, 2 * g), (2 * g + 1, 2 * g)}
    docs = spark.createDataFrame(rows, SHAPE)
    links = paragraphs.near_paragraphs(paragraphs.read(docs).where("sh is not null")).count()
    assert links == 30
    assert {(r.doc_id, r.class_id) for r in paragraphs.repeated(docs).collect()} == want


@pytest.mark.parametrize("words", [1, 15, 16, 23, 24, 25, 33, 50, 200])
def test_windows_equal_a_plain_loop(words):
    rng = random.Random(words)
    texts = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(words)).encode() for _ in range(3)] + [b"same " * words]
    windows, _ = paragraphs.units(texts)
    for d, t in enumerate(texts):
        places = windows["word"][windows["text"] == d].tolist()
        assert places == sorted(set(places)) and bool(places) == (words >= paragraphs.SHINGLE)
        for a in range(words - paragraphs.UNIT - paragraphs.GAP + 2):
            assert any(a <= p < a + paragraphs.GAP for p in places)
        alone, _ = paragraphs.units([t])
        assert alone["word"].tolist() == places and alone["content"].tolist() == windows["content"][windows["text"] == d].tolist()
