"""Language identification: accuracy on documents it never learnt from, gradients, odd texts."""

from __future__ import annotations

import zlib

import numpy as np

from acquimetra.llm import langid
from acquimetra.llm.registry import QUERIES
from acquimetra.llm.shared import table

SHAPE = "doc_id long, text string, lang string, letters string"


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in table(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op3_langid"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    known = [r for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert len(known) > 20
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in known]) >= 0.9


def samples():
    words = {"aa": "alpha beta gamma delta", "bb": "xylo zort quizz wykk"}
    return [(i, " ".join(words[k].split()[(i + j) % 4] for j in range(30)), k, "x") for i in range(60) for k in [("aa", "bb")[i % 2]]]


def test_odd_texts(spark):
    langs, model = langid.fit(spark.createDataFrame(samples(), SHAPE))
    assert langs == ["aa", "bb"]
    odd = [(None, None, None, ""), (1, "", None, ""), (2, "123 !?", "aa", ""), (3, "zort quizz wykk xylo " * 20_000, None, ""), (4, "alpha beta gamma delta alpha beta", None, ""), (4, "alpha beta gamma delta alpha beta", None, "")]
    df = spark.createDataFrame(odd, SHAPE)
    got = sorted((r.id or 0, r.lang_pred) for r in langid.predict(df, langs, model).collect())
    assert got == [(0, "und"), (1, "und"), (2, "und"), (3, "bb"), (4, "aa"), (4, "aa")]
    kept = langid.keep(df, langs, model, 0.3)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 4]


def test_nothing_labelled_and_empty(spark):
    none = spark.createDataFrame([(1, "text", None, "")], SHAPE)
    langs, model = langid.fit(none)
    assert (langs, model) == ([], None)
    assert langid.predict(none, langs, model).first().lang_pred == "und"
    assert langid.predict(none.limit(0), langs, model).count() == 0


def test_windows_cover_whole_texts():
    texts = [b"", None, b"A" * 255, b"b" * 256, b"c" * 700]
    x, first, used = langid.windows(texts)
    assert first.tolist() == [0, 1, 2, 3, 4] and len(x) == 7
    assert used.tolist() == [1, 1, 255, 256, 256, 256, 188]
    assert x[2, 0] == ord("a") and x[6, 187] == ord("c") and x[6, 188] == 0


def test_folded_tables_give_the_networks_output():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (20, langid.WINDOW), dtype=np.uint8)
    p = langid.train(x, rng.integers(0, 3, 20), 3, epochs=2)
    h = []
    for w in langid.WIDTHS:
        maps = np.stack([p["e"][x[:, i : i + w]].reshape(20, -1) @ p[f"w{w}"] for i in range(langid.WINDOW - w + 1)], axis=1)
        h.append(maps.max(axis=1) + p[f"b{w}"])
    z = np.maximum(np.concatenate(h, axis=1), 0) @ p["v"] + p["c"]
    q = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(langid.posteriors(x, p, langid.folded(p)), q / q.sum(axis=1, keepdims=True), atol=1e-4)
