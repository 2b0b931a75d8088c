"""Piece encoding against the public library, and a unigram model against all paths."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest

from acquimetra.llm import pieces
from acquimetra.llm.registry import QUERIES
from acquimetra.llm.shared import table

sentencepiece = pytest.importorskip("sentencepiece")
if not os.path.exists(pieces.MODEL):
    pytest.skip("no vocabulary file", allow_module_level=True)


@pytest.fixture(scope="module")
def both():
    return pieces.Encoder(pieces.load()), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def odd_texts():
    rng = random.Random(4)
    bits = ["the ", "ation", "  ", "\n", "é", "😀", "漢字", "123", "-", "\t", "aaaa", " a", "ing", "▁", "\x00", "zzz"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 20))) for _ in range(300)]
    return ["", " ", "   ", "\n\n", " leading", "trailing ", "two  blanks   three", "a" * 500, *made]


def test_ids_equal_the_library(both):
    own, other = both
    texts = [t for t in odd_texts() if "\x00" not in t]
    assert own.encode(texts) == other.encode(texts)


def test_long_text(both):
    own, other = both
    text = ("x" * 3000 + " word, ") * 20
    assert own.encode([text]) == other.encode([text])


def test_decoding_gives_the_text_back(both):
    own, _ = both
    texts = [t for t in odd_texts() if "▁" not in t]
    assert [own.decode(i) for i in own.encode(texts)] == texts


def test_query_equals_the_library(spark, sf_dir, both):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op7_pieces"](spark, sf_dir).collect()
    assert len(rows) == len(docs) and all(r.lossless for r in rows)
    for r in rows:
        ids = np.array(both[1].encode(docs[r.doc_id]), "<i4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_encode_then_decode_frames(spark):
    rows = [(1, "héllo  wörld", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "n", "x")]
    v = pieces.load()
    coded = pieces.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids string"), v)
    back = sorted((r.id or 0, r.text) for r in pieces.decoded(coded, v).collect())
    assert back == [(0, "n"), (1, "héllo  wörld"), (2, ""), (3, ""), (3, "")]
    assert pieces.encoded(spark.createDataFrame([], "doc_id long, text string"), v).count() == 0


def test_unigram_takes_the_best_path():
    names = {"▁": -3.0, "a": -2.0, "b": -2.2, "ab": -2.5, "▁a": -3.3, "ba": -3.1, "aba": -4.0, "▁ab": -4.4}
    ids = {p: i + 256 for i, p in enumerate(names)}
    v = pieces.Vocabulary(ids, {ids[p]: s for p, s in names.items()}, tuple(range(256)), 0, tuple([bytes([i]) for i in range(256)] + [p.replace("▁", " ").encode() for p in names]), True, True, 3)
    encoder = pieces.Encoder(v)

    def best(word):
        if not word:
            return 0.0
        return max((s + best(word[len(p) :]) for p, s in names.items() if word.startswith(p)), default=-1e9)

    rng = random.Random(0)
    for _ in range(60):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
        got = encoder.encode([text])[0]
        assert encoder.decode(got) == text
        assert sum(v.scores[i] for i in got) == pytest.approx(best("▁" + text))


def test_suffixes_are_sorted():
    codes = np.frombuffer("banana$ananas$".encode("utf-32-le"), np.uint32)
    order = pieces.suffixes(codes, 32)
    tails = [codes[i:].tolist() for i in order]
    assert tails == sorted(tails)


def test_long_words_are_cut_where_no_piece_runs_over():
    """Words of mixed scripts, digits and marks, far over LONG, and one over two chunks: the same ids as the reference encoder."""
    import random

    import sentencepiece as sp

    rng = random.Random(4)
    model = sp.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["".join(rng.choice("abcdefgh0123456789/=?&%.-_ÄßЖ漢字") for _ in range(n)) for n in (65, 300, 5000)]
    texts += ["https://example.org/" + "/".join(f"seg{i}?q={i * 7919}" for i in range(400)), "x" * 3000, "漢字仮名" * 500 + "\0" + "tail" * 40]
    encoder = pieces.Encoder(pieces.load())
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids == model.encode(t)
    begin = np.array([0, 2 * pieces.CHUNK + 10])
    big = ("ab0" * pieces.CHUNK)[: begin[1] - 1]
    start, length, ids = encoder.edges(big + "\0")
    assert len(start) == len(set(zip(start.tolist(), length.tolist(), strict=True))) and (np.diff(start) >= 0).all()
    assert set(ids.tolist()) == set(encoder.edges("ab0" * 20 + "\0")[2].tolist())
