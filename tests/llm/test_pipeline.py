"""The five stages, each on a small input of its own, and run() against them in a row."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
from acquimetra.llm import mixing
from acquimetra.llm.shared import table

STAGES = dict(corpus_pipeline.STAGES)


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "personal_data", "mixing", "pieces"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_stage_rejects_only_what_has_no_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(-1, None, None, "s", 0), (-2, "123 456 !!", None, "s", 10), (-3, "", "en", "s", 0)], docs.schema)
    kept = STAGES["language_id"](spark, docs.unionByName(odd), sf_dir)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    lettered = {r.doc_id for r in docs.where("text rlike '[A-Za-z]'").collect()}
    assert not ids & {-1, -2, -3} and len(lettered - ids) <= 0.01 * len(lettered)


def test_one_of_each_group_of_copies_stays(spark, sf_dir):
    rng = random.Random(8)
    words = [f"u{i}" for i in range(2000)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(200)]
        for k in range(3 if g < 6 else 1):
            w = list(base)
            if k == 2:
                w[100] = "other"
            rows.append((g * 10 + k, " ".join(w), "en", "s", 0))
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    kept = STAGES["near_duplicates"](spark, docs, sf_dir)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [g * 10 for g in range(12)]


def test_personal_data_goes_and_lengths_follow(spark, sf_dir):
    docs = spark.createDataFrame([(1, "mail a@b.co now", "en", "s", 15), (2, "clean", "en", "s", 5), (3, None, None, None, None)], table(spark, sf_dir, "documents").schema)
    got = {r.doc_id: r for r in STAGES["personal_data"](spark, docs, sf_dir).collect()}
    assert (got[1].text, got[1].n_chars, got[2].text, got[2].n_chars, got[3].text) == ("mail <EMAIL> now", 16, "clean", 5, None)


def test_mixing_stage_draws_whole_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    drawn = STAGES["mixing"](spark, docs, sf_dir)
    assert drawn.columns == docs.columns
    of = {r.doc_id: (r.copies, r.rate) for r in mixing.mixed(docs, mixing.domain_labels(table(spark, sf_dir, "labels")))[1].select("doc_id", "copies", "rate").collect()}
    counts: dict[int, int] = {}
    for r in drawn.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert all(c * int(x) <= counts.get(i, 0) <= c * (int(x) + 1) for i, (c, x) in of.items())


def test_run_equals_the_stages_in_a_row(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    got = sorted((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and 0 < len({i for i, _ in got}) <= before


def test_all_stay_where_no_language_is_known(spark, sf_dir):
    docs = spark.createDataFrame([(i, "some text" if i else None, None, "s", 9) for i in range(20)], table(spark, sf_dir, "documents").schema)
    assert STAGES["language_id"](spark, docs, sf_dir).count() == 20


def test_stages_on_empty_tables_equal_rows_and_extra_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s", 0, "a", "b", "c"), (1, text, "en", "s", 0, "a", "b", "c"), (2, "one two three", "en", "s", 0, None, "", "d"), (None, text, "en", "s", 0, "x", "y", "z")]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, letters string, fp string, pii_spans string")
    counts = {"near_duplicates": 3, "personal_data": 4}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, sf_dir)
        assert got.columns == more.columns and got.count() == counts.get(name, got.count()), name
    assert [r.n_tokens for r in corpus_pipeline.encode(spark, more, sf_dir).where("doc_id = 1").collect()] == [corpus_pipeline.encode(spark, more.where("doc_id is null"), sf_dir).first().n_tokens] * 2
