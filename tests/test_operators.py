"""Operators on small inline tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from acquimetra.functions import text
from acquimetra.operators import matching, merge, relational, scoring


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


RUNS = "run_id int, source string, status string, scope_complete boolean, limited boolean"


@pytest.mark.parametrize(
    ("run", "action"),
    [
        ((1, "s", "completed", True, False), "inactivate"),
        ((1, "s", "completed", False, False), "skip"),
        ((1, "s", "completed_zero", True, None), "inactivate"),
        ((1, "s", "failed", True, False), "skip"),
        ((1, "s", "completed", True, True), "skip"),
    ],
)
def test_only_whole_runs_deactivate(spark, run, action):
    state = spark.createDataFrame([("s", 1, True)], "source string, source_id int, source_active boolean")
    got = merge.reconcile_snapshot(state, spark.createDataFrame([run], RUNS), spark.createDataFrame([], "run_id int, source_id int"))
    assert rows(got, "source_id", "action") == [(1, action)]


def test_reappeared_rows_come_back_and_a_second_run_changes_nothing(spark):
    state = spark.createDataFrame([("s", 1, False), ("s", 2, True), ("t", 3, True)], "source string, source_id int, source_active boolean")
    runs = spark.createDataFrame([(1, "s", "completed", True, False)], RUNS)
    seen = spark.createDataFrame([(1, 1), (1, 1)], "run_id int, source_id int")
    got = merge.reconcile_snapshot(state, runs, seen)
    assert rows(got, "source_id", "action", "now_active") == [(1, "reactivate", True), (2, "inactivate", False), (3, "skip", True)]
    after = got.select("source", "source_id", F.col("now_active").alias("source_active"))
    assert rows(merge.reconcile_snapshot(after, runs, seen), "source_id", "now_active") == rows(got, "source_id", "now_active")


def test_upsert_is_idempotent(spark):
    shape = "id int, v string, h string"
    old, new = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], shape), spark.createDataFrame([(2, "c", "z"), (3, "d", "w")], shape)
    once = merge.upsert_changed(old, new, ["id"], "h")
    assert rows(once, "id", "v", "action") == [(1, "a", "keep"), (2, "c", "update"), (3, "d", "insert")]
    assert {r.action for r in merge.upsert_changed(once.drop("action"), new, ["id"], "h").collect()} == {"keep", "unchanged"}


def test_cascade_takes_the_first_level(spark):
    left = spark.createDataFrame([(1, "r1", "n1"), (2, None, "n2"), (3, None, None)], "l int, root string, name string")
    right = spark.createDataFrame([(9, "r1", "zz"), (8, "r8", "n1"), (7, "r7", "n2"), (6, "r6", "n2")], "r int, rroot string, rname string")
    got = matching.cascade(left, right, "l", "r", [("root", 1.0, F.col("root"), F.col("rroot")), ("name", 0.9, F.col("name"), F.col("rname"))])
    assert rows(got, "l", "r", "match_method") == [(1, 9, "root"), (2, 6, "name"), (3, None, "none")]


def test_concentration_of_one_and_of_equal_members(spark):
    df = spark.createDataFrame([("a", "x", 10.0), ("b", "x", 5.0), ("b", "y", 5.0)], "o string, m string, v double").withColumn("v", F.col("v").cast("decimal(18,2)"))
    assert rows(relational.concentration(df, "o", "m", "v"), "o", "hhi") == [("a", 10000), ("b", 5000)]


def test_small_samples_are_not_judged(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (10, 11, 12, 13, 14, 100)] + [("b", 1.0)], "k string, v double")
    assert rows(relational.outliers(df, ["k"], "v"), "k", "n_outliers", "status") == [("a", 1, "OK"), ("b", 0, "INSUFFICIENT_SAMPLE")]


def test_latest_breaks_ties_by_the_last_column(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, None, 3), (2, None, 4)], "k int, t int, id int")
    assert rows(relational.latest(df, ["k"], [F.desc_nulls_last("t"), F.desc("id")]), "k", "id") == [(1, 2), (2, 4)]


def test_similar_pairs_equal_brute_force(spark):
    docs = {i: " ".join(f"word{(i // 3 * 7 + k) % 40}" for k in range(12 + i % 3)) for i in range(30)}
    sets = {i: set(t.split()) for i, t in docs.items()}
    want = sorted((a, b) for a in docs for b in docs if a < b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b]))
    df = spark.createDataFrame([(i, t, "u") for i, t in docs.items()], "id int, t string, block string")
    assert rows(matching.similar_pairs(df, "id", "t", ["block"]), "a", "b") == sorted(want, key=repr)


def test_text_functions(spark):
    df = spark.createDataFrame([("12.345.678/0001-95", "Prefeitura  de São José", "edital 001/2026")], "a string, b string, c string")
    got = df.select(text.root8(F.col("a")), text.extract_tax_id(F.col("a")), text.fold(F.col("b")), text.canonical_number(F.col("c"))).first()
    assert tuple(got) == ("12345678", "12345678000195", "prefeitura  de sao jose", "1/2026")


def test_similar_pairs_expands_equal_sets(spark):
    df = spark.createDataFrame([(i, "alpha beta gamma delta", None if i == 9 else "u") for i in (5, 2, 9, 7)], "id int, t string, block string")
    assert rows(matching.similar_pairs(df, "id", "t", ["block"]), "a", "b", "similarity") == [(2, 5, 1.0), (2, 7, 1.0), (5, 7, 1.0)]


def test_engineering_class_by_hand(spark):
    cases = {
        "Engenharia de software": (0, "nao_relacionado", "software_only"),
        "aquisição de cimento para a escola": (12, "nao_relacionado", "material_isolado"),
        "reforma da escola e da creche": (20 + 12 + 12, "revisao_necessaria", None),
        "Reforma e ampliacao com construcao de escola": (100, "engenharia_confirmada", None),
        "fornecimento de material e mão de obra, obra de pavimentação": (20 + 20 + 24 + 8, "engenharia_provavel", None),
        "execução de obra de drenagem por empresa especializada": (20 + 20 + 24 + 12 + 10, "engenharia_confirmada", None),
        None: (0, "nao_relacionado", None),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    c = scoring.engineering_class(F.col("t"), F.lit(None).cast("double"))
    got = df.select("i", c["score"], c["confidence"], c["exclusion"]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == list(cases.values())
    more = scoring.engineering_class(F.col("t"), F.lit(1_000_000.0), F.lit(6), F.lit(True), F.lit(True))
    assert df.where("t like 'reforma%'").select(more["score"]).first()[0] == 44 + 12 + 4 + 4 + 8


def test_indel_ratio():
    assert matching.indel_ratio("abc", "abc") == 1.0
    assert matching.indel_ratio("abcd", "abed") == 0.75
    assert matching.indel_ratio("", "a") == 0.0


def test_keyed_duplicates_without_keys_meet_nothing(spark):
    """Rows without a key aren't shuffled by it; a hot key's rows are dealt to many tasks before their least is sought."""
    from acquimetra.operators import registers

    df = spark.range(300).selectExpr("id", "CASE WHEN id < 200 THEN 'hot' END AS k", "int(300 - id) AS made")
    out = registers.keyed_duplicates(df, "id", [F.lit(None).cast("string"), F.col("k")], [F.col("made")])
    assert {r.id: (r.keeper, r.level) for r in out.collect()} == {i: (199, 2) if i < 200 else (i, 0) for i in range(300)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan and "posexplode_outer" not in plan


def test_engineering_class_folds_a_text_once(spark):
    """At most once a column that is asked for, which Spark then shares, not once a term."""
    c = scoring.engineering_class(F.col("t"), F.lit(None).cast("double"))
    plan = spark.createDataFrame([("obra",)], "t string").select(*[x.alias(k) for k, x in c.items()])._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("translate(") <= 5
