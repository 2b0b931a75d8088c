"""Metrics compiled from definitions, their reconciliation, and the hierarchy of agencies."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from acquimetra.operators import hierarchy as H
from acquimetra.operators import metrics as M


def by_name(df):
    return {(r.metric, r.scope): r for r in df.collect()}


def test_readiness_and_targets(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 1)], "source string, ok int")
    ok = M.Metric("ok", "coverage", F.count_if(F.col("ok") == 1), F.count(F.lit(1)), 75.0, additive=True)
    never = M.Metric("never", "coverage", F.count_if(F.col("ok") == 5), F.count_if(F.col("ok") == 7))
    held = M.Metric("held", "coverage", F.count(F.lit(1)), F.count(F.lit(1)), ready=F.lit(False))
    got = by_name(M.measure(rows, [ok, never, held], "source"))
    assert {k[1]: (r.status, r.numerator, r.denominator, r.value, r.met) for k, r in got.items() if k[0] == "ok"} == {"all": ("READY", 3, 4, 75.0, True), "a": ("READY", 1, 2, 50.0, False), "b": ("READY", 1, 1, 100.0, True), "unknown": ("READY", 1, 1, 100.0, True)}
    assert (got["never", "all"].status, got["never", "all"].value, got["held", "all"].status, got["held", "all"].numerator) == ("NOT_READY", None, "NOT_READY", None)
    empty = by_name(M.measure(rows.limit(0), [ok], "source"))
    assert list(empty) == [("ok", "all")] and empty["ok", "all"].status == "NOT_READY"


def test_conflicts(spark):
    shape = "metric string, scope string, numerator double, denominator double, additive boolean"
    rows = [("a", "all", 5.0, 4.0, False), ("b", "all", 5.0, 10.0, True), ("b", "x", 2.0, 4.0, True), ("b", "y", 2.0, 6.0, True), ("c", "all", 1.0, 10.0, True), ("c", "x", 1.0, 10.0, True), ("d", "all", 1.0, 9.0, False)]
    got = {(r.metric, r.scope, r.conflict) for r in M.conflicts(spark.createDataFrame(rows, shape), ["c", "d"]).collect()}
    assert got == {("a", "all", "numerator_above_denominator"), ("b", "all", "scopes_do_not_add_up"), ("d", "all", "denominators_differ")}


def test_contract_by_hand(spark):
    at = dt.datetime(2026, 7, 1)
    full = dict.fromkeys(M.STAGES, True)
    sources = [(1, "Verified", False, full), (1, "accessible", False, full), (2, "operational", True, full), (3, "verified", False, {**full, "reconciled": False}), (4, None, None, None), (5, "operational", None, full)]
    each = spark.createDataFrame(sources, "id int, status string, dry boolean, stages map<string,boolean>")
    ready = {r.id for r in each.where(M.source_ready(F.col("status"), F.col("dry"), F.col("stages"))).collect()}
    assert ready == {1}
    universe = [(1, True, True, True, at - dt.timedelta(hours=24)), (2, True, False, False, at - dt.timedelta(hours=25)), (3, False, False, True, None)]
    df = spark.createDataFrame(universe, "id int, mapped boolean, operational boolean, signal boolean, seen timestamp")
    got = by_name(M.measure(df, M.entity_metrics("mapped", "operational", "signal", "seen", F.lit(at), 24)))
    assert {k[0]: (r.numerator, r.denominator, r.value, r.met) for k, r in got.items()} == {
        "entities_with_recent_commercial_signal": (2, 3, 66.67, None), "source_mapping_coverage": (2, 3, 66.67, False), "operational_source_coverage": (1, 3, 33.33, False), "freshness_coverage": (1, 3, 33.33, None),
    }
    sample = lambda *rows: by_name(M.measure(spark.createDataFrame(list(rows), "relevant boolean, retrieved boolean"), [M.recall_metric("relevant", "retrieved")]))["opportunity_recall", "all"]
    assert (sample((True, True), (True, False), (False, True), (None, None)).value, sample((False, True)).status, sample((True, None)).status) == (50.0, "NOT_READY", "NOT_READY")
    records = spark.createDataFrame([("x", " ", None), ("y", "z", 1.0)], "a string, b string, c double")
    got = by_name(M.measure(records, [M.completeness_metric(("a", "b", "c"))]))["required_field_completeness", "all"]
    assert (got.numerator, got.denominator, got.value) == (2.0, 3.0, 66.67)


def test_sources_by_hand(spark):
    day = dt.date(2026, 7, 1)
    rows = [("s", day, "edital", 1, True, "o1", "u"), ("s", day - dt.timedelta(30), "other", 2, True, "o2", ""), ("s", day - dt.timedelta(31), "edital", 3, True, "o3", "u"), ("t", day, None, 4, False, "o1", None), ("t", None, "errata", None, None, None, "u")]
    df = spark.createDataFrame(rows, "source string, day date, kind string, town int, known boolean, org string, url string")
    made = M.source_metrics("day", F.lit(dt.datetime(2026, 7, 1, 12)), 30, "kind", ("edital", "errata"), ("org", "url"), ("url", "kind"), "day", "town", "known", F.lit(10), "org", F.lit(4))
    got = {k: (r.numerator, r.denominator, r.value) for k, r in by_name(M.measure(df, made, "source")).items()}
    assert got["municipalities_with_publication", "all"] == (2, 10, 20.0) and got["municipalities_with_publication", "t"] == (0, 10, 0.0)
    assert got["orgs_with_recent_notice", "all"] == (2, 4, 50.0) and got["temporal_coverage", "s"] == (2, 31, 6.45) and got["temporal_coverage", "all"] == (2, 31, 6.45)
    assert got["act_category_distribution", "s"] == (1, 2, 50.0) and got["act_category_distribution", "all"] == (2, 2, 100.0)
    assert got["field_completeness", "all"] == (7, 10, 70.0) and got["document_coverage", "t"] == (1, 2, 50.0) and got["freshness_hours", "s"] == (12.0, 1.0, 12.0)
    assert M.conflicts(M.measure(df, made[:-1], "source")).count() == 0
    assert {(r.source, r.category, r.n, r.pct) for r in M.category_shares(df, "source", "kind").collect()} == {("s", "edital", 2, 66.67), ("s", "other", 1, 33.33), ("t", "unknown", 1, 50.0), ("t", "errata", 1, 50.0)}


def test_hierarchy_outcomes(spark):
    hall, camara, fund = H.TOWN, "Órgão Público do Poder Legislativo Municipal", "Fundo Municipal"
    rows = [(1, hall, "c1", "r1", True), (2, hall, "c1", "r2", True), (3, hall, "c2", "r3", False), (4, fund, "c1", "r4", True), (5, fund, "c2", "r5", True), (6, fund, None, "r6", True), (7, fund, "c1", "r7", False), (8, camara, "c1", "r8", True), (9, camara, "c1", "r9", True), (10, fund, "c1", "r10", True), (11, "Empresa", "c1", "r11", True), (12, fund, " ", "r12", True), (13, fund, "c1", None, None)]
    df = spark.createDataFrame(rows, "id int, nature string, code string, root string, active boolean")
    got = {r.id: (r.parent, r.relationship, r.outcome) for r in H.build(df, spark.createDataFrame([(10,), (10,)], "id int"), spark.createDataFrame([("r8",), ("r4",), (None,)], "root string")).collect()}
    assert got == {
        4: (2, "fundo", "linked"), 5: (None, "fundo", "no_town_hall"), 6: (None, "fundo", "no_code"), 7: (None, "fundo", "inactive"), 8: (None, "camara", "camara_with_notices"), 9: (2, "camara", "linked"), 10: (None, "fundo", "already_covered"), 12: (None, "fundo", "no_code"), 13: (None, "fundo", "inactive"),
    }


def test_deep_chains_and_cycles(spark):
    chain = [(i, i + 1) for i in range(1, 41)]
    links = [*chain, (100, 101), (101, 102), (102, 100), (103, 100), (200, 200), (7, 8), (5, None), (None, 6), (300, 301)]
    got = {r.id: r for r in H.ancestors(spark.createDataFrame(links, "id int, parent int"), spark.createDataFrame([(41,), (20,), (102,), (999,)], "id int")).collect()}
    assert all((got[i].root, got[i].depth, got[i].cyclic) == (41, 41 - i, False) for i in range(1, 42))
    assert all((got[i].nearest, got[i].steps) == ((20, 20 - i) if i <= 20 else (41, 41 - i)) for i in range(1, 42))
    assert [(got[i].cyclic, got[i].root, got[i].nearest, got[i].steps) for i in (100, 101, 102, 103, 200)] == [(True, None, 102, 2), (True, None, 102, 1), (True, None, 102, 0), (True, None, 102, 3), (True, None, None, None)]
    assert (got[300].root, got[300].depth, got[300].nearest) == (301, 1, None) and len(got) == 41 + 4 + 1 + 2
    assert H.ancestors(spark.createDataFrame([], "id int, parent int"), spark.createDataFrame([], "id int")).count() == 0


def test_cascade(spark):
    entities = spark.createDataFrame([(i,) for i in range(1, 7)], "id int")
    links = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "id int, parent int")
    coverage = spark.createDataFrame([(3, True, None), (1, False, "name"), (4, True, "name"), (4, True, "cnpj"), (5, False, None)], "id int, covered boolean, method string")
    got = {r.id: (r.covered, r.method, r.by) for r in H.cascade(entities, links, coverage).collect()}
    assert got == {1: (True, "hierarchical", 3), 2: (True, "hierarchical", 3), 3: (True, "direct", 3), 4: (True, "cnpj", 4), 5: (False, None, None), 6: (False, None, None)}
