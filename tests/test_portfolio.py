"""Contracts like notices against a loop; groups, scenarios, sensitivity, selection, bids, calibration, firms, names and keys by hand."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from __spark_entry__ import QUERIES
from acquimetra.functions import hashing, text
from acquimetra.operators import portfolio as P
from acquimetra.operators import registers as G


def words(t):
    return {w for w in (t or "").lower().split() if len(w) >= 3}


def test_similar_contracts_equal_a_loop(spark):
    rng = random.Random(2)
    make = lambda: rng.choice([None, "", " ".join(rng.choice(["obra", "ponte", "escola", "norte", "leste", "via", "praca", "xy"]) for _ in range(rng.randint(1, 7)))])
    notices = [(i, rng.choice(["u", "v", None]), make()) for i in range(120)]
    contracts = [(i, rng.choice(["u", "v", None]), make()) for i in range(150)] + [(900 + i, "u", "obra ponte escola norte") for i in range(40)]
    got = {r.id: r for r in P.similar_contracts(spark.createDataFrame(notices, "id int, o string, t string"), spark.createDataFrame(contracts, "cid int, o string, t string"), "id", "cid", "o", "t").collect()}
    assert len(got) == len(notices)
    for i, owner, t in notices:
        high, middle, shown = 0, 0, []
        for cid, other, u in contracts:
            if owner is None or owner != other or not t or not u:
                continue
            a, b = words(t), words(u)
            sim = len(a & b) / len(a | b) if a and b else 0.0
            x, y = t.split(), u.split()
            begun = len(x) >= 4 and len(y) >= 4 and x[:4] == y[:4]
            if begun or sim >= 0.5:
                high += 1
            elif sim >= 0.3:
                middle += 1
            else:
                continue
            shown.append((-round(max(sim, 0.5) if begun else sim, 2), cid))
        status = "CONFIRMADO" if high else "PARCIAL" if middle else "NAO_VERIFICADO"
        assert (got[i].status, got[i].n_high, got[i].n_middle) == (status, high, middle)
        assert [(-b.similarity, b.contract) for b in got[i].best] == sorted(shown)[:5]


def test_correlation(spark):
    rows = [("p", "a", "x", 10.0), ("p", "a", "x", 30.0), ("p", "a", "y", 20.0), ("p", None, None, None), ("p", None, None, 40.0), ("q", "a", "x", 0.0)]
    groups, whole = P.correlation_groups(spark.createDataFrame(rows, "f string, ag string, tw string, v double"), "f", "ag", "tw", "v")
    assert {(r.agency, r.town, r.n, r.exposure, r.share) for r in groups.collect()} == {("a", "x", 2, 40.0, 0.4), ("N/I", "N/I", 2, 40.0, 0.4)}
    assert {(r.portfolio, r.n, r.n_groups, r.n_independent, r.diversification) for r in whole.collect()} == {("p", 5, 2, 1, 0.6), ("q", 1, 0, 1, 0.0)}


def test_scenarios_by_hand(spark):
    rows = [(1, 0.1, 1000.0, 2, 0.0, 0.0), (2, 0.3, 1000.0, 12, 0.1, 0.9), (3, 0.3, 1000.0, 5, 0.0, 0.4), (4, 0.001, 1000.0, 0, None, None), (5, 0.0, 1000.0, 1, 0.0, 0.0), (6, 0.2, None, 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, p double, v double, n int, b double, t double").withColumns({"lo": F.lit(0.08), "hi": F.lit(0.15), "c": F.lit(2.0)})
    got = {(r.id, r.scenario): (r.prob, r.roi_min, r.roi_max, r.trigger) for r in P.scenarios(df, "p", "v", "n", "b", "t", "lo", "hi", "c").collect()}
    assert got[1, "base"] == (0.1, 6, 13, "as_is") and got[1, "optimistic"] == (0.25, 18, 36, "few_suppliers") and got[1, "pessimistic"] == (0.05, 2, 6, "more_competition")
    assert got[2, "optimistic"][::3] == (0.4, "recurring_supplier") and got[2, "pessimistic"][::3] == (0.12, "many_suppliers")
    assert got[3, "optimistic"][::3] == (0.4, "less_competition") and got[3, "pessimistic"][::3] == (0.09, "strong_supplier") and got[4, "pessimistic"][0] == 0.001
    assert {got[i, s] for i in (5, 6) for s in ("base", "optimistic", "pessimistic")} == {(0.0, 0, 0, "insufficient_data")}


def test_sensitivity_by_hand(spark):
    df = spark.createDataFrame([(1, 100.0, 50.0, None), (2, 50.0, 50.0, None), (3, 100.0, 50.0, "prazo curto")], "id int, hab double, rest double, gate string")
    even = dict.fromkeys(P.DIMENSIONS, F.lit(0.2))
    scores = {d: F.col("hab" if d == "hab" else "rest") for d in P.DIMENSIONS}
    got = {r.id: (r.stability, r.sensitive_to, r.least, r.most) for r in P.sensitivity(df, scores, even, F.when(F.col("id") == 1, 60.0).when(F.col("id") == 3, 20.0).otherwise(50.0), F.col("gate")).collect()}
    # hab up: 100 * 0.22 + 50 * 0.78 = 61; hab down: 59; another up: 50 * 0.22 + (100 + 150) * 0.195 = 59.75; down: 60.25
    assert got == {1: ("FRAGIL", "hab", 59.0, 61.0), 2: ("ROBUSTA", None, 50.0, 50.0), 3: ("ROBUSTA", None, 20.0, 20.0)}


def test_selection_stops_at_count_and_value(spark):
    shape = "g string, id int, category string, value double, cost double, roi_min double, roi_max double, cluster string"
    rows = [("a", 1, "QUICK_WIN", 100.0, 10.0, 0.0, 50.0, "k"), ("a", 2, "OPORTUNIDADE", 100.0, 10.0, -20.0, 40.0, "k"), ("a", 3, "INVESTIMENTO", 900.0, 10.0, 1.0, 30.0, None), ("a", 4, "QUICK_WIN", 1.0, 10.0, 1.0, 20.0, None), ("a", 5, "INACESSIVEL", 1.0, 1.0, 1.0, 900.0, None), ("b", 6, "QUICK_WIN", None, None, -5.0, -1.0, None)]
    got = [(r.g, r.id, r.pick, r.roi_expected, r.roi_cumulative, r.correlated) for r in G.chosen(spark.createDataFrame(rows, shape), "g", "id", 5, 500.0).orderBy("g", "pick").collect()]
    # The third would bring the total to 1,100 and ends the choice, though the fourth would fit.
    assert got == [("a", 1, 1, 50.0, 50.0, False), ("a", 2, 2, 10.0, 60.0, True), ("b", 6, 1, -3.0, -3.0, False)]
    assert [r.id for r in G.chosen(spark.createDataFrame(rows, shape), "g", "id", 1).orderBy("g").collect()] == [1, 6]


def test_bids_by_hand(spark):
    values = [("a", 100.0, 90.0), ("a", 100.0, 80.0), ("a", 100.0, 70.0), ("b", 100.0, 50.0), ("b", 100.0, 60.0), ("a", 100.0, 900.0), ("a", 0.0, 5.0), *[("c", 100.0, 100.0)] * 6]
    benchmark = G.discount_benchmark(spark.createDataFrame(values, "k string, e double, v double"), ["k"], "e", "v")
    assert {(r.k, r.n, r["mean"], r.p25, r.p50, r.p75, r["sample"]) for r in benchmark.collect()} == {("a", 3, 0.2, 0.15, 0.2, 0.25, "OK"), ("b", 2, None, None, None, None, "INSUFFICIENT"), ("c", 6, 0.0, 0.0, 0.0, 0.0, "OK")}
    tenders = spark.createDataFrame([(1, "a", 1000.0), (2, "b", 1000.0), (3, "a", 0.0), (4, "c", 1000.0)], "id int, k string, e double")
    got = {r.id: tuple(r)[3:] for r in G.suggested_bid(tenders, benchmark, ["k"], "e").collect()}
    assert got[1] == (750.0, 850.0, 830.0, 17.0, 800.0, 900.0, 3.8, "MEDIA") and got[2] == (None,) * 8 and got[3] == (None,) * 8 and got[4] == (1000.0, 1000.0) + (None,) * 6


def test_calibration_by_hand(spark):
    rows = [("a", "win", 0.8, 100.0, 90.0), ("a", "win", 0.6, 50.0, 45.0), ("a", "loss", 0.4, 10.0, 0.0), ("a", "no_bid", 0.9, 1.0, 1.0), ("b", "win", 0.5, 1.0, 1.0), ("b", "win", 0.0, None, None), ("c", "loss", 0.3, 1.0, 1.0), ("d", "no_bid", None, 1.0, 1.0)]
    got = {r.g: tuple(r)[1:] for r in G.calibration(spark.createDataFrame(rows, "g string, outcome string, score double, proposed double, won double"), "g").collect()}
    assert got["a"] == (4, 2, 1, 1, 0.667, 0.7, 0.4, 0.55, 150.0, 135.0, 0.9) and got["b"][:8] == (2, 2, 0, 0, 1.0, 0.5, 0.0, 0.45)
    assert got["c"] == (1, 0, 1, 0, 0.0, 0.0, 0.3, 0.45, 0.0, 0.0, None) and got["d"][:8] == (1, 0, 0, 1, 0.0, 0.0, 0.0, 0.45)


def test_firms_by_hand(spark):
    names = {"Construtora X S.A.": True, "Obras Z MEI": True, "Engenharia Y S/A": True, "Prefeitura de Obras LTDA": False, "Município de Obras LTDA": False, "Padaria LTDA": False, "Reformas ME filial": True, "Reformas ME": False, "Cooperativa de asfalto": True, "FUNDAÇÃO MUNICIPAL DE OBRAS": False, "Fundacao Predial": True, None: False}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.f for r in df.select("n", G.is_engineering_firm(F.col("n")).alias("f")).collect()} == names


def test_similar_notices_by_hand(spark):
    four, eight = "norte sul leste oeste", "norte sul leste oeste um dois tres quatro"
    rows = [(1, "a", 100.0, four, "2026-01-05"), (2, "a", 100.0, eight, "2026-01-01"), (3, "a", 86.0, "oeste de norte sul para leste", "2026-01-02"), (4, "a", 84.0, four, None), (5, "a", None, four, "2026-01-09"), (6, "a", 0.0, four, "2026-01-08"), (7, "b", 100.0, four, "2026-01-01"), (8, None, 100.0, four, None), (9, "a", 100.0, "de para", None)]
    df = spark.createDataFrame(rows, "id int, k string, v double, t string, d string")
    assert {(r.a, r.b, r.overlap) for r in G.similar_notices(df, "id", ["k"], "v", "t").collect()} == {(1, 3, 1.0), (3, 4, 1.0), (5, 6, 1.0)}
    assert {r.id: r.dropped_for for r in G.without_similar(df, "id", ["k"], "v", "t", "d").collect() if r.dropped_for} == {1: 3, 4: 3, 5: 6}


def test_names_and_keys(spark):
    df = spark.createDataFrame([("12345678 12345678000199 SEC MUN MUN de Foo", "Åland São Ýx øre", "a_b (c)")], "a string, b string, c string")
    assert tuple(df.select(*[text.normalize_name(F.col(c)) for c in "abc"]).first()) == ("SECRETARIA MUNICIPIO MUNICIPIO DE FOO", "ALAND SAO YX RE", "A_B C")
    none = F.lit(None).cast("string")
    key = hashing.cross_source(F.lit("Pregão"), F.lit("Obra: nº 1"), none, F.lit("2026-01-01").cast("date"), F.lit(None).cast("double"))
    portal = hashing.portal_hash(none, F.lit(" Içara "), F.lit(10.5), F.lit("[Portal de Compras Públicas] - OBRA   nova"))
    plain = hashing.portal_hash(F.lit("SC"), none, F.lit(None).cast("double"), none)
    got = df.select(key, portal, plain).first()
    assert list(got) == [hashlib.sha256(x.encode()).hexdigest() for x in ("pregao|obra n 1||2026-01-01|", "|içara|10.5|obra nova", "SC||0|")]


def test_scenarios_are_made_after_the_only_shuffle(spark, sf_dir):
    plan = QUERIES["bid_scenarios"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_words_of_notices_are_not_gathered_by_shuffle(spark, sf_dir):
    plan = QUERIES["similar_notices"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "posexplode(array(band" in plan
