"""Simulated bids, fits, competitors and unmatched notices, by hand."""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import functions as F

from __spark_entry__ import QUERIES
from acquimetra.operators import bids as B


def test_simulation(spark):
    rows = [(1, 1000.0, 0.5, 12, 0.10, 0.05, 0.15, 0.04, "4120"), (2, 1000.0, None, 4, 0.30, 0.01, 0.10, 0.0, None), (3, 1000.0, 0.5, 2, 0.1, 0.1, 0.1, 0.1, "62"), (4, 0.0, 0.5, 9, 0.1, 0.1, 0.1, 0.1, "62")]
    df = spark.createDataFrame(rows, "id int, v double, hhi double, n int, mid double, lo double, hi double, sd double, code string")
    s = B.simulate(*map(F.col, ("v", "hhi", "n", "mid", "lo", "hi", "sd", "code")))
    got = {r.id: r.s for r in df.select("id", s.alias("s")).collect()}
    # discount 0.10 + 0.3 * 0.04 = 0.112; careful max(0.05, 0.12) is above it, so 0.85 of it; aggressive 0.15 + 0.02
    p = 1 / (1 + math.exp(-1.7 * 0.3))
    assert [round(got[1][k], 6) for k in ("bid", "aggressive", "careful", "discount", "margin", "rivals")] == [888.0, 830.0, 904.8, 0.112, 0.138, 3.0]
    assert math.isclose(got[1].p_win, p**2) and math.isclose(got[1].expected, p**2 * 0.138 * 1000) and got[1].confidence == "ALTA"
    # default sector: aggressive 0.1 lies under 0.3, so 1.15 of it; five rivals where nothing is known
    assert [round(got[2][k], 6) for k in ("discount", "aggressive", "careful", "rivals")] == [0.3, 655.0, 850.0, 5.0] and math.isclose(got[2].p_win, 0.5**4) and got[2].confidence == "BAIXA"
    assert {(got[i].confidence, got[i].p_win) for i in (3, 4)} == {("INSUFICIENTE", 0.0)} and got[3].bid == 1000.0


def test_fit(spark):
    shape = "owner string, value double, modality string, population int, subject string, km double, state string"
    won = [("a", 100.0, "m", 4000, "obra ponte", 10.0, "SC"), ("a", 100.0, "m", 4000, "obra escola", 30.0, "SC"), ("a", 100.0, "k", 30000, "obra", None, "PR"), ("a", 100.0, None, None, None, 0.0, ""), ("b", 5.0, "m", 1, "x", 1.0, "SC")]
    known = B.profiles(spark.createDataFrame(won, shape))
    notices = [("a", 100.0, "m", 100, "ponte obra", 20.0, "SC"), ("a", 150.0, "z", 0, "", 100.0, "RS"), ("b", 5.0, "m", 1, "x", 1.0, "SC"), ("c", 5.0, "m", 1, "x", 1.0, "SC")]
    got = [r for r in B.fit(spark.createDataFrame(notices, shape), known).collect()]
    first = next(r for r in got if r.km == 20.0)
    # words: obra occurs 3 times in 4 contracts, the others once only: 0.75 / 2 * 3 above 1; modality 2 of 3; place 0.5 + 0.5 * 2 / 3; town micro 2 of 3
    assert [round(first[k], 6) for k in ("fit_value", "fit_words", "fit_modality", "fit_place", "fit_town")] == [1.0, 1.0, round(2 / 3, 6), round(0.5 + 1 / 3, 6), round(2 / 3, 6)]
    assert first.fit == round(0.30 + 0.25 + 0.15 * (2 / 3 + 0.5 + 1 / 3 + 2 / 3), 4)
    second = next(r for r in got if r.km == 100.0)
    # no spread: 1 - 0.5; no words 0.3; unknown modality 0.1; five times as far as usual: 0.5 * max(0.3, 1 - 3 * 0.2); unknown town 0.4
    assert [round(second[k], 6) for k in ("fit_value", "fit_words", "fit_modality", "fit_place", "fit_town")] == [0.5, 0.3, 0.1, 0.2, 0.4]
    assert sorted((r.owner, r.fit, r.fit_value) for r in got if r.owner != "a") == [("b", 0.5, None), ("c", 0.5, None)]


def test_competitors(spark):
    rows = [("g", "12.345.678/0001-95", 3, 10.0, ["SC"]), ("g", "22345678000195", 3, 20.0, None), ("g", "123", 9, 90.0, ["SC"]), ("g", "32345678000195", 1, 5.0, ["PR"]), ("g", "42345678000195", 0, 5.0, ["SC"]), ("h", "1", 1, 1.0, None)]
    picked, counts = B.competitors(spark.createDataFrame(rows, "g string, tax_id string, n int, total double, states array<string>"), "g", "SC", 3)
    assert sorted((r.g, r["rank"], r.tax_id, r.ticket) for r in picked.collect()) == [("g", 1, "22345678000195", 20 / 3), ("g", 2, "12345678000195", 10 / 3)]
    assert {tuple(r) for r in counts.collect()} == {("g", 2, "INSUFFICIENT"), ("h", 0, "INSUFFICIENT")}


def test_unmatched(spark):
    day = dt.date(2026, 7, 1)
    rows = [(1, None, "1", None, day), (2, None, "", "n", day - dt.timedelta(91)), (3, 5, "1", "n", day), (4, None, None, "", day), (5, None, None, "n", None)]
    df = spark.createDataFrame(rows, "id int, entity int, agency_cnpj string, agency_name string, published date")
    assert {(r.id, r.match_opportunity, r.recency) for r in B.unmatched(df, F.lit(day)).collect()} == {(1, "has_cnpj", "recent"), (2, "name_only", "historical"), (5, "name_only", "historical")}


def test_no_window_holds_a_group_of_discounts(spark, sf_dir):
    plan = QUERIES["bid_simulator"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(_g" not in plan


def test_profiles_of_sparse_owners(spark):
    shape = "owner string, value double, modality string, population int, subject string, km double, state string"
    rows = [("a", 0.1, None, None, "ponte escola", None, "")] * 3 + [("a", 0.1, "", 0, "escola muro", -1.0, None)] * 4 + [(None, -5.0, "m", 5000, None, 7.0, "SC"), (None, None, "m", 4999, "", 9.0, "PR")]
    for deal in (("value", "km", "subject"), ("owner",), ("population", "state")):
        got = {r.owner: r.asDict() for r in B.profiles(spark.createDataFrame(rows, shape), deal).collect()}
        a, none = got["a"], got[None]
        assert len(got) == 2 and (a["n"], a["sd"], a["most"], a["km"]) == (7, 0.0, 0.1, None) and math.isclose(a["mean"], 0.1)
        assert (a["modalities"], a["sizes"], a["states"]) == (None, None, None) and a["words"] == {"escola": 1.0, "ponte": 3 / 7, "muro": 4 / 7}
        assert none == {"owner": None, "n": 2, "mean": None, "sd": None, "most": None, "km": 8.0, "modalities": {"m": 1.0}, "sizes": {"micro": 0.5, "pequeno": 0.5}, "states": {"SC": 0.5, "PR": 0.5}, "words": None}


def test_words_of_a_profile(spark):
    shape = "owner string, value double, modality string, population int, subject string, km double, state string"
    # 60 words twice each and one three times: that one and the first 49 by name stay; a word that occurs once does not
    rows = [("a", 1.0, "m", 1, " ".join(f"w{i:03d}" for i in range(60)), 1.0, "SC")] * 2 + [("a", 1.0, "m", 1, "zeta", 1.0, "SC")] * 3 + [("a", 1.0, "m", 1, "once", 1.0, "SC")]
    words = B.profiles(spark.createDataFrame(rows, shape)).first().words
    assert words == {"zeta": 3 / 6} | {f"w{i:03d}": 2 / 6 for i in range(49)}


def test_lines_of_a_fit_are_shuffled_once(spark, sf_dir):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = QUERIES["victory_fit_parts"](spark, sf_dir)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set(key, before)
    # profiles and notices read one shuffle of the lines by order; the rows of profiles then meet by owner once
    assert len(re.findall(r"- Exchange hashpartitioning\(l_orderkey", final)) == 1 and "ReusedExchange" in final
    assert len(re.findall(r"- Exchange hashpartitioning\(owner#\d+L, _deal", final)) == 1
