"""Points near points against loops, at the poles and over the date line; clusters; order statistics; records of several versions."""

from __future__ import annotations

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from acquimetra.operators import nearby, ordered
from acquimetra.sources import records


def km(a, b):
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(x)))


def places(n, seed):
    rng = random.Random(seed)
    made = [(rng.choice([90.0, -90.0, 89.9, -89.2, rng.uniform(-90, 90), rng.uniform(84, 90)]), rng.choice([180.0, -180.0, 179.9, -179.9, 0.0, rng.uniform(-180, 180)])) for _ in range(n)]
    return [(i, *p) for i, p in enumerate(made)] + [(n, None, 1.0), (n + 1, 1.0, None)]


@pytest.mark.parametrize("radius", [3.0, 150.0, 2500.0, 12000.0])
def test_near_equals_a_loop(spark, radius):
    a, b = places(150, 1), places(150, 2)
    shape = "id int, lat double, lon double"
    got = {(r.a.id, r.b.id): r.km for r in nearby.near(spark.createDataFrame(a, shape), spark.createDataFrame(b, shape), radius).collect()}
    want = {(x[0], y[0]): km(x[1:], y[1:]) for x in a for y in b if None not in x + y and km(x[1:], y[1:]) <= radius}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)


def test_nearest(spark):
    a, b = spark.createDataFrame([(1, 0.0, 179.9), (2, 50.0, 0.0), (3, None, 1.0)], "id int, lat double, lon double"), spark.createDataFrame([(7, 0.0, -179.9), (5, 0.0, 179.75), (6, 0.0, 179.75)], "pid int, lat double, lon double")
    assert {r.id: r.pid for r in nearby.nearest(a, b, "id", "pid", 100.0).collect()} == {1: 5, 2: None, 3: None}


def test_many_rows_of_one_place_meet_once(spark):
    """3,000 rows of two places each side: the nearest are found without a row for each of the pairs, and no table that makes pairs is in one task."""
    a = spark.range(3000).selectExpr("id", "double(id % 2) AS lat", "0.0D AS lon").coalesce(1)
    b = spark.range(3000).selectExpr("id AS pid", "double(id % 2) AS lat", "0.1D AS lon").coalesce(1)
    assert {(r.id, r.pid) for r in nearby.nearest(a, b, "id", "pid", 50.0).collect()} == {(i, i % 2) for i in range(3000)}
    plan = nearby.nearest(a, b, "id", "pid", 50.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 3  # both sides' places, and their nearest
    pairs = nearby.near(a, b, 50.0)
    assert pairs.count() == 2 * 1500 * 1500 and pairs.rdd.getNumPartitions() == 4


@pytest.mark.parametrize("radius", [150.0, 1500.0])
def test_clusters_equal_a_loop(spark, radius):
    rng = random.Random(5)
    rows = [(i, lat, lon, rng.choice([None, 1.0, 2.0, rng.uniform(0, 9)]), rng.choice(["a", "b", None])) for i, lat, lon in places(160, 3)]
    rows += [(500 + i, -27.0 + i * 0.9, -49.0, float(i), "chain") for i in range(12)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double, value double, region string")
    want = {}
    for region in ("a", "b", None, "chain"):
        free = sorted((r for r in rows if r[4] == region and None not in r[1:3]), key=lambda r: (-(r[3] if r[3] is not None else -math.inf), r[0]))
        n = 0
        while free:
            seed = free[0]
            own = [r for r in free if km(seed[1:3], r[1:3]) <= radius]
            want |= {r[0]: n for r in own}
            free, n = [r for r in free if r not in own], n + 1
    got = {r.id: r.cluster for r in nearby.clusters(df, "id", "lat", "lon", "value", "region", radius).collect()}
    assert {k: v for k, v in got.items() if v is not None} == want and sorted(k for k, v in got.items() if v is None) == [160, 161]
    assert nearby.clusters(df.limit(0), "id", "lat", "lon", "value", "region").count() == 0


def test_spread_quantiles(spark):
    rng = random.Random(4)
    rows = [("hot", rng.choice([1.0, 2.0, rng.random()])) for _ in range(3000)] + [("one", 5.0), ("none", None), (None, 1.0), (None, 4.0), ("hot", None)]
    at = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.k: r for r in ordered.spread_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", at).collect()}
    for key in ("hot", "one", "none", None):
        values = sorted(v for k, v in rows if k == key and v is not None)
        assert got[key].n == len(values)
        for q in at:
            if not values:
                assert got[key][f"p{round(q * 100)}"] is None
                continue
            x = (len(values) - 1) * q
            want = values[math.floor(x)] * (1 - x % 1) + values[math.ceil(x)] * (x % 1)
            assert math.isclose(got[key][f"p{round(q * 100)}"], want)
    whole = ordered.spread_quantiles(spark.createDataFrame(rows, "k string, v double"), [], "v", (0.5,)).collect()
    assert len(whole) == 1 and whole[0].n == 3003
    assert ordered.spread_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", (0.5,)).count() == 0


def test_ranks(spark):
    rows = [(i, (i * 7) % 50 if i % 9 else None) for i in range(300)]
    got = {r.id: r["rank"] for r in ordered.ranks(spark.createDataFrame(rows, "id int, v int"), [F.col("v"), F.col("id")]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert got == {i: k + 1 for k, (i, _) in enumerate(order)}


def test_records_of_all_versions(spark):
    national = {"numeroControlePNCP": "", "id": 17, "orgaoEntidade": {"cnpj": "1", "razaoSocial": "R"}, "objetoCompra": "O", "valorTotalEstimado": 10.5, "dataAberturaProposta": "2026-01-02T03:04", "modalidadeId": "x6", "unidadeOrgao": {"municipioNome": "M"}, "uf": ""}
    rows = [
        ("pncp", json.dumps(national)), ("dom_sc", json.dumps({"id": 5, "Ato[titulo]": "T", "nome_entidade": "E", "data_publicacao": "03/02/2026", "url_web": "w"})), ("dom_sc", json.dumps({"id": 6})), ("dom_sc", json.dumps({"titulo": "x"})),
        ("novo", json.dumps({"identificador": "z", "nome": "N", "UF": "PR", "valorTotal": "R$ 1.000,5", "link": "l", "extra": [1, {"a": 2}]})), ("pncp", json.dumps({"id": "a"})), ("pncp", "{"), ("pncp", None), ("pncp", "3"), ("pncp", "[]"), (None, json.dumps({"id": "q", "titulo": "t"})),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, source string, raw string")
    got = [r for r in records.normalized(df, "source", "raw").orderBy("i").collect()]
    assert [r.reason for r in got] == [None, None, None, "no_id", None, "no_subject", "malformed", "malformed", "malformed", "malformed", None]
    a = got[0].record
    assert (a.source_id, a.orgao_cnpj, a.orgao_nome, a.objeto, a.valor, a.aberto, a.modalidade_id, a.municipio, a.uf, a.publicado) == ("17", "1", "R", "O", 10.5, dt.date(2026, 1, 2), None, "M", "SC", None)
    assert (got[1].record.objeto, got[1].record.orgao_nome, got[1].record.publicado, got[1].record.link) == ("T", "E", dt.date(2026, 2, 3), "w") and got[2].record.objeto == "Publicação DOM-SC"
    assert (got[4].record.source_id, got[4].record.objeto, got[4].record.uf, got[4].record.valor, got[4].record.url) == ("z", "N", "PR", 1000.5, "l") and got[6].record.uf is None and got[10].record.source_id == "q"


def test_json_is_built_and_appended(spark):
    df = spark.createDataFrame([(1, '[{"a": 1}]'), (2, None), (3, "broken")], "id int, h string")
    got = {r.id: r.x for r in df.select("id", records.appended(F.col("h"), F.struct(F.lit(9).alias("a")), "struct<a: int>").alias("x")).collect()}
    assert json.loads(got[1]) == [{"a": 1}, {"a": 9}] and json.loads(got[2]) == [{"a": 9}] and json.loads(got[3])[-1] == {"a": 9}
    assert df.select(records.packed({"x": F.col("id"), "y": F.col("h")}).alias("j")).orderBy("j").first().j == '{"x":1,"y":"[{\\"a\\": 1}]"}'


@pytest.mark.parametrize("name", ["value_statistics", "category_percentiles"])
def test_percentiles_of_large_groups_are_spread(spark, sf_dir, name):
    """No aggregate that keeps a group's values, and no window over a whole group."""
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "unboundedfollowing" not in plan.lower()


def test_equal_values_collapse_in_spread_quantiles(spark):
    df = spark.range(4000).selectExpr("id % 2 AS g", "CASE WHEN id < 3000 THEN 7.0D ELSE double(id) END AS v")
    got = {r.g: (r.n, r.p25, r.p50, r.p90) for r in ordered.spread_quantiles(df, ["g"], "v", (0.25, 0.5, 0.9)).collect()}
    for g in (0, 1):
        vs = sorted(7.0 if i < 3000 else float(i) for i in range(4000) if i % 2 == g)
        at = 0.9 * (len(vs) - 1)
        assert got[g] == (2000, 7.0, 7.0, pytest.approx(vs[int(at)] * (1 - at % 1) + vs[int(at) + 1] * (at % 1)))
