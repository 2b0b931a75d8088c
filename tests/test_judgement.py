"""Commercial status, reliability, percentages, matches by eight keys and duplicates, by hand."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from __spark_entry__ import QUERIES
from acquimetra.operators import judgement as J
from acquimetra.operators import official as A
from acquimetra.operators import registers as G

DAY = dt.date(2026, 7, 17)


def test_commercial_status(spark):
    d = lambda n: DAY + dt.timedelta(days=n)
    rows = [
        (("nao_relacionado", "Edital", None, None, None, d(9), None), "NOT_RELEVANT", 0.95), (("suspensao", None, None, None, None, d(9), None), "SUSPENDED", 0.9), (("edital", None, None, "Sine die", None, d(9), None), "SUSPENDED", 0.9),
        (("Anulacao ", None, None, None, None, d(9), None), "CLOSED", 0.9), (("ata_registro_precos", None, None, "Encerrado", None, None, None), "CONTRACT", 0.92), (("apostilamento", None, None, None, None, None, None), "AMENDMENT", 0.92),
        (("resultado", None, None, None, None, d(9), None), "RESULT", 0.9), (("edital", None, None, "Divulgação do resultado", None, d(9), None), "RESULT", 0.9), (("edital", None, None, "Finalizado", None, d(9), None), "RESULT", 0.88), (("edital", None, None, "Fracassada", None, d(9), None), "CLOSED", 0.88),
        (("edital", None, None, None, d(-9), d(-1), d(-20)), "CLOSED", 0.93), (("edital", None, None, None, d(-9), d(0), None), "OPEN_OPPORTUNITY", 0.92), (("edital", None, None, None, d(1), d(9), None), "UPCOMING_OPPORTUNITY", 0.9),
        (("edital", None, None, "Fase de lance", None, None, None), "OPEN_OPPORTUNITY", 0.85), (("edital", None, None, None, None, None, d(-30)), "RECENT_NOTICE", 0.75), (("edital", None, None, None, None, None, d(-31)), "OTHER_PROCUREMENT_ACT", 0.65),
        ((None, "Pregão 5", None, None, None, None, d(1)), "OTHER_PROCUREMENT_ACT", 0.65), ((None, None, "há inexigib aqui", None, None, None, d(0)), "RECENT_NOTICE", 0.75), (("errata", None, None, None, None, None, None), "OTHER_PROCUREMENT_ACT", 0.7),
        ((None, "nada", None, None, None, None, None), "NOT_RELEVANT", 0.4), (("outros", "licitante", None, None, None, None, None), "OTHER_PROCUREMENT_ACT", 0.4), (("posse", None, None, None, None, None, None), "OTHER_PROCUREMENT_ACT", 0.55),
    ]
    df = spark.createDataFrame([(i, *r[0]) for i, r in enumerate(rows)], "i int, cat string, title string, text string, state string, opens date, closes date, pub date")
    s = J.commercial_status(*map(F.col, ("cat", "title", "text", "state", "opens", "closes", "pub")), F.lit(DAY))
    got = [(r.s.status, r.s.confidence) for r in df.select("i", s.alias("s")).orderBy("i").collect()]
    assert got == [r[1:] for r in rows]


def test_reliability(spark):
    rows = [((1.0, True, "ok", 5, True, "x"), "TRUSTED"), ((30.0, True, "ok", 5, True, "x"), "DEGRADED"), ((200.0, True, "ok", 5, True, "x"), "UNTRUSTED"), ((1.0, None, None, None, None, "x"), "DEGRADED"), ((1.0, True, None, 0, True, "x"), "UNTRUSTED"), ((1.0, False, "ok", 5, True, "x"), "UNTRUSTED"), ((1.0, True, "stale", 5, True, "x"), "DEGRADED"), ((1.0, True, "ok", 5, True, None), "UNTRUSTED")]
    df = spark.createDataFrame([(i, *r[0]) for i, r in enumerate(rows)], "i int, age double, prov boolean, health string, n int, q boolean, f string")
    r = J.reliability(F.col("age"), [F.col("f").isNotNull()], F.col("prov"), F.col("health"), F.col("n"), F.col("q"), 3)
    assert [x.r.level for x in df.select("i", r.alias("r")).orderBy("i").collect()] == [x[1] for x in rows]
    none = F.lit(None)
    assert spark.range(1).select(J.reliability(none.cast("double"), [], none.cast("boolean"), none.cast("string"), none.cast("int"), none.cast("boolean"))["level"]).first()[0] == "UNKNOWN"


def test_percentages(spark):
    rows = [(5.0, 3, ["x"], None), (5.0, 0, ["x"], "empty_denominator"), (5.0, None, [], "no_denominator,no_limitations"), (5.0, -1, [" ", None], "no_denominator,no_limitations"), (None, None, None, None)]
    df = spark.createDataFrame([r[:3] for r in rows], "p double, n int, l array<string>")
    assert [r[0] for r in df.select(J.bare_percentage(F.col("p"), F.col("n"), F.col("l"))).collect()] == [r[3] for r in rows]


def test_official_matches(spark):
    shape = "id string, system string, pncp_number string, process_number string, contract_number string, edital_number string, year int, modality string, agency_cnpj string, agency_name string, sc_id string, status string, published date, value double"
    row = lambda i, s, **k: (i, s, *[k.get(c) for c in (*A.FIELDS, "status", "published", "value")])
    control, cnpj = "12345678000199-1-5/2026", "12345678000199"
    right = [
        row("p1", "pncp", pncp_number=control, process_number="1/2026", agency_cnpj=cnpj, status="open", value=100.0), row("c1", "compras_sc", pncp_number=control, sc_id="7"), row("c2", "compras_sc", process_number="1/2026", agency_cnpj=cnpj), row("c2", "compras_sc", process_number="1/2026", agency_cnpj=cnpj),
        row("n1", "pncp", edital_number="4", year=2026, agency_name="X", agency_cnpj="9"), row("s1", "compras_sc", pncp_number="sc-9", sc_id="9"), row("d9", "doe", contract_number="3", agency_cnpj=cnpj),
    ]
    left = [
        row("a", "doe", pncp_number=control, status="closed", value=100.5), row("b", "doe", process_number="1/2026", agency_cnpj=cnpj, value=150.0, status="open"), row("c", "doe", edital_number="4", year=2026, agency_name="X"), row("d", "doe", edital_number="4", year=2026, agency_name="X", agency_cnpj="1"),
        row("e", "doe", sc_id="9"), row("f", "doe", pncp_number="sc-9"), row("g", "doe", contract_number="3", agency_cnpj=cnpj), row("h", "dom", contract_number="3", agency_cnpj=cnpj), row("i", "doe"),
    ]
    got = {r.id: (r.rule, r.match, r.candidates, r.conflicts, r.review) for r in A.matches(spark.createDataFrame(left, shape), spark.createDataFrame(right, shape)).collect()}
    assert got["a"] == ("pncp_number_exact", "p1", 2, ["status_divergence", "ambiguous_match"], True)
    assert got["b"] == ("process_number_orgao_cnpj", "p1", 2, ["value_divergence", "ambiguous_match"], True)
    assert got["c"] == ("edital_number_year_orgao_name", "n1", 1, [], False) and got["d"] == (None, None, 0, None, None) and got["e"][:3] == ("compras_sc_id_crosswalk", "s1", 1)
    assert got["f"][0] is None and got["g"][0] is None and got["h"][:2] == ("contract_number_orgao_cnpj", "d9") and got["i"][0] is None


def test_keyed_duplicates(spark):
    rows = [(1, "a", None, 3), (2, "a", "x", 1), (3, None, "x", 2), (4, None, None, 1), (5, "b", None, 1), (6, None, "y", None), (7, None, "y", 0)]
    df = spark.createDataFrame(rows, "id int, k1 string, k2 string, at int")
    got = {r.id: (r.keeper, r.level) for r in G.keyed_duplicates(df, "id", [F.col("k1"), F.col("k2")], [F.col("at")]).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 2), 4: (4, 0), 5: (5, 0), 6: (6, 2), 7: (6, 2)}


def test_keys_of_official_acts_meet_without_what_is_compared(spark, sf_dir):
    plan = QUERIES["official_matches"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "min_by(b" not in plan and "sha2(" not in plan
