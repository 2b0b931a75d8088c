"""Simulated bids, fits, competitors, unmatched notices, radar scores and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acquimetra.catalog import query
from acquimetra.operators import bids as B
from acquimetra.operators import relational as R
from acquimetra.operators import scoring as G
from acquimetra.operators.ordered import spread_quantiles
from acquimetra.sources.canonical import CONTRACTS_SQL as C
from acquimetra.sources.canonical import contracts
from acquimetra.sources.tables import Tables

AS_OF = "1999-06-01"
_CODES = ("4120", "6201", "7020", "8610", "0000")


@query("bid_simulator", f"""WITH {C}, g AS (SELECT modality, status, supplier, count(*) AS k FROM c GROUP BY 1, 2, 3), h AS (SELECT modality, status, sum(k * k)::DOUBLE / power(sum(k)::DOUBLE, 2) AS hhi FROM g GROUP BY 1, 2),
b AS (SELECT modality, status, count(*) AS n, quantile_cont(d, 0.25) AS p25, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.75) AS p75, stddev_samp(d) AS sd FROM (SELECT modality, status, 1 - value::DOUBLE / estimate::DOUBLE AS d FROM c WHERE estimate > value) GROUP BY 1, 2),
s(k, lo, target, bdi) AS (VALUES ('41', 0.05, 0.12, 0.25), ('62', 0.10, 0.20, 0.30), ('70', 0.15, 0.25, 0.35), ('86', 0.08, 0.15, 0.28), ('00', 0.08, 0.15, 0.25)),
o AS (SELECT o_orderkey AS id, o_totalprice::DOUBLE AS v, n, p25, p50, p75, sd, CASE WHEN month(o_orderdate) <> 1 THEN hhi END AS hhi, s.* FROM orders JOIN b ON b.modality = o_orderpriority AND b.status = o_orderstatus JOIN h ON h.modality = b.modality AND h.status = b.status JOIN s ON s.k = ['41', '62', '70', '86', '00'][1 + day(o_orderdate) % 5]),
x AS (SELECT *, least(p50 + sd * 0.3, 1 - lo) AS bid, CASE WHEN hhi > 0 THEN least(20, greatest(2, round(1.5 / hhi))) ELSE 5 END AS rivals FROM o), y AS (SELECT *, CASE WHEN greatest(p25, target) > bid THEN bid * 0.85 ELSE greatest(p25, target) END AS careful, CASE WHEN least(p75 + sd * 0.5, 1 - lo) < bid THEN least(bid * 1.15, 1 - lo) ELSE least(p75 + sd * 0.5, 1 - lo) END AS bold,
 least(0.95, greatest(0.02, power(1 / (1 + exp(-1.7 * (bid - p50) / CASE WHEN sd > 0 THEN sd ELSE 0.05 END)), greatest(1, rivals - 1)))) AS p FROM x)
SELECT id, round(v * (1 - bid), 1) AS bid, round(v * (1 - bold), 1) AS aggressive, round(v * (1 - careful), 1) AS careful, round(p, 6) AS p_win, round(bdi - bid, 6) AS margin, round(p * (bdi - bid) * v, 1) AS expected, CAST(rivals AS DOUBLE) AS rivals, CASE WHEN n >= 10 AND sd > 0 THEN 'ALTA' WHEN n >= 5 THEN 'MEDIA' ELSE 'BAIXA' END AS confidence FROM y WHERE n >= 3""")
def bid_simulator(spark: SparkSession, d: str) -> DataFrame:
    t, c = Tables(spark, d), contracts(Tables(spark, d))
    both = ["modality", "status"]
    owner = c.withColumn("_both", F.concat_ws("|", *both))
    hhi = R.share_concentration(owner, "_both", "supplier").select("_both", "hhi")
    x = c.where("estimate > value").select(*both, (1 - F.col("value").cast("double") / F.col("estimate").cast("double")).alias("d"))
    q = spread_quantiles(x, both, "d", (0.25, 0.5, 0.75)).join(x.groupBy(*both).agg(F.stddev_samp("d").alias("sd")), both).withColumn("_both", F.concat_ws("|", *both)).join(hhi, "_both")
    code = F.element_at(F.array(*map(F.lit, _CODES)), 1 + F.dayofmonth("o_orderdate") % 5)
    rows = t.orders.join(q, (F.col("o_orderpriority") == F.col("modality")) & (F.col("o_orderstatus") == F.col("status")))
    s = B.simulate(F.col("o_totalprice"), F.when(F.month("o_orderdate") != 1, F.col("hhi")), F.col("n"), F.col("p50"), F.col("p25"), F.col("p75"), F.col("sd"), code)
    out = rows.select(F.col("o_orderkey").alias("id"), s.alias("s")).where("s.confidence <> 'INSUFICIENTE'")
    one = lambda k: F.round(F.col(f"s.{k}"), 1).alias(k)
    return out.select("id", one("bid"), one("aggressive"), one("careful"), F.round("s.p_win", 6).alias("p_win"), F.round("s.margin", 6).alias("margin"), one("expected"), "s.rivals", "s.confidence")


_WON = """SELECT l_suppkey AS owner, l_extendedprice::DOUBLE AS value, o_orderpriority AS modality, abs(c_acctbal) * 60 AS population, p_name AS subject, CASE WHEN c_nationkey <> 3 THEN (c_nationkey * 17 + l_suppkey % 11)::DOUBLE END AS km, CASE WHEN c_nationkey <> 4 THEN 'N' || c_nationkey END AS state, CAST(o_orderdate AS DATE) AS day, l_orderkey AS id, l_linenumber AS line
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey"""


@query("victory_fit_parts", f"""WITH w AS ({_WON}), b AS (SELECT *, CASE WHEN population < 5000 THEN 'micro' WHEN population < 20000 THEN 'pequeno' WHEN population < 100000 THEN 'medio' WHEN population < 500000 THEN 'grande' ELSE 'metropole' END AS size, list_distinct(list_filter(string_split(lower(subject), ' '), lambda x: length(x) >= 3)) AS words FROM w),
past AS (SELECT * FROM b WHERE day <= DATE '{AS_OF}'), s AS (SELECT owner, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, max(value) AS most, avg(CASE WHEN km > 0 THEN km END) AS km FROM past GROUP BY 1 HAVING count(*) >= 3),
m AS (SELECT owner, modality, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY owner) AS f FROM past GROUP BY 1, 2), z AS (SELECT owner, size, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY owner) AS f FROM past WHERE population > 0 GROUP BY 1, 2), u AS (SELECT owner, state, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY owner) AS f FROM past WHERE state IS NOT NULL GROUP BY 1, 2),
k AS (SELECT owner, w AS word, count(*) AS c FROM (SELECT owner, unnest(words) AS w FROM past) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY owner ORDER BY count(*) DESC, w) <= 50), kk AS (SELECT * FROM k WHERE c >= 2),
f AS (SELECT b.id, b.line, b.owner, b.value, s.*, b.km AS far, b.words, b.size, b.population, coalesce(m.f, 0.1) AS fm, 0.5 + 0.5 * coalesce(u.f, 0) AS fu, greatest(0.1, coalesce(z.f, 0.1)) AS fz FROM b JOIN s ON s.owner = b.owner LEFT JOIN m ON m.owner = b.owner AND m.modality = b.modality LEFT JOIN u ON u.owner = b.owner AND u.state = b.state LEFT JOIN z ON z.owner = b.owner AND z.size = b.size WHERE b.day > DATE '{AS_OF}'),
h AS (SELECT f.id, f.line, f.owner, f.value, sum(coalesce(kk.c, 0))::DOUBLE AS met FROM (SELECT id, line, owner, value, unnest(words) AS word FROM (SELECT DISTINCT id, line, owner, value, words FROM f)) f LEFT JOIN kk ON kk.owner = f.owner AND kk.word = f.word GROUP BY 1, 2, 3, 4),
r AS (SELECT f.id, f.line, f.owner, f.value AS v, exp(-power((f.value - mean) / sd, 2) / 2) * CASE WHEN f.value > most * 3 THEN 0.3 ELSE 1 END AS a, least(1, h.met / f.n / len(words) * 3) AS b, fm, least(1, fu * CASE WHEN coalesce(far, 0) <= 0 THEN 1 WHEN far / f.km > 2 THEN greatest(0.3, 1 - (far / f.km - 2) * 0.2) ELSE 1 END) AS p, CASE WHEN population > 0 THEN fz ELSE 0.4 END AS t FROM f JOIN h ON h.id = f.id AND h.line = f.line AND h.owner = f.owner AND h.value = f.value)
SELECT id, line, owner, round(v, 2) AS value, round(0.30 * a + 0.25 * b + 0.15 * fm + 0.15 * p + 0.15 * t, 4) AS fit, round(b, 10) AS fit_words, round(p, 10) AS fit_place FROM r""")
def victory_fit_parts(spark: SparkSession, d: str) -> DataFrame:
    t, c = Tables(spark, d), F.col
    bought = t.orders.join(t.customer, c("c_custkey") == c("o_custkey"))
    w = t.lineitem.join(t.part, c("p_partkey") == c("l_partkey")).join(bought, c("l_orderkey") == c("o_orderkey")).select(
        c("l_suppkey").alias("owner"), c("l_extendedprice").cast("double").alias("value"), c("o_orderpriority").alias("modality"), (F.abs("c_acctbal") * 60).alias("population"), c("p_name").alias("subject"),
        F.when(c("c_nationkey") != 3, (c("c_nationkey") * 17 + c("l_suppkey") % 11).cast("double")).alias("km"), F.when(c("c_nationkey") != 4, F.concat(F.lit("N"), c("c_nationkey").cast("string"))).alias("state"), c("o_orderdate").cast("date").alias("day"), c("l_orderkey").alias("id"), c("l_linenumber").alias("line"),
    )
    past = F.col("day") <= F.lit(AS_OF).cast("date")
    # dealt by the line's key, so that both sides read the same columns of lineitem and Spark shuffles it once
    x = B.fit(w.where(~past), B.profiles(w.where(past), ("id", "line"))).where("fit_value is not null")
    return x.select("id", "line", "owner", F.round("value", 2).alias("value"), "fit", F.round("fit_words", 10).alias("fit_words"), F.round("fit_place", 10).alias("fit_place"))


_CANDIDATES = """x AS (SELECT p_brand AS g, l_suppkey AS s, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), k AS (SELECT g, CASE WHEN s % 7 <> 0 THEN lpad(s::VARCHAR, 14, '0') ELSE s::VARCHAR END AS tax_id, n, total, s % 3 <> 0 AS here FROM x WHERE n >= 2 OR s % 2 = 0),
v AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, total DESC, tax_id) AS rank FROM k WHERE length(tax_id) = 14 AND n >= 2 AND here)"""


def _competitors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t, s = Tables(spark, d), F.col("l_suppkey")
    x = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("g"), "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))
    tax = F.when(s % 7 != 0, F.lpad(s.cast("string"), 14, "0")).otherwise(s.cast("string"))
    states = F.when(s % 3 == 0, F.array(F.lit("PR"))).when(s % 3 == 1, F.array(F.lit("PR"), F.lit("SC")))
    return B.competitors(x.where((F.col("n") >= 2) | (s % 2 == 0)).select("g", tax.alias("tax_id"), "n", "total", states.alias("states")), "g", "SC", 4, 2)


@query("competitor_selection", f"WITH {_CANDIDATES} SELECT g, CAST(rank AS INTEGER) AS rank, tax_id, n, round(total, 2) AS total FROM v WHERE rank <= 4")
def competitor_selection(spark: SparkSession, d: str) -> DataFrame:
    return _competitors(spark, d)[0].select("g", "rank", "tax_id", "n", "total")


@query("competitor_sufficiency", f"WITH {_CANDIDATES}, c AS (SELECT g, least(count(*), 4) AS valid FROM v GROUP BY g) SELECT DISTINCT k.g, coalesce(valid, 0) AS valid, CASE WHEN valid >= 4 THEN 'OK' ELSE 'INSUFFICIENT' END AS status FROM k LEFT JOIN c ON c.g = k.g")
def competitor_sufficiency(spark: SparkSession, d: str) -> DataFrame:
    return _competitors(spark, d)[1]


@query("unmatched_notices", f"""WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS entity, CASE WHEN month(o_orderdate) > 6 THEN o_custkey::VARCHAR WHEN month(o_orderdate) > 3 THEN '' END AS cnpj, CASE WHEN day(o_orderdate) > 9 THEN 'n' || o_custkey END AS name, CASE WHEN day(o_orderdate) <> 20 THEN CAST(o_orderdate AS DATE) END AS day FROM orders)
SELECT id, CASE WHEN coalesce(cnpj, '') <> '' THEN 'has_cnpj' ELSE 'name_only' END AS match_opportunity, CASE WHEN day >= DATE '2001-06-01' - 90 THEN 'recent' ELSE 'historical' END AS recency FROM x WHERE entity IS NULL AND (coalesce(cnpj, '') <> '' OR coalesce(name, '') <> '')""")
def unmatched_notices(spark: SparkSession, d: str) -> DataFrame:
    c, month, day = F.col, F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    who = c("o_custkey").cast("string")
    x = Tables(spark, d).orders.select(c("o_orderkey").alias("id"), F.when(c("o_orderstatus") == "F", c("o_custkey")).alias("entity"), F.when(month > 6, who).when(month > 3, "").alias("agency_cnpj"), F.when(day > 9, F.concat(F.lit("n"), who)).alias("agency_name"), F.when(day != 20, c("o_orderdate").cast("date")).alias("published"))
    return B.unmatched(x, F.lit("2001-06-01").cast("date")).select("id", "match_opportunity", "recency")


@query("radar_scores", """WITH x AS (SELECT o_orderkey AS id, o_orderstatus AS s, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderpriority AS p, o_totalprice AS v FROM orders),
y AS (SELECT id, CASE WHEN s <> 'P' THEN 20 ELSE 0 END + CASE WHEN m > 3 THEN 15 ELSE 0 END + CASE WHEN m > 6 THEN 15 ELSE 0 END + CASE WHEN d > 5 THEN 10 ELSE 0 END + CASE WHEN d > 10 THEN 15 ELSE 0 END + CASE WHEN d > 15 THEN 10 ELSE 0 END + CAST(round(15.0::DOUBLE * (7 - m % 5) / 7) AS INTEGER) AS data,
 CASE WHEN p IN ('1-URGENT', '2-HIGH') THEN 30 ELSE 0 END + least(20, (d % 5) * 6) + CASE WHEN m <> 2 THEN CAST(round(20 * (0.5 + 0.5 * greatest(0.0, 1 - (d * 10)::DOUBLE / 200))) AS INTEGER) ELSE 0 END + CASE WHEN p <> '5-LOW' THEN 10 ELSE 0 END + CASE WHEN m > 6 THEN 10 ELSE 0 END + CASE WHEN v > 100000 THEN 10 ELSE 0 END AS fit, p = '3-MEDIUM' AND d > 28 AS blocked FROM x)
SELECT id, data, fit, CASE WHEN blocked OR fit <= 20 THEN 'DESCARTAR' WHEN data >= 70 AND fit >= 55 THEN 'PRIORITARIA' ELSE 'REVISAR' END AS action FROM y""")
def radar_scores(spark: SparkSession, d: str) -> DataFrame:
    c, m, day, p = F.col, F.month("o_orderdate"), F.dayofmonth("o_orderdate"), F.col("o_orderpriority")
    weights = {"official": 20, "status_known": 15, "future_deadline": 15, "url": 10, "matched": 15, "fresh": 10, "completeness": 15, "object": 30, "words": 20, "distance": 20, "modality": 10, "deadline": 10, "documents": 10}
    signs = {
        "official": c("o_orderstatus") != "P", "status_known": m > 3, "future_deadline": m > 6, "url": day > 5, "matched": day > 10, "fresh": day > 15, "missing": m % 5, "hits": day % 5, "km": F.when(m != 2, day * 10), "near_km": F.lit(200.0),
        "modality_ok": p != "5-LOW", "documents": c("o_totalprice") > 100000, "object_ok": p.isin("1-URGENT", "2-HIGH"), "blocked": (p == "3-MEDIUM") & (day > 28),
    }
    data, fit, action = G.radar(signs, weights)
    return Tables(spark, d).orders.select(c("o_orderkey").alias("id"), data.alias("data"), fit.alias("fit"), action.alias("action"))


@query("expected_returns", """WITH x AS (SELECT l_orderkey AS id, l_linenumber AS line, l_extendedprice::DOUBLE * (0.02 + l_discount::DOUBLE) * 0.9 - 3000 AS win, l_tax::DOUBLE * 5 AS p FROM lineitem) SELECT id, line, CASE WHEN win <= 0 THEN 'INVIAVEL' WHEN win * p - 3000 > 0 THEN 'OPORTUNIDADE' ELSE 'INVESTIMENTO_ESTRATEGICO' END AS class, count(*) AS n, round(sum(win * p), 7) AS expected FROM x GROUP BY ALL""")
def expected_returns(spark: SparkSession, d: str) -> DataFrame:
    num = lambda k: F.col(k).cast("double")
    expected, kind = G.expected_roi(num("l_extendedprice"), 0.02 + num("l_discount"), F.lit(0.9), F.lit(3000.0), num("l_tax") * 5)
    x = Tables(spark, d).lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), kind.alias("class"), expected.alias("e"))
    return x.groupBy("id", "line", "class").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("e"), 7).alias("expected"))
