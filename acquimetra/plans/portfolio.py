"""Firms' contracts against notices, correlated notices, scenarios and sensitivity; order statistics of hot groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acquimetra.catalog import query
from acquimetra.operators import ordered as O
from acquimetra.operators import portfolio as P
from acquimetra.sources.tables import Tables


@query("hot_quantiles", """WITH x AS (SELECT l_returnflag AS flag, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem UNION ALL SELECT NULL, CAST(l_extendedprice AS DOUBLE) FROM lineitem WHERE l_linenumber = 1)
SELECT flag, count(*) AS n, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99), 6) AS p99 FROM x GROUP BY flag""")
def hot_quantiles(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("double").alias("v"), "l_linenumber")
    x = rows.select("flag", "v").union(rows.where("l_linenumber = 1").select(F.lit(None).cast("string"), "v"))
    g = O.spread_quantiles(x, ["flag"], "v", (0.1, 0.5, 0.99))
    return g.select("flag", "n", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p99")])


@query("value_ranks", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def value_ranks(spark: SparkSession, d: str) -> DataFrame:
    return O.ranks(Tables(spark, d).orders.select(F.col("o_orderkey").alias("id"), "o_totalprice"), [F.col("o_totalprice"), F.col("id")]).select("id", "rank")


@query("similar_contracts", """WITH n AS (SELECT o_orderkey AS id, o_orderstatus AS owner, CASE WHEN o_orderpriority <> '5-LOW' THEN concat_ws(' ', CASE WHEN o_orderstatus = 'F' THEN 'Reforma predial' ELSE 'Obra nova' END, ['urbana norte escola', 'rural sul ponte', 'hospital centro leito', 'estrada asfalto trecho'][1 + month(o_orderdate) % 4], 'lote' || day(o_orderdate)) END AS t FROM orders),
c AS (SELECT p_partkey AS cid, ['F', 'O', 'P'][1 + p_size % 3] AS owner, concat_ws(' ', CASE WHEN p_type = 'ECONOMY' THEN 'Reforma predial' ELSE 'Obra nova' END, ['urbana norte escola', 'rural sul ponte', 'hospital centro leito', 'estrada asfalto trecho'][1 + p_size % 4], p_name) AS t FROM part),
ns AS (SELECT owner, t, string_split(lower(t), ' ') AS b, list_sort(list_distinct(list_filter(string_split(lower(t), ' '), lambda w: length(w) >= 3))) AS w, list(id) AS ids FROM n WHERE t IS NOT NULL GROUP BY owner, t),
cs AS (SELECT owner, t, string_split(lower(t), ' ') AS b, list_sort(list_distinct(list_filter(string_split(lower(t), ' '), lambda w: length(w) >= 3))) AS w, count(*) AS k, list_sort(list(cid))[:5] AS cids FROM c GROUP BY owner, t),
p AS (SELECT ns.owner, ns.t, k, cids, len(list_intersect(ns.w, cs.w))::DOUBLE / len(list_distinct(ns.w || cs.w)) AS sim, ns.b[:4] = cs.b[:4] AND len(ns.b) >= 4 AND len(cs.b) >= 4 AS begun FROM ns JOIN cs ON ns.owner = cs.owner),
m AS (SELECT *, sim >= 0.5 OR begun AS high, round(CASE WHEN begun THEN greatest(sim, 0.5) ELSE sim END, 2) AS shown FROM p WHERE sim >= 0.3 OR begun),
s AS (SELECT owner, t, sum(CASE WHEN high THEN k ELSE 0 END)::BIGINT AS n_high, sum(CASE WHEN high THEN 0 ELSE k END)::BIGINT AS n_middle FROM m GROUP BY 1, 2), e AS (SELECT owner, t, shown, unnest(cids) AS cid FROM m),
t5 AS (SELECT owner, t, string_agg(cid || ':' || CAST(CAST(shown * 100 + 0.5 AS INTEGER) AS VARCHAR), ',' ORDER BY at) AS best FROM (SELECT *, row_number() OVER (PARTITION BY owner, t ORDER BY shown DESC, cid) AS at FROM e) WHERE at <= 5 GROUP BY 1, 2)
SELECT n.id, CASE WHEN n_high > 0 THEN 'CONFIRMADO' WHEN n_middle > 0 THEN 'PARCIAL' ELSE 'NAO_VERIFICADO' END AS status, coalesce(n_high, 0) AS n_high, coalesce(n_middle, 0) AS n_middle, coalesce(best, '') AS best FROM n LEFT JOIN s ON s.owner = n.owner AND s.t = n.t LEFT JOIN t5 ON t5.owner = n.owner AND t5.t = n.t""".replace(" AS at FROM e) WHERE at <= 5", " AS pos FROM e) WHERE pos <= 5").replace("ORDER BY at) AS best", "ORDER BY pos) AS best").replace("CAST(CAST(shown * 100 + 0.5 AS INTEGER) AS VARCHAR)", "CAST(CAST(round(shown * 100) AS INTEGER) AS VARCHAR)"))
def similar_contracts(spark: SparkSession, d: str) -> DataFrame:
    t, c = Tables(spark, d), F.col
    kinds = F.array(*map(F.lit, ("urbana norte escola", "rural sul ponte", "hospital centro leito", "estrada asfalto trecho")))
    head = lambda test: F.when(test, "Reforma predial").otherwise("Obra nova")
    text = F.concat_ws(" ", head(c("o_orderstatus") == "F"), F.element_at(kinds, 1 + F.month("o_orderdate") % 4), F.concat(F.lit("lote"), F.dayofmonth("o_orderdate").cast("string")))
    notices = t.orders.select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("owner"), F.when(c("o_orderpriority") != "5-LOW", text).alias("t"))
    owners = F.array(*map(F.lit, ("F", "O", "P")))
    contracts = t.part.select(c("p_partkey").alias("cid"), F.element_at(owners, (1 + c("p_size") % 3).cast("int")).alias("owner"), F.concat_ws(" ", head(c("p_type") == "ECONOMY"), F.element_at(kinds, (1 + c("p_size") % 4).cast("int")), "p_name").alias("t"))
    out = P.similar_contracts(notices, contracts, "id", "cid", "owner", "t")
    best = F.array_join(F.transform("best", lambda b: F.concat(b["contract"].cast("string"), F.lit(":"), F.round(b["similarity"] * 100).cast("int").cast("string"))), ",")
    return out.select("id", "status", "n_high", "n_middle", best.alias("best"))


_NOTICES = "SELECT o_custkey // 50 AS portfolio, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS agency, CASE WHEN month(o_orderdate) <> 3 THEN c_nationkey END AS town, CAST(o_totalprice AS DOUBLE) AS v FROM orders JOIN customer ON c_custkey = o_custkey"


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t, c = Tables(spark, d), F.col
    x = t.orders.join(t.customer, c("o_custkey") == c("c_custkey"))
    x = x.select(F.expr("o_custkey div 50").alias("portfolio"), F.when(c("o_orderpriority") != "5-LOW", c("o_custkey")).alias("agency"), F.when(F.month("o_orderdate") != 3, c("c_nationkey")).alias("town"), c("o_totalprice").alias("v"))
    return P.correlation_groups(x, "portfolio", "agency", "town", "v")


@query("correlation_groups", f"""WITH n AS ({_NOTICES}), g AS (SELECT portfolio, coalesce(CAST(agency AS VARCHAR), 'N/I') AS agency, coalesce(CAST(town AS VARCHAR), 'N/I') AS town, count(*) AS n, sum(v) AS e FROM n GROUP BY 1, 2, 3)
SELECT portfolio, agency, town, n, round(e, 2) AS exposure, round(e / sum(e) OVER (PARTITION BY portfolio), 6) AS share FROM g QUALIFY n > 1""")
def correlation_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)[0].withColumns({"exposure": F.round("exposure", 2), "share": F.round("share", 6)})


@query("portfolio_diversification", f"""WITH n AS ({_NOTICES}), g AS (SELECT portfolio, coalesce(CAST(agency AS VARCHAR), 'N/I') AS agency, coalesce(CAST(town AS VARCHAR), 'N/I') AS town, count(*) AS n, sum(v) AS e FROM n GROUP BY 1, 2, 3)
SELECT portfolio, sum(n)::BIGINT AS n, count(*) FILTER (WHERE n > 1) AS n_groups, count(*) FILTER (WHERE n = 1) AS n_independent, round(1 - max(n)::DOUBLE / sum(n)::DOUBLE, 3) AS diversification, round(max(e), 2) AS most_exposed FROM g GROUP BY 1""")
def portfolio_diversification(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)[1].withColumn("most_exposed", F.round("most_exposed", 2))


@query("bid_scenarios", """WITH x AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_linenumber <> 7 THEN l_discount * 3 END AS p, CAST(l_extendedprice AS DOUBLE) AS v, CAST(l_quantity AS INTEGER) % 15 AS n, CASE WHEN l_returnflag = 'A' THEN 0.1 ELSE 0 END AS bonus, l_tax * 6 AS top, 0.083 AS lo, 0.151 AS hi, 250.25 AS cost FROM lineitem),
k AS (SELECT *, p > 0 AND v > 0 AS ok, CASE WHEN n BETWEEN 1 AND 3 THEN least(p * 2.5, 0.5) WHEN bonus > 0 THEN least(p + 0.1, 0.5) ELSE least(p * 1.8, 0.4) END AS good, CASE WHEN n BETWEEN 1 AND 3 THEN 'few_suppliers' WHEN bonus > 0 THEN 'recurring_supplier' ELSE 'less_competition' END AS gt,
 greatest(0.001, CASE WHEN n > 10 THEN p * 0.4 WHEN top > 0.3 THEN p * 0.3 ELSE p * 0.5 END) AS bad, CASE WHEN n > 10 THEN 'many_suppliers' WHEN top > 0.3 THEN 'strong_supplier' ELSE 'more_competition' END AS bt FROM (SELECT * REPLACE (coalesce(p, 0) AS p) FROM x)),
s AS (SELECT *, 'base' AS scenario, p AS q, 'as_is' AS t FROM k UNION ALL SELECT *, 'optimistic', good, gt FROM k UNION ALL SELECT *, 'pessimistic', bad, bt FROM k)
SELECT id, line, scenario, CASE WHEN ok THEN t ELSE 'insufficient_data' END AS trigger, count(*) AS n, CAST(sum(CASE WHEN ok THEN CAST(round(v * q * lo - cost) AS BIGINT) ELSE 0 END) AS BIGINT) AS roi_min, CAST(sum(CASE WHEN ok THEN CAST(round(v * q * hi - cost) AS BIGINT) ELSE 0 END) AS BIGINT) AS roi_max FROM s GROUP BY ALL""")
def bid_scenarios(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    # A line's rows meet while there is one row for all three scenarios, and of few columns; the sums then need no other shuffle.
    lines = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_extendedprice", "l_quantity", "l_returnflag", "l_tax").repartition("l_orderkey", "l_linenumber")
    x = lines.select(
        c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), F.when(c("l_linenumber") != 7, c("l_discount").cast("double") * 3).alias("p"), c("l_extendedprice").cast("double").alias("v"), (c("l_quantity").cast("int") % 15).alias("n"),
        F.when(c("l_returnflag") == "A", 0.1).otherwise(0.0).alias("bonus"), (c("l_tax").cast("double") * 6).alias("top"), F.lit(0.083).alias("lo"), F.lit(0.151).alias("hi"), F.lit(250.25).alias("cost"),
    )
    s = P.scenarios(x, "p", "v", "n", "bonus", "top", "lo", "hi", "cost")
    return s.groupBy("id", "line", "scenario", "trigger").agg(F.count(F.lit(1)).alias("n"), F.sum("roi_min").alias("roi_min"), F.sum("roi_max").alias("roi_max"))


@query("bid_sensitivity", """WITH x AS (SELECT o_orderkey AS id, CAST(month(o_orderdate) * 8 AS DOUBLE) AS hab, CAST(day(o_orderdate) * 3 AS DOUBLE) AS fin, CASE o_orderstatus WHEN 'F' THEN 90.0 WHEN 'O' THEN 40.0 END AS geo, CAST(o_totalprice AS DOUBLE) / 5000 AS prazo, 55.0 AS comp, CASE WHEN o_orderpriority = '1-URGENT' THEN 'prazo' WHEN o_orderpriority = '5-LOW' THEN 'habilitacao,financeiro' END AS gate FROM orders),
d(k, dim, w) AS (VALUES (1, 'hab', 0.3), (2, 'fin', 0.25), (3, 'geo', 0.2), (4, 'prazo', 0.15), (5, 'comp', 0.1)), f AS (SELECT x.id, gate, d.*, coalesce(CASE dim WHEN 'hab' THEN hab WHEN 'fin' THEN fin WHEN 'geo' THEN geo WHEN 'prazo' THEN prazo ELSE comp END, 50) AS s FROM x CROSS JOIN d),
t AS (SELECT id, any_value(gate) AS gate, sum(s * w) AS total FROM f GROUP BY id), c AS (SELECT id, least(total, CASE WHEN gate LIKE '%prazo%' THEN 20 WHEN gate LIKE '%financeiro%' THEN 25 ELSE 1000 END) AS total, total AS raw, gate FROM t),
m AS (SELECT f.id, f.k, f.dim, by_, round_even(least(f.s * f.w * (1 + by_) + (c.raw - f.s * f.w) * (1 - f.w * (1 + by_)) / (1 - f.w), CASE WHEN c.gate LIKE '%prazo%' THEN 20 WHEN c.gate LIKE '%financeiro%' THEN 25 ELSE 1000 END), 0) AS moved FROM f JOIN c ON c.id = f.id CROSS JOIN (VALUES (0.1), (-0.1)) b(by_)),
r AS (SELECT m.id, min(moved) AS least, max(moved) AS most, arg_min(dim, k) FILTER (WHERE (CASE WHEN moved >= 60 THEN 2 WHEN moved >= 30 THEN 1 ELSE 0 END) <> (CASE WHEN c.total >= 60 THEN 2 WHEN c.total >= 30 THEN 1 ELSE 0 END)) AS sensitive_to FROM m JOIN c ON c.id = m.id GROUP BY m.id)
SELECT id, CASE WHEN sensitive_to IS NULL THEN 'ROBUSTA' ELSE 'FRAGIL' END AS stability, sensitive_to, least, most FROM r""")
def bid_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    x = Tables(spark, d).orders.select(
        c("o_orderkey").alias("id"), (F.month("o_orderdate") * 8).cast("double").alias("hab"), (F.dayofmonth("o_orderdate") * 3).cast("double").alias("fin"), F.when(c("o_orderstatus") == "F", 90.0).when(c("o_orderstatus") == "O", 40.0).alias("geo"),
        (c("o_totalprice").cast("double") / 5000).alias("prazo"), F.lit(55.0).alias("comp"), F.when(c("o_orderpriority") == "1-URGENT", "prazo").when(c("o_orderpriority") == "5-LOW", "habilitacao,financeiro").alias("gate"),
    )
    weights = dict(zip(P.DIMENSIONS, map(F.lit, (0.3, 0.25, 0.2, 0.15, 0.1)), strict=True))
    raw = sum((F.coalesce(c(k), F.lit(50.0)) * w for k, w in weights.items()), F.lit(0.0))
    total = F.least(raw, F.when(F.contains("gate", F.lit("prazo")), 20.0).when(F.contains("gate", F.lit("financeiro")), 25.0).otherwise(1000.0))
    return P.sensitivity(x, {k: c(k) for k in P.DIMENSIONS}, weights, total, c("gate")).select("id", "stability", "sensitive_to", "least", "most")
