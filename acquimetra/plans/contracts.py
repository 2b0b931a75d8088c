"""Contract history, winners, prices and buyers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acquimetra.catalog import query
from acquimetra.functions.brackets import COMPETITION, VALUE_RANGES, bracket
from acquimetra.operators import relational as R
from acquimetra.operators.ordered import spread_quantiles
from acquimetra.operators.scoring import discount_percent
from acquimetra.sources.canonical import CONTRACTS_SQL as C
from acquimetra.sources.canonical import MONEY, contracts, tenders
from acquimetra.sources.tables import Tables

AS_OF = "1999-06-01"


def _day():  # noqa: ANN202
    return F.lit(AS_OF).cast("date")


@query("contract_history_3y", f"""WITH {C} SELECT order_id, line, supplier, value, signed, ends, c_name AS buyer_name, c_mktsegment AS segment
FROM c JOIN customer ON buyer = c_custkey WHERE signed BETWEEN DATE '1996-06-01' AND DATE '{AS_OF}'""")
def contract_history_3y(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    c = contracts(t).where(F.col("signed").between(F.add_months(_day(), -36), _day()))
    return c.join(t.customer, F.col("buyer") == F.col("c_custkey")).select("order_id", "line", "supplier", "value", "signed", "ends", F.col("c_name").alias("buyer_name"), F.col("c_mktsegment").alias("segment"))


@query("expiring_contracts_window", f"""WITH {C} SELECT order_id, line, buyer, supplier, value, ends, CAST(date_diff('day', DATE '{AS_OF}', ends) AS INTEGER) AS days_left
FROM c WHERE ends BETWEEN DATE '{AS_OF}' + 90 AND DATE '{AS_OF}' + 180""")
def expiring_contracts_window(spark: SparkSession, d: str) -> DataFrame:
    c = contracts(Tables(spark, d)).where(F.col("ends").between(F.date_add(_day(), 90), F.date_add(_day(), 180)))
    return c.select("order_id", "line", "buyer", "supplier", "value", "ends", F.datediff("ends", _day()).alias("days_left")).orderBy(F.col("ends").asc_nulls_last())


@query("supplier_winners_hhi", f"""WITH {C}, sa AS (SELECT supplier AS k, buyer, sum(value) AS v, count(*) AS n FROM c GROUP BY 1, 2),
t AS (SELECT k, CAST(sum(n) AS BIGINT) AS n_contracts, CAST(sum(v) AS DECIMAL(18,2)) AS total, count(*) AS n_orgs, sum(power(CAST(v AS DOUBLE), 2)) AS q FROM sa GROUP BY k)
SELECT k AS supplier_key, n_contracts, total, n_orgs, CAST(round(q / power(CAST(total AS DOUBLE), 2) * 10000, 0) AS BIGINT) AS hhi FROM t""")
def supplier_winners_hhi(spark: SparkSession, d: str) -> DataFrame:
    return R.concentration(contracts(Tables(spark, d)), "supplier", "buyer", "value").select(F.col("supplier").alias("supplier_key"), "n_contracts", "total", F.col("n_members").alias("n_orgs"), "hhi")


@query("category_percentiles", f"""WITH {C} SELECT CASE WHEN p_type ILIKE '%eco%' THEN 'basico' WHEN p_type ILIKE '%promo%' OR p_type ILIKE '%large%' THEN 'grande' ELSE 'outros' END AS category, count(*) AS n,
CAST(quantile_cont(CAST(value AS DOUBLE), 0.1) AS DECIMAL(18,4)) AS p10, CAST(quantile_cont(CAST(value AS DOUBLE), 0.25) AS DECIMAL(18,4)) AS p25, CAST(quantile_cont(CAST(value AS DOUBLE), 0.5) AS DECIMAL(18,4)) AS p50, CAST(quantile_cont(CAST(value AS DOUBLE), 0.75) AS DECIMAL(18,4)) AS p75, CAST(quantile_cont(CAST(value AS DOUBLE), 0.9) AS DECIMAL(18,4)) AS p90
FROM c JOIN part ON part = p_partkey WHERE value > 0 GROUP BY 1""")
def category_percentiles(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    kind = F.when(F.col("p_type").ilike("%eco%"), "basico").when(F.col("p_type").ilike("%promo%") | F.col("p_type").ilike("%large%"), "grande").otherwise("outros")
    c = contracts(t).where("value > 0").join(t.part, F.col("part") == F.col("p_partkey")).withColumn("category", kind)
    q = spread_quantiles(c, ["category"], "value", (0.1, 0.25, 0.5, 0.75, 0.9))
    return q.select("category", "n", *[F.col(p).cast("decimal(18,4)").alias(p) for p in ("p10", "p25", "p50", "p75", "p90")])


@query("value_observations_union", f"""WITH {C} SELECT order_id, CAST(NULL AS INTEGER) AS line, buyer, estimate AS value, 'estimado' AS basis FROM (SELECT o_orderkey AS order_id, o_custkey AS buyer, CAST(o_totalprice AS DECIMAL(18,2)) AS estimate FROM orders)
UNION ALL SELECT order_id, line, buyer, value, 'contratado' FROM c""")
def value_observations_union(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    a = tenders(t).select("order_id", "buyer", F.col("estimate").alias("value"), F.lit("estimado").alias("basis"))
    b = contracts(t).select("order_id", "line", "buyer", "value", F.lit("contratado").alias("basis"))
    return b.unionByName(a, allowMissingColumns=True)


@query("value_statistics", f"""WITH {C}, u AS (SELECT CAST(o_totalprice AS DECIMAL(18,2)) AS value, 'estimado' AS basis FROM orders UNION ALL SELECT value, 'contratado' FROM c),
s AS (SELECT basis, count(*) AS n, min(value) AS low, max(value) AS high, CAST(sum(value) AS DOUBLE) AS s1, CAST(sum(CAST(value AS DECIMAL(18,2)) * CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS s2,
CAST(quantile_cont(CAST(value AS DOUBLE), 0.25) AS DECIMAL(18,4)) AS p25, CAST(quantile_cont(CAST(value AS DOUBLE), 0.5) AS DECIMAL(18,4)) AS p50, CAST(quantile_cont(CAST(value AS DOUBLE), 0.75) AS DECIMAL(18,4)) AS p75 FROM u GROUP BY basis)
SELECT basis, n, low, high, s1 / n AS mean, CAST(round(CAST(sqrt((s2 - s1 * s1 / n) / (n - 1)) AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS sd, CAST(round(CAST(sqrt((s2 - s1 * s1 / n) / n) * 100 * n / s1 AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS cv, p25, p50, p75 FROM s""")
def value_statistics(spark: SparkSession, d: str) -> DataFrame:
    v = value_observations_union(spark, d)
    s = v.groupBy("basis").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").cast("double").alias("s1"), F.sum(F.col("value") * F.col("value")).cast("double").alias("s2"))
    q = spread_quantiles(v, ["basis"], "value", (0.25, 0.5, 0.75)).select("basis", *[F.col(p).cast("decimal(18,4)").alias(p) for p in ("p25", "p50", "p75")])
    s = s.join(q, "basis")
    spread = F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")
    sd, cv = F.sqrt(spread / (F.col("n") - 1)), F.sqrt(spread / F.col("n")) * 100 * F.col("n") / F.col("s1")
    two = lambda x: F.round(x.cast("decimal(18,6)"), 2).cast(MONEY)
    return s.select("basis", "n", "low", "high", (F.col("s1") / F.col("n")).alias("mean"), two(sd).alias("sd"), two(cv).alias("cv"), "p25", "p50", "p75")


@query("panorama_volume", f"""WITH {C} SELECT CAST(year(signed) AS INTEGER) AS year, CAST(month(signed) AS INTEGER) AS month, count(*) AS n, CAST(sum(value) AS DECIMAL(18,2)) AS total, count(DISTINCT buyer) AS n_buyers FROM c GROUP BY 1, 2""")
def panorama_volume(spark: SparkSession, d: str) -> DataFrame:
    return contracts(Tables(spark, d)).groupBy(F.year("signed").alias("year"), F.month("signed").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast(MONEY).alias("total"), F.count_distinct("buyer").alias("n_buyers"))


@query("seasonality", f"""WITH {C}, m AS (SELECT CAST(month(signed) AS INTEGER) AS month, count(*) AS n, CAST(sum(value) AS DECIMAL(18,2)) AS total FROM c GROUP BY 1)
SELECT month, n, total, CAST(n AS DOUBLE) * 100 / CAST(sum(n) OVER () AS DOUBLE) AS share FROM m""")
def seasonality(spark: SparkSession, d: str) -> DataFrame:
    m = contracts(Tables(spark, d)).groupBy(F.month("signed").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast(MONEY).alias("total"))
    whole = m.agg(F.sum("n").cast("double").alias("_n"))
    return m.crossJoin(F.broadcast(whole)).select("month", "n", "total", (F.col("n").cast("double") * 100 / F.col("_n")).alias("share"))


@query("top_buyers", f"""WITH {C} SELECT buyer, count(*) AS n, CAST(sum(value) AS DECIMAL(18,2)) AS total, max(signed) AS last_signed FROM c GROUP BY buyer ORDER BY n DESC, total DESC, buyer LIMIT 10""")
def top_buyers(spark: SparkSession, d: str) -> DataFrame:
    g = contracts(Tables(spark, d)).groupBy("buyer").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast(MONEY).alias("total"), F.max("signed").alias("last_signed"))
    return g.orderBy(F.desc("n"), F.desc("total"), "buyer").limit(10)


@query("stats_labelled_union", """SELECT 'tenders' AS label, count(*) AS n FROM orders UNION ALL SELECT 'open_tenders', count(*) FILTER (WHERE o_orderstatus = 'O') FROM orders UNION ALL SELECT 'contracts', count(*) FROM lineitem
UNION ALL SELECT 'suppliers', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'buyers', count(DISTINCT o_custkey) FROM orders""")
def stats_labelled_union(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    a = t.orders.agg(F.count(F.lit(1)).alias("tenders"), F.count_if(F.col("o_orderstatus") == "O").alias("open_tenders"), F.count_distinct("o_custkey").alias("buyers")).unpivot([], ["tenders", "open_tenders", "buyers"], "label", "n")
    b = t.lineitem.agg(F.count(F.lit(1)).alias("contracts"), F.count_distinct("l_suppkey").alias("suppliers")).unpivot([], ["contracts", "suppliers"], "label", "n")
    return a.union(b)


@query("star_left_join", f"""WITH {C} SELECT order_id, line, s_name AS supplier_name, p_name AS subject, n_name AS place, value FROM c LEFT JOIN supplier ON supplier = s_suppkey AND s_acctbal > 0 LEFT JOIN part ON part = p_partkey LEFT JOIN nation ON s_nationkey = n_nationkey""")
def star_left_join(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    s = t.supplier.where("s_acctbal > 0")  # a condition of the join on the right side alone
    j = contracts(t).join(s, F.col("supplier") == F.col("s_suppkey"), "left").join(t.part, F.col("part") == F.col("p_partkey"), "left").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.select("order_id", "line", F.col("s_name").alias("supplier_name"), F.col("p_name").alias("subject"), F.col("n_name").alias("place"), "value")


@query("bid_contract_discount", f"""WITH {C}, o AS (SELECT order_id, modality, estimate, sum(value) AS contracted FROM c GROUP BY 1, 2, 3), x AS (SELECT modality, (CAST(estimate AS DOUBLE) - CAST(contracted AS DOUBLE)) / CAST(estimate AS DOUBLE) * 100 AS pct FROM o WHERE estimate > 0)
SELECT modality, count(*) AS n, CAST(quantile_cont(pct, 0.5) AS DECIMAL(18,4)) AS median_discount, count(*) FILTER (WHERE pct > 0) AS n_below FROM x GROUP BY modality""")
def bid_contract_discount(spark: SparkSession, d: str) -> DataFrame:
    o = contracts(Tables(spark, d)).groupBy("order_id", "modality", "estimate").agg(F.sum("value").alias("contracted"))
    x = o.select("modality", discount_percent(F.col("estimate").cast("double"), F.col("contracted").cast("double")).alias("pct")).where("pct is not null")
    return x.groupBy("modality").agg(F.count(F.lit(1)).alias("n"), F.percentile("pct", F.lit(0.5)).cast("decimal(18,4)").alias("median_discount"), F.count_if(F.col("pct") > 0).alias("n_below"))


_PROFILE = f"""p AS (SELECT buyer, count(*) AS n, CAST(sum(value) AS DECIMAL(18,2)) AS total, count(*) FILTER (WHERE modality IN ('1-URGENT', '2-HIGH')) AS n_core, count(DISTINCT supplier) AS n_suppliers, min(signed) AS first_signed, max(signed) AS last_signed,
 count(*) FILTER (WHERE ends BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 90) AS exp90, count(*) FILTER (WHERE ends BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 180) AS exp180, count(*) FILTER (WHERE ends BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 365) AS exp365,
 CAST(quantile_cont(CAST(value AS DOUBLE), 0.5) AS DECIMAL(18,4)) AS median_value FROM c GROUP BY buyer)"""


def _profiles(c: DataFrame) -> DataFrame:
    due = lambda n: F.count_if(F.col("ends").between(_day(), F.date_add(_day(), n))).alias(f"exp{n}")
    return c.groupBy("buyer").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").cast(MONEY).alias("total"), F.count_if(F.col("modality").isin("1-URGENT", "2-HIGH")).alias("n_core"), F.count_distinct("supplier").alias("n_suppliers"), F.min("signed").alias("first_signed"), F.max("signed").alias("last_signed"),
        due(90), due(180), due(365), F.percentile(F.col("value").cast("double"), F.lit(0.5)).cast("decimal(18,4)").alias("median_value"),
    )


@query("buyer_profiles", f"WITH {C}, {_PROFILE} SELECT * FROM p")
def buyer_profiles(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(contracts(Tables(spark, d)))


@query("topn_suppliers_per_buyer", f"""WITH {C}, g AS (SELECT buyer, supplier, count(*) AS n, CAST(sum(value) AS DECIMAL(18,2)) AS total FROM c GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY buyer ORDER BY total DESC, supplier) AS INTEGER) AS rank FROM g) SELECT * FROM r WHERE rank <= 3""")
def topn_suppliers_per_buyer(spark: SparkSession, d: str) -> DataFrame:
    g = contracts(Tables(spark, d)).groupBy("buyer", "supplier").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast(MONEY).alias("total"))
    return R.top_n(g, ["buyer"], [F.desc("total"), "supplier"], 3)


@query("price_panel_iqr", f"""WITH {C}, v AS (SELECT p_type, p_brand, CAST(value AS DOUBLE) AS v FROM c JOIN part ON part = p_partkey), g AS (SELECT p_type, p_brand, count(*) AS n, CAST(quantile_cont(v, 0.25) AS DECIMAL(18,4)) AS p25, CAST(quantile_cont(v, 0.5) AS DECIMAL(18,4)) AS p50, CAST(quantile_cont(v, 0.75) AS DECIMAL(18,4)) AS p75 FROM v GROUP BY 1, 2)
SELECT g.p_type, g.p_brand, n, p25, p50, p75, count(*) FILTER (WHERE v < CAST(p25 AS DOUBLE) - (CAST(p75 AS DOUBLE) - CAST(p25 AS DOUBLE)) * 1.5 OR v > CAST(p75 AS DOUBLE) + (CAST(p75 AS DOUBLE) - CAST(p25 AS DOUBLE)) * 1.5) AS n_outliers, CASE WHEN n < 50 THEN 'INSUFFICIENT_SAMPLE' ELSE 'OK' END AS status FROM v JOIN g USING (p_type, p_brand) GROUP BY ALL""")
def price_panel_iqr(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return R.outliers(contracts(t).join(t.part, F.col("part") == F.col("p_partkey")), ["p_type", "p_brand"], "value", 50, kind="decimal(18,4)")


@query("dispute_stats", """WITH x AS (SELECT o_orderpriority AS modality, CASE WHEN o_totalprice < 100000 THEN '0-100K' WHEN o_totalprice < 500000 THEN '100K-500K' WHEN o_totalprice < 2000000 THEN '500K-2M' ELSE '2M+' END AS value_range, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)
SELECT modality, value_range, count(*) AS n, count(DISTINCT o_custkey) AS n_buyers, CAST(sum(v) AS DECIMAL(18,2)) AS total, max(v) AS high FROM x GROUP BY 1, 2""")
def dispute_stats(spark: SparkSession, d: str) -> DataFrame:
    o = tenders(Tables(spark, d)).withColumn("value_range", bracket(F.col("estimate"), VALUE_RANGES))
    return o.groupBy("modality", "value_range").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("buyer").alias("n_buyers"), F.sum("estimate").cast(MONEY).alias("total"), F.max("estimate").alias("high"))


@query("competitive_metrics", f"""WITH {C}, g AS (SELECT buyer, supplier, CAST(sum(value) AS DOUBLE) AS v FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY buyer ORDER BY v DESC, supplier) AS k FROM g), s AS (SELECT buyer, sum(value) AS t, count(*) AS n FROM c GROUP BY 1),
top AS (SELECT buyer, count(*) AS n_suppliers, sum(CASE WHEN k <= 5 THEN CAST(v AS DECIMAL(18,2)) END) AS v5 FROM r GROUP BY 1)
SELECT s.buyer, s.n AS n_contracts, n_suppliers, CAST(v5 AS DOUBLE) / CAST(t AS DOUBLE) AS top5_share, CASE WHEN n_suppliers < 3 THEN 'BAIXA' WHEN n_suppliers < 6 THEN 'MEDIA' WHEN n_suppliers < 11 THEN 'ALTA' ELSE 'MUITO_ALTA' END AS level FROM s JOIN top USING (buyer)""")
def competitive_metrics(spark: SparkSession, d: str) -> DataFrame:
    g = contracts(Tables(spark, d)).groupBy("buyer", "supplier").agg(F.sum("value").cast(MONEY).alias("v"), F.count(F.lit(1)).alias("n"))
    w = R.W.partitionBy("buyer").orderBy(F.desc("v"), "supplier")
    x = g.withColumn("k", F.row_number().over(w)).groupBy("buyer").agg(F.sum("n").alias("n_contracts"), F.count(F.lit(1)).alias("n_suppliers"), F.sum(F.when(F.col("k") <= 5, F.col("v"))).cast("double").alias("v5"), F.sum("v").cast("double").alias("t"))
    return x.select("buyer", "n_contracts", "n_suppliers", (F.col("v5") / F.col("t")).alias("top5_share"), bracket(F.col("n_suppliers"), COMPETITION).alias("level"))


@query("market_trend", f"""WITH {C}, x AS (SELECT modality, count(*) FILTER (WHERE signed > DATE '1998-12-01') AS n6, count(*) FILTER (WHERE signed > DATE '1998-06-01') AS n12, count(*) FILTER (WHERE signed > DATE '1997-06-01' AND signed <= DATE '1998-06-01') AS n12_before FROM c WHERE signed <= DATE '{AS_OF}' GROUP BY 1)
SELECT modality, n6, n12, n12_before, CASE WHEN n12_before > 0 THEN (CAST(n12 AS DOUBLE) - CAST(n12_before AS DOUBLE)) / CAST(n12_before AS DOUBLE) END AS growth FROM x""")
def market_trend(spark: SparkSession, d: str) -> DataFrame:
    c = contracts(Tables(spark, d)).where(F.col("signed") <= _day())
    since = lambda m: F.col("signed") > F.add_months(_day(), -m)
    g = c.groupBy("modality").agg(F.count_if(since(6)).alias("n6"), F.count_if(since(12)).alias("n12"), F.count_if(since(24) & ~since(12)).alias("n12_before"))
    before = F.col("n12_before").cast("double")
    return g.withColumn("growth", F.when(before > 0, (F.col("n12").cast("double") - before) / before))


@query("supplier_history", f"""WITH {C} SELECT order_id, line, buyer, value, signed, ends FROM c WHERE supplier = 7""")
def supplier_history(spark: SparkSession, d: str) -> DataFrame:
    return contracts(Tables(spark, d)).where("supplier = 7").select("order_id", "line", "buyer", "value", "signed", "ends").orderBy(F.desc("signed"), "order_id", "line")


@query("top_competitors", f"""WITH {C}, g AS (SELECT supplier, count(*) AS n, CAST(sum(value) AS DECIMAL(18,2)) AS total, max(signed) AS last_signed, string_agg(DISTINCT modality, '; ' ORDER BY modality) AS modalities FROM c JOIN part ON part = p_partkey WHERE p_type = 'PROMO' GROUP BY supplier) SELECT * FROM g ORDER BY n DESC, total DESC, supplier LIMIT 20""")
def top_competitors(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    g = contracts(t).join(t.part.where("p_type = 'PROMO'"), F.col("part") == F.col("p_partkey")).groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast(MONEY).alias("total"), F.max("signed").alias("last_signed"), F.array_join(F.array_sort(F.collect_set("modality")), "; ").alias("modalities"))
    return g.orderBy(F.desc("n"), F.desc("total"), "supplier").limit(20)


@query("pricing_stats_newest", f"""WITH {C}, x AS (SELECT value FROM c JOIN part ON part = p_partkey WHERE p_name ILIKE '%red%' AND p_name ILIKE '%widget%' AND value > 0 ORDER BY signed DESC, order_id, line, value LIMIT 1000)
SELECT count(*) AS n, CAST(quantile_cont(CAST(value AS DOUBLE), 0.1) AS DECIMAL(18,4)) AS p10, CAST(quantile_cont(CAST(value AS DOUBLE), 0.5) AS DECIMAL(18,4)) AS p50, CAST(quantile_cont(CAST(value AS DOUBLE), 0.9) AS DECIMAL(18,4)) AS p90, CAST(sum(value) AS DOUBLE) / count(*) AS mean FROM x""")
def pricing_stats_newest(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    x = contracts(t).where("value > 0").join(t.part.where("p_name ilike '%red%' and p_name ilike '%widget%'"), F.col("part") == F.col("p_partkey")).orderBy(F.desc("signed"), "order_id", "line", "value").limit(1000)
    p = lambda q: F.percentile(F.col("value").cast("double"), F.lit(q)).cast("decimal(18,4)")
    return x.agg(F.count(F.lit(1)).alias("n"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), (F.sum("value").cast("double") / F.count(F.lit(1))).alias("mean"))


@query("agency_price_profile", f"""WITH {C}, u AS (SELECT buyer, 'contract' AS kind, value FROM c UNION ALL SELECT o_custkey, 'tender', CAST(o_totalprice AS DECIMAL(18,2)) FROM orders) SELECT buyer, kind, count(*) AS n, min(value) AS low, max(value) AS high, CAST(quantile_cont(CAST(value AS DOUBLE), 0.5) AS DECIMAL(18,4)) AS median FROM u GROUP BY 1, 2""")
def agency_price_profile(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    u = contracts(t).select("buyer", F.lit("contract").alias("kind"), "value").union(tenders(t).select("buyer", F.lit("tender"), "estimate"))
    return u.groupBy("buyer", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.percentile(F.col("value").cast("double"), F.lit(0.5)).cast("decimal(18,4)").alias("median"))


@query("org_ranking_with_basis", f"""WITH {C}, k AS (SELECT buyer, count(*) AS n, CAST(sum(value) AS DECIMAL(18,2)) AS total FROM c WHERE signed > DATE '1998-06-01' AND signed <= DATE '{AS_OF}' GROUP BY 1),
o AS (SELECT o_custkey AS buyer, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total FROM orders GROUP BY 1)
SELECT o.buyer, coalesce(k.n, o.n) AS n, coalesce(k.total, o.total) AS total, CASE WHEN k.n IS NOT NULL THEN 'contratado' ELSE 'estimado' END AS basis FROM o LEFT JOIN k ON o.buyer = k.buyer""")
def org_ranking_with_basis(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    k = contracts(t).where((F.col("signed") > F.add_months(_day(), -12)) & (F.col("signed") <= _day())).groupBy("buyer").agg(F.count(F.lit(1)).alias("kn"), F.sum("value").cast(MONEY).alias("kt"))
    o = tenders(t).groupBy("buyer").agg(F.count(F.lit(1)).alias("on"), F.sum("estimate").cast(MONEY).alias("ot"))
    return o.join(k, "buyer", "left").select("buyer", F.coalesce("kn", "on").alias("n"), F.coalesce("kt", "ot").alias("total"), F.when(F.col("kn").isNotNull(), "contratado").otherwise("estimado").alias("basis"))


@query("effective_end_with_amendments", f"""WITH {C}, a AS (SELECT order_id, max(ends) AS last_end, min(ends) AS base_end, count(*) AS n FROM c GROUP BY 1) SELECT order_id, base_end, last_end, CASE WHEN last_end < DATE '{AS_OF}' THEN 'expired' WHEN last_end > DATE '{AS_OF}' + 180 THEN 'too_far' ELSE 'in_window' END AS reason FROM a WHERE n > 1""")
def effective_end_with_amendments(spark: SparkSession, d: str) -> DataFrame:
    a = contracts(Tables(spark, d)).groupBy("order_id").agg(F.min("ends").alias("base_end"), F.max("ends").alias("last_end"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return a.select("order_id", "base_end", "last_end", F.when(F.col("last_end") < _day(), "expired").when(F.col("last_end") > F.date_add(_day(), 180), "too_far").otherwise("in_window").alias("reason"))
