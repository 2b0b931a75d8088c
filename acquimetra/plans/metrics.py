"""The metric contract, metrics of sources, and the hierarchy of agencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acquimetra.catalog import query
from acquimetra.operators import hierarchy as H
from acquimetra.operators import metrics as M
from acquimetra.sources.tables import Tables

AS_OF = "2001-07-01"
_FIELDS = ("status", "buyer", "value", "published", "priority")
_RECORDS = "SELECT nullif(o_orderstatus, 'P') AS status, o_custkey AS buyer, CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS value, o_orderdate AS published, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders"


@query("metric_contract", f"""WITH e AS (SELECT user_id AS id, max(ts) AS last_seen, bool_or(event_type = 'signup') AS a, bool_or(event_type = 'view') AS b, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase' AND value > 40) AS p FROM events GROUP BY 1),
s AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '2001-01-01'), u AS (SELECT c_custkey AS id, e.id IS NOT NULL AS mapped, coalesce(a AND b AND c AND p, false) AS operational, s.id IS NOT NULL AS signal, last_seen FROM customer LEFT JOIN e ON e.id = c_custkey LEFT JOIN s ON s.id = c_custkey),
r AS ({_RECORDS}),
m AS (SELECT 'entities_with_recent_commercial_signal' AS metric, 'commercial_signal' AS kind, count(*) FILTER (WHERE signal)::DOUBLE AS n, count(*)::DOUBLE AS d, NULL::DOUBLE AS target FROM u
 UNION ALL SELECT 'source_mapping_coverage', 'coverage', count(*) FILTER (WHERE mapped), count(*), 100 FROM u UNION ALL SELECT 'operational_source_coverage', 'coverage', count(*) FILTER (WHERE operational), count(*), 95 FROM u
 UNION ALL SELECT 'freshness_coverage', 'coverage', count(*) FILTER (WHERE last_seen >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR), count(*), NULL FROM u
 UNION ALL SELECT 'opportunity_recall', 'recall', count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O'), count(*) FILTER (WHERE l_returnflag = 'R'), NULL FROM lineitem
 UNION ALL SELECT 'required_field_completeness', 'completeness', round((count(status) + count(buyer) + count(value) + count(published) + count(priority))::DOUBLE / count(*), 4), 5, NULL FROM r)
SELECT metric, kind, 'READY' AS status, n AS numerator, d AS denominator, round(n / d * 100, 2) AS value, target, round(n / d * 100, 2) >= target AS met FROM m""")
def metric_contract(spark: SparkSession, d: str) -> DataFrame:
    """Six indicators: four over the universe of customers, one over a labelled sample, one over records; each population is read once."""
    t, c = Tables(spark, d), F.col
    kinds = {"a": c("event_type") == "signup", "b": c("event_type") == "view", "c": c("event_type") == "click", "p": (c("event_type") == "purchase") & (c("value") > 40)}
    seen = t.events.groupBy(c("user_id").alias("id")).agg(F.max("ts").alias("last_seen"), *[F.bool_or(v).alias(k) for k, v in kinds.items()])
    signal = t.orders.where("o_orderstatus = 'O' and o_orderdate >= timestamp_ntz '2001-01-01'").select(c("o_custkey").alias("id")).distinct().withColumn("signal", F.lit(True))
    stages = F.create_map(*[x for s, v in zip(M.STAGES, ("a", "b", "c", "p", "p", "p"), strict=True) for x in (F.lit(s), c(v))])
    universe = t.customer.select(c("c_custkey").alias("id")).join(seen, "id", "left").join(signal, "id", "left")
    universe = universe.select(F.coalesce("signal", F.lit(False)).alias("signal"), c("last_seen").isNotNull().alias("mapped"), M.source_ready(F.when(c("a"), "Verified"), F.lit(False), stages).alias("operational"), "last_seen")
    entities = M.measure(universe, M.entity_metrics("mapped", "operational", "signal", "last_seen", F.lit("2024-01-31 00:00:00").cast("timestamp"), 24))
    sample = t.lineitem.select((c("l_returnflag") == "R").alias("relevant"), (c("l_linestatus") == "O").alias("retrieved"))
    records = t.orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("status"), c("o_custkey").alias("buyer"), F.when(c("o_totalprice") > 50000, c("o_totalprice")).alias("value"), c("o_orderdate").alias("published"), F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"))
    out = entities.union(M.measure(sample, [M.recall_metric("relevant", "retrieved")])).union(M.measure(records, [M.completeness_metric(_FIELDS)]))
    return out.select("metric", "kind", "status", "numerator", "denominator", "value", "target", "met")


_TAXONOMY = ("F", "O", "aviso", "edital")
_SOURCE_ROWS = "r AS (SELECT o_orderpriority AS source, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS category, o_custkey AS org, c_nationkey AS town, n_regionkey <> 4 AS known, CASE WHEN o_totalprice > 100000 THEN 'x' ELSE ' ' END AS link FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"


@query("source_metrics", f"""WITH {_SOURCE_ROWS}, x AS (SELECT 'all' AS scope, * FROM r UNION ALL SELECT source, * FROM r), i AS (SELECT *, day BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}' AS inside FROM x),
g AS (SELECT scope, count(*) AS n, count(DISTINCT CASE WHEN inside AND known THEN town END) AS towns, count(DISTINCT CASE WHEN inside THEN org END) AS orgs, count(DISTINCT CASE WHEN inside THEN day END) AS days, count(DISTINCT CASE WHEN category IN ('F', 'O', 'aviso', 'edital') THEN category END) AS kinds,
 count(org) + count(link) FILTER (WHERE trim(link) <> '') + count(nullif(category, '')) AS cells, count(*) FILTER (WHERE trim(link) <> '') AS docs, date_diff('hour', max(day)::TIMESTAMP, TIMESTAMP '{AS_OF}') AS hours FROM i GROUP BY scope),
u AS (SELECT count(*) FILTER (WHERE n_regionkey <> 4) AS towns FROM nation), o AS (SELECT count(*) AS orgs FROM customer),
m AS (SELECT scope, 'municipalities_with_publication' AS metric, g.towns::DOUBLE AS n, u.towns::DOUBLE AS d FROM g, u UNION ALL SELECT scope, 'orgs_with_recent_notice', g.orgs, o.orgs FROM g, o UNION ALL SELECT scope, 'temporal_coverage', days, 31 FROM g
 UNION ALL SELECT scope, 'act_category_distribution', kinds, 4 FROM g UNION ALL SELECT scope, 'field_completeness', cells, n * 3 FROM g UNION ALL SELECT scope, 'document_coverage', docs, n FROM g UNION ALL SELECT scope, 'freshness_hours', hours, 1 FROM g)
SELECT metric, scope, 'READY' AS status, n AS numerator, d AS denominator, CASE WHEN metric = 'freshness_hours' THEN round(n, 2) ELSE round(n / d * 100, 2) END AS value FROM m""")
def source_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _source_metrics(spark, d).select("metric", "scope", "status", "numerator", "denominator", "value")


def _source_metrics(spark: SparkSession, d: str) -> DataFrame:
    t, c = Tables(spark, d), F.col
    towns = t.nation.select(c("n_nationkey").alias("town"), (c("n_regionkey") != 4).alias("known"))
    who = t.customer.select(c("c_custkey").alias("org"), c("c_nationkey").alias("town")).join(towns, "town")
    rows = t.orders.select(c("o_orderpriority").alias("source"), c("o_orderdate").cast("date").alias("day"), c("o_orderstatus").alias("category"), c("o_custkey").alias("org"), F.when(c("o_totalprice") > 100000, "x").otherwise(" ").alias("link")).join(who, "org")
    n_towns, n_orgs = F.lit(towns.where("known").count()), F.lit(t.customer.count())
    made = M.source_metrics("day", F.lit(AS_OF).cast("timestamp"), 30, "category", _TAXONOMY, ("org", "link", "category"), ("link",), "day", "town", "known", n_towns, "org", n_orgs)
    return M.measure(rows, made, "source")


@query("metric_conflicts", """SELECT CAST(NULL AS VARCHAR) AS metric, CAST(NULL AS VARCHAR) AS scope, CAST(NULL AS VARCHAR) AS conflict FROM region WHERE false""")
def metric_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the sources against those of all, numerators against denominators: there is nothing to report."""
    return M.conflicts(_source_metrics(spark, d).where("metric <> 'freshness_hours'"))


@query("category_shares", """WITH g AS (SELECT o_orderpriority AS source, coalesce(nullif(o_orderstatus, 'P'), 'unknown') AS category, count(*) AS n FROM orders GROUP BY 1, 2) SELECT source, category, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY source) * 100, 2) AS pct FROM g""")
def category_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).orders.select(F.col("o_orderpriority").alias("source"), F.nullif("o_orderstatus", F.lit("P")).alias("category"))
    return M.category_shares(rows, "source", "category")


_NATURES = {"AUTOMOBILE": "Município", "BUILDING": "Órgão Público do Poder Legislativo Municipal", "FURNITURE": "Autarquia Municipal", "HOUSEHOLD": "Fundo Municipal", "MACHINERY": "Empresa Privada"}


@query("hierarchy_build", f"""WITH e AS (SELECT c_custkey AS id, CASE c_mktsegment {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NATURES.items())} END AS nature, CASE WHEN c_acctbal < 9000 THEN c_nationkey END AS code, c_acctbal >= 0 AS active FROM customer),
h AS (SELECT code, max(id) AS hall FROM e WHERE nature = 'Município' AND active AND code IS NOT NULL AND code <> 5 GROUP BY code), cov AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P'),
x AS (SELECT e.id, hall, CASE nature WHEN 'Órgão Público do Poder Legislativo Municipal' THEN 'camara' WHEN 'Autarquia Municipal' THEN 'autarquia' WHEN 'Fundo Municipal' THEN 'fundo' END AS relationship, e.code, active, e.id IN (SELECT id FROM cov) AS own, e.id IN (SELECT id FROM b) AS busy FROM e LEFT JOIN h ON h.code = e.code),
o AS (SELECT *, CASE WHEN NOT active THEN 'inactive' WHEN code IS NULL THEN 'no_code' WHEN own THEN 'already_covered' WHEN relationship = 'camara' AND busy THEN 'camara_with_notices' WHEN hall IS NULL THEN 'no_town_hall' ELSE 'linked' END AS outcome FROM x WHERE relationship IS NOT NULL)
SELECT id, CASE WHEN outcome = 'linked' THEN hall END AS parent, relationship, outcome FROM o""")
def hierarchy_build(spark: SparkSession, d: str) -> DataFrame:
    t, c = Tables(spark, d), F.col
    nature = F.try_element_at(F.create_map(*[F.lit(x) for kv in _NATURES.items() for x in kv]), c("c_mktsegment"))
    entities = t.customer.select(c("c_custkey").alias("id"), F.when((nature == "Município") & (c("c_nationkey") == 5), F.lit("Estado")).otherwise(nature).alias("nature"), F.when(c("c_acctbal") < 9000, c("c_nationkey")).alias("code"), c("c_custkey").alias("root"), (c("c_acctbal") >= 0).alias("active"))
    covered = t.orders.where("o_orderdate >= timestamp_ntz '2001-06-01'").select(c("o_custkey").alias("id"))
    return H.build(entities, covered, t.orders.where("o_orderstatus = 'P'").select(c("o_custkey").alias("root")))


@query("hierarchy_ancestors", """WITH RECURSIVE p AS (SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 AND c_acctbal > 9000 THEN c_custkey WHEN c_custkey > 0 AND NOT (c_mktsegment = 'MACHINERY' AND c_acctbal < 0) THEN c_custkey // 2 END AS parent FROM customer),
m AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2001-01-01'),
up AS (SELECT id, id AS node, 0 AS depth FROM p UNION ALL SELECT up.id, p.parent, depth + 1 FROM up JOIN p ON p.id = up.node WHERE p.parent IS NOT NULL AND p.parent <> p.id),
r AS (SELECT up.id, arg_max(node, depth) AS top, max(depth) AS depth, arg_min(node, depth) FILTER (WHERE node IN (SELECT id FROM m)) AS nearest, min(depth) FILTER (WHERE node IN (SELECT id FROM m)) AS steps FROM up GROUP BY up.id)
SELECT r.id, CASE WHEN p.parent IS NULL THEN top END AS root, CASE WHEN p.parent IS NULL THEN CAST(depth AS BIGINT) END AS depth, nearest, CAST(steps AS BIGINT) AS steps, p.parent IS NOT NULL AS cyclic FROM r JOIN p ON p.id = r.top""")
def hierarchy_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a tree of many levels with some that answer to themselves; marked are those with recent filled orders."""
    t, k = Tables(spark, d), F.col("c_custkey")
    loop, free = (F.col("c_nationkey") == 3) & (F.col("c_acctbal") > 9000), (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") < 0)
    links = t.customer.select(k.alias("id"), F.when(loop, k).when((k > 0) & ~free, F.expr("c_custkey div 2")).alias("parent"))
    marked = t.orders.where("o_orderstatus = 'F' and o_orderdate >= timestamp_ntz '2001-01-01'").select(F.col("o_custkey").alias("id"))
    found = H.ancestors(links, marked)
    # Roots that nobody answers to are no link at all.
    alone = links.join(found.select("id"), "id", "left_anti").join(marked.distinct().withColumn("m", F.lit(True)), "id", "left")
    return found.union(alone.select("id", F.col("id").alias("root"), F.lit(0).cast("long"), F.when(F.col("m"), F.col("id")), F.when(F.col("m"), 0).cast("long"), F.lit(False)))
