"""Coverage, evidence and freshness over the event log and the entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acquimetra.catalog import query
from acquimetra.functions.parse import age_hours
from acquimetra.operators import coverage as K
from acquimetra.operators import relational as R
from acquimetra.sources.tables import Tables

NOW = "2024-01-31 00:00:00"


def _now():  # noqa: ANN202
    return F.lit(NOW).cast("timestamp_ntz")


@query("coverage_gaps_anti", """SELECT c_custkey AS entity, c_mktsegment AS segment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2000-01-01') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2000-06-01')""")
def coverage_gaps_anti(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    e = t.customer.select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"))
    o = t.orders.select(F.col("o_custkey").alias("entity"), "o_orderstatus", "o_orderpriority", "o_orderdate")
    a = o.where("o_orderstatus = 'P' and o_orderdate >= timestamp_ntz '2000-01-01'").select("entity")
    b = o.where("o_orderpriority = '1-URGENT' and o_orderdate >= timestamp_ntz '2000-06-01'").select("entity")
    return R.missing(R.missing(e, a, ["entity"]), b, ["entity"])


@query("gaps_by_group_exists_filter", """WITH f AS (SELECT c_mktsegment AS segment, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01') AS covered FROM customer)
SELECT segment, count(*) AS total, count(*) FILTER (WHERE covered) AS n_covered, CAST(round(CAST(count(*) FILTER (WHERE covered) AS DECIMAL(18,2)) * 100 / count(*), 1) AS DOUBLE) AS pct FROM f GROUP BY 1""")
def gaps_by_group_exists_filter(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    recent = t.orders.where("o_orderdate >= timestamp_ntz '2001-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    f = R.with_flag(t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment")), recent, ["c_custkey"], "covered")
    n = F.count_if("covered")
    return f.groupBy("segment").agg(F.count(F.lit(1)).alias("total"), n.alias("n_covered"), F.round(n.cast("decimal(18,2)") * 100 / F.count(F.lit(1)), 1).cast("double").alias("pct"))


@query("null_aware_not_in", """SELECT c_custkey AS entity FROM customer WHERE nullif(c_custkey, 5) NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'O')""")
def null_aware_not_in(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    # NOT IN keeps its null rule in SQL only: a null on either side is no proof of absence.
    sql = "select c_custkey as entity from {c} where nullif(c_custkey, 5L) not in (select o_custkey from {o} where o_totalprice > 400000 and o_orderstatus = 'O')"
    return spark.sql(sql, c=t.customer, o=t.orders)


@query("reappeared_or_exists", """SELECT o_orderkey AS order_id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' AND (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING'))""")
def reappeared_or_exists(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    o = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("buyer"))
    a = R.with_flag(o, t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_id")), ["order_id"], "by_id")
    b = R.with_flag(a, t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("buyer")), ["buyer"], "by_key")
    return b.where("by_id or by_key").select("order_id", "status")


@query("coverage_health", """SELECT event_type AS source, count(*) AS n, count(DISTINCT user_id) AS n_entities, count(*) FILTER (WHERE value > 10) AS n_good, CAST(round(CAST(count(*) FILTER (WHERE value > 10) AS DECIMAL(18,2)) * 100 / greatest(count(*), 1), 1) AS DOUBLE) AS pct, max(ts) AS last_seen FROM events GROUP BY 1""")
def coverage_health(spark: SparkSession, d: str) -> DataFrame:
    good = F.count_if(F.col("value") > 10)
    n = F.count(F.lit(1))
    return Tables(spark, d).events.groupBy(F.col("event_type").alias("source")).agg(n.alias("n"), F.count_distinct("user_id").alias("n_entities"), good.alias("n_good"), F.round(good.cast("decimal(18,2)") * 100 / F.greatest(n, F.lit(1)), 1).cast("double").alias("pct"), F.max("ts").alias("last_seen"))


@query("coverage_summary_share", """WITH g AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id) GROUP BY 1, 2) SELECT source, day, n, CAST(n AS DOUBLE) * 100 / CAST(sum(n) OVER (PARTITION BY day) AS DOUBLE) AS share FROM g""")
def coverage_summary_share(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    e = t.events.join(t.customer.select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi")
    g = e.groupBy(F.col("event_type").alias("source"), F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n").cast("double") * 100 / F.sum("n").over(R.W.partitionBy("day")).cast("double"))


@query("coverage_trend_lag", """WITH g AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2) SELECT source, day, n, n - lag(n) OVER (PARTITION BY source ORDER BY day) AS change, CAST(row_number() OVER (PARTITION BY source ORDER BY day DESC) AS INTEGER) AS recency FROM g""")
def coverage_trend_lag(spark: SparkSession, d: str) -> DataFrame:
    g = Tables(spark, d).events.groupBy(F.col("event_type").alias("source"), F.col("ts").cast("date").alias("day")).agg(F.count_distinct("user_id").alias("n"))
    w = R.W.partitionBy("source")
    return g.select("source", "day", "n", (F.col("n") - F.lag("n").over(w.orderBy("day"))).alias("change"), F.row_number().over(w.orderBy(F.desc("day"))).alias("recency"))


@query("latest_evidence", """SELECT user_id AS entity, event_type AS state, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = Tables(spark, d).events.select(F.col("user_id").alias("entity"), F.col("event_type").alias("state"), "event_id", "ts", "value")
    return R.latest(e, ["entity", "state"], [F.desc_nulls_last("ts"), F.desc("event_id")])


@query("source_health", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT event_type AS state, count(*) AS n_entities, min(ts) AS oldest, max(ts) AS newest FROM l WHERE rn = 1 GROUP BY 1""")
def source_health(spark: SparkSession, d: str) -> DataFrame:
    e = Tables(spark, d).events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))  # one pass, combined before the shuffle
    return e.groupBy(F.col("m.event_type").alias("state")).agg(F.count(F.lit(1)).alias("n_entities"), F.min("m.ts").alias("oldest"), F.max("m.ts").alias("newest"))


@query("hierarchy_self_join", """WITH p AS (SELECT min(c_custkey) AS parent, c_nationkey FROM customer GROUP BY c_nationkey), h AS (SELECT c.c_custkey AS child, min(p.parent) AS parent FROM customer c LEFT JOIN p ON p.c_nationkey = c.c_nationkey AND p.parent <> c.c_custkey GROUP BY 1),
cov AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01') SELECT child, parent, a.k IS NOT NULL AS own, b.k IS NOT NULL AS inherited, a.k IS NOT NULL OR b.k IS NOT NULL AS covered FROM h LEFT JOIN cov a ON a.k = child LEFT JOIN cov b ON b.k = parent""")
def hierarchy_self_join(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    c = t.customer.select(F.col("c_custkey").alias("child"), "c_nationkey")
    p = c.groupBy("c_nationkey").agg(F.min("child").alias("parent"))
    h = c.join(p, "c_nationkey", "left").groupBy("child").agg(F.min(F.when(F.col("parent") != F.col("child"), F.col("parent"))).alias("parent"))
    cov = t.orders.where("o_orderdate >= timestamp_ntz '2001-01-01'").select("o_custkey")
    own = R.with_flag(h, cov.select(F.col("o_custkey").alias("child")), ["child"], "own")
    both = R.with_flag(own, cov.select(F.col("o_custkey").alias("parent")), ["parent"], "inherited")
    return both.select("child", "parent", "own", "inherited", (F.col("own") | F.col("inherited")).alias("covered"))


@query("applicability_wildcard_rules", """WITH r(source, filter, applies, reason, priority) AS (VALUES ('pncp', '*', true, 'national', 1), ('pncp', 'REGION_1', false, 'own portal', 5), ('dom', 'REGION_2', true, 'member', 3), ('dom', '*', false, 'not a member', 1), ('tce', 'REGION_0', true, 'audited', 2)),
e AS (SELECT n_nationkey AS entity, 'REGION_' || CAST(n_regionkey AS VARCHAR) AS area FROM nation), s(source) AS (VALUES ('pncp'), ('dom'), ('tce'), ('ciga')), g AS (SELECT * FROM e CROSS JOIN s), m AS (SELECT g.entity, g.area, g.source, max(r.applies) AS a, max_by(r.reason, r.priority) AS reason FROM g JOIN r ON r.source = g.source AND (r.filter = '*' OR r.filter = g.area) GROUP BY 1, 2, 3)
SELECT g.entity, g.area, g.source, coalesce(m.a, false) AS applicable, coalesce(m.reason, 'no_rule') AS reason FROM g LEFT JOIN m USING (entity, area, source)""")
def applicability_wildcard_rules(spark: SparkSession, d: str) -> DataFrame:
    e = Tables(spark, d).nation.select(F.col("n_nationkey").alias("entity"), F.concat(F.lit("REGION_"), F.col("n_regionkey").cast("string")).alias("area"))
    rules = [("pncp", "*", True, "national", 1), ("pncp", "REGION_1", False, "own portal", 5), ("dom", "REGION_2", True, "member", 3), ("dom", "*", False, "not a member", 1), ("tce", "REGION_0", True, "audited", 2)]
    r = spark.createDataFrame(rules, "source string, filter string, applies boolean, reason string, priority int")
    return K.applicability(e, r, ["pncp", "dom", "tce", "ciga"], "area")


@query("except_missing", """SELECT c_custkey AS entity FROM customer EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'""")
def except_missing(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return t.customer.select(F.col("c_custkey").alias("entity")).subtract(t.events.where("event_type = 'purchase'").select("user_id"))


@query("consecutive_failures", """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id AS entity, count(*) FILTER (WHERE event_type = 'error') AS n_failures, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS states FROM r WHERE rn <= 6 GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'error') >= 2""")
def consecutive_failures(spark: SparkSession, d: str) -> DataFrame:
    last = R.top_n(Tables(spark, d).events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 6)
    g = last.groupBy(F.col("user_id").alias("entity")).agg(F.count_if(F.col("event_type") == "error").alias("n_failures"), F.array_join(F.array_sort(F.collect_set("event_type")), "; ").alias("states"))
    return g.where("n_failures >= 2")


@query("field_completeness", """WITH x AS (SELECT count(*) AS total, count(nullif(o_orderstatus, 'P')) AS a, count(CASE WHEN o_totalprice > 50000 THEN o_totalprice END) AS b, count(nullif(o_orderpriority, '4-NOT SPECIFIED')) AS c FROM orders), u AS (SELECT 'status' AS field, a AS filled, total FROM x UNION ALL SELECT 'value', b, total FROM x UNION ALL SELECT 'priority', c, total FROM x)
SELECT field, filled, total, CAST(round(CAST(filled AS DECIMAL(18,2)) * 100 / greatest(total, 1), 1) AS DOUBLE) AS percent FROM u""")
def field_completeness(spark: SparkSession, d: str) -> DataFrame:
    fields = {"status": F.nullif(F.col("o_orderstatus"), F.lit("P")), "value": F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice")), "priority": F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED"))}
    return R.completeness(Tables(spark, d).orders, fields)


_STATE = "CASE event_type WHEN 'purchase' THEN 'success_with_data' WHEN 'view' THEN 'success_zero' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'pending' ELSE 'partial' END"


def _states(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    state = F.when(t == "purchase", "success_with_data").when(t == "view", "success_zero").when(t == "error", "error").when(t == "signup", "pending").otherwise("partial")
    return Tables(spark, d).events.withColumn("state", state)


_ALLOWED = """(a = 'pending' AND b IN ('running', 'blocked', 'not_applicable')) OR (a = 'running' AND b IN ('success_with_data', 'success_zero', 'partial', 'error', 'blocked', 'pending'))
 OR (a = 'success_with_data' AND b IN ('stale', 'running', 'partial')) OR (a = 'success_zero' AND b IN ('stale', 'running', 'success_with_data')) OR (a = 'partial' AND b IN ('running', 'success_with_data', 'success_zero', 'error', 'stale'))
 OR (a = 'error' AND b IN ('pending', 'running', 'blocked')) OR (a = 'blocked' AND b IN ('pending', 'not_applicable')) OR (a = 'stale' AND b IN ('running', 'pending'))"""


@query("evidence_state_machine", f"""WITH s AS (SELECT user_id, {_STATE} AS b, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events) SELECT a AS from_state, b AS to_state, count(*) AS n, ({_ALLOWED}) AS valid FROM s WHERE a IS NOT NULL GROUP BY a, b""")
def evidence_state_machine(spark: SparkSession, d: str) -> DataFrame:
    s = _states(spark, d).select(F.lag("state").over(R.W.partitionBy("user_id").orderBy("ts", "event_id")).alias("from_state"), F.col("state").alias("to_state")).where("from_state is not null")
    return s.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n")).withColumn("valid", K.is_valid_transition(F.col("from_state"), F.col("to_state")))


@query("evidence_proofs", f"""WITH x AS (SELECT event_id, {_STATE} AS state, CAST(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) AS DOUBLE) / 3600000000 AS age, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events)
SELECT event_id, CASE WHEN state IN ('blocked', 'partial', 'error', 'stale', 'pending', 'never_checked') THEN 'state_' || state WHEN age < 0 THEN 'no_valid_time' WHEN age > 168 THEN 'stale' WHEN state = 'success_zero' AND k % 2 = 0 THEN 'covered_zero' WHEN state = 'success_zero' THEN 'zero_unproved' WHEN k > 0 AND value > 1 AND value <= k THEN 'covered_data' ELSE 'data_unproved' END AS proof FROM x""")
def evidence_proofs(spark: SparkSession, d: str) -> DataFrame:
    e = _states(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    zero = F.col("state") == "success_zero"
    fetched, persisted = F.when(zero, 0).otherwise(F.col("k")), F.when(zero, 0.0).otherwise(F.when(F.col("value") > 1, F.col("value")).otherwise(0.0))
    proof = K.evidence_proof(F.col("state"), F.lit(True), age_hours(_now(), F.col("ts")), F.lit(168), fetched, persisted, F.lit(0), F.lit(0), F.col("k") % 2 == 0)
    return e.select("event_id", proof.alias("proof"))


@query("freshness_classes", f"""WITH l AS (SELECT user_id, max(ts) AS ts, max_by(event_type, (ts, event_id)) AS last_type, max_by(event_id, (ts, event_id)) AS run_id FROM events GROUP BY 1), x AS (SELECT c_custkey AS entity, c_mktsegment, last_type, run_id, CAST(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) AS DOUBLE) / 3600000000 AS age FROM customer LEFT JOIN l ON user_id = c_custkey)
SELECT entity, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'NOT_APPLICABLE' WHEN last_type = 'signup' THEN 'BLOCKED' WHEN last_type = 'error' THEN 'INCOMPLETE' WHEN age IS NULL THEN 'NEVER' WHEN age < 0 OR run_id % 7 = 0 THEN 'INCOMPLETE' WHEN age <= 24 THEN 'FRESH' ELSE 'STALE' END AS freshness FROM x""")
def freshness_classes(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    last = t.events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    x = t.customer.join(last, F.col("user_id") == F.col("c_custkey"), "left")
    run = F.when(F.col("m.event_id") % 7 != 0, F.col("m.event_id"))
    kind = lambda v: F.coalesce(F.col("m.event_type") == v, F.lit(False))
    c = K.freshness(F.col("c_mktsegment") != "FURNITURE", kind("signup"), kind("error"), age_hours(_now(), F.col("m.ts")), run, F.lit("h"), F.lit(K.SLA_HOURS["tenders"]))
    return x.select(F.col("c_custkey").alias("entity"), c.alias("freshness"))


@query("recall_by_stratum", """WITH s AS (SELECT lang, source, quality = 1 AS found, CAST(n_chars AS DOUBLE) AS w FROM labels JOIN documents USING (doc_id)), u AS (SELECT 'lang' AS dimension, lang AS stratum, found, w FROM s UNION ALL SELECT 'source', source, found, w FROM s UNION ALL SELECT 'overall', 'all', found, w FROM s)
SELECT dimension, stratum, count(*) AS n, count(*) FILTER (WHERE found) AS n_found, sum(CASE WHEN found THEN w ELSE 0 END) / sum(w) AS recall, sum(CASE WHEN found THEN w ELSE 0 END) / sum(w) >= 0.8 AS passes FROM u GROUP BY 1, 2""")
def recall_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    s = t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id").withColumn("found", F.col("quality") == 1)
    return K.stratified_recall(s, ["lang", "source"], "found", "n_chars")


@query("coverage_buckets", f"""WITH e AS (SELECT user_id, event_type AS source, max(ts) AS ts FROM events GROUP BY 1, 2), b AS (SELECT user_id, source, CASE WHEN ts >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR THEN 'covered' WHEN ts >= TIMESTAMP '{NOW}' - INTERVAL 240 HOUR THEN 'stale' ELSE 'overdue' END AS bucket FROM e)
SELECT source, bucket, count(*) AS n, CAST(count(*) AS DOUBLE) * 100 / CAST(sum(count(*)) OVER (PARTITION BY source) AS DOUBLE) AS share FROM b GROUP BY 1, 2""")
def coverage_buckets(spark: SparkSession, d: str) -> DataFrame:
    e = Tables(spark, d).events.groupBy("user_id", F.col("event_type").alias("source")).agg(F.max("ts").alias("ts"))
    age = age_hours(_now(), F.col("ts"))
    g = e.withColumn("bucket", F.when(age <= 72, "covered").when(age <= 240, "stale").otherwise("overdue")).groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n").cast("double") * 100 / F.sum("n").over(R.W.partitionBy("source")).cast("double"))


@query("coverage_gate", f"""WITH e AS (SELECT user_id, event_type, max(ts) >= TIMESTAMP '{NOW}' - INTERVAL 240 HOUR AS ok FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2), g AS (SELECT user_id, count(*) FILTER (WHERE ok) AS n FROM e GROUP BY 1)
SELECT count(*) AS denominator, count(*) FILTER (WHERE n = 2) AS covered, CASE WHEN count(*) = 0 THEN 'NOT_READY' WHEN CAST(count(*) FILTER (WHERE n = 2) AS DOUBLE) / CAST(count(*) AS DOUBLE) >= 0.95 THEN 'PASS' ELSE 'FAIL' END AS gate FROM g""")
def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    e = Tables(spark, d).events.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts")).withColumn("ok", age_hours(_now(), F.col("ts")) <= 240)
    return K.coverage_gate(e, "user_id", ["view", "click"], "event_type", "ok")


@query("worst_state_by_entity", f"""WITH p(state, k) AS (VALUES {', '.join(f"('{s}', {i})" for i, s in enumerate(K.PRECEDENCE))}), s AS (SELECT user_id, {_STATE} AS state FROM events WHERE ts >= TIMESTAMP '2024-01-25') SELECT user_id AS entity, min_by(state, k) AS state FROM s JOIN p USING (state) GROUP BY 1""")
def worst_state_by_entity(spark: SparkSession, d: str) -> DataFrame:
    return K.worst_state(_states(spark, d).where("ts >= timestamp_ntz '2024-01-25'"), ["user_id"], "state").withColumnRenamed("user_id", "entity")


@query("population_identity", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_left, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_right""")
def population_identity(spark: SparkSession, d: str) -> DataFrame:
    o = Tables(spark, d).orders
    g = o.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("b"))  # both anti joins in one pass
    return g.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_left"), F.count_if(F.col("b") & ~F.col("a")).alias("only_right"))
