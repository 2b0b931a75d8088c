"""A monitoring cycle over orders and their lines, and operational lists over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acquimetra.catalog import query
from acquimetra.operators import monitor as M
from acquimetra.sources.tables import Tables

_EVENTS = {1: "retificacao", 2: "SUSPENSAO", 3: "PUBLICACAO", 4: "REABERTURA"}
_CYCLES = f"""cur AS (SELECT o_orderkey AS id, CASE WHEN month(o_orderdate) = 12 THEN '' ELSE o_orderstatus END AS status, CASE month(o_orderdate) {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _EVENTS.items())} END AS event, CASE WHEN o_custkey % 9 = 0 THEN ' ' ELSE 'a' || (o_custkey % 60) END AS agency FROM orders WHERE o_orderdate < TIMESTAMP '2001-06-01'),
prev AS (SELECT o_orderkey AS id, CASE WHEN day(o_orderdate) < 8 THEN 'o' ELSE lower(o_orderstatus) END AS status FROM orders WHERE o_orderdate < TIMESTAMP '2001-05-01' AND o_orderpriority <> '5-LOW'),
con AS (SELECT l_orderkey AS cid, l_linenumber AS line, 'a' || (l_suppkey % 50) AS agency, CASE WHEN l_linenumber <> 5 THEN 's' || l_suppkey END AS supplier, CAST(l_shipdate AS DATE) AS ends FROM lineitem)"""


def _cycle(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t, c, month = Tables(spark, d), F.col, F.month("o_orderdate")
    kinds = F.create_map(*[F.lit(x) for kv in _EVENTS.items() for x in kv])
    current = t.orders.where("o_orderdate < timestamp_ntz '2001-06-01'").select(c("o_orderkey").alias("id"), F.when(month == 12, "").otherwise(c("o_orderstatus")).alias("status"), F.try_element_at(kinds, month).alias("event"), F.when(c("o_custkey") % 9 == 0, " ").otherwise(F.concat(F.lit("a"), (c("o_custkey") % 60).cast("string"))).alias("agency"))
    previous = t.orders.where("o_orderdate < timestamp_ntz '2001-05-01' and o_orderpriority <> '5-LOW'").select(c("o_orderkey").alias("id"), F.when(F.dayofmonth("o_orderdate") < 8, "o").otherwise(F.lower("o_orderstatus")).alias("status"))
    contracts = t.lineitem.select(c("l_orderkey").alias("cid"), c("l_linenumber").alias("line"), F.concat(F.lit("a"), (c("l_suppkey") % 50).cast("string")).alias("agency"), F.when(c("l_linenumber") != 5, F.concat(F.lit("s"), c("l_suppkey").cast("string"))).alias("supplier"), c("l_shipdate").cast("date").alias("ends"))
    return current, previous, contracts


@query("monitor_new", f"WITH {_CYCLES} SELECT id, status FROM cur WHERE id NOT IN (SELECT id FROM prev)")
def monitor_new(spark: SparkSession, d: str) -> DataFrame:
    current, previous, _ = _cycle(spark, d)
    return M.new_rows(current, previous).select("id", "status")


_MOVED = f"""m AS (SELECT cur.id, upper(coalesce(event, '')) AS e, prev.status AS from_status, upper(cur.status) AS to_status FROM cur LEFT JOIN prev ON prev.id = cur.id),
v AS (SELECT id, CASE WHEN e IN ('RETIFICACAO', 'SUSPENSAO', 'REABERTURA') THEN e ELSE 'STATUS_CHANGE' END AS event, from_status, to_status FROM m WHERE e IN ('RETIFICACAO', 'SUSPENSAO', 'REABERTURA') OR (from_status IS NOT NULL AND to_status <> '' AND to_status <> upper(from_status)))"""


@query("monitor_changes", f"WITH {_CYCLES}, {_MOVED} SELECT * FROM v")
def monitor_changes(spark: SparkSession, d: str) -> DataFrame:
    current, previous, _ = _cycle(spark, d)
    return M.status_changes(current, previous)


@query("monitor_panorama", f"""WITH {_CYCLES} SELECT 'agency' AS part, CASE WHEN trim(agency) = '' THEN 'UNKNOWN' ELSE agency END AS name, count(*) AS n FROM (SELECT agency FROM cur UNION ALL SELECT agency FROM con) GROUP BY 1, 2 UNION ALL SELECT 'supplier', supplier, count(*) FROM con WHERE supplier IS NOT NULL GROUP BY 1, 2""")
def monitor_panorama(spark: SparkSession, d: str) -> DataFrame:
    current, _, contracts = _cycle(spark, d)
    return M.panorama(current, contracts)


@query("monitor_variation", f"""WITH {_CYCLES}, {_MOVED}, n AS (SELECT 'notices' AS metric, (SELECT count(*) FROM cur) AS current, (SELECT count(*) FROM prev) AS previous UNION ALL SELECT 'contracts', (SELECT count(*) FROM con), (SELECT count(*) FROM con WHERE ends < DATE '2001-05-01') UNION ALL SELECT 'new', (SELECT count(*) FROM cur WHERE id NOT IN (SELECT id FROM prev)), 0
 UNION ALL SELECT 'changes', (SELECT count(*) FROM v), NULL UNION ALL SELECT 'ending', (SELECT count(*) FROM con WHERE date_diff('day', DATE '2001-06-01', ends) BETWEEN 90 AND 180), (SELECT count(*) FROM con WHERE date_diff('day', DATE '2001-05-01', ends) BETWEEN 90 AND 180))
SELECT metric, previous, current, current - previous AS delta, CASE WHEN previous <> 0 THEN round((current - previous) * 100.0::DOUBLE / previous, 2) END AS delta_pct FROM n""")
def monitor_variation(spark: SparkSession, d: str) -> DataFrame:
    current, previous, contracts = _cycle(spark, d)
    ending = lambda day: M.ending(contracts, "ends", F.lit(day).cast("date"))
    now = M.metrics(notices=current, contracts=contracts, new=M.new_rows(current, previous), changes=M.status_changes(current, previous), ending=ending("2001-06-01"))
    before = M.metrics(notices=previous, contracts=contracts.where("ends < date '2001-05-01'"), new=previous.limit(0), ending=ending("2001-05-01"))
    return M.variation(now, before)


@query("uncovered_entities", """SELECT c_custkey AS id, 'no_open_notice' AS gap_reason FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def uncovered_entities(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    notices = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"))
    by_event = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("k"))
    entities = t.customer.select(F.col("c_custkey").alias("id"))
    return M.uncovered(M.uncovered(entities, notices, {"id": "k"}, ""), by_event, {"id": "k"}, "no_open_notice")


_RUNS = """r AS (SELECT event_id AS id, 'u' || (user_id % 25) AS source, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'running' WHEN 'view' THEN 'partial' ELSE 'completed' END AS status, CASE WHEN event_type <> 'click' OR value > 5 THEN ts END AS started, CASE WHEN event_type <> 'click' AND value < 60 THEN ts + INTERVAL 1 HOUR END AS finished, CASE WHEN value > 80 THEN 'slow ' || user_id END AS error FROM events)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    c, kind = F.col, F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "click", "running").when(kind == "view", "partial").otherwise("completed")
    return Tables(spark, d).events.select(
        c("event_id").alias("id"), F.concat(F.lit("u"), (c("user_id") % 25).cast("string")).alias("source"), status.alias("status"), F.when((kind != "click") | (c("value") > 5), c("ts")).alias("started"),
        F.when((kind != "click") & (c("value") < 60), c("ts") + F.expr("interval 1 hour")).alias("finished"), F.when(c("value") > 80, F.concat(F.lit("slow "), c("user_id").cast("string"))).alias("error"),
    )


@query("source_blockers", f"WITH {_RUNS} SELECT source, 'ingestion_' || status AS blocker, count(*) AS n, max(started) AS last_started, coalesce(max(error), '') AS detail FROM r WHERE status IN ('error', 'partial') OR error IS NOT NULL GROUP BY source, status")
def source_blockers(spark: SparkSession, d: str) -> DataFrame:
    return M.blockers(_runs(spark, d))


@query("stale_runs", f"""WITH {_RUNS}, n AS (SELECT *, epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(date_trunc('second', started)) AS s, epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(date_trunc('second', finished)) AS f FROM r), l AS (SELECT * FROM n WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY source ORDER BY finished DESC NULLS LAST, id DESC) = 1)
SELECT id, source, status, CASE WHEN status = 'running' AND s > 7200 THEN 'stuck_running_gt_2h' WHEN status IN ('error', 'partial') AND f > 86400 THEN 'failed_stale_gt_24h' ELSE 'running_no_finish' END AS reason FROM n WHERE (status = 'running' AND s > 7200) OR (status IN ('error', 'partial') AND f > 86400) OR (status = 'running' AND started IS NULL AND finished IS NULL)
UNION ALL SELECT id, source, status, 'latest_completed_older_than_24h' FROM l WHERE coalesce(f, s) > 86400""")
def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    return M.stale_runs(_runs(spark, d), F.lit("2024-01-30 12:00:00").cast("timestamp"))
