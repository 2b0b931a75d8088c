"""Registers, duplicates by key, runs, snapshots and checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acquimetra.catalog import query
from acquimetra.functions import hashing, parse, text
from acquimetra.operators import coverage as K
from acquimetra.operators import matching as X
from acquimetra.operators import registers as G
from acquimetra.operators import relational as R
from acquimetra.operators import scoring as C
from acquimetra.operators import search as S
from acquimetra.sources.canonical import CONTRACTS_SQL, contracts
from acquimetra.sources.tables import Tables

NOW = "2001-06-30"


@query("capability_sources", """WITH s AS (SELECT c_custkey AS source, max(c_acctbal) >= 0 AS enabled FROM customer GROUP BY 1), h AS (SELECT DISTINCT user_id AS source, event_type AS capability FROM events WHERE value > 20) SELECT s.source, capability FROM s JOIN h ON h.source = s.source WHERE enabled AND capability IN ('click', 'view', 'error')""")
def capability_sources(spark: SparkSession, d: str) -> DataFrame:
    """A register of customers as sources, able of what their events show."""
    t = Tables(spark, d)
    able = t.events.where("value > 20").groupBy(F.col("user_id").alias("source")).agg(F.collect_set("event_type").alias("capabilities"))
    register = t.customer.select(F.col("c_custkey").alias("source"), (F.col("c_acctbal") >= 0).alias("enabled")).join(able, "source")
    parts = [G.capable(register, c).withColumn("capability", F.lit(c)) for c in ("click", "view", "error")]
    return parts[0].union(parts[1]).union(parts[2])


@query("alias_resolve", """WITH a AS (SELECT c_custkey AS alias, min(c_custkey) OVER (PARTITION BY c_nationkey) AS target FROM customer), b AS (SELECT alias, target FROM a WHERE alias % 3 = 0)
SELECT o_orderkey AS id, coalesce(b.target, o_custkey) AS resolved, b.target IS NOT NULL AS via_alias FROM orders LEFT JOIN b ON b.alias = o_custkey""")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    least = t.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("target"))
    known = t.customer.where("c_custkey % 3 = 0").join(least, "c_nationkey").select(F.col("c_custkey").alias("alias"), "target")
    return G.resolved(t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey"), known, "o_custkey").select("id", "resolved", "via_alias")


_CODE = "lpad(CAST({} AS VARCHAR), 8, '0')"


@query("prefix_join_root8", f"""WITH l AS (SELECT o_orderkey AS id, {_CODE.format('o_custkey')} || '0001' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS code FROM orders), r AS (SELECT c_custkey AS entity, CASE WHEN c_custkey % 50 = 0 THEN {_CODE.format('c_custkey')} || '0001' ELSE {_CODE.format('c_custkey')} END AS prefix FROM customer)
SELECT id, entity FROM l JOIN r ON starts_with(code, prefix)""")
def prefix_join_root8(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    code = lambda c: F.lpad(F.col(c).cast("string"), 8, "0")
    left = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(code("o_custkey"), F.lit("0001"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")).alias("code"))
    right = t.customer.select(F.col("c_custkey").alias("entity"), F.when(F.col("c_custkey") % 50 == 0, F.concat(code("c_custkey"), F.lit("0001"))).otherwise(code("c_custkey")).alias("prefix"))
    return G.prefix_join(left, right, "code", "prefix").select("id", "entity")


@query("root8_entity_join", f"""WITH l AS (SELECT o_custkey AS buyer, {_CODE.format('o_custkey')} || '/0001-' || CAST(o_orderkey % 10 AS VARCHAR) AS doc, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders), r AS (SELECT c_custkey AS entity, {_CODE.format('c_custkey')} AS root FROM customer)
SELECT entity, count(*) AS n, CAST(sum(v) AS DECIMAL(28,2)) AS total FROM l JOIN r ON left(regexp_replace(doc, '[^0-9]', '', 'g'), 8) = root GROUP BY entity""")
def root8_entity_join(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    doc = F.concat(F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("/0001-"), (F.col("o_orderkey") % 10).cast("string"))
    left = t.orders.select(text.root8(doc).alias("root"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    right = t.customer.select(F.col("c_custkey").alias("entity"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("root"))
    return left.join(right, "root").groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("decimal(28,2)").alias("total"))


_DUPES = """x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS k1, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) || '|' || CAST(o_orderdate AS DATE) END AS k2, o_orderdate AS made FROM orders)"""


@query("keyed_duplicates", f"""WITH {_DUPES}, w AS (SELECT *, count(*) OVER (PARTITION BY k1) AS n1, first_value(id) OVER (PARTITION BY k1 ORDER BY made, id) AS f1, count(*) OVER (PARTITION BY k2) AS n2, first_value(id) OVER (PARTITION BY k2 ORDER BY made, id) AS f2 FROM x)
SELECT id, CASE WHEN k1 IS NOT NULL AND n1 > 1 THEN f1 WHEN k2 IS NOT NULL AND n2 > 1 THEN f2 ELSE id END AS keeper, CASE WHEN k1 IS NOT NULL AND n1 > 1 THEN 1 WHEN k2 IS NOT NULL AND n2 > 1 THEN 2 ELSE 0 END AS level FROM w""")
def keyed_duplicates(spark: SparkSession, d: str) -> DataFrame:
    o = Tables(spark, d).orders.select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate")
    k1 = F.when(F.col("id") % 3 == 0, F.col("o_custkey"))
    k2 = F.when(F.col("id") % 5 != 0, F.concat_ws("|", "o_custkey", F.col("o_orderdate").cast("date")))
    return G.keyed_duplicates(o, "id", [k1, k2], [F.col("o_orderdate")])


@query("merge_fields_provenance", """WITH x AS (SELECT o_custkey AS g, o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS priority FROM orders)
SELECT g, count(*) AS merged, arg_min(status, id) FILTER (WHERE status IS NOT NULL) AS status, min(id) FILTER (WHERE status IS NOT NULL) AS status_from, arg_min(priority, id) FILTER (WHERE priority IS NOT NULL) AS priority, min(id) FILTER (WHERE priority IS NOT NULL) AS priority_from FROM x GROUP BY g""")
def merge_fields_provenance(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    x = Tables(spark, d).orders.select(F.col("o_custkey").alias("g"), k.alias("id"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("status"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("priority"))
    return G.merged_fields(x, "g", [F.col("id")], ["status", "priority"], "id")


@query("seen_state", """SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS times FROM events GROUP BY user_id""")
def seen_state(spark: SparkSession, d: str) -> DataFrame:
    """The state after a first batch (all but errors), carried on by a second one."""
    e = Tables(spark, d).events.select("user_id", "ts", "event_type")
    first = e.where("event_type <> 'error'").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("times"))
    return G.seen_state(first, e.where("event_type = 'error'"), "user_id", "ts")


@query("stalled_runs", """WITH r AS (SELECT event_id, ts AS started, CASE WHEN event_type <> 'error' THEN ts END AS finished FROM events), n AS (SELECT max(ts) AS now FROM events)
SELECT event_id, CASE WHEN finished IS NOT NULL THEN 'finished' WHEN (epoch_us(now) - epoch_us(started)) / 60000000.0 > 60 THEN 'stalled' ELSE 'running' END AS health FROM r, n""")
def stalled_runs(spark: SparkSession, d: str) -> DataFrame:
    e = Tables(spark, d).events
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    runs = e.select("event_id", F.col("ts").alias("started"), F.when(F.col("event_type") != "error", F.col("ts")).alias("finished"))
    return G.run_health(runs, "started", "finished", F.lit(now)).select("event_id", "health")


@query("snapshot_append", """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS source, count(*) AS n FROM orders GROUP BY 1, 2) SELECT day, source, CASE WHEN source = '1-URGENT' THEN 0 ELSE n END AS n FROM c""")
def snapshot_append(spark: SparkSession, d: str) -> DataFrame:
    """A history that holds one source already (with other counts, which stay), and the snapshot put to it twice."""
    c = Tables(spark, d).orders.groupBy(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    history = c.where("source = '1-URGENT'").withColumn("n", F.lit(0).cast("long"))
    once = G.with_snapshot(history, c, ["day", "source"])
    return G.with_snapshot(once, c, ["day", "source"])


_TAX = "lpad(CAST(s_suppkey * 7919 AS VARCHAR), 8, '0') || '0001' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0')"
_CHECK = "(list_sum(list_transform(range(1, {n}), lambda i: CAST(substr(d, i, 1) AS INTEGER) * {w}[i])) % 11)"
_C1, _C2 = _CHECK.format(n=13, w="[5,4,3,2,9,8,7,6,5,4,3,2]"), _CHECK.format(n=14, w="[6,5,4,3,2,9,8,7,6,5,4,3,2]")


@query("field_validators", f"""WITH x AS (SELECT s_suppkey AS id, {_TAX} AS d, CASE s_nationkey % 4 WHEN 0 THEN 'sc' WHEN 1 THEN 'SP ' WHEN 2 THEN 'XX' END AS uf, s_suppkey % 800 - 100 AS days FROM supplier)
SELECT id, length(d) = 14 AND CAST(substr(d, 13, 1) AS INTEGER) = CASE WHEN {_C1} < 2 THEN 0 ELSE 11 - {_C1} END AND CAST(substr(d, 14, 1) AS INTEGER) = CASE WHEN {_C2} < 2 THEN 0 ELSE 11 - {_C2} END AS tax_ok, coalesce(upper(trim(uf)) IN ('SC', 'SP'), false) AS state_ok, days BETWEEN 0 AND 365 AS range_ok FROM x""")
def field_validators(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    tax = F.concat(F.lpad((k * 7919).cast("string"), 8, "0"), F.lit("0001"), F.lpad((k % 100).cast("string"), 2, "0"))
    n = F.col("s_nationkey") % 4
    uf = F.when(n == 0, "sc").when(n == 1, "SP ").when(n == 2, "XX")
    day = F.to_date(F.lit(NOW))
    return Tables(spark, d).supplier.select(k.alias("id"), G.valid_tax_id(tax).alias("tax_ok"), G.valid_state(uf).alias("state_ok"), G.valid_range(day, F.date_add(day, (k % 800 - 100).cast("int"))).alias("range_ok"))


# Heads and tails of names, and by hand whether a head is of the trade, a head is a public body's, a tail is a legal form, a head is one.
_HEADS = {0: ("Construtora", True, False, False), 1: ("Municipio de Obras", True, True, False), 2: ("Engenharia", True, False, False), 3: ("Padaria", False, False, False), 4: ("Fundação Municipal de Obras", True, True, True), 5: ("Cooperativa de Reformas", True, False, True), 6: ("OBRAS & Cia", True, False, False)}
_TAILS = {"AUTOMOBILE": (" LTDA", True), "BUILDING": (" S.A.", True), "FURNITURE": (" MEI", True), "HOUSEHOLD": (" filial", False), "MACHINERY": ("", False)}


@query("engineering_firms", f"""WITH h(i, head, trade, public, form) AS (VALUES {", ".join(f"({i}, '{w}', {str(t).lower()}, {str(p).lower()}, {str(f).lower()})" for i, (w, t, p, f) in _HEADS.items())}), t(seg, tail, form) AS (VALUES {", ".join(f"('{k}', '{w}', {str(f).lower()})" for k, (w, f) in _TAILS.items())})
SELECT c_custkey AS id, head || ' ' || c_custkey || tail AS name, trade AND NOT public AND (t.form OR h.form) AS is_firm FROM customer JOIN h ON i = c_nationkey % 7 JOIN t ON seg = c_mktsegment""")
def engineering_firms(spark: SparkSession, d: str) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(h[0]) for h in _HEADS.values()]), (F.col("c_nationkey") % 7 + 1).cast("int"))
    tail = F.try_element_at(F.create_map(*[F.lit(x) for k, t in _TAILS.items() for x in (k, t[0])]), F.col("c_mktsegment"))
    x = Tables(spark, d).customer.select(F.col("c_custkey").alias("id"), F.concat(head, F.lit(" "), F.col("c_custkey").cast("string"), tail).alias("name"))
    return x.select("id", "name", G.is_engineering_firm(F.col("name")).alias("is_firm"))


@query("portfolio_selection", """WITH x AS (SELECT o_custkey AS g, o_orderkey AS id, o_orderpriority AS cluster, o_totalprice AS value, o_totalprice * 0.3 - 20000 AS roi_max, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice * 0.1 - 30000 END AS roi_min, CASE WHEN o_orderpriority <> '5-LOW' THEN 1000 + o_totalprice * 0.01 ELSE 2500 END AS cost FROM orders WHERE o_orderstatus <> 'P'),
e AS (SELECT *, (CASE WHEN roi_max > 0 THEN roi_max ELSE roi_min END) / cost AS eff, CASE WHEN roi_min <> 0 THEN (roi_max + roi_min) / 2 ELSE roi_max END AS expected FROM x),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY eff DESC, id) AS pick, sum(value) OVER (PARTITION BY g ORDER BY eff DESC, id) AS total FROM e),
k AS (SELECT *, sum(expected) OVER (PARTITION BY g ORDER BY pick) AS cumulative, row_number() OVER (PARTITION BY g, cluster ORDER BY pick) > 1 AS correlated FROM p WHERE pick <= 5 AND total <= 900000)
SELECT g, id, CAST(pick AS INTEGER) AS pick, round(expected, 4) AS roi_expected, round(cumulative, 4) AS roi_cumulative, correlated FROM k""")
def portfolio_selection(spark: SparkSession, d: str) -> DataFrame:
    v, c = F.col("o_totalprice").cast("double"), F.col
    x = Tables(spark, d).orders.select(
        c("o_custkey").alias("g"), c("o_orderkey").alias("id"), c("o_orderpriority").alias("cluster"), v.alias("value"), (v * 0.3 - 20000).alias("roi_max"), F.when(c("o_orderstatus") == "F", 0.0).otherwise(v * 0.1 - 30000).alias("roi_min"),
        F.when(c("o_orderpriority") != "5-LOW", 1000 + v * 0.01).alias("cost"), F.when(c("o_orderstatus") == "P", "INACESSIVEL").when(c("o_orderstatus") == "F", "QUICK_WIN").otherwise("OPORTUNIDADE").alias("category"),
    )
    return G.chosen(x, "g", "id", 5, 900_000.0, 2500.0).select("g", "id", "pick", F.round("roi_expected", 4).alias("roi_expected"), F.round("roi_cumulative", 4).alias("roi_cumulative"), "correlated")


@query("suggested_bid", f"""WITH {CONTRACTS_SQL}, x AS (SELECT modality, status, 1 - CAST(value AS DOUBLE) / CAST(estimate AS DOUBLE) AS discount FROM c WHERE estimate > 0 AND value > 0),
b AS (SELECT modality, status, count(*) AS n, round(quantile_cont(discount, 0.25), 4) AS p25, round(quantile_cont(discount, 0.5), 4) AS p50, round(quantile_cont(discount, 0.75), 4) AS p75 FROM x WHERE discount BETWEEN -1 AND 1 GROUP BY ALL HAVING count(*) >= 3)
SELECT o_orderkey AS id, round(v * (1 - p75::DECIMAL(10,6)), 2)::DOUBLE AS least, round(v * (1 - p25::DECIMAL(10,6)), 2)::DOUBLE AS most, round(v * (1 - lean), 2)::DOUBLE AS bid, round(lean * 100, 1)::DOUBLE AS discount_pct, round(v * (1 - p50::DECIMAL(10,6)), 2)::DOUBLE AS aggressive, round(v * (1 - CAST(p50::DECIMAL(10,6) * 0.5 AS DECIMAL(12,6))), 2)::DOUBLE AS careful,
 round(((1 - lean) * 1.25 - 1) * 100, 1)::DOUBLE AS margin_pct, CASE WHEN b.n >= 5 THEN 'ALTA' WHEN b.n >= 3 THEN 'MEDIA' END AS confidence FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders) LEFT JOIN (SELECT *, CAST(p50::DECIMAL(10,6) * 0.85 AS DECIMAL(12,6)) AS lean FROM b) b ON b.modality = o_orderpriority AND b.status = o_orderstatus""")
def suggested_bid(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    benchmark = G.discount_benchmark(contracts(t), ["modality", "status"], "estimate", "value")
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("modality"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("v"))
    return G.suggested_bid(rows, benchmark, ["modality", "status"], "v").drop("modality", "status", "v")


@query("consistency_checks", """WITH o AS (SELECT o_orderkey AS id, o_totalprice AS total, o_orderstatus AS status, o_orderdate AS made FROM orders), l AS (SELECT l_orderkey AS id, count(*) AS lines, min(l_shipdate) AS ships FROM lineitem GROUP BY 1), x AS (SELECT o.*, l.lines, l.ships FROM o LEFT JOIN l ON o.id = l.id)
SELECT id, 'has_lines' AS check FROM x WHERE lines IS NULL UNION ALL SELECT id, 'value_in_range' FROM x WHERE NOT coalesce(total BETWEEN 2000 AND 400000, false) UNION ALL SELECT id, 'ships_after_order' FROM x WHERE NOT coalesce(ships >= made, false) UNION ALL SELECT id, 'known_status' FROM x WHERE NOT coalesce(status IN ('O', 'F'), false)""")
def consistency_checks(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("lines"), F.min("l_shipdate").alias("ships"))
    x = t.orders.select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus", "o_orderdate").join(lines, "id", "left")
    return G.failed_checks(x, "id", {"has_lines": F.col("lines") > 0, "value_in_range": F.col("o_totalprice").between(2000, 400_000), "ships_after_order": F.col("ships") >= F.col("o_orderdate"), "known_status": F.col("o_orderstatus").isin("O", "F")})


@query("win_loss_calibration", """WITH x AS (SELECT o_custkey AS g, o_orderstatus AS s, o_totalprice / 499979 AS score, o_totalprice AS v FROM orders),
a AS (SELECT g, count(*) AS total, count(*) FILTER (WHERE s = 'F') AS wins, count(*) FILTER (WHERE s = 'O') AS losses, count(*) FILTER (WHERE s = 'P') AS no_bids, avg(score) FILTER (WHERE s = 'F') AS w, avg(score) FILTER (WHERE s = 'O') AS l, min(score) FILTER (WHERE s = 'F') AS m, coalesce(sum(v) FILTER (WHERE s = 'F'), 0) AS proposed FROM x GROUP BY 1)
SELECT g, total, wins, losses, no_bids, round(wins / greatest(1, wins + losses), 3) AS win_rate, round(coalesce(w, 0), 3) AS score_wins, round(coalesce(l, 0), 3) AS score_losses, CASE WHEN w IS NOT NULL AND l IS NOT NULL THEN round((w + l) / 2, 3) WHEN w IS NOT NULL THEN round(m * 0.9, 3) ELSE 0.45 END AS threshold, round(proposed, 2) AS proposed FROM a""")
def win_loss_calibration(spark: SparkSession, d: str) -> DataFrame:
    v, s = F.col("o_totalprice").cast("double"), F.col("o_orderstatus")
    x = Tables(spark, d).orders.select(F.col("o_custkey").alias("g"), F.when(s == "F", "win").when(s == "O", "loss").otherwise("no_bid").alias("outcome"), (v / 499979).alias("score"), v.alias("proposed"), (v * 0.9).alias("won"))
    return G.calibration(x, "g").select("g", "total", "wins", "losses", "no_bids", "win_rate", "score_wins", "score_losses", "threshold", F.round("proposed", 2).alias("proposed"))


#: Notices with many words from a few columns: words of an order's lines by ship month, return flag and line number.
_NOTICES = """SELECT o_orderkey AS id, o_custkey // 10 AS agency, o_orderpriority AS state, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(o_totalprice AS DOUBLE) END AS v, CAST(o_orderdate AS DATE) AS day,
 list_distinct(list_filter(['obra', 'de', o_orderstatus || 'x', 'ano' || year(o_orderdate), 'mes' || (month(o_orderdate) // 7), 'tri' || (month(o_orderdate) // 7), 'a', 'servico', 'rua'], lambda w: length(w) > 1 AND w NOT IN ('de', 'a'))) AS w FROM orders"""
_ALIKE = """p AS (SELECT a.id AS a, b.id AS b, a.day AS day_a, b.day AS day_b, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(a.w || b.w)) AS overlap FROM n a JOIN n b ON a.agency = b.agency AND a.state = b.state AND a.id < b.id
 WHERE CASE WHEN a.v > 0 AND b.v > 0 THEN least(a.v, b.v) / greatest(a.v, b.v) >= 0.85 ELSE a.v = b.v END AND len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(a.w || b.w)) > 0.8)"""


def _notices(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    half = F.expr("month(o_orderdate) div 7").cast("string")
    text = F.concat_ws(" ", F.lit("Obra de"), F.concat(F.lower("o_orderstatus"), F.lit("x")), F.concat(F.lit("ANO"), F.year("o_orderdate").cast("string")), F.concat(F.lit("mes"), half), F.concat(F.lit("tri"), half), F.lit("a servico  rua"))
    return Tables(spark, d).orders.select(c("o_orderkey").alias("id"), F.expr("o_custkey div 10").alias("agency"), c("o_orderpriority").alias("state"), F.when(c("o_orderstatus") != "P", c("o_totalprice").cast("double")).alias("v"), c("o_orderdate").cast("date").alias("day"), text.alias("text"))


@query("similar_notices", f"WITH n AS ({_NOTICES}), {_ALIKE} SELECT a, b, overlap FROM p")
def similar_notices(spark: SparkSession, d: str) -> DataFrame:
    return G.similar_notices(_notices(spark, d), "id", ["agency", "state"], "v", "text")


@query("notices_without_similar", f"""WITH RECURSIVE n AS ({_NOTICES}), {_ALIKE}, e AS (SELECT CASE WHEN (day_a, a) < (day_b, b) THEN a ELSE b END AS x, CASE WHEN (day_a, a) < (day_b, b) THEN b ELSE a END AS y FROM p), o AS (SELECT id, row_number() OVER (ORDER BY day, id) AS pos FROM n WHERE id IN (SELECT x FROM e UNION SELECT y FROM e)),
r AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS kept UNION ALL SELECT o.pos, CASE WHEN len(list_intersect(r.kept, coalesce((SELECT list(x) FROM e WHERE y = o.id), []))) > 0 THEN r.kept ELSE list_append(r.kept, o.id) END FROM r JOIN o ON o.pos = r.pos + 1),
k AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM r ORDER BY pos DESC LIMIT 1)), f AS (SELECT e.y AS id, arg_min(e.x, o.pos) AS dropped_for FROM e JOIN k ON k.id = e.x JOIN o ON o.id = e.x WHERE e.y NOT IN (SELECT id FROM k) GROUP BY 1)
SELECT n.id, f.dropped_for FROM n LEFT JOIN f USING (id)""")
def notices_without_similar(spark: SparkSession, d: str) -> DataFrame:
    return G.without_similar(_notices(spark, d), "id", ["agency", "state"], "v", "text", "day")


@query("latest_run", """SELECT event_type, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 1""")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    e = Tables(spark, d).events
    last = e.groupBy("event_type").agg(F.max_by(F.struct("event_id", "user_id"), "event_id").alias("r"))
    return last.select("event_type", "r.event_id", "r.user_id")


@query("match_baseline", """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'exact' WHEN o_orderkey % 3 = 1 THEN 'fuzzy' END AS method, o_orderpriority AS source FROM orders), g AS (SELECT source, coalesce(method, 'none') AS method, count(*) AS n FROM x GROUP BY 1, 2) SELECT source, method, n, round(100.0 * n / sum(n) OVER (PARTITION BY source), 2) AS percent FROM g""")
def match_baseline(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    g = Tables(spark, d).orders.groupBy(F.col("o_orderpriority").alias("source"), F.when(k == 0, "exact").when(k == 1, "fuzzy").otherwise("none").alias("method")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(R.W.partitionBy("source")), 2))


@query("status_words", """WITH x AS (SELECT o_orderkey AS id, ['Divulgada', 'Em Análise', 'Cancelado', 'FRACASSADA', 'suspenso', 'acervo público', 'publicado', 'nonsense', 'Agendada', 'Adjudicada'][1 + o_orderkey % 10] AS word, o_orderstatus = 'F' AS gazette FROM orders)
SELECT id, CASE word WHEN 'Divulgada' THEN 'upcoming' WHEN 'Em Análise' THEN 'open' WHEN 'Cancelado' THEN 'revoked' WHEN 'FRACASSADA' THEN 'failed' WHEN 'suspenso' THEN 'suspended' WHEN 'acervo público' THEN CASE WHEN gazette THEN 'unknown' END WHEN 'publicado' THEN 'open' WHEN 'Agendada' THEN 'upcoming' WHEN 'Adjudicada' THEN 'closed' END AS status FROM x""")
def status_words(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*map(F.lit, ("Divulgada", "Em Análise", "Cancelado", "FRACASSADA", "suspenso", "acervo público", "publicado", "nonsense", "Agendada", "Adjudicada")))
    word = F.get(words, (F.col("o_orderkey") % 10).cast("int"))
    return Tables(spark, d).orders.select(F.col("o_orderkey").alias("id"), C.status_word(word, F.col("o_orderstatus") == "F").alias("status"))


# Names and, by hand, what they normalize to and their other names.
_AGENCIES = (
    ("Sec. Mun. de Saúde", "SECRETARIA MUNICIPIO DE SAUDE", ""),
    ("PM de Içara", "PREFEITURA MUNICIPAL DE ICARA", "MUNICIPIO DE ICARA"),
    ("SEC MUN MUN de Foo", "SECRETARIA MUNICIPIO MUNICIPIO DE FOO", ""),
    ("FUNDO MUN Educação 12345678 12345678000199", "FUNDO MUNICIPAL EDUCACAO", ""),
    ("Câmara Municipal de Tubarão", "CAMARA MUNICIPAL DE TUBARAO", "TUBARAO CAMARA MUNICIPAL"),
    ("Câmara de Vereadores de São José", "CAMARA DE VEREADORES DE SAO JOSE", "SAO JOSE CAMARA DE VEREADORES"),
    ("Åland Ýx - Câmara de Vereadores", "ALAND YX CAMARA DE VEREADORES", "CAMARA DE VEREADORES DE ALAND YX"),
    ("CM de Vereadores de Laguna", "CAMARA MUNICIPAL DE VEREADORES DE LAGUNA", "VEREADORES DE LAGUNA CAMARA MUNICIPAL|LAGUNA CAMARA MUNICIPAL DE VEREADORES"),
    ("Prefeitura de Lages", "PREFEITURA DE LAGES", "MUNICIPIO DE LAGES"),
    ("PMF Florianópolis / IPUF", "PREFEITURA MUNICIPAL DE FLORIANOPOLIS INSTITUTO DE PLANEJAMENTO URBANO DE", "MUNICIPIO DE FLORIANOPOLIS INSTITUTO DE PLANEJAMENTO URBANO DE"),
    ("FMS", "FUNDO MUNICIPAL DE SAUDE", ""),
    (None, "", ""),
)


def _texts(texts: tuple) -> str:
    return "[" + ", ".join("NULL" if x is None else "'" + x + "'" for x in texts) + "]"


@query("agency_names", f"""WITH x AS (SELECT c_custkey AS id, 1 + (c_nationkey + CAST(floor(c_acctbal) AS BIGINT) % 7 + 7) % {len(_AGENCIES)} AS i FROM customer) SELECT id, ({_texts(tuple(a[1] for a in _AGENCIES))})[i] AS name, ({_texts(tuple(a[2] for a in _AGENCIES))})[i] AS aliases FROM x""")
def agency_names(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("c_nationkey") + F.floor("c_acctbal") % 7 + 7) % len(_AGENCIES)
    x = Tables(spark, d).customer.select(F.col("c_custkey").alias("id"), text.normalize_name(F.get(F.array(*[F.lit(a[0]) for a in _AGENCIES]), at.cast("int"))).alias("name"))
    return x.select("id", "name", F.array_join(text.aliases(F.col("name")), "|").alias("aliases"))


@query("cosine_search", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), s AS (SELECT vec_id, CAST(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT e FROM q) AS DOUBLE[])) AS DOUBLE) AS c FROM embeddings) SELECT vec_id, round(c, 6) AS cosine FROM s WHERE c > 0.1 ORDER BY c DESC, vec_id LIMIT 20""")
def cosine_search(spark: SparkSession, d: str) -> DataFrame:
    v = Tables(spark, d).embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return S.vector_search(v, "e", "vec_id", v.orderBy("vec_id").first()["e"], 0.1).select("vec_id", F.round("similarity", 6).alias("cosine"))


@query("link_conflicts", """WITH x AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS v, o_orderstatus AS s, CAST(o_orderdate AS DATE) AS day FROM orders), y AS (SELECT id, CASE WHEN id % 3 = 0 THEN v * 1.02 ELSE v END AS v2, CASE WHEN id % 4 = 0 THEN 'X' ELSE s END AS s2, CASE WHEN id % 5 = 0 THEN day + 1 ELSE day END AS d2 FROM x)
SELECT id, concat_ws(',', CASE WHEN s <> s2 THEN 'status' END, CASE WHEN day <> d2 THEN 'date' END, CASE WHEN abs(v - v2) > 1 AND abs(v - v2) > greatest(abs(v), abs(v2)) * 0.01 THEN 'value' END) AS conflicts FROM x JOIN y USING (id)""")
def link_conflicts(spark: SparkSession, d: str) -> DataFrame:
    k, v, s, day = F.col("o_orderkey"), F.col("o_totalprice").cast("double"), F.col("o_orderstatus"), F.col("o_orderdate").cast("date")
    other = (F.when(k % 4 == 0, "X").otherwise(s), F.when(k % 5 == 0, F.date_add(day, 1)).otherwise(day), F.when(k % 3 == 0, v * 1.02).otherwise(v))
    return Tables(spark, d).orders.select(k.alias("id"), X.conflicts((s, other[0]), (day, other[1]), (v, other[2])).alias("conflicts"))


@query("run_states", """SELECT l_orderkey AS order_id, l_linenumber AS line, CASE WHEN l_quantity % 3 = 0 THEN 'success_with_data' WHEN l_linenumber % 2 = 0 AND l_quantity % 5 = 0 AND l_linenumber >= 2 THEN 'success_zero' WHEN l_linenumber % 2 = 0 AND l_quantity % 5 = 0 THEN 'partial' WHEN l_linenumber % 2 = 0 THEN 'success_zero' ELSE 'partial' END AS state, CASE WHEN l_linenumber = 7 THEN 'unknown' WHEN l_quantity <= 20 THEN 'fresh' WHEN l_quantity <= 40 THEN 'stale' ELSE 'overdue' END AS decay FROM lineitem""")
def run_states(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    state = K.run_state(F.when(q % 3 == 0, 1).otherwise(0), F.lit(0), F.lit(0), n % 2 == 0, q % 5 == 0, n, F.lit(2), F.lit(0))
    return Tables(spark, d).lineitem.select(F.col("l_orderkey").alias("order_id"), n.alias("line"), state.alias("state"), K.decay(F.when(n != 7, q), F.lit(20)).alias("decay"))


@query("profile_learning", f"""WITH {CONTRACTS_SQL}, m AS (SELECT supplier, modality, count(*) AS k FROM c GROUP BY 1, 2), t AS (SELECT supplier, string_agg(modality || ':' || k, ',' ORDER BY k DESC, modality) AS modalities FROM m GROUP BY 1)
SELECT c.supplier, count(*) AS n, round(avg(CAST(value AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST(value AS DOUBLE)), 4) AS sd, CAST(min(value) AS DOUBLE) AS least, CAST(max(value) AS DOUBLE) AS most, round(quantile_cont(CAST(value AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST(value AS DOUBLE), 0.75), 6) AS p75, any_value(modalities) AS modalities FROM c JOIN t ON t.supplier = c.supplier GROUP BY 1""")
def profile_learning(spark: SparkSession, d: str) -> DataFrame:
    c = contracts(Tables(spark, d)).select("supplier", "modality", F.col("value").cast("double").alias("value"))
    num = c.groupBy("supplier").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"))
    q = R.quantiles(c, ["supplier"], "value", (0.25, 0.75)).withColumns({"p25": F.round("p25", 6), "p75": F.round("p75", 6)})
    freq = c.groupBy("supplier", "modality").agg(F.count(F.lit(1)).alias("k")).groupBy("supplier").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "modality"))).alias("f"))
    listed = F.array_join(F.transform("f", lambda x: F.concat(x["modality"], F.lit(":"), (-x["k"]).cast("string"))), ",")
    return num.join(q, "supplier").join(freq.select("supplier", listed.alias("modalities")), "supplier")


@query("cross_portal_hash", """WITH x AS (SELECT c_custkey AS id, CASE WHEN c_nationkey <> 3 THEN 'SC' END AS uf, CASE WHEN c_nationkey <> 4 THEN lower(trim(c_mktsegment)) ELSE '' END AS town, CASE WHEN c_nationkey = 5 THEN 0 ELSE c_acctbal END AS v, lower(c_name) AS name FROM customer)
SELECT id, sha256(coalesce(uf, '') || '|' || town || '|' || CASE WHEN v = 0 THEN '0' WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(v AS VARCHAR) END || '|' || 'compra de ' || name) AS hash FROM x""")
def cross_portal_hash(spark: SparkSession, d: str) -> DataFrame:
    c, n = F.col, F.col("c_nationkey")
    # The same subject as portals write it: with a prefix, in capitals, with more blanks.
    subject = F.concat(F.when(n % 2 == 0, "[Portal de Compras Públicas] - ").otherwise(" "), F.when(n % 3 == 0, "Compra   de ").otherwise("COMPRA\tde "), c("c_name"))
    town = F.when(n != 4, F.concat(F.lit(" "), c("c_mktsegment"), F.lit(" ")))
    return Tables(spark, d).customer.select(c("c_custkey").alias("id"), hashing.portal_hash(F.when(n != 3, "SC"), town, F.when(n != 5, c("c_acctbal")), subject).alias("hash"))


@query("cross_source_key", """WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '5-LOW' THEN 'pregao ' || lower(o_orderpriority) ELSE '' END AS modality, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS agency, CASE WHEN month(o_orderdate) <> 5 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE '' END AS day, CASE WHEN month(o_orderdate) <> 6 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) ELSE '' END AS v, o_custkey FROM orders)
SELECT id, sha256(modality || '|aquisicao de asfalto no ' || o_custkey || ' a|' || agency || '|' || day || '|' || v) AS key FROM x""")
def cross_source_key(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    modality = F.when(c("o_orderpriority") != "5-LOW", F.concat(F.lit(" Pregão  "), c("o_orderpriority")))
    subject = F.concat(F.lit("Aquisição de ASFALTO, no. "), c("o_custkey").cast("string"), F.lit(" (à)"))
    key = hashing.cross_source(modality, subject, F.when(c("o_orderstatus") != "P", c("o_custkey").cast("string")), F.when(F.month("o_orderdate") != 5, c("o_orderdate").cast("date")), F.when(F.month("o_orderdate") != 6, c("o_totalprice")))
    return Tables(spark, d).orders.select(c("o_orderkey").alias("id"), key.alias("key"))


@query("leading_numbers", """SELECT c_custkey AS id, CAST(nullif(regexp_extract((CASE WHEN c_custkey % 3 = 0 THEN c_custkey || ' de 7' WHEN c_custkey % 3 = 1 THEN 'x' || c_custkey ELSE '  ' || c_custkey || '/2024' END), '([0-9]+)', 1), '') AS BIGINT) AS number FROM customer""")
def leading_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(" de 7"))).when(k % 3 == 1, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.concat(F.lit("  "), k.cast("string"), F.lit("/2024")))
    return Tables(spark, d).customer.select(k.alias("id"), parse.leading_int(raw).cast("long").alias("number"))
