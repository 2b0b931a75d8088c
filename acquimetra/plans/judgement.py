"""Judgements on records that orders make: commercial status, reliability, percentages, sector fit; acts found in several systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acquimetra.catalog import query
from acquimetra.operators import judgement as J
from acquimetra.operators import official as A
from acquimetra.operators import registers as G
from acquimetra.sources.tables import Tables

# Categories of acts by month, states by day of the month, titles by priority; and, by hand from the rules, what each state says. "Aviso de Licitação" is no signal: the rule's word ends at "licita".
_CATEGORIES = ("edital", "", "suspensao", "revogacao", "extrato_contrato", "termo_aditivo", "homologacao", "retificacao", "outros", "nao_relacionado", "aviso_licitacao", "posse")
_STATES = {
    "": "none", "Em recebimento de proposta": "open", "Aguardando abertura da sessão": "open", "Publicado resultado": "result", "HOMOLOGADA": "result", "Licitação finalizada": "closed_result", "Encerrado": "closed", "Deserto": "closed",
    "Suspensa sine die": "suspended", "Certame anulado": "closed", "Concluída": "closed_result", "Em sessão, encerrado o prazo": "open", "em análise": "none",
}
_TITLES = {"1-URGENT": "Aviso de Licitação", "2-HIGH": "Comunicado", "3-MEDIUM": "Novo contrato", "4-NOT SPECIFIED": "Pregão nº 5", "5-LOW": None}
_AS_OF = "1999-07-01"


def _list(texts) -> str:  # noqa: ANN001
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in texts) + "]"


@query("commercial_status", f"""WITH x AS (SELECT o_orderkey AS id, ({_list(_CATEGORIES)})[month(o_orderdate)] AS cat, ({_list(_STATES.values())})[1 + day(o_orderdate) % {len(_STATES)}] AS said, CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TITLES.items() if v)} END AS title,
 CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 20 WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) + 400 END AS closes, CAST(o_orderdate AS DATE) + 10 AS opens, CAST(o_orderdate AS DATE) AS published, DATE '{_AS_OF}' AS today FROM orders),
s AS (SELECT *, cat IN ('edital', 'aviso_licitacao') OR coalesce(title, '') LIKE 'Pregão%' AS signal, date_diff('day', published, today) AS age FROM x),
r AS (SELECT id, CASE WHEN cat = 'nao_relacionado' THEN 'unrelated_act' WHEN cat IN ('suspensao', 'revogacao') OR said = 'suspended' THEN 'suspend_or_revoke' WHEN cat = 'extrato_contrato' THEN 'contract_act' WHEN cat = 'termo_aditivo' THEN 'amendment_act' WHEN cat = 'homologacao' THEN 'result_act'
 WHEN said = 'result' THEN 'result_state' WHEN said IN ('closed', 'closed_result') THEN 'closed_state' WHEN closes < today THEN 'deadline_passed' WHEN closes IS NOT NULL AND opens > today THEN 'opens_in_future' WHEN closes IS NOT NULL THEN 'deadline_open' WHEN said = 'open' THEN 'open_state'
 WHEN signal AND age BETWEEN 0 AND 30 THEN 'recent_notice' WHEN signal THEN 'opportunity_without_deadline' WHEN cat = 'retificacao' THEN 'secondary_act' ELSE 'no_signal' END AS rule, cat, said, title FROM s)
SELECT id, rule, CASE rule WHEN 'unrelated_act' THEN 'NOT_RELEVANT' WHEN 'suspend_or_revoke' THEN CASE WHEN cat = 'revogacao' THEN 'CLOSED' ELSE 'SUSPENDED' END WHEN 'contract_act' THEN 'CONTRACT' WHEN 'amendment_act' THEN 'AMENDMENT' WHEN 'result_act' THEN 'RESULT' WHEN 'result_state' THEN 'RESULT'
 WHEN 'closed_state' THEN CASE WHEN said = 'closed' THEN 'CLOSED' ELSE 'RESULT' END WHEN 'deadline_passed' THEN 'CLOSED' WHEN 'opens_in_future' THEN 'UPCOMING_OPPORTUNITY' WHEN 'deadline_open' THEN 'OPEN_OPPORTUNITY' WHEN 'open_state' THEN 'OPEN_OPPORTUNITY' WHEN 'recent_notice' THEN 'RECENT_NOTICE'
 WHEN 'opportunity_without_deadline' THEN 'OTHER_PROCUREMENT_ACT' WHEN 'secondary_act' THEN 'OTHER_PROCUREMENT_ACT' ELSE CASE WHEN cat IN ('', 'outros') AND coalesce(title, '') NOT LIKE '%contrato%' AND coalesce(title, '') NOT LIKE 'Aviso de Licita%' THEN 'NOT_RELEVANT' ELSE 'OTHER_PROCUREMENT_ACT' END END AS status,
 CASE rule WHEN 'unrelated_act' THEN 0.95 WHEN 'suspend_or_revoke' THEN 0.9 WHEN 'contract_act' THEN 0.92 WHEN 'amendment_act' THEN 0.92 WHEN 'result_act' THEN 0.9 WHEN 'result_state' THEN 0.9 WHEN 'closed_state' THEN 0.88 WHEN 'deadline_passed' THEN 0.93 WHEN 'opens_in_future' THEN 0.9 WHEN 'deadline_open' THEN 0.92
 WHEN 'open_state' THEN 0.85 WHEN 'recent_notice' THEN 0.75 WHEN 'opportunity_without_deadline' THEN 0.65 WHEN 'secondary_act' THEN 0.7 ELSE CASE WHEN cat IN ('', 'outros') THEN 0.4 ELSE 0.55 END END::DOUBLE AS confidence, rule IN ('open_state', 'recent_notice', 'opportunity_without_deadline', 'no_signal') AS review FROM r""")
def commercial_status(spark: SparkSession, d: str) -> DataFrame:
    c, day = F.col, F.col("o_orderdate").cast("date")
    at = lambda texts, i: F.element_at(F.array(*map(F.lit, texts)), i)
    titles = F.create_map(*[x for k, v in _TITLES.items() for x in (F.lit(k), F.lit(v).cast("string"))])
    closes = F.when(c("o_orderstatus") == "F", F.date_add(day, 20)).when(c("o_orderstatus") == "O", F.date_add(day, 400))
    s = J.commercial_status(at(_CATEGORIES, F.month(day)), F.try_element_at(titles, c("o_orderpriority")), F.lit(None).cast("string"), at(_STATES, 1 + F.dayofmonth(day) % len(_STATES)), F.date_add(day, 10), closes, day, F.lit(_AS_OF).cast("date"))
    return Tables(spark, d).orders.select(c("o_orderkey").alias("id"), s.alias("s")).select("id", "s.rule", "s.status", "s.confidence", "s.review")


@query("data_reliability", """WITH x AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_linenumber <> 3 THEN l_quantity * 5 END AS age, l_returnflag <> 'N' AS f1, l_linestatus = 'O' AS f2, CASE WHEN l_discount < 0.03 THEN true WHEN l_discount > 0.09 THEN false END AS prov, CASE WHEN l_tax < 0.02 THEN 'OK ' WHEN l_tax < 0.04 THEN 'degraded' WHEN l_tax > 0.07 THEN 'down' END AS health, CASE WHEN l_linenumber < 6 THEN l_linenumber - 1 END AS n, CASE WHEN l_suppkey % 7 = 0 THEN false WHEN l_suppkey % 7 < 4 THEN true END AS q FROM lineitem),
s AS (SELECT *, (NOT f1)::INT + (NOT f2)::INT AS lacking, coalesce(age <= 24, false)::INT + coalesce(prov, false)::INT + coalesce(q, false)::INT + coalesce(health = 'OK ', false)::INT + (f1 AND f2)::INT + coalesce(n >= 2, false)::INT AS good FROM x)
SELECT id, line, CASE WHEN q = false OR prov = false OR health = 'down' OR age > 168 OR n <= 0 OR lacking = 2 THEN 'UNTRUSTED' WHEN lacking > 0 OR health = 'degraded' OR age > 24 OR n < 2 THEN 'DEGRADED' WHEN good >= 3 THEN 'TRUSTED' WHEN good > 0 THEN 'DEGRADED' ELSE 'UNKNOWN' END AS level, good AS signals, count(*) AS copies FROM s GROUP BY ALL""")
def data_reliability(spark: SparkSession, d: str) -> DataFrame:
    c, off = F.col, F.col("l_discount").cast("double")
    health = F.when(c("l_tax") < 0.02, "OK ").when(c("l_tax") < 0.04, "degraded").when(c("l_tax") > 0.07, "down")
    by = c("l_suppkey") % 7
    r = J.reliability(F.when(c("l_linenumber") != 3, c("l_quantity") * 5), [c("l_returnflag") != "N", c("l_linestatus") == "O"], F.when(off < 0.03, True).when(off > 0.09, False), health, F.when(c("l_linenumber") < 6, c("l_linenumber") - 1), F.when(by == 0, False).when(by < 4, True), 2)
    x = Tables(spark, d).lineitem.select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), r.alias("r")).select("id", "line", "r.level", "r.signals")
    return x.groupBy("id", "line", "level", "signals").agg(F.count(F.lit(1)).alias("copies"))


@query("claim_guards", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN nullif(concat_ws(',', CASE WHEN month(o_orderdate) = 1 THEN 'no_denominator' WHEN month(o_orderdate) = 2 THEN 'no_denominator' WHEN month(o_orderdate) = 3 THEN 'empty_denominator' END, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'no_limitations' END), '') END AS refused FROM orders""")
def claim_guards(spark: SparkSession, d: str) -> DataFrame:
    c, month = F.col, F.month("o_orderdate")
    n = F.when(month == 2, -1).when(month == 3, 0).when(month > 3, month)
    none = F.lit(None).cast("array<string>")
    said = F.when(c("o_orderpriority") == "1-URGENT", none).when(c("o_orderpriority") == "2-HIGH", F.array().cast("array<string>")).when(c("o_orderpriority") == "3-MEDIUM", F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.array(F.lit("partial")))
    return Tables(spark, d).orders.select(c("o_orderkey").alias("id"), J.bare_percentage(F.when(c("o_orderstatus") != "P", c("o_totalprice")), n, said).alias("refused"))


@query("sector_fit", """SELECT p_partkey AS id, CASE WHEN p_name LIKE '%red%' AND p_name NOT LIKE '%bolt%' THEN 'COMPATIVEL' WHEN p_name LIKE '%bolt%' AND p_name NOT LIKE '%red%' THEN 'INCOMPATIVEL' WHEN p_name LIKE '%ring%' AND p_name NOT LIKE '%bolt%' THEN 'COMPATIVEL' ELSE 'NEEDS_REVIEW' END AS fit FROM part""")
def sector_fit(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).part.select(F.col("p_partkey").alias("id"), J.sector_fit(F.upper("p_name"), "red", "ring", "bolt").alias("fit"))


_ACTS = """a AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DOUBLE) AS v FROM orders),
l AS (SELECT 'd' || k AS id, CASE WHEN s = 'P' THEN 'dom' ELSE 'doe' END AS system, CASE WHEN p = '1-URGENT' THEN lpad(c::VARCHAR, 14, '0') || '-1-' || (k % 10000) || '/2024' END AS pncp, CASE WHEN p IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN (k // 4)::VARCHAR || '/' || year(day) END AS process, CASE WHEN p = '4-NOT SPECIFIED' THEN (c % 50)::VARCHAR END AS contract, CASE WHEN p = '5-LOW' THEN (c % 30)::VARCHAR END AS edital,
 year(day) AS year, CASE WHEN p <> '3-MEDIUM' THEN 'pregao' END AS modality, CASE WHEN p IN ('2-HIGH', '4-NOT SPECIFIED') THEN lpad(c::VARCHAR, 14, '0') END AS cnpj, 'orgao ' || (c % 40) AS name, CASE WHEN month(day) = 4 THEN 'sc' || (c % 20) END AS sc, s AS status, day AS published, v AS value FROM a),
r AS (SELECT CASE WHEN s = 'F' THEN 'p' ELSE 'c' END || k AS id, CASE WHEN s = 'F' THEN 'pncp' WHEN s = 'O' THEN 'compras_sc' ELSE 'doe' END AS system, CASE WHEN month(day) <> 2 THEN lpad(c::VARCHAR, 14, '0') || '-1-' || (k % 10000) || '/2024' ELSE 'sc-' || k END AS pncp, (k // 4)::VARCHAR || '/' || year(day) AS process, (c % 50)::VARCHAR AS contract, (c % 30)::VARCHAR AS edital,
 year(day) AS year, 'pregao' AS modality, CASE WHEN month(day) <> 3 THEN lpad(c::VARCHAR, 14, '0') END AS cnpj, 'orgao ' || (c % 40) AS name, 'sc' || (c % 20) AS sc, CASE WHEN month(day) = 6 THEN 'X' ELSE s END AS status, day AS published, v * CASE WHEN month(day) = 7 THEN 1.5 ELSE 1.005 END AS value FROM a),
lk AS (SELECT id, system, status, published, value, cnpj, unnest([{'n': 1, 'k': CASE WHEN regexp_matches(pncp, '^[0-9]{14}-') THEN pncp END}, {'n': 2, 'k': process || '|' || cnpj}, {'n': 3, 'k': process || '|' || year || '|' || modality}, {'n': 4, 'k': contract || '|' || cnpj}, {'n': 5, 'k': edital || '|' || year || '|' || cnpj}, {'n': 6, 'k': CASE WHEN cnpj IS NULL THEN edital || '|' || year || '|' || name END}, {'n': 7, 'k': sc}, {'n': 8, 'k': cnpj || '|' || process || '|' || year || '|' || modality}]) AS u FROM l),
rk AS (SELECT id, system, status, published, value, cnpj, unnest([{'n': 1, 'k': CASE WHEN regexp_matches(pncp, '^[0-9]{14}-') THEN pncp END}, {'n': 2, 'k': process || '|' || cnpj}, {'n': 3, 'k': process || '|' || year || '|' || modality}, {'n': 4, 'k': contract || '|' || cnpj}, {'n': 5, 'k': edital || '|' || year || '|' || cnpj}, {'n': 6, 'k': edital || '|' || year || '|' || name}, {'n': 7, 'k': sc}, {'n': 8, 'k': cnpj || '|' || process || '|' || year || '|' || modality}]) AS u FROM r),
m AS (SELECT lk.id, lk.u.n AS n, rk.id AS rid, rk.system AS rsystem, lk.status <> rk.status AS d1, lk.published <> rk.published AS d2, abs(lk.value - rk.value) > 1 AND abs(lk.value - rk.value) / greatest(abs(lk.value), abs(rk.value)) > 0.01 AS d3, left(lk.cnpj, 8) <> left(rk.cnpj, 8) AS d4 FROM lk JOIN rk ON lk.u.n = rk.u.n AND lk.u.k = rk.u.k AND lk.system <> rk.system),
f AS (SELECT *, count(*) OVER (PARTITION BY id, n) AS candidates FROM m), b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY n, rsystem <> 'pncp', rid) = 1)"""


@query("official_matches", f"""WITH {_ACTS} SELECT l.id, ({_list(n for n, _ in A.RULES)})[n] AS rule, rid AS match, rsystem AS match_system, coalesce(candidates, 0) AS candidates, CASE WHEN n IS NOT NULL THEN concat_ws(',', CASE WHEN d1 THEN 'status_divergence' END, CASE WHEN d2 THEN 'date_divergence' END, CASE WHEN d3 THEN 'value_divergence' END, CASE WHEN d4 THEN 'cnpj_conflict' END, CASE WHEN candidates > 1 THEN 'ambiguous_match' END) END AS conflicts,
 CASE WHEN n IS NOT NULL THEN coalesce(d1, false) OR coalesce(d3, false) OR coalesce(d4, false) OR candidates > 1 END AS review FROM l LEFT JOIN b ON b.id = l.id""")
def official_matches(spark: SparkSession, d: str) -> DataFrame:
    c, k, who = F.col, F.col("o_orderkey"), F.col("o_custkey")
    day, p, s = c("o_orderdate").cast("date"), c("o_orderpriority"), c("o_orderstatus")
    text = lambda x: x.cast("string")
    month, year = F.month("o_orderdate"), F.year("o_orderdate")
    cnpj, process = F.lpad(text(who), 14, "0"), F.concat(text(F.expr("o_orderkey div 4")), F.lit("/"), text(year))
    control = F.concat(cnpj, F.lit("-1-"), text(k % 10000), F.lit("/2024"))
    orders = Tables(spark, d).orders
    left = orders.select(
        F.concat(F.lit("d"), text(k)).alias("id"), F.when(s == "P", "dom").otherwise("doe").alias("system"), F.when(p == "1-URGENT", control).alias("pncp_number"), F.when(p.isin("1-URGENT", "2-HIGH", "3-MEDIUM"), process).alias("process_number"),
        F.when(p == "4-NOT SPECIFIED", text(who % 50)).alias("contract_number"), F.when(p == "5-LOW", text(who % 30)).alias("edital_number"), year.alias("year"), F.when(p != "3-MEDIUM", "pregao").alias("modality"),
        F.when(p.isin("2-HIGH", "4-NOT SPECIFIED"), cnpj).alias("agency_cnpj"), F.concat(F.lit("orgao "), text(who % 40)).alias("agency_name"), F.when(month == 4, F.concat(F.lit("sc"), text(who % 20))).alias("sc_id"), s.alias("status"), day.alias("published"), c("o_totalprice").cast("double").alias("value"),
    )
    right = orders.select(
        F.concat(F.when(s == "F", "p").otherwise("c"), text(k)).alias("id"), F.when(s == "F", "pncp").when(s == "O", "compras_sc").otherwise("doe").alias("system"), F.when(month != 2, control).otherwise(F.concat(F.lit("sc-"), text(k))).alias("pncp_number"), process.alias("process_number"),
        text(who % 50).alias("contract_number"), text(who % 30).alias("edital_number"), year.alias("year"), F.lit("pregao").alias("modality"), F.when(month != 3, cnpj).alias("agency_cnpj"), F.concat(F.lit("orgao "), text(who % 40)).alias("agency_name"), F.concat(F.lit("sc"), text(who % 20)).alias("sc_id"),
        F.when(month == 6, "X").otherwise(s).alias("status"), day.alias("published"), (c("o_totalprice").cast("double") * F.when(month == 7, 1.5).otherwise(1.005)).alias("value"),
    )
    return A.matches(left, right).select("id", "rule", "match", "match_system", "candidates", F.array_join("conflicts", ",").alias("conflicts"), "review")


_LEVELS = """x AS (SELECT o_orderkey AS id, o_orderdate AS made, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN 'n' || o_custkey END AS k1, CASE WHEN month(o_orderdate) = 5 THEN o_orderpriority || ':' || (o_custkey % 20) END AS k2, CASE WHEN o_orderstatus = 'F' THEN o_custkey || '|' || year(o_orderdate) END AS k3, md5(o_custkey || '|' || o_orderstatus || '|' || CAST(o_orderdate AS DATE)) AS k4 FROM orders)"""


@query("duplicate_levels", f"""WITH {_LEVELS}, w AS (SELECT *, {", ".join(f"count(*) OVER (PARTITION BY k{i}) AS n{i}, first_value(id) OVER (PARTITION BY k{i} ORDER BY made, id) AS f{i}" for i in range(1, 5))} FROM x)
SELECT id, CASE {" ".join(f"WHEN k{i} IS NOT NULL AND n{i} > 1 THEN f{i}" for i in range(1, 5))} ELSE id END AS keeper, CASE {" ".join(f"WHEN k{i} IS NOT NULL AND n{i} > 1 THEN {i}" for i in range(1, 5))} ELSE 0 END AS level FROM w""")
def duplicate_levels(spark: SparkSession, d: str) -> DataFrame:
    """All four levels: official number, source and its id, agency with process, content hash."""
    c = F.col
    text = lambda x: F.col(x).cast("string")
    keys = [
        F.when((c("o_orderpriority") == "1-URGENT") & (c("o_totalprice") > 300000), F.concat(F.lit("n"), text("o_custkey"))), F.when(F.month("o_orderdate") == 5, F.concat("o_orderpriority", F.lit(":"), (c("o_custkey") % 20).cast("string"))),
        F.when(c("o_orderstatus") == "F", F.concat_ws("|", text("o_custkey"), F.year("o_orderdate").cast("string"))), F.md5(F.concat_ws("|", text("o_custkey"), "o_orderstatus", c("o_orderdate").cast("date").cast("string"))),
    ]
    return G.keyed_duplicates(Tables(spark, d).orders.withColumnRenamed("o_orderkey", "id"), "id", keys, [c("o_orderdate")])
