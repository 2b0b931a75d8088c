"""Scores and classes on tenders, contracts and buyers; streaming ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acquimetra.catalog import query
from acquimetra.operators import relational as R
from acquimetra.operators import scoring as G
from acquimetra.sources.canonical import CONTRACTS_SQL as C
from acquimetra.sources.canonical import contracts, tenders
from acquimetra.sources.tables import Tables, checkpointed, remove, shared_folder

AS_OF = "1999-06-01"


def _day():  # noqa: ANN202
    return F.lit(AS_OF).cast("date")


_T = f"""t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'Revogada' WHEN o_orderkey % 6 = 1 THEN 'aberta' END AS word, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + 10 END AS opening, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + 40 END AS deadline,
 CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS published, CASE WHEN o_orderkey % 9 = 0 THEN 'pregao eletronico' WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS subject, CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS value, CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey END AS agency, o_orderpriority, o_orderstatus FROM orders),
s AS (SELECT *, CASE word WHEN 'Revogada' THEN 'revoked' WHEN 'aberta' THEN 'open' ELSE CASE WHEN deadline IS NOT NULL THEN CASE WHEN opening IS NOT NULL THEN CASE WHEN deadline > DATE '{AS_OF}' AND opening <= DATE '{AS_OF}' THEN 'open' WHEN deadline <= DATE '{AS_OF}' THEN 'closed' WHEN opening > DATE '{AS_OF}' THEN 'upcoming' END WHEN deadline > DATE '{AS_OF}' THEN 'open' ELSE 'closed' END
 WHEN opening IS NOT NULL THEN CASE WHEN opening > DATE '{AS_OF}' THEN 'upcoming' WHEN published IS NULL THEN 'unknown' WHEN date_diff('day', published, DATE '{AS_OF}') <= 90 THEN 'open' WHEN date_diff('day', published, DATE '{AS_OF}') <= 365 THEN 'unknown' ELSE 'closed' END
 WHEN date_diff('day', published, DATE '{AS_OF}') > 365 THEN 'closed' WHEN date_diff('day', published, DATE '{AS_OF}') > 90 AND contains(lower(subject), 'pregao') THEN 'closed' ELSE 'unknown' END END AS status FROM t)"""


def _tenders(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    t = Tables(spark, d).orders.select(
        k.alias("id"), F.when(k % 6 == 0, "Revogada").when(k % 6 == 1, "aberta").alias("word"), F.when(k % 4 != 0, F.date_add(day, 10)).alias("opening"), F.when(k % 3 != 0, F.date_add(day, 40)).alias("deadline"), F.when(k % 10 != 0, day).alias("published"),
        F.when(k % 9 == 0, "pregao eletronico").when(k % 13 == 0, "").otherwise(F.col("o_orderpriority")).alias("subject"), F.when(k % 8 != 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("value"), F.when(k % 17 != 0, F.col("o_custkey")).alias("agency"), "o_orderpriority", "o_orderstatus",
    )
    return t.withColumn("status", G.canonical_status(F.col("word"), F.col("opening"), F.col("deadline"), F.col("published"), F.col("subject"), _day()))


@query("status_ladder", f"WITH {_T} SELECT id, status FROM s")
def status_ladder(spark: SparkSession, d: str) -> DataFrame:
    return _tenders(spark, d).select("id", "status")


@query("ranking_score", f"""WITH {_T}, g AS (SELECT *, o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS competitive, o_orderstatus <> 'P' AS trusted, id % 5 <> 0 AS files, CASE WHEN id % 7 <> 0 THEN id END AS notice, agency % 3 = 0 AS in_radius, (agency IS NULL)::INT + (subject IS NULL)::INT + (value IS NULL)::INT + (opening IS NULL)::INT + (deadline IS NULL)::INT AS gaps FROM s),
x AS (SELECT *, status IN ('revoked', 'annulled', 'failed', 'closed') OR coalesce(trim(subject) = '', false) OR agency IS NULL OR coalesce(value < 0, false) OR coalesce(deadline <= DATE '{AS_OF}' AND status <> 'open', false) AS blocked,
 greatest(0, least(100, 50 + CASE WHEN status = 'open' THEN 30 ELSE 0 END + CASE WHEN status = 'upcoming' THEN 21 ELSE 0 END + CASE WHEN opening > DATE '{AS_OF}' AND date_diff('day', DATE '{AS_OF}', opening) <= 30 THEN 15 ELSE 0 END + CASE WHEN agency IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN value BETWEEN 10000 AND 50000000 THEN 10 ELSE 0 END + CASE WHEN competitive THEN 10 ELSE 0 END
 + CASE WHEN notice IS NOT NULL AND files THEN 15 WHEN notice IS NOT NULL THEN 7 ELSE 0 END + CASE WHEN in_radius THEN 15 ELSE 0 END + CASE WHEN trusted THEN 5 ELSE 0 END + CASE WHEN gaps = 0 THEN 10 ELSE 0 END - CASE WHEN status = 'unknown' THEN 20 ELSE 0 END - CASE WHEN opening IS NULL THEN 15 ELSE 0 END - CASE WHEN deadline IS NULL THEN 10 ELSE 0 END - CASE WHEN value IS NULL THEN 10 ELSE 0 END
 - CASE WHEN notice IS NULL THEN 10 ELSE 0 END - CASE WHEN NOT trusted THEN 10 ELSE 0 END - CASE WHEN NOT competitive THEN 10 ELSE 0 END - CASE WHEN gaps >= 3 THEN 15 ELSE 0 END - CASE WHEN date_diff('day', published, DATE '{AS_OF}') > 60 THEN 5 ELSE 0 END)) AS raw FROM g)
SELECT id, CAST(CASE WHEN blocked THEN 0 WHEN raw >= 70 AND id % 2 = 0 THEN least(raw, 69) ELSE raw END AS INTEGER) AS score, CASE WHEN blocked THEN 'NO_GO' WHEN raw >= 70 AND id % 2 <> 0 THEN 'GO' WHEN raw >= 40 THEN 'REVIEW' ELSE 'NO_GO' END AS tier FROM x""")
def ranking_score(spark: SparkSession, d: str) -> DataFrame:
    t = _tenders(spark, d)
    k = F.col("id")
    c = {n: F.col(n) for n in ("status", "agency", "subject", "value", "opening", "deadline", "published")} | {
        "town": F.lit("x"), "notice": F.when(k % 7 != 0, k), "files": k % 5 != 0, "in_radius": F.col("agency") % 3 == 0, "trusted": F.col("o_orderstatus") != "P", "competitive": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "profile_complete": k % 2 != 0,
    }
    score, tier = G.ranking(c, _day())
    return t.select("id", score.alias("score"), tier.alias("tier"))


@query("backfill_ranking", f"""WITH {_T}, x AS (SELECT id, CASE WHEN status = 'open' THEN 30 ELSE 0 END + CASE WHEN deadline >= DATE '{AS_OF}' THEN 15 WHEN deadline IS NULL AND date_diff('day', published, DATE '{AS_OF}') <= 30 THEN 10 ELSE 0 END + CASE WHEN o_orderpriority = '2-HIGH' THEN 10 ELSE 0 END + CASE WHEN value > 0 THEN 10 ELSE 0 END + CASE WHEN subject <> '' THEN 5 ELSE 0 END AS score FROM s)
SELECT id, CAST(score AS INTEGER) AS score, CASE WHEN score >= 50 THEN 'GO' WHEN score >= 25 THEN 'REVIEW' ELSE 'NO_GO' END AS tier FROM x""")
def backfill_ranking(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    score, tier = G.backfill_ranking(c("status") == "open", c("deadline"), c("published"), c("o_orderpriority") == "2-HIGH", c("value"), c("subject"), _day())
    return _tenders(spark, d).select("id", score.alias("score"), tier.alias("tier"))


@query("buyer_ranking", f"""WITH {C}, b AS (SELECT buyer, CAST(count(*) AS DOUBLE) AS total, CAST(count(*) FILTER (WHERE modality IN ('1-URGENT', '2-HIGH')) AS DOUBLE) AS aec, CAST(sum(value) AS DOUBLE) AS value, CAST(count(*) FILTER (WHERE ends BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 90) AS DOUBLE) AS exp90, CAST(count(*) FILTER (WHERE status = 'O') AS DOUBLE) AS open, greatest(CAST(date_diff('day', min(signed), max(signed)) AS DOUBLE), 1.0) AS span FROM c GROUP BY 1),
m AS (SELECT *, total / span * 365 AS per_year, value / total AS ticket FROM b), x AS (SELECT greatest(max(total), 1.0) AS t, greatest(max(value), 1.0) AS v, greatest(max(per_year), 1.0) AS f, greatest(max(open), 1.0) AS o, greatest(max(exp90), 1.0) AS e FROM m),
r AS (SELECT buyer, least(25.0, aec / greatest(total, 1.0) / 0.30 * 20 + CASE WHEN aec / greatest(total, 1.0) > 0.5 THEN 5.0 ELSE 0.0 END) + least(10.0, total / t * 10) + least(10.0, value / v * 10) + least(15.0, per_year / f * 15) + least(10.0, ticket / 500000 * 10) + 2 + least(10.0, open / o * 10) + least(5.0, exp90 / e * 5) + 3 AS s FROM m, x)
SELECT buyer, CAST(s AS DECIMAL(18,6)) AS score, CASE WHEN s >= 60 THEN 'PRIORITARIO' WHEN s >= 40 THEN 'ATIVO' WHEN s >= 20 THEN 'REVIEW' ELSE 'BAIXA' END AS class FROM r""")
def buyer_ranking(spark: SparkSession, d: str) -> DataFrame:
    c = contracts(Tables(spark, d))
    n = lambda x: x.cast("double")
    b = c.groupBy("buyer").agg(
        n(F.count(F.lit(1))).alias("total"), n(F.count_if(F.col("modality").isin("1-URGENT", "2-HIGH"))).alias("aec"), n(F.sum("value")).alias("value"), n(F.count_if(F.col("ends").between(_day(), F.date_add(_day(), 90)))).alias("exp90"), n(F.count_if(F.col("status") == "O")).alias("open"),
        F.greatest(n(F.datediff(F.max("signed"), F.min("signed"))), F.lit(1.0)).alias("span"),
    )
    m = b.withColumns({"per_year": F.col("total") / F.col("span") * 365, "ticket": F.col("value") / F.col("total")})
    top = m.agg(*[F.greatest(F.max(k), F.lit(1.0)).alias(f"top_{k}") for k in ("total", "value", "per_year", "open", "exp90")])
    score, kind = G.buyer_score({k: F.col(k) for k in ("aec", "total", "value", "per_year", "ticket", "open", "exp90")} | {"km": F.lit(None).cast("double"), "hhi": F.lit(2000)}, {k: F.col(f"top_{k}") for k in ("total", "value", "per_year", "open", "exp90")})
    return m.crossJoin(F.broadcast(top)).select("buyer", score.cast("decimal(18,6)").alias("score"), kind.alias("class"))


@query("victory_fit", f"""WITH {C}, p AS (SELECT supplier, count(*) AS n, CAST(sum(value) AS DOUBLE) / count(*) AS mean, max(value) AS most, CAST(sum(value * value) AS DOUBLE) AS s2, CAST(sum(value) AS DOUBLE) AS s1 FROM c WHERE signed <= DATE '{AS_OF}' GROUP BY 1), q AS (SELECT *, sqrt(greatest(0.0, s2 / n - mean * mean)) AS sd FROM p)
SELECT order_id, supplier, value, CAST(exp(-power((CAST(value AS DOUBLE) - mean) / sd, 2) / 2) * CASE WHEN value > most * 3 THEN 0.3 ELSE 1.0 END AS DECIMAL(18,6)) AS fit FROM c JOIN q USING (supplier) WHERE signed > DATE '{AS_OF}' AND n >= 3""")
def victory_fit(spark: SparkSession, d: str) -> DataFrame:
    c = contracts(Tables(spark, d))
    past = c.where(F.col("signed") <= _day()).groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("s1"), F.sum(F.col("value") * F.col("value")).cast("double").alias("s2"), F.max("value").cast("double").alias("most")).where("n >= 3")
    mean = F.col("s1") / F.col("n")
    fit = G.value_fit(F.col("value").cast("double"), mean, F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)), F.col("most"))
    return c.where(F.col("signed") > _day()).join(past, "supplier").select("order_id", "supplier", "value", fit.cast("decimal(18,6)").alias("fit"))


@query("bid_simulation", f"""WITH {C}, o AS (SELECT order_id, modality, estimate, sum(value) AS v FROM c GROUP BY 1, 2, 3), x AS (SELECT modality, (CAST(estimate AS DOUBLE) - CAST(v AS DOUBLE)) / CAST(estimate AS DOUBLE) AS d FROM o WHERE estimate > v), m AS (SELECT modality, count(*) AS n, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.75) - quantile_cont(d, 0.25) AS sd FROM x GROUP BY 1), g AS (SELECT *, least(median + sd * 0.3, 0.95) AS s FROM m)
SELECT modality, n, CAST(s AS DECIMAL(18,6)) AS suggested, CAST(least(0.95, greatest(0.02, power(1.0 / (1.0 + exp((s - median) / CASE WHEN sd > 0 THEN sd ELSE 0.05 END * -1.7)), greatest(1.0, CAST(least(20.0, greatest(2.0, round(1.5 / 0.4))) AS DOUBLE) - 1)))) AS DECIMAL(18,6)) AS p_win FROM g""")
def bid_simulation(spark: SparkSession, d: str) -> DataFrame:
    o = contracts(Tables(spark, d)).groupBy("order_id", "modality", "estimate").agg(F.sum("value").alias("v")).where("estimate > v")
    x = o.select("modality", (G.discount_percent(F.col("estimate").cast("double"), F.col("v").cast("double")) / 100).alias("d"))
    p = lambda q: F.percentile("d", F.lit(q))
    m = x.groupBy("modality").agg(F.count(F.lit(1)).alias("n"), p(0.5).alias("median"), (p(0.75) - p(0.25)).alias("sd"))
    s = G.suggested_discount(F.col("median"), F.col("sd"), "engineering")
    win = G.win_probability(s, F.col("median"), F.col("sd"), G.rivals(F.lit(0.4)))
    return m.select("modality", "n", s.cast("decimal(18,6)").alias("suggested"), win.cast("decimal(18,6)").alias("p_win"))


@query("bid_score", """WITH x AS (SELECT p_partkey AS id, (p_partkey % 10) / 10.0 AS fit, p_retailprice AS v, (p_partkey % 7) AS roi, (p_partkey % 90) AS p, (p_partkey % 800) AS km, CASE p_partkey % 4 WHEN 0 THEN 'URGENTE' WHEN 1 THEN 'IMINENTE' WHEN 2 THEN 'PLANEJAVEL' ELSE 'SEM_DATA' END AS u, CASE p_partkey % 5 WHEN 0 THEN 'BAIXA' WHEN 1 THEN 'MEDIA' WHEN 2 THEN 'ALTA' WHEN 3 THEN 'MUITO_ALTA' ELSE 'x' END AS k FROM part),
s AS (SELECT id, fit * 0.20 + CASE WHEN v / 500 <= 1 THEN 1.0 WHEN v / 500 <= 3 THEN 0.7 WHEN v / 500 <= 5 THEN 0.4 WHEN v / 500 <= 10 THEN 0.2 ELSE 0.05 END * 0.15 + CASE WHEN roi >= 5 THEN 1.0 WHEN roi >= 3 THEN 0.7 WHEN roi >= 1.5 THEN 0.4 WHEN roi > 0 THEN 0.1 ELSE 0.0 END * 0.15 + least(1.0, p / 60.0) * 0.15 + CASE WHEN km <= 100 THEN 1.0 WHEN km <= 300 THEN 0.7 WHEN km <= 600 THEN 0.4 ELSE 0.2 END * 0.10
 + CASE u WHEN 'URGENTE' THEN 0.3 WHEN 'IMINENTE' THEN 0.6 WHEN 'PLANEJAVEL' THEN 1.0 ELSE 0.4 END * 0.10 + CASE k WHEN 'BAIXA' THEN 1.0 WHEN 'MEDIA' THEN 0.7 WHEN 'ALTA' THEN 0.4 WHEN 'MUITO_ALTA' THEN 0.2 ELSE 0.5 END * 0.15 AS score FROM x) SELECT id, CAST(CAST(score AS DOUBLE) AS DECIMAL(18,4)) AS score FROM s""")
def bid_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda m, names, other: F.coalesce(*[F.when(k % m == i, n) for i, n in enumerate(names)], F.lit(other))
    c = {
        "fit": (k % 10) / 10.0, "value": F.col("p_retailprice"), "capital": F.lit(500.0), "roi": k % 7, "p_win": (k % 90).cast("double"), "km": k % 800, "urgency": pick(4, ["URGENTE", "IMINENTE", "PLANEJAVEL"], "SEM_DATA"),
        "competition": pick(5, ["BAIXA", "MEDIA", "ALTA", "MUITO_ALTA"], "x"),
    }
    return Tables(spark, d).part.select(k.alias("id"), G.bid_score(c)[0].cast("decimal(18,4)").alias("score"))


@query("supplier_share_concentration", f"""WITH {C}, g AS (SELECT buyer, supplier, count(*) AS n FROM c GROUP BY 1, 2) SELECT buyer, count(*) AS n_members, CAST(CAST(sum(n * n) AS DOUBLE) / power(CAST(sum(n) AS DOUBLE), 2) AS DECIMAL(18,8)) AS hhi, CAST(CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS DECIMAL(18,8)) AS top_share FROM g GROUP BY 1""")
def supplier_share_concentration(spark: SparkSession, d: str) -> DataFrame:
    g = R.share_concentration(contracts(Tables(spark, d)), "buyer", "supplier")
    return g.select("buyer", "n_members", F.col("hhi").cast("decimal(18,8)").alias("hhi"), F.col("top_share").cast("decimal(18,8)").alias("top_share"))


@query("openness_recommendation", f"""SELECT o_orderkey AS id, CASE WHEN CAST(o_orderdate AS DATE) + 40 >= DATE '{AS_OF}' AND o_orderstatus = 'O' THEN 'apply' WHEN CAST(o_orderdate AS DATE) + 40 >= DATE '{AS_OF}' THEN 'verify' ELSE 'discard' END AS recommendation FROM orders WHERE o_orderdate <= TIMESTAMP '{AS_OF}'""")
def openness_recommendation(spark: SparkSession, d: str) -> DataFrame:
    t = tenders(Tables(spark, d)).where(F.col("published") <= _day())
    due = F.date_add("published", 40) >= _day()
    return t.select(F.col("order_id").alias("id"), R.ladder((due & (F.col("status") == "O"), "apply"), (due, "verify"), otherwise="discard").alias("recommendation"))


# Texts and, worked out by hand from the rules, their points without the value's, categories and what excludes them.
_WORKS = [
    ("Obra de drenagem", 64, "DRENAGEM,OUTROS_SERVICOS_DE_ENGENHARIA_CIVIL", None),
    ("laudo e projeto", 12, "LAUDOS_E_PERICIAS", None),
    ("engenharia de software", None, "", "software_only"),
    ("fornecimento de cimento", 0, "", "material_isolado"),
    ("Execução de pavimentação e drenagem por empresa especializada, obra na rodovia", 130, "DRENAGEM,INFRAESTRUTURA_RODOVIARIA,OUTROS_SERVICOS_DE_ENGENHARIA_CIVIL,PAVIMENTACAO", None),
    ("licença de software para obra", 32, "OUTROS_SERVICOS_DE_ENGENHARIA_CIVIL", "software_only"),
    ("Reforma e ampliação com construção de escola", 108, "AMPLIACAO,CONSTRUCAO_NOVA,EDIFICACOES_PUBLICAS,REFORMA", None),
    ("topografia e sondagem, laudo, viaduto", 48, "LAUDOS_E_PERICIAS,PONTES_E_OBRAS_DE_ARTE,SONDAGEM,TOPOGRAFIA", None),
]
_WORK_ROWS = ", ".join(f"({i}, {'NULL' if p is None else p}, '{c}', {'NULL' if e is None else repr(e)})" for i, (_, p, c, e) in enumerate(_WORKS))


@query("engineering_classifier", f"""WITH w(i, points, categories, exclusion) AS (VALUES {_WORK_ROWS}), x AS (SELECT p_partkey AS id, w.*, CASE WHEN p_retailprice * 1000 >= 1000000 THEN 8 WHEN p_retailprice * 1000 >= 100000 THEN 4 ELSE 0 END + CASE WHEN p_partkey % 14 BETWEEN 4 AND 9 OR p_partkey % 14 IN (11, 12) THEN 4 ELSE 0 END AS more FROM part JOIN w ON p_partkey % 8 = i),
k AS (SELECT *, CAST(CASE WHEN points IS NULL THEN 0 WHEN exclusion = 'material_isolado' THEN least(points + more, 25) ELSE least(points + more, 100) END AS INTEGER) AS score FROM x)
SELECT id, score, CASE WHEN categories = '' OR score < 40 THEN 'nao_relacionado' WHEN score < 60 THEN 'revisao_necessaria' WHEN score < 80 THEN 'engenharia_provavel' ELSE 'engenharia_confirmada' END AS confidence, categories <> '' AND score >= 60 AS engineering, categories, exclusion FROM k""")
def engineering_classifier(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    subject = F.get(F.array(*[F.lit(w[0]) for w in _WORKS]), (k % 8).cast("int"))
    c = G.engineering_class(subject, F.col("p_retailprice") * 1000, (k % 14).cast("int"))
    return Tables(spark, d).part.select(k.alias("id"), c["score"].alias("score"), c["confidence"].alias("confidence"), c["engineering"].alias("engineering"), F.array_join(c["categories"], ",").alias("categories"), c["exclusion"].alias("exclusion"))


@query("stream_ingest")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events as micro-batches from a file source into a keyed state; what fails the rules goes aside."""
    from acquimetra.streaming import ingest

    home = shared_folder(spark, "ingest")
    landing = f"{home}/landing"
    Tables(spark, d).events.repartition(3, "event_id").write.parquet(landing)
    schema = spark.read.parquet(landing).schema
    ingest.ingest_available(spark, landing, schema, ["user_id", "event_type"], ["ts", "event_id"], {"has_value": "value >= 0", "has_user": "user_id is not null"}, f"{home}/state", f"{home}/checkpoint")
    out = checkpointed(ingest.current(spark, f"{home}/state", ["user_id", "event_type"], ["ts", "event_id"]))
    remove(spark, home)
    return out
