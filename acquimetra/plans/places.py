"""Points near points, and records of several versions, with JSON built and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acquimetra.catalog import query
from acquimetra.operators import nearby as N
from acquimetra.sources import files, records
from acquimetra.sources.tables import Tables, remove, shared_folder

_LAT, _LON = "(((n + CAST(floor(bal) AS BIGINT)) % 181 + 181) % 181 - 90)::DOUBLE", "(((n * 37 + CAST(floor(bal) AS BIGINT) * 7) % 361 + 361) % 361 - 180)::DOUBLE"
_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_POINTS = f"""a AS (SELECT c_custkey AS id, {_LAT} AS lat, {_LON} AS lon FROM (SELECT c_custkey, c_nationkey AS n, c_acctbal AS bal FROM customer WHERE c_mktsegment <> 'MACHINERY')),
b AS (SELECT s_suppkey AS sid, {_LAT} AS lat, {_LON} AS lon FROM (SELECT s_suppkey, s_nationkey * 3 AS n, s_acctbal AS bal FROM supplier))"""


def _place(n: Column, bal: Column) -> tuple[Column, Column]:
    whole = F.floor(bal)
    return (F.pmod(n + whole, F.lit(181)) - 90).cast("double").alias("lat"), (F.pmod(n * 37 + whole * 7, F.lit(361)) - 180).cast("double").alias("lon")


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t, c = Tables(spark, d), F.col
    a = t.customer.where("c_mktsegment <> 'MACHINERY'").select(c("c_custkey").alias("id"), *_place(c("c_nationkey"), c("c_acctbal")))
    return a, t.supplier.select(c("s_suppkey").alias("sid"), *_place(c("s_nationkey") * 3, c("s_acctbal")))


@query("points_near_points", f"WITH {_POINTS}, p AS (SELECT id, sid, {_KM} AS km FROM a CROSS JOIN b) SELECT id, sid, round(km, 6) AS km FROM p WHERE km <= 900")
def points_near_points(spark: SparkSession, d: str) -> DataFrame:
    a, b = _points(spark, d)
    return N.near(a, b, 900.0).select(F.col("a.id").alias("id"), F.col("b.sid").alias("sid"), F.round("km", 6).alias("km"))


@query("nearest_points", f"WITH {_POINTS}, p AS (SELECT id, sid, {_KM} AS km FROM a CROSS JOIN b), m AS (SELECT id, arg_min(sid, (km, sid)) AS sid, min(km) AS km FROM p WHERE km <= 600 GROUP BY id) SELECT a.id, m.sid, round(m.km, 6) AS km FROM a LEFT JOIN m USING (id)")
def nearest_points(spark: SparkSession, d: str) -> DataFrame:
    a, b = _points(spark, d)
    return N.nearest(a, b, "id", "sid", 600.0).select("id", "sid", F.round("km", 6).alias("km"))


_SOURCE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'pncp' WHEN '2-HIGH' THEN 'dom_sc' WHEN '3-MEDIUM' THEN 'portal' WHEN '4-NOT SPECIFIED' THEN 'pncp' ELSE 'dom_sc' END"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """A JSON record of each order, as its source would have it; some are broken, some lack an id or a subject."""
    c, p = F.col, F.col("o_orderpriority")
    key, value = c("o_orderkey").cast("string"), c("o_totalprice").cast("decimal(18,2)")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    agency = F.struct(c("o_custkey").cast("string").alias("cnpj"), F.concat(F.lit("Órgão "), c("o_custkey").cast("string")).alias("razaoSocial"))
    new = records.packed({"numeroControlePNCP": F.when(c("o_orderstatus") != "P", key), "id": F.when(c("o_orderstatus") == "P", key), "orgaoEntidade": agency, "objetoCompra": F.concat(F.lit("Obra "), key), "valorTotalEstimado": value, "dataPublicacaoPncp": F.concat(day, F.lit("T10:00:00")), "codigoModalidade": F.month("o_orderdate"), "uf": F.lit("")})
    old = records.packed({"id": key, "orgaoCNPJ": c("o_custkey").cast("string"), "objeto": F.when(c("o_orderstatus") != "F", "Serviço"), "valorEstimado": F.lit("R$ 1.234,50"), "dataPublicacao": day, "uf": F.lit("PR")})
    gazette = records.packed({"id": F.when(c("o_orderstatus") != "P", key), "titulo": F.when(c("o_orderstatus") != "F", "Extrato"), "entidade": F.lit("Prefeitura"), "data_publicacao": F.date_format("o_orderdate", "dd/MM/yyyy"), "url_web": F.concat(F.lit("http://x/"), key)})
    generic = records.packed({"identificador": key, "descricao": F.lit("Compra"), "valor": value, "cidade": F.lit("Lages"), "data_abertura": day})
    raw = F.when(p == "1-URGENT", new).when(p == "2-HIGH", gazette).when(p == "3-MEDIUM", generic).when(p == "4-NOT SPECIFIED", old).otherwise(F.when(c("o_orderstatus") == "F", "{broken").when(c("o_orderstatus") == "O", "[1, 2]"))
    return Tables(spark, d).orders.select(key.cast("long").alias("id"), F.expr(_SOURCE).alias("source"), raw.alias("raw"))


@query("versioned_records", f"""WITH o AS (SELECT o_orderkey AS id, {_SOURCE} AS source, o_orderpriority AS p, o_orderstatus AS s, o_custkey AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS v, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT id, source, CASE WHEN p = '5-LOW' THEN 'malformed' WHEN p = '2-HIGH' AND s = 'P' THEN 'no_id' WHEN p = '4-NOT SPECIFIED' AND s = 'F' THEN 'no_subject' END AS reason,
 CASE WHEN p = '5-LOW' OR (p = '2-HIGH' AND s = 'P') THEN NULL ELSE CAST(id AS VARCHAR) END AS source_id, CASE WHEN p IN ('1-URGENT', '4-NOT SPECIFIED') THEN CAST(k AS VARCHAR) END AS orgao_cnpj,
 CASE p WHEN '1-URGENT' THEN 'Órgão ' || k WHEN '2-HIGH' THEN 'Prefeitura' END AS orgao_nome, CASE p WHEN '1-URGENT' THEN 'Obra ' || id WHEN '2-HIGH' THEN CASE WHEN s <> 'F' THEN 'Extrato' ELSE 'Publicação DOM-SC' END WHEN '3-MEDIUM' THEN 'Compra' WHEN '4-NOT SPECIFIED' THEN CASE WHEN s <> 'F' THEN 'Serviço' END END AS objeto,
 CASE WHEN p = '4-NOT SPECIFIED' THEN 'PR' WHEN p <> '5-LOW' THEN 'SC' END AS uf, CASE WHEN p = '3-MEDIUM' THEN 'Lages' END AS municipio, CASE WHEN p IN ('1-URGENT', '3-MEDIUM') THEN v WHEN p = '4-NOT SPECIFIED' THEN 1234.5 END AS valor, CASE WHEN p IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED') THEN day END AS publicado,
 CASE WHEN p = '3-MEDIUM' THEN day END AS aberto, CASE WHEN p = '1-URGENT' THEN CAST(month(day) AS INTEGER) END AS modalidade_id, CASE WHEN p = '2-HIGH' THEN 'http://x/' || id END AS link FROM o""")
def versioned_records(spark: SparkSession, d: str) -> DataFrame:
    r = records.normalized(_raw(spark, d), "source", "raw")
    return r.select("id", "source", "reason", *[F.col(f"record.{f}").alias(f) for f in ("source_id", "orgao_cnpj", "orgao_nome", "objeto", "uf", "municipio", "valor", "publicado", "aberto", "modalidade_id", "link")])


@query("json_history", """SELECT user_id AS id, count(*) + 1 AS n, max(value) AS most, arg_min(event_type, event_id) AS first_kind FROM events GROUP BY 1""")
def json_history(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as a JSON array, one entry appended, and read back element by element."""
    kind = "struct<at: bigint, kind: string, value: double>"
    entry = F.struct(F.col("event_id").alias("at"), F.col("event_type").alias("kind"), F.col("value").cast("double").alias("value"))
    held = Tables(spark, d).events.groupBy(F.col("user_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("history"))
    more = F.struct(F.lit(1 << 40).cast("long").alias("at"), F.lit("end").alias("kind"), F.lit(None).cast("double").alias("value"))
    rows = files.json_rows(held.select("id", records.appended(F.col("history"), more, kind).alias("history")), "history", kind)
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("item.value").alias("most"), F.min_by("item.kind", "item.at").alias("first_kind"))


@query("landing_files", """WITH x AS (SELECT o_orderpriority AS priority, count(*) AS n, min(o_orderkey) AS least FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT priority, n, least, true AS same FROM x""")
def landing_files(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines land in turn, the newest file is read, a report of it is written and read back with the same fingerprint."""
    home, o = shared_folder(spark, "landing"), Tables(spark, d).orders
    schema = "o_orderkey long, o_orderpriority string"
    for status in ("P", "F"):
        o.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderpriority").coalesce(1).write.mode("append").json(f"{home}/in")
    newest = files.newest_files(spark, f"{home}/in", schema)
    report = newest.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"))
    files.write_report(report, f"{home}/report")
    back = spark.read.option("header", True).schema("priority string, n long, least long").csv(f"{home}/report")
    same = files.fingerprint(report).first() == files.fingerprint(back).first() and files.json_lines(spark, f"{home}/in", schema).count() == o.where("o_orderstatus in ('P', 'F')").count()
    out = spark.createDataFrame([(*r, same) for r in back.collect()], "priority string, n long, least long, same boolean")  # a report is for people, so it is small
    remove(spark, home)
    return out
