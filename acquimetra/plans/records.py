"""Text keys, search, identity resolution and keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acquimetra.catalog import query
from acquimetra.functions import hashing, parse, text
from acquimetra.functions.geo import haversine_km
from acquimetra.functions.vector import dot
from acquimetra.operators import matching as X
from acquimetra.operators import merge as M
from acquimetra.operators import nearby
from acquimetra.operators import relational as R
from acquimetra.operators import search as S
from acquimetra.sources.canonical import MONEY
from acquimetra.sources.tables import Tables

_FOLD = f"replace(translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}'), 'ß', 'ss')"
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOKENS = f"list_distinct(list_filter(string_split(trim(regexp_replace({_FOLD}, '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})))"


@query("normalize_text", f"""SELECT doc_id, md5({_FOLD}) AS folded_md5, substr(regexp_replace(regexp_replace({_FOLD}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 40) AS slug, CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END AS short FROM documents""")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return Tables(spark, d).documents.select("doc_id", F.md5(text.fold(t)).alias("folded_md5"), F.substring(text.slug(t), 1, 40).alias("slug"), text.shorten(t, 30).alias("short"))


@query("tokenize_stats", f"""WITH x AS (SELECT doc_id, lang, {_TOKENS} AS t FROM documents) SELECT lang, count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS n_tokens, CAST(max(len(t)) AS INTEGER) AS most FROM x GROUP BY 1""")
def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    x = Tables(spark, d).documents.select("lang", F.size(text.tokens(F.col("text"))).alias("k"))
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("n_tokens"), F.max("k").alias("most"))


@query("frequent_keywords", f"""WITH x AS (SELECT lang, unnest({_TOKENS}) AS w FROM documents), g AS (SELECT lang, w, count(*) AS n FROM x GROUP BY 1, 2 HAVING count(*) >= 2) SELECT lang, w AS word, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS INTEGER) AS rank FROM g QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= 50""")
def frequent_keywords(spark: SparkSession, d: str) -> DataFrame:
    g = Tables(spark, d).documents.select("lang", F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return R.top_n(g, ["lang"], [F.desc("n"), "word"], 50).select("lang", "word", "n", "rank")


@query("content_hash", """SELECT doc_id, md5(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || coalesce(text, '')) AS key_md5, sha256(lower(trim(coalesce(source, ''))) || '|' || lower(trim(coalesce(text, ''))) || '|' || coalesce(CAST(n_chars AS VARCHAR), '')) AS key_sha256 FROM documents""")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return Tables(spark, d).documents.select("doc_id", hashing.content_md5(c("source"), c("lang"), c("text")).alias("key_md5"), hashing.content_sha256(c("source"), c("text"), c("n_chars")).alias("key_sha256"))


@query("cross_source_dedup_groups", f"""WITH x AS (SELECT doc_id, source, md5(trim(regexp_replace({_FOLD}, '[^a-z0-9]+', ' ', 'g'))) AS h FROM documents), g AS (SELECT h, min(doc_id) AS canonical, count(*) AS n, count(DISTINCT source) AS n_sources FROM x GROUP BY h HAVING count(DISTINCT source) >= 2) SELECT doc_id, canonical, n, n_sources, doc_id <> canonical AS duplicate FROM x JOIN g USING (h)""")
def cross_source_dedup_groups(spark: SparkSession, d: str) -> DataFrame:
    x = Tables(spark, d).documents.select("doc_id", "source", F.md5(F.trim(F.regexp_replace(text.fold(F.col("text")), "[^a-z0-9]+", " "))).alias("h"))
    g = x.groupBy("h").agg(F.min("doc_id").alias("canonical"), F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources")).where("n_sources >= 2")
    return x.join(g, "h").select("doc_id", "canonical", "n", "n_sources", (F.col("doc_id") != F.col("canonical")).alias("duplicate"))


@query("near_dup_jaccard", f"""WITH x AS (SELECT doc_id, lang, {_TOKENS} AS t FROM documents), p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS na, len(b.t) AS nb FROM x a JOIN x b ON a.lang = b.lang AND a.doc_id < b.doc_id AND least(len(a.t), len(b.t)) >= greatest(len(a.t), len(b.t)) * 0.75 AND len(a.t) > 0 AND len(b.t) > 0)
SELECT a, b, CAST(i AS DOUBLE) / CAST(na + nb - i AS DOUBLE) AS similarity, CASE WHEN CAST(i AS DOUBLE) / CAST(na + nb - i AS DOUBLE) >= 0.85 THEN 'remove' ELSE 'warn' END AS verdict FROM p WHERE CAST(i AS DOUBLE) / CAST(na + nb - i AS DOUBLE) >= 0.75""")
def near_dup_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return X.similar_pairs(Tables(spark, d).documents, "doc_id", "text", ["lang"])


@query("identifier_extraction", """SELECT page_id, nullif(regexp_extract(url, '([0-9]{3,6})', 1), '') AS number, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, len(regexp_extract_all(html, '<a href')) AS n_links FROM pages""")
def identifier_extraction(spark: SparkSession, d: str) -> DataFrame:
    got = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return Tables(spark, d).pages.select("page_id", got("url", "([0-9]{3,6})").alias("number"), got("html", "<title>([^<]*)</title>").alias("title"), F.regexp_count("html", F.lit("<a href")).cast("long").alias("n_links"))


_SAMPLES = [("R$ 1.234,56", "05/02/2026", "pregao 001/2026"), ("1234.5", "2026-02-05T10:00:00Z", "1-2026"), ("", "32/13/2026", "none"), ("12,5", "published 2026-01-31", "edital 12.2025"), ("abc", "", "CNPJ 12.345.678/0001-95"), ("-7", "2026-02-30", "x 12345678000195 y")]


@query("parse_numbers_dates", f"""WITH v(i, n, dt, s) AS (VALUES {', '.join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(_SAMPLES))}), x AS (SELECT *, regexp_replace(n, '[^0-9,.-]', '', 'g') AS k FROM v)
SELECT i, TRY_CAST(nullif(CASE WHEN contains(k, ',') THEN replace(replace(k, '.', ''), ',', '.') ELSE k END, '') AS DOUBLE) AS number, coalesce(TRY_CAST(nullif(regexp_extract(dt, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') AS DATE), TRY_CAST(nullif(regexp_extract(dt, '([0-9]{{2}})/([0-9]{{2}})/([0-9]{{4}})', 3) || '-' || regexp_extract(dt, '([0-9]{{2}})/([0-9]{{2}})/([0-9]{{4}})', 2) || '-' || regexp_extract(dt, '([0-9]{{2}})/([0-9]{{2}})/([0-9]{{4}})', 1), '--') AS DATE)) AS day,
CASE WHEN regexp_matches(s, '[0-9]{{1,6}}[/.-][0-9]{{4}}') THEN coalesce(nullif(regexp_replace(regexp_extract(s, '([0-9]{{1,6}})[/.-]([0-9]{{4}})', 1), '^0+', ''), ''), '0') || '/' || regexp_extract(s, '([0-9]{{1,6}})[/.-]([0-9]{{4}})', 2) END AS notice,
coalesce(nullif(regexp_replace(regexp_extract(s, '([0-9]{{2}}\\.[0-9]{{3}}\\.[0-9]{{3}}/[0-9]{{4}}-[0-9]{{2}})', 1), '[^0-9]', '', 'g'), ''), nullif(regexp_extract(s, '(?:^|[^0-9])([0-9]{{14}})(?:[^0-9]|$)', 1), '')) AS tax_id FROM x""")
def parse_numbers_dates(spark: SparkSession, d: str) -> DataFrame:
    v = spark.createDataFrame([(i, *s) for i, s in enumerate(_SAMPLES)], "i int, n string, dt string, s string")
    return v.select("i", parse.brazilian_number(F.col("n")).alias("number"), parse.any_date(F.col("dt")).alias("day"), text.canonical_number(F.col("s")).alias("notice"), text.extract_tax_id(F.col("s")).alias("tax_id"))


_PLACES = "SELECT c_custkey AS id, -33.0 + (c_custkey * 37 % 1000) / 100.0 AS lat, -54.0 + (c_custkey * 61 % 1000) / 100.0 AS lon FROM customer"


def _places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return Tables(spark, d).customer.select(k.alias("id"), (F.lit(-33.0) + (k * 37 % 1000) / 100.0).alias("lat"), (F.lit(-54.0) + (k * 61 % 1000) / 100.0).alias("lon"), F.col("c_acctbal").alias("value"), F.col("c_nationkey").alias("region"))


@query("haversine_radius", f"""WITH p AS ({_PLACES}), k AS (SELECT id, 2 * 6371.0 * asin(least(1.0, sqrt(power(sin(radians(lat - -27.6) / 2), 2) + cos(radians(-27.6)) * cos(radians(lat)) * power(sin(radians(lon - -48.5) / 2), 2)))) AS km FROM p) SELECT id, CAST(round(CAST(km AS DECIMAL(18,6)), 3) AS DECIMAL(18,3)) AS km FROM k WHERE km <= 200""")
def haversine_radius(spark: SparkSession, d: str) -> DataFrame:
    return X.within_radius(_places(spark, d), "lat", "lon", -27.6, -48.5, 200.0).select("id", F.round(F.col("km").cast("decimal(18,6)"), 3).cast("decimal(18,3)").alias("km"))


@query("vector_similarity_topk", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), x AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS s FROM embeddings, q WHERE vec_id <> 7) SELECT vec_id, CAST(s AS DECIMAL(18,6)) AS similarity FROM x ORDER BY s DESC, vec_id LIMIT 20""")
def vector_similarity_topk(spark: SparkSession, d: str) -> DataFrame:
    e = Tables(spark, d).embeddings
    q = e.where("vec_id = 7").select(F.col("embedding").alias("q"))
    x = e.where("vec_id <> 7").crossJoin(F.broadcast(q)).withColumn("s", dot(F.col("embedding"), F.col("q")))  # one query row
    return x.orderBy(F.desc("s"), "vec_id").limit(20).select("vec_id", F.col("s").cast("decimal(18,6)").alias("similarity"))


@query("json_props_explode", """WITH x AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_type, count(k) AS n, min(k) AS low, max(k) AS high, CAST(sum(k) AS BIGINT) AS total FROM x GROUP BY 1""")
def json_props_explode(spark: SparkSession, d: str) -> DataFrame:
    x = Tables(spark, d).events.select("event_type", F.from_json("props", "k int").alias("p"))
    return x.groupBy("event_type").agg(F.count("p.k").alias("n"), F.min("p.k").alias("low"), F.max("p.k").alias("high"), F.sum("p.k").alias("total"))


@query("keyword_search_ranked", f"""WITH x AS (SELECT doc_id, ' ' || regexp_replace({_FOLD}, '[^a-z0-9]+', '  ', 'g') || ' ' AS t FROM documents WHERE lang IN ('en', 'fr') AND n_chars >= 200), r AS (SELECT doc_id, CAST((length(t) - length(replace(t, ' the ', ''))) / 5 AS INTEGER) + CAST((length(t) - length(replace(t, ' with ', ''))) / 6 AS INTEGER) AS rank FROM x) SELECT doc_id, rank FROM r WHERE rank > 0 ORDER BY rank DESC, doc_id LIMIT 25 OFFSET 5""")
def keyword_search_ranked(spark: SparkSession, d: str) -> DataFrame:
    docs = Tables(spark, d).documents
    return S.search(docs, "text", "doc_id", ["the", "with"], {"lang": ["en", "fr"]}, {"n_chars": 200}, limit=25, offset=5).select("doc_id", "rank")


@query("trigram_search", """WITH q AS (SELECT list_distinct(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS g FROM (SELECT '  red widgt ' AS x)), p AS (SELECT p_partkey, p_name, '  ' || lower(p_name) || ' ' AS x FROM part), t AS (SELECT p_partkey, p_name, list_distinct(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS g FROM p),
s AS (SELECT p_partkey, p_name, CAST(len(list_intersect(t.g, q.g)) AS DOUBLE) / CAST(len(list_distinct(list_concat(t.g, q.g))) AS DOUBLE) AS similarity FROM t, q) SELECT * FROM s WHERE similarity >= 0.3 ORDER BY similarity DESC, p_partkey LIMIT 20""")
def trigram_search(spark: SparkSession, d: str) -> DataFrame:
    return S.trigram_search(Tables(spark, d).part.select("p_partkey", "p_name"), "p_name", "p_partkey", "red widgt")


@query("keyword_filters", """SELECT p_partkey, p_name ILIKE '%red%' AND p_name ILIKE '%gear%' AS has_all, p_name ILIKE '%red%' OR p_name ILIKE '%gear%' AS has_any, regexp_matches(lower(p_name), '(bolt|ring)') AS by_pattern FROM part""")
def keyword_filters(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return Tables(spark, d).part.select("p_partkey", S.all_keywords(n, ["red", "gear"]).alias("has_all"), S.any_keyword(n, ["red", "gear"]).alias("has_any"), n.rlike("(?i)(bolt|ring)").alias("by_pattern"))


# The left side of identity resolution: customers as a portal might spell them.
_LEFT = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) END AS root, CASE WHEN c_custkey % 3 = 1 THEN c_name WHEN c_custkey % 3 = 2 AND c_custkey % 2 = 0 THEN upper(c_name) ELSE 'unknown' END AS name, c_nationkey AS town FROM customer"


def _left(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_name")
    name = F.when(k % 3 == 1, n).when((k % 3 == 2) & (k % 2 == 0), F.upper(n)).otherwise("unknown")
    return Tables(spark, d).customer.select(k.alias("id"), F.when(k % 3 == 0, k.cast("string")).alias("root"), name.alias("name"), F.col("c_nationkey").alias("town"))


@query("cascade_match", f"""WITH l AS ({_LEFT}), r AS (SELECT c_custkey AS entity, c_name, c_nationkey FROM customer WHERE c_custkey % 5 <> 0), m AS (SELECT l.id, coalesce(a.entity, b.entity, c.entity) AS entity, CASE WHEN a.entity IS NOT NULL THEN 'root' WHEN b.entity IS NOT NULL THEN 'name_town' WHEN c.entity IS NOT NULL THEN 'name_upper' ELSE 'none' END AS match_method
FROM l LEFT JOIN r a ON l.root = CAST(a.entity AS VARCHAR) LEFT JOIN r b ON l.name = b.c_name AND l.town = b.c_nationkey LEFT JOIN r c ON l.name = upper(c.c_name)) SELECT id, entity, match_method, CAST(CASE match_method WHEN 'root' THEN 1.0 WHEN 'name_town' THEN 0.95 WHEN 'name_upper' THEN 0.9 ELSE 0 END AS DOUBLE) AS match_score FROM m""")
def cascade_match(spark: SparkSession, d: str) -> DataFrame:
    r = Tables(spark, d).customer.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("entity"), "c_name", "c_nationkey")
    levels = [
        ("root", 1.0, F.col("root"), F.col("entity").cast("string")),
        ("name_town", 0.95, F.concat_ws("|", "name", "town"), F.concat_ws("|", "c_name", "c_nationkey")),
        ("name_upper", 0.9, F.col("name"), F.upper("c_name")),
    ]
    return X.cascade(_left(spark, d), r, "id", "entity", levels)


@query("priority_rule_reconcile", """WITH l AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS number, o_custkey, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS value FROM orders), r AS (SELECT o_orderkey AS act, o_custkey, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS value FROM orders WHERE o_orderstatus <> 'P'),
m AS (SELECT id, act, 0 AS rank, 'number' AS rule FROM l JOIN r ON number = act UNION ALL SELECT id, act, 1, 'buyer_day' FROM l JOIN r ON l.o_custkey = r.o_custkey AND l.day = r.day UNION ALL SELECT id, act, 2, 'buyer' FROM l JOIN r ON l.o_custkey = r.o_custkey), g AS (SELECT id, rank, rule, count(DISTINCT act) AS candidates, min(act) AS act FROM m GROUP BY 1, 2, 3), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank) = 1)
SELECT l.id, b.rule, b.act, coalesce(b.candidates, 0) AS candidates, CASE WHEN b.id IS NULL THEN 'unmatched' WHEN b.candidates = 1 THEN 'matched' ELSE 'review' END AS decision FROM l LEFT JOIN b ON l.id = b.id""")
def priority_rule_reconcile(spark: SparkSession, d: str) -> DataFrame:
    o = Tables(spark, d).orders.select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus")
    left, right = o.drop("o_orderstatus"), o.where("o_orderstatus <> 'P'").drop("o_orderstatus").withColumnRenamed("id", "act")
    day = F.concat_ws("|", "o_custkey", "day")
    rules = [("number", F.when(F.col("id") % 4 == 0, F.col("id")), F.col("act")), ("buyer_day", day, day), ("buyer", F.col("o_custkey"), F.col("o_custkey"))]
    return X.reconcile(left, right, "id", "act", rules)


@query("universe_resolution", f"""WITH l AS ({_LEFT}), u AS (SELECT c_custkey AS entity_id, CAST(c_custkey AS VARCHAR) AS root, CASE WHEN c_custkey % 10 = 4 THEN 'twin' ELSE c_name END AS name, c_nationkey AS town FROM customer), r AS (SELECT root, min(entity_id) AS i, count(DISTINCT entity_id) AS n FROM u GROUP BY 1), nt AS (SELECT name, town, min(entity_id) AS i, count(DISTINCT entity_id) AS n FROM u GROUP BY 1, 2), nn AS (SELECT name, min(entity_id) AS i, count(DISTINCT entity_id) AS n FROM u GROUP BY 1)
SELECT l.id AS row_id, CASE WHEN r.n = 1 THEN r.i WHEN nt.n = 1 THEN nt.i WHEN nn.n = 1 THEN nn.i END AS entity_id, CASE WHEN r.n = 1 THEN 'root' WHEN nt.n = 1 THEN 'name_town' WHEN nn.n = 1 THEN 'name' WHEN r.n > 1 OR nt.n > 1 OR nn.n > 1 THEN 'ambiguous' ELSE 'unknown' END AS method
FROM (SELECT id, root, CASE WHEN id % 10 = 7 THEN 'twin' ELSE name END AS name, CASE WHEN id % 2 = 0 THEN town ELSE -1 END AS town FROM l) l LEFT JOIN r ON l.root = r.root LEFT JOIN nt ON l.name = nt.name AND l.town = nt.town LEFT JOIN nn ON l.name = nn.name""")
def universe_resolution(spark: SparkSession, d: str) -> DataFrame:
    left = _left(spark, d).select(F.col("id").alias("row_id"), "root", F.when(F.col("id") % 10 == 7, "twin").otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 2 == 0, F.col("town")).otherwise(-1).alias("town"))
    k = F.col("c_custkey")
    u = Tables(spark, d).customer.select(k.alias("entity_id"), k.cast("string").alias("root"), F.when(k % 10 == 4, "twin").otherwise(F.col("c_name")).alias("name"), F.col("c_nationkey").alias("town"))
    return X.resolve_universe(left, u).select("row_id", "entity_id", "method")


_OLD = "SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS value, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 3 <> 0"
_NEW = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, CAST(CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) * 2 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS value, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders WHERE o_orderkey % 4 <> 0"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = Tables(spark, d).orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast(MONEY).alias("value"), F.col("o_orderdate").cast("date").alias("day"))
    new = o.where("id % 4 <> 0").withColumns({"status": F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("status")), "value": F.when(F.col("id") % 11 == 0, F.col("value") * 2).otherwise(F.col("value")).cast(MONEY), "day": F.when(F.col("id") % 5 != 0, F.col("day"))})
    return o.where("id % 3 <> 0"), new


@query("upsert_change_detect", f"""WITH o AS (SELECT *, md5(status || '|' || CAST(value AS VARCHAR)) AS h FROM ({_OLD})), n AS (SELECT *, md5(status || '|' || CAST(value AS VARCHAR)) AS h FROM ({_NEW}))
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL AND o.h IS DISTINCT FROM n.h THEN n.status ELSE o.status END AS status, CASE WHEN n.id IS NOT NULL AND o.h IS DISTINCT FROM n.h THEN n.value ELSE o.value END AS value, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'keep' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'unchanged' ELSE 'update' END AS action FROM o FULL JOIN n ON o.id = n.id""")
def upsert_change_detect(spark: SparkSession, d: str) -> DataFrame:
    h = F.md5(F.concat_ws("|", F.col("status"), F.col("value").cast("string")))
    old, new = (x.withColumn("h", h) for x in _snapshots(spark, d))
    return M.upsert_changed(old, new, ["id"], "h").select("id", "status", "value", "action")


@query("upsert_first_write_wins", f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.status ELSE n.status END AS status, CASE WHEN o.id IS NOT NULL THEN o.value ELSE n.value END AS value, coalesce(o.day, n.day) AS day, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n ON o.id = n.id""")
def upsert_first_write_wins(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return M.merged(old, new, ["id"], {"status": "keep_old", "value": "keep_old", "day": "coalesce_old"})


@query("upsert_column_policies", f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.status ELSE o.status END AS status, coalesce(n.value, o.value) AS value, coalesce(n.day, o.day) AS day, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n ON o.id = n.id""")
def upsert_column_policies(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return M.merged(old, new, ["id"], {"status": "overwrite", "value": "coalesce_new", "day": "coalesce_new"})


@query("snapshot_reconcile", """WITH st AS (SELECT 's' || CAST(o_custkey % 4 AS VARCHAR) AS source, o_orderkey AS source_id, o_orderstatus <> 'F' AS source_active FROM orders), seen AS (SELECT DISTINCT 's' || CAST(o_custkey % 4 AS VARCHAR) AS source, o_orderkey AS source_id FROM orders WHERE o_orderkey % 3 <> 0), x AS (SELECT st.*, st.source IN ('s0', 's2') AS covered, seen.source_id IS NOT NULL AND st.source IN ('s0', 's2') AS hit FROM st LEFT JOIN seen USING (source, source_id)),
y AS (SELECT source, source_id, source_active, CASE WHEN NOT covered THEN 'skip' WHEN hit AND NOT source_active THEN 'reactivate' WHEN hit THEN 'touch' WHEN source_active THEN 'inactivate' ELSE 'still_absent' END AS action FROM x)
SELECT *, CASE WHEN action IN ('reactivate', 'touch') THEN true WHEN action IN ('inactivate', 'still_absent') THEN false ELSE source_active END AS now_active FROM y""")
def snapshot_reconcile(spark: SparkSession, d: str) -> DataFrame:
    o = Tables(spark, d).orders.select(F.concat(F.lit("s"), (F.col("o_custkey") % 4).cast("string")).alias("source"), F.col("o_orderkey").alias("source_id"), (F.col("o_orderstatus") != "F").alias("source_active"))
    runs = spark.createDataFrame([(0, "s0", "completed", True, False), (1, "s1", "failed", True, False), (2, "s2", "completed_zero", True, None), (3, "s3", "completed", True, True)], "run_id int, source string, status string, scope_complete boolean, limited boolean")
    seen = o.where("source_id % 3 <> 0").select(F.substring("source", 2, 1).cast("int").alias("run_id"), "source_id")
    return M.reconcile_snapshot(o, runs, seen)


@query("run_diff_changed_fields", f"""WITH o AS ({_OLD}), n AS ({_NEW}), x AS (SELECT n.id, list_filter([CASE WHEN o.status IS DISTINCT FROM n.status THEN 'status' END, CASE WHEN o.value IS DISTINCT FROM n.value THEN 'value' END, CASE WHEN o.day IS DISTINCT FROM n.day THEN 'day' END], lambda f: f IS NOT NULL) AS f FROM o JOIN n ON o.id = n.id)
SELECT id, array_to_string(f, ',') AS changed, CAST(len(f) AS INTEGER) AS n_changed FROM x WHERE len(f) > 0""")
def run_diff_changed_fields(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return M.changed_fields(old, new, ["id"], ["id", "value"], ["status", "value", "day"])


@query("delta_status", f"""WITH o AS (SELECT id, value, CAST(day + 20 AS DATE) AS due FROM ({_OLD})), n AS (SELECT id, value, CAST(day + 20 AS DATE) AS due FROM ({_NEW})), x AS (SELECT n.*, o.id IS NULL AS fresh, date_diff('day', DATE '1999-06-01', n.due) AS now_days, date_diff('day', DATE '1999-05-20', o.due) AS then_days, abs(CAST(n.value AS DOUBLE) - CAST(o.value AS DOUBLE)) / abs(CAST(o.value AS DOUBLE)) AS moved FROM n LEFT JOIN o ON n.id = o.id)
SELECT id, CASE WHEN fresh THEN 'NOVO' WHEN now_days <= 3 AND then_days > 3 THEN 'VENCENDO' WHEN moved > 0.05 THEN 'ATUALIZADO' ELSE 'INALTERADO' END AS delta FROM x""")
def delta_status(spark: SparkSession, d: str) -> DataFrame:
    old, new = (x.withColumn("due", F.date_add("day", 20)) for x in _snapshots(spark, d))
    day = lambda s: F.lit(s).cast("date")
    return M.delta(old, new, "id", "value", "due", day("1999-05-20"), day("1999-06-01")).select("id", "delta")


@query("scd_versions", """SELECT user_id, event_id, ts AS valid_from, CAST(row_number() OVER w AS INTEGER) AS version, lead(ts) OVER w AS valid_to, lead(ts) OVER w IS NULL AS is_current FROM events WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def scd_versions(spark: SparkSession, d: str) -> DataFrame:
    e = Tables(spark, d).events.where("event_type = 'signup'").select("user_id", "event_id", F.col("ts").alias("valid_from"))
    return R.versions(e, ["user_id"], ["valid_from", "event_id"], "valid_from")


@query("retention_dry_run", """SELECT o_orderstatus AS status, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') > 1800 THEN 'hard_delete' WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') > 900 THEN 'soft_delete' ELSE 'keep' END AS purge, count(*) AS n FROM orders GROUP BY 1, 2""")
def retention_dry_run(spark: SparkSession, d: str) -> DataFrame:
    o = Tables(spark, d).orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("day"))
    return M.retention(o, "day", F.lit("2001-08-01").cast("date"), 900, 1800).groupBy("status", "purge").agg(F.count(F.lit(1)).alias("n"))


@query("fuzzy_match_levenshtein", """WITH l AS (SELECT p_partkey AS id, p_brand, replace(p_name, 'e', '') AS name FROM part WHERE p_partkey % 20 = 0), r AS (SELECT DISTINCT p_brand, p_name FROM part), x AS (SELECT id, p_name, levenshtein(name, p_name) AS k FROM l JOIN r USING (p_brand)) SELECT id, p_name AS best, CAST(k AS INTEGER) AS distance FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, p_name) = 1""")
def fuzzy_match_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    p = Tables(spark, d).part
    left = p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id"), "p_brand", F.replace("p_name", F.lit("e"), F.lit("")).alias("name"))
    x = left.join(p.select("p_brand", "p_name").distinct(), "p_brand").withColumn("k", F.levenshtein("name", "p_name"))
    return x.groupBy("id").agg(F.min(F.struct("k", "p_name")).alias("m")).select("id", F.col("m.p_name").alias("best"), F.col("m.k").alias("distance"))


@query("fuzzy_match")
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    p = Tables(spark, d).part
    left = p.select(F.col("p_partkey").alias("id"), "p_brand", F.replace("p_name", F.lit("e"), F.lit("")).alias("name"))
    right = p.groupBy("p_brand", F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity"))
    return X.fuzzy_best(left, right, "id", "entity", "name", "p_brand", 0.75)


@query("regional_clusters")
def regional_clusters(spark: SparkSession, d: str) -> DataFrame:
    return nearby.clusters(_places(spark, d), "id", "lat", "lon", "value", "region")


@query("greedy_dedup")
def greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    return X.greedy_keep(Tables(spark, d).documents.select("doc_id", "text", "lang", "source"), "doc_id", "text", ["lang", "source"])


@query("nearest_place", f"""WITH p AS ({_PLACES}) SELECT id, CAST(round(CAST(2 * 6371.0 * asin(least(1.0, sqrt(power(sin(radians(-27.6 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(-27.6)) * power(sin(radians(-48.5 - lon) / 2), 2)))) AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS km, lat BETWEEN -29.4 AND -25.9 AND lon BETWEEN -53.9 AND -48.3 AS inside FROM p""")
def nearest_place(spark: SparkSession, d: str) -> DataFrame:
    from acquimetra.functions.geo import in_box

    p = _places(spark, d)
    km = haversine_km(F.col("lat"), F.col("lon"), F.lit(-27.6), F.lit(-48.5))
    return p.select("id", F.round(km.cast("decimal(18,6)"), 2).cast(MONEY).alias("km"), in_box(F.col("lat"), F.col("lon"), -29.4, -53.9, -25.9, -48.3).alias("inside"))
