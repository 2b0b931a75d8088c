"""State that batches keep up: coverage of entities, record hashes, dead letters, backfill windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acquimetra.catalog import query
from acquimetra.sources.tables import Tables, checkpointed, remove, shared_folder
from acquimetra.streaming import deadletters, ingest, maintained

_NOTICES = """SELECT o_orderkey AS arrived, CASE WHEN o_orderstatus <> 'P' THEN o_custkey // 4 END AS entity, o_orderpriority AS source, CASE WHEN month(o_orderdate) <> 2 THEN CAST(o_orderdate AS DATE) END AS published,
 CASE WHEN month(o_orderdate) % 4 = 0 THEN 'hierarchical' WHEN month(o_orderdate) % 4 = 1 THEN NULL WHEN month(o_orderdate) % 4 = 2 THEN 'hierarchical' ELSE 'name' END AS method FROM orders"""


@query("maintained_coverage", f"""WITH n AS ({_NOTICES}), k AS (SELECT * FROM n WHERE entity IS NOT NULL),
g AS (SELECT entity, source, count(*) AS total, CASE WHEN count(*) = 1 THEN max(published) ELSE max(coalesce(published, DATE '1970-01-01')) END AS last_seen, arg_min(coalesce(method, 'direct'), arrived) FILTER (WHERE coalesce(method, 'direct') <> 'hierarchical') AS strong FROM k GROUP BY 1, 2)
SELECT entity, source, last_seen, total, coalesce(last_seen >= DATE '2001-06-01' - 90, false) AS covered, coalesce(strong, 'hierarchical') AS method FROM g""")
def maintained_coverage(spark: SparkSession, d: str) -> DataFrame:
    month = F.month("o_orderdate")
    notices = Tables(spark, d).orders.select(
        F.col("o_orderkey").alias("arrived"), F.when(F.col("o_orderstatus") != "P", F.expr("o_custkey div 4")).alias("entity"), F.col("o_orderpriority").alias("source"),
        F.when(month != 2, F.col("o_orderdate").cast("date")).alias("published"), F.when(month % 4 == 3, "name").when(month % 4 != 1, "hierarchical").alias("method"), F.year("o_orderdate").alias("year"),
    ).where("entity is not null")
    home = shared_folder(spark, "coverage")
    kept = maintained.coverage(spark, home)
    years = notices.agg(F.min("year"), F.max("year")).first()
    for i, year in enumerate(range(years[0], years[1] + 1)):
        kept.apply(i, notices.where(F.col("year") == year))
        if i == 2:
            kept.apply(i, notices.where(F.col("year") == year))  # a batch that runs again
            kept.compact(1)
    out = checkpointed(maintained.coverage_of(kept.state(), F.lit("2001-06-01").cast("date")))
    remove(spark, home)
    return out


_HASHES = "SELECT event_id, ts, event_type, user_id, md5(user_id || '|' || event_type || '|' || CAST(floor(value) AS BIGINT)) AS content_hash FROM events"


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    key = F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.floor("value").cast("string")))
    return Tables(spark, d).events.select("event_id", F.col("ts").alias("at"), F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("run_id"), key.alias("content_hash"))


def _batches(rows: DataFrame) -> list[DataFrame]:
    """The rows of three spans of days."""
    day = F.dayofmonth("at")
    return [rows.where(day <= 10), rows.where((day > 10) & (day <= 20)), rows.where(day > 20)]


@query("duplicate_records", f"WITH x AS ({_HASHES}) SELECT event_id, row_number() OVER (PARTITION BY content_hash ORDER BY ts, event_id) > 1 AS duplicate FROM x")
def duplicate_records(spark: SparkSession, d: str) -> DataFrame:
    home, out = shared_folder(spark, "hashes"), None
    kept = maintained.hashes(spark, home)
    for i, rows in enumerate(_batches(_hashed(spark, d))):
        part = checkpointed(maintained.record(kept, i, rows, ["at", "event_id"]).select("event_id", "duplicate"))
        out = part if out is None else out.union(part)
    remove(spark, home)
    return out


@query("hash_state", f"WITH x AS ({_HASHES}) SELECT content_hash, count(*) AS times, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(event_type, ts) AS first_source, CAST(arg_min(user_id, ts) AS VARCHAR) AS first_run FROM x GROUP BY 1")
def hash_state(spark: SparkSession, d: str) -> DataFrame:
    home = shared_folder(spark, "hashes")
    kept = maintained.hashes(spark, home)
    for i, rows in enumerate(_batches(_hashed(spark, d))):
        kept.apply(i, rows)
    state = kept.state().select("content_hash", "times", "first_seen", "last_seen", F.col("first.value.source").alias("first_source"), F.col("first.value.run_id").alias("first_run"))
    out = checkpointed(state)
    remove(spark, home)
    return out


@query("dead_letters", """WITH x AS (SELECT event_type AS source, CAST(event_id AS VARCHAR) AS record, ts, CAST(floor(value) AS INTEGER) % 5 AS need FROM events WHERE value > 20),
e AS (SELECT source, record, CAST(j AS INTEGER) AS pushed, CAST(j + 1 AS INTEGER) AS retry_count, CASE WHEN j < 3 THEN 'replayed' ELSE 'dead' END AS status, ts + to_hours(CAST(j AS INTEGER)) AS failed_at FROM x, range(0, 4) r(j) WHERE j <= need)
SELECT source, record, pushed, retry_count, status, failed_at, CASE retry_count WHEN 1 THEN 300 WHEN 2 THEN 900 ELSE 3600 END AS wait FROM e WHERE NOT (status = 'dead' AND failed_at < TIMESTAMP '2024-04-20 00:00:00' - INTERVAL 90 DAY)""")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Events that are too dear fail as often as their value says; a stream of files pushes and replays them, then the rest is replayed and old dead ones go."""
    home = shared_folder(spark, "dead")
    failed = Tables(spark, d).events.where("value > 20").select(F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("record"), F.col("ts").alias("failed_at"), F.lit("value").alias("error_code"), F.format_string("{\"value\": %s}", F.col("value")).alias("payload"))
    # As many files as the rows need; two micro-batches take half of them each, by several tasks.
    files = max(2, spark.sparkContext.defaultParallelism, failed.rdd.getNumPartitions())
    failed.repartition(files, "record").write.parquet(f"{home}/landing")
    as_of = F.lit("2024-04-20 00:00:00").cast("timestamp")

    def retry(replayed: DataFrame) -> DataFrame:
        again = replayed.where(F.floor(F.get_json_object("payload", "$.value").cast("double")).cast("int") % 5 >= F.col("retry_count"))
        return again.withColumn("failed_at", F.col("failed_at") + F.expr("interval 1 hour"))

    deadletters.drain(spark, f"{home}/landing", failed.schema, f"{home}/letters", f"{home}/checkpoint", retry, lambda _: as_of, files_per_batch=(files + 1) // 2, limit=None)
    letters, step = deadletters.DeadLetters(spark, f"{home}/letters"), 1000
    while letters.state().where("status = 'pending'").limit(1).count():
        letters.push(step + 1, retry(letters.replay(step, as_of, "rest", limit=None)))
        step += 2
    letters.purge(step, as_of)
    out = letters.state().select("source", "record", "pushed", "retry_count", "status", "failed_at", deadletters.backoff_seconds(F.col("retry_count")).alias("wait"))
    out = checkpointed(out)
    remove(spark, home)
    return out


@query("backfill_windows", """WITH b AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM events), w AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS window_start, hi FROM b)
SELECT window_start, least(window_start + 6, hi) AS window_end, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) BETWEEN window_start AND least(window_start + 6, hi)) AS n FROM w""")
def backfill_windows(spark: SparkSession, d: str) -> DataFrame:
    days = Tables(spark, d).events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    lo, hi = days.agg(F.min("day"), F.max("day")).first()
    windows = ingest.backfill_windows(spark, str(lo), str(hi))
    start = F.date_add(F.lit(lo), F.expr(f"7 * (datediff(day, date'{lo}') div 7)").cast("int"))
    per_window = days.groupBy(start.alias("window_start")).agg(F.sum("n").alias("n"))
    return windows.join(per_window, "window_start", "left").select("window_start", "window_end", F.coalesce("n", F.lit(0)).alias("n"))
