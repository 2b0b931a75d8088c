"""What has changed since the last cycle, and lists that somebody has to work on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Events that are news of their own, hours after which finished runs are old and running ones stuck, days of the window in which contracts end.
EVENTS = ("RETIFICACAO", "SUSPENSAO", "REVOGACAO", "REABERTURA", "ALTERACAO_PRAZO")
STALE_HOURS, STUCK_HOURS, WINDOW = 24, 2, (90, 180)
FAILED = ("failed", "error", "partial")


def new_rows(current: DataFrame, previous: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key the last cycle did not know; rows without a key are none."""
    return current.where(F.col(key).isNotNull()).join(previous.select(key).distinct(), key, "left_anti")


def status_changes(current: DataFrame, previous: DataFrame, events: Sequence[str] = EVENTS) -> DataFrame:
    """(id, event, from_status, to_status): rows that name an event, and rows whose status is another than in the last cycle, whatever its case.

    current: (id, status, event); previous: (id, status), of several rows of an id the greatest counts. An empty new status is no change.
    """
    was = previous.groupBy(F.col("id").alias("_id")).agg(F.max(F.coalesce("status", F.lit(""))).alias("_was"))
    now, event = F.upper(F.coalesce("status", F.lit(""))), F.upper(F.coalesce("event", F.lit("")))
    x = current.where("id is not null").join(was, F.col("id") == F.col("_id"), "left").select("id", F.col("_was").alias("from_status"), now.alias("to_status"), event.alias("e"))
    moved = F.col("from_status").isNotNull() & (F.col("to_status") != "") & (F.col("to_status") != F.upper("from_status"))
    named = F.col("e").isin(*events)
    return x.where(named | moved).select("id", F.when(named, F.col("e")).otherwise("STATUS_CHANGE").alias("event"), "from_status", "to_status")


def ending(contracts: DataFrame, ends: str, as_of: Column, days: tuple[int, int] = WINDOW) -> DataFrame:
    """Contracts that end within the window, with the days that are left."""
    left = F.datediff(F.col(ends), as_of)
    return contracts.withColumn("days_left", left).where(F.col("days_left").between(*days))


def panorama(notices: DataFrame, contracts: DataFrame) -> DataFrame:
    """(part, name, n): how often an agency stands in notices and contracts (a blank one is UNKNOWN), and a supplier in contracts.

    notices: (agency); contracts: (agency, supplier).
    """
    named = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("UNKNOWN"))
    agencies = notices.select(named("agency").alias("name")).union(contracts.select(named("agency")))
    suppliers = contracts.select(F.trim(F.col("supplier").cast("string")).alias("name")).where("name is not null and name <> ''")
    both = agencies.select(F.lit("agency").alias("part"), "name").union(suppliers.select(F.lit("supplier"), "name"))
    return both.groupBy("part", "name").agg(F.count(F.lit(1)).alias("n"))


def metrics(**tables: DataFrame) -> DataFrame:
    """(metric, value): the rows of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
        out = one if out is None else out.union(one)
    return out


def variation(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(metric, previous, current, delta, delta_pct) of metrics of two cycles; no percentage of nothing."""
    c, p = current.select("metric", F.col("value").alias("current")), previous.select("metric", F.col("value").alias("previous"))
    x = c.join(p, "metric", "full_outer")
    delta = F.col("current") - F.col("previous")
    return x.select("metric", "previous", "current", delta.alias("delta"), F.when(F.col("previous") != 0, F.round(delta * 100.0 / F.col("previous"), 2)).alias("delta_pct"))


def uncovered(entities: DataFrame, covering: DataFrame, on: dict[str, str], reason: str) -> DataFrame:
    """Entities that no row of ``covering`` meets by any of the column pairs, with the reason."""
    out = entities
    for mine, theirs in on.items():
        out = out.join(covering.select(F.col(theirs).alias("_k")).distinct(), F.col(mine) == F.col("_k"), "left_anti")
    return out.withColumn("gap_reason", F.lit(reason))


def blockers(runs: DataFrame) -> DataFrame:
    """(source, blocker, n, last_started, detail) of runs (source, status, started, error) that failed or say why; detail is the greatest of the first 300 characters."""
    bad = runs.where(F.col("status").isin(*FAILED) | (F.coalesce("error", F.lit("")) != ""))
    g = bad.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"), F.max("started").alias("last_started"), F.max("error").alias("e"))
    return g.select("source", F.concat(F.lit("ingestion_"), "status").alias("blocker"), "n", "last_started", F.left(F.coalesce("e", F.lit("")), F.lit(300)).alias("detail"))


def stale_runs(runs: DataFrame, now: Column, stale: int = STALE_HOURS, stuck: int = STUCK_HOURS) -> DataFrame:
    """(id, source, status, reason): runs that hang, failures that nobody has mended, and sources whose last completed run is old.

    runs: (id, source, status, started, finished).
    """
    hours = lambda at: (F.unix_timestamp(now) - F.unix_timestamp(F.col(at).cast("timestamp"))) / 3600
    hangs = F.when((F.col("status") == "running") & F.col("started").isNotNull(), F.when(hours("started") > stuck, f"stuck_running_gt_{stuck}h"))
    failed = F.when(F.col("finished").isNotNull() & F.col("status").isin(*FAILED) & (hours("finished") > stale), f"failed_stale_gt_{stale}h")
    open_ = F.when((F.col("status") == "running") & F.col("started").isNull() & F.col("finished").isNull(), "running_no_finish")
    each = runs.withColumn("reason", F.coalesce(hangs, failed, open_)).where("reason is not null").select("id", "source", "status", "reason")
    last = runs.where("status = 'completed'").groupBy("source").agg(F.max_by(F.struct("id", "status", F.coalesce("finished", "started").alias("at")), F.struct(F.col("finished").isNotNull(), "finished", "id")).alias("r"))
    old = last.select("r.id", "source", "r.status", F.col("r.at").alias("at")).where(hours("at") > stale).select("id", "source", "status", F.lit(f"latest_completed_older_than_{stale}h").alias("reason"))
    return each.union(old)
