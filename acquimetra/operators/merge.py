"""Keyed merges without a transactional table: old and new state in, new state and actions out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import latest


def _both(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    o = old.select(F.lit(True).alias("_o"), *[F.col(c).alias(f"o_{c}") for c in old.columns])
    n = new.select(F.lit(True).alias("_n"), *[F.col(c).alias(f"n_{c}") for c in new.columns])
    on = [F.col(f"o_{k}") == F.col(f"n_{k}") for k in keys]
    return o.join(n, on, "full_outer")


def _policy(name: str, c: str) -> Column:
    o, n = F.col(f"o_{c}"), F.col(f"n_{c}")
    came = F.col("_n").isNotNull()
    return {
        "overwrite": F.when(came, n).otherwise(o), "keep_old": F.when(F.col("_o").isNotNull(), o).otherwise(n), "coalesce_new": F.coalesce(n, o),
        "coalesce_old": F.coalesce(o, n), "max": F.greatest(o, n), "min": F.least(o, n),
    }[name]


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str], policy: dict[str, str], default: str = "overwrite") -> DataFrame:
    """One full outer join; each column by its policy, and ``action``: insert, update (rows in both) or keep."""
    action = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "keep").otherwise("update")
    cols = [F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in keys] + [_policy(policy.get(c, default), c).alias(c) for c in old.columns if c not in keys]
    return _both(old, new, keys).select(*cols, action.alias("action"))


def upsert_changed(old: DataFrame, new: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """Inserts new keys and replaces rows whose content hash differs; equal ones count as unchanged."""
    same = F.col(f"o_{content}").eqNullSafe(F.col(f"n_{content}"))
    action = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "keep").when(same, "unchanged").otherwise("update")
    take = F.col("_n").isNotNull() & (F.col("_o").isNull() | ~same)
    cols = [F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in keys] + [F.when(take, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in old.columns if c not in keys]
    return _both(old, new, keys).select(*cols, action.alias("action"))


def changed_fields(prev: DataFrame, cur: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows of both runs that differ, with the names of the fields; each run is cut to one row a key first."""
    a, b = latest(prev, keys, order), latest(cur, keys, order)
    both = _both(a.select(*keys, *fields), b.select(*keys, *fields), keys).where("_o and _n")
    names = F.filter(F.array(*[F.when(~F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return both.select(*[F.col(f"n_{k}").alias(k) for k in keys], F.array_join(names, ",").alias("changed"), F.size(names).alias("n_changed")).where("n_changed > 0")


def reconcile_snapshot(state: DataFrame, runs: DataFrame, membership: DataFrame, keys: Sequence[str] = ("source", "source_id")) -> DataFrame:
    """New state after a run of a source.

    Only runs that are complete, cover their whole scope and weren't limited may deactivate; then absent records go inactive and reappeared ones come back.
    state: (keys, source_active); runs: (run_id, source, status, scope_complete, limited); membership: (run_id, source_id).
    """
    good = runs.where("status in ('completed', 'completed_zero') and scope_complete and not coalesce(limited, false)").select("run_id", "source")
    seen = membership.dropDuplicates(["run_id", "source_id"]).join(good, "run_id").select("source", "source_id").distinct().withColumn("_seen", F.lit(True))
    covered = good.select("source").distinct().withColumn("_covered", F.lit(True))
    joined = state.join(covered, "source", "left").join(seen, list(keys), "left")
    action = (
        F.when(F.col("_covered").isNull(), "skip").when(F.col("_seen") & ~F.col("source_active"), "reactivate").when(F.col("_seen"), "touch").when(F.col("source_active"), "inactivate").otherwise("still_absent")
    )
    active = F.when(action.isin("reactivate", "touch"), True).when(action.isin("inactivate", "still_absent"), False).otherwise(F.col("source_active"))
    return joined.select(*state.columns, action.alias("action"), active.alias("now_active"))


def retention(df: DataFrame, date_col: str, as_of: Column, soft_days: int, hard_days: int) -> DataFrame:
    """What a purge would do with each row: keep, soft_delete or hard_delete."""
    age = F.datediff(as_of, F.col(date_col))
    return df.withColumn("purge", F.when(age > hard_days, "hard_delete").when(age > soft_days, "soft_delete").otherwise("keep"))


def delta(prev: DataFrame, cur: DataFrame, key: str, value: str, deadline: str, prev_as_of: Column, as_of: Column) -> DataFrame:
    """NOVO, VENCENDO (three days or fewer now, more before), ATUALIZADO (value moved over 5 percent) or INALTERADO."""
    p = prev.select(key, F.col(value).cast("double").alias("_pv"), F.col(deadline).alias("_pd"))
    days, before = F.datediff(F.col(deadline), as_of), F.datediff(F.col("_pd"), prev_as_of)
    moved = F.abs(F.col(value).cast("double") - F.col("_pv")) / F.nullif(F.abs(F.col("_pv")), F.lit(0.0))
    label = F.when(F.col("_pv").isNull() & F.col("_pd").isNull(), "NOVO").when((days <= 3) & (before > 3), "VENCENDO").when(moved > 0.05, "ATUALIZADO").otherwise("INALTERADO")
    return cur.join(p, key, "left").withColumn("delta", label).drop("_pv", "_pd")
