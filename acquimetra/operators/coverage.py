"""Coverage, freshness and recall: what was collected, how recently, and how completely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hours in which each capability has to be refreshed.
SLA_HOURS = {"tenders": 24, "contracts": 168}
# Allowed moves between lifecycle states.
TRANSITIONS = {
    "not_applicable": (), "pending": ("running", "blocked", "not_applicable"), "running": ("success_with_data", "success_zero", "partial", "error", "blocked", "pending"),
    "success_with_data": ("stale", "running", "partial"), "success_zero": ("stale", "running", "success_with_data"), "partial": ("running", "success_with_data", "success_zero", "error", "stale"),
    "error": ("pending", "running", "blocked"), "blocked": ("pending", "not_applicable"), "stale": ("running", "pending"),
}
# Which state of a group's members shows, first to last.
PRECEDENCE = ("blocked", "error", "partial", "stale", "never_checked", "pending", "success_zero", "success_with_data")


def is_valid_transition(a: Column, b: Column) -> Column:
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]) if v else F.array().cast("array<string>"))])
    return F.coalesce(F.array_contains(allowed[a], b), F.lit(False))


def run_state(fetched: Column, transformed: Column, persisted: Column, complete: Column, zero_proof: Column, processed: Column, expected_pages: Column, expected_records: Column) -> Column:
    some = (fetched > 0) | (transformed > 0) | (persisted > 0)
    return (
        F.when(some, "success_with_data").when(complete & zero_proof & (processed >= expected_pages), "success_zero").when(complete & zero_proof, "partial").when(complete & (expected_records == 0), "success_zero").otherwise("partial")
    )


def decay(age_hours: Column, sla: Column) -> Column:
    return F.when(age_hours.isNull(), "unknown").when(age_hours <= sla, "fresh").when(age_hours <= sla * 2, "stale").otherwise("overdue")


def freshness(applicable: Column, blocked: Column, partial: Column, age_hours: Column, run_id: Column, content_hash: Column, sla: Column) -> Column:
    return (
        F.when(~applicable, "NOT_APPLICABLE").when(blocked, "BLOCKED").when(partial, "INCOMPLETE").when(age_hours.isNull(), "NEVER").when((age_hours < 0) | run_id.isNull() | content_hash.isNull(), "INCOMPLETE").when(age_hours <= sla, "FRESH").otherwise("STALE")
    )


def evidence_proof(state: Column, applicable: Column, age_hours: Column, sla: Column, fetched: Column, persisted: Column, processed: Column, expected: Column, token: Column) -> Column:
    """Why evidence counts (covered_zero, covered_data) or doesn't."""
    zero = applicable & (fetched == 0) & (persisted == 0) & (((processed >= expected) & (expected > 0)) | token)
    data = (fetched > 0) & (persisted > 0) & (persisted <= fetched)
    return (
        F.when(state.isin("blocked", "partial", "error", "stale", "pending", "never_checked"), F.concat(F.lit("state_"), state))
        .when(age_hours.isNull() | (age_hours < 0), "no_valid_time").when(age_hours > sla, "stale").when((state == "success_zero") & zero, "covered_zero").when(state == "success_zero", "zero_unproved").when((state == "success_with_data") & data, "covered_data").otherwise("data_unproved")
    )


def coverage_gate(covered: DataFrame, entity: str, required: list[str], source: str, ok: str, least: float = 0.95) -> DataFrame:
    """One row: entities, those with all required sources covered, the share, and whether the gate passes."""
    each = covered.where(F.col(source).isin(required)).groupBy(entity).agg(F.count_distinct(F.when(F.col(ok), F.col(source))).alias("n"))
    g = each.agg(F.count(F.lit(1)).alias("denominator"), F.count_if(F.col("n") == len(required)).alias("covered"))
    share = F.col("covered") / F.nullif(F.col("denominator"), F.lit(0))
    return g.withColumn("gate", F.when(F.col("denominator") == 0, "NOT_READY").when(share >= least, "PASS").otherwise("FAIL"))


def worst_state(df: DataFrame, keys: list[str], state: str) -> DataFrame:
    order = F.array(*[F.lit(s) for s in PRECEDENCE])
    return df.groupBy(*keys).agg(F.min(F.when(F.array_position(order, F.col(state)) > 0, F.array_position(order, F.col(state))).otherwise(len(PRECEDENCE) + 1)).alias("_p")).withColumn("state", F.get(order, (F.col("_p") - 1).cast("int"))).drop("_p")


def stratified_recall(sample: DataFrame, strata: list[str], found: str, weight: str | None = None, floor: float = 0.8) -> DataFrame:
    """(dimension, stratum, n, n_found, recall, passes) over each stratum column and overall."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pairs = F.array(*[F.struct(F.lit(s).alias("dimension"), F.col(s).cast("string").alias("stratum")) for s in strata], F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("stratum")))
    each = sample.select(F.explode(pairs).alias("k"), F.col(found).alias("_f"), w.alias("_w"))
    g = each.groupBy("k.dimension", "k.stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if("_f").alias("n_found"), F.sum("_w").alias("_t"), F.sum(F.when(F.col("_f"), F.col("_w")).otherwise(0.0)).alias("_h"))
    return g.withColumn("recall", F.col("_h") / F.nullif(F.col("_t"), F.lit(0.0))).withColumn("passes", F.col("recall") >= floor).drop("_t", "_h")


def applicability(entities: DataFrame, rules: DataFrame, sources: list[str], attribute: str) -> DataFrame:
    """(entity columns, source, applicable, reason): rules (source, filter, applies, reason, priority) with ``*`` for all; the highest priority gives the reason."""
    spark = entities.sparkSession
    grid = entities.crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in sources], "source string"))).select("*", F.struct(*[F.col(c) for c in entities.columns], "source").alias("_row"))
    r = rules.select("source", F.col("filter").alias("_f"), "applies", "reason", "priority")
    met = grid.join(r, "source", "left").where(F.col("_f").isNull() | (F.col("_f") == "*") | (F.col("_f") == F.col(attribute)))
    # Rows are compared as structs, null for null, so an entity with an unknown attribute keeps its rules.
    g = met.groupBy("_row").agg(F.max("applies").alias("_a"), F.max_by("reason", "priority").alias("reason")).withColumnRenamed("_row", "_met")
    return grid.join(g, F.col("_row").eqNullSafe(F.col("_met")), "left").select(*entities.columns, "source", F.coalesce("_a", F.lit(False)).alias("applicable"), F.coalesce("reason", F.lit("no_rule")).alias("reason"))
