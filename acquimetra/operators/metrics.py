"""Metrics as data: what is counted, over what, for which target; all metrics of a population come from one aggregation.

A ``Metric`` names a numerator and a denominator as aggregates over one population of rows. ``measure`` compiles any number of them
into a single aggregation, for every value of a scope and for all rows together, and gives a row for each metric and scope.
A metric without a denominator, or without what it is counted from, is NOT_READY and has no percentage; it is never zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "all"
# The stages that a source has to have passed, and its states that count.
STAGES = ("mapped", "accessible", "collected", "normalized", "reconciled", "verified_within_sla")
OPERATIONAL = ("verified", "operational")
# Commercial states that are a recent signal.
SIGNALS = ("OPEN_OPPORTUNITY", "UPCOMING_OPPORTUNITY", "RECENT_NOTICE", "OPEN", "UPCOMING", "RECENT")
# Fields that a decision needs.
DECISION_FIELDS = ("entity", "cnpj", "process", "edital", "objeto", "modalidade", "situacao", "datas", "valor", "local", "url", "docs", "fonte", "collected_at", "commercial_class", "sector_class", "ranking_evidence")


@dataclass(frozen=True)
class Metric:
    """``numerator`` and ``denominator`` are aggregates; ``ready`` is one too: whether there is what to count from. ``additive`` numerators of the scopes add up to that of all."""

    name: str
    kind: str
    numerator: Column
    denominator: Column
    target: float | None = None
    ready: Column | None = None
    unit: str = "pct"
    additive: bool = False


def percent(numerator: Column, denominator: Column) -> Column:
    return F.round(numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0)) * 100, 2)


def measure(rows: DataFrame, metrics: Sequence[Metric], scope: str | None = None) -> DataFrame:
    """(metric, kind, scope, status, numerator, denominator, value, target, met, additive) of every metric for all rows and, with ``scope``, each of its values; a null one is ``unknown``.

    value is a percentage, or the numerator itself for metrics of another unit.
    """
    aggs = []
    for i, m in enumerate(metrics):
        aggs += [m.numerator.cast("double").alias(f"n{i}"), m.denominator.cast("double").alias(f"d{i}"), (F.lit(True) if m.ready is None else F.coalesce(m.ready, F.lit(False))).alias(f"r{i}")]
    if scope is None:
        flat = rows.agg(*aggs).withColumn("scope", F.lit(ALL))
    else:
        named = rows.withColumn("_scope", F.coalesce(F.col(scope).cast("string"), F.lit("unknown")))
        flat = named.groupingSets([["_scope"], []], "_scope").agg(*aggs, F.grouping_id().alias("_all")).withColumn("scope", F.when(F.col("_all") == 1, ALL).otherwise(F.col("_scope")))
        # Without rows there are no grouping sets; all rows together are then none.
        columns = [c for c in flat.columns if c[0] in "ndr" and c != "scope"]
        none = rows.limit(0).agg(*aggs).select(F.lit(ALL).alias("scope"), F.lit(0).alias("_real"), F.struct(*columns).alias("_row"))
        both = flat.select("scope", F.lit(1).alias("_real"), F.struct(*columns).alias("_row")).union(none)
        flat = both.groupBy("scope").agg(F.max_by("_row", "_real").alias("_row")).select("scope", "_row.*")
    each = []
    for i, m in enumerate(metrics):
        n, d = F.col(f"n{i}"), F.col(f"d{i}")
        ready = F.col(f"r{i}") & n.isNotNull() & (d.isNotNull() & (d > 0) if m.unit == "pct" else F.lit(True))
        value = percent(n, d) if m.unit == "pct" else F.round(n, 2)
        each.append(
            F.struct(
                F.lit(m.name).alias("metric"), F.lit(m.kind).alias("kind"), "scope", F.when(ready, "READY").otherwise("NOT_READY").alias("status"), F.when(ready, n).alias("numerator"), d.alias("denominator"),
                F.when(ready, value).alias("value"), F.lit(m.target).cast("double").alias("target"), F.when(ready, value >= F.lit(m.target)).cast("boolean").alias("met"), F.lit(m.additive).alias("additive"),
            )
        )
    return flat.select(F.inline(F.array(*each)))


def conflicts(results: DataFrame, shared: Sequence[str] = ()) -> DataFrame:
    """(metric, scope, conflict) of results that can't be: a numerator above its denominator, scopes of an additive metric that don't add up to all, or metrics of ``shared`` that don't have one denominator."""
    above = results.where("numerator > denominator").select("metric", "scope", F.lit("numerator_above_denominator").alias("conflict"))
    whole = F.max(F.when(F.col("scope") == ALL, F.coalesce("numerator", F.lit(0.0))))
    parts = F.sum(F.when(F.col("scope") != ALL, F.coalesce("numerator", F.lit(0.0))))
    sums = results.where("additive").groupBy("metric").agg(whole.alias("w"), parts.alias("p")).where("p is not null and abs(w - p) > 1e-6").select("metric", F.lit(ALL), F.lit("scopes_do_not_add_up"))
    one = results.where(F.col("metric").isin(*shared)).agg(F.count_distinct("denominator").alias("n"), F.max("metric").alias("metric")).where("n > 1").select("metric", F.lit(ALL), F.lit("denominators_differ"))
    return above.union(sums).union(one)


def filled(c: Column | str) -> Column:
    """Whether a field holds something: null and blank text don't count."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def source_ready(status: Column, dry_run: Column, stages: Column) -> Column:
    """Whether a source's record proves it operational: a state that counts, a run that wasn't dry, and every stage passed (``stages`` maps them to true)."""
    passed = F.lit(True)
    for s in STAGES:
        passed = passed & F.coalesce(F.try_element_at(stages, F.lit(s)), F.lit(False))
    return F.coalesce(F.lower(status).isin(*OPERATIONAL), F.lit(False)) & F.coalesce(~dry_run, F.lit(False)) & passed


def entity_metrics(mapped: str, operational: str, signal: str, last_seen: str, as_of: Column, sla_hours: int) -> list[Metric]:
    """Four metrics over a universe with a row for each entity; the universe is their denominator and never gets smaller."""
    one = F.count(F.lit(1))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(F.col(last_seen).cast("timestamp"))) / 3600
    return [
        Metric("entities_with_recent_commercial_signal", "commercial_signal", F.count_if(signal), one),
        Metric("source_mapping_coverage", "coverage", F.count_if(mapped), one, 100.0),
        Metric("operational_source_coverage", "coverage", F.count_if(operational), one, 95.0),
        Metric("freshness_coverage", "coverage", F.count_if(F.coalesce(age <= sla_hours, F.lit(False))), one),
    ]


def recall_metric(relevant: str, retrieved: str) -> Metric:
    """Over a labelled sample; without a relevant item, or with one that nobody has looked for, it isn't ready."""
    wanted = F.coalesce(F.col(relevant), F.lit(False))
    return Metric("opportunity_recall", "recall", F.count_if(wanted & F.coalesce(F.col(retrieved), F.lit(False))), F.count_if(wanted), ready=F.count_if(wanted & F.col(retrieved).isNull()) == 0)


def completeness_metric(fields: Sequence[str], name: str = "required_field_completeness") -> Metric:
    """Mean filled fields of a record, of all fields."""
    per_row = sum((filled(f).cast("int") for f in fields), F.lit(0))
    return Metric(name, "completeness", F.round(F.avg(per_row), 4), F.lit(len(fields)), ready=F.count(F.lit(1)) > 0)


def source_metrics(date: str, as_of: Column, days: int, category: str, taxonomy: Sequence[str], fields: Sequence[str], links: Sequence[str], collected: str, town: str, known_town: str, towns: Column, org: str, orgs: Column) -> list[Metric]:
    """What sources bring: towns and organisations seen in a window, days with records, kinds of acts, filled cells, records with a link, hours since the last collection.

    Distinct towns and organisations are counted exactly; days and kinds are bounded sets, gathered as such.
    """
    day, one = F.col(date).cast("date"), F.count(F.lit(1))
    inside = day.between(F.date_sub(as_of.cast("date"), days), as_of.cast("date"))
    own = F.count_if(filled(links[0]) if len(links) == 1 else F.exists(F.array(*[filled(c) for c in links]), lambda x: x))
    cells = sum((F.count_if(filled(f)) for f in fields), F.lit(0).cast("long"))
    last = F.max(F.unix_timestamp(F.col(collected).cast("timestamp")))
    return [
        Metric("municipalities_with_publication", "coverage", F.count_distinct(F.when(inside & F.col(known_town), F.col(town))), towns),
        Metric("orgs_with_recent_notice", "coverage", F.count_distinct(F.when(inside, F.col(org))), orgs),
        Metric("temporal_coverage", "coverage", F.size(F.collect_set(F.when(inside, day))), F.lit(days + 1)),
        Metric("act_category_distribution", "coverage", F.size(F.collect_set(F.when(F.col(category).isin(*taxonomy), F.col(category)))), F.lit(len(taxonomy))),
        Metric("field_completeness", "completeness", cells, one * len(fields), additive=True),
        Metric("document_coverage", "coverage", own, one, additive=True),
        Metric("freshness_hours", "freshness", (F.unix_timestamp(as_of) - last) / 3600, F.lit(1), unit="hours"),
    ]


def category_shares(rows: DataFrame, scope: str, category: str) -> DataFrame:
    """(scope, category, n, pct): how the records of a scope divide into categories; a null one is ``unknown``."""
    g = rows.groupBy(scope, F.coalesce(category, F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = g.groupBy(F.col(scope).alias("_scope")).agg(F.sum("n").alias("_total"))
    return g.join(total, F.col(scope).eqNullSafe(F.col("_scope"))).select(scope, "category", "n", percent(F.col("n"), F.col("_total")).alias("pct"))
