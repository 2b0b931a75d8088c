"""Latest rows, concentration, percentiles, gaps, completeness, top-n: DataFrame to DataFrame, lazily."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

By = Sequence[Column | str]


def latest(df: DataFrame, keys: By, order: By) -> DataFrame:
    """First row of each key in ``order``, which has to end with a unique column. Spark prunes before its shuffle."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_n(df: DataFrame, keys: By, order: By, n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def versions(df: DataFrame, keys: By, order: By, start: str, to: str = "valid_to") -> DataFrame:
    """Version numbers from 1 for each key, and when each gave way to the next."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"version": F.row_number().over(w), to: F.lead(start).over(w), "is_current": F.lead(start).over(w).isNull()})


def ratio(part: Column, whole: Column, zero: float | None = None) -> Column:
    """part / whole as double; where whole is 0, ``zero``."""
    return F.when(whole == 0, F.lit(zero).cast("double")).otherwise(part.cast("double") / whole.cast("double"))


def concentration(df: DataFrame, owner: str, member: str, value: str) -> DataFrame:
    """Herfindahl index of each owner over its members' shares in the summed value, times 10,000 and whole.

    Sums by owner and member first, so a hot owner is met by its members only.
    """
    pairs = df.groupBy(owner, member).agg(F.sum(value).alias("v"), F.count(F.lit(1)).alias("n"))
    whole = pairs.groupBy(owner).agg(F.sum("n").cast("long").alias("n_contracts"), F.sum("v").cast("decimal(18,2)").alias("total"), F.count(F.lit(1)).alias("n_members"), F.sum(F.pow(F.col("v").cast("double"), F.lit(2.0))).alias("squares"))
    share = F.when(F.col("total") != 0, F.col("squares") / F.pow(F.col("total").cast("double"), F.lit(2.0)))
    return whole.withColumn("hhi", F.round(share * 10000, 0).cast("long")).drop("squares")


def share_concentration(df: DataFrame, owner: str, member: str, value: str | None = None) -> DataFrame:
    """The same index from 0 to 1, over values or, without ``value``, over counts; with the number of members and the largest share."""
    x = F.sum(value) if value else F.count(F.lit(1))
    pairs = df.groupBy(owner, member).agg(x.cast("double").alias("v"))
    g = pairs.groupBy(owner).agg(F.count(F.lit(1)).alias("n_members"), F.sum("v").alias("t"), F.sum(F.col("v") * F.col("v")).alias("q"), F.max("v").alias("m"))
    return g.select(owner, "n_members", (F.col("q") / F.nullif(F.col("t") * F.col("t"), F.lit(0.0))).alias("hhi"), (F.col("m") / F.nullif(F.col("t"), F.lit(0.0))).alias("top_share"))


def quantiles(df: DataFrame, keys: By, value: str, at: Sequence[float], prefix: str = "p", kind: str = "double") -> DataFrame:
    """Count and exact interpolated percentiles of each group, as ``kind``.

    Equal values of a group collapse before the shuffle; running counts over a group's distinct values, sorted and spilled by Spark, then show the two values
    next to each percentile, for all percentiles at once. Groups with a null key are groups; null values are not counted.
    """
    names = [k if isinstance(k, str) else df.select(k).columns[0] for k in keys]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    counts = rows.groupBy(*names, "_v").agg(F.count("_v").alias("_c"))
    group = F.struct(*[F.col(c) for c in names]) if names else F.lit(0)
    keyed = counts.select("*", group.alias("_g"))
    by = W.partitionBy("_g")
    ranked = keyed.select("*", F.sum("_c").over(by.orderBy("_v").rowsBetween(W.unboundedPreceding, 0)).alias("_to"), F.sum("_c").over(by).alias("_n"))
    place = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    holds = lambda k: (F.col("_to") > k) & (F.col("_to") - F.col("_c") <= k) & (F.col("_c") > 0)

    def at_place(p: float) -> Column:
        low = F.max(F.when(holds(F.floor(place(p))), F.col("_v")))
        high = F.max(F.when(holds(F.ceil(place(p))), F.col("_v")))
        part = F.max(place(p)) - F.floor(F.max(place(p)))
        return F.when(part == 0, low).otherwise((1 - part) * low + part * high)

    return ranked.groupBy(*names).agg(F.max("_n").alias("n"), *[at_place(p).cast(kind).alias(f"{prefix}{round(p * 100)}") for p in at])


def completeness(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, filled, total, percent): one scan counts all fields, then turns the row."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f) for f, c in fields.items()])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields])
    each = counts.select(F.explode(rows).alias("r"), "_n").select("r.field", "r.filled", F.col("_n").alias("total"))
    return each.withColumn("percent", F.round(F.col("filled").cast("decimal(18,2)") * 100 / F.greatest(F.col("total"), F.lit(1)), 1).cast("double"))


def missing(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_anti")


def with_flag(left: DataFrame, right: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """Adds whether a row's key occurs in ``right``."""
    return left.join(right.select(*on).distinct().withColumn(flag, F.lit(True)), list(on), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def outliers(df: DataFrame, keys: By, value: str, least: int = 5, k: float = 1.5, kind: str = "double") -> DataFrame:
    """Price panel: n, quartiles, rows outside the fences; groups below ``least`` rows are too small to judge."""
    g = quantiles(df, keys, value, (0.25, 0.5, 0.75), kind=kind)
    names = [c for c in g.columns if c not in ("n", "p25", "p50", "p75")]
    h = g.select(F.struct(*names).alias("_h"), "n", "p25", "p50", "p75")
    fenced = df.select(*keys, F.col(value).cast("double").alias("_v")).join(h, F.struct(*names).eqNullSafe(F.col("_h"))).drop("_h")
    low, high = F.col("p25").cast("double"), F.col("p75").cast("double")
    wide = (high - low) * k
    out = (F.col("_v") < low - wide) | (F.col("_v") > high + wide)
    counted = fenced.groupBy(*names, "n", "p25", "p50", "p75").agg(F.count_if(out).alias("n_outliers"))
    return counted.withColumn("status", F.when(F.col("n") < least, "INSUFFICIENT_SAMPLE").otherwise("OK"))


def ladder(*steps: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The label of the first condition that holds."""
    out = F
    for cond, label in steps:
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit(otherwise))
