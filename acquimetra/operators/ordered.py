"""Order statistics of groups of any size: no task holds a group.

Rows are put in order of group and value over all partitions; each partition counts what it has of a group, running sums of
these few counts give every partition's first rank, and only the rows of the wanted ranks are looked up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acquimetra.sources.tables import checkpointed

#: Rows of wanted ranks up to which they are broadcast; beyond, they meet the rows by shuffle.
BROADCAST_RANKS = 100_000


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_RANKS + 1).count() <= BROADCAST_RANKS else df.hint("merge")


def spread_quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], prefix: str = "p") -> DataFrame:
    """Count and exact interpolated percentiles of each group, like ``relational.quantiles``, for groups that no task could hold. Equal values of a group collapse first.

    Groups with a null key are groups; null values are not counted, and a group without others has n 0 and null percentiles.
    """
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    rows = df.select(group.alias("g"), F.col(value).cast("double").alias("v"))
    counts = rows.where("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    placed = checkpointed(counts.repartitionByRange("g", "v").select("g", "v", "c", F.spark_partition_id().alias("part")))
    runs = placed.groupBy("g", "part").agg(F.sum("c").alias("c"))
    by = W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    runs = runs.select("g", "part", "c", (F.sum("c").over(by) - F.col("c")).alias("first"), F.sum("c").over(W.partitionBy("g")).alias("n"))
    exact = (F.col("n") - 1) * F.col("q.q")
    asked = runs.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(at)])).alias("q"))
    asked = asked.select("g", "part", "c", "first", "n", F.col("q.i").alias("i"), exact.alias("exact"), F.explode(F.array_distinct(F.array(F.floor(exact), F.ceil(exact)))).alias("rank"))
    wanted = checkpointed(asked.where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("c"))).select("g", "part", (F.col("rank") - F.col("first")).alias("row"), "n", "i", "exact", "rank"))
    # Only partitions that hold a wanted rank are counted through; each was written by one task.
    held = placed.join(_sized(wanted.select("part", F.col("g").alias("h")).distinct()).withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col("g").eqNullSafe(F.col("h")), "left_semi")
    upto = held.select("g", "part", "v", "c", F.sum("c").over(W.partitionBy("g", "part").orderBy("v").rowsBetween(W.unboundedPreceding, 0)).alias("to"))
    asking = _sized(wanted.select(F.col("g").alias("h"), F.col("part").alias("p"), "row", "n", "i", "exact", "rank"))
    found = upto.join(asking, (F.col("part") == F.col("p")) & F.col("g").eqNullSafe(F.col("h")) & (F.col("row") < F.col("to")) & (F.col("row") >= F.col("to") - F.col("c")))
    low, high = F.max(F.when(F.col("rank") == F.floor("exact"), F.col("v"))), F.max(F.when(F.col("rank") == F.ceil("exact"), F.col("v")))
    part = F.max(F.col("exact") - F.floor("exact"))
    each = found.groupBy("g", "n", "i").agg(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias("p"))
    wide = each.groupBy("g").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("p"))).alias(f"{prefix}{round(q * 100)}") for i, q in enumerate(at)])
    if not keys:
        return wide.drop("g")
    all_groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("_rows"))
    out = all_groups.join(wide.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")), "left")
    return out.select("g.*", F.coalesce("n", F.lit(0)).alias("n"), *[f"{prefix}{round(q * 100)}" for q in at])


def ranks(df: DataFrame, order: Sequence[Column], to: str = "rank") -> DataFrame:
    """``df`` with each row's place in the order of all rows, from 1, without gathering them; ``order`` has to be unique for places to be repeatable."""
    names = [f"_o{i}" for i in range(len(order))]
    index = F.monotonically_increasing_id()
    ordered = df.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)])
    by = [F.asc_nulls_last(n) for n in names]
    placed = checkpointed(ordered.repartitionByRange(*by).sortWithinPartitions(*by).select(*df.columns, F.shiftright(index, 33).alias("_part"), index.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_part", (F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).alias("_before"))  # a row for each partition
    return placed.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_row") + F.col("_before") + 1).alias(to))
