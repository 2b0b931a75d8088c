"""Totals that are kept up by batches: a batch adds its own small table, and reading folds all of them.

Every measure can be folded in any grouping (sum, count, least, greatest, first and last by an order), so the state after any
split of the rows into batches equals a computation over all rows. A batch has its folder by number and overwrites it
when it runs again; ``compact`` writes the fold of all batches so far, from which reading goes on. Keys are spread by hash
and rows of a key are combined before the shuffle, so a hot key costs no more than others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How partial values of each kind are folded; ``first`` and ``last`` hold structs that begin with their order.
FOLDS = {"sum": F.sum, "count": F.sum, "least": F.min, "greatest": F.max, "first": F.min, "last": F.max}


@dataclass(frozen=True)
class Measure:
    """``value`` of the rows that ``where`` lets in, by ``kind``; ``order`` is for first and last, where ties go to the lesser (greater) value."""

    kind: str
    value: Column
    order: Column | None = None
    where: Column | None = None

    def over_rows(self) -> Column:
        value = F.struct(self.order.alias("at"), self.value.alias("value")) if self.order is not None else self.value
        value = value if self.where is None else F.when(self.where, value)
        return F.coalesce(F.count(value), F.lit(0)) if self.kind == "count" else FOLDS[self.kind](value)


class Maintained:
    """``home`` holds the folders; ``keys`` may be null."""

    def __init__(self, spark: SparkSession, home: str, keys: Sequence[str], measures: dict[str, Measure]) -> None:
        self.spark, self.home, self.keys, self.measures = spark, home, list(keys), measures

    def delta(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[m.over_rows().alias(name) for name, m in self.measures.items()])

    def apply(self, batch: int, rows: DataFrame) -> None:
        """Adds the rows of a batch, or replaces what the same batch has added before."""
        self.delta(rows).write.mode("overwrite").parquet(f"{self.home}/deltas/batch={batch}")

    def _read(self, kind: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.home}/{kind}")
        except AnalysisException as gone:
            if gone.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def parts(self, before: int | None = None) -> DataFrame | None:
        """The tables that make the state of all batches, or of those before a number; None if there is none."""
        base, deltas = self._read("base"), self._read("deltas")
        last = None
        if base is not None:
            last = base.where(F.lit(True) if before is None else F.col("upto") < before).agg(F.max("upto")).first()[0]
        out = None if last is None else base.where(F.col("upto") == last).drop("upto")
        if deltas is not None:
            own = deltas.where((F.lit(True) if before is None else F.col("batch") < before) & (F.lit(True) if last is None else F.col("batch") > last)).drop("batch")
            out = own if out is None else out.unionByName(own)
        return out

    def fold(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.keys).agg(*[FOLDS[m.kind](name).alias(name) for name, m in self.measures.items()])

    def state(self, before: int | None = None) -> DataFrame | None:
        """A row for each key with its measures."""
        parts = self.parts(before)
        return None if parts is None else self.fold(parts)

    def compact(self, upto: int, keep: Column | None = None) -> None:
        """Writes the state of all batches up to a number, of the keys that ``keep`` accepts, as the new base. Batches up to it must not be applied again."""
        state = self.state(upto + 1)
        if state is not None:
            (state if keep is None else state.where(keep)).write.mode("overwrite").parquet(f"{self.home}/base/upto={upto}")


# The date that stands for an unknown one, days that a source counts as covered, the method of a link that names none, and the one that any other replaces.
EPOCH, COVERED_DAYS, DIRECT, WEAK = "1970-01-01", 90, "direct", "hierarchical"


def coverage(spark: SparkSession, home: str) -> Maintained:
    """Per entity and source: rows (entity, source, published, method, arrived) of notices that were linked to an entity."""
    published, method = F.col("published").cast("date"), F.coalesce("method", F.lit(DIRECT))
    known = F.coalesce(published, F.lit(EPOCH).cast("date"))
    measures = {
        "total": Measure("count", F.lit(1)),
        "dated": Measure("greatest", published),
        "latest": Measure("greatest", known),
        "strong": Measure("first", method, F.col("arrived"), method != WEAK),
    }
    return Maintained(spark, home, ["entity", "source"], measures)


def coverage_of(state: DataFrame, as_of: Column) -> DataFrame:
    """(entity, source, last_seen, total, covered, method): a single undated notice has no last day, several count as the first day of all; the first method that isn't weak stays."""
    last = F.when(F.col("total") == 1, F.col("dated")).otherwise(F.col("latest"))
    return state.select("entity", "source", last.alias("last_seen"), "total", F.coalesce(last >= F.date_sub(as_of, COVERED_DAYS), F.lit(False)).alias("covered"), F.coalesce(F.col("strong.value"), F.lit(WEAK)).alias("method"))


def newly_linked(old: DataFrame, new: DataFrame, key: str, entity: str) -> DataFrame:
    """Rows of ``new`` that count for an entity: those whose key is new, or whose entity has come or changed; the old entity keeps its count."""
    before = old.select(F.col(key).alias("_key"), F.col(entity).alias("_entity"), F.lit(True).alias("_known"))
    joined = new.where(F.col(entity).isNotNull()).join(before, F.col(key) == F.col("_key"), "left")
    return joined.where(F.col("_known").isNull() | ~F.col(entity).eqNullSafe(F.col("_entity"))).drop("_key", "_entity", "_known")


def hashes(spark: SparkSession, home: str, key: str = "content_hash") -> Maintained:
    """Per content hash: how often and when it was seen, and whose it was first; rows (key, source, run_id, at)."""
    who = F.struct("source", "run_id")
    return Maintained(spark, home, [key], {"times": Measure("count", F.lit(1)), "first_seen": Measure("least", F.col("at")), "last_seen": Measure("greatest", F.col("at")), "first": Measure("first", who, F.col("at"))})


def record(kept: Maintained, batch: int, rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Counts a batch of records and returns it with ``duplicate``: whether an earlier batch, or an earlier row of this one, had the same hash. Records without a hash are no duplicates and aren't counted."""
    (key,) = kept.keys
    known = kept.state(batch)
    rows = rows.select("*", F.struct(*order).alias("_order"))
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("_order").alias("_first"))
    if known is not None:
        first = first.join(known.select(key, F.lit(True).alias("_known")), key, "left")
    else:
        first = first.withColumn("_known", F.lit(None).cast("boolean"))
    kept.apply(batch, rows.where(F.col(key).isNotNull()))
    out = rows.join(first, key, "left")
    return out.withColumn("duplicate", F.coalesce(F.col("_known") | (F.col("_order") > F.col("_first")), F.lit(False))).drop("_order", "_first", "_known")
