"""Resumable micro-batches: parse, quarantine, deduplicate, upsert; progress lives in the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acquimetra.operators.relational import latest


def split_valid(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all SQL conditions, and the others with the names of those they failed; a null condition fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("failed_rules", failed)
    return marked.where(F.size("failed_rules") == 0).drop("failed_rules"), marked.where(F.size("failed_rules") > 0)


def backfill_windows(spark: SparkSession, start: str, end: str, days: int = 7) -> DataFrame:
    """(window_start, window_end) that tile a period; the last may be shorter."""
    s = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {days} days"))
    return spark.range(1).select(F.explode(s).alias("window_start")).withColumn("window_end", F.least(F.date_add("window_start", days - 1), F.lit(end).cast("date")))


def ingest_available(spark: SparkSession, source: str, schema: T.StructType, keys: list[str], order: list[str], rules: dict[str, str], target: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """Runs all files that have come since the last run, as micro-batches, into ``target``.

    Each batch writes its valid rows to ``target/batch=<id>`` and the rest to ``<target>_dead/batch=<id>``; a batch that is run again after a failure overwrites
    its own folder, so the result is the same. ``current`` reads the state.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_valid(batch, rules)
        latest(good, keys, [F.desc_nulls_last(c) for c in order]).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{target}_dead/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; late rows count by their order columns, none is dropped."""
    return latest(spark.read.parquet(target), keys, [*[F.desc_nulls_last(c) for c in order], F.desc("batch")]).drop("batch")
