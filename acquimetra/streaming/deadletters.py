"""Dead letters: records that a stage could not take, kept until they are replayed, dead or purged.

Every step appends the entries that it changes to a maintained table of latest versions, under its own number, so a step that runs again
after a failure writes the same again and a restart reads the same state. An entry is named by source, record and how often the
record had been retried when it came; a replayed record that fails once more comes as an entry of its own, with its count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .maintained import Maintained, Measure

# Seconds to wait after so many retries and after more, most retries, days until what is closed goes, and the longest message and trace kept.
WAITS, LATER, MOST_RETRIES, KEEP_DAYS, MESSAGE, TRACE = (60, 300, 900), 3600, 3, 90, 2000, 10_000
NAME = ["source", "record", "pushed"]
FIELDS = "run_id string, phase string, payload string, error_code string, error_message string, error_trace string, retry_count int, status string, failed_at timestamp, replayed_at timestamp, replayed_by string"


def backoff_seconds(retries: Column) -> Column:
    """Wait before a record that was retried so often is tried again."""
    out = F.when(retries < 1, WAITS[0])
    for i, wait in enumerate(WAITS[1:], 1):
        out = out.when(retries == i, wait)
    return out.otherwise(LATER)


def entries(failed: DataFrame) -> DataFrame:
    """Pending entries of failed records: (source, record, retry_count, failed_at) and what ``failed`` has of the other fields; absent ones are null."""
    kinds = T.StructType.fromDDL(FIELDS)
    have = {c.lower() for c in failed.columns}
    retries = F.coalesce(F.col("retry_count").cast("int"), F.lit(0)) if "retry_count" in have else F.lit(0)
    own = {"retry_count": retries, "status": F.lit("pending"), "replayed_at": F.lit(None), "replayed_by": F.lit(None)}
    cut = {"error_message": MESSAGE, "error_trace": TRACE}
    cols = []
    for f in kinds.fields:
        c = own.get(f.name, F.col(f.name) if f.name in have else F.lit(None))
        c = F.left(c, F.lit(cut[f.name])) if f.name in cut and f.name in have else c
        cols.append(c.cast(f.dataType).alias(f.name))
    return failed.select(F.col("source").cast("string").alias("source"), F.col("record").cast("string").alias("record"), retries.alias("pushed"), *cols)


class DeadLetters:
    """All entries under ``home``; every writing step takes a number that grows."""

    def __init__(self, spark: SparkSession, home: str) -> None:
        names = T.StructType.fromDDL(FIELDS).fieldNames()
        self.kept = Maintained(spark, home, NAME, {"entry": Measure("last", F.struct(*names), F.col("step"))})
        self.spark = spark

    def state(self, before: int | None = None) -> DataFrame:
        """The entries after all steps, or those before a number."""
        state = self.kept.state(before)
        if state is None:
            return self.spark.createDataFrame([], f"source string, record string, pushed int, {FIELDS}")
        return state.select(*NAME, "entry.value.*").where("status <> 'purged'")

    def _write(self, step: int, changed: DataFrame) -> None:
        self.kept.apply(step, changed.withColumn("step", F.lit(step).cast("long")))

    def push(self, step: int, failed: DataFrame) -> None:
        self._write(step, entries(failed))

    def replay(self, step: int, as_of: Column, run_id: str, source: str | None = None, limit: int | None = 100, due_only: bool = False) -> DataFrame:
        """Takes up to ``limit`` pending entries, those that failed first; returns them with their raised count. Those retried too often become dead and aren't returned."""
        open_ = self.state(step).where("status = 'pending'")
        if source is not None:
            open_ = open_.where(F.col("source") == source)
        if due_only:
            open_ = open_.where(F.unix_timestamp("failed_at") + backoff_seconds(F.col("retry_count")) <= F.unix_timestamp(as_of))
        if limit is not None:
            open_ = open_.orderBy("failed_at", *NAME).limit(limit)
        tried = F.col("retry_count") + 1
        dead = tried > MOST_RETRIES
        changed = open_.withColumns({"retry_count": tried, "status": F.when(dead, "dead").otherwise("replayed"), "replayed_at": F.when(~dead, as_of.cast("timestamp")), "replayed_by": F.when(~dead, F.lit(run_id))})
        self._write(step, changed)
        written = self.kept._read("deltas").where(F.col("batch") == step)
        return written.select(*NAME, "entry.value.*").where("status = 'replayed'")

    def archive(self, step: int, chosen: Column) -> None:
        self._write(step, self.state(step).where(chosen).withColumn("status", F.lit("archived")))

    def purge(self, step: int, as_of: Column, days: int = KEEP_DAYS, source: str | None = None) -> None:
        """Takes out dead and archived entries that failed more than ``days`` days ago."""
        old = self.state(step).where("status in ('dead', 'archived')").where(F.col("failed_at") < as_of.cast("timestamp") - F.make_dt_interval(F.lit(days)))
        self._write(step, (old if source is None else old.where(F.col("source") == source)).withColumn("status", F.lit("purged")))

    def counts(self) -> DataFrame:
        """(source, status, n)."""
        return self.state().groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))

    def compact(self, upto: int) -> None:
        """Folds the steps so far into one table, without purged entries."""
        self.kept.compact(upto, F.col("entry.value.status") != "purged")


def drain(spark: SparkSession, landing: str, schema: T.StructType, home: str, checkpoint: str, retry: Callable[[DataFrame], DataFrame], as_of: Callable[[int], Column], run_id: str = "worker", files_per_batch: int = 1, limit: int | None = 100) -> None:
    """Runs all files of failures that have come: each micro-batch pushes its failures, replays what is pending and pushes what fails again.

    ``retry`` gets replayed records and returns those that failed again, with ``failed_at``; ``as_of`` gives the time of a micro-batch.
    """
    letters = DeadLetters(spark, home)

    def step(batch: DataFrame, number: int) -> None:
        letters.push(3 * number, batch)
        again = retry(letters.replay(3 * number + 1, as_of(number), run_id, limit=limit))
        letters.push(3 * number + 2, again)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
