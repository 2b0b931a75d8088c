"""Landing files in and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, limit: int | None = None) -> DataFrame:
    """JSON lines by a schema; a line that can't be read is a row of nulls."""
    df = spark.read.schema(schema).json(path)
    return df.limit(limit) if limit is not None else df


def newest_files(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "json") -> DataFrame:
    """Rows of the file that was modified last; the name breaks ties."""
    df = spark.read.schema(schema).format(kind).load(path).withColumns({"_at": F.col("_metadata.file_modification_time"), "_file": F.col("_metadata.file_path")})
    last = df.agg(F.max(F.struct("_at", "_file")).alias("m")).select("m._at", "m._file")  # one row
    return df.join(F.broadcast(last), ["_at", "_file"], "left_semi").drop("_at", "_file")


def json_rows(df: DataFrame, json_col: str, element: str) -> DataFrame:
    """A row for each element of a JSON array, read by the schema ``element``; null and unreadable arrays have none."""
    return df.select("*", F.explode(F.from_json(F.col(json_col), f"array<{element}>")).alias("item"))


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """One file for people; only for results that a person can read."""
    out = df.coalesce(1).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.format(kind).save(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n, digest) that doesn't depend on the order of rows: the sum of row hashes, modulo 2^63 - 1."""
    h = F.pmod(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)"), F.lit(9223372036854775807).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h) % F.lit(9223372036854775807).cast("decimal(38,0)"), F.lit(0)).cast("long").alias("digest"))
