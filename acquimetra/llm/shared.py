"""Small helpers: shared-folder tables, connected components, table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where that is unset and driver and executors are one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="acquimetra-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and rereads it: cuts lineage and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that ``cut`` wrote and that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def components(links: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, str]:
    """Connected components of ``links`` (columns a, b: long) by alternating large-star and small-star rounds.

    Every round joins each edge to the least neighbour of one of its ends and rewires it there, so the edge count never
    grows and the number of rounds is logarithmic. Hubs are only ever aggregated by ``min`` or met in a sort-merge
    join, which adaptive execution splits; the hints keep Spark from a broadcast, since links that lie packed in a small file may be many. Returns (id, component) for the ids that occur in a link, with the path of the written table; component is the
    least id that can be reached. Rows with a null end are ignored; equal rows count once.
    """
    spark = links.sparkSession
    star = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges, path = cut(star, "links")
    for _ in range(max_rounds):
        # Large star: each end's larger neighbours move to its least neighbour.
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least.hint("merge"), "x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        # Small star: each node's smaller neighbours, and the node, move to the least of them.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(low.hint("merge"), "v")
        after = moved.select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").union(low.select("v", F.col("m").alias("u"))).distinct()
        new, new_path = cut(after, "links")
        # Done when every node hangs on one root and no root hangs on another.
        ends = new.select(F.col("v").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(new.select("u", F.lit(0), F.lit(1)))
        unsettled = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs + holds > 1 and hangs > 0").limit(1).count()
        drop(spark, path)
        edges, path = new, new_path
        if not unsettled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).union(edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()), path
