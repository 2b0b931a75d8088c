"""Nearest neighbours by inner product with a forest of sorted hash strings.

Equal vectors collapse to one with their smallest ids. Every tree hashes a vector to a string of ``LENGTH`` bits, the sides of random
hyperplanes through the sample's medians; vectors get one more component that evens out their norms, so that
the angle orders them as the inner product does. Vectors are dealt out by the strings' first bits: in each of some trees a vector goes to the place of its prefix, and a
query goes to the places of its own prefixes only. How many trees and bits is chosen on a bounded sample, so that ``ROUTED`` of the nearest neighbours share a
prefix with the query; vectors without structure share none, and their queries go everywhere. Places of many vectors are split into blocks of about ``BLOCK`` by a hash of the id.
Each block holds a sorted array of strings for each tree. A query descends in all trees to its longest matching prefix and
then ascends in all of them at once, level by level, until the ranges hold enough candidates; these are ranked by the exact
inner product. How many are enough is measured on the sample against brute force, for a recall of ``RECALL``; vectors without
structure need a large share of all, structured ones a small one. ``recall`` measures a result against brute force over all vectors.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part; equal rows
count once; fewer than k candidates give fewer rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, drop, table

TREES, LENGTH, BLOCK, ASKING, SAMPLE, RECALL, ROUTED, DEEPEST, SEED = 24, 32, 8192, 4096, 3000, 0.97, 0.985, 12, 11
SHARES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0, 8.0)


def even(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that brings all to the norm ``longest``."""
    return np.column_stack([v, np.sqrt(np.maximum(0, longest**2 - (v * v).sum(axis=1)))])


class Forest:
    """Hyperplanes of all trees; their offsets are the sample's medians."""

    def __init__(self, sample: np.ndarray, longest: float, trees: int = TREES) -> None:
        self.trees, self.longest = trees, longest
        self.planes = np.random.default_rng(SEED).normal(size=(sample.shape[1] + 1, trees * LENGTH)).astype(np.float32)
        self.offset = np.median(even(sample, longest) @ self.planes, axis=0) if len(sample) else np.zeros(trees * LENGTH)

    def strings(self, v: np.ndarray, asking: bool) -> np.ndarray:
        """(trees, n) hash strings as integers, first bit highest. A query has nothing in the added component but points as its own row does."""
        x = even(v, self.longest) if not asking else np.column_stack([v, np.zeros(len(v))]) * (self.longest / np.maximum(1e-300, np.sqrt((v * v).sum(axis=1))))[:, None]
        bits = (x @ self.planes > self.offset).reshape(len(v), self.trees, LENGTH)
        return np.ascontiguousarray((bits @ (1 << np.arange(LENGTH - 1, -1, -1, dtype=np.int64))).T)


class Block:
    """Sorted arrays over some vectors."""

    def __init__(self, forest: Forest, v: np.ndarray) -> None:
        s = forest.strings(v, False)
        self.order = np.argsort(s, axis=1)
        self.sorted = np.take_along_axis(s, self.order, axis=1)

    def candidates(self, strings: np.ndarray, enough: float) -> Iterator[np.ndarray]:
        """For each query (a column of ``strings``), the members found when the ascent stops."""
        trees, n = strings.shape
        lo, hi = np.zeros((trees, n), np.int64), np.full((trees, n), self.sorted.shape[1], np.int64)
        open_ = np.ones(n, bool)
        for level in range(LENGTH, -1, -1):
            shift = LENGTH - level
            at = np.flatnonzero(open_)
            if not len(at):
                break
            a, b = np.empty((trees, len(at)), np.int64), np.empty((trees, len(at)), np.int64)
            for t in range(trees):
                low = (strings[t, at] >> shift) << shift
                a[t], b[t] = np.searchsorted(self.sorted[t], low), np.searchsorted(self.sorted[t], low + (1 << shift))
            done = ((b - a).sum(axis=0) >= enough) | (level == 0)
            lo[:, at[done]], hi[:, at[done]] = a[:, done], b[:, done]
            open_[at[done]] = False
        for q in range(n):
            found = np.zeros(self.sorted.shape[1], bool)
            for t in range(trees):
                found[self.order[t, lo[t, q] : hi[t, q]]] = True
            yield np.flatnonzero(found)


def best(ids: np.ndarray, v: np.ndarray, query: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best among the candidates ``at``, ties to smaller ids."""
    score = (v[at] * query).sum(axis=1)
    if len(at) > k:
        near = np.flatnonzero(score >= np.partition(score, len(at) - k)[len(at) - k])
        at, score = at[near], score[near]
    order = np.lexsort((ids[at], -score))[:k]
    return ids[at][order], score[order]


def tuned(sample: np.ndarray, forest: Forest, k: int) -> float:
    """Candidates to stop at, as a share of a block (a member counts once a tree), for the wanted recall on the sample."""
    if len(sample) <= k + 1:
        return float(forest.trees)
    queries = sample[:: max(1, len(sample) // 150)]
    truth = np.argsort(-(queries @ sample.T), axis=1)[:, : k + 1]
    block, strings = Block(forest, sample), forest.strings(queries, True)
    for share in SHARES:
        found = list(block.candidates(strings, share * len(sample)))
        if np.mean([np.isin(t, f).mean() for t, f in zip(truth, found, strict=True)]) >= RECALL:
            return share
    return float(forest.trees)


def routed(sample: np.ndarray, forest: Forest, k: int, n: int) -> tuple[int, int]:
    """Trees and prefix bits to deal out by: those that bring a query to the least share of all vectors at the wanted recall on the sample; (1, 0) is all of them.

    The sample's neighbours are further away than those among all vectors, so the choice is on the safe side. At most ``DEEPEST`` bits, which bounds the places.
    """
    deepest = min(DEEPEST, max(0, math.ceil(math.log2(max(1, n / BLOCK)))))
    if len(sample) <= k + 1 or not deepest:
        return 1, 0
    queries = sample[:: max(1, len(sample) // 150)]
    truth = np.argsort(-(queries @ sample.T), axis=1)[:, : k + 1]
    own, asked = forest.strings(sample, False), forest.strings(queries, True)
    options = sorted(((trees / (1 << bits), trees, bits) for bits in range(1, deepest + 1) for trees in (1, 2, 4, 8) if trees < 1 << bits))
    for _, trees, bits in options:
        shift = LENGTH - bits
        if ((own[:trees, truth] >> shift) == (asked[:trees, :, None] >> shift)).any(axis=0).mean() >= ROUTED:
            return trees, bits
    return 1, 0


def nearest(vectors: DataFrame, k: int = 20, asks: str = "vec_id % 20 = 0", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, candidates): for each row that ``asks``, its k nearest other rows, and how many vectors the query was compared with."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double, candidates long"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], out)
    dim, longest = dims[0]["d"], dims[0]["longest"]
    rows = rows.where(F.size("v") == dim).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).withColumn("h", F.xxhash64("v"))
    one, _ = cut(rows.withColumn("asks", F.expr(asks)).groupBy("h", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.max("asks").alias("asks")), "vectors")
    n = one.count()
    sample = np.array([r["v"] for r in one.select("v").orderBy(F.xxhash64("h", F.lit(SEED)), "id").limit(SAMPLE).collect()])
    forest = Forest(sample, longest)
    share = tuned(sample, forest, k)
    trees, bits = routed(sample, forest, k, n)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift, base = LENGTH - bits, np.arange(trees, dtype=np.int64)[:, None] << bits
        for b in batches:
            if len(b):
                v = np.stack(b["v"].to_numpy())
                for col, asking in (("own", False), ("goes", True)):
                    b[col] = list((base + (forest.strings(v, asking)[:trees] >> shift)).T)
                yield b

    dealt = one.select("id", "v", "asks").mapInPandas(places, "id long, v array<double>, asks boolean, own array<long>, goes array<long>")
    held = dealt.select("id", "v", F.explode("own").alias("place"))
    asked = dealt.where("asks").select("id", "v", F.explode("goes").alias("place"))
    both = held.select("place", F.lit(1).alias("a"), F.lit(0).alias("b")).union(asked.select("place", F.lit(0), F.lit(1))).groupBy("place").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    parts = lambda c, m: F.greatest(F.lit(1), F.ceil(F.col(c) / m)).cast("int")
    sizes, _ = cut(both.select("place", parts("a", BLOCK).alias("blocks"), parts("b", ASKING).alias("shelves")), "places")
    sizes = F.broadcast(sizes)  # at most 8 * 2 ** DEEPEST rows
    deal = lambda name, m: F.pmod(F.xxhash64("id", F.lit(name)), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    index = held.join(sizes, "place").select("id", "v", "place", deal("block", "blocks").alias("block"), every("shelves").alias("shelf"))
    queries = asked.join(sizes, "place").select(*[F.col(c).alias(c) for c in ("id", "v", "place")], every("blocks").alias("block"), deal("shelf", "shelves").alias("shelf"))

    def search(members: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Hits, and for each query a row without an id that says how many candidates there were."""
        found: list[tuple[int, int | None, float]] = []
        if len(members) and len(asked):
            ids, v = members["id"].to_numpy(), np.stack(members["v"].to_numpy())
            block = Block(forest, v)
            for i in range(0, len(asked), 512):
                part = asked.iloc[i : i + 512]
                q = np.stack(part["v"].to_numpy())
                for qid, query, at in zip(part["id"], q, block.candidates(forest.strings(q, True), share * len(ids)), strict=True):
                    got, score = best(ids, v, query, at, k + 1)
                    found += zip([qid] * len(got), got.tolist(), score.tolist(), strict=True)
                    found.append((qid, None, float(len(at))))
        return pd.DataFrame(found, columns=["query", "id", "score"]).astype({"query": "int64", "id": "Int64", "score": "float64"})

    keys = ["place", "block", "shelf"]
    hits = index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(search, "query long, id long, score double")
    top = lambda df, key, by, m: df.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(*by))).where(F.col("r") <= m).drop("r")
    hits, path = cut(hits, "hits")
    compared = hits.where("id is null").groupBy("query").agg(F.sum("score").cast("long").alias("candidates"))
    hits = top(hits.where("id is not null").groupBy("query", "id").agg(F.max("score").alias("score")), "query", [F.desc("score"), "id"], k + 1)
    hits, _ = cut(hits.join(compared, "query"), "best-hits")
    drop(spark, path)
    # Back from distinct vectors to rows: copies of a vector share its hits, and stand in them with their smallest ids.
    copies = rows.join(one.where("n > 1").select("h", "v", "id"), ["h", "v"]).select("vec_id", "id").distinct()
    named = one.where("n = 1").select(F.col("id").alias("vec_id"), "id")
    shown = named.union(top(copies, "id", ["vec_id"], k + 1))
    askers = named.union(copies).where(asks).select(F.col("vec_id").alias("query_id"), F.col("id").alias("query"))
    wide = top(hits.join(shown, "id").select("query", "vec_id", "score", "candidates"), "query", [F.desc("score"), "vec_id"], k + 1)
    pairs = wide.join(askers, "query").where("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "candidates")


def recall(vectors: DataFrame, found: DataFrame, queries: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Share of brute force's results among ``found``, over at most so many of its queries: these are sent to all vectors, block by block."""
    ids = [r["query_id"] for r in found.select("query_id").distinct().orderBy(F.xxhash64("query_id")).limit(queries).collect()]
    hits = found.where(F.col("query_id").isin(ids)).groupBy("query_id").agg(F.count(F.lit(1)).alias("k"), F.collect_list("score").alias("scores")).collect()
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v")).where("i is not null and forall(v, x -> x is not null and abs(x) < double('infinity'))")
    asked = {r["i"]: np.array(r["v"]) for r in rows.where(F.col("i").isin(ids)).collect()}
    most = max([r["k"] for r in hits], default=0)
    order, q = sorted(asked), np.stack([asked[i] for i in sorted(asked)]) if asked else np.zeros((0, 0))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = np.stack([(q * v).sum(axis=1) for v in b["v"]], axis=1)
                s[np.array(order)[:, None] == b["i"].to_numpy()[None]] = -np.inf
                near = np.argsort(-s, axis=1)[:, :most]
                yield pd.DataFrame({"query_id": np.repeat(order, near.shape[1]), "score": np.take_along_axis(s, near, axis=1).ravel()})

    if not order:
        return 1.0
    best_ = rows.mapInPandas(score, "query_id long, score double").withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"))))
    floor = {r["query_id"]: r["s"] for r in best_.where(F.col("r") <= most).groupBy("query_id").agg(F.min("score").alias("s")).collect()}
    return sum(sum(s >= floor[r["query_id"]] - 1e-12 for s in r["scores"]) for r in hits) / sum(r["k"] for r in hits)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_ann": op10_ann}
ORACLES: dict[str, str] = {}
