"""Deterministic identity resolution: rule cascades, priority reconciliation, similarity joins by blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acquimetra.functions.geo import haversine_km, near_box
from acquimetra.functions.text import tokens
from acquimetra.sources.tables import checkpointed

#: Most frequent tokens whose counts order sets of tokens; all others count as rare.
KNOWN = 100_000
#: Bits of the table of hashed ids that is broadcast, as words of 64: at most 131,072 rows whatever the input.
HASHED_BITS = 1 << 23
#: A set of n tokens is looked at in as many more tokens as n holds this number, and has to share as many more.
SPARE = 32


def _keyed(df: DataFrame, cols: Sequence[Column | str], keys: Sequence[Column]) -> DataFrame:
    """A row of (cols, rank, key) for each key that isn't null."""
    each = F.array(*[F.struct(F.lit(i).alias("rank"), k.cast("string").alias("key")) for i, k in enumerate(keys)])
    return df.select(*cols, F.explode(F.filter(each, lambda x: x["key"].isNotNull())).alias("_k")).select("*", "_k.rank", "_k.key").drop("_k")


def cascade(left: DataFrame, right: DataFrame, left_id: str, right_id: str, levels: Sequence[tuple[str, float, Column, Column]]) -> DataFrame:
    """(left_id, right_id, match_method, match_score): the first level that finds a partner decides; ties go to the least right_id.

    levels: (name, score, key of left, key of right). One equi-join over (level, key) whatever the number of levels; the right side is
    collapsed to one row a level and key before it, so no level multiplies rows.
    """
    names, scores = F.array(*[F.lit(x[0]) for x in levels]), F.array(*[F.lit(float(x[1])) for x in levels])
    keys = _keyed(right, [right_id], [x[3] for x in levels]).groupBy("rank", "key").agg(F.min(right_id).alias(right_id))
    hits = _keyed(left, [left_id], [x[2] for x in levels]).join(keys, ["rank", "key"])
    best = hits.groupBy(left_id).agg(F.min(F.struct("rank", right_id)).alias("_b"))
    rank = F.col("_b.rank")
    method, score = F.coalesce(F.get(names, rank), F.lit("none")), F.coalesce(F.get(scores, rank), F.lit(0.0))
    return left.select(left_id).join(best, left_id, "left").select(left_id, F.col(f"_b.{right_id}").alias(right_id), method.alias("match_method"), score.alias("match_score"))


def reconcile(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rules: Sequence[tuple[str, Column, Column]], preferred: str | None = None) -> DataFrame:
    """(left_id, rule, right_id, candidates, decision): all rules at once as one equi-join over (rule, key); the first rule with candidates wins.

    More than one candidate under the winning rule asks for review; ``preferred`` names a boolean column of right whose rows come first.
    """
    names = F.array(*[F.lit(r[0]) for r in rules])
    lk = _keyed(left, [left_id], [r[1] for r in rules]).withColumn("rule", F.get(names, F.col("rank")))
    prefer = F.col(preferred).cast("int") if preferred else F.lit(0)
    rk = _keyed(right, [right_id, prefer.alias("_p")], [r[2] for r in rules])
    # A row of right for each rule and key before the join, so that a key with many rows on both sides does not multiply them.
    rk = rk.groupBy("rank", "key").agg(F.count_distinct(right_id).alias("candidates"), F.min(F.struct((-F.col("_p")).alias("p"), F.col(right_id).alias("id"))).alias("b"))
    found = lk.join(rk, ["rank", "key"])
    best = found.withColumn("_rn", F.row_number().over(W.partitionBy(left_id).orderBy("rank"))).where("_rn = 1")
    picked = best.select(left_id, "rule", F.col("b.id").alias(right_id), "candidates", F.when(F.col("candidates") == 1, "matched").otherwise("review").alias("decision"))
    return left.select(left_id).join(picked, left_id, "left").fillna({"decision": "unmatched", "candidates": 0})


def conflicts(status: tuple[Column, Column], date: tuple[Column, Column], value: tuple[Column, Column]) -> Column:
    """Comma-joined names of what two linked records disagree on; values may differ by 1 percent or by 1."""
    a, b = value
    apart = (F.abs(a - b) > 1) & (F.abs(a - b) > F.greatest(F.abs(a), F.abs(b)) * 0.01)
    found = F.array(F.when(status[0] != status[1], "status"), F.when(date[0] != date[1], "date"), F.when(apart, "value"))
    return F.array_join(F.filter(found, lambda x: x.isNotNull()), ",")


def _token_sets(df: DataFrame, id_col: str, text_col: str, blocks: Sequence[str]) -> DataFrame:
    """(id, block, t, s): hash of the block, each text's tokens as sorted 64-bit hashes, and a hash of both that stands for the set.

    Stored sets take more room than the texts, so whoever needs tokens cuts the texts again.
    """
    t = F.sort_array(F.transform(tokens(F.coalesce(F.col(text_col), F.lit(""))), lambda w: F.xxhash64(w)))
    block = F.xxhash64(F.lit(len(blocks)), *[x for c in blocks for x in (F.col(c).isNull(), F.col(c))])
    return df.select(F.col(id_col).alias("id"), block.alias("block"), t.alias("t")).withColumn("s", F.xxhash64("block", "t"))


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``KNOWN`` most frequent tokens, sorted, and their counts. Only counts are shuffled, no set's tokens.

    ``explode`` would have Spark filter out empty sets first, for which it would cut each text twice.
    """
    counts = sets.select(F.explode_outer("t").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    known = sorted((r["w"], r["df"]) for r in counts.where("df > 1 and w is not null").orderBy(F.desc("df"), "w").limit(KNOWN).collect())
    return np.array([w for w, _ in known] or [0], np.int64), np.array([n for _, n in known] or [0], np.int64)


def _rarest_first(reps: DataFrame) -> Callable[..., Column]:
    """Orders sets of token hashes: all but the ``KNOWN`` most frequent tokens by hash, then those by frequency.

    Any one order of tokens finds all links; frequent ones come last so that few sets meet.
    """
    words, often = _frequent(reps)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ordered(t: pd.Series) -> pd.Series:
        out = []
        for x in t:
            at = np.minimum(np.searchsorted(words, x), len(words) - 1)
            out.append(x[np.lexsort((x, np.where(words[at] == x, often[at], 0)))])
        return pd.Series(out)

    return ordered


def _first_tokens(sets: DataFrame, least: float) -> DataFrame:
    """(key, id, n, left): the tokens, rarest first, in which a set of n has ``1 + n // SPARE`` in common with any set alike. key: hash of block and token; left: tokens from it on."""
    words, often = _frequent(sets)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            each = x["t"].map(len).to_numpy(np.int64)
            row, t = np.repeat(np.arange(len(x)), each), np.concatenate([*x["t"], np.zeros(0, np.int64)])
            at = np.minimum(np.searchsorted(words, t), len(words) - 1)
            t, left = t[np.lexsort((t, np.where(words[at] == t, often[at], 0), row))], np.repeat(np.cumsum(each), each) - np.arange(len(t))
            n = each[row]
            first = left >= np.ceil(n * least - 1e-9) - n // SPARE
            key = (x["block"].to_numpy(np.int64)[row] ^ t)[first]
            yield pd.DataFrame({"key": key, "id": x["id"].to_numpy()[row[first]], "n": n[first], "left": left[first]})

    kind = T.StructType([T.StructField("key", T.LongType()), sets.schema["id"], T.StructField("n", T.LongType()), T.StructField("left", T.LongType())])
    return sets.select("id", "block", "t").mapInPandas(cut, kind)


def _marked(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """df with ``_in``: true for all ids of ``ids``, and for few others while those are few, by a table of hashed ids that is broadcast."""
    at = F.pmod(F.xxhash64(F.col(id_col)), F.lit(HASHED_BITS))
    bit = F.expr("shiftleft(1L, cast(_at % 64 as int))")
    bits = ids.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    held = df.withColumn("_at", at).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(bits), "_word", "left")
    return held.withColumn("_in", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_at", "_word", "_bits")


def _set_links(df: DataFrame, id_col: str, text_col: str, blocks: Sequence[str], least: float) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep: the least id with the same set; null for the empty one), and the links (a, b, similarity), a < b, of reps of a block whose sets are alike.

    Equal sets collapse first. Sets of na and nb tokens that are alike have o or more in common, so their first na - o + c and nb - o + c tokens, rarest first, have c in
    common for any c. Only these are joined on and counted; c rises with the sizes, since large sets share a few tokens by chance. Tokens of what is left go
    to the least set that its lesser one met, not to each pair, and are compared there.
    """
    cut = lambda rows: _token_sets(rows, id_col, text_col, blocks)
    own = checkpointed(cut(df).select("id", "s", F.size("t").alias("n")))
    reps = own.where("n > 0 and id is not null").groupBy("s").agg(F.min("id").alias("rep"))
    copies = own.where("n > 0").join(reps, "s").where("id <> rep").select(F.col("id").alias(id_col))
    # Only rows that may be copies are shuffled to see whether they are.
    marked = _marked(df.where(F.col(id_col).isNotNull()), id_col, copies)
    single = cut(marked.where("not _in"))
    some = cut(marked.where("_in")).join(reps.select(F.col("rep").alias("id"), "s"), ["id", "s"]).select(*single.columns)
    first = _first_tokens(single.unionByName(some), least)
    a, b = (first.select("key", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("left").alias(f"left_{x}")) for x in "ab")
    needs, common = F.ceil((F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9), 1 + F.expr(f"least(na, nb) div {SPARE}")
    close = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9) & (F.least("left_a", "left_b") > needs - common)
    met = a.join(b.hint("merge"), "key").where(close).groupBy("a", "b", common.alias("c")).agg(F.count(F.lit(1)).alias("k"))
    pairs = checkpointed(met.where("k >= c").select("a", "b"))
    low = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("low"))
    to = checkpointed(pairs.join(low, "a", "left").select(F.coalesce("low", "a").alias("to"), F.explode(F.array("a", "b")).alias("id")).distinct())
    told = cut(_marked(df, id_col, to.select(F.col("id").alias(id_col))).where("_in")).join(to, "id")
    x, y = (told.select("to", "block", F.col("id").alias(c), F.col("t").alias(f"t{c}")) for c in "ab")
    both, na, nb = F.size(F.array_intersect("ta", "tb")), F.size("ta"), F.size("tb")
    near = x.join(y.hint("merge"), ["to", "block"]).where((F.col("a") < F.col("b")) & (F.least(na, nb) >= F.greatest(na, nb) * least - 1e-9))
    links = near.select("a", "b", (both / (na + nb - both)).alias("similarity")).where(F.col("similarity") >= least).distinct()
    return own.join(reps, "s", "left").select("id", "rep"), links


def similar_pairs(df: DataFrame, id_col: str, text_col: str, blocks: Sequence[str], least: float = 0.75, remove: float = 0.85) -> DataFrame:
    """(a, b, similarity, verdict) of pairs in a block whose token sets are alike. Rows with a null in a block column meet no other row.

    Links are found between distinct sets; the ids that have these sets are put in at the end.
    """
    members, links = _set_links(df.where(" and ".join(f"{c} is not null" for c in blocks)) if blocks else df, id_col, text_col, blocks, least)
    members = members.where("rep is not null and id is not null")
    x, y = (members.select(F.col("rep").alias(c), F.col("id").alias(f"id_{c}")) for c in "ab")
    across = links.join(x, "a").join(y, "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "similarity")
    within = x.join(y.withColumnRenamed("b", "a"), "a").where("id_a < id_b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(within).select("a", "b", "similarity", F.when(F.col("similarity") >= remove, "remove").otherwise("warn").alias("verdict"))


def indel_ratio(a: str, b: str) -> float:
    """2 x longest common subsequence over the summed lengths, by bits of a machine-sized integer."""
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 2 * (len(a) - s.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


def fuzzy_best(left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str, block: str, least: float = 0.85) -> DataFrame:
    """(left_id, right_id, score): the most alike name within a block; lengths too far apart for ``least`` are not compared. Ties go to the least right_id.

    Different names of a block are compared once, whatever the number of rows that have them; rows get their name's result at the end.
    """
    rows = left.where(F.col(left_id).isNotNull()).select(left_id, block, F.col(name).alias("_a"))
    a, b = rows.select(block, "_a").distinct(), right.groupBy(block, F.col(name).alias("_b")).agg(F.min(right_id).alias(right_id))
    la, lb = F.length("_a"), F.length("_b")
    pairs = a.join(b, block).where(2 * F.least(la, lb) >= (la + lb) * least).withColumn("score", fuzzy_ratio("_a", "_b")).where(F.col("score") >= least)
    best = pairs.groupBy(block, "_a").agg(F.max(F.struct("score", (-F.col(right_id)).alias("r"))).alias("m"))
    return rows.join(best, [block, "_a"]).groupBy(left_id).agg(F.max("m").alias("m")).select(left_id, (-F.col("m.r")).alias(right_id), F.col("m.score").alias("score"))


def within_radius(df: DataFrame, lat: str, lon: str, lat0: float, lon0: float, km: float) -> DataFrame:
    """Rows within ``km`` of a point, with their distance; a box that scans can use comes first."""
    d = haversine_km(F.col(lat), F.col(lon), F.lit(lat0), F.lit(lon0))
    return df.where(near_box(F.col(lat), F.col(lon), lat0, lon0, km)).withColumn("km", d).where(F.col("km") <= km)


def resolve_universe(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """(row columns, entity_id, method): a unique root first, then name and town, then a unique name, else ambiguous or unknown.

    rows: (row_id, root, name, town); universe: (entity_id, root, name, town).
    """
    def unique(cols: list[str], tag: str) -> DataFrame:
        return universe.where(" and ".join(f"{c} is not null" for c in cols)).groupBy(*cols).agg(F.min("entity_id").alias(f"id_{tag}"), F.count_distinct("entity_id").alias(f"n_{tag}"))

    j = rows.join(unique(["root"], "r"), ["root"], "left").join(unique(["name", "town"], "nt"), ["name", "town"], "left").join(unique(["name"], "n"), ["name"], "left")
    one = lambda t: F.col(f"n_{t}") == 1
    many = F.coalesce(F.col("n_r") > 1, F.lit(False)) | F.coalesce(F.col("n_nt") > 1, F.lit(False)) | F.coalesce(F.col("n_n") > 1, F.lit(False))
    entity = F.when(one("r"), F.col("id_r")).when(one("nt"), F.col("id_nt")).when(one("n"), F.col("id_n"))
    method = F.when(one("r"), "root").when(one("nt"), "name_town").when(one("n"), "name").when(many, "ambiguous").otherwise("unknown")
    return j.select(*rows.columns, entity.alias("entity_id"), method.alias("method"))


def settled(links: DataFrame) -> DataFrame:
    """(b) of the rows that go: links (a, b), a before b, are taken in order; a row goes if it links to a row before it that stays.

    A round keeps what has no open link to an earlier row and drops what links to it.
    """
    edges, rounds = links, []
    while not edges.isEmpty():
        kept = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        rounds.append(checkpointed(edges.join(kept, "a").select("b").distinct()))
        edges = checkpointed(edges.join(rounds[-1], "b", "left_anti").join(rounds[-1].select(F.col("b").alias("a")), "a", "left_anti"))
    return reduce(DataFrame.union, rounds, links.select("b").limit(0))


def greedy_keep(df: DataFrame, id_col: str, text_col: str, block: Sequence[str], least: float = 0.85) -> DataFrame:
    """(id, dropped_for): by rising id within a block, a row goes if a row kept before it is alike, and names the least such row. Nulls are a block of their own.

    The order is settled in rounds over the links of distinct sets: what has no undecided link to a lesser row is kept, and what links to
    it goes. Each round is a few joins over the links still open, checkpointed; no block has to fit in a task.
    """
    members, links = _set_links(df.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, block, least)
    links = checkpointed(links.select("a", "b"))
    gone = settled(links)
    fell = links.join(gone, "b", "left_semi").join(gone.select(F.col("b").alias("a")), "a", "left_anti").groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("to"))
    named = members.join(fell, "rep", "left")
    return named.select("id", F.coalesce("to", F.when(F.col("id") != F.col("rep"), F.col("rep"))).alias("dropped_for"))
