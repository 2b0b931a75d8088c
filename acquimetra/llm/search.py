"""Ranked lexical search on an inverted index of two levels.

``build`` counts documents and terms, then writes the index: tasks cut their documents into blocks and write, for each block and term, the places
of the documents that hold it with two levels of evidence. The upper level is one byte a posting, the term's impact in
that document rounded upward; the lower level is the exact count, with each document's length in the block's head. Blocks need no shuffle.

``search`` sends the queries, themselves inverted and in blocks, to the postings of their terms. The bytes alone give every document an upper and
a lower bound; the k-th best lower bound over all blocks is the floor, and every document whose upper bound
reaches it is scored again in integers from the lower level. Nothing is dropped on a bound that could still reach the first k.

Defined results: null and empty texts have no terms and are never found; every row is a document, so repeated rows rank each; a null doc_id is returned
as null and comes last among equal scores; rows of queries with the same id are one query with the terms of all of them, null being an id too; a query
without known terms has no rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, drop, table

#: A block ends with so many documents or terms; queries go in blocks of about so many.
BLOCK_DOCS, BLOCK_TERMS, QUERY_BLOCK = 4096, 2_000_000, 256
#: Inverted query rows up to which they are broadcast; beyond, they meet the postings by shuffle.
BROADCAST_ROWS = 100_000
#: Bits that a byte impact leaves out; impacts are below 1,000,000, so that 245 steps hold them.
BITS = 12
STEP = 1 << BITS
#: Maps A-Z to lower case and every ASCII byte that is neither letter nor digit to a blank.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
POSTINGS = "block long, term string, places array<int>, counts array<int>, impacts binary, ids array<long>"


def terms(text: bytes) -> list[bytes]:
    """The maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(FOLDED).split()


def norm(n: int, docs: int, total: int) -> int:
    """The length norm of a document of ``n`` terms."""
    return 10 + 90 * n * docs // total


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact impacts in integers."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int]:
    """Documents with at least one term, and all their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(terms(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["docs", "total"])

    got = _texts(docs, id_col, text_col).mapInArrow(run, "docs long, total long").agg(F.sum("docs"), F.sum("total")).first()
    return int(got[0] or 0), int(got[1] or 0)


@dataclass
class Index:
    """Postings (a block's head has a null term, its documents' ids and, as counts, their lengths), documents and terms in all."""

    postings: DataFrame
    path: str
    docs: int
    total: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Indexes every term of every document."""
    n_docs, total = sizes(docs, id_col, text_col)

    def block(name: int, ids: list, lengths: list, postings: dict) -> pa.RecordBatch:
        keys = sorted(postings)
        flat = np.fromiter(chain.from_iterable(postings[k] for k in keys), np.int64).reshape(-1, 2)
        places, tf = flat[:, 0], flat[:, 1]
        m = np.array([norm(n, n_docs, total) for n in lengths], np.int64)
        q = ((impact(tf, m[places]) + STEP - 1) >> BITS).astype(np.uint8)
        ends = np.cumsum([0, *[len(postings[k]) // 2 for k in keys]])
        none = len(ids)
        offsets = pa.array(np.r_[0, 0, ends[1:]].astype(np.int32))
        count_offsets = pa.array(np.r_[0, none + ends].astype(np.int32))
        head_only = pa.array(np.r_[0, np.full(len(keys) + 1, none)].astype(np.int32))
        raw = q.tobytes()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(keys) + 1, name, np.int64)),
                pa.array([None, *keys], pa.binary()).cast(pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array(places.astype(np.int32))),
                pa.ListArray.from_arrays(count_offsets, pa.array(np.r_[lengths, tf].astype(np.int32))),
                pa.array([None, *[raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]], pa.binary()),
                pa.ListArray.from_arrays(head_only, pa.array(ids, pa.int64())),
            ],
            names=["block", "term", "places", "counts", "impacts", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        ids, lengths, postings, size = [], [], defaultdict(list), 0
        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = terms(text)
                if not words:
                    continue
                place = len(ids)
                ids.append(i)
                lengths.append(len(words))
                for w, n in Counter(words).items():
                    postings[w] += (place, n)
                size += len(words)
                if len(ids) == BLOCK_DOCS or size >= BLOCK_TERMS:
                    yield block(name, ids, lengths, postings)
                    name += 1
                    ids, lengths, postings, size = [], [], defaultdict(list), 0
        if ids:
            yield block(name, ids, lengths, postings)

    rows, path = cut(_texts(docs, id_col, text_col).mapInArrow(run, POSTINGS), "postings")
    return Index(rows, path, n_docs, total)


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): the different terms of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[t.decode() for t in set(terms(x))] for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.list_(pa.string()))], names=["item", "terms"])

    return _texts(items, id_col, text_col).mapInArrow(run, "item long, terms array<string>").select("item", F.explode("terms").alias("term")).distinct()


def weight(df: Column, docs: int) -> Column:
    """A term's weight, rounded down."""
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * docs + 2) / (2 * df + 1))).cast("long")


def _lists(c: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists."""
    a = c.combine_chunks()
    return a.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(a.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` best documents of every query with a score above 0."""
    spark = items.sparkSession
    asked, asked_path = cut(query_terms(items, id_col, text_col), "query-terms")
    blocks = max(1, -(-asked.select("item").distinct().count() // QUERY_BLOCK))
    held = index.postings.where("term is not null")
    dfs = held.select("term", F.size("places").alias("n")).join(_sized(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    known = asked.join(dfs, "term").withColumn("w", weight(F.col("df"), index.docs)).where("w > 0")
    items_of = F.transform(F.collect_list(F.struct("item")), lambda x: x["item"])  # keeps a null id
    inverted = known.groupBy("term", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("part")).agg(F.first("w").alias("w"), items_of.alias("items"))
    inverted, inverted_path = cut(inverted, "queries")
    small = _sized(inverted)

    def bounds(t: pa.Table) -> pa.Table:
        per_row = t["items"].to_pylist()
        names = list(dict.fromkeys(chain.from_iterable(per_row)))
        at = {x: i for i, x in enumerate(names)}
        places, ends = _lists(t["places"])
        size = int(places.max()) + 1
        upper, slack = np.zeros((len(names), size), np.int64), np.zeros((len(names), size), np.int64)
        for r, (own, w, raw) in enumerate(zip(per_row, t["w"].to_pylist(), t["impacts"].to_pylist(), strict=True)):
            q = np.frombuffer(raw, np.uint8).astype(np.int64)
            cells = np.ix_([at[x] for x in own], places[ends[r] : ends[r + 1]])
            upper[cells] += w * STEP * q
            slack[cells] += w * (STEP - 1) * (q > 0)
        best, docs, reach = [], [], []
        for up, low in zip(upper, upper - slack, strict=True):
            top = np.sort(np.partition(low, size - k)[size - k :] if size > k else low)
            best.append(top[top > 0])
            docs.append(np.flatnonzero((up > 0) & (up >= top[0])) if size > k else np.flatnonzero(up > 0))
            reach.append(up[docs[-1]])
        first = t.slice(0, 1)
        same = lambda c, kind: pa.array([first[c][0].as_py()] * len(names), kind)
        columns = [same("block", pa.int64()), same("part", pa.int32()), pa.array(names, pa.int64()), pa.array(best, pa.list_(pa.int64())), pa.array(docs, pa.list_(pa.int32())), pa.array(reach, pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, names=["block", "part", "item", "best", "docs", "reach"])

    level = held.select("block", "term", "places", "impacts").join(small, "term")
    bounded = level.groupBy("block", "part").applyInArrow(bounds, "block long, part int, item long, best array<long>, docs array<int>, reach array<long>")
    bounded, bounded_path = cut(bounded, "bounds")

    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))
    lows = bounded.select("item", F.explode("best").alias("low")).withColumn("place", place).where(F.col("place") <= k)
    floors = lows.groupBy(F.col("item").alias("of")).agg(F.when(F.count("low") >= k, F.min("low")).otherwise(F.lit(0)).alias("floor"))
    met = bounded.join(_sized(floors), F.col("item").eqNullSafe(F.col("of")))
    near = met.select("block", "part", "item", F.filter(F.arrays_zip("docs", "reach"), lambda x: x["reach"] >= F.col("floor"))["docs"].alias("docs")).where(F.size("docs") > 0)
    heads = index.postings.where("term is null").select("block", "ids", F.col("counts").alias("lengths"))
    near = near.join(heads, "block").select(
        "block", "part", "item", "docs", F.transform("docs", lambda i: F.col("ids")[i]).alias("ids"), F.transform("docs", lambda i: F.col("lengths")[i]).alias("lengths")
    )
    near, near_path = cut(near, "near")
    n_docs, total = index.docs, index.total

    def rescore(level: pa.Table, near: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(near) and len(level):
            rows_of = defaultdict(list)
            for r, own in enumerate(level["items"].to_pylist()):
                for x in own:
                    rows_of[x].append(r)
            places, ends = _lists(level["places"])
            counts, _ = _lists(level["counts"])
            w = level["w"].to_pylist()
            for item, docs, ids, lengths in zip(*[near[c].to_pylist() for c in ("item", "docs", "ids", "lengths")], strict=True):
                docs, score = np.array(docs), np.zeros(len(docs), np.int64)
                m = np.array([norm(n, n_docs, total) for n in lengths], np.int64)
                for r in rows_of[item]:
                    own, tf = places[ends[r] : ends[r + 1]], counts[ends[r] : ends[r + 1]].astype(np.int64)
                    spot = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                    hit = own[spot] == docs
                    score[hit] += w[r] * impact(tf[spot[hit]], m[hit])
                order = sorted(np.flatnonzero(score > 0).tolist(), key=lambda j: (-score[j], ids[j] is None, ids[j] or 0))[:k]
                out += [(item, ids[j], int(score[j])) for j in order]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    exact = held.select("block", "term", "places", "counts").join(near.select("block").distinct(), "block", "left_semi").join(small, "term")
    scored = exact.groupBy("block", "part").cogroup(near.groupBy("block", "part")).applyInArrow(rescore, "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked, _ = cut(scored.withColumn("rank", rank).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score"), "ranked")
    drop(spark, asked_path, inverted_path, bounded_path, near_path)
    return ranked


def _sized(rows: DataFrame) -> DataFrame:
    """``rows`` marked for broadcast where they are few; else a join shuffles them."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows.hint("merge")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(table(spark, sf_dir, "documents"))
    found = search(index, table(spark, sf_dir, "benchmark")).withColumnRenamed("item", "item_id")
    drop(spark, index.path)
    return found


QUERIES = {"op12_search": op12_search}
ORACLES = {
    "op12_search": r"""WITH d AS (SELECT row_number() OVER () AS row_, doc_id,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
size_ AS (SELECT count(*) FILTER (len(words) > 0) AS n, coalesce(sum(len(words)), 0)::BIGINT AS l FROM d),
tf AS (SELECT row_, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM (SELECT row_, doc_id, unnest(words) AS term FROM d) GROUP BY row_, term),
m AS (SELECT row_, 10 + (90 * len(words)::BIGINT * n) // l AS m FROM d, size_ WHERE len(words) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size_ GROUP BY term, n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, row_, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row_) GROUP BY item_id, row_),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""
}
