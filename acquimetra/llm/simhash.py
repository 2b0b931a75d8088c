"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Fingerprints are collapsed first, so copies never meet each other. Two fingerprints at 4 or fewer differing bits agree
on at least two of six blocks of the word (pigeonhole), so the upper nodes of the index are the fifteen masked
patterns (mask, bits under the mask): Spark deals fingerprints to these nodes, and only nodes with at least two
members go on. Crowded nodes are refined by five masks over their free bits, of which one must agree, which is exact as
well. The nodes of a task form one tree below: members are sorted by node and Gray rank, runs of eight become leaves, eight nodes become one above, and each
keeps the bits that all its members share and the range of upper nodes it covers. Pairs of tree nodes are descended from the root: pairs of different upper nodes
and pairs whose members are joined already are pruned, differences in shared bits accumulate from level to level, a pair beyond 4 is pruned with all its members, and a pair whose free bits are
at most 4 is linked as a whole. Only links to the least id of a node's group leave a task, so the output is linear. A node has to fit in a task: with distinct
fingerprints, two masks of about 21 and 9 bits leave one in 2^30 of them.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; a null doc_id gets a fingerprint and
no component; repeated rows are returned each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, cut, drop, fresh, table

CROWDED, LONG, MASKS, MASK_BITS = 2048, 4, 60, 16
#: Bits of the table of hashed ids that is broadcast, as words of 64: at most 131,072 rows whatever the input.
HASHED_BITS = 1 << 23


def shingle_hashes(parts: list[bytes], words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, joined by spaces; of all words if there are fewer."""
    line = b" ".join(parts)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length).tolist()
    last = ends[words - 1 :].tolist() or [len(line)]
    of = xxhash.xxh64_intdigest
    return np.array([of(line[a:b], 42) for a, b in zip(starts, last, strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes | None, words: int) -> int:
    """The unsigned SimHash of a text's word shingles; 0 without words."""
    parts = (text or b"").lower().split()
    return majority(shingle_hashes(parts, words)) if parts else 0


def long_majority(h: np.ndarray) -> list[int]:
    """``LONG`` times 64 bits from shingle hashes, each of hashes mixed anew; zeros without any."""
    out = []
    for _ in range(LONG):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        out.append(majority(h) if len(h) else 0)
    return out


def with_fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), words) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Joins the trees of a[i] and b[i] in place; a root is the least index of its tree. Tells whether anything was new."""
    new = False
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return new
        new = True
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def gray_links(codes: np.ndarray, bits: int, group: np.ndarray | None = None, more: np.ndarray | None = None, far: int = 0, fan: int = 8, step: int = 1 << 16) -> np.ndarray:
    """For each code, the index of its component's first member (in Gray order) among the ``codes`` of its group, as linked at ``bits`` or fewer differing bits.

    more: further bits of each code (a row of words), of which at most ``far`` may differ.
    """
    group = np.zeros(len(codes), np.int64) if group is None else group
    order = np.lexsort((gray_rank(codes), group))
    x, g = codes[order], group[order]
    root = np.arange(len(x))
    levels = [(x, np.full(len(x), ~np.uint64(0)), g, g)]  # pattern and mask of shared bits, first and last group; members themselves at the bottom
    while len(levels[-1][0]) > 1:
        low, mask, begin, end = levels[-1]
        at = np.arange(0, len(low), fan)
        every, some = np.bitwise_and.reduceat(low & mask, at), np.bitwise_or.reduceat(low | ~mask, at)
        shared = ~(every ^ some)
        levels.append((every & shared, shared, begin[at], np.maximum.reduceat(end, at)))
    for d in range(1, fan):  # neighbours first: what they join is not descended into again
        i = np.flatnonzero((g[d:] == g[:-d]) & (np.bitwise_count(x[d:] ^ x[:-d]) <= bits))
        if more is not None:
            i = i[np.bitwise_count(more[order[i]] ^ more[order[i + d]]).sum(axis=1) <= far]
        _unite(root, i, i + d)
    joined: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # least and greatest root below each node of a level
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        k, i, j = todo.pop()
        if len(i) > step:
            todo += [(k, i[step:], j[step:])]
            i, j = i[:step], j[:step]
        p, m, begin, end = levels[k]
        ok = (begin[j] <= end[i]) & (np.bitwise_count((p[i] ^ p[j]) & m[i] & m[j]) <= bits)
        i, j = i[ok], j[ok]
        if not k:
            if more is not None:
                near = np.bitwise_count(more[order[i]] ^ more[order[j]]).sum(axis=1) <= far
                i, j = i[near], j[near]
            if _unite(root, i, j):
                joined.clear()
            continue
        if k not in joined:
            at = np.arange(0, len(x), fan**k)
            joined[k] = np.minimum.reduceat(root, at), np.maximum.reduceat(root, at)
        least, most = joined[k]
        one = (least[i] == most[i]) & (least[j] == most[j]) & (least[i] == least[j])
        i, j = i[~one], j[~one]
        width = fan**k
        free = np.bitwise_count(~(m[i] & m[j]) | (p[i] ^ p[j]))
        whole = (free <= bits) & (begin[i] == end[j]) & (more is None)  # all members differ in these bits only
        first = i[whole] * width
        for at in (first, j[whole] * width) if len(first) else ():
            for d in range(width):
                ok = at + d < len(x)
                if _unite(root, first[ok], at[ok] + d):
                    joined.clear()
        i, j = i[~whole], j[~whole]
        a = (i[:, None, None] * fan + np.arange(fan)[None, :, None] + np.zeros((1, 1, fan), np.int64)).ravel()
        b = (j[:, None, None] * fan + np.arange(fan)[None, None, :] + np.zeros((1, fan, 1), np.int64)).ravel()
        n = len(levels[k - 1][0])
        ok = (a < n) & (b < n) & (a < b if k == 1 else a <= b)
        a, b = a[ok], b[ok]
        if k == 1:
            new = root[a] != root[b]
            a, b = a[new], b[new]
        if len(a):
            todo.append((k - 1, a, b))
    out = np.empty(len(x), np.int64)
    out[order] = order[root]
    return out


def _node_links(bits: int, keys: int, far: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (``keys`` columns that name a node, fp, further bits, id), those of a node together, to links (a, b) between ids.

    A node that runs over a batch's end waits for its rest; all others of a batch go through one tree.
    """

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        node, ids = rows[:, :keys], rows[:, -1]
        fp, more = np.ascontiguousarray(rows[:, keys]).view(np.uint64), np.ascontiguousarray(rows[:, keys + 1 : -1]).view(np.uint64)
        group = np.cumsum(np.r_[False, (node[1:] != node[:-1]).any(axis=1)])
        root = gray_links(fp, bits, group, more if more.shape[1] else None, far)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        hub = least[root]  # the least id, the same in most nodes that a group meets in, so that few links differ
        hung = np.flatnonzero(ids != hub)
        return pa.RecordBatch.from_arrays([pa.array(ids[hung]), pa.array(hub[hung])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            if kept and (kept[-1][-1, :keys] == rows[-1, :keys]).all():
                kept.append(rows)
                continue
            end = np.flatnonzero((rows[:, :keys] != rows[-1, :keys]).any(axis=1))
            end = end[-1] + 1 if len(end) else 0
            whole = np.concatenate([*kept, rows[:end]])
            kept = [rows[end:]]
            if len(whole):
                yield solve(whole)
        if kept:
            yield solve(np.concatenate(kept))

    return run


def _masks(bits_free: list[int], parts: int, keep: int) -> list[int]:
    """Masks of every ``keep`` of ``parts`` blocks of the given bit places."""
    blocks = [sum(1 << int(b) for b in x) for x in np.array_split(np.array(bits_free), parts)]
    return [sum(c) for c in combinations(blocks, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shared(nodes: DataFrame, *keys: str) -> DataFrame:
    """Rows of nodes with two members or more, each node's rows together, with the count ``n``; counted before any node's rows meet.

    Spark takes the nodes for as small as the fingerprints' file that they are made from, so without the hint it would broadcast them.
    """
    counts = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return nodes.join(counts.hint("merge"), list(keys))


def _together(nodes: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return nodes.select(*keys, *cols).repartition(*keys).sortWithinPartitions(*keys)


def near_components(fps: DataFrame, bits: int = 4, blocks: int = 6) -> tuple[DataFrame, str]:
    """fps: distinct (fp, id). Returns (id, component) of every id with a link, and the written table's path.

    Of ``blocks`` blocks, ``blocks - bits`` agree at least, which makes the nodes exact; more blocks than ``bits + 2`` give more and smaller nodes.
    """
    masks, cols = _masks(list(range(64)), blocks, blocks - bits), ["fp", "id"]
    nodes = fps.select(*cols, F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("m", "key")).withColumn("m", F.col("m").cast("long"))
    counted = _shared(nodes, "m", "key")
    usual = _together(counted.where(F.col("n") <= CROWDED), ["m", "key"], cols).mapInArrow(_node_links(bits, 2), "a long, b long")
    finer = F.array(*[F.array(*[F.lit(_signed(x)) for x in _masks([b for b in range(64) if not m >> b & 1], bits + 1, 1)]) for m in masks])
    crowded = counted.where(F.col("n") > CROWDED).select("m", "key", *cols, F.posexplode(finer[F.col("m").cast("int")]).alias("s", "under"))
    crowded = crowded.select("m", "key", F.col("s").cast("long").alias("s"), F.col("fp").bitwiseAND(F.col("under")).alias("rest"), *cols)
    return components(usual.union(_together(_shared(crowded, "m", "key", "s", "rest"), ["m", "key", "s", "rest"], cols).mapInArrow(_node_links(bits, 4), "a long, b long")))


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    fps, _ = cut(with_fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"))
    linked, _ = near_components(distinct, bits)
    named = distinct.join(linked.hint("merge"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(named.hint("merge"), "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def patterns(count: int = MASKS, width: int = MASK_BITS, seed: int = 5) -> list[tuple[int, int]]:
    """(word, mask) of each pattern over the long fingerprint: ``width`` bits of one word, the words in turn."""
    rng = np.random.default_rng(seed)
    return [(k % LONG, sum(1 << int(b) for b in rng.choice(64, width, replace=False))) for k in range(count)]


def bits_apart(similarity: float, deviations: float) -> int:
    """Bits of a long fingerprint that differ at a Jaccard similarity at most, but for a share of pairs beyond so many deviations: for sets of like size
    the cosine is 2J / (1 + J), and each bit differs with the angle's share of a half turn."""
    total, share = 64 * LONG, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(total * share + deviations * math.sqrt(total * share * (1 - share)))


def _hashed(ids: DataFrame, rows: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose id (not null) may be among the one column of ``ids``, and those whose id surely isn't.

    Each id sets one of ``HASHED_BITS`` bits, so few rows have to be shuffled to meet the ids themselves, however many rows there are.
    """
    word, bits = fresh(rows, "word", "bits")
    at = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(HASHED_BITS))
    of = lambda c: F.shiftright(at(c), 6)
    place = lambda c: F.pmod(at(c), F.lit(64)).cast("int")
    own = F.col(ids.columns[0])
    words = ids.select(of(own).alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), place(own)).alias("_bit")).groupBy(word).agg(F.bit_or("_bit").alias(bits))
    marked = rows.join(F.broadcast(words), of(F.col(id_col)) == F.col(word), "left")
    there = F.coalesce(F.getbit(F.col(bits), place(F.col(id_col))) == 1, F.lit(False))
    return marked.where(there).drop(word, bits), marked.where(~there).drop(word, bits)


def _verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) whose shingle sets (id, sh: sorted distinct 32-bit hashes) have that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                u, v = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok[k] = both >= similarity * (len(u) + len(v) - both)
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(ok))

    one, two = sets.select(F.col("id").alias("a"), F.col("sh").alias("x")), sets.select(F.col("id").alias("b"), F.col("sh").alias("y"))
    return links.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def with_shingles(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, l0, l1, ..., sh): the long fingerprint of each row and its distinct shingle hashes."""
    names = ["doc_id", *[f"l{i}" for i in range(LONG)], "sh"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            longs, sets = [], []
            for x in b.column(1):
                parts = (x.as_py() or b"").lower().split()
                h = shingle_hashes(parts, words) if parts else np.zeros(0, np.uint64)
                longs.append(long_majority(h))
                sets.append(np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes())
            cols = np.array(longs, np.uint64).reshape(b.num_rows, LONG).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(cols[:, i])) for i in range(LONG)], pa.array(sets, pa.binary())], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names[:-1]) + ", sh binary")


def similar_links(fps: DataFrame, similarity: float) -> DataFrame:
    """Candidate links (a, b) of distinct (l0, l1, ..., id) through the Gray index whose upper nodes are the masked bit patterns of ``patterns``.

    At a similarity of 0.8 a bit differs with probability 0.15, so one pattern of 16 bits agrees with 0.074 and one of 60 at least with 0.95 (0.999 at a similarity of 0.87).
    Below the node the tree runs on the first word, and all bits confirm.
    """
    cols = [f"l{i}" for i in range(LONG)]
    nodes = fps.select(*cols, "id", F.posexplode(F.array(*[F.col(f"l{w}").bitwiseAND(F.lit(_signed(m))) for w, m in patterns()])).alias("m", "key"))
    # The pattern's place goes into the key, for the shuffle's sake; two patterns of one key would only meet more often.
    nodes = nodes.select(F.xxhash64("m", "key").alias("key"), *cols, "id")
    first, every = bits_apart(similarity, 0) // LONG + 14, bits_apart(similarity, 2.5)
    return _together(nodes, ["key"], [*cols, "id"]).mapInArrow(_node_words(first, every), "a long, b long").distinct()


def _node_words(bits: int, far: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``_node_links`` for rows (key, l0, l1, ..., id): the tree's word is l0, and counts among the further bits too."""
    inner = _node_links(bits, 1, far)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return inner(pa.RecordBatch.from_arrays([b.column(0), b.column(1), *b.columns[1:]], names=["key", "fp", *b.schema.names[1:]]) for b in batches)

    return run


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keeps one row of each group of documents whose shingles of ``words`` words are alike to ``similarity`` (Jaccard) or more.

    Documents of equal long fingerprints collapse; candidates come from ``similar_links`` and are confirmed by the exact Jaccard similarity of their
    shingle sets (32-bit hashes). The row whose id names the group stays; of rows with that id and equal texts one, and every row without an id.
    """
    kept = docs.where(F.col(id_col).isNotNull())
    fps, path = cut(with_shingles(kept, words, id_col, text_col), "fingerprints")
    longs = [f"l{i}" for i in range(LONG)]
    distinct, distinct_path = cut(fps.groupBy(*longs).agg(F.min("doc_id").alias("id")), "distinct")
    links, links_path = cut(similar_links(distinct, similarity), "near-links")
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    near, _ = _hashed(ids, fps.select(F.col("doc_id").alias("id"), "sh"), "id")
    sets = near.join(ids, "id", "left_semi").groupBy("id").agg(F.min("sh").alias("sh"))
    linked, _ = components(_verified(links, sets, similarity))
    stay = distinct.join(linked, "id", "left").where("component is null or component = id").select("id").distinct()
    # The ids that go, and those that occur more than once, are few, so texts need not be shuffled to meet them.
    own = fps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    named = own.join(stay.withColumnRenamed("id", "doc_id").withColumn("stays", F.lit(True)), "doc_id", "left").where("stays is null or n > 1")
    (mark,) = fresh(docs, "marked")
    marked, _ = cut(named.select(F.col("doc_id").alias(mark), F.coalesce("stays", F.lit(False)).alias("again")), "marked")
    drop(docs.sparkSession, path, distinct_path, links_path)
    maybe, sure = _hashed(marked.select(mark), kept, id_col)
    once = sure.unionByName(maybe.join(marked.select(mark), F.col(id_col) == F.col(mark), "left_anti")).unionByName(docs.where(F.col(id_col).isNull()))
    again = marked.where("again").select(mark)
    if again.isEmpty():
        return once
    return once.unionByName(maybe.join(again, F.col(id_col) == F.col(mark), "left_semi").dropDuplicates([id_col, text_col]))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}
