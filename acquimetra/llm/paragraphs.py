"""Substring dedup: MinHash banding of paragraphs, exact Jaccard checks, removals clustered by components.

A text is read as words; a run of more than ``RUN`` bytes without white space is cut by its content, so scripts without spaces have words too.
Two kinds of units are read from whole texts:

Paragraphs are lines of at least ``LEAST`` words (of a text with fewer words, the whole text). Equal ones collapse; different ones meet where
a band of ``ROWS`` minima out of ``BANDS`` is equal: at a Jaccard similarity of 0.8 (distinct five-word shingles) a pair is found with
probability 1 - (1 - 0.8^3)^7 = 0.993. In a band's bucket, members of different components are compared by exact Jaccard (of 32-bit
shingle hashes, so exact up to their collisions); only tree edges leave the task. A crowded bucket is dealt out in pairs of salted blocks, which together hold all its pairs.

Windows of ``UNIT`` words start wherever in a text; winnowing takes one start in any ``GAP``, chosen by the words at it. Texts that share
``UNIT + GAP - 1`` = 24 words in a row share a window wherever it stands, with or without sentences or lines. Windows that other documents hold as well are merged
into spans; unequal words between two of them do not end a span while they are fewer than ``BRIDGE``: one changed word in a run of 50 leaves 24 equal ones at least on one
side and 16 or more in windows on both. A span counts when its windows reach over ``LEAST`` words but for the ``2 * (GAP - 1)`` that winnowing may leave at its
ends, or over all of a shorter text but for as many.

Documents are then linked to the least document that holds a window or paragraph of a span (or a near copy of the paragraph), and the components of these links are the classes.

Defined results: null and empty texts and those of fewer than five words have no passages; a null doc_id takes no part; equal rows count once; extra columns are ignored; passages that
repeat only inside one document are not reported; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import components, cut, drop, table

SHINGLE, UNIT, GAP, LEAST, BANDS, ROWS, RUN = 5, 16, 9, 50, 7, 3, 32
BRIDGE, CROWDED, BLOCKS = 19, 2048, 64
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACE = np.uint64((1 << 24) - 1)
SCHEMA = "doc_id long, word int, start int, length int, content long, need int, bands array<long>, sh binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


_SEEDS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """The first ``n`` powers of ``base``, kept for the next call."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = _POWERS[int(base)] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 21), base)], dtype=np.uint64)
    return have[:n]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every word in ``data``, which ends with white space."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(space.view(np.int8), prepend=1)
    s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    long = np.flatnonzero(e - s > RUN)
    if not len(long):
        return s, e
    size = (e - s)[long]
    at = np.repeat(s[long] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())  # the bytes of long runs
    at = at[(at - np.repeat(s[long], size) >= 3) & (at + 1 < np.repeat(e[long], size))]
    four = data[at].astype(np.uint32) | data[at - 1].astype(np.uint32) << 8 | data[at - 2].astype(np.uint32) << 16 | data[at - 3].astype(np.uint32) << 24
    here = at[((four * np.uint32(0x9E3779B1)) >> 29 == 0) & ((data[at + 1] & 0xC0) != 0x80)] + 1
    return np.sort(np.r_[s, here]), np.sort(np.r_[e, here])


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` values from each place on; places near the end see fewer."""
    out, have = v.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def winnowed(shingle: np.ndarray, local: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Of the starts ``valid`` (where a window of ``GAP`` starts begins), the places of the least shingles; equal ones by their local place."""
    if not len(valid):
        return valid
    here = np.arange(len(shingle), dtype=np.uint64)
    key = shingle >> np.uint64(28) << np.uint64(28) | (local % GAP).astype(np.uint64) << np.uint64(24) | here & _PLACE
    low = _sliding_least(key, GAP)[valid] & _PLACE
    picked = (valid & ~int(_PLACE)) | low.astype(np.int64)
    picked += np.where(picked < valid, int(_PLACE) + 1, 0)
    return np.unique(picked)


def units(texts: list[bytes]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Windows (text, word, start, stop, content, need) and paragraphs (text, start, stop, content, bands, sh as offsets and values) of all texts."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    none = {k: np.zeros(0, np.int64) for k in ("text", "word", "start", "stop", "content", "need", "bands", "offsets", "sh")}
    s, e = words_of(data) if len(data) else (np.zeros(0, np.int64),) * 2
    if len(s) < SHINGLE:
        return none, none
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    total = np.r_[np.uint64(0), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(len(data), _BASE), dtype=np.uint64)]
    word = _mix((total[e] - total[s]) * _powers(len(data), _INVERSE)[s])
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    doc = np.searchsorted(ends_of, s, side="right")
    first = np.searchsorted(doc, np.arange(len(texts)))
    n = np.diff(np.r_[first, len(s)])
    zero = points[np.r_[0, ends_of[:-1]]]
    local = np.arange(len(s)) - first[doc]
    left = n[doc] - local
    m = len(s) - SHINGLE + 1
    shingle = np.zeros(len(s), np.uint64)
    for k in range(SHINGLE):
        shingle[:m] = shingle[:m] * _BASE + word[k : k + m]
    shingle = _mix(shingle)

    at = winnowed(shingle, local, np.flatnonzero(left >= UNIT + GAP - 1))
    small = first[(n >= SHINGLE) & (n < UNIT + GAP - 1)]
    long, short = word[at[:, None] + np.arange(UNIT)] if len(at) else np.zeros((0, UNIT), np.uint64), []
    content = [_mix((long * _powers(UNIT, _BASE)).sum(axis=1, dtype=np.uint64))]
    for p in small.tolist():
        w = word[p : p + n[doc[p]]]
        short.append((w * _powers(len(w), _BASE)).sum(dtype=np.uint64) + np.uint64(len(w)))
    content.append(_mix(np.array(short, np.uint64)))
    every = np.r_[at, small].astype(np.int64)
    length = np.r_[np.full(len(at), UNIT), n[doc[small]]].astype(np.int64)
    t = doc[every]
    edge = 2 * (GAP - 1)
    need = np.where(n[t] < UNIT + GAP - 1, n[t], np.minimum(LEAST, n[t]) - edge)
    windows = {"text": t, "word": local[every], "start": points[s[every]] - zero[t], "stop": points[e[every + length - 1]] - zero[t], "content": np.concatenate(content).view(np.int64), "need": need}

    breaks = np.cumsum(data == 10)[s]
    line = np.where(n[doc] >= LEAST, breaks, 0)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])]
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(s)])
    fit = (size >= LEAST) | ((size >= SHINGLE) & (n[doc[begin]] < LEAST))
    begin, size = begin[fit], size[fit]
    if not len(begin):
        return windows, none
    count = size - SHINGLE + 1
    which = np.repeat(np.arange(len(begin)), count)
    places = np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    both = np.unique(which.astype(np.uint64) << np.uint64(32) | shingle[places] >> np.uint64(32))
    sh = both & np.uint64(0xFFFFFFFF)
    offsets = np.searchsorted(both, np.arange(len(begin), dtype=np.uint64) << np.uint64(32))
    least = [np.minimum.reduceat((sh * seed) ^ (sh * seed) >> np.uint64(29), offsets) for seed in _SEEDS]
    bands = np.empty((len(begin), BANDS), np.uint64)
    for k in range(BANDS):
        h = np.full(len(begin), k, np.uint64)
        for r in range(ROWS):
            h = _mix(h * _BASE + least[k * ROWS + r])
        bands[:, k] = h
    whole = _mix(np.add.reduceat(_mix(sh), offsets) + np.diff(np.r_[offsets, len(sh)]).astype(np.uint64))
    t = doc[begin]
    paragraphs = {"text": t, "start": points[s[begin]] - zero[t], "stop": points[e[begin + size - 1]] - zero[t], "content": whole.view(np.int64), "bands": bands.view(np.int64), "offsets": np.r_[offsets, len(sh)], "sh": sh.astype(np.uint32)}
    return windows, paragraphs


def read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The windows (``sh`` is null) and paragraphs of all texts, as ``SCHEMA`` says."""
    arrow = pa.schema([("doc_id", pa.int64()), *[(k, pa.int32()) for k in ("word", "start", "length")], ("content", pa.int64()), ("need", pa.int32()), ("bands", pa.list_(pa.int64())), ("sh", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = 0
            while i < b.num_rows:
                texts, size, j = [], 0, i
                while j < b.num_rows and (size < 1_000_000 or j == i):
                    texts.append(b.column(1)[j].as_py() or b"")
                    size += len(texts[-1])
                    j += 1
                w, p = units(texts)
                ids = b.column(0).slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64)
                ints = lambda x: pa.array(x.astype(np.int32))
                nulls = lambda n, t: pa.nulls(n, t)
                k = len(w["text"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[w["text"]]), ints(w["word"]), ints(w["start"]), ints(w["stop"] - w["start"]), pa.array(w["content"]), ints(w["need"]), nulls(k, pa.list_(pa.int64())), nulls(k, pa.binary())], schema=arrow)
                k = len(p["text"])
                if k:
                    bands = pa.ListArray.from_arrays(pa.array(np.arange(0, k * BANDS + 1, BANDS, dtype=np.int32)), pa.array(p["bands"].ravel()))
                    sh = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer((p["offsets"] * 4).astype(np.int32).tobytes()), pa.py_buffer(p["sh"].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[p["text"]]), nulls(k, pa.int32()), ints(p["start"]), ints(p["stop"] - p["start"]), pa.array(p["content"]), nulls(k, pa.int32()), bands, sh], schema=arrow)
                i = j

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).where("doc_id is not null and t is not null")
    return rows.mapInArrow(run, SCHEMA)


def bucket_links(ids: list[int], sets: list[np.ndarray], side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Tree edges between members (sorted distinct shingle hashes) of that Jaccard similarity or more. Every pair of different components is compared,
    but for pairs within one of two ``side``s where both are present, which another task compares."""
    n = len(ids)
    sizes = np.array([len(x) for x in sets])
    root, out = np.arange(n), []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    mixed = side.min() != side.max()
    for i in range(n - 1):
        a = sets[i]
        lo, hi = np.searchsorted(flat, a, "left"), np.searchsorted(flat, a, "right")
        reps = hi - lo
        met = owner[np.repeat(lo - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())]
        both = np.bincount(met, minlength=n)
        ok = (both >= similarity * (sizes + sizes[i] - both)) & (np.arange(n) > i)
        if mixed:
            ok &= side != side[i]
        for j in np.flatnonzero(ok & (root != root[i])).tolist():
            if root[j] != root[i]:
                out.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
        if (root == root[0]).all():
            break
    return out


def _verify(similarity: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (band, x, y, side, content, sh), those of a band and block pair together, to links."""
        at, ids, sets, side = None, [], [], []

        def solve() -> list[tuple[int, int]]:
            return bucket_links(ids, sets, np.array(side), similarity) if len(ids) > 1 else []

        def batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

        for b in batches:
            for k, x, y, z, c, s in zip(*(v.to_pylist() for v in b.columns), strict=True):
                if (k, x, y) != at:
                    if found := solve():
                        yield batch(found)
                    at, ids, sets, side = (k, x, y), [], [], []
                ids.append(c)
                sets.append(np.frombuffer(s, np.uint32))
                side.append(z)
        yield batch(solve())

    return run


def near_paragraphs(paragraphs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Links (a, b) between contents of different paragraphs; paragraphs: (doc_id, content, bands, sh)."""
    rows = paragraphs.groupBy("content").agg(F.any_value("bands").alias("bands")).select("content", F.explode("bands").alias("band"))
    full = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.least(F.lit(BLOCKS), F.ceil(F.col("n") / CROWDED)).cast("int")
    met = rows.select("band", "content").join(full.select("band", blocks.alias("blocks")), "band")
    # Each block meets every other; a member stands on the side of its own block.
    own = F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int")
    dealt = met.withColumn("own", own).select("band", "content", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "content")
    sets = paragraphs.select("content", "sh").join(met.select("content").distinct(), "content", "left_semi").groupBy("content").agg(F.any_value("sh").alias("sh"))
    checked = dealt.join(sets, "content").select("band", "x", "y", "side", "content", "sh").repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "content")
    return checked.mapInArrow(_verify(similarity), "a long, b long").distinct()


def _merged(spots: DataFrame, place: str, end: F.Column, bridge: int) -> DataFrame:
    """Numbers (``g``) the runs of each document's spots; a spot goes on with the run if it starts less than ``bridge`` after what went before."""
    reach = F.max(end).over(_by(place).rowsBetween(W.unboundedPreceding, -1))
    return spots.withColumn("_new", F.when(F.col(place) < reach + bridge, 0).otherwise(1)).withColumn("g", F.sum("_new").over(_by(place).rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def _by(place: str):  # noqa: ANN202
    return W.partitionBy("doc_id").orderBy(place, "stop")


def repeated(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, passages, spans, removed): a row for each document with passages that other documents hold too.

    class_id is the least doc_id of the component; spans are code points with the least document that holds the span (or a part of it), its
    owner; removed says whether a span of the document belongs to another owner, and would be taken out.
    """
    spark = docs.sparkSession
    found, path = cut(read(docs, id_col, text_col), "passages")
    windows, paragraphs = found.where("sh is null"), found.where("sh is not null")
    held = windows.groupBy("content").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("high")).where("owner < high").select("content", "owner")
    # Two numbers in one column each, for the shuffle's sake.
    packed = windows.select("doc_id", "content", (F.col("word") * F.lit(64).cast("long") + F.col("need")).alias("word"), (F.shiftleft(F.col("start").cast("long"), 32) + F.col("length")).alias("place"))
    spots = packed.join(held, "content").select(
        "doc_id", F.shiftright("word", 6).alias("word"), F.shiftright("place", 32).alias("start"), (F.shiftright("place", 32) + F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))).alias("stop"), F.col("word").bitwiseAND(F.lit(63)).alias("need"), "owner"
    )
    runs = _merged(spots, "word", F.col("word") + UNIT, BRIDGE).groupBy("doc_id", "g").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("owner").alias("owner"), F.max("need").alias("need"), (F.max("word") + UNIT - F.min("word")).alias("words")
    )
    runs = runs.where("words >= need").select("doc_id", "start", "stop", "owner")
    links, near_path = cut(near_paragraphs(paragraphs, similarity), "paragraph-links")
    of = paragraphs.groupBy("content").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    ends = links.select(F.col("a").alias("content"), F.col("b").alias("other")).union(links.select("b", "a"))
    met = ends.join(of.select(F.col("content").alias("other"), F.col("low").alias("their_low"), F.col("high").alias("their_high")), "other")
    kin = met.groupBy("content").agg(F.min("their_low").alias("their_low"), F.max("their_high").alias("their_high"))
    owned = of.join(kin, "content", "left").select("content", F.least("low", "their_low").alias("owner"), F.greatest("high", "their_high").alias("last")).where("owner < last")
    lines = paragraphs.select("doc_id", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("length")).cast("long").alias("stop"), "content").join(owned.select("content", "owner"), "content").drop("content")
    spans, spans_path = cut(_merged(runs.union(lines), "start", F.col("stop"), 0).groupBy("doc_id", "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("owner").alias("owner"), F.collect_set("owner").alias("owners")), "spans")
    near = met.join(of.select("content", "low"), "content").select(F.col("low").alias("a"), F.col("their_low").alias("b"))
    classes, _ = components(spans.select(F.col("doc_id").alias("a"), F.explode("owners").alias("b")).union(near))
    drop(spark, path, near_path)
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "owner")
    each = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("passages"), F.array_sort(F.collect_list(span)).alias("spans"))
    out = each.join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"), "passages", "spans", F.exists("spans", lambda x: x["owner"] != F.col("doc_id")).alias("removed"))


def op1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans are returned as text, ``start:stop:owner`` joined by commas."""
    listed = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["stop"], x["owner"])), ",")
    return repeated(table(spark, sf_dir, "documents")).withColumn("spans", listed)


QUERIES = {"op1_paragraphs": op1_paragraphs}
ORACLES: dict[str, str] = {}
