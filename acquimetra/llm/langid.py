"""Language identification by a byte convolutional network, trained and applied in numpy.

Texts are cut into windows of ``WINDOW`` bytes that cover them whole. Filters of two, three and four bytes slide over embedded
bytes, the maximum over a window feeds a softmax, and a text's posterior is the mean over its windows, weighted by
their bytes. Training takes a bounded sample: about ``per_language`` labelled texts of each language, and of each at most
three windows from a hashed place. For inference the filters are folded into tables over byte pairs, so that each needs at most
two look-ups a byte.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text where nothing was
labelled; ties go to the first language in alphabetical order; repeated rows and null ids are returned each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, table

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 8, 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

Model = dict[str, np.ndarray]


def windows(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte windows of all texts (zero-padded, A-Z lower-cased), the first window of each text, and each window's share of bytes."""
    n = np.array([len(t or b"") for t in texts], np.int64)
    count = np.maximum(1, -(-n // WINDOW))
    first = np.r_[0, np.cumsum(count)[:-1]]
    out = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    used = np.full(int(count.sum()), WINDOW, np.float32)
    for t, f, k, m in zip(texts, first.tolist(), count.tolist(), n.tolist(), strict=True):
        if m:
            out[f * WINDOW : f * WINDOW + m] = np.frombuffer(t, np.uint8)
        used[f + k - 1] = max(1, m - (k - 1) * WINDOW)
    return _LOWER[out].reshape(-1, WINDOW), first, used


def train(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 14, rate: float = 0.01, seed: int = 7) -> Model:
    """Cross-entropy with Adam over windows ``x`` with classes ``y``; classes weigh alike."""
    rng = np.random.default_rng(seed)
    p: Model = {"e": rng.normal(0, 0.5, (256, DIM)), "v": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, classes)), "c": np.zeros(classes)}
    for w in WIDTHS:
        p |= {f"w{w}": rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)), f"b{w}": np.zeros(FILTERS)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    weight = (len(y) / classes / np.maximum(1, np.bincount(y, minlength=classes)))[y].astype(np.float32)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            b = np.arange(len(at))[:, None]
            e, g, hidden, kept = p["e"][x[at]], {k: np.zeros_like(v) for k, v in p.items()}, [], []
            for w in WIDTHS:
                cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(at), WINDOW - w + 1, w * DIM)
                maps = cols @ p[f"w{w}"]
                top = maps.argmax(axis=1)
                hidden.append(np.take_along_axis(maps, top[:, None], 1)[:, 0] + p[f"b{w}"])
                kept.append((w, top, cols[b, top]))
            h = np.maximum(np.concatenate(hidden, axis=1), 0)
            z = h @ p["v"] + p["c"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[b[:, 0], y[at]] -= 1
            q *= weight[at, None] / len(at)
            g["v"], g["c"] = h.T @ q, q.sum(axis=0)
            dh = (q @ p["v"].T) * (h > 0)
            for i, (w, top, cols) in enumerate(kept):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                g[f"b{w}"], g[f"w{w}"] = d.sum(axis=0), np.einsum("bf,bfk->kf", d, cols)
                de = d[:, :, None] * p[f"w{w}"].T[None]
                for j in range(w):
                    np.add.at(g["e"], x[at][b, top + j], de[:, :, j * DIM : (j + 1) * DIM])
            t += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                p[k] -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return p


def folded(p: Model) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """Of each width: a table over the first byte pair, a table over what remains (a byte or a pair), and the bias."""
    out = []
    for w in WIDTHS:
        one = [(p["e"] @ p[f"w{w}"][j * DIM : (j + 1) * DIM]).astype(np.float32) for j in range(w)]
        pair = lambda a, b: np.ascontiguousarray((a[:, None] + b[None]).reshape(-1, FILTERS))
        out.append((pair(one[0], one[1]), None if w == 2 else one[2] if w == 3 else pair(one[2], one[3]), p[f"b{w}"]))
    return out


def posteriors(x: np.ndarray, p: Model, tables: list, step: int = 256) -> np.ndarray:
    """Softmax output of every window."""
    out = np.empty((len(x), len(p["c"])), np.float32)
    for i in range(0, len(x), step):
        part = x[i : i + step]
        pairs = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
        h = []
        for w, (first, rest, bias) in zip(WIDTHS, tables, strict=True):
            maps = first.take(pairs[:, : WINDOW - w + 1], axis=0)
            if rest is not None:
                maps += rest.take(part[:, 2:] if w == 3 else pairs[:, 2:], axis=0)
            h.append(maps.max(axis=1) + bias)
        z = np.maximum(np.concatenate(h, axis=1), 0) @ p["v"] + p["c"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        out[i : i + step] = q / q.sum(axis=1, keepdims=True)
    return out


def fit(labelled: DataFrame, per_language: int = 700, most: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], Model | None]:
    """The ``most`` frequent languages and a network from rows with a text and a language; ids only choose the sample."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("i is not null and t is not null and l is not null")
    rows = rows.where(F.col("t").rlike(r"\p{L}"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(most).collect()}
    langs = sorted(counts)
    if not langs:
        return [], None
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))])
    chosen = rows.where(F.col("l").isin(langs) & (F.pmod(F.xxhash64("i", F.lit("sample")), F.lit(1_000_000)) < share[F.col("l")] * 1_000_000))
    place = F.expr("substring(t, cast(1 + pmod(xxhash64(i), greatest(1, length(t) - 700)) as int), 760)")
    texts = chosen.select("l", place.cast("binary").alias("t")).limit(4 * per_language * len(langs)).toPandas()
    x, first, _ = windows([bytes(t)[: 3 * WINDOW] for t in texts["t"]])
    y = np.repeat(np.searchsorted(langs, texts["l"]), np.diff(np.r_[first, len(x)]))
    return langs, train(x, y, len(langs))


def _judge(texts: list[bytes | None], known: np.ndarray, langs: list[str], model: Model | None, tables: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Label and score of each text; ``known`` are the places of texts with letters."""
    label, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    at = 0
    while tables and at < len(known):
        part, size = [], 0
        while at < len(known) and (size < 2_000_000 or not part):
            part.append(int(known[at]))
            size += len(texts[part[-1]])
            at += 1
        x, first, used = windows([texts[k] for k in part])
        q = posteriors(x, model, tables).astype(np.float64) * used[:, None]
        q = np.add.reduceat(q, first, axis=0)
        q /= q.sum(axis=1, keepdims=True)
        best = q.argmax(axis=1)
        label[part], score[part] = np.array(langs, object)[best], q[np.arange(len(best)), best]
    return label, np.clip(score, 0, 1)


def predict(docs: DataFrame, langs: list[str], model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = folded(model) if model else None
        for b in batches:
            known = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
            label, score = _judge(b.column(1).to_pylist(), known, langs, model, tables)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("t"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double")


def keep(docs: DataFrame, langs: list[str], model: Model | None, least: float, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text has a language with a score of ``least`` or more; all columns stay, and all rows where there is no model."""
    if model is None:
        return docs
    names, (letters,) = docs.columns, fresh(docs, "letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = folded(model) if model else None
        for b in batches:
            known = np.flatnonzero(b.column(letters).to_numpy(zero_copy_only=False))
            texts = [None if x is None else x.encode() for x in b.column(text_col).to_pylist()]
            label, score = _judge(texts, known, langs, model, tables)
            yield b.select(names).filter(pa.array((label != "und") & (score >= least)))

    return docs.withColumn(letters, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that training never sees: crc32 of the id's text leaves 1 at division by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, model = fit(docs.where(~held_out()))
    return predict(docs, langs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_langid": op3_langid}
ORACLES: dict[str, str] = {}
