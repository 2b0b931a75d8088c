"""SentencePiece encoding and decoding by suffix-array matching.

Words that a worker hasn't met yet are joined to one text and sorted by suffix, as deep as the longest piece. Every piece is then found by
binary search as a range of suffixes, and each suffix in a range is an edge from where it starts to where the piece ends. Edges are sorted
by position and relaxed word by word: for a unigram model the best path is kept at each position, for a merge model (byte-pair
encoding) the edge with the best score among neighbouring symbols replaces them until none is left, which is what the model's
own rule asks for. Characters outside the vocabulary become bytes. No piece of the vocabulary may hold a word mark after
another character, so words are encoded on their own and remembered, within bounds. The model's pieces are read once by the driver and sent
to the workers, for which the vocabulary's fixed size is the bound.

Defined results: null and empty texts have no pieces; a text that holds the word mark itself decodes with a space there, as the
format has it, and is marked lossy; repeated rows and null ids are returned each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

MARK, MODEL = "▁", "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, KEPT, LONG = 400_000, 600_000, 64


@dataclass(frozen=True)
class Vocabulary:
    """What a model file says: normal pieces with ids and scores, byte pieces, and the rules that this module supports."""

    ids: dict[str, int]
    scores: dict[int, float]
    of_byte: tuple[int, ...]
    unknown: int
    texts: tuple[bytes, ...]
    unigram: bool
    prefix: bool
    longest: int = field(default=0)


def load(path: str = MODEL) -> Vocabulary:
    """Reads a model with identity normalization and byte fallback."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n, t = m.normalizer_spec, m.trainer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or not t.byte_fallback or t.model_type not in (1, 2):
        raise ValueError("a model with rules that are not supported")
    ids, scores, of_byte, texts, unknown = {}, {}, [0] * 256, [], 0
    for i, p in enumerate(m.pieces):
        plain = p.type in (1, 4)
        texts.append(p.piece.replace(MARK, " ").encode() if plain else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"")
        if plain:
            ids[p.piece], scores[i] = i, p.score
            if MARK in p.piece.lstrip(MARK) or "\n" in p.piece:
                raise ValueError("a piece that runs over the end of a word")
        elif p.type == 6:
            of_byte[int(p.piece[3:5], 16)] = i
        elif p.type == 2:
            unknown = i
    return Vocabulary(ids, scores, tuple(of_byte), unknown, tuple(texts), t.model_type == 1, n.add_dummy_prefix, max(map(len, ids)))


def suffixes(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``codes`` sorted by what follows, as far as ``depth`` codes, by prefix doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    have = 1
    while True:
        if have >= depth:
            return np.argsort(rank, kind="stable")
        after = np.zeros_like(rank)
        after[:-have] = rank[have:]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        have *= 2


class Encoder:
    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        names = np.array([p for p in v.ids if len(p) > 1 or v.unigram])
        self.names, self.length = names, np.char.str_len(names)
        self.order = np.array([v.ids[p] for p in names.tolist()])
        self.known: dict[str, tuple[int, ...]] = {}
        single = sorted(p for p in v.ids if len(p) == 1)
        self.chars, self.char_ids = np.array([ord(p) for p in single], np.uint32), np.array([v.ids[p] for p in single])
        score = np.full(len(v.texts), -np.inf)
        score[list(v.scores)] = list(v.scores.values())
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)  # equal scores, equal ranks

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and id of every occurrence of a piece, by start; a text far beyond ``CHUNK`` in parts that overlap by the longest piece."""
        if len(text) > 2 * CHUNK:
            parts = []
            for at in range(0, len(text), CHUNK):
                start, length, ids = self.edges(text[at : at + CHUNK + self.v.longest])
                own = start < CHUNK
                parts.append((start[own] + at, length[own], ids[own]))
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        depth = self.v.longest
        sa = suffixes(codes, depth)
        keys = np.lib.stride_tricks.sliding_window_view(np.r_[codes, np.zeros(depth, np.uint32)], depth)[sa]
        keys = np.ascontiguousarray(keys).view(f"<U{depth}").ravel()
        lo = np.searchsorted(keys, self.names)
        hi = np.searchsorted(keys, np.char.add(self.names, chr(0x10FFFF)))
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        start = sa[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        by = np.argsort(start, kind="stable")
        return start[by], self.length[which[by]], self.order[which[by]]

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not known; a NUL, which no piece holds, keeps them apart."""
        at = 0
        while at < len(words):
            part, size = [], 0
            while at < len(words) and (size < CHUNK or not part):
                part.append(words[at])
                size += len(words[at]) + 1
                at += 1
            text = "\0".join(part) + "\0"
            start, length, ids = self.edges(text)
            begin = np.r_[0, np.cumsum([len(w) + 1 for w in part])]
            relax = self.best_path if self.v.unigram else self.merged
            first = self.safe(begin, start, length)
            stop = np.r_[first[1:], len(text)]
            stop -= np.isin(stop, begin[1:])  # what keeps words apart belongs to none
            slow, found = np.arange(len(first)), {}
            if not self.v.unigram:
                slow = self.merge_all(text, first, stop, start, length, ids, found)
            for k in slow.tolist():
                a, b = np.searchsorted(start, (first[k], stop[k]))
                found[k] = relax(text[first[k] : stop[k]], (start[a:b] - first[k]).tolist(), length[a:b].tolist(), ids[a:b].tolist())
            ends = np.searchsorted(first, begin).tolist()
            for w, a, b in zip(part, ends, ends[1:], strict=False):
                self.known[w] = found[a] if b == a + 1 else tuple(chain.from_iterable(found[k] for k in range(a, b)))

    def safe(self, begin: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Where words begin, and in words of more than ``LONG`` characters every place that no piece runs over: what stands on both sides is encoded on its own."""
        long = np.flatnonzero(np.diff(begin) - 1 > LONG)
        if not len(long):
            return begin[:-1]
        over = np.zeros(begin[-1] + 1, np.int64)
        many = length > 1
        np.add.at(over, start[many] + 1, 1)
        np.add.at(over, start[many] + length[many], -1)
        free = np.flatnonzero(np.cumsum(over)[:-1] == 0)
        word = np.searchsorted(begin, free, side="right") - 1
        inner = np.isin(word, long) & (free < begin[word + 1] - 1)
        return np.union1d(begin[:-1], free[inner])

    def merge_all(self, text: str, first: np.ndarray, stop: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray, found: dict[int, tuple[int, ...]]) -> np.ndarray:
        """Merges in all stretches at once, one edge a stretch and round: the same rule as ``merged``. Returns the places of those that are left to that: long ones and those with bytes."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n, width = len(codes), self.v.longest + 1
        at = np.searchsorted(self.chars, codes)
        name = np.where(self.chars[np.minimum(at, len(self.chars) - 1)] == codes, self.char_ids[np.minimum(at, len(self.chars) - 1)], -1)
        edge = np.full((n, width), -1, np.int32)
        edge[start, length] = ids
        none, shift = np.int64(1 << 62), np.int64(n).item().bit_length()
        begin = np.r_[first, n]
        end_of = np.repeat(stop, np.diff(begin))  # of the stretch at each place
        end, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        before[first] = -1
        inside = np.arange(n) < end_of

        def key(s: np.ndarray, e: np.ndarray) -> np.ndarray:
            """What a merge to [s, e) is worth, least first: its rank, then its place."""
            ok = e - s < width
            i = np.where(ok, edge[s, np.where(ok, e - s, 0)], -1)
            return np.where(i >= 0, (self.rank[i] << shift) | s, none)

        value = np.full(n, none)
        two = np.flatnonzero(inside & (np.arange(n) + 1 < end_of))
        value[two] = key(two, two + 2)
        bad = np.logical_or.reduceat((name < 0) & inside, first) | (stop - first > LONG)
        value[np.repeat(bad, np.diff(begin))] = none
        while True:
            least = np.minimum.reduceat(value, first)
            s = least[least < none] & ((1 << shift) - 1)
            if not len(s):
                break
            mid = end[s]
            e = end[mid]
            name[s] = edge[s, e - s]
            end[s], inside[mid], value[mid], value[s] = e, False, none, none
            more = e < end_of[s]
            before[e[more]] = s[more]
            value[s[more]] = key(s[more], end[e[more]])
            p = before[s]
            has = p >= 0
            value[p[has]] = key(p[has], e[has])
        shown = np.flatnonzero(inside)
        got, cuts = name[shown].tolist(), np.searchsorted(shown, begin).tolist()
        for k in np.flatnonzero(~bad).tolist():
            found[k] = tuple(got[cuts[k] : cuts[k + 1]])
        return np.flatnonzero(bad)

    def symbol(self, c: str) -> tuple[int, ...]:
        i = self.v.ids.get(c)
        return (i,) if i is not None else tuple([self.v.of_byte[b] for b in c.encode("utf-8", "surrogatepass")])

    def merged(self, word: str, start: list[int], length: list[int], ids: list[int]) -> tuple[int, ...]:
        """Best-scored edge first, then leftmost; an edge counts when two neighbouring symbols are its halves."""
        n, score = len(word), self.v.scores
        edge = {(s, s + m): i for s, m, i in zip(start, length, ids, strict=True)}
        end, before, name = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        todo = [(-score[i], s, s + 2) for (s, e), i in edge.items() if e == s + 2]
        heapq.heapify(todo)
        while todo:
            _, s, e = heapq.heappop(todo)
            mid = end[s]
            if mid <= s or mid >= e or end[mid] != e:
                continue
            end[s], end[mid], name[s] = e, -1, edge[s, e]
            if e < n:
                before[e] = s
                if (i := edge.get((s, end[e]))) is not None:
                    heapq.heappush(todo, (-score[i], s, end[e]))
            if (p := before[s]) >= 0 and (i := edge.get((p, e))) is not None:
                heapq.heappush(todo, (-score[i], p, e))
        out, s = [], 0
        while s < n:
            out += (name[s],) if name[s] >= 0 else self.symbol(word[s])
            s = end[s]
        return tuple(out)

    def best_path(self, word: str, start: list[int], length: list[int], ids: list[int]) -> tuple[int, ...]:
        """Highest sum of scores; a character without a piece costs as the model has it, ten below the least score."""
        n, low = len(word), min(self.v.scores.values()) - 10
        best: list[tuple[float, int, tuple[int, ...]]] = [(0.0, 0, ())] + [(-np.inf, 0, ())] * n
        k = 0
        for s in range(n):
            here, single = best[s][0], False
            while k < len(start) and start[k] == s:
                e, v = s + length[k], here + self.v.scores[ids[k]]
                single |= length[k] == 1
                if v > best[e][0]:
                    best[e] = (v, s, (ids[k],))
                k += 1
            if not single and here + low > best[s + 1][0]:
                best[s + 1] = (here + low, s, self.symbol(word[s]))
        out: list[tuple[int, ...]] = []
        while n:
            out.append(best[n][2])
            n = best[n][1]
        return tuple([i for x in reversed(out) for i in x])

    @staticmethod
    def split(text: str, prefix: bool) -> list[str]:
        """Words with their marks; a line break stands alone."""
        out: list[str] = []
        for k, line in enumerate(((MARK if prefix else "") + text.replace(" ", MARK)).split("\n") if text else []):
            if k:
                out.append("\n")
            first, *rest = line.split(MARK)
            if "" not in rest:
                if first:
                    out.append(first)
                out += [MARK + w for w in rest]
                continue
            if first:
                out.append(first)
            marks = ""
            for w in rest:
                marks += MARK
                if w:
                    out.append(marks + w)
                    marks = ""
            if marks:
                out.append(marks)
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self.known) > KEPT:
            self.known.clear()
        words = [self.split(t, self.v.prefix) for t in texts]
        new: set[str] = set()
        new.update(*words)
        self.learn(sorted(new.difference(self.known)))
        of = self.known.__getitem__
        return [list(chain.from_iterable(map(of, ws))) for ws in words]

    def decode(self, ids: list[int]) -> str:
        texts = self.v.texts
        whole = b"".join([texts[i] for i in ids]).decode("utf-8", "replace")
        return whole[1:] if self.v.prefix and whole[:1] == " " else whole


#: The worker's encoder, with the words it has met.
_ENCODERS: list[Encoder] = []


def encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, n_bytes, ids_sha256, decoded_sha256, lossless[, ids]); n_bytes counts byte pieces, digests are of little-endian 32-bit ids and of UTF-8."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        if not _ENCODERS or _ENCODERS[0].v != v:
            _ENCODERS[:] = [Encoder(v)]
        encoder = _ENCODERS[0]
        byte = np.zeros(len(v.texts), bool)
        byte[list(v.of_byte)] = True
        for b in batches:
            at = 0
            while at < b.num_rows:
                texts, size, end = [], 0, at
                while end < b.num_rows and (size < 2_000_000 or end == at):
                    texts.append(b.column(1)[end].as_py() or "")
                    size += len(texts[-1])
                    end += 1
                rows, lists = [], []
                for t, ids in zip(texts, encoder.encode(texts), strict=True):
                    a, back = np.array(ids, "<i4"), encoder.decode(ids)
                    rows.append((len(a), int(byte[a].sum()) if len(a) else 0, hashlib.sha256(a.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == t))
                    if keep_ids:
                        lists.append(a)
                cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), *cols, *([pa.array(lists, pa.list_(pa.int32()))] if keep_ids else [])], names=["id", "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256", "lossless"] + ["ids"] * keep_ids)
                at = end

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string, lossless boolean" + ", ids array<int>" * keep_ids)


def decoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(id, text) of rows with id and ids."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        texts = v.texts
        for b in batches:
            out = []
            for ids in b.column(1).to_pylist():
                t = b"".join([texts[i] for i in ids or []]).decode("utf-8", "replace")
                out.append(t[1:] if v.prefix and t[:1] == " " else t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])

    return rows.select("id", "ids").mapInArrow(run, "id long, text string")


def op7_pieces(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), load(model), keep_ids=False).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_pieces": op7_pieces}
ORACLES: dict[str, str] = {}
