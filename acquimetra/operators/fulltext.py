"""Full-text search on a positional inverted index.

``build`` turns texts into rows (term, id, positions), one for each document and stemmed word; written partitioned by term it serves
every later query, and with ``only`` it keeps just the words of one query before anything is exploded or shuffled. ``matches`` reads the
postings of a query's words and gathers them by document: words and phrases are tested on positions, documents are ranked by
damped term counts times inverse document frequency. ``find`` adds filters on columns, a substring to fall back on, a vector to be near to,
order and paging.

Null and empty texts have no postings; a row with a null id is never found; ids are one document each, so positions of repeated rows lie in one list.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acquimetra.functions.text import ENDINGS, STOPWORDS, fold, folded, stem, stemmed
from acquimetra.functions.vector import cosine

Phrase = tuple[tuple[int, str], ...]


@dataclass(frozen=True)
class Ask:
    """What is looked for: of every group in ``all_of`` one phrase, and none of ``none_of``. A phrase holds (offset, stem) pairs, a word is a phrase of one."""

    all_of: tuple[tuple[Phrase, ...], ...]
    none_of: tuple[Phrase, ...] = ()

    def terms(self) -> list[str]:
        return sorted({t for p in (*[p for g in self.all_of for p in g], *self.none_of) for _, t in p})

    def ranked(self) -> list[str]:
        return sorted({t for g in self.all_of for p in g for _, t in p})


def phrase(text: str) -> Phrase:
    """Stems of a text at their places; stop words keep a place but aren't looked for."""
    words = [w for w in re.split("[^a-z0-9]+", folded(text)) if w]
    made = [(i, stemmed(w)) for i, w in enumerate(words) if w not in STOPWORDS]
    return tuple((i - made[0][0], t) for i, t in made)


def any_of(words: Sequence[str]) -> Ask:
    """At least one of the words or phrases."""
    return Ask((tuple(p for p in map(phrase, words) if p),))


def free_text(text: str) -> Ask | None:
    """As users type it: all words, phrases in double quotes, ``or`` between alternatives, a minus before what must not occur. None if nothing is left to look for."""
    groups, without, joined = [], [], False
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if word.lower() == "or" and not minus:
            joined = bool(groups)
            continue
        p = phrase(quoted or word)
        if not p:
            joined = False
        elif minus:
            without.append(p)
            joined = False
        elif joined:
            groups[-1].append(p)
            joined = False
        else:
            groups.append([p])
    return Ask(tuple(map(tuple, groups)), tuple(without)) if groups else None


def build(docs: DataFrame, id_col: str, text_col: str, only: Sequence[str] | None = None) -> DataFrame:
    """(term, id, positions): sorted places, from 0, of every stem that is no stop word; with ``only`` of these stems."""
    words = F.filter(F.split(fold(F.col(text_col)), "[^a-z0-9]+"), lambda w: w != "")
    placed = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    if only is not None:  # a stem is its word but for one ending at most, so other words need no stemming
        able = [t + e for t in only for e in ("", *ENDINGS.split("|"))]
        placed = F.filter(placed, lambda x: x["word"].isin(*able))
    placed = F.transform(F.filter(placed, lambda x: ~x["word"].isin(*STOPWORDS)), lambda x: F.struct(x["at"].alias("at"), stem(x["word"]).alias("term")))
    if only is not None:
        placed = F.filter(placed, lambda x: x["term"].isin(*only))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(placed).alias("x"))
    return rows.groupBy(F.col("x.term").alias("term"), "id").agg(F.array_sort(F.collect_list("x.at")).alias("positions"))


def frequencies(index: DataFrame) -> DataFrame:
    """(term, df, occurrences, last) of every term; last is the farthest place that it has in a document."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("positions")).alias("occurrences"), F.max(F.get(F.col("positions"), F.size("positions") - 1)).alias("last"))


def _present(p: Phrase, at: dict[str, Column]) -> Column:
    moved = lambda places, by: F.transform(places, lambda x: x - by)
    starts = [moved(at[t], offset) for offset, t in p]
    return F.coalesce(F.size(reduce(F.array_intersect, starts)) > 0, F.lit(False)) if len(p) > 1 else at[p[0][1]].isNotNull()


def damped(tf: Column) -> Column:
    """1 + 1/4 + 1/9 + ... up to ``tf``: later occurrences count less and less."""
    return F.aggregate(F.sequence(F.lit(1), tf), F.lit(0.0), lambda a, j: a + F.lit(1.0) / (j * j))


def matches(index: DataFrame, ask: Ask, n_docs: int | Column) -> DataFrame:
    """(id, rank) of the documents that hold what is asked for."""
    wanted = index.where(F.col("term").isin(*ask.terms()))
    ranked, n = ask.ranked(), n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    idf = wanted.where(F.col("term").isin(*ranked)).groupBy("term").agg(F.log1p(n / F.count(F.lit(1))).alias("idf"))  # a row for each word of the query at most
    rows = wanted.join(F.broadcast(idf), "term", "left")
    name = {t: f"_at{i}" for i, t in enumerate(ask.terms())}
    gathered = rows.groupBy("id").agg(*[F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(c) for t, c in name.items()], F.sum(damped(F.size("positions")) * F.coalesce("idf", F.lit(0.0))).alias("rank"))
    at = {t: F.col(c) for t, c in name.items()}
    test = reduce(and_, [reduce(or_, [_present(p, at) for p in g]) for g in ask.all_of])
    return gathered.where(reduce(and_, [~_present(p, at) for p in ask.none_of], test)).select("id", "rank")


def find(
    docs: DataFrame,
    id_col: str,
    index: DataFrame | None = None,
    ask: Ask | None = None,
    n_docs: int | Column = 1,
    equal: dict[str, Sequence] | None = None,
    least: dict[str, object] | None = None,
    most: dict[str, object] | None = None,
    or_substring: tuple[str, str] | None = None,
    near: tuple[str, Sequence[float], float] | None = None,
    newest: str | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """A page of ``docs`` with a column ``rank``, best first, then ``newest``, then ids.

    Filters that aren't given are no predicates at all. ``or_substring`` (column, text) lets rows in, with rank 0, that hold the text as it
    stands, in any case; ``near`` (column, vector, least cosine) keeps rows at least so near, and rows without a vector.
    """
    out = docs
    for c, vs in (equal or {}).items():
        out = out.where(F.col(c).isin(list(vs)))
    for c, v in (least or {}).items():
        out = out.where(F.col(c) >= v)
    for c, v in (most or {}).items():
        out = out.where(F.col(c) <= v)
    if near is not None:
        c, vector, floor = near
        out = out.where(F.col(c).isNull() | (cosine(F.col(c), F.array(*[F.lit(float(x)) for x in vector])) > floor))
    if ask is None or index is None:
        out = out.withColumn("rank", F.lit(0.0))
    else:
        hits = matches(index, ask, n_docs).withColumnRenamed("id", "_hit")
        out = out.join(hits, F.col(id_col) == F.col("_hit"), "left" if or_substring else "inner")
        if or_substring:
            c, part = or_substring
            out = out.where(F.col("_hit").isNotNull() | F.contains(F.lower(F.col(c)), F.lower(F.lit(part))))
        out = out.withColumn("rank", F.coalesce("rank", F.lit(0.0))).drop("_hit")
    order = [F.desc("rank"), *([F.desc_nulls_last(newest)] if newest else []), F.asc(id_col)]
    return out.orderBy(*order).offset(offset).limit(limit)
