"""Search over records: optional filters, keyword rank, trigram and vector similarity, stable paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acquimetra.functions.text import fold, jaccard, trigrams
from acquimetra.functions.vector import cosine


def all_keywords(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & c.ilike(f"%{w}%")
    return out


def any_keyword(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.ilike(f"%{w}%")
    return out


def keyword_rank(c: Column, words: Sequence[str]) -> Column:
    """How often the words stand in the folded text, each as a word of its own."""
    x = F.concat(F.lit(" "), F.regexp_replace(fold(c), "[^a-z0-9]+", "  "), F.lit(" "))
    n = lambda t, w: ((F.length(t) - F.length(F.replace(t, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("int")
    # Through an array of one, so that the text is folded once for all words.
    return F.get(F.transform(F.array(x), lambda t: sum((n(t, w) for w in words), F.lit(0))), F.lit(0))


def search(df: DataFrame, text_col: str, id_col: str, words: Sequence[str], equal: dict[str, Sequence] | None = None, least: dict[str, object] | None = None, most: dict[str, object] | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Rows that pass the given filters (absent ones are no predicates at all) and hold a keyword, best first, ids break ties."""
    out = df
    for c, vs in (equal or {}).items():
        out = out.where(F.col(c).isin(list(vs)))
    for c, v in (least or {}).items():
        out = out.where(F.col(c) >= v)
    for c, v in (most or {}).items():
        out = out.where(F.col(c) <= v)
    out = out.withColumn("rank", keyword_rank(F.col(text_col), words) if words else F.lit(0))
    return (out.where("rank > 0") if words else out).orderBy(F.desc("rank"), id_col).offset(offset).limit(limit)


def trigram_search(df: DataFrame, text_col: str, id_col: str, query: str, least: float = 0.3, limit: int = 20) -> DataFrame:
    sim = jaccard(trigrams(F.col(text_col)), trigrams(F.lit(query)))
    return df.withColumn("similarity", sim).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), id_col).limit(limit)


def vector_search(df: DataFrame, vector_col: str, id_col: str, query: Sequence[float], least: float = 0.0, limit: int = 20) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("similarity", cosine(F.col(vector_col), q)).where(F.col("similarity") > least).orderBy(F.desc("similarity"), id_col).limit(limit)
