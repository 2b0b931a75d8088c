"""Source divergence audit: how far the sources of a language differ in their words, and by which words.

Tasks count terms of whole texts and hand on partial counts, which are summed by (lang, source, term). Every term that enough of a language's
documents hold becomes one wide row: its counts as an array indexed by the language's sorted sources. Built-in
higher-order functions turn that array into smoothed shares and emit the contributions of source pairs, which partial
aggregation sums before the shuffle. A pair in which neither source has the term would contribute a constant, so this
constant is taken once for all terms and only its corrections are emitted. All arithmetic is in integers.

Defined results: null text, lang and source are empty strings, and an empty name is a language or source like any other; every row
is a document, so repeated rows count each; a group without terms takes part with zero counts; a language without kept terms has
pairs of value 0 and no terms; equal values rank by the item's bytes; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, drop, table

#: Documents of a language that have to hold a term, the count added to every term, ranks reported of terms.
LEAST_DOCS, SMOOTH, TOP_TERMS = 30, 5, 50
UNIT = 1_000_000_000
#: A task hands its counts on when it holds so many.
FLUSH = 200_000
#: Groups up to which the languages' source lists are broadcast; beyond, they are joined by shuffle.
BROADCAST_GROUPS = 20_000
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
#: Maps A-Z to lower case and every ASCII byte that is no letter to a blank; bytes of longer characters stay.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b in LETTERS or b > 127 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): partial occurrences and document counts; sum them by the first three."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def packed(n: dict, d: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in n.items():
            held = d[lang, source]
            size = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([held[t] for t in counts], pa.int64())],
                names=["lang", "source", "term", "n", "d"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, d, held = defaultdict(Counter), defaultdict(Counter), 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.translate(FOLDED).split()
                counts = n[lang, source]
                before = len(counts)
                counts.update(words)
                d[lang, source].update(set(words))
                held += len(counts) - before
                if held > FLUSH:
                    yield from packed(n, d)
                    n, d, held = defaultdict(Counter), defaultdict(Counter), 0
        yield from packed(n, d)

    return rows.mapInArrow(run, "lang string, source string, term string, n long, d long")


def share(n: Column, base: Column) -> Column:
    """1 + floor(UNIT * n / base) for n <= base, in three steps of a thousand so that long integers hold every product."""
    a, out = n, F.lit(1).cast("long")
    for step in (1_000_000, 1_000, 1):
        a = a * F.lit(1_000).cast("long")
        whole = F.call_function("div", a, base)
        out, a = out + whole * F.lit(step).cast("long"), a - whole * base
    return out


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, held): terms in at least ``least_docs`` documents of a language; held maps the sources that have the term to their counts."""
    by_source = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    whole = by_source.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("held"))
    return whole.where(F.col("d") >= least_docs).select("lang", "term", "total", "held")


def sources_of(docs: DataFrame, terms: DataFrame, smooth: int = SMOOTH) -> DataFrame:
    """(lang, base, groups): of each language the divisor of its shares and its sources in order, each with its name, divisor and share of an absent term."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n"))
    own = terms.select("lang", F.explode("held").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    rows = groups.join(own, ["lang", "source"], "left").join(sizes.withColumnRenamed("n", "lang_n"), "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    base = lambda c: F.col(c) + smooth * F.col("v")
    absent = F.when(F.col("v") > 0, share(F.lit(smooth).cast("long"), base("n")))
    packed = rows.select("lang", "v", base("lang_n").alias("lang_base"), F.struct("source", base("n").alias("base"), absent.alias("absent")).alias("g"))
    return packed.groupBy("lang").agg(F.max("v").alias("v"), F.max("lang_base").alias("lang_base"), F.array_sort(F.collect_list("g")).alias("groups"))


def wide(terms: DataFrame, langs: DataFrame, smooth: int = SMOOTH) -> DataFrame:
    """(lang, term, q, groups, has, p): each term's shares in the whole language and, indexed by source, in each source."""
    has = F.transform("groups", lambda g: F.coalesce(F.try_element_at("held", g["source"]), F.lit(0).cast("long")))
    p = F.zip_with("has", "groups", lambda n, g: F.when(n > 0, share(n + smooth, g["base"])).otherwise(g["absent"]))
    return terms.join(langs, "lang").withColumn("has", has).select("lang", "term", share(F.col("total") + smooth, F.col("lang_base")).alias("q"), "groups", "has", p.alias("p"))


def pair_values(words: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value): both directions of every pair of a language's sources."""
    each = words.select("lang", "groups", "has", "p", F.posexplode("p").alias("i", "pi")).where(F.col("has")[F.col("i")] > 0)
    gap = lambda x, y: F.abs(x - y)
    absent = lambda at: F.col("groups")[at]["absent"]
    # A pair is emitted at the lesser of its places that have the term.
    made = F.transform(
        "p",
        lambda pj, j: F.when((j == F.col("i")) | ((j < F.col("i")) & (F.col("has")[j] > 0)), None).otherwise(gap(F.col("pi"), pj) - gap(absent(F.col("i")), absent(j))),
    )
    parts = each.select("lang", "i", F.posexplode(made).alias("j", "f")).where("f is not null")
    sums = parts.groupBy("lang", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high")).agg(F.sum("f").alias("f"))
    one = langs.select("lang", "v", "groups", F.posexplode("groups").alias("a", "ga")).repartition("lang", "a")
    pairs = one.select("lang", "v", "a", "ga", F.posexplode("groups").alias("b", "gb")).where("a <> b")
    pairs = pairs.select(
        "lang", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), F.col("ga.source").alias("source"), F.col("gb.source").alias("item"),
        F.coalesce(F.col("v") * gap(F.col("ga.absent"), F.col("gb.absent")), F.lit(0).cast("long")).alias("same"),
    )
    return pairs.join(sums, ["lang", "low", "high"], "left").select("lang", "source", "item", (F.col("same") + F.coalesce("f", F.lit(0).cast("long"))).alias("value"))


def term_values(words: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms of which a source has a greater share than its language."""
    each = words.select("lang", F.col("term").alias("item"), "q", F.explode(F.arrays_zip("groups", "has", "p")).alias("x"))
    return each.where("x.has > 0 and x.p > q").select("lang", F.col("x.groups.source").alias("source"), "item", (F.col("x.p") - F.col("q")).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, smooth: int = SMOOTH, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` with every other source of the language, part ``term`` with the ``top_terms`` most telling terms."""
    spark = docs.sparkSession
    terms, terms_path = cut(kept_terms(docs, least_docs), "kept-terms")
    langs, _ = cut(sources_of(docs, terms, smooth), "lang-sources")
    few = langs.agg(F.coalesce(F.sum(F.size("groups")), F.lit(0))).first()[0] <= BROADCAST_GROUPS
    words, _ = cut(wide(terms, F.broadcast(langs) if few else langs.hint("merge"), smooth), "wide-terms")
    drop(spark, terms_path)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = None
    for part, rows, most in (("pair", pair_values(words, langs), None), ("term", term_values(words), top_terms)):
        rows = rows.withColumn("rank", F.row_number().over(ranked))
        rows = (rows if most is None else rows.where(F.col("rank") <= most)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
        out = rows if out is None else out.union(rows)
    return out


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {"op11_divergence": op11_divergence}
ORACLES = {
    "op11_divergence": r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
full_ AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM full_),
q AS (SELECT lang, term, 1 + (1000000000 * (total + 5)::HUGEINT) // (sum(total) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM kept),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
k AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM k WHERE part = 'pair' OR rank <= 50"""
}
