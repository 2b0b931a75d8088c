"""Full-text search over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acquimetra.catalog import query
from acquimetra.functions import text as T
from acquimetra.operators import fulltext as X
from acquimetra.sources.tables import Tables

_FOLD = f"replace(translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}'), 'ß', 'ss')"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_POSTINGS = f"""w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(string_split(regexp_replace({_FOLD}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS l FROM documents)),
p AS (SELECT doc_id, pos, regexp_replace(word, '^(.{{3,}}?)(?:{T.ENDINGS})$', '\\1') AS term FROM w WHERE word NOT IN ({_STOP}))"""
#: Words, a phrase, an alternative and an exclusion, as a user would type them.
TYPED = '"that was" or "was for" with -on'
#: The same spelled out for SQL: in the stems that the library's rule gives these words.
_HITS = """tf AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL),
idf AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM tf WHERE term IN ('that', 'was', 'for', 'with') GROUP BY term),
pairs AS (SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE (a.term = 'that' AND b.term = 'was') OR (a.term = 'was' AND b.term = 'for')),
h AS (SELECT doc_id, sum(idf * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j)))) AS rank FROM tf JOIN idf USING (term)
 WHERE doc_id IN (SELECT doc_id FROM pairs) AND doc_id IN (SELECT doc_id FROM tf WHERE term = 'with') AND doc_id NOT IN (SELECT doc_id FROM tf WHERE term = 'on') GROUP BY doc_id)"""


@query("index_terms", f"WITH {_POSTINGS}, g AS (SELECT term, doc_id, count(*) AS n, max(pos) AS last FROM p GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS occurrences, CAST(max(last) AS INTEGER) AS last FROM g GROUP BY term")
def index_terms(spark: SparkSession, d: str) -> DataFrame:
    return X.frequencies(X.build(Tables(spark, d).documents, "doc_id", "text"))


@query("text_search", f"WITH {_POSTINGS}, {_HITS} SELECT doc_id, round(rank, 6) AS rank FROM h")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    docs = Tables(spark, d).documents
    ask = X.free_text(TYPED)
    return X.matches(X.build(docs, "doc_id", "text", ask.terms()), ask, docs.count()).select(F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query("hybrid_search", f"""WITH {_POSTINGS}, {_HITS}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = (SELECT min(vec_id) FROM v)),
r AS (SELECT d.doc_id, d.lang, d.source, round(coalesce(h.rank, 0), 6) AS rank FROM documents d LEFT JOIN h USING (doc_id) LEFT JOIN v ON v.vec_id = d.doc_id
 WHERE lang IN ('en', 'de', 'fr') AND n_chars >= 100 AND n_chars <= 20000 AND (h.doc_id IS NOT NULL OR contains(lower(text), 'token =')) AND (v.e IS NULL OR list_cosine_similarity(v.e, (SELECT e FROM q)) > -0.2))
SELECT doc_id, lang, source, rank FROM r ORDER BY rank DESC, source DESC, doc_id LIMIT 200 OFFSET 3""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    docs, vectors = t.documents, t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    ask = X.free_text(TYPED)
    vector = vectors.orderBy("vec_id").first()["e"]
    rows = docs.join(vectors, docs["doc_id"] == vectors["vec_id"], "left")
    page = X.find(
        rows, "doc_id", X.build(docs, "doc_id", "text", ask.terms()), ask, docs.count(), {"lang": ["en", "de", "fr"]}, {"n_chars": 100}, {"n_chars": 20_000}, or_substring=("text", "token ="), near=("e", vector, -0.2), newest="source", limit=200, offset=3
    )
    return page.select("doc_id", "lang", "source", F.round("rank", 6).alias("rank"))
