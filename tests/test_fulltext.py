"""Full-text search: how queries are read, phrases by position, exclusions, paging and defined rows."""

from __future__ import annotations

import math

from __spark_entry__ import QUERIES
from acquimetra.functions.text import ENDINGS
from acquimetra.operators import fulltext as X

SHAPE = "id long, text string, day int, e array<double>, rank int"
DOCS = [
    (1, "Aquisição de materiais de construção para escola municipal", 1, [1.0, 0.0], 0),
    (2, "Construções da escola; material escolar", 2, [0.0, 1.0], 0),
    (3, "Escola municipal em reforma. Escola municipal nova, ESCOLA!", 3, None, 0),
    (4, "nada de interesse", 4, None, 0),
    (5, None, 5, None, 0),
    (6, "", 6, None, 0),
    (None, "escola municipal", 7, None, 0),
]


def rows(spark):
    return spark.createDataFrame(DOCS, SHAPE)


def hits(spark, typed):
    ask = X.free_text(typed)
    return {r.id: r["rank"] for r in X.matches(X.build(rows(spark), "id", "text"), ask, 6).collect()}


def test_queries_are_read():
    assert X.free_text('Escolas "de construção" or reforma -municipal') == X.Ask(((((0, "escol"),),), (((0, "construc"),), ((0, "reform"),))), (((0, "municipal"),),))
    assert X.free_text('"escola da reforma"').all_of == ((((0, "escol"), (2, "reform")),),)
    assert X.free_text("de -escola") is None and X.free_text("") is None and X.free_text('or "') is None


def test_words_phrases_exclusions(spark):
    assert set(hits(spark, "escolas")) == {1, 2, 3} and set(hits(spark, "construção escola")) == {1, 2}
    assert set(hits(spark, '"escola municipal"')) == {1, 3} and set(hits(spark, '"municipal escola"')) == set()
    assert set(hits(spark, '"materiais de construção"')) == {1} and set(hits(spark, "escola -municipal")) == {2}
    assert set(hits(spark, "reforma or aquisição")) == {1, 3} and hits(spark, "zebra") == {}


def test_rank(spark):
    got = hits(spark, "escola reforma or construções")
    idf = lambda df: math.log(1 + 6 / df)
    assert math.isclose(got[3], (1 + 1 / 4 + 1 / 9) * idf(3) + idf(1)) and math.isclose(got[1], idf(3) + idf(2))


def test_index_is_positional(spark):
    got = {(r.term, r.id): r.positions for r in X.build(rows(spark), "id", "text").collect()}
    assert got["escol", 3] == [0, 4, 7] and got["municipal", 3] == [1, 5] and ("de", 1) not in got and not any(i is None for _, i in got)
    only = X.build(rows(spark), "id", "text", ["escol"])
    assert {r.term for r in only.collect()} == {"escol"} and {(r.term, r.df, r.occurrences) for r in X.frequencies(only).collect()} == {("escol", 3, 5)}


def test_find(spark):
    df, ask = rows(spark).drop("rank"), X.any_of(["escola"])
    index = X.build(df, "id", "text")
    ids = lambda **k: [r.id for r in X.find(df, "id", index, ask, 6, **k).collect()]
    assert sorted(ids()) == [1, 2, 3]
    assert ids()[0] == 3 and ids(newest="day")[1:] == [2, 1] and ids(limit=1, offset=1, newest="day") == [2]
    assert ids(least={"day": 2}, most={"day": 2}) == [2] and ids(equal={"id": [1, 4]}) == [1]
    assert ids(or_substring=("text", "NADA DE"))[-1] == 4
    assert sorted(ids(near=("e", [1.0, 0.1], 0.7))) == [1, 3]
    assert [r.id for r in X.find(df, "id", newest="day", limit=2).collect()] == [None, 6]
    assert X.find(df.limit(0), "id", index.limit(0), ask, 0).count() == 0


def test_terms_are_counted_in_one_pass(spark, sf_dir):
    plan = QUERIES["index_terms"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2


def test_only_words_that_can_have_a_wanted_stem_are_stemmed(spark):
    text = "obra obras obramento obramentos obrais obraxx xobra ob Óbras as a " + " ".join("obr" + e for e in ENDINGS.split("|"))
    docs = spark.createDataFrame([(1, text), (2, "nada"), (3, None)], "i long, t string")
    full, part = X.build(docs, "i", "t"), X.build(docs, "i", "t", ["obr", "obra", "ob"])
    rows = lambda df: sorted((r.term, r.id, tuple(r.positions)) for r in df.collect())
    assert rows(part) == [r for r in rows(full) if r[0] in ("obr", "obra", "ob")] and len(rows(part)) >= 2
    assert "obramentos" in part._jdf.queryExecution().optimizedPlan().toString()
