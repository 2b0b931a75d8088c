"""Maintained totals and dead letters: any split into batches, repeats, restarts, and the sequence of retries."""

from __future__ import annotations

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import QUERIES
from acquimetra.streaming import deadletters, maintained

NOTICE = "entity int, source string, published date, method string, arrived int"
T0 = dt.datetime(2026, 1, 1)


def notices():
    rng = random.Random(3)
    days = [None, *[dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(0, 200, 9)], dt.date(1960, 5, 5)]
    return [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", "b"]), rng.choice(days), rng.choice([None, "hierarchical", "hierarchical", "name", "cnpj"]), i) for i in range(120)] + [(9, "a", None, None, 500), (8, "b", dt.date(1960, 1, 1), "hierarchical", 501)]


def by_trigger(rows, as_of):
    """Row by row, as a trigger would keep the table up."""
    epoch, out = dt.date(1970, 1, 1), {}
    for entity, source, day, method, _ in rows:
        if (entity, source) not in out:
            out[entity, source] = [day, 1, method or "direct"]
        else:
            e = out[entity, source]
            e[0], e[1] = max(e[0] or epoch, day or epoch), e[1] + 1
            if e[2] == "hierarchical":
                e[2] = method or "direct"
    return {k: (last, n, bool(last and last >= as_of - dt.timedelta(days=90)), m) for k, (last, n, m) in out.items()}


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_coverage_after_any_split(spark, tmp_path, size):
    rows, as_of = notices(), dt.date(2026, 6, 1)
    kept = maintained.coverage(spark, str(tmp_path / "c"))
    assert kept.state() is None
    for i in range(0, len(rows), size):
        df = spark.createDataFrame(rows[i : i + size], NOTICE)
        kept.apply(i // size, df)
        if i // size in (1, 2):
            kept.apply(i // size, df)
            kept.compact(i // size - 1)
    got = {(r.entity, r.source): (r.last_seen, r.total, r.covered, r.method) for r in maintained.coverage_of(kept.state(), F.lit(as_of)).collect()}
    assert got == by_trigger(rows, as_of)


def test_newly_linked(spark):
    old = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, entity int")
    new = spark.createDataFrame([(1, 5), (2, 6), (3, 8), (4, 9), (5, None)], "id int, entity int")
    assert sorted((r.id, r.entity) for r in maintained.newly_linked(old, new, "id", "entity").collect()) == [(2, 6), (3, 8), (4, 9)]


def test_hashes(spark, tmp_path):
    rows = [("h1", "a", "r1", 5, 1), ("h1", "b", "r1", 4, 2), ("h2", "a", "r1", 1, 3), (None, "a", "r1", 1, 4), ("h1", "a", "r2", 9, 5), ("h3", "c", "r2", 9, 6), ("h3", "c", "r2", 9, 7)]
    kept, shape = maintained.hashes(spark, str(tmp_path / "h")), "content_hash string, source string, run_id string, at int, id int"
    first, second = (spark.createDataFrame([r for r in rows if r[2] == run], shape) for run in ("r1", "r2"))
    for _ in range(2):  # a batch that runs again answers and counts the same
        assert {r.id: r.duplicate for r in maintained.record(kept, 0, first, ["at", "id"]).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert {r.id: r.duplicate for r in maintained.record(kept, 1, second, ["at", "id"]).collect()} == {5: True, 6: False, 7: True}
    assert {(r.content_hash, r.times, r.first_seen, r.last_seen, r["first"].value.source) for r in kept.state().collect()} == {("h1", 3, 4, 9, "b"), ("h2", 1, 1, 1, "a"), ("h3", 2, 9, 9, "c")}


def failed(spark, *rows):
    return spark.createDataFrame([(s, r, n, T0 + dt.timedelta(minutes=m)) for s, r, n, m in rows], "source string, record string, retry_count int, failed_at timestamp")


def at(days=0, minutes=0):
    return F.lit(T0 + dt.timedelta(days=days, minutes=minutes))


def test_backoff(spark):
    got = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 10, 100)], "n int").select(deadletters.backoff_seconds(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == [60, 300, 900, 3600, 3600, 3600]


def test_sequence(spark, tmp_path):
    d = deadletters.DeadLetters(spark, str(tmp_path / "d"))
    assert d.state().count() == 0 and d.counts().count() == 0 and d.replay(0, at(), "r").count() == 0
    d.push(1, failed(spark, ("a", "x", 0, 3), ("a", "y", 0, 1), ("b", "z", 0, 2)).withColumn("error_message", F.repeat(F.lit("m"), 3000)))
    assert {(r.source, r.status, r.n) for r in d.counts().collect()} == {("a", "pending", 2), ("b", "pending", 1)}
    first = d.replay(2, at(minutes=9), "run1", limit=2).orderBy("failed_at").collect()
    assert [(r.record, r.retry_count, r.replayed_by, len(r.error_message)) for r in first] == [("y", 1, "run1", 2000), ("z", 1, "run1", 2000)]
    assert [(r.record, r.status) for r in d.state().orderBy("record").collect()] == [("x", "pending"), ("y", "replayed"), ("z", "replayed")]
    assert [r.record for r in d.replay(3, at(minutes=3, days=0), "run2", due_only=True).collect()] == []
    assert [r.record for r in d.replay(4, at(minutes=4), "run2", source="a", due_only=True).collect()] == ["x"]
    # y fails again and again: counts 1, 2, 3 come back; with 3 the next replay is one too many.
    for n in (1, 2, 3):
        d.push(3 + 2 * n, failed(spark, ("a", "y", n, 10 * n)))
        got = d.replay(4 + 2 * n, at(days=1), "again").collect()
        assert [r.retry_count for r in got] == ([n + 1] if n < 3 else [])
    dead = d.state().where("status = 'dead'").collect()
    assert [(r.record, r.pushed, r.retry_count, r.replayed_at) for r in dead] == [("y", 3, 4, None)]
    again = deadletters.DeadLetters(spark, str(tmp_path / "d"))  # a restart
    d.compact(12)
    assert sorted(map(str, again.state().collect())) == sorted(map(str, d.state().collect())) and again.state().count() == 6
    again.archive(20, F.col("record") == "z")
    again.purge(21, at(days=90))
    assert again.state().count() == 6
    again.purge(22, at(days=91), source="b")
    assert again.state().count() == 5 and again.counts().where("status = 'dead'").count() == 1
    again.purge(23, at(days=91))
    assert again.state().count() == 4
    again.compact(23)
    assert again.state().count() == 4


def test_drain_is_the_same_after_a_restart(spark, tmp_path):
    rows = failed(spark, *[("a", f"x{i}", 0, i) for i in range(12)])
    results = []
    for runs in (1, 2):
        home, landing = str(tmp_path / f"h{runs}"), str(tmp_path / f"l{runs}")
        parts = [rows] if runs == 1 else [rows.where("record < 'x4'"), rows.where("record >= 'x4'")]
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(landing)
            again = lambda df: df.where("record in ('x1', 'x7')").withColumn("failed_at", F.col("failed_at"))
            deadletters.drain(spark, landing, rows.schema, home, home + "-c", again, lambda n: at(days=n))
        d = deadletters.DeadLetters(spark, home)
        for step in range(100, 110, 2):
            d.push(step + 1, again(d.replay(step, at(days=9), "rest")))
        results.append(sorted((r.record, r.pushed, r.retry_count, r.status) for r in d.state().collect()))
    assert results[0] == results[1] and [r for r in results[0] if r[3] == "dead"] == [("x1", 3, 4, "dead"), ("x7", 3, 4, "dead")] and len(results[0]) == 12 + 6


def test_failures_land_in_files_for_all_tasks(spark, sf_dir, monkeypatch):
    """A micro-batch used to be one file, written by one of two tasks, whatever the number of rows."""
    seen, drain = [], deadletters.drain
    monkeypatch.setattr(deadletters, "drain", lambda s, landing, *a, **k: (seen.append((len(glob.glob(f"{landing.removeprefix('file:')}/part-*")), k["files_per_batch"])), drain(s, landing, *a, **k)))
    assert QUERIES["dead_letters"](spark, sf_dir).count()
    ((files, each),) = seen
    assert files > 2 and each > 1 and each < files
