"""A monitoring cycle and operational lists, by hand."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from acquimetra.operators import monitor as M

NOW = dt.datetime(2026, 7, 17, 12)


def test_cycle(spark):
    now = spark.createDataFrame([(1, "open", None, "A"), (2, "CLOSED", None, " "), (3, "open", "suspensao", "A"), (4, "", None, None), (5, "new", "other", "B"), (None, "x", None, "B")], "id int, status string, event string, agency string")
    old = spark.createDataFrame([(1, "OPEN"), (2, "open"), (4, "open"), (9, "open")], "id int, status string")
    assert {r.id for r in M.new_rows(now, old).collect()} == {3, 5}
    assert {tuple(r) for r in M.status_changes(now, old).collect()} == {(2, "STATUS_CHANGE", "open", "CLOSED"), (3, "SUSPENSAO", None, "OPEN")}
    contracts = spark.createDataFrame([(1, "A", "S", NOW.date() + dt.timedelta(90)), (2, "C", " ", NOW.date() + dt.timedelta(181)), (3, None, "S", None), (4, "A", None, NOW.date() + dt.timedelta(180))], "cid int, agency string, supplier string, ends date")
    assert {(r.cid, r.days_left) for r in M.ending(contracts, "ends", F.lit(NOW.date())).collect()} == {(1, 90), (4, 180)}
    assert {tuple(r) for r in M.panorama(now, contracts).collect()} == {("agency", "A", 4), ("agency", "B", 2), ("agency", "C", 1), ("agency", "UNKNOWN", 3), ("supplier", "S", 2)}
    got = {r.metric: tuple(r)[1:] for r in M.variation(M.metrics(a=now, b=old, c=old.limit(0)), M.metrics(a=old, c=old.limit(0), d=old)).collect()}
    assert got == {"a": (4, 6, 2, 50.0), "b": (None, 4, None, None), "c": (0, 0, 0, None), "d": (4, None, None, None)}


def test_lists(spark):
    ago = lambda h: NOW - dt.timedelta(hours=h)
    rows = [(1, "a", "running", ago(3), None, None), (2, "a", "running", ago(1), None, None), (3, "a", "running", None, None, None), (4, "a", "failed", ago(30), ago(25), "boom"), (5, "a", "failed", ago(3), ago(2), None), (6, "a", "completed", ago(40), ago(39), None), (7, "a", "completed", ago(50), None, "late"), (8, "b", "completed", ago(2), ago(1), None), (9, "b", "completed", ago(90), ago(89), None), (10, "c", "completed", ago(26), None, None)]
    runs = spark.createDataFrame(rows, "id int, source string, status string, started timestamp, finished timestamp, error string")
    got = {(r.id, r.reason) for r in M.stale_runs(runs, F.lit(NOW)).collect()}
    assert got == {(1, "stuck_running_gt_2h"), (3, "running_no_finish"), (4, "failed_stale_gt_24h"), (6, "latest_completed_older_than_24h"), (10, "latest_completed_older_than_24h")}
    assert {(r.source, r.blocker, r.n, r.detail) for r in M.blockers(runs).collect()} == {("a", "ingestion_failed", 2, "boom"), ("a", "ingestion_completed", 1, "late")}
    entities = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, None)], "id int, root string")
    covering = spark.createDataFrame([(1, "x"), (None, "r2")], "e int, r string")
    assert {(r.id, r.gap_reason) for r in M.uncovered(entities, covering, {"id": "e", "root": "r"}, "gap").collect()} == {(3, "gap")}
