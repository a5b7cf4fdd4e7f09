"""Deletions under a manifest: right rows, nothing half done, repeatable, and files that go."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crosslight.sources import removal
from crosslight.streaming.filed import file_rows, filed

BASE, DAY = 1_704_067_200, 86_400
ROWS = [(("a", "b")[k % 2], f"e{k}", BASE + k * 7_200) for k in range(60)]  # five days


@pytest.fixture
def table(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, "tenant_id string, event_id string, event_time long")
    file_rows(frame.where("event_time % 14400 = 0"), f"{tmp_path}/t", "event_time", 0, ["tenant_id"])
    file_rows(frame.where("event_time % 14400 <> 0"), f"{tmp_path}/t", "event_time", 1, ["tenant_id"])
    return f"{tmp_path}/t", f"{tmp_path}/audit"


def ids(spark, path):
    return {r.event_id for r in removal.read(spark, path).select("event_id").collect()}


def test_a_purge_takes_a_tenants_range_and_is_noted(spark, table):
    path, audit = table
    start, end = BASE + DAY // 2, BASE + 2 * DAY
    wanted = {i for t, i, at in ROWS if not (t == "a" and start <= at < end)}
    assert removal.purge_range(spark, path, "a", start, end, "asked for", audit, 1) == 60 - len(wanted) and ids(spark, path) == wanted
    assert removal.purge_range(spark, path, "a", start, end, "again", audit, 2) == 0 and ids(spark, path) == wanted
    assert [r.detail for r in spark.read.parquet(audit).orderBy("occurred_at").collect()] == [f'{{"reason": "asked for", "rows": {60 - len(wanted)}}}', '{"reason": "again", "rows": 0}']
    with pytest.raises(ValueError, match="reason"):
        removal.purge_range(spark, path, "a", start, end, " ", audit, 3)
    assert {r.event_id for r in filed(spark, path, 5, BASE, BASE + 9 * DAY).collect()} == wanted  # the stream's reader follows too
    assert removal.vacuum(spark, path) > 0 and ids(spark, path) == wanted
    removal.purge_range(spark, path, "b", start, end, "more", audit, 4)
    assert ids(spark, path) == {i for t, i, at in ROWS if not start <= at < end}


def test_a_crash_before_the_swap_changes_nothing(spark, table, monkeypatch):
    path, audit = table
    monkeypatch.setattr(removal, "swap", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError, match="died"):
        removal.purge_range(spark, path, "a", BASE, BASE + DAY, "x", audit, 1)
    monkeypatch.undo()
    assert ids(spark, path) == {i for _, i, _ in ROWS}
    removal.purge_range(spark, path, "a", BASE, BASE + DAY, "x", audit, 1)
    assert ids(spark, path) == {i for t, i, at in ROWS if not (t == "a" and at < BASE + DAY)}
    with pytest.raises(RuntimeError, match="another deletion"):
        removal.swap(spark, path, 1, {})


def test_retention_by_tenant_and_all(spark, table):
    path, audit = table
    now = BASE + 5 * DAY
    removal.retention_delete(spark, path, {"a": 1, "b": 3}, now, audit)
    limits = {"a": now - DAY, "b": now - 3 * DAY}
    left = {i for t, i, at in ROWS if at >= limits[t]}
    assert ids(spark, path) == left
    hidden = removal.manifest(spark, path)[1]
    assert {d for d, x in hidden.items()} == {f"2024-01-0{k}" for k in (1, 2, 3, 4)}
    assert removal.vacuum(spark, path) == 8 and ids(spark, path) == left
    assert removal.purge_all(spark, path, "closed", audit, now) == len(left) and ids(spark, path) == set()
    file_rows(spark.createDataFrame(ROWS[:1], "tenant_id string, event_id string, event_time long").withColumn("event_time", F.lit(now)), path, "event_time", 2, ["tenant_id"])
    assert ids(spark, path) == {"e0"}
