"""Rollups' states: equal sets give equal counts, however they came about."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from crosslight.operators import rollups
from crosslight.plans.base import raw
from crosslight.plans.queries import ORACLE, QUERIES

from .compare import connection, difference

LARGER = Path("/root/testdata/sf0.01")


def test_estimates_do_not_depend_on_the_order_of_ids(spark):
    """3,000 ids forwards, backwards, out of ten buckets and with redeliveries; a small set stays exact."""
    ids = spark.range(0, 3_000, 1, 1).select(F.lit("t").alias("tenant_id"), F.lit("f5").alias("vendor"), F.concat(F.lit("e"), "id").alias("event_id"), F.col("id").alias("event_time"))
    counted = lambda rows, width=3_000: rollups.estimated(rollups.states(rows, "volume", width), "volume").first()["events"]
    backwards = ids.withColumn("event_time", 2_999 - F.col("event_time")).withColumn("event_id", F.concat(F.lit("e"), "event_time"))
    once = counted(ids)
    assert counted(backwards) == once and counted(ids, 300) == once and counted(ids.unionByName(backwards)) == once
    assert abs(once - 3_000) <= 150 and counted(ids.where("event_time < 40")) == 40


@pytest.mark.skipif(not LARGER.exists(), reason="needs the larger tables")
def test_rebuilt_states_on_larger_tables(spark):
    """Totals of more ids than a small set keeps, in many buckets: rebuilt sets are exact, rebuilt sketches equal those that were never lost."""
    assert not difference(spark, QUERIES["backfill_rollup"], ORACLE["backfill_rollup"], connection(LARGER), LARGER)
    rows = raw(spark, str(LARGER))
    low, high = rows.agg(F.min("event_time"), F.max("event_time") + 1).first()
    live, middle = rollups.states(rows, "volume"), (low + high) // 2
    back = rollups.rebuilt(live.where(F.col("bucket") < middle), rows, "volume", middle - 3_600, high)
    total = lambda found: {(r.tenant_id, r.vendor): r.events for r in found.collect()}
    exact, estimated = total(QUERIES["backfill_rollup"](spark, str(LARGER))), total(rollups.estimated(back, "volume"))
    assert estimated == total(rollups.estimated(live, "volume"))
    assert exact.keys() == estimated.keys() and all(abs(estimated[k] - exact[k]) <= 0.05 * exact[k] for k in exact)


def test_a_backfill_returns_the_rollups_own_exact_counts(spark, monkeypatch):
    """The query's figures are those of the rebuilt rollup: where the rebuilding loses rows, they change."""
    from .compare import DATA

    whole = {tuple(r) for r in QUERIES["backfill_rollup"](spark, str(DATA)).select("tenant_id", "vendor", "events").collect()}
    assert not difference(spark, QUERIES["backfill_rollup"], ORACLE["backfill_rollup"], connection())
    made = rollups.members
    monkeypatch.setattr(rollups, "members", lambda rows, *a: made(rows, *a).where("vendor <> 'f5' OR member NOT LIKE '%7'"))
    lost = {tuple(r) for r in QUERIES["backfill_rollup"](spark, str(DATA)).select("tenant_id", "vendor", "events").collect()}
    assert {r[1] for r in whole - lost} == {"f5"}


def test_rebuilt_members(spark):
    """Lost, wrong and repeated rows of a range are mended; what lies outside stays, wrong or not."""
    rows = spark.createDataFrame([("t", f"e{k}", k, "f5") for k in (0, 299, 300, 599, 600, 899)] * 2, "tenant_id string, event_id string, event_time long, vendor string")
    stored = spark.createDataFrame([("t", 0, "f5", "old"), ("t", 300, "f5", "wrong")], "tenant_id string, bucket long, vendor string, member string")
    found = rollups.rebuilt_members(stored, rows, "volume", 450, 601)
    assert sorted((r.bucket, r.member) for r in found.collect()) == [(0, "old"), (300, "e300"), (300, "e599"), (600, "e600"), (600, "e899")]
    assert [tuple(r) for r in rollups.counted(found, "volume").collect()] == [("t", "f5", 5)]
    assert rollups.counted(rollups.members(rows.limit(0), "volume"), "volume").count() == 0


def test_totals_stay_within_five_percent_where_smaller_sketches_did_not(spark):
    """Sets of 40,000 ids that sketches of 2^12 places put more than 5 % off."""
    rows = spark.range(0, 120_000, 1, 4).select(
        F.lit("t").alias("tenant_id"), F.element_at(F.array(F.lit("100"), F.lit("1896"), F.lit("2251")), (F.col("id") % 3 + 1).cast("int")).alias("vendor"), F.floor(F.col("id") / 3).alias("k")
    )
    rows = rows.withColumn("event_id", F.concat_ws("-", F.lit("e"), "vendor", "k")).withColumn("event_time", F.col("k"))
    counts = {r.vendor: r.events for r in rollups.estimated(rollups.states(rows, "volume"), "volume").collect()}
    assert len(counts) == 3 and all(abs(n - 40_000) <= 2_000 for n in counts.values())


def test_states_filed_with_fewer_places_are_united_too(spark):
    rows = spark.createDataFrame([("t", f"e{k}", k, "f5") for k in range(50)], "tenant_id string, event_id string, event_time long, vendor string")
    older = rows.where("event_time < 30").groupBy("tenant_id", F.lit(0).alias("bucket"), "vendor").agg(F.hll_sketch_agg("event_id", F.lit(12)).alias("state"))
    assert rollups.estimated(older.unionByName(rollups.states(rows.where("event_time >= 20"), "volume")), "volume").first()["events"] == 50
