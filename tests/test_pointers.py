"""Look-ups over pointers: tenants apart, whole answers, and how many files they open."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crosslight.operators import pointers

BASE = 1_704_067_200
EVENTS = "tenant_id string, event_id string, event_time long, vendor_request_id string, linked_request_id string, ja4 string, ingest_version long"
RECORDS = "tenant_id string, correlation_id string, window_start long, event_ids array<string>, version long, kind string"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Three days; both tenants have an event of every id, at the same times."""
    path = str(tmp_path_factory.mktemp("pointers"))
    events, records = [], []
    for k in range(90):
        at = BASE + 2_880 * k
        for tenant in ("a", "b"):
            events += [(tenant, f"e{k}", at, f"r{k % 10}", "" if k % 2 else None, f"j{k % 3}", v) for v in ((1, 2) if k % 7 == 0 else (1,))]
            records.append((tenant, f"{tenant}{k // 2}", at - at % 5, [f"e{k}"] if k % 2 == 0 else [f"e{k - 1}", f"e{k}"], 1 + k % 2, "new" if k % 2 else "old"))
    events, records = spark.createDataFrame(events, EVENTS), spark.createDataFrame(records, RECORDS)
    pointers.write_pointers(pointers.event_pointers(events).unionByName(pointers.record_pointers(records)), path, 0, 8)
    return spark.read.parquet(path), events, records, path


def test_an_event_by_its_id(spark, table):
    index, events, _, _ = table
    (row,) = pointers.event_by_id(index, events, "a", "e7", BASE, BASE + 259_200, 8).collect()
    assert (row.tenant_id, row.event_id, row.ingest_version) == ("a", "e7", 2)
    assert pointers.event_by_id(index, events, "c", "e7", BASE, BASE + 259_200, 8).count() == 0
    assert pointers.event_by_id(index, events, "a", "e7", BASE, BASE + 2_880, 8).count() == 0


def test_a_record_by_an_event_stays_with_its_tenant(spark, table):
    index, _, records, _ = table
    at = BASE + 2_880 * 41
    (row,) = pointers.record_of_event(index, records, "b", "e41", at, buckets=8).collect()
    assert (row.tenant_id, row.correlation_id, row.version) == ("b", "b20", 2)
    assert pointers.record_of_event(index, records, "b", "e41", at + 3_600, buckets=8).count() == 0
    assert pointers.record_of_event(index, records, "b", "", 0, buckets=8).count() == 0


def test_records_by_an_identifier(spark, table):
    index, _, records, _ = table
    found = pointers.records_of_identifier(index, records, "a", "vendor_request_id", "r3", BASE, BASE + 259_200, buckets=8).collect()
    assert sorted(r.correlation_id for r in found) == sorted(f"a{k // 2}" for k in range(3, 90, 10)) and {r.version for r in found} == {2}
    late = pointers.records_of_identifier(index, records, "a", "vendor_request_id", "r3", BASE + 172_800, BASE + 259_200, buckets=8)
    assert sorted(r.correlation_id for r in late.collect()) == sorted(f"a{k // 2}" for k in (63, 73, 83))
    assert pointers.records_of_identifier(index, records, "a", "ja4", "none", BASE, BASE + 259_200, buckets=8).count() == 0
    with pytest.raises(ValueError, match="can't be found by"):
        pointers.records_of_identifier(index, records, "a", "verdict", "blocked", BASE, BASE + 1, buckets=8)


def test_records_by_an_identifier_for_many_tenants(spark, table):
    """Every tenant asked for has what its own look-up finds, no other one has any; limits hold for each tenant."""
    index, _, records, _ = table
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "tenant_id string")
    ids = lambda rows: sorted((r.tenant_id, r.correlation_id, r.version) for r in rows.collect())
    for column, value, low, high in (("vendor_request_id", "r3", BASE, BASE + 259_200), ("ja4", "j1", BASE + 50_000, BASE + 120_000), ("ja4", "none", BASE, BASE + 259_200)):
        one = [ids(pointers.records_of_identifier(index, records, t, column, value, low, high, buckets=8)) for t in ("a", "b")]
        assert ids(pointers.records_of_identifier_by_tenant(index, records, asked, column, value, low, high, buckets=8)) == sorted(one[0] + one[1])
        assert ids(pointers.records_of_identifier_by_tenant(index, records, asked.where("tenant_id = 'b'"), column, value, low, high, buckets=8)) == one[1]
    with pytest.raises(ValueError):
        pointers.records_of_identifier_by_tenant(index, records, asked, "vendor", "x", 0, 1)


def test_a_look_up_opens_one_bucket_of_its_days(spark, table):
    index, _, _, path = table
    all_files = len(index.inputFiles())
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = pointers.pointed(index, "a", "record", ["e41"], BASE + 2_880 * 41 - 600, BASE + 2_880 * 41 + 600, 8)
        plan = found._jdf.queryExecution().executedPlan()
        assert found.agg(F.count("*")).count() == 1 and all_files > 50
        plan.execute().count()
        opened = plan.collectLeaves().head().metrics().apply("numFiles").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert opened == 1


def test_a_batch_that_is_written_again_replaces_itself(spark, table):
    index, events, _, path = table
    n = index.count()
    pointers.write_pointers(pointers.event_pointers(events.where("event_time < 1704153600")), path, 0, 8)
    assert spark.read.parquet(path).count() == n
    pointers.write_pointers(pointers.event_pointers(events.limit(3)), path, 1, 8)
    assert spark.read.parquet(path).where("batch = 1").count() > 0


def test_the_query_resolves_an_identifier_for_all_tenants(spark):
    from crosslight.plans.base import events, stored_records
    from crosslight.plans.queries import QUERIES

    from .compare import DATA

    with_it = events(spark, str(DATA)).where("ja4 = 't13d7'").select("tenant_id", "event_id")
    want = stored_records(spark, str(DATA)).select("tenant_id", "correlation_id", F.explode("event_ids").alias("event_id")).join(with_it, ["tenant_id", "event_id"])
    want = {(r.tenant_id, r.correlation_id) for r in want.collect()}
    assert len({t for t, _ in want}) == 3
    assert sorted(r.correlation_id for r in QUERIES["jn_ident_resolve"](spark, str(DATA)).collect()) == sorted(c for _, c in want)
