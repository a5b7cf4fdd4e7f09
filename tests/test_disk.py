"""What building the stored tables leaves on disk and deals out."""

from __future__ import annotations

from crosslight.operators import correlate, pointers
from crosslight.operators.components import cut
from crosslight.plans import base, queries

from .compare import DATA


def shuffled(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_a_built_table_leaves_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(base, "_kept", {})
    setting = spark.conf.get(base.FREED)
    # Spark's own collection of garbage may take older files meanwhile; new ones are what counts.
    before = shuffled(spark)
    assert base.stored_records(spark, str(DATA)).count() > 0
    left = {name for name in shuffled(spark) - before if name.endswith(".data")}
    assert len(left) <= 3, left  # those of the count itself and of the look at the input's state
    assert spark.conf.get(base.FREED) == setting


def test_events_are_dealt_out_by_group_once(spark):
    """Both steps of making records go on in the tasks that the events were dealt to."""
    rows = cut(correlate.grouped(base.events(spark, str(DATA))))
    plan = correlate.records_of(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1, plan


def test_pointers_are_shuffled_once_as_they_are_written(spark, tmp_path):
    rows = cut(base.raw(spark, str(DATA)))
    records = spark.createDataFrame([("a", "r1", 5, ["e1", "e2", "e1"]), ("a", "r1", 5, ["e1", "e3"])], "tenant_id string, correlation_id string, window_start long, event_ids array<string>")
    for name, found, wanted in (("events", pointers.event_pointers(rows), None), ("ids", pointers.event_pointers(rows, ("event",)), rows.select("tenant_id", "event_id").distinct().count()), ("records", pointers.record_pointers(records), 3)):
        first = spark._jsc.sc().newShuffleId()
        pointers.write_pointers(found, f"{tmp_path}/{name}", buckets=2)
        assert spark._jsc.sc().newShuffleId() - first == 2, name
        stored = spark.read.parquet(f"{tmp_path}/{name}")
        assert stored.count() == stored.distinct().count() and (wanted is None or stored.count() == wanted)


def test_an_event_is_looked_up_without_building_records(spark, monkeypatch):
    def none(*_):
        raise AssertionError("records were built")

    monkeypatch.setattr(base, "_kept", {})
    monkeypatch.setattr(queries, "stored_records", none)
    assert queries.QUERIES["lookup_event"](spark, str(DATA)).count() == 1
