"""Alerts by timers against previews and plain loops."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from crosslight.operators.alerts import Condition, preview
from crosslight.streaming import alerting, pipeline

SCHEMA = "tenant_id string, correlation_id string, version long, window_start long, disagreement_kind string, client_ip string, request_host string"
RULES = {
    "blocks": ("t", Condition("count", "gte", 3, 300, 600, {"kind": "allow_vs_block"})),
    "hosts": ("t", Condition("count", "gte", 2, 120, 120, {"kind": "allow_vs_block"}, ("request_host",))),
    "share": ("t", Condition("rate", "gt", 0.4, 300, 300, {"kind": "allow_vs_block"}, ("request_host",))),
    "addresses": ("t", Condition("distinct_ips", "gte", 3, 300, 300, {}, ("request_host",))),
    "silence": ("t", Condition("count", "lt", 1, 60, 300)),
}


@pytest.fixture(scope="module")
def rows(spark):
    """Two hundred records of two tenants within three hours, many in the same window, some without address or host."""
    out = []
    for k in range(200):
        at = 1_000_200 + (k * k * 37) % 10_800 // 5 * 5
        out.append(("t" if k % 4 else "u", f"c{k:03}", 1, at, "allow_vs_block" if k % 3 == 0 else "none", None if k % 11 == 0 else f"198.51.100.{k % 7}", None if k % 13 == 0 else f"h{k % 2}"))
    return spark.createDataFrame(out, SCHEMA)


def expected(records, rules, start, end):
    """Alerts by a loop over the ticks of each rule's preview."""
    out = set()
    for rule_id, (tenant, rule) in rules.items():
        ticks = preview(records.where(F.col("tenant_id") == tenant), rule, start, end, alerting.STEP).where("fires").collect()
        rest = {}
        for r in sorted(ticks, key=lambda r: r.tick):
            group = tuple(r[g] for g in rule.group_by)
            if r.tick >= rest.get(group, 0):
                rest[group] = r.tick + rule.cooldown
                out.add((rule_id, group, r.tick, round(r.value, 9)))
    return out


def plain(alerts):
    return {(r.rule_id, tuple(json.loads(r.group)), r.fired_at, round(r.value, 9)) for r in alerts.collect()}


def test_replayed_rules_fire_as_their_previews(spark, rows, tmp_path):
    rules = {k: r for k, r in RULES.items() if k != "silence"}
    found = alerting.replayed_alerts(rows, rules, str(tmp_path), 3)
    assert plain(found) == expected(rows, rules, 1_000_200, 1_000_200 + 10_800 + 900) and {r.rule_id for r in found.collect()} == set(rules)


def test_a_replaced_version_no_longer_counts_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    """What an amendment takes out of a rule is as if it had never come; every batch is sent twice."""
    at = 1_000_000
    row = lambda k, version, kind, sign: ("t", f"c{k}", version, at + 5 * k, kind, f"198.51.100.{k}", "h", sign)
    rules = {"ips": ("t", Condition("distinct_ips", "gte", 2, 300, 300, {"kind": "allow_vs_block"}, ("request_host",))), "n": ("t", Condition("count", "gte", 3, 300, 300, {"kind": "allow_vs_block"})), "one": ("t", Condition("count", "gte", 1, 300, 600, {"kind": "allow_vs_block"}))}
    batches = [
        [row(1, 1, "allow_vs_block", 1), row(2, 1, "allow_vs_block", 1)],
        [row(1, 1, "allow_vs_block", -1), row(1, 2, "none", 1)],
        [row(3, 1, "none", 1)],
    ]
    clocks = [at - 100, at - 90, at - 80]
    for copy in (0, 1):
        for number, (batch, clock) in enumerate(zip(batches, clocks)):
            found = alerting.moves(spark.createDataFrame(batch, SCHEMA + ", sign int"), rules).withColumn("clock", F.lit(clock).cast("long"))
            found.unionByName(alerting.bells(spark, rules, clock)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/moves/batch={number}")
    alerting.bells(spark, {}, at + 5_000).write.parquet(f"{tmp_path}/moves/batch=3")
    alerting.alert_stream(spark, str(tmp_path), rules, f"{tmp_path}/state", replay=True).awaitTermination()
    assert [(r.rule_id, r.value) for r in alerting.fired(spark, str(tmp_path)).collect()] == [("one", 1.0)]


def test_a_rule_fires_rests_and_fires_again_without_a_new_record(spark, tmp_path):
    """By the wall's clock with ticks of two seconds: one file of records, nothing after it; and a rule on silence without any record."""
    now = int(time.time())
    rules = {"n": ("t", Condition("count", "gte", 2, 60, 60, {}, ("request_host",))), "quiet": ("t", Condition("count", "lt", 1, 30, 60, {"host": "nowhere"}))}
    batch = [("t", f"c{k}", 1, now - k, "none", "198.51.100.1", "h", 1) for k in range(3)]
    alerting.file_moves(spark.createDataFrame(batch, SCHEMA + ", sign int"), rules, str(tmp_path), 0, step=2)
    query = alerting.alert_stream(spark, str(tmp_path), rules, f"{tmp_path}/state", step=2, every="1 second")
    found = []
    try:
        for _ in range(100):
            time.sleep(1)
            if (tmp_path / "alerts").exists() and len(found := alerting.fired(spark, str(tmp_path)).collect()) >= 3:
                break
    finally:
        query.stop()
    by = {r: sorted(x.fired_at for x in found if x.rule_id == r) for r in rules}
    assert [r.value for r in found if r.rule_id == "n"] == [3.0] and now < by["n"][0] <= now + 40
    # Silence has gone on when the rest is over: it fires again, 60 seconds later.
    assert len(by["quiet"]) == 2 and by["quiet"][1] == by["quiet"][0] + 60


def test_a_silent_rule_fires_once_its_window_is_empty(spark, tmp_path):
    """Replayed: the last of three records leaves the window, and the rule fires at that tick."""
    at = 1_000_000
    records = spark.createDataFrame([("t", f"c{k}", 1, at + 20 * k, "none", None, "h") for k in range(3)], SCHEMA)
    found = alerting.replayed_alerts(records, {"silence": RULES["silence"]}, str(tmp_path), 1)
    assert [r.fired_at for r in found.collect()] == [((at + 40 + 60) // 30 + 1) * 30]


def test_drift_names_the_most_frequent_fields(spark):
    """As a batch: counts are of events, not of fields; the fields named are bounded; a feed below the share doesn't warn."""
    rows = [("t", "a", k, [f"f{k % 3}", "z"] if k % 2 else []) for k in range(20)] + [("t", "b", k, ["x"] if k == 0 else None) for k in range(200)]
    frame = spark.createDataFrame(rows, "tenant_id string, feed_id string, event_time long, unknown_fields array<string>")
    (one,) = pipeline.drifting(frame).collect()
    assert (one.feed_id, one.window_start, one.events, one.drifted, one.fields) == ("a", 0, 20, 10, ["f0", "f1", "f2", "z"])
    (few,) = pipeline.drifting(frame, most=1).collect()
    assert few.fields == ["z"]
