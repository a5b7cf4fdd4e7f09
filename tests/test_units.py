"""Functions and operators one at a time, with odd input."""

from __future__ import annotations

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from crosslight.functions import text as t
from crosslight.functions import verdicts as v
from crosslight.operators import alerts, filters, health, latest, lookups, panels, redaction, upkeep


def values(spark, rows, *columns):
    frame = spark.createDataFrame([(r,) for r in rows], "x string")
    return [tuple(r) if len(columns) > 1 else r[0] for r in frame.select(*columns).collect()]


def test_addresses(spark):
    rows = ["203.0.113.5", " 203.0.113.5:80 ", "999.1.1.1", "2001:DB8::1", "[2001:db8::1]:443", "::ffff:10.0.0.1", "nonsense", "", None]
    assert values(spark, rows, t.parse_ip(F.col("x"))) == ["203.0.113.5", "203.0.113.5", None, "2001:db8::1", "2001:db8::1", "10.0.0.1", None, None, None]
    shared = ["10.1.2.3", "172.32.0.1", "172.16.0.1", "100.64.0.1", "100.128.0.1", "fe80::1", "fc00::1", "2606::1", None]
    assert values(spark, shared, t.is_shared_ip(F.col("x"))) == [True, False, True, True, False, True, True, False, False]


def test_times(spark):
    rows = ["2024-05-01T10:00:00Z", "1714557600", "1714557600000", "1714557600000000000", "2024-05-01 10:00:00", "01/May/2024:10:00:00 +0000", "Wed, 01 May 2024 10:00:00 +0000", "May  1 10:00:00", "x", None]
    found = values(spark, rows, F.unix_seconds(t.parse_time(F.col("x"), 2024)))
    assert found == [1_714_557_600] * 8 + [None, None]


def test_numbers_and_lists(spark):
    assert values(spark, ["200", "99", "600", "x", None], t.to_status(F.col("x"))) == [200, 0, 0, 0, 0]
    assert values(spark, ["AS64500", "64500", "-1", "", None], t.as_uint32(F.col("x"))) == [64_500, 64_500, 0, 0, 0]
    assert values(spark, ["a, b;;c", "", None], t.as_list(F.col("x"))) == [["a", "b", "c"], [], []]


def test_paths(spark):
    assert values(spark, ["/A//b/", "", "/", "//"], t.norm_path(F.col("x"))) == ["/a/b", "/", "/", "/"]


def test_framing_tells_lists_apart(spark):
    frame = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("é", None)], "x string, y string")
    found = [r[0] for r in frame.select(t.framed(F.col("x"), F.col("y"))).collect()]
    assert found == ["2:ab|1:c|", "1:a|2:bc|", "2:é|0:|"]


def test_verdicts(spark):
    assert values(spark, ["BLOCK", "log", "", None, "new"], v.cloudflare_verdict(F.col("x"))) == ["blocked", "monitored", "allowed", "allowed", "unknown"]


def test_filters_refuse_what_they_do_not_know(spark):
    rows = spark.range(1)
    with pytest.raises(ValueError, match="unknown filter"):
        filters.search_events(rows, {"colour": 1})
    with pytest.raises(ValueError, match="empty"):
        filters.is_in(F.col("x"), [])
    for bad in ((5, 5), (0, 91 * 86_400)):
        with pytest.raises(ValueError):
            filters.time_range(rows, *bad, now=1 << 40)


def test_cursor_and_paging_never_skip_or_repeat(spark):
    rows = spark.createDataFrame([(n // 7, f"e{n:03}") for n in range(100)], "event_time long, event_id string")
    seen, after = [], None
    while True:
        got = filters.page(rows, size=9, after=after).collect()
        seen += [r.event_id for r in got[:9]]
        if len(got) <= 9:
            break
        after = filters.Cursor.decode(filters.Cursor(got[8].event_time, got[8].event_id).encode())
    assert sorted(seen) == [f"e{n:03}" for n in range(100)]
    for bad in ("", "AA", "x" * 600, "!!"):
        with pytest.raises(ValueError):
            filters.Cursor.decode(bad)


def test_sizes():
    assert [filters.page_size(n) for n in (-1, 0, 5, 5_000)] == [100, 100, 5, 1_000]
    assert [filters.panel_size(n) for n in (0, 50, 101)] == [10, 50, 10]
    assert [upkeep.retention_days(n) for n in (0, -3, 9_999)] == [30, 1, 730]
    assert [alerts.retry_delay(n) for n in (1, 2, 4, 5)] == [2, 4, 16, None]
    assert filters.page_total(5, 10, True) == (5, True) and filters.page_total(11, 10, True) == (10, False)


def test_conditions_are_strict():
    good = '{"aggregate": "count", "comparator": "gt", "threshold": 1, "window": 60, "cooldown": 60, "group_by": ["country"]}'
    assert alerts.Condition.parse(good).group_by == ("country",)
    for change in (("count", "median"), ('"gt"', '"eq"'), ('"window": 60', '"window": 5'), ('"cooldown": 60', '"cooldown": 30'), ("country", "user_agent"), ('"threshold"', '"treshold"')):
        with pytest.raises((ValueError, TypeError)):
            alerts.Condition.parse(good.replace(*change))


def test_alert_lifecycle(spark):
    rows = spark.createDataFrame([("a", "new", None, None, 10, "pending", "r", "high", 1), ("b", "resolved", 1, 1, 11, "sent", "r", "low", 1)], "alert_id string, state string, acknowledged_at long, resolved_at long, fired_at long, notify_status string, rule_id string, severity string, version long")
    changed = alerts.transition(rows, ["a", "b"], "resolved", 99).collect()
    assert [(r.alert_id, r.state, r.acknowledged_at, r.resolved_at, r.version) for r in changed] == [("a", "resolved", 99, 99, 2)]
    assert [r.alert_id for r in alerts.list_alerts(rows, 0, 100, severity="low").collect()] == ["b"]
    assert [r.alert_id for r in alerts.pending_deliveries(rows).collect()] == ["a"]


def test_cooldown(spark):
    firings = spark.createDataFrame([("x", True), ("y", True), ("z", False)], "request_host string, fires boolean")
    none = spark.createDataFrame([], "key string, until long")
    first = alerts.with_cooldown(firings, none, "r", ("request_host",), 100)
    fired = first.where("request_host = 'x'").select("key", F.lit(200).cast("long").alias("until"))
    assert [r.request_host for r in alerts.with_cooldown(firings, fired, "r", ("request_host",), 150).collect()] == ["y"]
    assert alerts.with_cooldown(firings, fired, "r", ("request_host",), 200).count() == 2


def test_silent_feed_without_activity_is_unknown(spark):
    rows = spark.createDataFrame([("t", "f", 9_960, 0, 3, 0, 5, 1), ("t", "g", 9_000, 4, 0, 1, 5, 0)], "tenant_id string, feed_id string, minute long, accepted long, rejected long, drifted long, lag long, credential_ok int")
    found = {r.feed_id: r for r in health.feed_health(rows, 10_000).collect()}
    assert found["f"].silent is None and found["g"].silent and found["g"].drifting and found["g"].credential_ok is None


def test_snapshots_and_versions(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, version long")
    assert sorted(tuple(r) for r in latest.latest(rows, ["k"], "version").collect()) == [("a", 2), ("b", 1)]
    assert sorted(tuple(r) for r in latest.append_version(rows, spark.createDataFrame([("a",), ("c",)], "k string"), ["k"]).collect()) == [("a", 3), ("c", 1)]
    with pytest.raises(ValueError):
        latest.replace_snapshot(rows.limit(0))
    with pytest.raises(ValueError):
        upkeep.purged(rows, "t", 0, 1, " ")


def test_sketches_are_near(spark):
    rows = spark.range(20_000).select(F.lit("t").alias("tenant_id"), (F.col("id") * 10).alias("event_time"), F.lit("v").alias("vendor"), F.col("id").cast("string").alias("event_id"))
    states = panels.volume_sketches(rows.unionByName(rows))
    (found,) = panels.merge_sketches(panels.rollup_hourly(states), ["vendor"]).collect()
    assert abs(found.events - 20_000) < 0.05 * 20_000


def test_audit_chain_shows_a_gap(spark):
    rows = spark.createDataFrame([("t", f"e{n}", n, "me", "act", "x", "d") for n in range(6)], "tenant_id string, entry_id string, occurred_at long, actor string, action string, target string, detail string")
    kept = upkeep.chained(rows)
    assert kept.count() == upkeep.verify_chain(kept).where("linked AND intact").count() == 6
    broken = spark.createDataFrame(kept.where("entry_id <> 'e2'").collect(), kept.schema)
    assert [r.entry_id for r in upkeep.verify_chain(broken).where("NOT linked").collect()] == ["e3"]
    digests, last = {}, ""
    for n in range(6):
        fields = (last, "t", f"e{n}", str(n), "me", "act", "x", "d")
        digests[f"e{n}"] = last = hashlib.sha256("".join(f"{len(f)}:{f}|" for f in fields).encode()).hexdigest()
    assert {r.entry_id: r.entry_hash for r in kept.collect()} == digests
    # One who rewrites an entry and its digest breaks the link of the next.
    forged = F.col("entry_id") == "e3"
    changed = kept.withColumn("detail", F.when(forged, "y").otherwise(F.col("detail")))
    changed = changed.withColumn("entry_hash", F.when(forged, t.hash_chain(F.col("prev_hash"), *(F.col(c) for c in upkeep.AUDIT_FIELDS))).otherwise(F.col("entry_hash")))
    found = {r.entry_id: (r.intact, r.linked) for r in upkeep.verify_chain(changed).collect()}
    assert found["e3"] == (True, True) and found["e4"] == (True, False) and all(v == (True, True) for k, v in found.items() if k != "e4")


def test_preview_is_what_the_rule_measures(spark):
    rng = random.Random(5)
    rows = [("t", f"c{k}", rng.randrange(1_000, 3_000), f"ip{rng.randrange(6)}" if k % 9 else None, f"h{k % 3}", "US", rng.choice(("none", "allow_vs_block")), "blocked", "high", 2) for k in range(120)]
    kept = spark.createDataFrame(rows, "tenant_id string, correlation_id string, window_start long, client_ip string, request_host string, client_country string, disagreement_kind string, combined_outcome string, confidence string, vendor_count int").cache()
    for aggregate, groups in itertools.product(alerts.AGGREGATES, ((), ("request_host",))):
        rule = alerts.Condition(aggregate, "gt", 0.4, 97, 3_600, {"kind": "allow_vs_block"}, groups)
        found = {(r.tick, *(r[g] for g in groups)): (r.value, r.fires) for r in alerts.preview(kept, rule, 1_507, 2_007, 100).collect()}
        want = {}
        for tick in range(1_507, 2_008, 100):
            want |= {(tick, *(r[g] for g in groups)): (r.value, r.fires) for r in alerts.measure(kept, rule, tick).collect() if r.value or not groups}
            if not groups:
                want.setdefault((tick,), (0.0, False))
        assert {k: v for k, v in found.items() if v[0] or not groups} == want


def test_deliveries_are_tried_again(spark):
    schema = "alert_id string, state string, notify_status string, fired_at long, attempts int, next_attempt_at long, version long"
    rows = spark.createDataFrame([("a", "new", "pending", 10, None, None, 1), ("b", "new", "pending", 5, 4, 100, 1), ("c", "new", "pending", 7, 1, 900, 1), ("d", "new", "sent", 1, 1, None, 1)], schema)
    assert [r.alert_id for r in alerts.pending_deliveries(rows, 100).collect()] == ["b", "a"]
    outcomes = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False)], "alert_id string, delivered boolean")
    found = {r.alert_id: (r.notify_status, r.attempts, r.next_attempt_at, r.version) for r in alerts.after_attempts(rows, outcomes, 200).collect()}
    assert found == {"a": ("pending", 1, 202, 2), "b": ("failed", 5, None, 2), "c": ("sent", 2, None, 2)}


def test_export_files(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", ["a"], {"k": "v"}, 1)], "x string, l array<string>, m map<string,string>, n int")
    filters.write_csv(rows, str(tmp_path / "csv"))
    filters.write_ndjson(rows, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().x == "'=1+1"
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_storage(spark, tmp_path):
    spark.range(10).withColumn("date", F.lit("2024-05-01")).write.partitionBy("date").parquet(str(tmp_path / "t"))
    (row,) = upkeep.storage_stats(spark, str(tmp_path / "t")).where("partition = '2024-05-01'").collect()
    assert row.bytes > 0


def test_catalogue_and_unique(spark):
    rows = spark.createDataFrame([("1", ["SQL Injection", "N/A", "new"])], "id string, titles array<string>")
    known = spark.createDataFrame([("sql injection", "high", "d")], "title string, severity string, description string")
    assert sorted((r.title, r.severity) for r in lookups.with_catalogue(rows, "titles", known).collect()) == [("SQL Injection", "high"), ("new", None)]
    people = spark.createDataFrame([("t1", "A@x"), ("t2", "a@x"), ("t1", "b@x")], "tenant_id string, email string")
    assert [r.unique for r in lookups.resolve_unique(people, "a@X").collect()] == [False]
    assert lookups.resolve_unique(people, "none").count() == 0


def test_a_chain_is_verified_in_many_ranges(spark):
    """One tenant's chain over many partitions, sealed whole; a changed field, a changed digest and a missing entry show where they are."""
    rows = [("t", f"n{k:04}", 1_000 + k // 3, "me", "edit", "x", str(k)) for k in range(400)] + [("u", "only", 5, "me", "edit", "x", "")]
    entries = spark.createDataFrame(rows, "tenant_id string, entry_id string, occurred_at long, actor string, action string, target string, detail string")
    sealed = spark.createDataFrame((c := upkeep.chained(entries)).collect(), c.schema)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranges = sealed.repartitionByRange("tenant_id", "occurred_at", "entry_id").where("tenant_id = 't'").select(F.spark_partition_id()).distinct().count()
        assert ranges > 8
        assert upkeep.verify_chain(sealed).where("NOT intact OR NOT linked").count() == 0
        bent = sealed.where("entry_id <> 'n0100'").withColumn("detail", F.when(F.col("entry_id") == "n0200", "forged").otherwise(F.col("detail")))
        bent = bent.withColumn("entry_hash", F.when(F.col("entry_id") == "n0300", "0").otherwise(F.col("entry_hash")))
        found = {r.entry_id: (r.intact, r.linked) for r in upkeep.verify_chain(bent).where("NOT intact OR NOT linked").collect()}
        assert found == {"n0101": (True, False), "n0200": (False, True), "n0300": (False, True), "n0301": (True, False)}
        page = upkeep.list_audit(sealed, 1_050, 1_060).collect()
        assert [r.entry_id for r in page] == [f"n{k:04}" for k in range(150, 183)] and all(r.intact and r.linked for r in page)
        page = upkeep.list_audit(bent.withColumn("entry_hash", F.when(F.col("entry_id") == "n0149", "1").otherwise(F.col("entry_hash"))), 1_050, 1_060).collect()
        assert [r.entry_id for r in page if not r.linked] == ["n0150"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_redaction_of_odd_rows(spark):
    """No policy, no extras, empty texts, and a masked value inside a vendor's own field."""
    rows = [("a", "UA", "/p", "1.2.3.4", {"x": "GET /p", "y": None, "z": ""}, ["request_path"]), ("b", "", None, None, None, ["user_agent", "client_ip"]), ("c", "UA", "/p", "1.2.3.4", {"x": "/p"}, None), ("d", "UA", "/p", "1.2.3.4", {"x": "1", "Y": "2"}, ["RAW_EXTRA"])]
    frame = spark.createDataFrame(rows, "id string, user_agent string, request_path string, client_ip string, raw_extra map<string,string>, policy array<string>")
    found = {r.id: r for r in redaction.redacted(frame, F.col("policy")).collect()}
    assert found["a"].request_path == redaction.MASK and found["a"].raw_extra == {"x": redaction.MASK, "y": None, "z": ""} and found["a"].user_agent == "UA"
    assert (found["b"].user_agent, found["b"].client_ip, found["b"].raw_extra) == ("", None, None)
    assert found["c"].raw_extra == {"x": "/p"} and found["c"].client_ip == "1.2.3.4"
    assert found["d"].raw_extra == {"x": redaction.MASK, "Y": redaction.MASK} and found["d"].request_path == "/p"
    assert redaction.redacted(frame.select("id", "policy"), F.col("policy")).columns == ["id", "policy"]


def test_captured_requests_without_head_or_body(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "GET / HTTP/1.1\\r\\nCookie: a"), (4, "\\n\\nx")], "k int, raw string")
    none = F.lit(None).cast("string")
    found = {r.k: r.c for r in frame.select("k", t.captured_fields(F.col("raw"), none, none, none, none, none, none).alias("c")).collect()}
    assert all(len(c.fields) == 8 and c.truncated for c in found.values())
    assert found[3].fields["http.cookie"] == "a" and [found[k].body for k in (1, 2, 3, 4)] == ["", "", "", "x"]


def test_rates_of_silent_and_rejecting_feeds(spark):
    """A feed of rejections alone has no delay; a feed of an hour ago is silent; requests count by tenant."""
    ok = spark.createDataFrame([("t", "a", 3_600 + k, 3_500, ["x"] if k == 0 else []) for k in range(50)] + [("t", "old", 1_000, 990, [])], "tenant_id string, feed_id string, received_at long, event_time long, unknown_fields array<string>")
    lost = spark.createDataFrame([("t", "b", 3_600)], "tenant_id string, feed_id string, received_at long")
    found = {r.feed_id: r for r in health.ingest_rates(health.ingest_minutes(ok, lost), 3_700).collect()}
    assert (found["b"].lag_p95, found["b"].rejecting, found["b"].late, found["b"].silent) == (None, True, None, None)
    assert found["a"].drifting and found["a"].late and not found["a"].silent and 145 <= found["a"].lag_p95 <= 149
    assert found["old"].silent and not found["old"].late
    asked = spark.createDataFrame([("t", 100, 503 if k < 3 else 200, 5.0 if k < 10 else 0.1) for k in range(100)] + [("u", 100, 200, 0.1)], "tenant_id string, at long, status int, seconds double")
    rates = {r.tenant_id: (r.failing, r.slow) for r in health.request_rates(health.request_minutes(asked), 120).collect()}
    assert rates == {"t": (True, True), "u": (False, False)}
