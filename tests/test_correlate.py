"""The correlation join over labelled scenarios, and its algebra."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crosslight.fixture import COLUMNS
from crosslight.operators import correlate
from crosslight.operators.components import components
from crosslight.plans.base import events

SCHEMA = (
    "tenant_id string, feed_id string, event_id string, vendor string, event_time long, received_at long, vendor_request_id string, linked_request_id string, client_ip string, "
    "client_ip_shared boolean, client_asn long, client_country string, request_host string, request_path string, request_method string, user_agent string, http_status int, ja4 string, "
    "verdict string, rule_id string, score double, score_kind string, waf_attack_score int, waf_action string, waf_source string, matched_rule string, violation string, ingest_version long"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def event(event_id, vendor, at, rid="", linked="", ip="198.51.100.7", host="shop.test", path="/a", verdict="allowed", **more):
    row = dict.fromkeys(NAMES)
    row |= {"tenant_id": "t", "feed_id": vendor, "event_id": event_id, "vendor": vendor, "event_time": at, "received_at": at, "vendor_request_id": rid, "linked_request_id": linked, "client_ip": ip}
    row |= {"client_ip_shared": False, "client_asn": 0, "client_country": "", "request_host": host, "request_path": path, "request_method": "GET", "verdict": verdict, "rule_id": "", "matched_rule": ""}
    row |= {"score_kind": "none", "http_status": 200, "ingest_version": 1}
    return tuple((row | more)[n] for n in NAMES)


def build(spark, rows):
    return {tuple(sorted(r.event_ids)): r for r in correlate.records(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_fixture_columns():
    assert set(COLUMNS) == set(NAMES)


def scenarios():
    """(events, expected records: ids -> tier, confidence, kind)."""
    rows, want = [], {}
    base = 1_700_000_000
    for n in range(12):
        at, ip = base + 1_000 * n, f"198.51.100.{n}"
        rows += [event(f"a{n}c", "cloudflare", at, f"id{n}", ip=ip), event(f"a{n}f", "f5", at + 2, f"id{n}", ip=ip), event(f"a{n}d", "datadome", at + 4, f"id{n}", ip=ip)]
        want[(f"a{n}c", f"a{n}d", f"a{n}f")] = (1, "high", "none")
        rows += [event(f"b{n}c", "cloudflare", at, f"bc{n}", ip=ip, path="/b"), event(f"b{n}f", "f5", at + 1, f"bf{n}", ip=ip, path="/b")]
        want[(f"b{n}c", f"b{n}f")] = (2, "medium", "none")
        rows += [event(f"n{n}c", "cloudflare", at, f"nc{n}", ip=f"100.64.0.{n}", path="/n", client_ip_shared=True), event(f"n{n}f", "f5", at + 1, f"nf{n}", ip=f"100.64.0.{n}", path="/n")]
        want[(f"n{n}c", f"n{n}f")] = (2, "low", "none")
        rows += [event(f"g{n}c", "cloudflare", at, f"gc{n}", ip=ip, path="/g"), event(f"g{n}f", "f5", at + 1, f"gf{n}", ip=ip, path="/g", verdict="blocked")]
        want[(f"g{n}c", f"g{n}f")] = (2, "medium", "allow_vs_block")
        rows += [event(f"s{n}c", "cloudflare", at, f"sc{n}", ip=ip, path="/s"), event(f"s{n}d", "datadome", at + 1, f"sd{n}", ip=ip, path="/s", score=0.92, score_kind="bot")]
        want[(f"s{n}c", f"s{n}d")] = (2, "medium", "score_conflict")
        rows.append(event(f"o{n}c", "cloudflare", at, f"oc{n}", ip=ip, path="/o"))
        want[(f"o{n}c",)] = (2, "high", "none")
        rows += [event(f"m{n}c", "cloudflare", at, f"mc{n}", ip=ip, path="/m"), event(f"m{n}f", "f5", at + 25, f"mf{n}", ip=ip, path="/m")]
        want |= {(f"m{n}c",): (2, "high", "none"), (f"m{n}f",): (2, "high", "none")}
    return rows, want


def test_all_matched_rules_are_united_by_vendor(spark):
    rows = [event("c", "cloudflare", 10, "id", matched_rule="m1"), event("c2", "cloudflare", 11, "id"), event("f", "f5", 11, "id", matched_rule="v1"), event("d", "datadome", 12, "id")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("rule_ids", F.expr("CASE event_id WHEN 'c' THEN array('m2', 'm1') WHEN 'c2' THEN array('m0', '') WHEN 'f' THEN array() END"))
    (record,) = correlate.records(frame).collect()
    assert record.matched_rules == ["m0", "m1", "m2", "v1"] and record.vendor_rules == {"cloudflare": ["m0", "m1", "m2"], "f5": ["v1"]}
    late = spark.createDataFrame([event("c3", "cloudflare", 12, "id", matched_rule="m9")], SCHEMA)
    (amended,) = correlate.merge_amended(correlate.records(frame), correlate.records(late).withColumn("correlation_id", F.lit(record.correlation_id))).collect()
    assert amended.vendor_rules == {"cloudflare": ["m0", "m1", "m2", "m9"], "f5": ["v1"]}


def test_placeholder_ids_tie_nothing_together(spark):
    rows = [event(f"e{k}", vendor, 10_000 * k, rid, ip=f"198.51.100.{k}") for k, (vendor, rid) in enumerate([("cloudflare", "-"), ("f5", "-"), ("cloudflare", "0"), ("f5", " 0 "), ("datadome", "NULL"), ("f5", "null")])]
    assert len(build(spark, rows)) == 6


def test_labelled_scenarios(spark):
    rows, want = scenarios()
    found = build(spark, rows)
    several = {k for k in want if len(k) > 1}
    assert len(several & set(found)) / len(several) >= 0.95
    assert sum(k not in want for k in found) / len(found) <= 0.01
    for ids, expected in want.items():
        assert (found[ids].join_tier, found[ids].confidence, found[ids].disagreement_kind) == expected


def test_order_does_not_matter(spark):
    rows, _ = scenarios()
    assert {k: v.correlation_id for k, v in build(spark, rows).items()} == {k: v.correlation_id for k, v in build(spark, rows[::-1]).items()}


def test_bridges_over_three_hops(spark):
    rows = [event("1", "cloudflare", 10, "a"), event("2", "f5", 900, "b", "a"), event("3", "datadome", 1_800, "c", "b"), event("4", "cloudflare", 2_700, "d", "c"), event("5", "f5", 5, "z", ip=None)]
    found = build(spark, rows)
    assert found[("1", "2", "3", "4")].join_tier == 1 and found[("5",)].join_tier == 0


def test_one_vendor_repeating_an_id_is_not_exact(spark):
    found = build(spark, [event("1", "f5", 10, "a"), event("2", "f5", 500, "a")])
    assert {k: r.join_tier for k, r in found.items()} == {("1",): 2, ("2",): 2}


def test_window_edges(spark):
    """Windows of five seconds: 0 and 1 pair up, then 2 and 3; a window after a gap begins anew."""
    found = build(spark, [event(str(n), "cloudflare" if n % 2 else "f5", at, f"r{n}") for n, at in enumerate((4, 5, 10, 15, 30))])
    assert set(found) == {("0", "1"), ("2", "3"), ("4",)}


def test_no_address_or_host_stands_alone(spark):
    found = build(spark, [event("1", "f5", 10, "a", ip=None), event("2", "cloudflare", 10, "b", ip=None), event("3", "f5", 10, "c", host="")])
    assert len(found) == 3 and all(r.join_tier == 0 for r in found.values())


def test_tenants_never_mix(spark):
    rows = [event("1", "f5", 10, "a"), event("2", "cloudflare", 10, "a", tenant_id="u")]
    assert len(build(spark, rows)) == 2


def test_trusted_network(spark):
    rows = [event("1", "f5", 10, "a", client_asn=64_501, client_country="DE"), event("2", "datadome", 11, "a", client_asn=13_335, client_country="FR"), event("3", "cloudflare", 12, "a")]
    record = build(spark, rows)[("1", "2", "3")]
    assert (record.client_asn, record.client_country) == (64_501, "FR")


def test_merge_keeps_what_was_stored(spark):
    rows = [event("1", "cloudflare", 10, "a", matched_rule="m1"), event("2", "f5", 11, "a", verdict="blocked", matched_rule="m2"), event("3", "datadome", 12, "a", verdict="challenged")]
    frame = spark.createDataFrame(rows, SCHEMA)
    first, second = (correlate.records(frame.where(F.col("event_id").isin(*ids))) for ids in (["1", "2"], ["1", "2", "3"]))
    late = correlate.records(frame.where("event_id <> '2'"))
    merged = correlate.merge_amended(first, late).first()
    whole = second.first()
    for name in ("event_ids", "vendors", "matched_rules"):
        assert sorted(merged[name]) == sorted(whole[name])
    assert merged.verdicts == whole.verdicts and merged.disagreement_kind == "allow_vs_block" and merged.version == 2 and merged.amended


def test_components_of_chains_and_loops(spark):
    links = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(60)] + [("x", "y"), ("y", "x"), ("q", "q")], "a string, b string")
    roots = dict(components(links).collect())
    assert {roots[f"{i:04}"] for i in range(61)} == {"0000"} and roots["y"] == "x" and roots["q"] == "q"


def test_redelivery_changes_nothing(spark):
    from .compare import DATA

    rows = events(spark, str(DATA))
    once = correlate.records(rows).select("correlation_id", "event_ids")
    assert once.count() == once.select("correlation_id").distinct().count()


def test_every_exact_record_is_amended(spark):
    """The query amends all records of the exact tier, with or without datadome's events, by the operator's own version."""
    from crosslight.plans.base import stored_records
    from crosslight.plans.queries import QUERIES

    from .compare import DATA

    full = {r.correlation_id: (",".join(r.vendors), ",".join(sorted(r.event_ids))) for r in stored_records(spark, str(DATA)).where("join_tier = 1").collect()}
    found = QUERIES["agg_merge_amend"](spark, str(DATA)).collect()
    assert {r.correlation_id: (r.vendors, r.event_ids) for r in found} == full and len(found) == len(full)
    assert {r.version for r in found} == {2} and any("datadome" not in r.vendors for r in found)
