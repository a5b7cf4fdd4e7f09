"""Payloads of every vendor and format, and continuous runs over landed files."""

from __future__ import annotations

import gzip
import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosslight.operators import correlate, pointers, rollups
from crosslight.operators.alerts import Condition
from crosslight.operators.components import components
from crosslight.operators.latest import latest
from crosslight.plans.base import events
from crosslight.schemas import ENVELOPE
from crosslight.sources import payloads, pull, sinks
from crosslight.streaming import alerting, pipeline
from crosslight.streaming.filed import filed
from crosslight.streaming.windows import paired

from .compare import DATA

NOW = 1_714_557_700
EDGE = {
    "RayID": "8f1", "ParentRayID": "00", "EdgeStartTimestamp": "2024-05-01T10:00:00Z", "ClientIP": "198.51.100.4", "ClientASN": 64500, "ClientCountry": "de", "ClientRequestHost": "shop.test",
    "ClientRequestURI": "/Cart?x=1", "ClientRequestMethod": "GET", "EdgeResponseStatus": 403, "SecurityAction": "block", "SecurityRuleID": "r1", "SecurityRuleIDs": ["r1", "r2"], "SecuritySources": ["firewallManaged"], "WAFAttackScore": 12,
}


def taken(spark, *batches):
    rows = spark.createDataFrame([("t", "feed", vendor, "b", NOW, payload) for vendor, payload in batches], ENVELOPE).coalesce(1)
    accepted, rejected = payloads.normalise(rows, 2024)
    return accepted.collect(), rejected.collect()


def test_edge_log(spark):
    call = EDGE | {"RayID": "9a2", "ParentRayID": "8f1", "ClientRequestHost": payloads.BOT_API_HOST, "SecurityAction": "", "ResponseHeaders": {"x-dd-type": "hard_block"}}
    good, bad = taken(spark, ("cloudflare", json.dumps(EDGE) + "\n{broken\n" + json.dumps(EDGE | {"EdgeStartTimestamp": "soon"}) + "\n" + json.dumps(call)), ("cloudflare", json.dumps([EDGE | {"RayID": "7", "EdgeStartTimestamp": 1714557600000000000}])))
    by = {r.vendor_event_id: r for r in good}
    assert set(by) == {"8f1", "9a2", "7"} and sorted(r.reason for r in bad) == ["PARSE_ERROR", "TIMESTAMP_UNPARSABLE"]
    row = by["8f1"]
    assert (row.verdict, row.client_country, row.request_path, row.request_query, row.rule_ids, row.waf_attack_score, row.waf_source) == ("blocked", "DE", "/Cart", "x=1", ["r1", "r2"], 12, "firewallManaged")
    assert (by["9a2"].vendor, by["9a2"].vendor_request_id, by["9a2"].verdict, by["9a2"].client_ip) == ("datadome", "8f1", "blocked", None)
    assert by["7"].event_time == 1_714_557_600


def test_appliance_formats(spark):
    fields = {"support_id": "55", "date_time": "2024-05-01 10:00:00", "ip_client": "10.0.0.9", "x_forwarded_for_header_value": "198.51.100.9, 10.0.0.1", "method": "POST", "uri": "/login", "response_code": "403", "request_status": "blocked", "violations": "Brute Force;Other", "violation_rating": "4", "request": "POST /login HTTP/1.1\\r\\nHost: shop.test\\r\\nCF-Ray: 8f1-FRA\\r\\n\\r\\n"}
    cef = "CEF:0|F5|ASM|17|200|SQL-Injection|8|rt=2024-05-01 10:00:00 src=198.51.100.3 requestMethod=GET request=/a?b=c cn1=200 cn1Label=response_code cs1=pol icy cs1Label=policy_name act=passed cs3=77 cs3Label=support_id"
    syslog = '<134>May 1 10:00:00 host ASM: support_id="66",date_time="2024-05-01 10:00:00",ip_client=198.51.100.5,uri="/q""x",request_status="alerted",policy_name="p\\"q"'
    good, bad = taken(spark, ("f5", json.dumps(fields)), ("f5", cef), ("f5", syslog), ("f5", "CEF:0|a|b|c|d|e|f|src=1.1.1.1"), ("f5", "free text"))
    by = {r.vendor_event_id: r for r in good}
    assert (by["55"].vendor_request_id, by["55"].client_ip, by["55"].verdict, by["55"].request_host, by["55"].score, by["55"].score_kind) == ("8f1", "198.51.100.9", "rate_limited", "shop.test", 4.0, "threat")
    assert (by["77"].request_path, by["77"].request_query, by["77"].rule_id, by["77"].http_status, by["77"].verdict) == ("/a", "b=c", "pol icy", 200, "allowed")
    assert (by["66"].request_path, by["66"].rule_id, by["66"].verdict) == ('/q"x', 'p"q', "monitored")
    assert sorted(r.reason for r in bad) == ["PARSE_ERROR", "TIMESTAMP_UNPARSABLE"]


def test_bot_and_origin_logs(spark):
    bot = {"X-DataDome-RequestID": "9", "timestamp": 1714557600000, "ip": "198.51.100.4", "botscore": 92, "isbot": True, "Action": "", "country": "fr", "asn": "AS64500", "uri": "/a"}
    origin = {"time_iso8601": "2024-05-01T10:00:00+00:00", "cf_ray": "8f1-FRA", "cf_connecting_ip": "198.51.100.4", "remote_addr": "10.0.0.1", "request_uri": "/a", "status": "429", "upstream_addr": "-"}
    good, bad = taken(spark, ("datadome", json.dumps(bot)), ("nginx", json.dumps(origin)))
    by = {r.vendor: r for r in good}
    assert not bad and (by["datadome"].vendor_request_id, by["datadome"].score, by["datadome"].verdict, by["datadome"].client_asn) == ("9", 0.92, "monitored", 64_500)
    assert (by["nginx"].vendor_request_id, by["nginx"].client_ip, by["nginx"].verdict) == ("8f1", "198.51.100.4", "rate_limited")


def test_garbage_never_raises(spark):
    odd = ["", "\x00", "[", "{}", "[1, null, {}]", "CEF:", "support_id=", "=" * 50, '{"RayID": null}', " {"]
    good, _ = taken(spark, *((vendor, payload) for vendor in payloads.ADAPTERS for payload in odd))
    assert not good


def test_polls():
    assert pull.slices(None, 10_000) == [(6_400 + 300 * k, 6_700 + 300 * k) for k in range(11)]
    assert pull.slices(9_900, 10_000) == []
    book = {"": (["a"], "1"), "1": (["b"], "2"), "2": (["c"], "2")}
    assert [rows for rows, _ in pull.pages(book.__getitem__)] == [["a"], ["b"], ["c"]]


def test_slice_stream(spark, tmp_path):
    spark.dataSource.register(pull.SliceSource)
    rows = spark.readStream.format("log_slices").options(start="1000", now="2500", fetch="tests.test_payloads:fetched", tenant="t", feed="f", vendor="nginx").load()
    query = rows.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
    query.awaitTermination(120)
    assert sorted(r.payload for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [f'{{"from": {a}}}' for a in (1000, 1300, 1600, 1900)]


def fetched(start, end):
    return [{"from": start}]


BOOK = {"": (['{"p":1}', '{"p":2}'], "c1"), "c1": (['{"p":3}'], "c2"), "c2": ([], "c2")}


def book(cursor):
    return BOOK[cursor]


def test_pages_stream(spark, tmp_path):
    spark.dataSource.register(pull.PageSource)
    for _ in range(2):  # a second run goes on at the last cursor, where nothing more comes
        rows = spark.readStream.format("log_pages").options(fetch="tests.test_payloads:book", tenant="t", feed="f", vendor="nginx").load()
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        query.awaitTermination(120)
    assert sorted((r.payload, r.batch_id) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [('{"p":1}', "c1"), ('{"p":2}', "c1"), ('{"p":3}', "c2")]


def test_gzip_is_known_by_its_beginning(spark, tmp_path, monkeypatch):
    (tmp_path / "packed.log").write_bytes(gzip.compress(b"one\n") + gzip.compress("zwei ü".encode()))
    (tmp_path / "plain.log").write_bytes(b"three")
    (tmp_path / "broken.log").write_bytes(gzip.compress(b"four")[:-4])
    found = {r.file.rsplit("/", 1)[1]: r.payload for r in pull.landed_batch(spark, str(tmp_path)).collect()}
    assert found == {"packed.log": "one\nzwei ü", "plain.log": "three", "broken.log": None}
    monkeypatch.setattr(pull, "LARGEST", 10)
    assert pull.plain_text.func(pd.Series([gzip.compress(bytes(10)), gzip.compress(bytes(11)), gzip.compress(bytes(6)) * 2])).tolist() == [bytes(10).decode(), None, None]


def test_owner_lines_and_local_time(spark, tmp_path):
    (tmp_path / "asn.tsv").write_text("1.0.0.0\t1.0.0.255\t64500\tDE\tFirst\n1.1.0.0\t1.1.0.9\t64500\tFR\tSecond\n2.0.0.0\t2.0.0.1\t0\tNone\tNot routed\n")
    assert [tuple(r) for r in payloads.asn_owners(str(tmp_path / "asn.tsv"), spark).collect()] == [(64500, "First", "DE")]
    rows = spark.createDataFrame([("2024-05-01 12:00:00",), (" ",), ("odd",)], "date_time string")
    assert sorted(r[0] for r in payloads.local_to_utc(rows, "Europe/Berlin").collect()) == ["2024-05-01 10:00:00", "odd"]


def test_landed_files_become_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in/a.json.gz", "wt") as out:
        out.write(json.dumps(EDGE | {"EdgeStartTimestamp": "2024-05-01T10:00:00Z"}) + "\n{bad")
    stream = pull.landed_stream(spark, str(tmp_path / "in"), "t", "f", "cloudflare").withColumn("received_at", F.lit(NOW).cast("long"))
    pipeline.start(stream, str(tmp_path), str(tmp_path / "c"), sinks.write_batch(str(tmp_path / "out"))).awaitTermination(120)
    counts = {name: spark.read.parquet(str(tmp_path / "out" / name)).count() for name in ("raw", "events", "rejected")}
    assert counts == {"raw": 1, "events": 1, "rejected": 1}
    assert pull.landed_batch(spark, str(tmp_path / "in"), "a.json").count() == 1
    assert pull.landed_batch(spark, str(tmp_path / "in"), "b").count() == 0


@pytest.fixture(scope="module")
def day(spark, tmp_path_factory):
    """Three files of events: two vendors' first, redeliveries among them, then a third vendor's late ones."""
    path = tmp_path_factory.mktemp("day")
    rows = events(spark, str(DATA)).where("event_time % 5 = 0 OR vendor <> 'cloudflare'").orderBy("event_time", "event_id").limit(150)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    rows.where("vendor <> 'datadome'").coalesce(1).write.parquet(str(path / "in"))
    rows.where("vendor = 'f5'").coalesce(1).write.mode("append").parquet(str(path / "in"))
    rows.where("vendor = 'datadome'").coalesce(1).write.mode("append").parquet(str(path / "in"))
    return path, rows


def as_sets(records):
    return {frozenset(r.event_ids): r.disagreement_kind for r in records.collect()}


def test_replayed_stream_ends_like_the_batch(spark, day, tmp_path):
    """A stream in order of receipt, whose windows close by timers, gives the batch's records at once, each in one version."""
    rows = day[1]
    out = pipeline.replayed(rows, str(tmp_path), 2)
    assert as_sets(out) == as_sets(correlate.records(rows)) and {r.version for r in out.collect()} == {1}
    assert {r.correlation_id for r in out.collect()} == {r.correlation_id for r in correlate.records(rows).collect()}
    # A batch that is run again, as after a failure, replaces what it wrote.
    counts = {t: spark.read.parquet(f"{tmp_path}/out/{t}").count() for t in ("events", "ids", "records", "claims")}
    last = sorted(p.name for p in (tmp_path / "state/commits").iterdir() if p.name.isdigit())[-1]
    (tmp_path / "state/commits" / last).unlink()
    (tmp_path / "state/commits" / f".{last}.crc").unlink(missing_ok=True)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    pipeline.correlate_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", replay=True, buckets=None).awaitTermination()
    assert counts == {t: spark.read.parquet(f"{tmp_path}/out/{t}").count() for t in counts}
    rule = Condition("count", "gte", 1, 86_400, 86_400, {"min_vendors": 2})
    for number in (0, 0, 1):
        pipeline.alert_batch(f"{tmp_path}/out", {"r": rule})(spark.read.parquet(f"{tmp_path}/out/records"), number)
    assert spark.read.parquet(f"{tmp_path}/out/alerts").count() == 1


def test_events_after_a_window_closed_amend_its_record(spark, day, tmp_path):
    """A group whose record was out before its last event came ends in one record, with what that held before."""
    rows = day[1].withColumn("received_at", F.col("received_at") + F.when(F.col("vendor") == "datadome", 10**7).otherwise(0))
    stored = latest(pipeline.replayed(rows, str(tmp_path), 4, lateness=10**8), ["tenant_id", "correlation_id"], "version")
    # A late event may tie together what has been emitted apart; the earlier record then holds it all.
    held = as_sets(stored)
    assert all(any(group <= found for found in held) for group in as_sets(correlate.records(rows)))
    assert any(r.amended and r.version > 1 for r in stored.collect())


def requests(rows, *items):
    """Events as rows of a frame: (number, event_time, received_at, vendor, more)."""
    first = rows.orderBy("event_time").limit(1).collect()[0].asDict()
    at = lambda k, event_time, received_at, vendor, more: first | {"event_id": f"{vendor}-{k}-{event_time}", "event_time": event_time, "received_at": received_at, "vendor": vendor, "vendor_request_id": f"id{k}", "linked_request_id": "", "client_ip": f"198.51.100.{k}"} | more
    return rows.sparkSession.createDataFrame([tuple(at(*i)[c] for c in rows.columns) for i in items], rows.schema)


def test_late_events_are_counted_and_forgotten_windows_stay_so(spark, day, tmp_path):
    """Beyond the lateness an event is counted; within it, it amends; the batches read no event that shares neither a window nor an id."""
    rows = requests(
        day[1], (1, 10_000, 10_001, "cloudflare", {}), (1, 10_001, 10_002, "f5", {}), (2, 10_100, 10_101, "cloudflare", {}),
        (3, 11_000, 11_001, "cloudflare", {}), (3, 11_001, 11_003, "f5", {}), (2, 10_150, 11_005, "f5", {}), (4, 9_000, 11_010, "f5", {}), (5, 20_000, 20_001, "f5", {}),
    )
    for k, r in enumerate(sorted(rows.collect(), key=lambda r: r.received_at)):
        spark.createDataFrame([r], rows.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rules = {"all": (rows.first().tenant_id, Condition("count", "gte", 1, 86_400, 86_400)), "two": (rows.first().tenant_id, Condition("count", "gte", 1, 86_400, 86_400, {"min_vendors": 2}))}
    pipeline.correlate_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", replay=True, rules=rules).awaitTermination()
    stored = latest(spark.read.parquet(f"{tmp_path}/out/records"), ["tenant_id", "correlation_id"], "version")
    found = sorted((sorted(r.event_ids), r.version) for r in stored.collect())
    assert found == [(["cloudflare-1-10000", "f5-1-10001"], 1), (["cloudflare-2-10100", "f5-2-10150"], 2), (["cloudflare-3-11000", "f5-3-11001"], 1)]
    assert [r.dropped for r in pipeline.late_dropped(spark, f"{tmp_path}/out").collect()] == [1]
    # Alerts count the record that was amended once, in its last version, and rest on what is stored.
    moved = spark.read.schema(alerting.MOVE).parquet(f"{tmp_path}/out/moves")
    assert dict(moved.groupBy("rule_id").agg(F.sum("hits")).collect()) == {"all": 3, "two": 3} and stored.sparkSession.read.parquet(f"{tmp_path}/out/records").count() == 4
    fired = spark.createDataFrame([("two", rows.first().tenant_id, "[]", 10_120, 2.0, 96_520)], alerting.ALERT)
    (alert,) = alerting.with_evidence(fired, f"{tmp_path}/out", rules).collect()
    assert alert.evidence == sorted(r.correlation_id for r in stored.collect() if r.window_start < 10_120)


def test_a_timer_closes_a_window_without_new_input(spark, day, tmp_path):
    """By the wall's clock: one file of events just now, nothing after it, and the record comes once the grace has passed."""
    now = int(time.time())
    rows = requests(day[1], (1, now, now, "cloudflare", {}), (1, now, now, "f5", {}), (2, now - 3_600, now, "f5", {}))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = pipeline.correlate_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", grace=1, lateness=60, every="1 second")
    try:
        for _ in range(120):
            time.sleep(1)
            if (tmp_path / "out/pointers/kind=record").exists():  # the last that the batch writes
                break
    finally:
        query.stop()
    done = filed(spark, f"{tmp_path}/out/records")
    assert [sorted(r.event_ids) for r in done.collect()] == [[f"cloudflare-1-{now}", f"f5-1-{now}"]]
    index = spark.read.parquet(f"{tmp_path}/out/pointers")
    (record,) = pointers.record_of_event(index, done, done.first().tenant_id, f"f5-1-{now}", now).collect()
    assert record.correlation_id == done.first().correlation_id
    assert [r.dropped for r in pipeline.late_dropped(spark, f"{tmp_path}/out").collect()] == [1]


def test_pairs_of_windows_go_on_after_forgotten_ones():
    """State that has forgotten a run's beginning pairs its windows up as the whole run would."""
    dice = random.Random(1)
    for _ in range(300):
        ws = sorted(dice.sample(range(14), dice.randrange(1, 12)))
        whole, k = paired(ws, None), dice.randrange(len(ws))
        before = (ws[k - 1], whole[ws[k - 1]]) if k else None
        assert paired(ws[k:], before) == {w: whole[w] for w in ws[k:]}
        for w in ws:
            start = next(s for s in range(w, -2, -1) if s - 1 not in ws)
            assert whole[w] == start + 2 * ((w - start) // 2)


def test_a_walk_reads_what_its_ids_lead_to_and_no_more(spark):
    """Chains of any order and length end in the components' groups, and unrelated ids are not touched."""
    dice, rows = random.Random(2), []
    for chain in range(6):
        links = list(range(dice.randrange(1, 7)))
        dice.shuffle(links)
        rows += [("t", f"e{chain}-{k}", ("f5", "cloudflare")[k % 2], f"c{chain}-{k}", f"c{chain}-{k + 1}" if k % 3 else "", 100) for k in links]
    frame = spark.createDataFrame(rows, "tenant_id string, event_id string, vendor string, vendor_request_id string, linked_request_id string, event_time long")
    ids = frame.withColumn("node", F.explode(pipeline._nodes())).where("node IS NOT NULL").cache()
    roots = dict(components(frame.select(F.least(*(nodes := [correlate.request_key(c) for c in ("vendor_request_id", "linked_request_id")])).alias("a"), F.greatest(*nodes).alias("b"))).collect())
    for chain in range(6):
        seeds = ids.where(F.col("event_id") == f"e{chain}-0").select("node")
        found = {r.node for r in pipeline.walked(ids, seeds).collect()}
        start = roots[f"t1|t|c{chain}-0"]
        assert found == {n for n, root in roots.items() if root == start}


def test_stream_dedup_and_rollup(spark, day):
    path, rows = day
    stream = spark.readStream.schema(rows.schema).parquet(str(path / "in"))
    for name, frame, mode in (("dedup", pipeline.deduplicated(stream), "append"), ("rollup", pipeline.volume_rollup(stream), "complete"), ("minutes", pipeline.health_minutes(stream), "complete")):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(300)
    assert spark.table("dedup").count() == rows.count()
    assert spark.table("rollup").agg(F.sum(F.hll_sketch_estimate("state"))).first()[0] == pytest.approx(rows.count(), rel=0.05)
    assert spark.table("minutes").agg(F.sum("accepted")).first()[0] > rows.count()


def test_rollups_of_a_stream(spark, day):
    """Four rollups of a stream whose files overlap: the states of what was new, a rebuilt hour equals the live one, a batch run again changes nothing."""
    path, rows = day
    root = str(path / "rolled")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    pipeline.start(stream, root, str(path / "rolled-c"), pipeline.rollup_batch(root)).awaitTermination(300)
    exact = {tuple(r)[:-1]: r[-1] for r in rows.groupBy("tenant_id", "vendor", "verdict").agg(F.count_distinct("event_id")).collect()}
    counted = lambda: {tuple(r)[:-1]: r[-1] for r in rollups.estimated(pipeline.rolled_up(spark, root, "verdicts"), "verdicts").collect()}
    assert counted() == exact  # the file of redeliveries added nothing
    pipeline.rollup_batch(root)(rows.where("vendor = 'f5'"), 1)
    assert counted() == exact
    live = pipeline.rolled_up(spark, root, "rules")
    low, high = rows.agg(F.min("event_time"), F.max("event_time")).first()
    back = rollups.rebuilt(live.where(F.col("bucket") > (low + high) // 2), rows, "rules", low, (low + high) // 2 + 300)
    daily = lambda s: sorted(map(tuple, rollups.estimated(s, "rules", 86_400).collect()))
    assert daily(back) == daily(live)
    best = rollups.top(pipeline.rolled_up(spark, root, "sources"), "sources", 3).groupBy("tenant_id").count().collect()
    assert all(r["count"] <= 3 for r in best) and pipeline.rolled_up(spark, root, "none") is None
