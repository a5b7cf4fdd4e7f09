"""Registered queries of the correlation engine and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import verdicts as v
from ..operators import alerts, correlate, filters, health, latest, lookups, panels, pointers, redaction, rollups, tuning, upkeep
from ..operators.alerts import Condition, measure, preview
from ..sources import payloads
from ..streaming import alerting, pipeline
from .base import RECORDS_SQL, events, joined, map_text, over_events, over_obs, over_records, raw, shared_path, stored, stored_records

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


EVENT_COLUMNS = "tenant_id, event_id, event_time, vendor, verdict, http_status"


def _some(rows, names: str = EVENT_COLUMNS):
    return rows.select(*(n.strip() for n in names.split(",")))


# --- scans, filters, paging ---------------------------------------------------------------------

def _span(rows) -> tuple[int, int]:
    low, high = rows.agg(F.min("event_time"), F.max("event_time")).first()
    return (low or 0), (high or 0) + 1


SPAN = "(SELECT min(event_time) AS lo, max(event_time) + 1 AS hi FROM obs)"


@query("scan_events", over_events(f"SELECT {EVENT_COLUMNS} FROM ev, {SPAN} WHERE tenant_id = 'tenant-1' AND event_time >= lo + 100000 AND event_time < least(lo + 900000, hi)"))
def scan_events(spark, d):
    low, high = _span(raw(spark, d))
    # Tenant and time are the same in all versions of an event, so they may be asked for first.
    within = (F.col("tenant_id") == "tenant-1") & (F.col("event_time") >= low + 100_000) & (F.col("event_time") < low + 900_000)
    return _some(filters.time_range(events(spark, d, within), low + 100_000, low + 900_000, high))


def _keyset(spark, d, after):
    """A page by (time, id), which all versions of an event share: filtered before versions are told apart."""
    return _some(filters.page(events(spark, d, F.col("event_time") <= after.at), size=50, after=after))


FILTERS = {
    "flt_eq": ({"host": "h3.example.com"}, "request_host = 'h3.example.com'"),
    "flt_ge": ({"score_min": 0.9}, "score >= 0.9"),
    "flt_le": ({"score_max": 0.1}, "score <= 0.1"),
    "flt_in": ({"verdicts": ["blocked", "challenged"]}, "verdict IN ('blocked', 'challenged')"),
    "flt_contains": ({"path_contains": "purch"}, "request_path LIKE '%purch%'"),
    "flt_has_token": ({"user_agent": "probe1"}, "list_contains(regexp_split_to_array(user_agent, '[^0-9A-Za-z]+'), 'probe1')"),
    "flt_event_filters": (
        {"vendors": ["cloudflare"], "country": "DE", "status": 403, "waf_score_max": 50, "method": "GET", "q": "view"},
        "vendor = 'cloudflare' AND client_country = 'DE' AND http_status = 403 AND waf_attack_score BETWEEN 1 AND 50 AND request_method = 'GET' AND list_contains(regexp_split_to_array(request_path, '[^0-9A-Za-z]+'), 'view')",
    ),
}
for _name, (_spec, _where) in FILTERS.items():
    query(_name, over_events(f"SELECT {EVENT_COLUMNS} FROM ev WHERE {_where}"))(lambda spark, d, s=_spec: _some(filters.search_events(events(spark, d), s)))

query("flt_ne", over_events(f"SELECT {EVENT_COLUMNS} FROM ev WHERE vendor <> 'f5'"))(lambda spark, d: _some(events(spark, d).where(filters.OPERATIONS["ne"](F.col("vendor"), "f5"))))
query("flt_no_client_ip", over_events(f"SELECT {EVENT_COLUMNS} FROM ev WHERE client_ip IS NOT NULL"))(lambda spark, d: _some(events(spark, d).where("client_ip IS NOT NULL")))
query(
    "flt_ingest_drop",
    over_obs(f"SELECT {EVENT_COLUMNS}, ingest_version FROM obs WHERE NOT (request_host = 'h1.example.com' OR ends_with(request_path, 'view') OR starts_with(request_path, '/sig') OR contains(request_host, '5.ex'))"),
)(lambda spark, d: _some(filters.drop_rules(raw(spark, d), [("host", "equals", "H1.example.com"), ("path", "suffix", "VIEW"), ("path", "prefix", "/sig"), ("host", "contains", "5.ex")]), EVENT_COLUMNS + ", ingest_version"))
query("flt_age_gate", over_obs("SELECT event_id, ingest_version, CASE WHEN event_time + 60 BETWEEN received_at - 7776000 AND received_at - 40 THEN NULL ELSE 'TIMESTAMP_OUT_OF_RANGE' END AS reason FROM obs"))(
    lambda spark, d: filters.age_gate(raw(spark, d).withColumn("event_time", F.col("event_time") + 60), ahead=-40).select("event_id", "ingest_version", "reason")
)
query("flt_plausible", over_obs("SELECT event_id, ingest_version FROM obs WHERE event_time BETWEEN 946684800 AND 4133980799"))(lambda spark, d: raw(spark, d).where(t.plausible_time(F.timestamp_seconds("event_time"))).select("event_id", "ingest_version"))

RECORD_COLUMNS = "correlation_id, window_start, vendor_count, confidence, disagreement_kind, combined_outcome"
RECORD_SPECS = {
    "flt_correlated_filters": ({"only_disagreements": True, "min_vendors": 2, "confidence": "medium", "country": "FR"}, "disagreement_kind <> 'none' AND vendor_count >= 2 AND confidence = 'medium' AND client_country = 'FR'"),
    "flt_has_any": ({"event_ids": ["cloudflare-5", "f5-10", "datadome-15"]}, "list_has_any(id_list, ['cloudflare-5', 'f5-10', 'datadome-15'])"),
    "flt_has": ({"matched_rule": "m3"}, "list_contains(matched_rules, 'm3')"),
    "jn_verdict_filter": ({"kind": "allow_vs_block", "outcome": "blocked"}, "disagreement_kind = 'allow_vs_block' AND combined_outcome = 'blocked'"),
}
for _name, (_spec, _where) in RECORD_SPECS.items():
    query(_name, over_records(f"SELECT {RECORD_COLUMNS} FROM rec WHERE {_where}"))(lambda spark, d, s=_spec: _some(filters.search_records(stored_records(spark, d), s), RECORD_COLUMNS))
query("flt_map_key", over_records("SELECT correlation_id, cf_rule FROM rec WHERE cf_rule = 'r4'"))(
    lambda spark, d: stored_records(spark, d).withColumn("cf_rule", filters.map_value(F.col("rule_ids"), "cloudflare")).where("cf_rule = 'r4'").select("correlation_id", "cf_rule")
)
query("flt_list_correlated", over_records(f"SELECT {RECORD_COLUMNS} FROM rec WHERE confidence = 'low' AND vendor_count >= 2 ORDER BY window_start DESC, correlation_id DESC LIMIT 101"))(
    lambda spark, d: _some(filters.page(filters.search_records(stored_records(spark, d), {"confidence": "low", "min_vendors": 2}), "window_start", "correlation_id", 100), RECORD_COLUMNS)
)
query("scan_partition_bound", over_records(f"SELECT {RECORD_COLUMNS} FROM rec, (SELECT min(window_start) AS lo FROM rec) WHERE window_start BETWEEN lo + 200000 - 87300 AND lo + 300000 + 87300"))(
    lambda spark, d: _some(filters.near_partition(r := stored_records(spark, d), (lo := r.agg(F.min("window_start")).first()[0] or 0) + 200_000, lo + 300_000), RECORD_COLUMNS)
)
query("pg_keyset", over_events(f"SELECT {EVENT_COLUMNS} FROM ev, {SPAN} WHERE event_time < lo + 500000 OR (event_time = lo + 500000 AND event_id < 'f') ORDER BY event_time DESC, event_id DESC LIMIT 51"))(
    lambda spark, d: _keyset(spark, d, filters.Cursor.decode(filters.Cursor(_span(raw(spark, d))[0] + 500_000, "f").encode()))
)
query("export_csv", over_events("SELECT regexp_replace('=' || event_id, '^([=+\\-@\\t\\r])', '''\\1') AS safe, event_id FROM ev ORDER BY event_time DESC, event_id DESC LIMIT 100000"))(
    lambda spark, d: filters.export(events(spark, d))[0].select(t.csv_safe(F.concat(F.lit("="), "event_id")).alias("safe"), "event_id")
)
query("export_ndjson", over_events("SELECT count(*) > 5000 AS truncated FROM ev"))(lambda spark, d: filters.export(events(spark, d), 5_000)[1])

# --- versions -----------------------------------------------------------------------------------

query("agg_latest", over_events(f"SELECT {EVENT_COLUMNS}, ingest_version FROM ev"))(lambda spark, d: _some(events(spark, d), EVENT_COLUMNS + ", ingest_version"))
query("win_argmax", over_obs("SELECT tenant_id, event_id, arg_max(verdict, ingest_version) AS verdict FROM obs GROUP BY ALL"))(lambda spark, d: latest.newest_value(raw(spark, d), ["tenant_id", "event_id"], "verdict", "ingest_version"))
query("agg_versions", over_obs("SELECT tenant_id, event_id, max(ingest_version) AS ingest_version FROM obs GROUP BY ALL"))(lambda spark, d: latest.versions(raw(spark, d), ["tenant_id", "event_id"]))
query("win_limit_by", over_events(f"SELECT {EVENT_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY request_host ORDER BY event_time DESC, event_id DESC) AS n FROM ev) WHERE n = 1"))(
    lambda spark, d: _some(latest.pick_first(events(spark, d), ["request_host"], [F.desc("event_time"), F.desc("event_id")]))
)
query("lookup_event", over_events(f"SELECT {EVENT_COLUMNS} FROM ev WHERE tenant_id = 'tenant-0' AND event_id = (SELECT min(event_id) FROM obs WHERE tenant_id = 'tenant-0')"))(
    lambda spark, d: _some(pointers.event_by_id(event_pointers(spark, d), r := raw(spark, d), "tenant-0", r.where("tenant_id = 'tenant-0'").agg(F.min("event_id")).first()[0] or "", *_span(r), FEW))
)
query("lookup_raw_payload", over_obs("SELECT event_id, received_at, ingest_version FROM obs WHERE tenant_id = 'tenant-1' AND event_id = (SELECT min(event_id) FROM obs WHERE tenant_id = 'tenant-1') ORDER BY received_at DESC, ingest_version DESC LIMIT 1"))(
    lambda spark, d: lookups.lookup_payload(r := raw(spark, d), "tenant-1", r.where("tenant_id = 'tenant-1'").agg(F.min("event_id")).first()[0], vendor="cloudflare").select("event_id", "received_at", "ingest_version")
)
query("list_rejected", over_obs("SELECT event_id, received_at FROM obs WHERE feed_id = 'feed-f5' AND http_status = 429 ORDER BY received_at DESC, event_id DESC LIMIT 100"))(
    lambda spark, d: lookups.rejected(raw(spark, d).where("http_status = 429").withColumn("reason", F.lit("PARSE_ERROR")), 0, 1 << 40, "feed-f5", "PARSE_ERROR").select("event_id", "received_at")
)

# --- joins --------------------------------------------------------------------------------------

query("jn_exact_simple", over_events("SELECT tenant_id, event_id, 't1|' || tenant_id || '|' || vendor_request_id AS exact_key FROM ev WHERE (tenant_id, vendor_request_id) IN (SELECT (tenant_id, vendor_request_id) FROM ev GROUP BY tenant_id, vendor_request_id HAVING count(DISTINCT vendor) > 1)"))(
    lambda spark, d: correlate.exact_groups(events(spark, d), bridges=False)
)
query("jn_exact_tier1", over_records("SELECT tenant_id, event_id, exact_key FROM exact"))(lambda spark, d: correlate.exact_groups(events(spark, d)))
query("jn_heur_tier2", over_records("SELECT tenant_id, event_id, shape || '|' || w AS heuristic_key FROM (SELECT tenant_id, event_id, floor(event_time / 5)::BIGINT AS w, 't2|' || tenant_id || '|' || client_ip || '|' || request_host || '|' || request_path || '|' || request_method AS shape FROM ev WHERE request_host <> '' AND client_ip <> '')"))(
    lambda spark, d: correlate.heuristic_groups(events(spark, d), adjacent=False).where("shape IS NOT NULL").select("tenant_id", "event_id", "heuristic_key")
)
query("jn_heur_adjacent", over_records("SELECT tenant_id, event_id, group_key FROM grp WHERE join_tier = 2"))(lambda spark, d: correlate.grouped(events(spark, d)).where("join_tier = 2").select("tenant_id", "event_id", "group_key"))
query("win_pairing", over_records("SELECT shape, w, g AS window_no FROM (SELECT shape, w, first_w + 2 * ((w - first_w) // 2) AS g FROM (SELECT *, min(w) OVER (PARTITION BY shape, run) AS first_w FROM (SELECT shape, w, w - row_number() OVER (PARTITION BY shape ORDER BY w) AS run FROM (SELECT DISTINCT tenant_id AS shape, floor(event_time / 300)::BIGINT AS w FROM ev))))"))(
    lambda spark, d: _pairing(events(spark, d))
)
query("jn_solo", over_records("SELECT tenant_id, event_id, group_key FROM grp WHERE join_tier = 0"))(lambda spark, d: correlate.grouped(events(spark, d)).where("join_tier = 0").select("tenant_id", "event_id", "group_key"))
query("jn_partner_walk", over_records("SELECT DISTINCT ev.tenant_id, ev.event_id FROM ev JOIN exact USING (tenant_id, event_id) WHERE exact_key IN (SELECT exact_key FROM exact JOIN ev USING (tenant_id, event_id) WHERE vendor = 'datadome' AND verdict = 'challenged')"))(
    lambda spark, d: correlate.partners(e := events(spark, d), e.where("vendor = 'datadome' AND verdict = 'challenged'")).select("tenant_id", "event_id")
)
query("jn_identity", over_records("SELECT tenant_id, group_key, correlation_id FROM rec"))(lambda spark, d: stored_records(spark, d).select("tenant_id", "group_key", "correlation_id"))
query("jn_events_to_record", over_records("SELECT r.correlation_id, e.event_id, e.vendor, e.verdict FROM (SELECT tenant_id, correlation_id, unnest(id_list) AS event_id FROM rec) r JOIN ev e USING (tenant_id, event_id)"))(
    lambda spark, d: lookups.events_of_records(stored_records(spark, d), events(spark, d)).select("correlation_id", "event_id", "vendor", "verdict")
)
ONE_VENDOR = "SELECT correlation_id, event_id FROM (SELECT r.correlation_id, e.event_id, row_number() OVER (PARTITION BY r.tenant_id, r.correlation_id ORDER BY {order}) AS n FROM (SELECT tenant_id, correlation_id, unnest(id_list) AS event_id FROM rec) r JOIN ev e USING (tenant_id, event_id) WHERE e.vendor = '{vendor}') WHERE n = 1"
query("jn_two_step_lookup", over_records(ONE_VENDOR.format(vendor="f5", order="e.event_time DESC, e.event_id DESC")))(lambda spark, d: lookups.newest_vendor_event(stored_records(spark, d), events(spark, d), "f5").select("correlation_id", "event_id"))
query("jn_attach_cf", over_records(ONE_VENDOR.format(vendor="cloudflare", order="(e.rule_id <> '') DESC, (e.waf_attack_score > 0) DESC, e.event_id DESC")))(lambda spark, d: lookups.best_edge_event(stored_records(spark, d), events(spark, d)).select("correlation_id", "event_id"))
query("win_pick_best", over_records(ONE_VENDOR.format(vendor="datadome", order="e.score DESC, e.event_id DESC")))(
    lambda spark, d: latest.pick_first(lookups.events_of_records(stored_records(spark, d), events(spark, d).where("vendor = 'datadome'")), ["tenant_id", "correlation_id"], [F.desc("score"), F.desc("event_id")]).select("correlation_id", "event_id")
)
# Tenants share event ids here: every event and record stands a second time under another tenant, which look-ups must not find.
query("jn_ident_resolve", over_records(f"SELECT {RECORD_COLUMNS} FROM rec JOIN (SELECT tenant_id, list(event_id) AS found FROM (SELECT tenant_id, event_id, row_number() OVER (PARTITION BY tenant_id ORDER BY event_id) AS n FROM (SELECT DISTINCT tenant_id, event_id FROM ev WHERE ja4 = 't13d7')) WHERE n <= 100 GROUP BY tenant_id) USING (tenant_id) WHERE list_has_any(id_list, found)"))(
    lambda spark, d: _some(pointers.records_of_identifier_by_tenant(event_pointers(spark, d).unionByName(record_pointers(spark, d)), _twice(stored_records(spark, d)), r := raw(spark, d), "ja4", "t13d7", *_span(r), buckets=FEW), RECORD_COLUMNS)
)
query("jn_event_to_corr", over_records(f"SELECT {RECORD_COLUMNS} FROM rec WHERE tenant_id = 'tenant-2' AND list_contains(id_list, (SELECT min(event_id) FROM ev WHERE tenant_id = 'tenant-2' AND vendor = 'cloudflare'))"))(
    lambda spark, d: _some(_event_to_record(spark, d), RECORD_COLUMNS)
)
ASN = "SELECT 64500 + n_nationkey AS asn, n_name AS owner_name, r_name AS owner_country FROM nation JOIN region ON n_regionkey = r_regionkey"
query("jn_asn_owner", over_events(f"SELECT e.event_id, e.client_asn, o.owner_name, o.owner_country FROM ev e LEFT JOIN ({ASN}) o ON e.client_asn = o.asn"))(lambda spark, d: lookups.with_asn_owner(events(spark, d), _owners(spark, d)).select("event_id", "client_asn", "owner_name", "owner_country"))
RULES = "SELECT 'tenant-' || (p_partkey % 3) AS tenant_id, 'r' || (p_partkey % 9) AS rule_id, p_name AS description, CASE WHEN p_partkey % 9 IN (1, 4) THEN 'log' WHEN p_partkey % 9 = 7 THEN 'simulate' WHEN p_size % 2 = 0 THEN 'log' ELSE 'block' END AS action FROM part"
query("jn_rule_names", over_events(f"SELECT e.event_id, e.rule_id, n.rule_name FROM ev e LEFT JOIN (SELECT tenant_id, rule_id, min(description) AS rule_name FROM ({RULES}) WHERE description <> '' GROUP BY ALL) n USING (tenant_id, rule_id)"))(
    lambda spark, d: lookups.with_rule_names(events(spark, d), _rules(spark, d)).select("event_id", "rule_id", "rule_name")
)
query("jn_asm_catalog", over_events("SELECT e.event_id, e.violation AS title, c.severity FROM ev e LEFT JOIN (SELECT 'viol-' || s_suppkey % 4 AS title, min(s_name) AS severity FROM supplier GROUP BY 1) c ON lower(e.violation) = c.title WHERE e.violation <> ''"))(
    lambda spark, d: lookups.with_catalogue(events(spark, d).withColumn("titles", F.array("violation", F.lit("N/A"))), "titles", _catalogue(spark, d)).select("event_id", "title", "severity")
)
query("jn_verdict_pairs", over_records("SELECT f5_verdict, cf_verdict, count(*) AS n FROM rec WHERE f5_verdict <> '' AND cf_verdict <> '' GROUP BY ALL"))(lambda spark, d: lookups.verdict_pairs(stored_records(spark, d)))
query("jn_anti_effect", over_records(f"SELECT {RECORD_COLUMNS} FROM rec WHERE f5_verdict IN ('blocked', 'rate_limited') AND cf_verdict = 'allowed'"))(lambda spark, d: _some(lookups.only_f5_blocked(stored_records(spark, d)), RECORD_COLUMNS))


def _twice(rows):
    """The same rows, and all of them again under a tenant of the same name with an x; records of that one have other ids."""
    again = rows.withColumn("tenant_id", F.concat("tenant_id", F.lit("x")))
    return rows.unionByName(again.withColumn("correlation_id", F.concat(F.lit("x"), "correlation_id")) if "correlation_id" in rows.columns else again)


#: Buckets of a day of the test tables, whose days are small.
FEW = 2


def event_pointers(spark, d):
    """Pointers to all events, built once for a session and state of the input, kind by kind."""

    def build(path):
        rows = _twice(raw(spark, d))
        for kind in ("event", *(c for c in pointers.IDENTIFIERS if c in rows.columns)):
            pointers.write_pointers(pointers.event_pointers(rows, (kind,)), path, buckets=FEW)

    return stored(spark, d, "event-pointers", build)


def record_pointers(spark, d):
    """Pointers from all events to their records, built likewise."""
    rows = stored_records(spark, d)
    return stored(spark, d, "record-pointers", lambda path: pointers.write_pointers(pointers.record_pointers(_twice(rows)), path, buckets=FEW))


def _event_to_record(spark, d):
    event = raw(spark, d).where("tenant_id = 'tenant-2' AND vendor = 'cloudflare'").agg(F.min_by(F.struct("event_id", "event_time"), "event_id")).first()[0]
    return pointers.record_of_event(record_pointers(spark, d), _twice(stored_records(spark, d)), "tenant-2", event["event_id"] if event else "", event["event_time"] if event else 0, buckets=FEW)


def _pairing(rows):
    """One key for a tenant's events, so that long runs of consecutive windows arise."""
    few = rows.select("tenant_id", F.lit("1.1.1.1").alias("client_ip"), F.lit("h").alias("request_host"), F.lit("/").alias("request_path"), F.lit("GET").alias("request_method"), "event_id", F.floor(F.col("event_time") / 60).alias("event_time"))
    return _windows(few)


def _windows(few):
    keyed = few.select("tenant_id", "event_id", F.floor(F.col("event_time") / 5).cast("long").alias("w"))
    return keyed.join(correlate.heuristic_groups(few), ["tenant_id", "event_id"]).select(F.col("tenant_id").alias("shape"), "w", "window_no").distinct()


def _owners(spark, d):
    nation, region = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        (F.lit(64_500) + F.col("n_nationkey")).cast("long").alias("asn"), F.col("n_name").alias("owner_name"), F.col("r_name").alias("owner_country"), F.lit(1).alias("updated_at")
    )


def _rules(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select(
        F.concat(F.lit("tenant-"), (F.col("p_partkey") % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("r"), (F.col("p_partkey") % 9).cast("string")).alias("rule_id"),
        F.col("p_name").alias("description"),
        F.expr("CASE WHEN p_partkey % 9 IN (1, 4) THEN 'log' WHEN p_partkey % 9 = 7 THEN 'simulate' WHEN p_size % 2 = 0 THEN 'log' ELSE 'block' END").alias("action"),
    )


def _catalogue(spark, d):
    supplier = spark.read.parquet(f"{d}/supplier.parquet")
    return supplier.groupBy(F.concat(F.lit("viol-"), (F.col("s_suppkey") % 4).cast("string")).alias("title")).agg(F.min("s_name").alias("severity")).withColumn("description", F.lit(""))


# --- records ------------------------------------------------------------------------------------

RECORD_ALL = "tenant_id, correlation_id, window_start, first_event_time, last_event_time, vendors, vendor_count, event_ids, client_ip, client_ip_shared, client_asn, client_country, request_host, request_path, request_method, verdicts, rule_ids, matched, combined_outcome, disagreement_kind, join_tier, confidence, candidate_count"


@query("agg_record_build", over_records(f"SELECT {RECORD_ALL.replace('matched', 'coalesce(array_to_string(matched_rules, chr(44)), repeat(chr(32), 0)) AS matched')} FROM rec"))
def record_build(spark, d):
    rows = stored_records(spark, d)
    return _some(rows.withColumns({"vendors": joined("vendors"), "event_ids": joined("event_ids"), "verdicts": map_text("verdicts"), "rule_ids": map_text("rule_ids"), "matched": joined("matched_rules")}), RECORD_ALL)


for _name, _columns in {"agg_geo_trust": "client_asn, client_country", "agg_combined_outcome": "combined_outcome", "agg_classify": "disagreement_kind", "agg_candidate_count": "candidate_count", "agg_confidence": "confidence, join_tier"}.items():
    query(_name, over_records(f"SELECT correlation_id, {_columns} FROM rec"))(lambda spark, d, c=_columns: _some(stored_records(spark, d), "correlation_id, " + c))
query("get_correlated", over_records(f"SELECT {RECORD_COLUMNS} FROM rec WHERE tenant_id = 'tenant-2' AND correlation_id = (SELECT min(correlation_id) FROM rec WHERE tenant_id = 'tenant-2')"))(
    lambda spark, d: _some(lookups.get_record(r := stored_records(spark, d), "tenant-2", r.where("tenant_id = 'tenant-2'").agg(F.min("correlation_id")).first()[0]), RECORD_COLUMNS)
)
query("scan_correlated_latest", over_records(f"SELECT {RECORD_COLUMNS}, 2 AS version FROM rec WHERE vendor_count > 1 UNION ALL SELECT {RECORD_COLUMNS}, 1 FROM rec WHERE vendor_count = 1"))(
    lambda spark, d: _some(latest.latest((r := stored_records(spark, d)).unionByName(latest.append_version(r, r.where("vendor_count > 1"), ["tenant_id", "correlation_id"])), ["tenant_id", "correlation_id"], "version"), RECORD_COLUMNS + ", version")
)


@query("agg_merge_amend", over_records("SELECT correlation_id, vendors, event_ids, verdicts, disagreement_kind, combined_outcome, 2 AS version FROM (SELECT *, array_to_string(list_sort(id_list), ',') AS event_ids, FROM (SELECT * EXCLUDE event_ids FROM rec)) WHERE join_tier = 1"))
def merge_amend(spark, d):
    """All records of the exact tier, stored without their last vendor's events and amended by these once they come."""
    full = stored_records(spark, d).where("join_tier = 1").withColumn("_late", F.array_max(F.map_keys("verdicts")))
    part = lambda keep: full.select(
        "*", F.filter("event_ids", lambda e: keep(F.substring_index(e, "-", 1))).alias("_ids"), F.map_filter("verdicts", lambda k, _: keep(k)).alias("_v")
    ).withColumn("event_ids", F.col("_ids")).withColumn("verdicts", F.col("_v")).withColumn("vendors", F.map_keys("_v")).where(F.size("_v") > 0).drop("_ids", "_v", "_late")
    stored, fresh = part(lambda vendor: vendor != F.col("_late")), part(lambda vendor: vendor == F.col("_late"))
    out = correlate.merge_amended(stored, fresh).select("correlation_id", "vendors", "event_ids", "verdicts", "disagreement_kind", "combined_outcome", "version")
    return out.withColumns({"vendors": joined("vendors"), "event_ids": joined("event_ids"), "verdicts": map_text("verdicts")})


@query("st_window_close", over_records("SELECT tenant_id, correlation_id, array_to_string(list_sort(id_list), ',') AS event_ids, disagreement_kind, 1 AS version FROM rec"))
def window_close(spark, d):
    """All observations sent through the continuous correlation in the order of their receipt; timers close the windows."""
    out = pipeline.replayed(raw(spark, d), shared_path(spark, "replay"), 2)
    return out.withColumn("event_ids", F.array_sort("event_ids")).select("tenant_id", "correlation_id", joined("event_ids").alias("event_ids"), "disagreement_kind", "version")


# --- panels, tuning, migration ------------------------------------------------------------------

query("agg_vendor_volume", over_events("SELECT tenant_id, (event_time // 300) * 300 AS bucket, vendor, count(DISTINCT event_id) AS events FROM ev GROUP BY ALL"))(lambda spark, d: panels.vendor_volume(raw(spark, d)))
query("agg_verdict_mix", over_events("SELECT tenant_id, (event_time // 86400) * 86400 AS bucket, vendor, verdict, count(DISTINCT event_id) AS events FROM ev GROUP BY ALL"))(lambda spark, d: panels.verdict_mix(events(spark, d), 86_400))
query("agg_overview_totals", over_events("SELECT tenant_id, count(*) AS total, count(*) FILTER (WHERE verdict IN ('blocked', 'rate_limited')) AS blocked, count(*) FILTER (WHERE verdict = 'challenged') AS challenged FROM ev GROUP BY ALL"))(
    lambda spark, d: panels.overview_totals(panels.verdict_mix(events(spark, d)))
)
query("agg_top_rules", over_events("SELECT vendor, rule_id, count(DISTINCT event_id) AS events FROM ev WHERE rule_id <> '' GROUP BY ALL ORDER BY events DESC, vendor, rule_id LIMIT 10"))(lambda spark, d: panels.top_rules(events(spark, d)))
query("agg_top_sources", over_events("SELECT client_ip, client_country, client_asn, count(DISTINCT event_id) AS events, count(DISTINCT event_id) FILTER (WHERE verdict IN ('blocked', 'rate_limited')) AS blocked FROM ev WHERE client_ip IS NOT NULL GROUP BY ALL ORDER BY events DESC, client_ip, client_country, client_asn LIMIT 20"))(
    lambda spark, d: panels.top_sources(events(spark, d), 20)
)
query("agg_top_asns", over_events("SELECT client_asn, sum(n) AS events, count(DISTINCT client_ip) AS clients, (SELECT client_country FROM (SELECT client_country, count(*) AS c FROM ev e2 WHERE e2.client_asn = x.client_asn AND client_ip IS NOT NULL GROUP BY 1 ORDER BY c DESC, client_country DESC LIMIT 1)) AS country FROM (SELECT client_asn, client_ip, client_country, count(DISTINCT event_id) AS n FROM ev WHERE client_ip IS NOT NULL AND client_asn > 0 GROUP BY ALL) x GROUP BY client_asn ORDER BY events DESC, client_asn LIMIT 10"))(
    lambda spark, d: panels.top_asns(events(spark, d))
)
query("agg_disagreement_rate", over_records("SELECT tenant_id, bucket, disagreement_kind, n AS disagreeing, total, total_compat FROM (SELECT *, sum(n) OVER (PARTITION BY tenant_id, bucket) AS total, max(n) OVER (PARTITION BY tenant_id, bucket) AS total_compat FROM (SELECT tenant_id, (window_start // 86400) * 86400 AS bucket, disagreement_kind, count(DISTINCT correlation_id) AS n FROM rec GROUP BY ALL)) WHERE disagreement_kind <> 'none'"))(
    lambda spark, d: panels.disagreement_rate(stored_records(spark, d), 86_400)
)
query("agg_volume_sketch")(lambda spark, d: panels.merge_sketches(panels.rollup_hourly(panels.volume_sketches(events(spark, d))), ["tenant_id", "vendor"]))
query("agg_volume_sketch_error", over_events("SELECT tenant_id, vendor, count(DISTINCT event_id) AS exact, true AS near FROM ev GROUP BY ALL"))(
    lambda spark, d: panels.merge_sketches(panels.volume_sketches(e := events(spark, d)), ["tenant_id", "vendor"])
    .join(e.groupBy("tenant_id", "vendor").agg(F.count_distinct("event_id").alias("exact")), ["tenant_id", "vendor"])
    .select("tenant_id", "vendor", "exact", (F.abs(F.col("events") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))
)


def _near(spark, d, name, keys):
    """A rollup's daily counts from its states beside exact ones, which they are near (exact for small counts)."""
    rollup = rollups.ROLLUPS[name]
    rows = stored_records(spark, d) if rollup.counted == "correlation_id" else events(spark, d)
    found = rollups.estimated(rollups.states(rows, name), name, 86_400, keys)
    rows = rows.withColumn("stopped", F.col("verdict").isin(*rollups.STOPPED)) if "stopped" in keys else rows
    exact = rows.where(rollup.where).groupBy("tenant_id", t.bucket_start(F.col(rollup.time), 86_400).alias("bucket"), *keys).agg(F.count_distinct(rollup.counted).alias("exact"))
    both = found.unionByName(exact, allowMissingColumns=True).groupBy("tenant_id", "bucket", *keys).agg(F.max("events").alias("events"), F.max("exact").alias("exact"))
    return both.select("tenant_id", "bucket", *keys, "exact", (F.abs(F.col("events") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact"))).alias("near"))


for _name, (_sql, _keys) in {
    "volume": ("event_time // 86400 * 86400 AS bucket, vendor, count(*) AS exact FROM ev", ("vendor",)),
    "verdicts": ("event_time // 86400 * 86400 AS bucket, vendor, verdict, count(*) AS exact FROM ev", ("vendor", "verdict")),
    "rules": ("event_time // 86400 * 86400 AS bucket, vendor, rule_id, count(*) AS exact FROM ev WHERE rule_id <> ''", ("vendor", "rule_id")),
    "sources": ("event_time // 86400 * 86400 AS bucket, client_ip, client_country, client_asn, verdict IN ('blocked', 'rate_limited') AS stopped, count(*) AS exact FROM ev WHERE client_ip IS NOT NULL", ("client_ip", "client_country", "client_asn", "stopped")),
    "disagreement": ("window_start // 86400 * 86400 AS bucket, disagreement_kind, count(*) AS exact FROM rec", ("disagreement_kind",)),
}.items():
    _over = over_records if _name == "disagreement" else over_events
    query(f"rollup_{_name}", _over(f"SELECT *, true AS near FROM (SELECT tenant_id, {_sql} GROUP BY ALL)"))(lambda spark, d, n=_name, k=_keys: _near(spark, d, n, k))


@query("backfill_rollup", over_events("SELECT tenant_id, vendor, count(DISTINCT event_id) AS events FROM ev GROUP BY ALL"))
def backfill_rollup(spark, d):
    """Exact counts of a rollup of which the later half of the time was lost and is rebuilt, over an hour that was not lost too."""
    rows = raw(spark, d)
    low, high = _span(rows)
    middle = (low + high) // 2
    kept = rollups.members(rows, "volume").where(F.col("bucket") < middle)
    return rollups.counted(rollups.rebuilt_members(kept, rows, "volume", middle - 3_600, high), "volume")


SCORED = "count(*) AS events, count(*) FILTER (WHERE waf_attack_score BETWEEN 1 AND 20) AS attack, count(*) FILTER (WHERE waf_attack_score BETWEEN 21 AND 50) AS suspicious, count(*) FILTER (WHERE waf_attack_score > 50) AS clean, round(coalesce(avg(waf_attack_score) FILTER (WHERE waf_attack_score > 0), 0.0), 6) AS mean_score"
query("agg_waf_rule_profile", over_events(f"SELECT *, CASE WHEN waf_action = 'skip' THEN 'exempting' WHEN attack + suspicious + clean = 0 THEN 'unscored' WHEN (attack + suspicious) / (attack + suspicious + clean) >= 0.8 THEN 'attacks' WHEN (attack + suspicious) / (attack + suspicious + clean) <= 0.2 THEN 'clean' ELSE 'mixed' END AS reading FROM (SELECT tenant_id, rule_id, request_host, waf_action, waf_source, {SCORED} FROM ev WHERE vendor = 'cloudflare' AND rule_id <> '' GROUP BY ALL)"))(
    lambda spark, d: tuning.rule_profile(events(spark, d, F.col("vendor") == "cloudflare"))
)
query("agg_waf_paths", over_events(f"SELECT request_host, request_path, events, mean_score FROM (SELECT request_host, request_path, {SCORED} FROM ev WHERE rule_id = 'r3' GROUP BY ALL)"))(lambda spark, d: tuning.rule_paths(events(spark, d), "r3"))
query("agg_waf_gaps", over_events(f"SELECT request_host, events, attack, suspicious, mean_score FROM (SELECT request_host, {SCORED} FROM ev WHERE vendor = 'cloudflare' AND rule_id = '' AND waf_attack_score BETWEEN 1 AND 50 GROUP BY ALL)"))(lambda spark, d: tuning.gaps(events(spark, d)))
query("agg_corroboration", over_records("SELECT tenant_id, cf_rule AS rule, count(*) AS correlated, count(*) FILTER (WHERE regexp_matches(o, 'blocked|rate_limited|challenged')) AS confirmed, count(*) FILTER (WHERE NOT regexp_matches(o, 'blocked|rate_limited|challenged|monitored|unknown')) AS allowed FROM (SELECT tenant_id, cf_rule, regexp_replace(verdicts, 'cloudflare=[a-z_]+', '') AS o FROM rec WHERE vendor_count > 1 AND cf_rule <> '') GROUP BY ALL"))(
    lambda spark, d: tuning.corroboration(stored_records(spark, d))
)
F5_OF = "(SELECT tenant_id, correlation_id, f5_verdict, cf_verdict, unnest(id_list) AS event_id FROM rec WHERE f5_verdict IN ('blocked', 'rate_limited') AND cf_verdict = 'allowed') r JOIN ev e USING (tenant_id, event_id)"
query("agg_uncovered", over_records(f"SELECT violation, request_host, request_method, count(DISTINCT correlation_id) AS requests, count(DISTINCT request_path) AS paths, count(DISTINCT client_ip) AS clients, min(event_time) AS first_seen, max(event_time) AS last_seen FROM {F5_OF} WHERE vendor = 'f5' AND violation <> '' GROUP BY ALL"))(
    lambda spark, d: tuning.uncovered(stored_records(spark, d), events(spark, d))
)
query("agg_rule_agreement", over_records("SELECT *, CASE WHEN n < 10 THEN 'insufficient' WHEN (blocked + flagged / 2) / n >= 0.8 THEN 'ready' WHEN (blocked + flagged / 2) / n <= 0.2 THEN 'false_positive' ELSE 'disputed' END AS reading FROM (SELECT rule, count(*) AS n, count(*) FILTER (WHERE f5_verdict IN ('blocked', 'rate_limited')) AS blocked, count(*) FILTER (WHERE f5_verdict = 'monitored') AS flagged, count(*) FILTER (WHERE f5_verdict = 'allowed') AS allowed, count(DISTINCT request_host) AS hosts, CASE WHEN count(DISTINCT request_host) = 1 THEN min(request_host) ELSE '' END AS host FROM (SELECT f5_verdict, request_host, unnest(matched_rules) AS rule FROM rec WHERE f5_verdict <> '') GROUP BY rule)"))(
    lambda spark, d: tuning.rule_agreement(stored_records(spark, d))
)
query("agg_observed_monitored", over_events("SELECT DISTINCT rule_id FROM ev WHERE vendor = 'cloudflare' AND rule_id <> '' AND waf_action IN ('log', 'simulate')"))(lambda spark, d: tuning.observed_monitored(events(spark, d)))
query("agg_monitored_rules", f"SELECT tenant_id, rule_id, min(action) AS action FROM ({RULES}) GROUP BY tenant_id, rule_id HAVING min(action) IN ('log', 'simulate')")(lambda spark, d: tuning.monitored_rules(_rules(spark, d)))
query("set_union_candidates", over_events(f"SELECT DISTINCT rule_id FROM (SELECT rule_id FROM ({RULES}) UNION SELECT rule_id FROM ev) WHERE rule_id <> ''"))(lambda spark, d: lookups.union_candidates(_rules(spark, d), events(spark, d)))
query("set_union_strings", over_events("SELECT event_id, concat_ws(',', nullif(rule_id, ''), nullif(matched_rule, '')) AS both FROM ev WHERE rule_id <> matched_rule"))(
    lambda spark, d: events(spark, d).where("rule_id <> matched_rule").select("event_id", F.array_join(lookups.union_strings(F.array("rule_id"), F.array("matched_rule")), ",").alias("both"))
)
query("set_append_unique", over_events("SELECT request_host, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM ev GROUP BY ALL"))(
    lambda spark, d: lookups.append_unique(events(spark, d).select("request_host", F.array("rule_id").alias("rules")), ["request_host"], "rules").withColumn("rules", joined("rules"))
)
query("list_rule_samples", over_events(f"SELECT {EVENT_COLUMNS} FROM ev WHERE rule_id = 'r4' ORDER BY event_time DESC, event_id DESC LIMIT 20"))(lambda spark, d: _some(lookups.rule_samples(raw(spark, d), "r4")))
query("list_migration_samples", over_records(f"SELECT correlation_id, event_id, event_time, request_host, request_path, f5_verdict, cf_verdict FROM {F5_OF} WHERE vendor = 'f5' AND violation = 'VIOL-2' ORDER BY event_time DESC, event_id DESC LIMIT 20"))(
    lambda spark, d: tuning.migration_samples(stored_records(spark, d), events(spark, d), "VIOL-2")
)

# --- alerts, health, upkeep ---------------------------------------------------------------------

BLOCKS = Condition("count", "gte", 3, 86_400, 86_400, {"kind": "allow_vs_block"}, ("request_host",))
LAST = "(SELECT max(window_start) + 5 AS hi FROM rec)"


def _last(rows) -> int:
    return (rows.agg(F.max("window_start")).first()[0] or 0) + 5


query("agg_alert_measure", over_records(f"SELECT request_host, count(*)::DOUBLE AS value, array_to_string(list_sort(list(correlation_id))[:20], ',') AS evidence, count(*) >= 3 AS fires FROM rec, {LAST} WHERE window_start >= hi - 86400 AND window_start < hi AND disagreement_kind = 'allow_vs_block' GROUP BY request_host"))(
    lambda spark, d: measure(r := stored_records(spark, d), BLOCKS, _last(r)).withColumn("evidence", joined("evidence"))
)
query("alert_rate", over_records(f"SELECT country, n / every AS value, n / every > 0.1 AS fires FROM (SELECT client_country AS country, count(*) FILTER (WHERE disagreement_kind = 'allow_vs_block')::DOUBLE AS n, count(*) AS every FROM rec, {LAST} WHERE window_start >= hi - 86400 AND window_start < hi GROUP BY 1) WHERE n > 0"))(
    lambda spark, d: measure(r := stored_records(spark, d), Condition("rate", "gt", 0.1, 86_400, 86_400, {"kind": "allow_vs_block"}, ("country",)), _last(r)).select("country", "value", "fires")
)
TICKS = "(SELECT unnest(generate_series(hi - 36000 + {0}, hi, 600)) AS tick FROM (SELECT ((max(window_start) + 5) // 600) * 600 AS hi FROM rec)) t LEFT JOIN rec ON window_start >= tick - 3600 AND window_start < tick"
query("alert_preview", over_records(f"SELECT tick, n::DOUBLE AS value, n >= 3 AS fires FROM (SELECT tick, count(*) FILTER (WHERE disagreement_kind = 'allow_vs_block') AS n FROM {TICKS.format(0)} GROUP BY tick)"))(
    lambda spark, d: preview(r := stored_records(spark, d), Condition("count", "gte", 3, 3_600, 86_400, {"kind": "allow_vs_block"}), (hi := _last(r) // 600 * 600) - 36_000, hi, 600)
)
query("alert_preview_rate", over_records(f"SELECT tick, value, value > 0.1 AS fires FROM (SELECT tick, coalesce(count(*) FILTER (WHERE disagreement_kind = 'allow_vs_block') / nullif(count(correlation_id), 0), 0.0)::DOUBLE AS value FROM {TICKS.format(7)} GROUP BY tick)"))(
    lambda spark, d: preview(r := stored_records(spark, d), Condition("rate", "gt", 0.1, 3_600, 86_400, {"kind": "allow_vs_block"}), (hi := _last(r) // 600 * 600) - 36_000 + 7, hi, 600)
)
query("alert_preview_ips", over_records(f"SELECT tick, request_host, n::DOUBLE AS value, n >= 2 AS fires FROM (SELECT tick, request_host, count(DISTINCT client_ip) FILTER (WHERE disagreement_kind = 'allow_vs_block') AS n FROM {TICKS.format(7)} GROUP BY ALL) WHERE n > 0"))(
    lambda spark, d: preview(r := stored_records(spark, d), Condition("distinct_ips", "gte", 2, 3_600, 86_400, {"kind": "allow_vs_block"}, ("request_host",)), (hi := _last(r) // 600 * 600) - 36_000 + 7, hi, 600)
)
query("alert_compare", over_records("SELECT correlation_id, vendor_count > 2 AS gt, vendor_count >= 2 AS gte, vendor_count < 2 AS lt, vendor_count <= 2 AS lte, false AS other FROM rec"))(
    lambda spark, d: stored_records(spark, d).select("correlation_id", *(_compare(F.col("vendor_count"), c, n).alias(c) for c, n in (("gt", 2), ("gte", 2), ("lt", 2), ("lte", 2), ("other", 2))))
)


def _compare(value, comparator, threshold):
    from ..operators.alerts import compare

    return compare(value, comparator, threshold)


# Rules that are replayed over all records, through the states of the continuous alerts: each of one tenant.
LIVE = {
    "blocks": ("tenant-1", Condition("count", "gte", 2, 7_200, 86_400, {"kind": "allow_vs_block"}, ("request_host",))),
    "share": ("tenant-2", Condition("rate", "gt", 0.3, 3_600, 86_400, {"kind": "allow_vs_block"}, ("country",))),
    "addresses": ("tenant-0", Condition("distinct_ips", "gte", 2, 7_200, 172_800, {"kind": "allow_vs_block"}, ("request_host",))),
}
HIT = "disagreement_kind = 'allow_vs_block'"


def _ticks(rule_id: str, column: str, value: str, fires: str) -> str:
    """Values of a rule that fires, at every tick of each group, in SQL."""
    tenant, rule = LIVE[rule_id]
    of = f"SELECT unnest(generate_series((window_start // 30 + 1) * 30, (window_start + {rule.window}) // 30 * 30, 30)) AS tick, {column} AS g, client_ip, {HIT} AS hit FROM rec WHERE tenant_id = '{tenant}'"
    return f"SELECT '{rule_id}' AS rule_id, '{tenant}' AS tenant_id, g, tick, {value} AS value, {rule.cooldown} AS cooldown FROM ({of}) GROUP BY g, tick HAVING count(*) FILTER (WHERE hit) > 0 AND {fires}"


FIRST_HITS = "count(*) FILTER (WHERE hit)::DOUBLE"
FIRING = " UNION ALL ".join(
    (_ticks("blocks", "request_host", FIRST_HITS, f"{FIRST_HITS} >= 2"), _ticks("share", "client_country", f"{FIRST_HITS} / count(*)", f"{FIRST_HITS} / count(*) > 0.3"), _ticks("addresses", "request_host", (n := "count(DISTINCT client_ip) FILTER (WHERE hit)::DOUBLE"), f"{n} >= 2"))
)
ALERTED = f"""WITH RECURSIVE {RECORDS_SQL}, f AS MATERIALIZED (SELECT * EXCLUDE g, CASE WHEN g IS NULL THEN '[null]' ELSE '["' || g || '"]' END AS "group" FROM ({FIRING})),
alerted AS (SELECT rule_id, "group", min(tick) AS tick FROM f GROUP BY ALL
    UNION ALL SELECT f.rule_id, f."group", min(f.tick) FROM alerted a JOIN f ON f.rule_id = a.rule_id AND f."group" = a."group" AND f.tick >= a.tick + f.cooldown GROUP BY ALL)
SELECT rule_id, tenant_id, "group", tick AS fired_at, value, tick + cooldown AS until FROM f JOIN alerted USING (rule_id, "group", tick)"""


@query("st_alert_eval", ALERTED)
def alert_eval(spark, d):
    """All records sent through the rules' states in the order of their time; what fires every 30 seconds, and rests."""
    return alerting.replayed_alerts(stored_records(spark, d), LIVE, shared_path(spark, "alerts"), 2)


MINUTES = "SELECT tenant_id, feed_id, (received_at // 60) * 60 AS minute, count(*) AS accepted, count(*) FILTER (WHERE http_status = 429) AS rejected, count(*) FILTER (WHERE waf_attack_score > 90) AS drifted, max(received_at - event_time) AS lag, 1 AS credential_ok FROM obs GROUP BY ALL"


def _samples(spark, d):
    return raw(spark, d).select(
        "tenant_id", "feed_id", F.col("received_at").alias("at"), F.lit(1).cast("long").alias("accepted"), (F.col("http_status") == 429).cast("long").alias("rejected"),
        (F.col("waf_attack_score") > 90).cast("long").alias("drifted"), (F.col("received_at") - F.col("event_time")).alias("lag"), F.lit(1).alias("credential_ok"),
    )


query("agg_feed_health_minute", over_obs(MINUTES))(lambda spark, d: health.feed_minutes(_samples(spark, d)))
query("agg_feed_health", over_obs(f"SELECT tenant_id, feed_id, sum(accepted) AS accepted, sum(rejected) AS rejected, max(lag) AS lag, max(minute) AS last_active, round(sum(accepted) / 3600, 6) AS events_per_s, sum(drifted) / sum(accepted) > 0.01 AS drifting, max(minute) < hi - 900 AS silent, min(credential_ok) FILTER (WHERE minute > hi - 300) AS credential_ok FROM ({MINUTES}), (SELECT max(received_at) AS hi FROM obs) WHERE minute > hi - 3600 AND minute <= hi GROUP BY tenant_id, feed_id, hi"))(
    lambda spark, d: health.feed_health(health.feed_minutes(s := _samples(spark, d)), s.agg(F.max("at")).first()[0] or 0)
)
query("agg_corr_health", over_obs("SELECT tenant_id, filed, emitted, failures, dropped, CASE WHEN failures > 0 AND emitted = 0 THEN 'failing' WHEN filed = 0 THEN 'idle' WHEN emitted = 0 THEN 'stalled' WHEN dropped / filed > 0.05 THEN 'losing' WHEN due >= 8192 AND lag > 100 THEN 'behind' ELSE 'healthy' END AS status, due, lag FROM (SELECT tenant_id, count(*) AS filed, count(*) FILTER (WHERE vendor = 'cloudflare') AS emitted, count(*) FILTER (WHERE http_status = 429) AS failures, count(*) FILTER (WHERE vendor = 'f5' AND rule_id = 'policy-3') AS dropped, max(CASE WHEN vendor = 'cloudflare' THEN 8192 ELSE 0 END) AS due, max(received_at - event_time) AS lag FROM obs, (SELECT (max(received_at) // 60) * 60 AS hi FROM obs) WHERE (received_at // 60) * 60 > hi - 900 GROUP BY ALL)"))(
    lambda spark, d: health.correlation_health(m := _corr_minutes(spark, d), m.agg(F.max("minute")).first()[0] or 0, 200)
)


def _corr_minutes(spark, d):
    one = lambda test: F.sum(F.when(F.expr(test), 1).otherwise(0))
    return raw(spark, d).groupBy("tenant_id", t.bucket_start(F.col("received_at"), 60).alias("minute")).agg(
        F.count("*").alias("filed"), one("vendor = 'cloudflare'").alias("emitted"), one("http_status = 429").alias("failures"), one("vendor = 'f5' AND rule_id = 'policy-3'").alias("dropped"),
        F.max(F.when(F.col("vendor") == "cloudflare", 8_192).otherwise(0)).alias("due"), F.max(F.col("received_at") - F.col("event_time")).alias("lag"),
    )


query("agg_drift", over_obs("SELECT tenant_id, feed_id, (event_time // 86400) * 86400 AS window_start, count(*) AS events, count(*) FILTER (WHERE matched_rule <> '') AS drifted, array_to_string(list_sort(list(DISTINCT matched_rule) FILTER (WHERE matched_rule <> '')), ',') AS fields FROM obs GROUP BY ALL HAVING count(*) FILTER (WHERE matched_rule <> '') > 0.01 * count(*)"))(
    lambda spark, d: health.drift(raw(spark, d).withColumn("unknown_fields", F.filter(F.array("matched_rule"), lambda x: x != "")), width=86_400).withColumn("fields", joined("fields"))
)
query("ops_rate_rules", over_obs("SELECT feed_id, count(*) AS accepted, max(received_at) AS last, quantile_disc(received_at - event_time, 0.95) AS lag_p95, count(*) FILTER (WHERE http_status = 429) AS rejected, max(received_at) < hi - 900 AS silent, quantile_disc(received_at - event_time, 0.95) > 60 AS late, count(*) FILTER (WHERE http_status = 429) / (count(*) + count(*) FILTER (WHERE http_status = 429)) > 0.01 AS rejecting FROM obs, (SELECT max(received_at) AS hi FROM obs) WHERE received_at BETWEEN hi - 3600 AND hi GROUP BY feed_id, hi"))(lambda spark, d: health.operational_rates(r := raw(spark, d), r.where("http_status = 429"), r.agg(F.max("received_at")).first()[0] or 0))
query("st_quota", over_obs("SELECT tenant_id, 'day' AS span, (received_at // 86400) * 86400 AS at, sum(length(user_agent)) AS used FROM obs GROUP BY ALL HAVING sum(length(user_agent)) > 2000"))(
    lambda spark, d: health.quota(raw(spark, d).withColumn("bytes", F.length("user_agent")), 1_000, 2_000)
)
QUOTAS = {"second": 1, "day": 2_000}


@query("st_quota_live", over_obs("SELECT * FROM (SELECT tenant_id, 'day' AS span, (received_at // 86400) * 86400 AS at, sum(length(user_agent)) AS used FROM obs GROUP BY ALL HAVING sum(length(user_agent)) > 2000 UNION ALL SELECT tenant_id, 'second', received_at, count(*) FROM obs GROUP BY ALL HAVING count(*) > 1)"))
def quota_live(spark, d):
    """All observations sent through the streaming counters of both quotas, in the order of their receipt."""
    folder = shared_path(spark, "quota")
    used = raw(spark, d).select("tenant_id", "received_at", F.length("user_agent").alias("bytes"))
    used.repartitionByRange(4, "received_at").sortWithinPartitions("received_at").write.parquet(f"{folder}/in")
    for span, limit in QUOTAS.items():
        stream = spark.readStream.schema(used.schema).parquet(f"{folder}/in")
        pipeline.start(pipeline.over_quota(stream, span, limit), folder, f"{folder}/state-{span}", pipeline.quota_batch(f"{folder}/over/of={span}"), mode="update").awaitTermination()
    return pipeline.overruns(spark, f"{folder}/over")


@query("st_drift_once", over_obs("SELECT tenant_id, feed_id, (event_time // 600) * 600 AS window_start FROM obs GROUP BY ALL HAVING count(*) FILTER (WHERE matched_rule <> '') > 0.01 * count(*)"))
def drift_once(spark, d):
    """All observations sent through the warnings of drift in four batches: each window warns in the first batch that shows it."""
    folder = shared_path(spark, "drift")
    rows = raw(spark, d).select("tenant_id", "feed_id", "event_time", "received_at", F.filter(F.array("matched_rule"), lambda x: x != "").alias("unknown_fields"))
    for k, part in enumerate((r := rows.approxQuantile("received_at", [0.25, 0.5, 0.75], 0.001)) + [None] if rows.limit(1).count() else []):
        own = rows.where((F.lit(True) if k == 0 else F.col("received_at") > r[k - 1]) & (F.lit(True) if part is None else F.col("received_at") <= part))
        own.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    pipeline.start(pipeline.drifting(stream), folder, f"{folder}/state", pipeline.warn_batch(f"{folder}/warnings"), mode="update").awaitTermination()
    return spark.read.parquet(f"{folder}/warnings").select("tenant_id", "feed_id", "window_start")


def _delays(spark, d):
    """Observations with delays from 0 to 96 seconds, and the fields that their feed doesn't know."""
    rows = raw(spark, d).withColumn("event_time", F.col("received_at") - F.col("received_at") % 97)
    return rows.withColumn("unknown_fields", F.filter(F.array("matched_rule"), lambda x: x != ""))


@query("ops_rate_states", over_obs("SELECT tenant_id, feed_id, count(*) AS accepted, count(*) FILTER (WHERE http_status = 429) AS rejected, count(*) FILTER (WHERE matched_rule <> '') AS drifted, max(received_at) AS last, max(received_at) < hi - 900 AS silent, count(*) FILTER (WHERE http_status = 429) / (count(*) + count(*) FILTER (WHERE http_status = 429)) > 0.01 AS rejecting, count(*) FILTER (WHERE matched_rule <> '') > 0.01 * count(*) AS drifting, true AS late, true AS near FROM obs, (SELECT max(received_at) AS hi FROM obs) GROUP BY tenant_id, feed_id, hi"))
def rate_states(spark, d):
    """Rates from states of all minutes. `near`: the delay's 95 % quantile lies between the exact ones at 93 and 97 %."""
    rows = _delays(spark, d)
    now = rows.agg(F.max("received_at")).first()[0] or 0
    out = health.ingest_rates(health.ingest_minutes(rows, rows.where("http_status = 429")), now, now + 1)
    exact = rows.groupBy("tenant_id", "feed_id").agg(F.expr("percentile_disc(0.93) WITHIN GROUP (ORDER BY received_at - event_time)").alias("lo"), F.expr("percentile_disc(0.97) WITHIN GROUP (ORDER BY received_at - event_time)").alias("hi"))
    return out.join(exact, ["tenant_id", "feed_id"]).withColumn("near", F.col("lag_p95").between(F.col("lo"), F.col("hi"))).drop("lo", "hi", "lag_p95")


@query("ops_request_states", over_obs("SELECT tenant_id, count(*) AS requests, count(*) FILTER (WHERE http_status + 100 >= 500) AS errors, count(*) FILTER (WHERE http_status + 100 >= 500) / count(*) > 0.02 AS failing, true AS slow, true AS near FROM obs GROUP BY tenant_id"))
def request_states(spark, d):
    """The same of requests: observations stand for requests that took up to 3.88 seconds, those of status 403 and above failed."""
    rows = raw(spark, d).select("tenant_id", F.col("received_at").alias("at"), (F.col("http_status") + 100).alias("status"), (F.col("received_at") % 98 / 25.0).alias("seconds"))
    now = rows.agg(F.max("at")).first()[0] or 0
    out = health.request_rates(health.request_minutes(rows), now, now + 1)
    exact = rows.groupBy("tenant_id").agg(F.expr("percentile_disc(0.93) WITHIN GROUP (ORDER BY seconds)").alias("lo"), F.expr("percentile_disc(0.97) WITHIN GROUP (ORDER BY seconds)").alias("hi"))
    return out.join(exact, "tenant_id").withColumn("near", F.col("took_p95").between(F.col("lo"), F.col("hi"))).drop("lo", "hi", "took_p95")


PEOPLE = "SELECT 'tenant-' || (c_custkey % 3) AS tenant_id, lower(c_mktsegment) || (c_nationkey) || '@example.com' AS email, c_acctbal FROM customer"


def _people(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(
        F.concat(F.lit("tenant-"), (F.col("c_custkey") % 3).cast("string")).alias("tenant_id"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string"), F.lit("@example.com")).alias("email"), "c_acctbal"
    )


query("agg_uniqueness_check", f"SELECT tenant_id, email, count(*) AS n FROM ({PEOPLE}) GROUP BY ALL HAVING count(*) > 1")(lambda spark, d: lookups.duplicates(_people(spark, d), [F.col("tenant_id"), F.lower("email")], ["tenant_id", "email"]))
query("agg_count_admins", f"SELECT tenant_id, count(*) AS n FROM ({PEOPLE}) WHERE c_acctbal > 5000 GROUP BY ALL")(lambda spark, d: _people(spark, d).where("c_acctbal > 5000").groupBy("tenant_id").agg(F.count("*").alias("n")))
query("resolve_unique", f"SELECT min(tenant_id) AS tenant_id, count(DISTINCT tenant_id) = 1 AS \"unique\" FROM ({PEOPLE}) WHERE email = 'building3@example.com' HAVING count(*) > 0")(lambda spark, d: lookups.resolve_unique(_people(spark, d), "Building3@example.com"))
query("retention_delete", over_obs("SELECT event_id, ingest_version FROM obs, (SELECT max(event_time) AS hi FROM obs) WHERE event_time >= hi - 86400 * CASE tenant_id WHEN 'tenant-0' THEN 30 WHEN 'tenant-1' THEN 7 ELSE 730 END"))(
    lambda spark, d: upkeep.retained(r := raw(spark, d), _retention(spark), r.agg(F.max("event_time")).first()[0] or 0).select("event_id", "ingest_version")
)


def _retention(spark):
    return spark.createDataFrame([("tenant-0", 0), ("tenant-1", 7), ("tenant-2", 4_000)], "tenant_id string, retention_days int")


query("purge_range", over_obs(f"SELECT event_id, ingest_version FROM obs, {SPAN} WHERE NOT (tenant_id = 'tenant-1' AND event_time >= lo + 1000 AND event_time < lo + 500000)"))(
    lambda spark, d: upkeep.purged(r := raw(spark, d), "tenant-1", (lo := _span(r)[0]) + 1_000, lo + 500_000, "asked for")[0].select("event_id", "ingest_version")
)
query("purge_all", over_obs("SELECT event_id FROM obs LIMIT 0"))(lambda spark, d: upkeep.purge_all(raw(spark, d)).select("event_id"))
query("storage_days_to_full", over_obs("SELECT sum(bytes) AS used, round(avg(bytes) FILTER (WHERE day <> (SELECT max(event_time // 86400) FROM obs)), 6) AS per_day FROM (SELECT event_time // 86400 AS day, sum(length(user_agent)) AS bytes FROM obs GROUP BY 1)"))(
    lambda spark, d: upkeep.days_to_full(x := raw(spark, d).groupBy(t.bucket_start(F.col("event_time"), 1).alias("s"), F.floor(F.col("event_time") / 86_400).alias("day")).agg(F.sum(F.length("user_agent")).alias("bytes")).groupBy("day").agg(F.sum("bytes").alias("bytes")), 1 << 40, x.agg(F.max("day")).first()[0]).select("used", F.round("per_day", 6).alias("per_day"))
)


def _audit(spark, d):
    return raw(spark, d).where("ingest_version = 1").select(
        "tenant_id", F.col("event_id").alias("entry_id"), F.col("event_time").alias("occurred_at"), F.col("client_ip").alias("actor"), F.col("verdict").alias("action"), F.col("request_host").alias("target"), F.col("user_agent").alias("detail")
    )


@query("win_chain_link", over_obs("SELECT tenant_id, event_id AS entry_id, event_id <> 'cloudflare-30' AS intact, coalesce(lag(event_id) OVER (PARTITION BY tenant_id ORDER BY event_time, event_id), '') <> 'x' AS linked FROM obs WHERE ingest_version = 1"))
def chain_link(spark, d):
    """A chain in which one entry's text was changed afterwards: it alone is no longer intact."""
    rows = upkeep.chained(_audit(spark, d)).withColumn("detail", F.when(F.col("entry_id") == "cloudflare-30", "changed").otherwise(F.col("detail")))
    return upkeep.verify_chain(rows).select("tenant_id", "entry_id", "intact", "linked")


query("list_audit", over_obs(f"SELECT event_id AS entry_id, event_time AS occurred_at FROM obs, {SPAN} WHERE ingest_version = 1 AND verdict = 'blocked' AND event_time BETWEEN lo AND lo + 1000000"))(
    lambda spark, d: upkeep.list_audit(upkeep.chained(_audit(spark, d)), lo := _span(raw(spark, d))[0], lo + 1_000_000, action="blocked").select("entry_id", "occurred_at")
)
query("backfill_column", over_events("SELECT event_id, 'ua-' || regexp_extract(user_agent, 'probe([0-9])', 1) AS ja4, ingest_version + 1 AS ingest_version FROM ev WHERE ja4 = ''"))(
    lambda spark, d: lookups.backfill_column(r := raw(spark, d), r.select("tenant_id", "event_id", "received_at", F.concat(F.lit("ja4=ua-"), F.regexp_extract("user_agent", "probe([0-9])", 1), F.lit(";")).alias("payload")), "ja4", "ja4=([^;]+)").select("event_id", "ja4", "ingest_version")
)

# Alerts, rules and feeds in versions, made of orders and suppliers.
ALERTS = (
    "SELECT CAST(o_orderkey AS {s}) AS alert_id, 'rule-' || CAST(o_custkey % 5 AS {s}) AS rule_id, CASE WHEN o_totalprice > 200000 THEN 'critical' ELSE 'warning' END AS severity, "
    "CASE WHEN o_orderstatus = 'F' THEN 'new' WHEN o_orderstatus = 'O' THEN 'acknowledged' ELSE 'resolved' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 'sent' ELSE 'pending' END AS notify_status, "
    "CAST(o_orderkey * 10 AS BIGINT) AS fired_at, CAST(o_orderkey % 6 AS INT) AS attempts, CAST(o_orderkey * 10 + o_custkey % 100 AS BIGINT) AS next_attempt_at, CAST(NULL AS BIGINT) AS acknowledged_at, CAST(NULL AS BIGINT) AS resolved_at, CAST(1 AS BIGINT) AS version FROM orders"
)
ALERTS_SQL = ALERTS.format(s="VARCHAR")
RULE_ROWS = "SELECT 'tenant-' || CAST(s_suppkey % 3 AS {s}) AS tenant_id, 'a' || CAST(s_suppkey % 40 AS {s}) AS rule_id, s_name AS name, s_suppkey % 4 <> 0 AS enabled, CAST(s_suppkey AS BIGINT) AS version FROM supplier"
FEED_ROWS = "SELECT 'tenant-' || CAST(s_suppkey % 3 AS {s}) AS tenant_id, 'feed-' || CAST(s_suppkey % 40 AS {s}) AS feed_id, CASE WHEN s_nationkey % 2 = 0 THEN 'pull' ELSE 'push' END AS mode, s_suppkey % 5 <> 0 AS enabled, CAST(s_suppkey AS BIGINT) AS version FROM supplier"


def _from(table: str, select: str):
    sql = select.format(s="STRING").replace(f" FROM {table}", " FROM {rows}")
    return lambda spark, d: spark.sql(sql, rows=spark.read.parquet(f"{d}/{table}.parquet"))


_alerts, _alert_rules, _feeds = _from("orders", ALERTS), _from("supplier", RULE_ROWS), _from("supplier", FEED_ROWS)
NEWEST = "(SELECT * FROM ({0}) QUALIFY row_number() OVER (PARTITION BY tenant_id, {1} ORDER BY version DESC) = 1)"
query("list_alerts", f"SELECT alert_id, fired_at FROM ({ALERTS_SQL}) WHERE state = 'acknowledged' AND severity = 'critical' AND fired_at < 4000000 ORDER BY fired_at DESC, alert_id DESC LIMIT 500")(
    lambda spark, d: alerts.list_alerts(_alerts(spark, d), 0, 4_000_000, state="acknowledged", severity="critical", limit=1_000).select("alert_id", "fired_at")
)
query("list_pending_deliveries", f"SELECT alert_id, fired_at FROM ({ALERTS_SQL}) WHERE notify_status = 'pending' AND next_attempt_at <= 20000 ORDER BY fired_at, alert_id LIMIT 50")(
    lambda spark, d: alerts.pending_deliveries(_alerts(spark, d), 20_000).select("alert_id", "fired_at")
)
query("alert_transition", f"SELECT alert_id, 'resolved' AS state, 77 AS acknowledged_at, 77 AS resolved_at, 2 AS version FROM ({ALERTS_SQL}) WHERE alert_id IN ('1', '2', '3', '4', '5', '6', '7') AND state <> 'resolved'")(
    lambda spark, d: alerts.transition(_alerts(spark, d), [str(k) for k in range(1, 8)], "resolved", 77).select("alert_id", "state", "acknowledged_at", "resolved_at", "version")
)
query("st_alert_retry", f"SELECT alert_id, CASE WHEN ok THEN 'sent' WHEN attempts >= 4 THEN 'failed' ELSE 'pending' END AS notify_status, attempts + 1 AS attempts, CASE WHEN NOT ok AND attempts < 4 THEN 1000 + 2 * pow(2, attempts)::BIGINT END AS next_attempt_at, 2 AS version FROM (SELECT *, fired_at % 40 = 0 AS ok FROM ({ALERTS_SQL}) WHERE notify_status = 'pending')")(
    lambda spark, d: alerts.after_attempts(a := _alerts(spark, d), a.select("alert_id", (F.col("fired_at") % 40 == 0).alias("delivered")), 1_000).select("alert_id", "notify_status", "attempts", "next_attempt_at", "version")
)
query("list_rules", f"SELECT rule_id, name, enabled, version FROM {NEWEST.format(RULE_ROWS.format(s='VARCHAR'), 'rule_id')} WHERE tenant_id = 'tenant-1'")(lambda spark, d: lookups.list_rules(_alert_rules(spark, d), "tenant-1").select("rule_id", "name", "enabled", "version"))
query("list_enabled_rules", f"SELECT tenant_id, rule_id, version FROM {NEWEST.format(RULE_ROWS.format(s='VARCHAR'), 'rule_id')} WHERE enabled")(lambda spark, d: lookups.enabled_rules(_alert_rules(spark, d)).select("tenant_id", "rule_id", "version"))
query("list_feeds", f"SELECT feed_id, mode, enabled, version FROM {NEWEST.format(FEED_ROWS.format(s='VARCHAR'), 'feed_id')} WHERE tenant_id = 'tenant-2'")(lambda spark, d: lookups.list_feeds(_feeds(spark, d), "tenant-2").select("feed_id", "mode", "enabled", "version"))
query("list_pull_feeds", f"SELECT tenant_id, feed_id, version FROM {NEWEST.format(FEED_ROWS.format(s='VARCHAR'), 'feed_id')} WHERE enabled AND mode = 'pull'")(lambda spark, d: lookups.pull_feeds(_feeds(spark, d)).select("tenant_id", "feed_id", "version"))

# --- formats ------------------------------------------------------------------------------------

def _payloads(spark, d, payload: str):
    return raw(spark, d).where("ingest_version = 1").select("event_id", F.expr(payload).alias("payload"))


def _fields(spark, d, payload: str, *names: str):
    """Fields of every record of a payload made of an observation."""
    rows = payloads.with_fields(payloads.lines_of(_payloads(spark, d, payload)))
    return rows.select("event_id", "format", *(F.try_element_at("fields", F.lit(n)).alias(n) for n in names))


query("detect_format", over_obs("SELECT event_id, ['json', 'ndjson', 'cef', 'syslog', 'unknown'][(event_time % 5) + 1] AS format FROM obs WHERE ingest_version = 1"))(
    lambda spark, d: _payloads(spark, d, "elt(CAST(event_time % 5 AS INT) + 1, ' [{}]', '{\"a\":1}', '<13>May  1 host CEF:0|F5|ASM|1|2|n|5|act=x', 'support_id=\"7\",ip_client=\"1.2.3.4\"', 'GET / HTTP/1.1')").select("event_id", payloads.detect_format(F.col("payload")).alias("format"))
)
query("fmt_json_array", over_obs("SELECT event_id, 'ndjson' AS format, v, event_id || v AS id FROM obs, (VALUES ('1'), ('2')) t(v) WHERE ingest_version = 1"))(
    lambda spark, d: _fields(spark, d, "concat('[{\"id\":\"', event_id, '1\",\"v\":1}, {\"id\":\"', event_id, '2\",\"v\":\"2\"}]')", "v", "id")
)
query("fmt_ndjson", over_obs("SELECT event_id, 'ndjson' AS format, v, event_id || v AS id FROM obs, (VALUES ('1'), ('2')) t(v) WHERE ingest_version = 1"))(
    lambda spark, d: _fields(spark, d, "concat('{\"id\":\"', event_id, '1\",\"v\":1}\n\n{\"v\":\"2\",\"id\":\"', event_id, '2\"}\r\n')", "v", "id")
)
query("fmt_cef", over_obs("SELECT event_id, 'cef' AS format, 'ASM' AS device_product, event_id AS \"externalId\", request_path || ' a=b' AS request, 'p ' || vendor AS policy, verdict AS act FROM obs WHERE ingest_version = 1"))(
    lambda spark, d: _fields(spark, d, r"concat('CEF:0|F5|ASM|15.1|200|x|5|externalId=', event_id, ' request=', request_path, ' a\\=b cs1Label=policy cs1=p ', vendor, ' act=', verdict)", "device_product", "externalId", "request", "policy", "act")
)
query("fmt_syslog_kv", over_obs("SELECT event_id, 'syslog' AS format, event_id AS support_id, client_ip AS ip_client, 'a \"b\", c' AS violations, verdict AS request_status FROM obs WHERE ingest_version = 1 AND client_ip IS NOT NULL"))(
    lambda spark, d: _fields(spark, d, "concat('support_id=\"', event_id, '\",ip_client=\"', client_ip, '\",violations=\"a \"\"b\"\", c\",request_status=', verdict)", "support_id", "ip_client", "violations", "request_status")
)

# --- scalar functions ---------------------------------------------------------------------------

PAGES = "SELECT page_id, url FROM pages"


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")


@query("fn_split_uri", "SELECT page_id, CASE WHEN instr(u, '?') > 0 THEN substr(u, 1, instr(u, '?') - 1) ELSE u END AS path, CASE WHEN instr(u, '?') > 0 THEN substr(u, instr(u, '?') + 1) ELSE '' END AS query FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '?a=1?b' ELSE url END AS u FROM pages)")
def fn_split_uri(spark, d):
    rows = _pages(spark, d).withColumn("u", F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("?a=1?b"))).otherwise(F.col("url")))
    path, rest = t.split_uri(F.col("u"))
    return rows.select("page_id", path.alias("path"), rest.alias("query"))


query("fn_norm_path", "SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, CASE WHEN length(s) > 1 THEN regexp_replace(s, '/$', '') ELSE s END AS p FROM (SELECT page_id, regexp_replace(lower(trim(' /A//' || url || '// ')), '/+', '/', 'g') AS s FROM pages))")(
    lambda spark, d: _pages(spark, d).select("page_id", t.norm_path(F.concat(F.lit(" /A//"), "url", F.lit("// "))).alias("path"))
)
query("fn_time_bucket", over_obs("SELECT event_id, ingest_version, event_time // 5 AS w, (event_time // 3600) * 3600 AS h FROM obs"))(
    lambda spark, d: raw(spark, d).select("event_id", "ingest_version", t.time_bucket(F.timestamp_seconds("event_time"), 5_000_000).alias("w"), t.bucket_start(F.col("event_time"), 3_600).alias("h"))
)
query("fn_parse_time", over_obs("SELECT event_id, ingest_version, event_time AS a, event_time AS b, event_time AS c, event_time AS d FROM obs"))(
    lambda spark, d: raw(spark, d).select(
        "event_id", "ingest_version",
        F.unix_seconds(t.parse_time(F.col("event_time"))).alias("a"),
        F.unix_seconds(t.parse_time(F.col("event_time") * 1_000)).alias("b"),
        F.unix_seconds(t.parse_time(F.date_format(F.timestamp_seconds("event_time"), "yyyy-MM-dd'T'HH:mm:ssXXX"))).alias("c"),
        F.unix_seconds(t.parse_time(F.col("event_time") * 1_000_000_000)).alias("d"),
    )
)
query("fn_parse_ip", over_obs("SELECT event_id, ingest_version, client_ip AS ip, client_ip AS with_port, NULL::VARCHAR AS bad FROM obs"))(
    lambda spark, d: raw(spark, d).select("event_id", "ingest_version", t.parse_ip(F.col("client_ip")).alias("ip"), t.parse_ip(F.concat("client_ip", F.lit(":443"))).alias("with_port"), t.parse_ip(F.concat("client_ip", F.lit("x"))).alias("bad"))
)
OCTETS = "SELECT event_id, ingest_version, (event_time % 256) AS a, (event_time // 256 % 256) AS b FROM obs"
query("fn_is_shared_ip", over_obs(f"SELECT event_id, ingest_version, a = 10 OR a = 127 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) AS shared FROM ({OCTETS})"))(
    lambda spark, d: raw(spark, d).select("event_id", "ingest_version", t.is_shared_ip(F.concat_ws(".", (F.col("event_time") % 256).cast("string"), (F.floor(F.col("event_time") / 256) % 256).cast("string"), F.lit("3"), F.lit("4"))).alias("shared"))
)
query("fn_last_untrusted_hop", over_obs("SELECT event_id, ingest_version, '8.8.' || (event_time % 250) || '.1' AS hop FROM obs"))(
    lambda spark, d: raw(spark, d).select("event_id", "ingest_version", t.last_untrusted_hop(F.concat(F.lit("9.9.9.9, 8.8."), (F.col("event_time") % 250).cast("string"), F.lit(".1, 10.1.2.3, 7.7.7.7")), F.lit("7.7.7.7")).alias("hop"))
)
query("fn_event_id", over_obs("SELECT event_id, ingest_version, sha256(strlen(feed_id) || ':' || feed_id || '|3:rid|' || strlen(vendor || '|' || vendor_request_id) || ':' || vendor || '|' || vendor_request_id || '|') AS id FROM obs"))(
    lambda spark, d: raw(spark, d).select("event_id", "ingest_version", t.event_identity(F.col("feed_id"), F.col("vendor"), F.col("vendor_request_id"), F.col("user_agent")).alias("id"))
)
query("fn_uuid_from_hash", over_obs("SELECT event_id, ingest_version, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT *, sha256(event_id) AS h FROM obs)"))(
    lambda spark, d: raw(spark, d).select("event_id", "ingest_version", t.uuid_of(F.col("event_id")).alias("id"))
)
query("fn_cf_verdict", over_obs("SELECT event_id, ingest_version, CASE waf_action WHEN 'block' THEN 'blocked' WHEN 'log' THEN 'monitored' WHEN 'simulate' THEN 'monitored' WHEN 'challenge' THEN 'challenged' ELSE 'allowed' END AS verdict FROM obs"))(
    lambda spark, d: raw(spark, d).select("event_id", "ingest_version", v.cloudflare_verdict(F.upper("waf_action")).alias("verdict"))
)
query("fn_f5_verdict", over_obs("SELECT event_id, ingest_version, CASE WHEN http_status <> 403 THEN 'allowed' WHEN violation = 'VIOL-1' THEN 'rate_limited' ELSE 'blocked' END AS verdict FROM obs WHERE vendor = 'f5'"))(
    lambda spark, d: raw(spark, d).where("vendor = 'f5'").select("event_id", "ingest_version", v.f5_verdict(F.when(F.col("http_status") == 403, "Blocked").otherwise("passed"), F.when(F.col("violation") == "VIOL-1", "Brute Force").otherwise(F.col("violation")), F.lit(None).cast("string"), F.lit("")).alias("verdict"))
)
query("fn_dd_verdict", over_obs("SELECT event_id, ingest_version, CASE WHEN verdict = 'blocked' THEN 'blocked' WHEN verdict = 'challenged' THEN 'challenged' WHEN score > 0.5 THEN 'monitored' ELSE 'allowed' END AS verdict FROM obs WHERE vendor = 'datadome'"))(
    lambda spark, d: raw(spark, d).where("vendor = 'datadome'").select("event_id", "ingest_version", v.datadome_verdict(F.when(F.col("verdict") == "blocked", "hardblock").when(F.col("verdict") == "challenged", "captcha").otherwise(""), F.col("score") > 0.5).alias("verdict"))
)
query("fn_nginx_verdict", over_obs("SELECT event_id, ingest_version, CASE WHEN event_time % 2 = 0 THEN 'allowed' WHEN http_status = 403 THEN 'blocked' WHEN http_status = 429 THEN 'rate_limited' ELSE 'allowed' END AS verdict FROM obs"))(
    lambda spark, d: raw(spark, d).select("event_id", "ingest_version", v.nginx_verdict(F.when(F.col("event_time") % 2 == 0, "10.0.0.1:80").otherwise("-"), F.col("http_status")).alias("verdict"))
)
query("fn_dd_call_verdict", over_obs("SELECT event_id, ingest_version, CASE http_status WHEN 200 THEN CASE WHEN event_time % 3 = 0 THEN 'monitored' ELSE 'allowed' END WHEN 403 THEN CASE WHEN event_time % 3 = 0 THEN 'blocked' ELSE 'challenged' END ELSE 'unknown' END AS verdict FROM obs"))(
    lambda spark, d: raw(spark, d).select("event_id", "ingest_version", v.datadome_call_verdict(F.col("http_status"), F.when(F.col("event_time") % 3 == 0, "HARD_BLOCK")).alias("verdict"))
)
query("fn_casts", over_obs("SELECT event_id, ingest_version, http_status AS status, 0 AS bad_status, client_asn AS asn, 1.5::DOUBLE AS number, 'a+b' AS parts FROM obs"))(
    lambda spark, d: raw(spark, d).select("event_id", "ingest_version", t.to_status(F.col("http_status").cast("string")).alias("status"), t.to_status(F.lit("abc")).alias("bad_status"), t.as_uint32(F.concat(F.lit("as"), F.col("client_asn").cast("string"))).alias("asn"), t.as_float(F.lit(" 1.5 ")).alias("number"), F.array_join(t.as_list(F.lit("a; b ,")), "+").alias("parts"))
)
query("fn_waf_score", over_obs("SELECT event_id, ingest_version, waf_attack_score AS a, CASE WHEN waf_attack_score BETWEEN 1 AND 50 THEN waf_attack_score * 2 ELSE 0 END AS b FROM obs"))(
    lambda spark, d: raw(spark, d).select("event_id", "ingest_version", t.waf_score(F.col("waf_attack_score")).alias("a"), t.waf_score(F.col("waf_attack_score") * 2).alias("b"))
)
query("fn_header_extract", over_obs("SELECT event_id, ingest_version, vendor_request_id AS host, 'abc' AS ray FROM obs"))(
    lambda spark, d: raw(spark, d).select("event_id", "ingest_version", t.header_of(r := F.concat(F.lit("GET / HTTP/1.1\r\nX-Host: "), "vendor_request_id", F.lit("\\r\\nCF-Ray: abc-FRA\r\n\r\n")), "x-host").alias("host"), t.ray_of(r).alias("ray"))
)
query("fn_redact", over_obs("SELECT event_id, ingest_version, regexp_replace(user_agent, 'probe[0-9]', '***') AS ua, '***' AS extra FROM obs"))(
    lambda spark, d: raw(spark, d).select("event_id", "ingest_version", t.redact(F.col("user_agent"), "probe[0-9]").alias("ua"), t.redact_extras(F.create_map(F.lit("k"), F.concat(F.lit("x"), "user_agent")), [F.col("user_agent")])["k"].alias("extra"))
)
@query("fn_redact_policy", over_obs("""SELECT event_id, ingest_version, CASE tenant_id WHEN 'tenant-0' THEN '[REDACTED]' ELSE user_agent END AS ua, CASE tenant_id WHEN 'tenant-1' THEN '[REDACTED]' ELSE request_path END AS path, CASE tenant_id WHEN 'tenant-1' THEN NULL ELSE client_ip END AS ip,
    CASE tenant_id WHEN 'tenant-0' THEN '[REDACTED]' ELSE user_agent END AS e_ua, CASE tenant_id WHEN 'tenant-1' THEN '[REDACTED]' ELSE request_method || ' ' || request_path END AS e_line, CASE tenant_id WHEN 'tenant-1' THEN '[REDACTED]' ELSE ja4 END AS e_secret FROM obs"""))
def redact_policy(spark, d):
    """Each tenant's policy over all its observations, the vendor's own fields included."""
    line = F.concat_ws(" ", "request_method", "request_path")
    rows = raw(spark, d).withColumn("raw_extra", F.create_map(F.lit("ClientRequestUserAgent"), F.col("user_agent"), F.lit("line"), line, F.lit("Secret"), F.col("ja4")))
    policy = F.when(F.col("tenant_id") == "tenant-0", F.array(F.lit("user_agent"))).when(F.col("tenant_id") == "tenant-1", F.array(F.lit(" Request_Path "), F.lit("client_ip"), F.lit("secret")))
    e = F.col("raw_extra")
    return redaction.redacted(rows, policy).select("event_id", "ingest_version", F.col("user_agent").alias("ua"), F.col("request_path").alias("path"), F.col("client_ip").alias("ip"), e["ClientRequestUserAgent"].alias("e_ua"), e["line"].alias("e_line"), e["Secret"].alias("e_secret"))


CAPTURED = {"http.host": "coalesce(request_host, '')", "http.request.method": "request_method", "http.request.uri.path": "request_path", "http.request.uri.query": "CASE WHEN http_status = 200 THEN '' ELSE 'a=1' END", "http.request.uri": "request_path || CASE WHEN http_status = 200 THEN '' ELSE '?a=1' END", "http.user_agent": "CASE WHEN vendor = 'f5' THEN 'seen ' || event_id ELSE user_agent END", "http.referer": "'https://' || event_id", "http.cookie": "'s=\"1\"'", "ip.src": "client_ip"}


@query("fn_captured_fields", over_obs("SELECT event_id, ingest_version, " + ", ".join(f"{v} AS {k.replace('.', '_')}" for k, v in CAPTURED.items()) + ", 'x=' || verdict AS body, true AS truncated FROM obs"))
def captured(spark, d):
    """Requests as an appliance captures them: line breaks as two characters, quotes escaped; f5's events have no user agent of their own."""
    text = F.concat(F.lit("GET /other HTTP/1.1\\r\\nUser-Agent: seen "), "event_id", F.lit("\\r\\nREFERER: https://"), "event_id", F.lit("\\r\\ncookie: s=%221%22\\r\\nCookie: again\\r\\n\\r\\nx="), "verdict")
    own = F.when(F.col("vendor") != "f5", F.col("user_agent"))
    found = t.captured_fields(text, F.col("request_host"), F.col("request_method"), F.col("request_path"), F.expr(CAPTURED["http.request.uri.query"]), own, F.col("client_ip"))
    rows = raw(spark, d).withColumn("c", found)
    return rows.select("event_id", "ingest_version", *(F.try_element_at("c.fields", F.lit(k)).alias(k.replace(".", "_")) for k in CAPTURED), "c.body", "c.truncated")


query("fn_extra_unknown", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'extra,other' ELSE 'other' END AS names FROM events")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", F.array_join(t.extra_fields(F.when(F.col("event_id") % 2 == 0, '{"k":1,"extra":"a","other":2}').otherwise('{"k":1,"other":2}'), ["k"])[1], ",").alias("names"))
)
query("fn_csv_safe", "SELECT doc_id, CASE WHEN regexp_matches(x, '^[=+@-]') THEN '''' || x ELSE x END AS safe FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '=' || source ELSE source END AS x FROM documents)")(
    lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", t.csv_safe(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("="), "source")).otherwise(F.col("source"))).alias("safe"))
)
query("fn_hash_chain", over_obs("SELECT event_id, ingest_version, sha256(strlen(tenant_id) || ':' || tenant_id || '|' || strlen(event_id) || ':' || event_id || '|0:|') AS h FROM obs"))(
    lambda spark, d: raw(spark, d).select("event_id", "ingest_version", t.hash_chain(F.col("tenant_id"), F.col("event_id"), F.lit(None)).alias("h"))
)
query("fn_cooldown_key", over_obs("SELECT event_id, ingest_version, sha256('2:r1|1:a|' || strlen(vendor) || ':' || vendor || '|1:b|' || strlen(tenant_id) || ':' || tenant_id || '|') AS key FROM obs"))(
    lambda spark, d: raw(spark, d).select("event_id", "ingest_version", t.cooldown_key(F.lit("r1"), F.create_map(F.lit("b"), F.col("tenant_id"), F.lit("a"), F.col("vendor"))).alias("key"))
)
query("fn_parse_transcript", over_obs("SELECT event_id, ingest_version, request_method AS method, request_path AS path, 'q=1' AS query, request_host AS host, 'body' AS body FROM obs"))(
    lambda spark, d: raw(spark, d).select("event_id", "ingest_version", t.transcript(F.concat("request_method", F.lit(" "), "request_path", F.lit("?q=1 HTTP/1.1\r\nHost: "), "request_host", F.lit("\r\nX-A: 1\r\n\r\nbody"))).alias("r")).select("event_id", "ingest_version", "r.method", "r.path", "r.query", F.try_element_at("r.headers", F.lit("host")).alias("host"), "r.body")
)
