"""Vendor payloads brought into the common event model.

A batch of payload lines is told apart by its first characters, turned into a map of fields, and
projected by its vendor's adapter. A line that can't be read is rejected alone, with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import verdicts as v
from ..operators.components import cut
from ..schemas import EVENT_COLUMNS

# Rejection codes, the longest line, the bot service's host behind the edge, header names in CEF.
PARSE_ERROR, BAD_TIME, TOO_LONG = "PARSE_ERROR", "TIMESTAMP_UNPARSABLE", "LINE_TOO_LONG"
LONGEST_LINE = 4 << 20
BOT_API_HOST = "api-cloudflare.datadome.co"
CEF_HEADER = ("version", "device_vendor", "device_product", "device_version", "signature_id", "name", "severity")
MAP = "map<string,string>"


def detect_format(payload: Column) -> Column:
    """json (an array), ndjson, cef, syslog or unknown, by how a payload begins."""
    head = F.ltrim(payload)
    return (
        F.when(head.startswith("["), "json")
        .when(head.startswith("{"), "ndjson")
        .when(head.rlike(r"^(<\d+>)?.{0,80}?CEF:\d"), "cef")
        .when(head.rlike(r"(^|[\s,])(support_id|ip_client)="), "syslog")
        .otherwise("unknown")
    )


def lines_of(batches: DataFrame, payload: str = "payload") -> DataFrame:
    """One row for each record of a payload: `line` and `format`. Arrays are unrolled, other formats go by lines."""
    kind = detect_format(F.col(payload))
    items = F.from_json(payload, "array<string>")
    rows = batches.withColumn("format", kind).withColumn("line", F.explode(F.when((F.col("format") == "json") & items.isNotNull(), items).otherwise(F.split(payload, "\r?\n"))))
    return rows.where(F.trim("line") != "").withColumn("format", F.when(F.col("format") == "json", "ndjson").otherwise(detect_format(F.col("line"))))


KEY = r"[A-Za-z][A-Za-z0-9_.]*"


def _as_map(pairs: Column) -> Column:
    """A column of pairs as a map; of repeated keys the first counts."""
    firsts = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
    return F.map_from_entries(firsts)


def with_cef_fields(lines: DataFrame) -> DataFrame:
    """Header parts and extension of CEF lines as `cef`; a value runs to the next key, and labelled fields go by their label too.

    Each step is a column of its own, so that no step is computed more than once.
    """
    pattern = F.lit(rf"(?:^|\s)({KEY})=((?:(?!\s{KEY}=).)*)")
    parts = F.concat(F.split(F.regexp_extract("line", r"CEF:(.*)$", 1), r"(?<!\\)\|", 8), F.array_repeat(F.lit(""), 8))
    clean = lambda k, v: F.struct(k.alias("key"), F.trim(F.regexp_replace(v, r"\\([=|\\])", "$1")).alias("value"))
    value_of = lambda name: F.try_element_at(F.filter("_own", lambda q: q["key"] == name), F.lit(1))["value"]
    labels = F.transform(F.filter("_own", lambda p: p["key"].endswith("Label") & (p["value"] != "")), lambda p: F.struct(p["value"].alias("key"), value_of(F.regexp_replace(p["key"], "Label$", "")).alias("value")))
    header = F.transform(F.arrays_zip(F.array(*map(F.lit, CEF_HEADER)).alias("k"), F.slice("_parts", 1, len(CEF_HEADER)).alias("v")), lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value")))
    return (
        lines.withColumn("_parts", parts)
        .withColumn("_own", F.zip_with(F.regexp_extract_all(F.col("_parts")[7], pattern, F.lit(1)), F.regexp_extract_all(F.col("_parts")[7], pattern, F.lit(2)), clean))
        .withColumn("_pairs", F.concat(header, F.filter(labels, lambda p: p["value"].isNotNull()), "_own"))
        .withColumn("cef", _as_map(F.col("_pairs")))
        .drop("_parts", "_own", "_pairs")
    )


def with_syslog_fields(lines: DataFrame) -> DataFrame:
    """k=v and k="v" pairs of lines as `syslog`; quotes are doubled or escaped inside, and a last one may be missing."""
    pattern = F.lit(r'([A-Za-z_][A-Za-z0-9_]*)=(?:"((?:[^"\\]|\\.|"")*)"?|([^\s,"]*))')
    found = lambda k: F.regexp_extract_all("line", pattern, F.lit(k))
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, '""', '"'), r'\\(["\\])', "$1")
    values = F.zip_with(found(2), found(3), lambda q, b: F.when(q != "", clean(q)).otherwise(b))
    return lines.withColumn("_pairs", F.zip_with(found(1), values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))).withColumn("syslog", _as_map(F.col("_pairs"))).drop("_pairs")


def with_fields(lines: DataFrame) -> DataFrame:
    """Lines with `fields`, a map of their names and texts (null if they can't be read)."""
    rows = with_syslog_fields(with_cef_fields(lines.withColumn("_json", F.from_json("line", MAP))))
    fields = (
        F.when(F.length("line") > LONGEST_LINE, F.lit(None))
        .when(F.col("format") == "ndjson", F.when(F.size("_json") > 0, F.col("_json")))
        .when(F.col("format") == "cef", F.col("cef"))
        .when(F.col("format") == "syslog", F.col("syslog"))
    )
    return rows.withColumn("fields", fields).drop("_json", "cef", "syslog")


def picked(rows: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Fields as columns `f_name`, each the first of its sources that isn't empty; null if all are."""
    texts = {f"f_{name}": F.coalesce(*(F.nullif(F.trim(F.try_element_at("fields", F.lit(n))), F.lit("")) for n in sources)) for name, sources in names.items()}
    return rows.select("tenant_id", "feed_id", "received_at", "line", "format", *(c.alias(n) for n, c in texts.items()))


def _json_list(column: str) -> Column:
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


CLOUDFLARE_FIELDS = {
    "parentrayid": ("ParentRayID",),
    "clientrequesthost": ("ClientRequestHost",),
    "clientrequesturi": ("ClientRequestURI",),
    "edgeresponsestatus": ("EdgeResponseStatus",),
    "responseheaders": ("ResponseHeaders",),
    "clientip": ("ClientIP",),
    "securityaction": ("SecurityAction",),
    "edgestarttimestamp": ("EdgeStartTimestamp",),
    "rayid": ("RayID",),
    "clientasn": ("ClientASN",),
    "clientcountry": ("ClientCountry",),
    "clientrequestmethod": ("ClientRequestMethod",),
    "clientrequestuseragent": ("ClientRequestUserAgent",),
    "ja4": ("JA4",),
    "securityruleid": ("SecurityRuleID",),
    "wafattackscore": ("WAFAttackScore",),
    "securityruleids": ("SecurityRuleIDs",),
    "securitysources": ("SecuritySources",),
}


def cloudflare_events(rows: DataFrame) -> DataFrame:
    """Edge log rows. A call to the bot service on behalf of a request becomes that vendor's event."""
    rows = picked(rows, CLOUDFLARE_FIELDS)
    parent = F.when(F.col("f_parentrayid").isin("00"), F.lit(None)).otherwise(F.col("f_parentrayid"))
    bot_call = (F.lower(F.coalesce(F.col("f_clientrequesthost"), F.lit(""))) == BOT_API_HOST) & parent.isNotNull()
    path, rest = t.split_uri(F.coalesce(F.col("f_clientrequesturi"), F.lit("")))
    status = t.to_status(F.col("f_edgeresponsestatus"))
    headers = F.from_json(F.col("f_responseheaders"), MAP)
    kind = F.coalesce(F.try_element_at(headers, F.lit("x-dd-type")), F.lit(""))
    hide = lambda c: F.when(bot_call, F.lit(None)).otherwise(c)
    action = F.coalesce(F.col("f_securityaction"), F.lit(""))
    rows = rows.withColumn("_ip", t.plain_ip(F.col("f_clientip")))
    ip = F.col("_ip")
    return rows.select(
        *_envelope(),
        F.when(bot_call, "datadome").otherwise("cloudflare").alias("vendor"),
        F.col("f_edgestarttimestamp").alias("event_time_original"),
        F.when(bot_call, parent).otherwise(F.coalesce(F.col("f_rayid"), F.lit(""))).alias("vendor_request_id"),
        F.coalesce(F.col("f_rayid"), F.lit("")).alias("vendor_event_id"),
        F.when(bot_call, "").otherwise(F.coalesce(parent, F.lit(""))).alias("linked_request_id"),
        hide(ip).alias("client_ip"),
        F.coalesce(hide(t.is_shared_ip(ip)), F.lit(False)).alias("client_ip_shared"),
        F.coalesce(hide(t.as_uint32(F.col("f_clientasn"))), F.lit(0)).alias("client_asn"),
        F.coalesce(hide(F.upper(F.col("f_clientcountry"))), F.lit("")).alias("client_country"),
        F.coalesce(hide(F.col("f_clientrequesthost")), F.lit("")).alias("request_host"),
        F.coalesce(hide(path), F.lit("")).alias("request_path"),
        F.coalesce(hide(rest), F.lit("")).alias("request_query"),
        F.coalesce(hide(F.col("f_clientrequestmethod")), F.lit("")).alias("request_method"),
        F.coalesce(hide(F.col("f_clientrequestuseragent")), F.lit("")).alias("user_agent"),
        status.alias("http_status"),
        F.coalesce(F.col("f_ja4"), F.lit("")).alias("ja4"),
        F.when(bot_call, v.datadome_call_verdict(status, kind)).otherwise(v.cloudflare_verdict(action)).alias("verdict"),
        action.alias("verdict_reason"),
        F.coalesce(F.col("f_securityruleid"), F.lit("")).alias("rule_id"),
        _json_list("f_securityruleids").alias("rule_ids"),
        F.lit(None).cast("double").alias("score"),
        F.lit("none").alias("score_kind"),
        t.waf_score(F.col("f_wafattackscore")).alias("waf_attack_score"),
        F.lower(action).alias("waf_action"),
        F.coalesce(F.try_element_at(_json_list("f_securitysources"), F.lit(1)), F.lit("")).alias("waf_source"),
        F.coalesce(F.col("f_securityruleid"), F.lit("")).alias("matched_rule"),
        F.lit("").alias("violation"),
    )


F5_FIELDS = {
    "request": ("request", "Request"),
    "ip_client": ("ip_client", "src"),
    "x_forwarded_for_header_value": ("x_forwarded_for_header_value", "xff"),
    "uri": ("uri", "request_uri", "requestUrl"),
    "request_2": ("request",),
    "support_id": ("support_id", "cs3"),
    "request_status": ("request_status", "act"),
    "violations": ("violations", "cs5"),
    "date_time": ("date_time", "rt"),
    "geo_location": ("geo_location", "cs6"),
    "host": ("host", "dhost"),
    "query_string": ("query_string",),
    "method": ("method", "requestMethod"),
    "user_agent": ("user_agent",),
    "response_code": ("response_code", "cn1"),
    "attack_type": ("attack_type", "cs4"),
    "sub_violations": ("sub_violations",),
    "policy_name": ("policy_name", "cs1"),
    "signature_id": ("signature_id",),
    "violation_rating": ("violation_rating",),
}


def f5_events(rows: DataFrame) -> DataFrame:
    """Appliance log rows, from JSON, key-value syslog or CEF."""
    rows = picked(rows, F5_FIELDS)
    rows = rows.withColumn("_raw", F.coalesce(F.col("f_request"), F.lit(""))).withColumn("_peer", t.plain_ip(F.col("f_ip_client")))
    raw, peer = F.col("_raw"), F.col("_peer")
    rows = rows.withColumn("_named", F.nullif(t.header_of(raw, "cf-connecting-ip"), F.lit("")))
    ip = F.coalesce(t.plain_ip(F.col("_named")), t.last_untrusted_hop(F.col("f_x_forwarded_for_header_value"), peer, True), peer)
    rows = rows.withColumn("_ip", ip)
    ip = F.col("_ip")
    path, rest = t.split_uri(F.coalesce(F.col("f_uri"), F.nullif(F.regexp_extract(F.col("f_request_2"), r"^(/\S*)$", 1), F.lit("")), F.lit("")))
    support = F.coalesce(F.col("f_support_id"), F.lit(""))
    status = F.coalesce(F.col("f_request_status"), F.lit(""))
    violations = F.coalesce(F.col("f_violations"), F.lit(""))
    return rows.select(
        *_envelope(),
        F.lit("f5").alias("vendor"),
        F.col("f_date_time").alias("event_time_original"),
        F.coalesce(F.nullif(t.ray_of(raw), F.lit("")), support).alias("vendor_request_id"),
        support.alias("vendor_event_id"),
        F.lit("").alias("linked_request_id"),
        ip.alias("client_ip"),
        t.is_shared_ip(ip).alias("client_ip_shared"),
        F.lit(0).cast("long").alias("client_asn"),
        F.upper(F.coalesce(F.col("f_geo_location"), F.lit(""))).alias("client_country"),
        F.coalesce(F.col("f_host"), F.nullif(t.header_of(raw, "host"), F.lit("")), F.lit("")).alias("request_host"),
        path.alias("request_path"),
        F.coalesce(F.col("f_query_string"), rest).alias("request_query"),
        F.coalesce(F.col("f_method"), F.lit("")).alias("request_method"),
        F.coalesce(F.col("f_user_agent"), F.nullif(t.header_of(raw, "user-agent"), F.lit("")), F.lit("")).alias("user_agent"),
        t.to_status(F.col("f_response_code")).alias("http_status"),
        F.lit("").alias("ja4"),
        v.f5_verdict(status, violations, F.col("f_attack_type"), F.col("f_sub_violations")).alias("verdict"),
        status.alias("verdict_reason"),
        F.coalesce(F.col("f_policy_name"), F.col("f_signature_id"), F.lit("")).alias("rule_id"),
        t.as_list(violations).alias("rule_ids"),
        t.as_float(F.col("f_violation_rating")).alias("score"),
        F.when(t.as_float(F.col("f_violation_rating")).isNull(), "none").otherwise("threat").alias("score_kind"),
        F.lit(0).alias("waf_attack_score"),
        F.lit("").alias("waf_action"),
        F.lit("").alias("waf_source"),
        F.lit("").alias("matched_rule"),
        F.coalesce(F.try_element_at(t.as_list(violations), F.lit(1)), F.lit("")).alias("violation"),
    )


DATADOME_FIELDS = {
    "ip": ("ip", "clientip"),
    "isbot": ("isbot",),
    "botscore": ("botscore", "score"),
    "uri": ("uri", "request"),
    "action": ("action", "response"),
    "timestamp": ("timestamp", "time"),
    "requestid": ("requestid",),
    "asn": ("asn",),
    "country": ("country",),
    "host": ("host",),
    "method": ("method",),
    "ua": ("ua", "useragent"),
    "status": ("status",),
    "botname": ("botname", "family"),
}


def datadome_events(rows: DataFrame) -> DataFrame:
    """Bot log rows; the score is from 0 to 100 in the log."""
    folded = F.transform_keys("fields", lambda k, _: F.lower(F.regexp_replace(F.regexp_replace(k, "(?i)^x-datadome-", ""), "[-_]", "")))
    rows = picked(rows.withColumn("fields", folded), DATADOME_FIELDS)
    is_bot = F.lower(F.coalesce(F.col("f_isbot"), F.lit("false"))).isin("true", "1", "yes")
    score = t.as_float(F.col("f_botscore"))
    path, rest = t.split_uri(F.coalesce(F.col("f_uri"), F.lit("")))
    action = F.coalesce(F.col("f_action"), F.lit(""))
    rows = rows.withColumn("_ip", t.plain_ip(F.col("f_ip")))
    ip = F.col("_ip")
    return rows.select(
        *_envelope(),
        F.lit("datadome").alias("vendor"),
        F.col("f_timestamp").alias("event_time_original"),
        F.coalesce(F.col("f_requestid"), F.lit("")).alias("vendor_request_id"),
        F.coalesce(F.col("f_requestid"), F.lit("")).alias("vendor_event_id"),
        F.lit("").alias("linked_request_id"),
        ip.alias("client_ip"),
        t.is_shared_ip(ip).alias("client_ip_shared"),
        t.as_uint32(F.col("f_asn")).alias("client_asn"),
        F.upper(F.coalesce(F.col("f_country"), F.lit(""))).alias("client_country"),
        F.coalesce(F.col("f_host"), F.lit("")).alias("request_host"),
        path.alias("request_path"),
        rest.alias("request_query"),
        F.coalesce(F.col("f_method"), F.lit("")).alias("request_method"),
        F.coalesce(F.col("f_ua"), F.lit("")).alias("user_agent"),
        t.to_status(F.col("f_status")).alias("http_status"),
        F.lit("").alias("ja4"),
        v.datadome_verdict(action, is_bot).alias("verdict"),
        action.alias("verdict_reason"),
        F.coalesce(F.col("f_botname"), F.lit("")).alias("rule_id"),
        F.array().cast("array<string>").alias("rule_ids"),
        (score / 100).alias("score"),
        F.when(score.isNull(), "none").otherwise("bot").alias("score_kind"),
        F.lit(0).alias("waf_attack_score"),
        F.lit("").alias("waf_action"),
        F.lit("").alias("waf_source"),
        F.lit("").alias("matched_rule"),
        F.lit("").alias("violation"),
    )


NGINX_FIELDS = {
    "cf_connecting_ip": ("cf_connecting_ip",),
    "remote_addr": ("remote_addr",),
    "request_uri": ("request_uri",),
    "status": ("status",),
    "cf_ray": ("cf_ray",),
    "time_iso8601": ("time_iso8601",),
    "host": ("host", "server_name"),
    "request_method": ("request_method",),
    "user_agent": ("user_agent",),
    "upstream_addr": ("upstream_addr",),
    "upstream_status": ("upstream_status",),
}


def nginx_events(rows: DataFrame) -> DataFrame:
    """Origin log rows."""
    rows = picked(rows, NGINX_FIELDS)
    rows = rows.withColumn("_edge", t.plain_ip(F.col("f_cf_connecting_ip"))).withColumn("_peer", t.plain_ip(F.col("f_remote_addr")))
    edge, peer = F.col("_edge"), F.col("_peer")
    ip = F.when(t.routable_ip(edge, True), edge).when(t.routable_ip(peer, True), peer)
    path, rest = t.split_uri(F.coalesce(F.col("f_request_uri"), F.lit("")))
    status = t.to_status(F.col("f_status"))
    ray = F.substring_index(F.coalesce(F.col("f_cf_ray"), F.lit("")), "-", 1)
    return rows.select(
        *_envelope(),
        F.lit("nginx").alias("vendor"),
        F.col("f_time_iso8601").alias("event_time_original"),
        ray.alias("vendor_request_id"),
        ray.alias("vendor_event_id"),
        F.lit("").alias("linked_request_id"),
        ip.alias("client_ip"),
        t.is_shared_ip(ip).alias("client_ip_shared"),
        F.lit(0).cast("long").alias("client_asn"),
        F.lit("").alias("client_country"),
        F.coalesce(F.col("f_host"), F.lit("")).alias("request_host"),
        path.alias("request_path"),
        rest.alias("request_query"),
        F.coalesce(F.col("f_request_method"), F.lit("")).alias("request_method"),
        F.coalesce(F.col("f_user_agent"), F.lit("")).alias("user_agent"),
        status.alias("http_status"),
        F.lit("").alias("ja4"),
        v.nginx_verdict(F.col("f_upstream_addr"), status).alias("verdict"),
        F.coalesce(F.col("f_upstream_status"), F.lit("")).alias("verdict_reason"),
        F.lit("").alias("rule_id"),
        F.array().cast("array<string>").alias("rule_ids"),
        F.lit(None).cast("double").alias("score"),
        F.lit("none").alias("score_kind"),
        F.lit(0).alias("waf_attack_score"),
        F.lit("").alias("waf_action"),
        F.lit("").alias("waf_source"),
        F.lit("").alias("matched_rule"),
        F.lit("").alias("violation"),
    )


def _envelope() -> list[Column]:
    return [F.col(c) for c in ("tenant_id", "feed_id", "received_at", "line", "format")]


#: Adapter of each vendor; a further vendor adds its projection here.
ADAPTERS = {"cloudflare": cloudflare_events, "f5": f5_events, "datadome": datadome_events, "nginx": nginx_events}


def normalise(envelopes: DataFrame, year: int | None = None, adapters: dict = ADAPTERS) -> tuple[DataFrame, DataFrame]:
    """Accepted events in the common model, and rejected lines with their reason.

    Envelopes are tenant_id, feed_id, vendor, received_at, payload. `year` completes times that have none.
    """
    # Both results read what was parsed once; writing it down also keeps filters from being pushed
    # through the parsing, where they would repeat all of it.
    lines = cut(with_fields(lines_of(envelopes.withColumn("source_vendor", F.lower("vendor")).drop("vendor"))))
    unread = lines.where("fields IS NULL").select(
        "tenant_id", "feed_id", "received_at", "line", F.when(F.length("line") > LONGEST_LINE, TOO_LONG).otherwise(PARSE_ERROR).alias("reason")
    )
    rows = None
    for vendor, adapter in adapters.items():
        own = adapter(lines.where(F.col("fields").isNotNull() & (F.col("source_vendor") == vendor)))
        rows = own if rows is None else rows.unionByName(own)
    # Once for all vendors: this step leaves the JVM.
    rows = rows.withColumn("client_ip", t.canonical_ip(F.col("client_ip"))).withColumn("client_ip_shared", t.is_shared_ip(F.col("client_ip")))
    rows = rows.withColumn("_parsed", t.parse_time(F.col("event_time_original"), year))
    rows = rows.withColumn("_time", F.when(t.plausible_time(F.col("_parsed")), F.col("_parsed"))).withColumn("event_time", F.unix_seconds("_time"))
    rows = rows.withColumn("event_id", t.event_identity(F.col("feed_id"), F.col("vendor"), F.col("vendor_request_id"), F.col("line"))).withColumn("ingest_version", F.lit(1).cast("long"))
    late = F.when(F.col("event_time").isNull(), BAD_TIME).when(~F.col("event_time").between(F.col("received_at") - 90 * 86_400, F.col("received_at") + 300), "TIMESTAMP_OUT_OF_RANGE")
    rows = cut(rows.withColumn("reason", late).drop("_parsed", "_time"))
    refused = rows.where("reason IS NOT NULL").select("tenant_id", "feed_id", "received_at", "line", "reason")
    return rows.where("reason IS NULL").select(*EVENT_COLUMNS), unread.unionByName(refused)


def local_to_utc(lines: DataFrame, zone: str, column: str = "date_time") -> DataFrame:
    """Lines of an appliance that logs local time, with the time in UTC; empty frames go."""
    shifted = F.date_format(F.to_utc_timestamp(F.try_to_timestamp(F.col(column), F.lit("yyyy-MM-dd HH:mm:ss")), zone), "yyyy-MM-dd HH:mm:ss")
    return lines.where(F.trim(F.coalesce(column, F.lit(""))) != "").withColumn(column, F.coalesce(shifted, F.col(column)))


def asn_owners(path: str, spark) -> DataFrame:
    """Network owners from tab-separated lines (first, last, asn, country, name); the first line of a network counts."""
    lines = spark.read.csv(path, sep="\t", quote="", schema="low string, high string, asn long, owner_country string, owner_name string")
    numbered = lines.withColumn("_n", F.monotonically_increasing_id()).where("asn > 0 AND owner_name <> 'Not routed'")
    first = numbered.groupBy("asn").agg(F.min_by(F.struct("owner_name", "owner_country"), "_n").alias("first"))
    return first.select("asn", "first.owner_name", "first.owner_country")


def catalogue(path: str, spark) -> DataFrame:
    """Catalogue entries from vendor dumps in JSON: title, severity, description, cleaned."""
    rows = spark.read.json(path)
    clean = lambda c: F.trim(F.regexp_replace(F.col(c).cast("string"), r"\s+", " "))
    return rows.select(*(clean(c).alias(c) for c in ("title", "severity", "description"))).where("title <> ''").dropDuplicates(["title"])
