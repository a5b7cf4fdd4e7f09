"""The correlation join: which events of several vendors describe the same request.

Tier 1 links events that share request ids, also over bridges; tier 2 groups the rest by address,
host, path, method and time window, and brings neighbours across a window's edge together; events
without such a key stand alone. A group becomes one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_path, uuid_of
from ..functions.verdicts import RANK, rank
from .components import components, cut

#: Width of a window in seconds, and the least bot score that contradicts an all-allowed request.
WINDOW, SCORE = 5, 0.8
# Request ids that stand for none.
NO_ID = ("", "-", "0", "null", "none", "undefined")
# Whom to trust for network and country, and the edge's own network.
TRUST = {"cloudflare": 0, "datadome": 1, "f5": 2, "nginx": 3}
EDGE_ASN = 13335


def request_key(column: str) -> Column:
    """A request id, trimmed, under its tenant; null for those that stand for none, which would tie millions of requests together."""
    own = F.trim(column)
    return F.when(own.isNotNull() & ~F.lower(own).isin(*NO_ID), F.concat(F.lit("t1|"), "tenant_id", F.lit("|"), own))


def exact_groups(events: DataFrame, bridges: bool = True) -> DataFrame:
    """Tier 1: event_id, tenant_id, exact_key, for events whose ids more than one vendor reports.

    With `bridges` an event that carries two ids makes one group of both; the key is the component's
    smallest id. Only such events are links; an id that no event ties to another is its own component.
    Without, events must share the vendor's own request id.
    """
    if bridges:
        ids = [request_key(c) for c in ("vendor_request_id", "linked_request_id")]
        keyed = events.select("tenant_id", "event_id", "vendor", F.least(*ids).alias("node"), F.greatest(*ids).alias("other")).where("node IS NOT NULL")
        roots = components(keyed.where("node <> other").select("node", "other").distinct(), "node", "other")
        keyed = keyed.join(roots, "node", "left").select("tenant_id", "event_id", "vendor", F.coalesce("root", "node").alias("exact_key"))
    else:
        keyed = events.select("tenant_id", "event_id", "vendor", request_key("vendor_request_id").alias("exact_key")).where("exact_key IS NOT NULL")
    # Distinct vendors of a key are few, so the count is made from partial sets before the shuffle.
    confirmed = keyed.groupBy("exact_key").agg(F.count_distinct("vendor").alias("n")).where("n > 1").select("exact_key")
    return keyed.join(confirmed, "exact_key").select("tenant_id", "event_id", "exact_key")


def shape_key() -> Column:
    """Tier-2 key without its window; null where host or address is missing."""
    host = F.lower(F.trim("request_host"))
    usable = (F.coalesce(host, F.lit("")) != "") & (F.coalesce(F.col("client_ip"), F.lit("")) != "")
    parts = F.concat_ws("|", F.lit("t2"), "tenant_id", "client_ip", host, norm_path(F.col("request_path")), F.upper("request_method"))
    return F.when(usable, parts)


def paired_windows(windows: DataFrame) -> DataFrame:
    """The window that each one of some distinct (shape, w) goes by, as window_no: in a run of consecutive ones they pair up from the first on."""
    # Windows of one run differ from their place in the key's order by the same number.
    runs = windows.withColumn("run", F.col("w") - F.row_number().over(Window.partitionBy("shape").orderBy("w")))
    start = F.min("w").over(Window.partitionBy("shape", "run"))
    return runs.select("shape", "w", (start + 2 * F.floor((F.col("w") - start) / 2)).cast("long").alias("window_no"))


def heuristic_groups(events: DataFrame, window: int = WINDOW, adjacent: bool = True) -> DataFrame:
    """Tier 2: event_id, tenant_id, heuristic_key (null for events that stand alone), window_no.

    With `adjacent` a window that follows another of the same key joins it, unless that one was
    joined already: in a run of consecutive windows they pair up from the first on.
    """
    keyed = events.select("tenant_id", "event_id", shape_key().alias("shape"), F.floor(F.col("event_time") / window).cast("long").alias("w"))
    if not adjacent:
        return keyed.select("tenant_id", "event_id", F.concat_ws("|", "shape", F.col("w").cast("string")).alias("heuristic_key"), F.col("w").alias("window_no"), "shape")
    paired = paired_windows(keyed.where("shape IS NOT NULL").select("shape", "w").distinct())
    return keyed.join(paired, ["shape", "w"], "left").select(
        "tenant_id", "event_id", F.when(F.col("shape").isNotNull(), F.concat_ws("|", "shape", F.col("window_no").cast("string"))).alias("heuristic_key"), "window_no", "shape"
    )


def grouped(events: DataFrame, window: int = WINDOW) -> DataFrame:
    """Events with their group: group_key, join_tier (1, 2, or 0 for one that stands alone)."""
    return events.join(group_keys(events, window), ["tenant_id", "event_id"])


#: What grouping reads of an event; the other columns meet the group once it is known.
NARROW = ("tenant_id", "event_id", "vendor", "vendor_request_id", "linked_request_id", "event_time", "client_ip", "request_host", "request_path", "request_method")


def group_keys(events: DataFrame, window: int = WINDOW) -> DataFrame:
    """Group of every event: tenant_id, event_id, group_key, join_tier."""
    narrow = cut(events.select(*NARROW))
    exact = cut(exact_groups(narrow))
    rest = narrow.join(exact, ["tenant_id", "event_id"], "left_anti")
    tier2 = heuristic_groups(rest, window).select(
        "tenant_id",
        "event_id",
        F.coalesce("heuristic_key", F.concat(F.lit("solo|"), "event_id")).alias("group_key"),
        F.when(F.col("heuristic_key").isNull(), 0).otherwise(2).alias("join_tier"),
    )
    return exact.select("tenant_id", "event_id", F.col("exact_key").alias("group_key"), F.lit(1).alias("join_tier")).unionByName(tier2)


def disagreement(flags: dict[str, Column], bot_score: Column, all_allowed: Column, vendors: Column, threshold: float = SCORE) -> Column:
    """Kind of contradiction between vendors; one vendor alone doesn't contradict itself."""
    stopped = flags["blocked"] | flags["rate_limited"]
    return (
        F.when(vendors < 2, "none")
        .when(flags["allowed"] & stopped, "allow_vs_block")
        .when(flags["allowed"] & flags["challenged"], "allow_vs_challenge")
        .when(all_allowed & F.coalesce(bot_score >= threshold, F.lit(False)), "score_conflict")
        .otherwise("none")
    )


def confidence(vendors: Column, tier: Column, shared: Column, candidates: Column) -> Column:
    return F.when((vendors == 1) | (tier == 1), "high").when(shared | (candidates > 1), "low").otherwise("medium")


def records(events: DataFrame, window: int = WINDOW, threshold: float = SCORE) -> DataFrame:
    """One record for each group of events.

    Of several events of one vendor the last by (time, vendor, event) speaks for it. Network and
    country come from the vendor that is trusted most; the edge's own network number counts only
    from the edge. All rules that an event matched are united, over all (matched_rules) and by vendor
    (vendor_rules). Copies of an event must be gone (see `latest`).
    """
    return records_of(grouped(events, window), window, threshold)


def records_of(rows: DataFrame, window: int = WINDOW, threshold: float = SCORE) -> DataFrame:
    """Records of events that know their group already (group_key, join_tier); see `records`."""
    order = F.struct("event_time", "vendor", "event_id")
    trust = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TRUST.items() for x in kv)), "vendor"), F.lit(9))
    trusted = F.struct(trust, F.col("event_time"), F.col("event_id"))
    asn_ok = (F.col("client_asn") > 0) & ((F.col("client_asn") != EDGE_ASN) | (F.col("vendor") == "cloudflare"))
    listed = F.array("matched_rule")
    if "rule_ids" in rows.columns:  # an event may have matched several rules
        listed = F.array_union(F.coalesce("rule_ids", F.array().cast("array<string>")), listed)
    matched = F.filter(listed, lambda r: r.isNotNull() & (r != ""))
    # One row for each vendor of a group first, which bounds what the second step collects. Events are dealt out by group once,
    # as they are: what the steps make of them is several times larger, and few events have a group's vendor in common.
    per_vendor = rows.repartition("tenant_id", "group_key").groupBy("tenant_id", "group_key", "join_tier", "vendor").agg(
        F.count("*").alias("n"),
        F.max_by("verdict", order).alias("verdict"),
        F.max_by("rule_id", F.when(F.col("rule_id") != "", order)).alias("rule_id"),
        F.max_by("score", F.when(F.col("score").isNotNull(), order)).alias("score"),
        F.max(F.when(F.col("score_kind") == "bot", F.col("score"))).alias("bot_score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(matched)))).alias("matched"),
        F.array_sort(F.collect_set("verdict")).alias("verdicts_seen"),
        F.collect_list(F.struct("event_time", "vendor", "event_id")).alias("events"),
        F.min("event_time").alias("first_event_time"),
        F.max("event_time").alias("last_event_time"),
        F.bool_or(F.coalesce("client_ip_shared", F.lit(False))).alias("shared"),
        *(F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(order.alias("o"), F.col(c).alias("x")))).alias(f"_{c}") for c in ("client_ip", "request_host", "request_path", "request_method")),
        F.min(F.when(asn_ok, F.struct(trusted.alias("o"), F.col("client_asn").alias("x")))).alias("_asn"),
        F.min(F.when(F.coalesce(F.col("client_country"), F.lit("")) != "", F.struct(trusted.alias("o"), F.col("client_country").alias("x")))).alias("_country"),
    )
    entry = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(v).isNotNull(), F.struct("vendor", v)))))
    out = per_vendor.groupBy("tenant_id", "group_key", "join_tier").agg(
        F.min("first_event_time").alias("first_event_time"),
        F.max("last_event_time").alias("last_event_time"),
        F.array_sort(F.collect_set("vendor")).alias("vendors"),
        F.transform(F.array_sort(F.flatten(F.collect_list("events"))), lambda e: e["event_id"]).alias("event_ids"),
        entry("verdict").alias("verdicts"),
        entry("rule_id").alias("rule_ids"),
        entry("score").alias("scores"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched")))).alias("matched_rules"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.size("matched") > 0, F.struct("vendor", "matched"))))).alias("vendor_rules"),
        F.array_distinct(F.flatten(F.collect_list("verdicts_seen"))).alias("_seen"),
        F.max("bot_score").alias("_bot"),
        F.bool_or("shared").alias("client_ip_shared"),
        F.max("n").alias("_most"),
        *(F.min(f"_{c}")["x"].alias(c) for c in ("client_ip", "request_host", "request_path", "request_method")),
        F.min("_asn")["x"].alias("client_asn"),
        F.min("_country")["x"].alias("client_country"),
    )
    seen = {v: F.array_contains("_seen", v) for v in RANK}
    n = F.size("vendors")
    worst = F.array_max(F.transform("_seen", lambda v: F.struct(rank(v).alias("r"), v.alias("v"))))["v"]
    kind = disagreement(seen, F.col("_bot"), F.size(F.array_except("_seen", F.array(F.lit("allowed")))) == 0, n, threshold)
    candidates = F.when(F.col("join_tier") == 1, 1).otherwise(F.col("_most"))
    start = F.when(F.col("join_tier") == 2, F.regexp_extract("group_key", r"(-?\d+)$", 1).try_cast("long") * window)
    return (
        out.withColumn("vendor_count", n)
        .withColumn("combined_outcome", worst)
        .withColumn("disagreement_kind", kind)
        .withColumn("has_disagreement", F.col("disagreement_kind") != "none")
        .withColumn("candidate_count", candidates.cast("long"))
        .withColumn("confidence", confidence(n, F.col("join_tier"), F.col("client_ip_shared"), F.col("candidate_count")))
        .withColumn("window_start", F.coalesce(start, F.floor(F.col("first_event_time") / window) * window).cast("long"))
        .withColumn("correlation_id", uuid_of(F.concat(F.octet_length("group_key").cast("string"), F.lit(":"), "group_key")))
        .withColumn("f5_verdict", F.coalesce(F.try_element_at("verdicts", F.lit("f5")), F.lit("")))
        .withColumn("cf_verdict", F.coalesce(F.try_element_at("verdicts", F.lit("cloudflare")), F.lit("")))
        .withColumn("version", F.lit(1).cast("long"))
        .withColumn("amended", F.lit(False))
        .drop("_seen", "_most", "_bot")
        .withColumn("bot_score", F.try_element_at("scores", F.lit("datadome")))
    )


def partners(events: DataFrame, seeds: DataFrame) -> DataFrame:
    """All events of the exact groups of some events (tenant_id, event_id), bridges included."""
    exact = exact_groups(events)
    keys = exact.join(seeds.select("tenant_id", "event_id").distinct(), ["tenant_id", "event_id"], "left_semi").select("exact_key").distinct()
    return events.join(exact.join(keys, "exact_key").select("tenant_id", "event_id"), ["tenant_id", "event_id"], "left_semi")


def claimed_ids(records_: DataFrame, claims: DataFrame) -> DataFrame:
    """Records under the id that one of their request ids has claimed before (identifier, correlation_id, claimed_at)."""
    ids = records_.select("tenant_id", "correlation_id", F.explode("event_ids").alias("identifier"))
    earliest = ids.join(claims.select("identifier", F.col("correlation_id").alias("held"), "claimed_at"), "identifier").groupBy("tenant_id", "correlation_id").agg(F.min_by("held", F.struct("claimed_at", "held")).alias("held"))
    return records_.join(earliest, ["tenant_id", "correlation_id"], "left").withColumn("correlation_id", F.coalesce("held", "correlation_id")).drop("held")


def merge_amended(stored: DataFrame, fresh: DataFrame, threshold: float = SCORE) -> DataFrame:
    """Stored records joined with what late events add: the next version of every record in `fresh`.

    Events, vendors and matched rules are united, a vendor's fresh word replaces its stored one, the
    span widens, the earlier window and the stronger tier (with its confidence) stay, and the
    disagreement is classified anew over the united verdicts. Records that are stored alone don't change.
    """
    keys = ["tenant_id", "correlation_id"]
    s, f = stored.alias("s"), fresh.alias("f")
    both = f.join(s, [F.col(f"s.{k}") == F.col(f"f.{k}") for k in keys], "left")
    known = F.col("s.correlation_id").isNotNull()
    united = lambda c: F.array_sort(F.array_union(F.coalesce(F.col(f"s.{c}"), F.array().cast("array<string>")), F.col(f"f.{c}")))
    newest = lambda c: F.when(known, F.map_zip_with(f"s.{c}", f"f.{c}", lambda k, a, b: F.coalesce(b, a))).otherwise(F.col(f"f.{c}"))
    both_lists = lambda k, a, b: F.array_sort(F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))
    united_by_vendor = F.when(F.col("s.correlation_id").isNotNull(), F.map_zip_with("s.vendor_rules", "f.vendor_rules", both_lists)).otherwise(F.col("f.vendor_rules"))
    strength = lambda t: F.when(t == 1, 2).when(t == 2, 1).otherwise(0)
    keep = known & (strength(F.col("s.join_tier")) > strength(F.col("f.join_tier")))
    earlier = lambda c: F.when(F.coalesce(F.col(f"s.{c}").cast("string"), F.lit("")) != "", F.col(f"s.{c}")).otherwise(F.col(f"f.{c}"))
    out = both.select(
        *(F.col(f"f.{k}").alias(k) for k in keys),
        F.least("s.window_start", "f.window_start").alias("window_start"),
        F.least("s.first_event_time", "f.first_event_time").alias("first_event_time"),
        F.greatest("s.last_event_time", "f.last_event_time").alias("last_event_time"),
        *(united(c).alias(c) for c in ("vendors", "event_ids", "matched_rules")),
        *(newest(c).alias(c) for c in ("verdicts", "rule_ids", "scores")),
        *([united_by_vendor.alias("vendor_rules")] if "vendor_rules" in stored.columns and "vendor_rules" in fresh.columns else []),
        *(earlier(c).alias(c) for c in ("client_ip", "request_host", "request_path", "request_method", "client_asn", "client_country")),
        (F.coalesce("s.client_ip_shared", F.lit(False)) | F.col("f.client_ip_shared")).alias("client_ip_shared"),
        F.when(keep, F.col("s.join_tier")).otherwise(F.col("f.join_tier")).alias("join_tier"),
        F.greatest("s.candidate_count", "f.candidate_count").alias("candidate_count"),
        F.when(keep, F.col("s.confidence")).alias("_confidence"),
        (F.coalesce("s.version", F.lit(0)) + 1).alias("version"),
        known.alias("amended"),
    )
    words = F.map_values("verdicts")
    seen = {v: F.array_contains(words, v) for v in RANK}
    n = F.size("vendors")
    return (
        out.withColumn("vendor_count", n)
        .withColumn("combined_outcome", F.array_max(F.transform(words, lambda v: F.struct(rank(v).alias("r"), v.alias("v"))))["v"])
        .withColumn("disagreement_kind", disagreement(seen, F.try_element_at("scores", F.lit("datadome")), F.size(F.array_except(words, F.array(F.lit("allowed")))) == 0, n, threshold))
        .withColumn("has_disagreement", F.col("disagreement_kind") != "none")
        .withColumn("confidence", F.coalesce("_confidence", confidence(n, F.col("join_tier"), F.col("client_ip_shared"), F.col("candidate_count"))))
        .drop("_confidence")
    )
