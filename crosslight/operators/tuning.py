"""Readings of firewall rules: profiles, gaps, corroboration, and moving rules from one vendor to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import latest
from .lookups import events_of_records, only_f5_blocked

#: Shares at which a rule reads as right or wrong, and the least requests for a reading.
READY, WRONG, LEAST = 0.8, 0.2, 10


def _scores() -> list[Column]:
    """Attack scores are inverted: 1-20 attack, 21-50 suspicious, over 50 clean, 0 unscored."""
    score = F.col("waf_attack_score")
    of = lambda test: F.sum(F.when(test, 1).otherwise(0))
    return [
        F.count("*").alias("events"),
        of(score.between(1, 20)).alias("attack"),
        of(score.between(21, 50)).alias("suspicious"),
        of(score > 50).alias("clean"),
        F.round(F.coalesce(F.avg(F.when(score > 0, score)), F.lit(0.0)), 6).alias("mean_score"),
    ]


def rule_profile(events: DataFrame) -> DataFrame:
    """For each tenant's rule, host, action and source how its requests scored, and what that says of the rule."""
    rows = events.where("vendor = 'cloudflare' AND rule_id <> ''").groupBy("tenant_id", "rule_id", "request_host", "waf_action", "waf_source").agg(*_scores())
    scored = F.col("attack") + F.col("suspicious") + F.col("clean")
    share = F.try_divide(F.col("attack") + F.col("suspicious"), scored)
    reading = (
        F.when(F.col("waf_action") == "skip", "exempting").when(scored == 0, "unscored").when(share >= READY, "attacks").when(share <= WRONG, "clean").otherwise("mixed")
    )
    return rows.withColumn("reading", reading)


def rule_paths(events: DataFrame, rule: str) -> DataFrame:
    """Hosts and paths of a rule with the mean of what was scored."""
    return events.where(F.col("rule_id") == rule).groupBy("request_host", "request_path").agg(*_scores()).select("request_host", "request_path", "events", "mean_score")


def gaps(events: DataFrame) -> DataFrame:
    """Requests of each host that no rule matched although they scored as attack or suspicious."""
    rows = events.where("vendor = 'cloudflare' AND rule_id = '' AND waf_attack_score BETWEEN 1 AND 50")
    return rows.groupBy("request_host").agg(*_scores()).select("request_host", "events", "attack", "suspicious", "mean_score")


def corroboration(records: DataFrame) -> DataFrame:
    """For each tenant's edge rule the records that other vendors saw too, and whether any of these stopped them.

    `records` holds versions; the newest counts, and only then do filters apply.
    """
    rows = latest(records, ["tenant_id", "correlation_id"], "version").where("vendor_count > 1")
    rows = rows.withColumn("rule", F.coalesce(F.try_element_at("rule_ids", F.lit("cloudflare")), F.lit(""))).where("rule <> ''")
    others = F.map_values(F.map_filter("verdicts", lambda k, v: k != "cloudflare"))
    stopped = F.exists(others, lambda v: v.isin("blocked", "rate_limited", "challenged"))
    allowed = F.forall(others, lambda v: v == "allowed")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy("tenant_id", "rule").agg(F.count("*").alias("correlated"), one(stopped).alias("confirmed"), one(allowed).alias("allowed"))


def uncovered(records: DataFrame, events: DataFrame) -> DataFrame:
    """What one firewall stops and the other lets pass, by violation, host and method."""
    met = events_of_records(only_f5_blocked(records), events.where("vendor = 'f5' AND violation <> ''"))
    return met.groupBy("violation", "request_host", "request_method").agg(
        F.count_distinct("correlation_id").alias("requests"),
        F.count_distinct("request_path").alias("paths"),
        F.count_distinct("client_ip").alias("clients"),
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
    )


def rule_agreement(records: DataFrame) -> DataFrame:
    """How the one firewall treated what each matched rule of the other caught, and whether the rule may be enforced.

    Lists are filtered before they are unrolled. A host's name is given if it is the only one.
    """
    rows = records.where("f5_verdict <> ''").withColumn("rule", F.explode(F.filter("matched_rules", lambda r: r != "")))
    one = lambda *v: F.sum(F.when(F.col("f5_verdict").isin(*v), 1).otherwise(0))
    out = rows.groupBy("rule").agg(
        F.count("*").alias("n"),
        one("blocked", "rate_limited").alias("blocked"),
        one("monitored").alias("flagged"),
        one("allowed").alias("allowed"),
        F.count_distinct("request_host").alias("hosts"),
        F.when(F.count_distinct("request_host") == 1, F.min("request_host")).otherwise("").alias("host"),
    )
    share = (F.col("blocked") + F.col("flagged") / 2) / F.col("n")
    reading = F.when(F.col("n") < LEAST, "insufficient").when(share >= READY, "ready").when(share <= WRONG, "false_positive").otherwise("disputed")
    return out.withColumn("reading", reading)


def observed_monitored(events: DataFrame, limit: int = 200) -> DataFrame:
    """Rules that were seen watching only."""
    return events.where("vendor = 'cloudflare' AND rule_id <> '' AND waf_action IN ('log', 'simulate')").select("rule_id").distinct().orderBy("rule_id").limit(limit)


def monitored_rules(rules: DataFrame) -> DataFrame:
    """Rules that a tenant has configured and that only watch; of several actions the smallest."""
    return rules.groupBy("tenant_id", "rule_id").agg(F.min("action").alias("action")).where("action IN ('log', 'simulate')")


def migration_samples(records: DataFrame, events: DataFrame, violation: str, limit: int = 20) -> DataFrame:
    """Newest requests of a violation that the other firewall let pass, with both verdicts."""
    met = events_of_records(only_f5_blocked(records), events.where((F.col("vendor") == "f5") & (F.col("violation") == violation)))
    page = met.orderBy(F.desc("event_time"), F.desc("event_id")).limit(limit)
    return page.join(records.select("tenant_id", "correlation_id", "f5_verdict", "cf_verdict"), ["tenant_id", "correlation_id"]).select(
        "correlation_id", "event_id", "event_time", "request_host", "request_path", "f5_verdict", "cf_verdict"
    )
