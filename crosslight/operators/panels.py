"""Dashboard panels: exact over events and records, and over merged sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bucket_start
from .filters import panel_size


def vendor_volume(events: DataFrame, width: int = 300) -> DataFrame:
    """Distinct events of each vendor in each bucket."""
    return events.groupBy("tenant_id", bucket_start(F.col("event_time"), width).alias("bucket"), "vendor").agg(F.count_distinct("event_id").alias("events"))


def verdict_mix(events: DataFrame, width: int = 300) -> DataFrame:
    return events.groupBy("tenant_id", bucket_start(F.col("event_time"), width).alias("bucket"), "vendor", "verdict").agg(F.count_distinct("event_id").alias("events"))


def overview_totals(mix: DataFrame) -> DataFrame:
    """Totals of a verdict mix: all, stopped (rate limits too), challenged."""
    of = lambda *v: F.sum(F.when(F.col("verdict").isin(*v), F.col("events")).otherwise(0))
    return mix.groupBy("tenant_id").agg(F.sum("events").alias("total"), of("blocked", "rate_limited").alias("blocked"), of("challenged").alias("challenged"))


def top_rules(events: DataFrame, size: int = 10) -> DataFrame:
    counts = events.where("rule_id <> ''").groupBy("vendor", "rule_id").agg(F.count_distinct("event_id").alias("events"))
    return counts.orderBy(F.desc("events"), "vendor", "rule_id").limit(panel_size(size))


def top_sources(events: DataFrame, size: int = 10) -> DataFrame:
    """Addresses with most events, and how many were stopped; events without address don't count."""
    stopped = F.col("verdict").isin("blocked", "rate_limited")
    counts = events.where("client_ip IS NOT NULL").groupBy("client_ip", "client_country", "client_asn").agg(
        F.count_distinct("event_id").alias("events"), F.count_distinct(F.when(stopped, F.col("event_id"))).alias("blocked")
    )
    return counts.orderBy(F.desc("events"), "client_ip", "client_country", "client_asn").limit(panel_size(size))


def top_asns(events: DataFrame, size: int = 10) -> DataFrame:
    """Networks with most events: of their addresses' counts the sum, exact clients, the country with most events."""
    own = events.where("client_ip IS NOT NULL AND client_asn > 0")
    by_country = own.groupBy("client_asn", "client_ip", "client_country").agg(F.count_distinct("event_id").alias("events")).groupBy("client_asn", "client_country").agg(F.sum("events").alias("own"))
    # Addresses are told apart as rows first and counted after; no row holds a network's addresses.
    clients = own.select("client_asn", "client_ip").distinct().groupBy("client_asn").agg(F.count("*").alias("clients"))
    totals = by_country.groupBy("client_asn").agg(F.sum("own").alias("events"), F.max(F.struct("own", "client_country"))["client_country"].alias("country"))
    counts = totals.join(clients, "client_asn").select("client_asn", "events", "clients", "country")
    return counts.orderBy(F.desc("events"), "client_asn").limit(panel_size(size))


def disagreement_rate(records: DataFrame, width: int = 300) -> DataFrame:
    """For each bucket and kind the records that disagree; the bucket's true total and its largest kind (total_compat)."""
    kinds = records.groupBy("tenant_id", bucket_start(F.col("window_start"), width).alias("bucket"), "disagreement_kind").agg(F.count_distinct("correlation_id").alias("n"))
    totals = kinds.groupBy("tenant_id", "bucket").agg(F.sum("n").alias("total"), F.max("n").alias("total_compat"))
    return kinds.where("disagreement_kind <> 'none'").join(totals, ["tenant_id", "bucket"]).select("tenant_id", "bucket", "disagreement_kind", F.col("n").alias("disagreeing"), "total", "total_compat")


def volume_sketches(events: DataFrame, width: int = 300, lg_k: int = 12) -> DataFrame:
    """Mergeable states of distinct events, of bounded size, for each bucket and vendor."""
    return events.groupBy("tenant_id", bucket_start(F.col("event_time"), width).alias("bucket"), "vendor").agg(F.hll_sketch_agg("event_id", F.lit(lg_k)).alias("state"))


def merge_sketches(states: DataFrame, keys: list[str]) -> DataFrame:
    """Estimated distinct events of coarser groups, from states alone; about 1.6 % of error at lg_k 12."""
    return states.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("state")).alias("events"))


def rollup_hourly(states: DataFrame) -> DataFrame:
    """Coarser states from finer ones, so a rollup can be rebuilt or read twice without counting twice."""
    return states.groupBy("tenant_id", bucket_start(F.col("bucket"), 3600).alias("bucket"), "vendor").agg(F.hll_union_agg("state").alias("state"))
