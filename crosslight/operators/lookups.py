"""Enriching joins, lookups by id, and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import cut
from .latest import latest, pick_first

HOUR = 3_600
#: Dimension tables of fewer rows than this are broadcast; larger ones are joined by Spark's own choice.
SMALL_DIMENSION = 100_000


def dimension_join(rows: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a dimension, broadcast if it is small."""
    few = dimension.limit(SMALL_DIMENSION + 1).count() <= SMALL_DIMENSION
    return rows.join(F.broadcast(dimension) if few else dimension, on, "left")


def with_asn_owner(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Owner's name and country of a network: owners has asn, owner_name, owner_country, and the newest updated_at counts."""
    newest = latest(owners, ["asn"], "updated_at", ["owner_name"]).select(F.col("asn").alias("client_asn"), "owner_name", "owner_country")
    return dimension_join(rows, newest, ["client_asn"])


def with_rule_names(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Description of a rule of the tenant; of several the smallest non-empty one."""
    named = rules.where(F.coalesce("description", F.lit("")) != "").groupBy("tenant_id", "rule_id").agg(F.min("description").alias("rule_name"))
    return dimension_join(rows, named, ["tenant_id", "rule_id"])


def with_catalogue(rows: DataFrame, titles: str, catalogue: DataFrame) -> DataFrame:
    """One row for each title of a list, with its catalogue entry; N/A is skipped and unknown titles stay."""
    entries = catalogue.groupBy(F.lower("title").alias("_title")).agg(F.min_by(F.struct("severity", "description"), "title").alias("entry"))
    each = rows.withColumn("title", F.explode(F.filter(titles, lambda t: ~F.upper(F.trim(t)).isin("", "N/A")))).withColumn("_title", F.lower(F.trim("title")))
    return dimension_join(each, entries, ["_title"]).select(*rows.columns, "title", "entry.severity", "entry.description")


def lookup_payload(raw: DataFrame, tenant: str, event_id: str, received_at: int | None = None, vendor: str | None = None) -> DataFrame:
    """Raw payload of one event, within an hour of its receipt and from its vendor where they are known."""
    own = raw.where((F.col("tenant_id") == tenant) & (F.col("event_id") == event_id))
    if received_at is not None:
        own = own.where(F.col("received_at").between(received_at - HOUR, received_at + HOUR))
    if vendor:
        own = own.where(F.col("vendor") == vendor)
    return own.orderBy(F.desc("received_at"), *(F.desc(c) for c in ("ingest_version",) if c in raw.columns)).limit(1)


def get_record(records: DataFrame, tenant: str, correlation_id: str) -> DataFrame:
    own = records.where((F.col("tenant_id") == tenant) & (F.col("correlation_id") == correlation_id))
    return latest(own, ["tenant_id", "correlation_id"], "version")


def events_of_records(records: DataFrame, events: DataFrame, slack: int = HOUR) -> DataFrame:
    """Each event of each record, by the event's id and within `slack` seconds of the record's span."""
    each = records.select("tenant_id", "correlation_id", "first_event_time", "last_event_time", F.explode("event_ids").alias("event_id"))
    low, high = records.agg(F.min("first_event_time"), F.max("last_event_time")).first()
    if low is not None:  # the events' side is bounded before it is joined, by day too where it lies in days
        events = events.where(F.col("event_time").between(low - slack, high + slack))
        if "date" in events.columns:
            events = events.where(F.col("date").between(*(F.to_date(F.timestamp_seconds(F.lit(s))) for s in (low - slack, high + slack))))
    met = each.join(events, ["tenant_id", "event_id"])
    return met.where(F.col("event_time").between(F.col("first_event_time") - slack, F.col("last_event_time") + slack)).drop("first_event_time", "last_event_time")


def newest_vendor_event(records: DataFrame, events: DataFrame, vendor: str, page: int | None = None) -> DataFrame:
    """For each record its vendor's newest event (time, then id); with `page` for so many records, the newest, which are taken before the join."""
    if page is not None:
        records = records.orderBy(F.desc("window_start"), F.desc("correlation_id")).limit(page)
    own = events_of_records(records, events.where(F.col("vendor") == vendor))
    return pick_first(own, ["tenant_id", "correlation_id"], [F.desc("event_time"), F.desc("event_id")])


def best_edge_event(records: DataFrame, events: DataFrame) -> DataFrame:
    """For each record its edge event that says most: with a rule, then with a score, then the larger id."""
    own = events_of_records(records, events.where("vendor = 'cloudflare'"))
    order = [F.desc(F.col("rule_id") != ""), F.desc(F.col("waf_attack_score") > 0), F.desc("event_id")]
    return pick_first(own, ["tenant_id", "correlation_id"], order)


def verdict_pairs(records: DataFrame) -> DataFrame:
    """How often each pair of verdicts of the two firewalls met on one request."""
    return records.where("f5_verdict <> '' AND cf_verdict <> ''").groupBy("f5_verdict", "cf_verdict").agg(F.count("*").alias("n"))


def only_f5_blocked(records: DataFrame) -> DataFrame:
    """Requests that one firewall stopped and the other let pass."""
    return records.where(F.col("f5_verdict").isin("blocked", "rate_limited") & (F.col("cf_verdict") == "allowed"))


def rejected(rows: DataFrame, start: int, end: int, feed: str | None = None, reason: str | None = None, limit: int = 100) -> DataFrame:
    """Dead letters of a closed range, newest first."""
    rows = rows.where(F.col("received_at").between(start, end))
    if feed:
        rows = rows.where(F.col("feed_id") == feed)
    if reason:
        rows = rows.where(F.col("reason") == reason)
    return rows.orderBy(F.desc("received_at"), F.desc("event_id")).limit(min(limit, 1000))


def union_strings(a: str, b: str) -> F.Column:
    """Both lists without empty texts and repetitions, in their order."""
    return F.filter(F.array_union(a, b), lambda x: x != "")


def union_candidates(configured: DataFrame, observed: DataFrame) -> DataFrame:
    """Rules that are configured or were seen, each once."""
    return configured.select("rule_id").union(observed.select("rule_id")).where("rule_id <> ''").distinct()


def append_unique(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Distinct members of lists of a group, sorted."""
    return rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(column)))).alias(column))


def resolve_unique(rows: DataFrame, email: str) -> DataFrame:
    """Tenant of an address and whether it is the only one; no row if there is none."""
    found = rows.where(F.lower("email") == email.lower()).select("tenant_id").distinct().limit(2)
    return found.agg(F.min("tenant_id").alias("tenant_id"), (F.count("*") == 1).alias("unique")).where("tenant_id IS NOT NULL")


def duplicates(rows: DataFrame, keys: list[F.Column], names: list[str]) -> DataFrame:
    """Keys that stand more than once."""
    return rows.groupBy(*(k.alias(n) for k, n in zip(keys, names))).agg(F.count("*").alias("n")).where("n > 1")


def backfill_column(events: DataFrame, raw: DataFrame, column: str, pattern: str, before: int = 1_800, after: int = 14_400) -> DataFrame:
    """The next version of events that lack a column's value, with what a pattern finds in their raw payload.

    The payload is looked for from `before` seconds before to `after` seconds after the event.
    """
    newest = latest(events, ["tenant_id", "event_id"]).where(F.coalesce(column, F.lit("")) == "")
    found = raw.select("tenant_id", "event_id", "received_at", F.regexp_extract("payload", pattern, 1).alias("_found")).where("_found <> ''")
    found = found.groupBy("tenant_id", "event_id").agg(F.min_by("_found", "received_at").alias("_found"), F.min("received_at").alias("_at"))
    met = newest.join(found, ["tenant_id", "event_id"]).where(F.col("_at").between(F.col("event_time") - before, F.col("event_time") + after))
    return met.withColumn(column, F.col("_found")).withColumn("ingest_version", F.col("ingest_version") + 1).drop("_found", "_at")


def rule_samples(events: DataFrame, rule: str, limit: int = 20) -> DataFrame:
    """Newest events of a rule, each in its newest version."""
    return latest(events.where(F.col("rule_id") == rule), ["tenant_id", "event_id"]).orderBy(F.desc("event_time"), F.desc("event_id")).limit(limit)


def list_rules(rules: DataFrame, tenant: str) -> DataFrame:
    """A tenant's alert rules in their newest version, by name."""
    return latest(rules, ["tenant_id", "rule_id"], "version").where(F.col("tenant_id") == tenant).orderBy("name", "rule_id")


def enabled_rules(rules: DataFrame) -> DataFrame:
    """Rules of all tenants whose newest version is enabled."""
    return latest(rules, ["tenant_id", "rule_id"], "version").where("enabled")


def list_feeds(feeds: DataFrame, tenant: str) -> DataFrame:
    """A tenant's feeds in their newest version, by id."""
    return latest(feeds, ["tenant_id", "feed_id"], "version").where(F.col("tenant_id") == tenant).orderBy("feed_id")


def pull_feeds(feeds: DataFrame) -> DataFrame:
    """Feeds of all tenants that are to be pulled and whose newest version is enabled."""
    return latest(feeds, ["tenant_id", "feed_id"], "version").where("enabled AND mode = 'pull'")


def chain_links(entries: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Audit entries with `linked`: whether an entry names the digest of the one before it. A tenant's first has none to name.

    Entries are dealt out by ranges of (tenant, time, entry), so a tenant's chain is looked at in many
    places at once; each range takes the digest it goes on from out of a table of the ranges' last ones.
    `before` (tenant_id, entry_hash) gives the digests that come before the entries of a part of a chain.
    """
    order = ["occurred_at", "entry_id"]
    # Cut, as ranges are sampled and must not change between the readings.
    ranged = cut(entries.repartitionByRange("tenant_id", *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("tenant_id", "_range").orderBy(*order)
    ends = ranged.groupBy("tenant_id", "_range").agg(F.max_by("entry_hash", F.struct(*order)).alias("_end"))  # a row for each range and tenant in it
    if before is not None:
        ends = ends.unionByName(before.select("tenant_id", F.lit(-1).alias("_range"), F.col("entry_hash").alias("_end")))
    carried = ends.withColumn("_carried", F.lag("_end").over(Window.partitionBy("tenant_id").orderBy("_range"))).drop("_end")
    rows = ranged.withColumn("_first", F.row_number().over(inside) == 1).withColumn("_before", F.lag("entry_hash").over(inside))
    came = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before"))
    joined = rows.join(carried, ["tenant_id", "_range"])
    return joined.withColumn("linked", came.isNull() | (F.col("prev_hash") == came)).select(*entries.columns, "linked")
