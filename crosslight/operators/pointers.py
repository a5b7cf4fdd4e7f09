"""An inverted table from events and identifiers to where they are stored, for look-ups that must not scan.

A pointer lies under its kind, the day of its time and a bucket of its value. A look-up knows all three,
so it lists and reads one bucket of a few days, and in it only the row groups whose Bloom filter may
hold the value. The rows that a pointer leads to are then read from their own days alone.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import cut
from .latest import latest

#: Buckets of a day; more of them mean smaller files and fewer rows to a look-up. A table is read with as many as it was written with.
BUCKETS = 64
#: What events can be found by, besides their own id.
IDENTIFIERS = ("vendor_request_id", "vendor_event_id", "linked_request_id", "ja4")
#: Seconds around an event in which its record begins, and the most events that are followed for an identifier.
SLACK, FOLLOWED = 600, 100
#: Rows that are sent to all tasks rather than joined by a shuffle.
SENT = 100_000


def bucket_of(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def _day(column: str) -> Column:
    return F.to_date(F.timestamp_seconds(column))


def event_pointers(events: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Pointers to events by their id (kind "event") and by every identifier they carry, or of some kinds; empty identifiers point nowhere.

    Versions of an event repeat its pointers, which are dropped when they are written.
    """
    known = ["event", *(c for c in IDENTIFIERS if c in events.columns)]
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col("event_id" if k == "event" else k).cast("string").alias("value")) for k in known if kinds is None or k in kinds))
    each = events.select("tenant_id", "event_id", F.col("event_time").alias("at"), F.explode(pairs).alias("p"))
    return each.select("tenant_id", "p.kind", "p.value", "event_id", F.lit(None).cast("string").alias("correlation_id"), "at").where("value <> ''")


def record_pointers(records: DataFrame) -> DataFrame:
    """Pointers from the events of records to these (kind "record"); all versions of a record share one, once they are written."""
    each = records.select("tenant_id", F.explode("event_ids").alias("event_id"), "correlation_id", F.col("window_start").alias("at"))
    return each.select("tenant_id", F.lit("record").alias("kind"), F.col("event_id").alias("value"), "event_id", "correlation_id", "at")


def write_pointers(pointers: DataFrame, path: str, number: int = 0, buckets: int = BUCKETS) -> None:
    """Adds pointers as those of batch `number`, each once; a batch that is written again replaces itself."""
    rows = pointers.withColumn("date", _day("at")).withColumn("bucket", bucket_of(F.col("value"), buckets)).withColumn("batch", F.lit(number).cast("long"))
    keys = ["kind", "date", "bucket", "batch"]
    # Dealt out before the repeated ones are dropped: equal pointers go to one task anyhow, so they are shuffled once. Kinds are
    # left out, as Spark takes a column of one value out of what it groups by, and would then shuffle again.
    dealt = rows.repartition("date", "bucket").distinct().sortWithinPartitions(*keys, "tenant_id", "value")
    filtered = dealt.write.option("parquet.bloom.filter.enabled#value", "true").option("parquet.bloom.filter.expected.ndv#value", "100000")
    filtered.partitionBy(*keys).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def _days(low: int, high: int) -> Column:
    day = lambda s: datetime.datetime.fromtimestamp(s, datetime.timezone.utc).date()
    return F.col("date").between(F.lit(day(low)), F.lit(day(high)))


def pointed(pointers: DataFrame, tenant: str, kind: str, values: list[str], low: int, high: int, buckets: int = BUCKETS) -> DataFrame:
    """Pointers of a tenant to some values within a closed range of seconds. Kind, days and buckets are constants, so other files are not opened."""
    own = pointers.sparkSession.range(1).select(F.explode(F.array(*(bucket_of(F.lit(v), buckets) for v in values)))).distinct().collect() if values else []
    wanted = (F.col("kind") == kind) & _days(low, high) & F.col("bucket").isin([r[0] for r in own])
    return pointers.where(wanted & F.col("value").isin(values) & (F.col("tenant_id") == tenant) & F.col("at").between(low, high))


def _rows_at(rows: DataFrame, tenant: str, column: str, found: list[tuple[str, int]], time_column: str) -> DataFrame:
    """Rows of a tenant by a key, each from the day and second that its pointer names; `found` is bounded by what is followed."""
    at = reduce(lambda a, b: a | b, ((F.col(column) == k) & (F.col(time_column) == t) for k, t in found), F.lit(False))
    if found and "date" in rows.columns:
        rows = rows.where(F.col("date").isin([datetime.datetime.fromtimestamp(t, datetime.timezone.utc).date() for _, t in found]))
    return rows.where((F.col("tenant_id") == tenant) & at)


def event_by_id(pointers: DataFrame, events: DataFrame, tenant: str, event_id: str, low: int, high: int, buckets: int = BUCKETS) -> DataFrame:
    """Newest version of one event of a tenant; no row where it has none in the range."""
    found = [(r.event_id, r.at) for r in pointed(pointers, tenant, "event", [event_id], low, high, buckets).select("event_id", "at").distinct().limit(FOLLOWED).collect()]
    return _rows_at(events, tenant, "event_id", found, "event_time").orderBy(F.desc("ingest_version")).limit(1)


def _newest(records: DataFrame, tenant: str, ids: list[str], low: int, high: int) -> DataFrame:
    """Newest versions of a few records that begin within a closed range; a later version may begin earlier, never later."""
    if "date" in records.columns:
        records = records.where(_days(low, high))
    own = records.where((F.col("tenant_id") == tenant) & F.col("correlation_id").isin(ids) & F.col("window_start").between(low, high))
    return latest(own, ["tenant_id", "correlation_id"], "version")


def record_of_event(pointers: DataFrame, records: DataFrame, tenant: str, event_id: str, at: int, slack: int = SLACK, buckets: int = BUCKETS) -> DataFrame:
    """A tenant's records that hold an event, of those that begin within `slack` seconds of it. Another tenant's event of the same id leads nowhere."""
    found = pointed(pointers, tenant, "record", [event_id], at - slack, at + slack, buckets).select("correlation_id").distinct().limit(FOLLOWED).collect()
    return _newest(records, tenant, [r[0] for r in found], at - slack, at + slack)


def records_of_identifier(pointers: DataFrame, records: DataFrame, tenant: str, column: str, value: str, low: int, high: int, slack: int = SLACK, buckets: int = BUCKETS) -> DataFrame:
    """A tenant's records that hold an event with an identifier, among events from `low` to before `high`.

    At most FOLLOWED events, the first by id, are followed; records are looked for only around the span of these.
    """
    if column not in IDENTIFIERS:
        raise ValueError(f"events can't be found by {column}")
    events = pointed(pointers, tenant, column, [value], low, high - 1, buckets).groupBy("event_id").agg(F.min("at").alias("first"), F.max("at").alias("last")).orderBy("event_id").limit(FOLLOWED).collect()
    first, last = min((r["first"] for r in events), default=0) - slack, max((r["last"] for r in events), default=0) + slack
    ids = pointed(pointers, tenant, "record", [r["event_id"] for r in events], first, last, buckets).select("correlation_id").distinct().collect() if events else []
    return _newest(records, tenant, [r[0] for r in ids], first, last)


def _small(rows: DataFrame) -> DataFrame:
    """What is followed, worked out once and sent to all tasks if it is few rows, so that the table it is looked up in isn't shuffled."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows


def records_of_identifier_by_tenant(pointers: DataFrame, records: DataFrame, tenants: DataFrame, column: str, value: str, low: int, high: int, slack: int = SLACK, buckets: int = BUCKETS) -> DataFrame:
    """`records_of_identifier` for every tenant of a table (tenant_id) at once, with at most FOLLOWED events and a span for each."""
    if column not in IDENTIFIERS:
        raise ValueError(f"events can't be found by {column}")
    own = tenants.select("tenant_id").distinct()
    wanted = (F.col("kind") == column) & _days(low, high - 1) & (F.col("bucket") == bucket_of(F.lit(value), buckets)) & (F.col("value") == value) & F.col("at").between(low, high - 1)
    events = pointers.where(wanted).join(own, "tenant_id", "left_semi").groupBy("tenant_id", "event_id").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    order = Window.partitionBy("tenant_id").orderBy("event_id")
    events = events.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= FOLLOWED)
    spans = events.groupBy("tenant_id").agg((F.min("first") - slack).alias("first"), (F.max("last") + slack).alias("last"))
    followed = _small(events.select("tenant_id", F.col("event_id").alias("value"), bucket_of(F.col("event_id"), buckets).alias("bucket")).join(spans, "tenant_id"))
    near = _days(low - slack, high - 1 + slack)
    there = pointers.where((F.col("kind") == "record") & near).select("tenant_id", "value", "bucket", "correlation_id", "at")
    ids = there.join(followed, ["tenant_id", "value", "bucket"]).where(F.col("at").between(F.col("first"), F.col("last"))).select("tenant_id", "correlation_id", "first", "last").distinct()
    if "date" in records.columns:
        records = records.where(near)
    names = records.columns
    found = records.join(_small(ids), ["tenant_id", "correlation_id"]).where(F.col("window_start").between(F.col("first"), F.col("last"))).select(*names)
    return latest(found, ["tenant_id", "correlation_id"], "version")
