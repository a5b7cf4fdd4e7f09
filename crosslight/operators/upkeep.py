"""Retention, purges, storage figures and the audit chain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import framed, hash_chain
from .lookups import chain_links

DAY = 86_400


def retention_days(days: int) -> int:
    """0 means 30; otherwise 1 to 730."""
    return 30 if days == 0 else min(730, max(1, days))


def retained(rows: DataFrame, tenants: DataFrame, now: int, column: str = "event_time") -> DataFrame:
    """Rows that their tenant's retention keeps (tenants: tenant_id, retention_days)."""
    days = F.when(F.coalesce("retention_days", F.lit(0)) == 0, 30).otherwise(F.least(F.lit(730), F.greatest(F.lit(1), "retention_days")))
    limits = tenants.select("tenant_id", (F.lit(now) - days * DAY).alias("_from"))
    kept = rows.join(F.broadcast(limits) if tenants.limit(100_001).count() <= 100_000 else limits, "tenant_id", "left")
    return kept.where(F.col(column) >= F.coalesce("_from", F.lit(now - 30 * DAY))).drop("_from")


def purged(rows: DataFrame, tenant: str, start: int, end: int, reason: str, column: str = "event_time") -> tuple[DataFrame, DataFrame]:
    """Rows without those of a tenant's range, and how many went; a reason is required."""
    if not reason.strip():
        raise ValueError("a purge needs a reason")
    gone = (F.col("tenant_id") == tenant) & (F.col(column) >= start) & (F.col(column) < end)
    count = rows.where(gone).agg(F.count("*").alias("rows")).withColumn("tenant_id", F.lit(tenant)).withColumn("reason", F.lit(reason))
    return rows.where(~gone), count


def purge_all(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


def storage_stats(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of each partition folder of a table, from the file listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    folder = F.coalesce(F.nullif(F.regexp_extract("path", r"date=([^/]+)/", 1), F.lit("")), F.lit("all"))
    return files.groupBy(folder.alias("partition")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def days_to_full(daily: DataFrame, capacity: int, today: str) -> DataFrame:
    """Days until a capacity is used up, at the mean of whole days (today doesn't count)."""
    out = daily.agg(F.sum("bytes").alias("used"), F.avg(F.when(F.col("day") != today, F.col("bytes"))).alias("per_day"))
    return out.withColumn("days_left", F.when(F.col("per_day") > 0, F.floor(F.greatest(F.lit(0), F.lit(capacity) - F.col("used")) / F.col("per_day"))).cast("long"))


AUDIT_FIELDS = ("tenant_id", "entry_id", "occurred_at", "actor", "action", "target", "detail")


def chained(entries: DataFrame) -> DataFrame:
    """Entries with prev_hash, the digest of the tenant's entry before ("" for the first), and entry_hash, the digest of prev_hash and the fields.

    Whoever changes an entry has to change all later ones. Each digest needs the one before, so a
    tenant's entries are sealed in order, by one task that keeps no more than the last digest.
    """
    keys = ["tenant_id", "entry_id"]

    def seal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, last = None, ""
        for batch in batches:
            before, own = [], []
            for name, content in zip(batch["tenant_id"], batch["content"]):
                if name != tenant:
                    tenant, last = name, ""
                before.append(last)
                last = hashlib.sha256(f"{len(last)}:{last}|{content}".encode()).hexdigest()
                own.append(last)
            yield batch[keys].assign(prev_hash=before, entry_hash=own)

    content = entries.select(*keys, "occurred_at", framed(*(F.col(c).cast("string") for c in AUDIT_FIELDS)).alias("content"))
    ordered = content.repartition("tenant_id").sortWithinPartitions("tenant_id", "occurred_at", "entry_id").select(*keys, "content")
    return entries.join(ordered.mapInPandas(seal, "tenant_id string, entry_id string, prev_hash string, entry_hash string"), keys)


def verify_chain(entries: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Entries with `intact`, whether prev_hash and the fields still give the digest, and `linked`, whether prev_hash is that of the entry before."""
    return chain_links(entries.withColumn("intact", F.col("entry_hash") == hash_chain(F.col("prev_hash"), *(F.col(c) for c in AUDIT_FIELDS))), before)


def list_audit(entries: DataFrame, start: int, end: int, action: str | None = None, actor: str | None = None) -> DataFrame:
    """Entries of a closed range in order, verified before the page is narrowed: the range's own, and against each tenant's last digest before it."""
    earlier = entries.where(F.col("occurred_at") < start).groupBy("tenant_id").agg(F.max_by("entry_hash", F.struct("occurred_at", "entry_id")).alias("entry_hash"))
    rows = verify_chain(entries.where(F.col("occurred_at").between(start, end)), earlier)
    if action:
        rows = rows.where(F.col("action") == action)
    if actor:
        rows = rows.where(F.col("actor") == actor)
    return rows.orderBy("occurred_at", "entry_id")
