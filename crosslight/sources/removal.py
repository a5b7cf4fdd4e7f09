"""Deletions from tables in folders by day and batch (see `streaming.filed`), under a manifest that readers follow.

A deletion writes what stays of the days it touches into a batch folder of its own, and then swaps in
the next manifest, which hides these days' other folders; whole days are hidden without reading them.
The swap is one rename, so readers see all of a deletion or nothing, and one that died before it has
changed nothing and can be run again. `vacuum` removes hidden folders later.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches from this number on are a deletion's, and visible only if the manifest names them.
OWN = 1 << 40


def _system(spark: SparkSession, path: str):
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    return base, base.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    base, system = _system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(base)) if system.exists(base) else []


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, dict]]:
    """The newest manifest's version (0: none), and for each day that deletions touched its hidden batches and the one that is theirs."""
    versions = [int(n[1:-5]) for n in _names(spark, f"{path}/_manifest") if n.startswith("v") and n.endswith(".json")]
    if not versions:
        return 0, {}
    text = spark.read.text(f"{path}/_manifest/v{max(versions)}.json", wholetext=True).first()[0]
    return max(versions), json.loads(text)


def swap(spark: SparkSession, path: str, version: int, content: dict[str, dict]) -> None:
    """Makes a manifest the newest; an error if another deletion has swapped in one of this version meanwhile."""
    text = json.dumps(content, sort_keys=True)
    part, system = _system(spark, f"{path}/_manifest/part-{version}")
    out = system.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    target, _ = _system(spark, f"{path}/_manifest/v{version}.json")
    if system.exists(target) or not system.rename(part, target):
        raise RuntimeError(f"another deletion has changed {path}; run this one again")


def visible(rows: DataFrame, content: dict[str, dict]) -> DataFrame:
    """Rows that a manifest shows. A day's hidden batches are a filter on folders, so they are not read."""
    shown = F.col("batch") < OWN
    for day, found in content.items():
        own = (F.col("date") == F.lit(datetime.date.fromisoformat(day))) & ~F.col("batch").isin(found["hidden"])
        shown = F.when(F.col("date") == F.lit(datetime.date.fromisoformat(day)), own & (shown | (F.col("batch") == found["own"]))).otherwise(shown)
    return rows.where(shown)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table without what was deleted."""
    return visible(spark.read.parquet(path), manifest(spark, path)[1])


def delete(spark: SparkSession, path: str, gone: Column, days: list[str], whole: list[str]) -> int:
    """Deletes rows for which `gone` is true from some days, and all of the days in `whole`. Days that lose nothing are not rewritten.

    Returns how many rows went; a day that goes whole is counted by its files' footers alone.
    """
    version, content = manifest(spark, path)
    rows = visible(spark.read.parquet(path), content)
    day = F.date_format("date", "yyyy-MM-dd")
    gone = F.coalesce(gone, F.lit(False))
    counts = rows.where(day.isin([*days, *whole])).groupBy(day.alias("day")).agg(F.count(F.when(gone | day.isin(whole), 1)).alias("gone"), F.count("*").alias("n")).where("gone > 0").collect()
    if not counts:
        return 0
    own = OWN + version + 1
    kept = [r["day"] for r in counts if r["gone"] < r["n"]]
    if kept:
        left = rows.where(day.isin(kept) & ~gone).withColumn("batch", F.lit(own))
        left.repartition("date", F.pmod(F.xxhash64("tenant_id"), F.lit(4))).write.partitionBy("date", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    for r in counts:
        batches = [int(n[6:]) for n in _names(spark, f"{path}/date={r['day']}") if n.startswith("batch=")]
        content[r["day"]] = {"hidden": sorted(b for b in batches if b != own), "own": own}
    swap(spark, path, version + 1, content)
    return sum(r["gone"] for r in counts)


def _days(spark: SparkSession, path: str) -> list[str]:
    return [n[5:] for n in _names(spark, path) if n.startswith("date=")]


def _day(seconds: int) -> str:
    return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc).date().isoformat()


def _audited(spark: SparkSession, audit: str, path: str, action: str, reason: str, rows: int, now: int) -> int:
    entry = [("", f"{action}-{now}-{path.rsplit('/', 1)[-1]}", now, action, path, json.dumps({"reason": reason, "rows": rows}))]
    spark.createDataFrame(entry, "tenant_id string, entry_id string, occurred_at long, action string, target string, detail string").write.mode("append").parquet(audit)
    return rows


def purge_range(spark: SparkSession, path: str, tenant: str, start: int, end: int, reason: str, audit: str, now: int, column: str = "event_time") -> int:
    """Deletes a tenant's rows from `start` to before `end`; a reason is required and noted with the number of rows."""
    if not reason.strip():
        raise ValueError("a purge needs a reason")
    days = [d for d in _days(spark, path) if _day(start) <= d <= _day(end - 1)]
    gone = (F.col("tenant_id") == tenant) & (F.col(column) >= start) & (F.col(column) < end)
    return _audited(spark, audit, path, "purge_range", reason, delete(spark, path, gone, days, []), now)


def purge_all(spark: SparkSession, path: str, reason: str, audit: str, now: int) -> int:
    """Deletes all rows of a table, by hiding its days."""
    if not reason.strip():
        raise ValueError("a purge needs a reason")
    return _audited(spark, audit, path, "purge_all", reason, delete(spark, path, F.lit(False), [], _days(spark, path)), now)


def retention_delete(spark: SparkSession, path: str, days_of: dict[str, int], now: int, audit: str, column: str = "event_time", default: int = 30) -> int:
    """Deletes what each tenant's retention has run out for (days by tenant, 1 to 730; 0 and tenants without: `default`).

    Days before the longest retention go whole; days that no retention reaches are not read.
    """
    days_of = {t: default if d == 0 else min(730, max(1, d)) for t, d in days_of.items()}
    limits = {t: now - d * 86_400 for t, d in days_of.items()}
    oldest, newest = min([*limits.values(), now - default * 86_400]), max([*limits.values(), now - default * 86_400])
    every = _days(spark, path)
    limit = F.lit(now - default * 86_400)
    for tenant, at in limits.items():  # one for each tenant that set one
        limit = F.when(F.col("tenant_id") == tenant, F.lit(at)).otherwise(limit)
    rows = delete(spark, path, F.col(column) < limit, [d for d in every if _day(oldest) <= d <= _day(newest)], [d for d in every if d < _day(oldest)])
    return _audited(spark, audit, path, "retention", f"older than {default} days or a tenant's own limit", rows, now)


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes hidden folders and those of deletions that never came to their swap; how many. For times without deletions or long readers."""
    _, content = manifest(spark, path)
    removed = 0
    for day in _days(spark, path):
        own = content.get(day, {"hidden": [], "own": None})
        for name in _names(spark, f"{path}/date={day}"):
            number = int(name[6:]) if name.startswith("batch=") else -1
            if number in own["hidden"] or (number >= OWN and number != own["own"]):
                folder, system = _system(spark, f"{path}/date={day}/{name}")
                removed += bool(system.delete(folder, True))
    return removed
