"""Versioned tables: appended versions, read as the newest of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], version: str = "ingest_version", ties: list[str] | None = None, fixed: Column | None = None) -> DataFrame:
    """The newest version of each key; ties between equal versions go by `ties`, descending.

    Filters on columns that a later version may change belong after this, not before it. `fixed` is a
    filter on columns that all versions of a key share; it is applied before, where it reaches the scan.
    """
    if fixed is not None:
        rows = rows.where(fixed)
    order = [F.desc(c) for c in (version, *(ties or []))]
    return pick_first(rows, keys, order)


def pick_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (one per key, also where the key is null)."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def newest_value(rows: DataFrame, keys: list[str], value: str, version: str) -> DataFrame:
    """The value of the newest version of each key, as an aggregate."""
    return rows.groupBy(*keys).agg(F.max_by(value, version).alias(value))


def versions(rows: DataFrame, keys: list[str], version: str = "ingest_version") -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(version).alias(version))


def append_version(stored: DataFrame, changes: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """New versions of changed rows: the stored version plus one, or 1."""
    now = versions(stored, keys, version).withColumnRenamed(version, "_stored")
    return changes.drop(version).join(now, keys, "left").withColumn(version, F.coalesce("_stored", F.lit(0)) + 1).drop("_stored")


def replace_snapshot(new: DataFrame, required: list[str] | None = None) -> DataFrame:
    """A dimension's next snapshot; an empty one is refused, as are rows without the required texts."""
    for column in required or []:
        new = new.where(F.coalesce(F.trim(column), F.lit("")) != "")
    if new.limit(1).count() == 0:
        raise ValueError("an empty snapshot would erase the dimension")
    return new
