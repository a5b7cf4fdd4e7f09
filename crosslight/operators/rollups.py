"""The dashboard's five rollups as states that can be merged, of bounded size and blind to redeliveries.

A rollup has a row for each tenant, bucket of time and value of its dimensions, with a sketch of the
distinct ids that fell there. A batch of a stream adds the states of its own rows; states of one key
are united when they are read, and since they are sets, what comes twice counts once. Coarser
buckets, whole ranges and rebuilt hours come out of the same union.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bucket_start
from .filters import panel_size

#: Width of a bucket in seconds, and the sketch's size: 2^LG_K places, about 0.8 % of error, so 5 % are six standard errors.
WIDTH, LG_K = 300, 14
STOPPED = ("blocked", "rate_limited")


@dataclass(frozen=True)
class Rollup:
    """What a rollup counts (ids of `counted` rows), along which dimensions, by which time; rows that `where` leaves out don't count."""

    dimensions: tuple[str, ...]
    counted: str = "event_id"
    time: str = "event_time"
    where: str = "true"


ROLLUPS = {
    "volume": Rollup(("vendor",)),
    "verdicts": Rollup(("vendor", "verdict")),
    "rules": Rollup(("vendor", "rule_id"), where="rule_id <> ''"),
    "sources": Rollup(("client_ip", "client_country", "client_asn", "stopped"), where="client_ip IS NOT NULL"),
    "disagreement": Rollup(("disagreement_kind",), "correlation_id", "window_start"),
}


def states(rows: DataFrame, name: str, width: int = WIDTH) -> DataFrame:
    """States of a rollup: tenant_id, bucket, its dimensions, state. Rows are events, or records for "disagreement"."""
    rollup = ROLLUPS[name]
    if "stopped" in rollup.dimensions:
        rows = rows.withColumn("stopped", F.col("verdict").isin(*STOPPED))
    keys = ["tenant_id", bucket_start(F.col(rollup.time), width).alias("bucket"), *rollup.dimensions]
    return rows.where(rollup.where).groupBy(*keys).agg(F.hll_sketch_agg(rollup.counted, F.lit(LG_K)).alias("state"))


def united(found: DataFrame, keys: list[str | Column]) -> DataFrame:
    """One state for each of some keys, out of finer ones or of several batches' ones. States filed with fewer places go together with larger ones."""
    return found.groupBy(*keys).agg(F.hll_union_agg("state", F.lit(True)).alias("state"))


def estimated(found: DataFrame, name: str, width: int | None = None, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Counts of a rollup, in buckets of `width` seconds (None: over all of `found`), along its dimensions or some of them.

    A sketch that has not met another full one is estimated from the order in which its ids came. United with
    itself it holds the same ids and is estimated from these alone, so equal sets have equal counts.
    """
    time = [] if width is None else [bucket_start(F.col("bucket"), width).alias("bucket")]
    out = united(found, ["tenant_id", *time, *(ROLLUPS[name].dimensions if keys is None else keys)])
    return out.withColumn("events", F.hll_sketch_estimate(F.hll_union("state", "state"))).drop("state")


def top(found: DataFrame, name: str, size: int = 10) -> DataFrame:
    """The values of a rollup with most ids, for each tenant, from states alone; ties go by the values."""
    from pyspark.sql import Window

    counts = estimated(found, name)
    order = Window.partitionBy("tenant_id").orderBy(F.desc("events"), *ROLLUPS[name].dimensions)
    return counts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= panel_size(size)).drop("_n")


def disagreement_rates(found: DataFrame, width: int) -> DataFrame:
    """Records that disagree and all records of each bucket and kind, from the states of "disagreement"."""
    kinds = estimated(found, "disagreement", width)
    totals = estimated(found, "disagreement", width, ()).withColumnRenamed("events", "total")
    return kinds.where("disagreement_kind <> 'none'").join(totals, ["tenant_id", "bucket"]).withColumnRenamed("events", "disagreeing")


def members(rows: DataFrame, name: str, width: int = WIDTH) -> DataFrame:
    """A rollup's sets themselves, for exact counts: tenant_id, bucket, its dimensions, member. A row for each id, however often it came."""
    rollup = ROLLUPS[name]
    if "stopped" in rollup.dimensions:
        rows = rows.withColumn("stopped", F.col("verdict").isin(*STOPPED))
    bucket = bucket_start(F.col(rollup.time), width).alias("bucket")
    return rows.where(rollup.where).select("tenant_id", bucket, *rollup.dimensions, F.col(rollup.counted).alias("member")).distinct()


def counted(found: DataFrame, name: str) -> DataFrame:
    """Exact counts of a rollup along its dimensions, over all of `found`, from its members alone."""
    return found.groupBy("tenant_id", *ROLLUPS[name].dimensions).agg(F.count_distinct("member").alias("events"))


def _inside(low: int, high: int, width: int) -> Callable[[str], Column]:
    """Whether a column of seconds lies in the whole buckets that a range touches."""
    low, high = low // width * width, -(-high // width) * width
    return lambda c: (F.col(c) >= low) & (F.col(c) < high)


def rebuilt(stored: DataFrame, rows: DataFrame, name: str, low: int, high: int, width: int = WIDTH) -> DataFrame:
    """The rollup with the buckets from `low` to before `high` made anew of rows, for a backfill or a repair; other buckets are not touched.

    Buckets that the limits cut through are made anew whole, so rows must hold all of these.
    """
    inside = _inside(low, high, width)
    fresh = states(rows.where(inside(ROLLUPS[name].time)), name, width)
    return united(stored, ["tenant_id", "bucket", *ROLLUPS[name].dimensions]).where(~inside("bucket")).unionByName(fresh)


def rebuilt_members(stored: DataFrame, rows: DataFrame, name: str, low: int, high: int, width: int = WIDTH) -> DataFrame:
    """`rebuilt` for the members of a rollup."""
    inside = _inside(low, high, width)
    return stored.where(~inside("bucket")).unionByName(members(rows.where(inside(ROLLUPS[name].time)), name, width))
