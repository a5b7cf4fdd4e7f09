"""Writing batches of a stream: raw first, then events and rejections, then records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pointers
from .payloads import normalise

DAY = 86_400


def by_day(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("date", F.to_date(F.timestamp_seconds(column)))


def append(rows: DataFrame, path: str, column: str, sort: list[str] | None = None, batch: int | None = None) -> None:
    """Adds rows to a table partitioned by day; sorted rows let readers skip row groups.

    With a batch's number they have a folder of their own under each day, so a batch that is run again
    replaces what it wrote before. A table written so belongs to one stream, whose checkpoint counts the
    batches; `removal` deletes from it.
    """
    dated = by_day(rows, column).repartition("date", F.pmod(F.xxhash64("tenant_id"), F.lit(16)))
    ordered = dated.sortWithinPartitions(*sort) if sort else dated
    if batch is None:
        ordered.write.partitionBy("date").mode("append").parquet(path)
    else:
        numbered = ordered.withColumn("batch", F.lit(batch).cast("long"))
        numbered.write.partitionBy("date", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_batch(root: str, year: int | None = None, buckets: int = pointers.BUCKETS):
    """For foreachBatch: the raw payloads, what they mean, pointers to these, and what was refused; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        append(batch.withColumn("batch_no", F.lit(number)), f"{root}/raw", "received_at", batch=number)
        accepted, rejected = normalise(batch, year)
        append(accepted, f"{root}/events", "event_time", ["tenant_id", "vendor", "event_time"], number)
        pointers.write_pointers(pointers.event_pointers(accepted), f"{root}/pointers", number, buckets)
        append(rejected, f"{root}/rejected", "received_at", batch=number)

    return write


def dead_letters(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """Rejected rows whose reason is missing count as unreadable."""
    return rows.withColumn("reason", F.coalesce(F.nullif(F.trim(reason), F.lit("")), F.lit("PARSE_ERROR")))


def append_records(records: DataFrame, path: str, batch: int | None = None) -> None:
    """Appends record versions; the verdicts that queries filter on stand in columns of their own."""
    append(records, path, "window_start", ["tenant_id", "window_start"], batch)
