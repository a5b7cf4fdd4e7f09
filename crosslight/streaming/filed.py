"""Tables in folders by day and batch, of which a batch reads only the days it needs."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.removal import OWN, manifest, visible


def file_rows(rows: DataFrame, path: str, column: str, number: int, sort: list[str]) -> None:
    """Files a batch's rows under the day of a time column and the batch's number; a batch that is run again replaces what it filed."""
    rows = rows.withColumn("date", F.to_date(F.timestamp_seconds(column))).withColumn("batch", F.lit(number).cast("long"))
    # A day's rows go to a few tasks, so a busy day is not one task's.
    dealt = rows.repartition("date", F.pmod(F.xxhash64(*sort), F.lit(4)))
    dealt.sortWithinPartitions("date", *sort).write.partitionBy("date", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def _days(spark: SparkSession, path: str) -> list[str]:
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(base):
        return []
    return sorted(s.getPath().getName()[5:] for s in system.listStatus(base) if s.getPath().getName().startswith("date="))


def filed(spark: SparkSession, path: str, number: int | None = None, low: int | None = None, high: int | None = None) -> DataFrame | None:
    """What batches before `number` have filed under the days from `low` to `high` (seconds); None where there is nothing.

    Only the folders of these days are listed and read. A batch that is run again doesn't see its own traces.
    What deletions have hidden is not there (see `sources.removal`).
    """
    day = lambda s: datetime.datetime.fromtimestamp(s, datetime.timezone.utc).date().isoformat()
    wanted = [d for d in _days(spark, path) if (low is None or d >= day(low)) and (high is None or d <= day(high))]
    if not wanted:
        return None
    found = spark.read.option("basePath", path).parquet(*(f"{path}/date={d}" for d in wanted))
    found = visible(found, manifest(spark, path)[1])
    return found if number is None else found.where((F.col("batch") < number) | (F.col("batch") >= OWN))
