"""Contiguous shards of near equal bytes from global prefix sums.

Rows are put into a global order by range partitioning and sorted inside each partition. A first
pass totals the bytes of each partition; the running totals of those few rows give every partition
its start in the global byte line. A second pass adds the running total inside the partition, so no
row ever needs another partition. The byte line is then cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table, utf8_size


def balanced_shards(rows: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard number and place in the shard of every row.

    Order is by id (nulls first), then by a digest and the size of the text, so repeated ids and
    rows have a defined order up to rows that are wholly alike. A row belongs to the shard that holds
    the middle of its bytes; a shard's bytes differ from the target by less than the two rows at its
    ends. The size of a row is its text's UTF-8 bytes plus one, so null and empty texts count too.
    An empty table gives an empty result; with fewer rows than shards some shards stay empty. Texts of
    any length count by their bytes. Other columns are not read.

    Columns: the id, size, text_crc32, shard, slot (from 0 in each shard, without gaps).
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    line = rows.select(
        F.col(id_col).alias("_id"),
        (utf8_size(text_col) + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_digest"),
    )
    order = ["_id", "_digest", "size"]
    ranged = line.repartitionByRange(*order).sortWithinPartitions(*order)
    # Range bounds come from a sample, so the partitioning is fixed by writing it down once.
    ranged = cut(ranged.withColumn("_part", F.spark_partition_id()))
    by_part = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = (
        ranged.groupBy("_part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .select(
            "_part",
            F.coalesce(F.sum("bytes").over(by_part), F.lit(0)).alias("_start"),
            F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("_row"),
            F.sum("bytes").over(Window.partitionBy()).alias("_total"),
        )
    )

    # The broadcast side has one row for each partition of the table. Ids stay on Spark's side.
    along = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("_start") + F.sum("size").over(along) - F.col("size") / 2
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.greatest(F.lit(1), "_total")).cast("int"))
    place = F.col("_row") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    placed = ranged.join(F.broadcast(starts), "_part").select("_id", "size", "text_crc32", shard.alias("shard"), place.alias("_at"))
    placed = cut(placed)
    firsts = placed.groupBy("shard").agg(F.min("_at").alias("_first"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_at") - F.col("_first")).alias("slot")
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"), 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
