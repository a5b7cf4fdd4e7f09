"""Pulling sources: landed files, and a stream of time slices or of pages behind a cursor."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from ..schemas import ENVELOPE

# Seconds of a slice, how far slices stay behind now, where the first begins, the most pages of a poll.
SLICE, LAG, FIRST, MAX_PAGES = 300, 120, 3_600, 100
# Fixed value: the most bytes that a compressed payload may hold.
LARGEST = 256 << 20


@F.pandas_udf(T.StringType())
def plain_text(contents: pd.Series) -> pd.Series:
    """Text of a file, unpacked if it begins as gzip does, whatever its name; null if it is broken or holds more than LARGEST bytes."""

    def one(data: bytes) -> str | None:
        out = []
        size = 0
        while data[:2] == b"\x1f\x8b":  # members may follow each other
            unpack = zlib.decompressobj(31)
            try:
                out.append(unpack.decompress(data, LARGEST + 1 - size))
            except zlib.error:
                return None
            size += len(out[-1])
            if size > LARGEST or not unpack.eof:
                return None
            data = unpack.unused_data
        return (b"".join(out) if out else data).decode("utf-8", "replace")

    return contents.map(lambda x: None if x is None else one(bytes(x)))


def landed_stream(spark: SparkSession, path: str, tenant: str, feed: str, vendor: str) -> DataFrame:
    """New files of a folder as envelopes, compressed or not; the checkpoint remembers what was read."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select(
        F.lit(tenant).alias("tenant_id"), F.lit(feed).alias("feed_id"), F.lit(vendor).alias("vendor"), F.lit("").alias("batch_id"),
        F.unix_seconds(F.current_timestamp()).alias("received_at"), plain_text("content").alias("payload"),
    )


def landed_batch(spark: SparkSession, path: str, after: str = "") -> DataFrame:
    """Files of a folder whose name sorts after a watermark, without empty ones: file, payload."""
    files = spark.read.format("binaryFile").load(path).where(F.element_at(F.split("path", "/"), -1) > after)
    return files.select(F.col("path").alias("file"), plain_text("content").alias("payload")).where("payload IS NULL OR trim(payload) <> ''")


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Envelopes from a topic; needs Spark's Kafka package on the cluster."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return rows.select(F.from_json(F.col("value").cast("string"), ENVELOPE).alias("e")).select("e.*")


def slices(since: int | None, now: int) -> list[tuple[int, int]]:
    """Whole slices from where the last poll ended up to LAG seconds before now."""
    start = now - FIRST if since is None else since
    out = []
    while start + SLICE <= now - LAG:
        out.append((start, start + SLICE))
        start += SLICE
    return out


def pages(fetch: Callable[[str], tuple[list[str], str]], cursor: str = "") -> Iterator[tuple[list[str], str]]:
    """Pages behind a cursor, until one is empty or the cursor stays where it is."""
    for _ in range(MAX_PAGES):
        rows, after = fetch(cursor)
        if rows:
            yield rows, after
        if not rows or after == cursor:
            return
        cursor = after


class PageReader(SimpleDataSourceStreamReader):
    """Reads the pages behind a cursor; the stream's offset is the cursor, so a poll goes on where the last one ended."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": self.options.get("cursor", "")}

    def _read(self, cursor: str, until: str | None) -> tuple[Iterator[tuple], dict]:
        import importlib

        module, _, name = self.options["fetch"].partition(":")
        rows = []
        for page, after in pages(getattr(importlib.import_module(module), name), cursor):
            rows += [(self.options.get("tenant", ""), self.options.get("feed", ""), self.options.get("vendor", ""), after, int(self.options.get("now") or 0), x if isinstance(x, str) else json.dumps(x)) for x in page]
            cursor = after
            if after == until:
                break
        return iter(rows), {"cursor": cursor}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return self._read(start["cursor"], None)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return self._read(start["cursor"], end["cursor"])[0]

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    """A paged export behind a cursor, as a streaming source: format `log_pages`. A poll reads MAX_PAGES pages at most."""

    @classmethod
    def name(cls) -> str:
        return "log_pages"

    def schema(self) -> str:
        return ENVELOPE

    def simpleStreamReader(self, schema) -> PageReader:  # noqa: N802
        return PageReader(self.options)


class _Slice(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class SliceReader(DataSourceStreamReader):
    """Reads one time slice in each task; `fetch` in the options names a function as module:name."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": int(self.options["start"])}

    def latestOffset(self) -> dict:  # noqa: N802
        import time

        start, now = int(self.options["start"]), int(self.options.get("now") or time.time())
        done = slices(start, now)
        return {"at": done[-1][1] if done else start}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Slice(a, min(a + SLICE, end["at"])) for a in range(start["at"], end["at"], SLICE)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        import importlib

        module, _, name = self.options["fetch"].partition(":")
        for row in getattr(importlib.import_module(module), name)(partition.start, partition.end):
            yield (self.options.get("tenant", ""), self.options.get("feed", ""), self.options.get("vendor", ""), "", partition.end, row if isinstance(row, str) else json.dumps(row))

    def commit(self, end: dict) -> None:
        pass


class SliceSource(DataSource):
    """A log export that is asked for time slices, as a streaming source: format `log_slices`."""

    @classmethod
    def name(cls) -> str:
        return "log_slices"

    def schema(self) -> str:
        return ENVELOPE

    def streamReader(self, schema) -> SliceReader:  # noqa: N802
        return SliceReader(self.options)
