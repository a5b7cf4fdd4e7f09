"""Continuous forms: redelivery suppression, correlation with amendments, rollups, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import correlate, pointers, rollups
from ..operators.alerts import Condition, measure, with_cooldown
from ..operators.components import cut
from ..operators.health import DRIFT
from ..operators.latest import latest
from .alerting import Rules, file_moves
from .filed import file_rows, filed
from .windows import GRACE, LATE, closing

#: Time within which a redelivery is dropped, and by which an event may be late.
REDELIVERY, LATENESS = "10 minutes", "15 minutes"
#: Seconds for which a request id is known, before and after an event that carries it.
TTL = 86_400
#: The state store that keyed state with timers needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.timestamp_seconds("event_time"))


def deduplicated(events: DataFrame) -> DataFrame:
    """Events without redeliveries; the state of an id is dropped once the watermark passes it."""
    return timed(events).withWatermark("ts", REDELIVERY).dropDuplicatesWithinWatermark(["tenant_id", "event_id"])


def volume_rollup(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Sketches of distinct events for each window and vendor, which redeliveries don't change."""
    rows = timed(events).withWatermark("ts", LATENESS)
    states = rows.groupBy("tenant_id", F.window("ts", width).alias("w"), "vendor").agg(F.hll_sketch_agg("event_id", F.lit(12)).alias("state"), F.count("*").alias("deliveries"))
    return states.select("tenant_id", F.unix_seconds("w.start").alias("bucket"), "vendor", "state", "deliveries")


def health_minutes(events: DataFrame) -> DataFrame:
    """Events, largest delay and drifted events of each feed and minute."""
    rows = timed(events).withWatermark("ts", LATENESS)
    out = rows.groupBy("tenant_id", "feed_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("accepted"), F.max(F.col("received_at") - F.col("event_time")).alias("lag"))
    return out.select("tenant_id", "feed_id", F.unix_seconds("w.start").alias("minute"), "accepted", "lag")


def over_quota(events: DataFrame, span: str, limit: int, size: str = "bytes") -> DataFrame:
    """A stream's seconds or days (`span`) in which a tenant is over its quota of events or bytes, as `health.quota` has them; for update mode.

    Counters are added up before they are shuffled and live until the watermark passes them. Nothing waits for
    them: what comes while they are lost is taken.
    """
    rows = events.withColumn("ts", F.timestamp_seconds("received_at")).withWatermark("ts", LATENESS)
    used = F.count("*") if span == "second" else F.sum(size)
    counted = rows.groupBy("tenant_id", F.window("ts", f"1 {span}").alias("w")).agg(used.alias("used")).where(F.col("used") > limit)
    return counted.select("tenant_id", F.lit(span).alias("span"), F.unix_seconds("w.start").alias("at"), "used")


def quota_batch(root: str):
    """For foreachBatch over `over_quota`: files what is over in a batch; see `overruns`."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return run


def overruns(spark: SparkSession, root: str) -> DataFrame:
    """The last count of each second or day that went over a quota: counts only grow."""
    return spark.read.parquet(root).groupBy("tenant_id", "span", "at").agg(F.max("used").alias("used"))


def drifting(events: DataFrame, unknown: str = "unknown_fields", width: str = "10 minutes", most: int = 50) -> DataFrame:
    """A stream's windows of a feed in which over one event of a hundred has fields that the schema doesn't know; for update mode.

    Of the fields the `most` frequent are named; what is held of them is a sketch of bounded size.
    """
    rows = timed(events).withWatermark("ts", LATENESS).select("tenant_id", "feed_id", "ts", F.posexplode_outer(unknown).alias("k", "field"))
    found = rows.groupBy("tenant_id", "feed_id", F.window("ts", width).alias("w")).agg(
        F.count(F.when(F.coalesce("k", F.lit(0)) == 0, 1)).alias("events"), F.count(F.when(F.col("k") == 0, 1)).alias("drifted"), F.expr(f"approx_top_k(field, {most}, {20 * most})").alias("top")
    )
    fields = F.array_sort(F.filter(F.transform("top", lambda x: x["item"]), lambda x: x.isNotNull()))
    return found.where(F.col("drifted") > DRIFT * F.col("events")).select("tenant_id", "feed_id", F.unix_seconds("w.start").alias("window_start"), "events", "drifted", fields.alias("fields"))


def warn_batch(path: str):
    """For foreachBatch over `drifting`: files a window's warning once, in the batch that first shows it. Of earlier ones only the days in question are read."""

    def run(batch: DataFrame, number: int) -> None:
        batch = cut(batch)
        low, high = batch.agg(F.min("window_start"), F.max("window_start")).first()
        warned = None if low is None else filed(batch.sparkSession, path, number, low, high)
        key = ["tenant_id", "feed_id", "window_start"]
        new = batch if warned is None else batch.join(warned.select(*key), key, "left_anti")
        file_rows(new, path, "window_start", number, key)

    return run


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as fault:
        if "PATH_NOT_FOUND" in str(fault) or "UNABLE_TO_INFER_SCHEMA" in str(fault):
            return None
        raise


def before(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """What batches before `number` have written to a table; a repeated batch doesn't see its own traces."""
    found = _table(spark, path)
    return None if found is None else found.where(F.col("batch") < number).drop("batch", "date")


def settle_batch(root: str, schema: StructType, window: int = correlate.WINDOW, ttl: int = TTL, buckets: int | None = pointers.BUCKETS, rules: Rules | None = None):
    """For foreachBatch over `closing`: files a batch's events, and emits the records of the groups that it closes.

    `schema` is that of the stream's events. They are filed by day, and once more, narrowly, under each
    request id they carry. Records are built from the closed groups and, over ids, whatever stands for
    the same requests within `ttl` seconds; no other stored event is read. An identifier that was claimed
    first keeps its record: what comes later is the record's next version, and a group to which nothing
    was added gives none. With `buckets` the look-ups' pointers to events and records are written along,
    with `rules` what the records of the batch and those they replace mean to alerts (see `alerting`).
    All that a batch writes is under its number and replaces what the batch wrote before, if it is run again.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch = cut(batch)
        late = batch.where("kind = 'late'").groupBy("tenant_id").agg(F.count("*").alias("dropped"))
        late.write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        fresh = batch.where("kind = 'event'").select(F.from_json("row", schema).alias("e")).select("e.*")
        file_rows(fresh, f"{root}/events", "event_time", number, ["tenant_id", "event_id"])
        ids = fresh.select("tenant_id", "event_id", "vendor", "vendor_request_id", "linked_request_id", "event_time").withColumn("node", F.explode(_nodes())).where("node IS NOT NULL")
        file_rows(ids, f"{root}/ids", "event_time", number, ["node", "event_id"])
        closed = cut(batch.where("kind = 'closed'").select("tenant_id", "shape", "window_no", "event_id", "event_time").distinct())
        low, high = closed.agg(F.min("event_time"), F.max("event_time")).first()
        fresh_pointers = pointers.event_pointers(fresh)
        if low is not None:
            emitted = _emit(batch.sparkSession, root, number, closed, low, high, window, ttl, rules)
            fresh_pointers = fresh_pointers.unionByName(pointers.record_pointers(emitted))
        if buckets:
            pointers.write_pointers(fresh_pointers, f"{root}/pointers", number, buckets)

    return run


def _nodes() -> F.Column:
    return F.array_distinct(F.array(*(correlate.request_key(c) for c in ("vendor_request_id", "linked_request_id"))))


def walked(ids: DataFrame, seeds: DataFrame) -> DataFrame:
    """What is filed under some ids (node) and, over events with two of them, under all that they lead to.

    Each round looks up the ids that the last one has found; rounds end with the longest chain of events.
    """
    frontier, seen, out = cut(seeds.select("node").distinct()), None, None
    while frontier.limit(1).count():
        hits = cut(ids.join(frontier, "node", "left_semi"))
        out = hits if out is None else out.unionByName(hits)
        seen = frontier if seen is None else cut(seen.union(frontier))
        frontier = cut(hits.select(F.explode(_nodes()).alias("node")).where("node IS NOT NULL").distinct().join(seen, "node", "left_anti"))
    return out if out is not None else ids.limit(0)


EVENT = ["tenant_id", "event_id"]
RECORD = ["tenant_id", "correlation_id"]


def _emit(spark: SparkSession, root: str, number: int, closed: DataFrame, low: int, high: int, window: int, ttl: int, rules: Rules | None) -> DataFrame:
    near = filed(spark, f"{root}/events", number + 1, low, high).where(F.col("event_time").between(low, high))
    due = cut(near.join(closed.select(*EVENT, "shape", "window_no"), EVENT))
    own = due.select(F.explode(_nodes()).alias("node")).where("node IS NOT NULL")
    ids = filed(spark, f"{root}/ids", number + 1, low - ttl, high + ttl)
    tied = cut(walked(ids, own).drop("node", "date", "batch").distinct()) if ids is not None else None
    rows = due.drop("date", "batch")
    exact = None
    if tied is not None and tied.limit(1).count():
        exact = cut(correlate.exact_groups(tied))
        first, last = tied.agg(F.min("event_time"), F.max("event_time")).first()
        known = filed(spark, f"{root}/events", number + 1, first, last).where(F.col("event_time").between(first, last)).drop("date", "batch")
        partners = known.join(exact, EVENT).withColumn("group_key", F.col("exact_key")).withColumn("join_tier", F.lit(1)).drop("exact_key")
        rows = rows.join(exact.select(*EVENT), EVENT, "left_anti")
    # What has gone to the exact tier holds no window open: the windows that are left pair up anew, as they do in the batch.
    rows = rows.drop("window_no").withColumn("w", F.floor(F.col("event_time") / window).cast("long"))
    rows = rows.join(correlate.paired_windows(rows.select("shape", "w").distinct()), ["shape", "w"]).drop("w")
    solo = F.col("shape").startswith("solo|")
    rows = rows.withColumn("group_key", F.when(solo, F.col("shape")).otherwise(F.concat_ws("|", "shape", F.col("window_no").cast("string")))).withColumn("join_tier", F.when(solo, 0).otherwise(2)).drop("shape", "window_no")
    if exact is not None:
        rows = rows.unionByName(partners)
    fresh = cut(correlate.records_of(latest(rows, EVENT), window))

    # The days on which what may be amended can lie.
    first, last = fresh.agg(F.min("first_event_time"), F.max("last_event_time")).first()
    claims = filed(spark, f"{root}/claims", number, first - ttl, last + ttl)
    if claims is not None:
        fresh = cut(correlate.claimed_ids(fresh, claims))
    stored = filed(spark, f"{root}/records", number, first - ttl, last + ttl)
    if stored is not None:
        touched = stored.join(fresh.select(*RECORD).distinct(), RECORD, "left_semi").drop("date", "batch")
        old = cut(latest(touched, RECORD, "version"))
        fresh = fresh.join(old.select(*RECORD, F.col("event_ids").alias("_had")), RECORD, "left")
        fresh = cut(fresh.where(F.col("_had").isNull() | (F.size(F.array_except("event_ids", "_had")) > 0)).drop("_had"))
        merged = correlate.merge_amended(old, fresh)
        rest = [c for c in fresh.columns if c not in merged.columns]
        fresh = cut(merged.join(fresh.select(*RECORD, *rest), RECORD))
    if rules:
        changes = fresh.withColumn("sign", F.lit(1))
        if stored is not None:
            replaced = old.join(fresh.select(*RECORD), RECORD, "left_semi").withColumn("sign", F.lit(-1))
            changes = changes.unionByName(replaced, allowMissingColumns=True)
        file_moves(changes, rules, root, number)
    file_rows(fresh, f"{root}/records", "window_start", number, ["tenant_id", "window_start"])
    claimed = fresh.select("tenant_id", F.explode("event_ids").alias("identifier"), "correlation_id", F.lit(number).cast("long").alias("claimed_at"), "first_event_time")
    file_rows(claimed, f"{root}/claims", "first_event_time", number, ["identifier", "tenant_id"])
    return fresh


def rollup_batch(root: str, names: tuple[str, ...] = ("volume", "verdicts", "rules", "sources")):
    """For foreachBatch: files the states of a batch's rows under each rollup, by day. Only the batch is read."""

    def run(batch: DataFrame, number: int) -> None:
        batch = cut(batch)
        for name in names:
            file_rows(rollups.states(batch, name), f"{root}/rollups/{name}", "bucket", number, ["tenant_id", "bucket"])

    return run


def rolled_up(spark: SparkSession, root: str, name: str, low: int | None = None, high: int | None = None) -> DataFrame | None:
    """The states of a rollup over the days from `low` to `high`, one for each key; None where there are none."""
    found = filed(spark, f"{root}/rollups/{name}", None, low, high)
    return None if found is None else rollups.united(found, ["tenant_id", "bucket", *rollups.ROLLUPS[name].dimensions])


def late_dropped(spark: SparkSession, root: str) -> DataFrame:
    """Events of each tenant that came too late: tenant_id, dropped."""
    return spark.read.parquet(f"{root}/late").groupBy("tenant_id").agg(F.sum("dropped").alias("dropped"))


def alert_batch(root: str, rules: dict[str, Condition]):
    """For foreachBatch over records: measures every rule at the batch's end and appends what fires and isn't cooling down."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        end = batch.agg(F.max("window_start")).first()[0]
        if end is None or not rules:
            return
        end += correlate.WINDOW
        # One bounded read serves all rules: the days of the widest window.
        begin = end - max(rule.window for rule in rules.values())
        recent = spark.read.parquet(f"{root}/records").where(F.col("date") >= F.to_date(F.timestamp_seconds(F.lit(begin))))
        stored = cut(latest(recent.where(F.col("window_start") >= begin).drop("date", "batch"), ["tenant_id", "correlation_id"], "version"))
        fired = before(spark, f"{root}/alerts", number)
        fired = fired if fired is not None else spark.createDataFrame([], "key string, until long")
        out = None
        for name, rule in rules.items():
            new = with_cooldown(measure(stored, rule, end), fired, name, rule.group_by, end)
            new = new.select("key", F.lit(name).alias("rule_id"), "value", "evidence", F.lit(end).cast("long").alias("fired_at"), F.lit(end + rule.cooldown).cast("long").alias("until"))
            out = new if out is None else out.unionByName(new)
        out.write.mode("overwrite").parquet(f"{root}/alerts/batch={number}")

    return run


def start(events: DataFrame, root: str, checkpoint: str, batch, once: bool = True, mode: str = "append") -> StreamingQuery:
    """Runs a foreachBatch function over a stream; `once` works off what is there and ends."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    writer = events.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def correlate_stream(events: DataFrame, root: str, checkpoint: str, window: int = correlate.WINDOW, grace: int = GRACE, lateness: int = LATE, ttl: int = TTL, replay: bool = False, every: str = "10 seconds", buckets: int | None = pointers.BUCKETS, rules: Rules | None = None) -> StreamingQuery:
    """Continuous correlation of a stream of events into `root`/records.

    A window closes `grace` seconds after its end by the clock, whether or not anything comes. With
    `replay` the clock is the stream's received_at, and the query ends with the stream.
    """
    spark = events.sparkSession
    cut(spark.range(1))  # foreachBatch cuts its lineage in the checkpoint folder
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    found = closing(events, window, grace, lateness, replay)
    writer = found.writeStream.foreachBatch(settle_batch(root, events.schema, window, ttl, buckets, rules)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if replay else writer.trigger(processingTime=every)).start()


def replayed(events: DataFrame, folder: str, parts: int = 3, window: int = correlate.WINDOW, grace: int = GRACE, lateness: int = LATE) -> DataFrame:
    """All record versions of past events, sent through `correlate_stream` in the order in which they were received.

    The events are written to `folder` in `parts` slices of their receipt times. At last comes one event long
    after all others, which moves the clock past every window; it stands in no record.
    """
    spark = events.sparkSession
    edges = events.approxQuantile("received_at", [k / parts for k in range(1, parts)], 0.001)
    low, high = [None, *edges], [*edges, None]
    for a, b in zip(low, high):
        part = events.where((F.lit(True) if a is None else F.col("received_at") > a) & (F.lit(True) if b is None else F.col("received_at") <= b))
        # A slice is one file, made of many tasks' rows and, by small row groups, read by many.
        part.repartition(1).write.mode("append").option("parquet.block.size", 4 << 20).parquet(f"{folder}/in")
    end = 10 * (grace + lateness + window)
    last = events.orderBy(F.desc("received_at")).limit(1).withColumn("received_at", F.col("received_at") + end).withColumn("event_time", F.col("received_at"))
    last.withColumn("event_id", F.lit("")).withColumn("vendor_request_id", F.lit("")).withColumn("linked_request_id", F.lit("")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    correlate_stream(stream, f"{folder}/out", f"{folder}/state", window, grace, lateness, replay=True, buckets=None).awaitTermination()
    return spark.read.parquet(f"{folder}/out/records")


__all__ = ["alert_batch", "closing", "correlate_stream", "deduplicated", "drifting", "health_minutes", "late_dropped", "over_quota", "overruns", "quota_batch", "replayed", "rolled_up", "rollup_batch", "settle_batch", "start", "volume_rollup", "warn_batch"]
