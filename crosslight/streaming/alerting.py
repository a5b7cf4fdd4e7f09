"""Alert rules in keyed state: every 30 seconds by a timer, whether or not a record comes.

A batch's records become moves: what enters a rule's window at one tick and leaves it at another, added
up by rule, group and ticks before they are filed. A first state (`Panes`) adds up the moves that are due
at a tick, so a window of a day costs no more than one of a minute. Addresses are spread over SALTS keys,
each of which counts its own; all other counts are sums already when they come. A second state (`Rests`)
adds the spread counts up, compares, and keeps the time until which a rule and group rest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.alerts import EVIDENCE, GROUPS, Condition
from ..operators.components import cut
from ..operators.filters import RECORD_FILTERS, passes
from ..operators.latest import latest
from .filed import filed

#: Seconds between ticks, and keys over which the addresses of a group are spread.
STEP, SALTS = 30, 64
#: enter and leave: the ticks at which the hits and the records of all kinds begin and cease to count.
MOVE = "batch long, clock long, rule_id string, tenant_id string, group string, salt int, enter long, leave long, ip string, hits long, every long"
VALUE = "rule_id string, tenant_id string, group string, salt int, tick long, hits long, every long"
ALERT = "rule_id string, tenant_id string, group string, fired_at long, value double, until long"
#: Rules by id, each with the tenant whose records it measures.
Rules = dict[str, tuple[str, Condition]]


def matches(records: DataFrame, rules: Rules) -> DataFrame:
    """A row for each record and rule that it counts for: m (rule_id, group, width, ip, hit). All rules take one pass."""
    found = []
    for rule_id, (tenant, rule) in rules.items():
        hit = F.coalesce(passes(rule.filters, RECORD_FILTERS), F.lit(False))
        counts = (F.col("tenant_id") == tenant) & (F.lit(True) if rule.aggregate == "rate" else hit)
        ip = F.col("client_ip") if rule.aggregate == "distinct_ips" else F.lit(None).cast("string")
        if rule.aggregate == "distinct_ips":
            counts &= ip.isNotNull()
        group = F.to_json(F.array(*(F.col(GROUPS[g]).cast("string") for g in rule.group_by))) if rule.group_by else F.lit("[]")
        found.append(F.when(counts, F.struct(F.lit(rule_id).alias("rule_id"), group.alias("group"), F.lit(rule.window).alias("width"), ip.alias("ip"), hit.cast("int").alias("hit"))))
    return records.withColumn("m", F.explode(F.array_compact(F.array(*found))))


def moves(changes: DataFrame, rules: Rules, step: int = STEP) -> DataFrame:
    """Moves of records that come (sign 1) or whose version is replaced (sign -1), added up by rule, group and ticks."""
    after = lambda t: ((F.floor(t / step) + 1) * step).cast("long")
    met = matches(changes, rules).select("tenant_id", "m.*", "sign", "window_start")
    salt = F.when(F.col("ip").isNull(), 0).otherwise(F.pmod(F.xxhash64("ip"), F.lit(SALTS))).cast("int")
    keyed = met.select("rule_id", "tenant_id", "group", salt.alias("salt"), after(F.col("window_start")).alias("enter"), after(F.col("window_start") + F.col("width")).alias("leave"), "ip", "sign", "hit")
    out = keyed.groupBy("rule_id", "tenant_id", "group", "salt", "enter", "leave", "ip").agg(F.sum(F.col("sign") * F.col("hit")).alias("hits"), F.sum("sign").alias("every"))
    return out.where("hits <> 0 OR every <> 0")


def file_moves(changes: DataFrame, rules: Rules, root: str, number: int, step: int = STEP) -> None:
    """Files a batch's moves under its number; those of one key lie in one file, so a state gets a batch as a whole."""
    out = moves(changes, rules, step).withColumn("clock", F.lit(None).cast("long")).repartition("rule_id", "tenant_id", "group", "salt")
    out.write.mode("overwrite").parquet(f"{root}/moves/batch={number}")


def bells(spark: SparkSession, rules: Rules, clock: int | None = None) -> DataFrame:
    """Moves of nothing: one that sets a replay's clock, and one for every rule without groups, so that one on silence has a state before any record."""
    rows = [(clock, "", "", "", 0, 0, 0, None, 0, 0)]
    rows += [(clock, rule_id, tenant, "[]", 0, 0, 0, None, 0, 0) for rule_id, (tenant, rule) in rules.items() if not rule.group_by]
    return spark.createDataFrame(rows, MOVE.split(", ", 1)[1])


class Panes(StatefulProcessor):
    """What counts now for a rule, group and salt, and what enters and leaves at the ticks to come."""

    def __init__(self, step: int, replay: bool):
        self.step, self.replay = step, replay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The last batch seen, the counts, and how many ticks are to come; a key without any is forgotten.
        self.now = handle.getValueState("now", "batch long, hits long, every long, open int")
        self.due = handle.getMapState("due", "tick long", "hits long, every long, ips string")
        self.ips = handle.getMapState("ips", "ip string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at = (timerValues.getCurrentWatermarkInMs() if self.replay else timerValues.getCurrentProcessingTimeInMs()) // 1000
        soon = (at // self.step + 1) * self.step
        seen, hits, every, open_ = self.now.get() if self.now.exists() else (-2, 0, 0, 0)
        last, new = seen, {}
        for r in rows:
            if r.batch <= seen:  # a batch that was run again
                continue
            last = max(last, r.batch)
            enter, leave = max(r.enter, soon), max(r.leave, soon)
            if enter == leave and (r.hits or r.every):  # it has left already
                continue
            for tick, sign in ((enter, 1), (leave, -1)) if r.hits or r.every else ((soon, 1),):
                sums = new.setdefault(tick, [0, 0, {}])
                sums[0] += sign * r.hits
                sums[1] += sign * r.every
                if r.ip is not None:
                    sums[2][r.ip] = sums[2].get(r.ip, 0) + sign * r.hits
        for tick, (h, e, ips) in new.items():
            if self.due.containsKey((tick,)):
                h0, e0, known = self.due.getValue((tick,))
                for ip, n in json.loads(known).items():
                    ips[ip] = ips.get(ip, 0) + n
                h, e = h + h0, e + e0
            else:
                open_ += 1
                self.handle.registerTimer(1000 * tick)
            self.due.updateValue((tick,), (h, e, json.dumps(ips)))
        if open_:
            self.now.update((last, hits, every, open_))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        tick = expiredTimerInfo.getExpiryTimeInMs() // 1000
        if not self.due.containsKey((tick,)):
            return
        h, e, ips = self.due.getValue((tick,))
        self.due.removeKey((tick,))
        seen, hits, every, open_ = self.now.get()
        ips = json.loads(ips)
        if ips:
            h = 0
            for ip, d in ips.items():
                n = self.ips.getValue((ip,))[0] if self.ips.containsKey((ip,)) else 0
                h += (n + d > 0) - (n > 0)
                if n + d:
                    self.ips.updateValue((ip,), (n + d,))
                elif n:
                    self.ips.removeKey((ip,))
        hits, every = hits + h, every + e
        if open_ > 1:
            self.now.update((seen, hits, every, open_ - 1))
        else:
            self.now.clear()
        yield Row(rule_id=key[0], tenant_id=key[1], group=key[2], salt=key[3], tick=tick, hits=hits, every=every)

    def close(self) -> None:
        pass


class Rests(StatefulProcessor):
    """The value of a rule and group, and until when it rests after it fired."""

    def __init__(self, rules: Rules, step: int, timed: bool):
        self.rules, self.step, self.timed = rules, step, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "hits long, every long, until long")
        self.parts = handle.getMapState("parts", "salt int", "hits long, every long")

    def _value(self, rule: Condition, hits: int, every: int) -> float:
        return hits / every if rule.aggregate == "rate" and every else float(hits)

    def _fires(self, rule: Condition, hits: int, every: int) -> bool:
        if rule.group_by and not hits:  # a group without hits is not measured
            return False
        value, limit = self._value(rule, hits, every), rule.threshold
        return {"gt": value > limit, "gte": value >= limit, "lt": value < limit, "lte": value <= limit}[rule.comparator]

    def _alert(self, key, rule: Condition, tick: int, hits: int, every: int) -> Row:
        return Row(rule_id=key[0], tenant_id=key[1], group=key[2], fired_at=tick, value=self._value(rule, hits, every), until=tick + rule.cooldown)

    def _rested(self, until: int) -> int:
        return -(-until // self.step) * self.step

    def _keep(self, hits: int, every: int, until: int, tick: int, rule: Condition) -> None:
        if rule.group_by and not hits and not every and until <= tick:
            self.now.clear()
            self.parts.clear()
            return
        self.now.update((hits, every, until))
        if self.timed and until > tick:
            self.handle.registerTimer(1000 * self._rested(until))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rule = self.rules.get(key[0], (None, None))[1]
        if rule is None:  # taken away meanwhile
            return
        hits, every, until = self.now.get() if self.now.exists() else (0, 0, 0)
        ticks: dict[int, list] = {}
        for r in rows:
            ticks.setdefault(r.tick, []).append(r)
        for tick in sorted(ticks):
            # Between two ticks at which something moves it may have rested and fire again.
            while until and self._rested(until) < tick and self._fires(rule, hits, every):
                alert = self._alert(key, rule, self._rested(until), hits, every)
                until = alert.until
                yield alert
            for r in ticks[tick]:
                h, e = self.parts.getValue((r.salt,)) if self.parts.containsKey((r.salt,)) else (0, 0)
                hits, every = hits + r.hits - h, every + r.every - e
                if r.hits or r.every:
                    self.parts.updateValue((r.salt,), (r.hits, r.every))
                elif h or e:
                    self.parts.removeKey((r.salt,))
            if tick >= until and self._fires(rule, hits, every):
                alert = self._alert(key, rule, tick, hits, every)
                until = alert.until
                yield alert
        if ticks:
            self._keep(hits, every, until, max(ticks), rule)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        tick = expiredTimerInfo.getExpiryTimeInMs() // 1000
        rule = self.rules.get(key[0], (None, None))[1]
        if rule is None or not self.now.exists():
            return
        hits, every, until = self.now.get()
        if until <= tick and self._fires(rule, hits, every):
            alert = self._alert(key, rule, tick, hits, every)
            until = alert.until
            yield alert
        self._keep(hits, every, until, tick, rule)

    def close(self) -> None:
        pass


def firing(found: DataFrame, rules: Rules, step: int = STEP, replay: bool = False) -> DataFrame:
    """Alerts of a stream of moves (see ALERT). The clock is the wall's; in a replay it is the moves' own."""
    if replay:
        found = found.withColumn("at", F.timestamp_seconds("clock")).withWatermark("at", "0 seconds")
    values = found.groupBy("rule_id", "tenant_id", "group", "salt").transformWithState(
        Panes(step, replay), outputStructType=VALUE, outputMode="Append", timeMode="EventTime" if replay else "ProcessingTime"
    )
    return values.groupBy("rule_id", "tenant_id", "group").transformWithState(
        Rests(rules, step, not replay), outputStructType=ALERT, outputMode="Append", timeMode="None" if replay else "ProcessingTime"
    )


def with_evidence(alerts: DataFrame, root: str, rules: Rules) -> DataFrame:
    """Alerts with the EVIDENCE smallest ids of the records that they rest on, of which only the days in question are read."""
    low, high = alerts.agg(F.min("fired_at"), F.max("fired_at")).first()
    stored = None if low is None else filed(alerts.sparkSession, f"{root}/records", None, low - max(rule.window for _, rule in rules.values()), high)
    if stored is None:
        return alerts.withColumn("evidence", F.array().cast("array<string>"))
    hits = matches(latest(stored.drop("date", "batch"), ["tenant_id", "correlation_id"], "version"), rules).where("m.hit = 1")
    hits = hits.select("tenant_id", "m.rule_id", "m.group", "m.width", "window_start", "correlation_id")
    key = ["rule_id", "tenant_id", "group"]
    near = alerts.select(*key, "fired_at").join(hits, key).where("window_start >= fired_at - width AND window_start < fired_at")
    few = near.withColumn("n", F.row_number().over(Window.partitionBy(*key, "fired_at").orderBy("correlation_id"))).where(F.col("n") <= EVIDENCE)
    return alerts.join(few.groupBy(*key, "fired_at").agg(F.array_sort(F.collect_list("correlation_id")).alias("evidence")), [*key, "fired_at"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def file_alerts(root: str, rules: Rules):
    """For foreachBatch over `firing`: files a batch's alerts with their evidence; a repeated batch replaces what it filed."""

    def run(batch: DataFrame, number: int) -> None:
        batch = cut(batch)
        if number == 0 or batch.limit(1).count():
            with_evidence(batch, root, rules).write.mode("overwrite").parquet(f"{root}/alerts/batch={number}")

    return run


def alert_stream(spark: SparkSession, root: str, rules: Rules, checkpoint: str, step: int = STEP, replay: bool = False, every: str = "5 seconds") -> StreamingQuery:
    """Continuous alerts from the moves under `root`, which the correlation files when it is given the same rules."""
    cut(spark.range(1))  # foreachBatch cuts its lineage in the checkpoint folder
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if not replay:
        bells(spark, rules).write.mode("overwrite").parquet(f"{root}/moves/batch=-1")
    found = spark.readStream.schema(MOVE).option("maxFilesPerTrigger", 1 if replay else 1_000).parquet(f"{root}/moves")
    writer = firing(found, rules, step, replay).writeStream.foreachBatch(file_alerts(root, rules)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if replay else writer.trigger(processingTime=every)).start()


def replayed_alerts(records: DataFrame, rules: Rules, folder: str, parts: int = 3, step: int = STEP) -> DataFrame:
    """The alerts that rules would have raised over past records, sent through the same states in the order of their time."""
    spark = records.sparkSession
    edges = [int(e) for e in records.approxQuantile("window_start", [k / parts for k in range(1, parts + 1)], 0.001)]
    if not edges:
        return spark.createDataFrame([], ALERT)
    edges[-1] = records.agg(F.max("window_start")).first()[0]
    last = edges[-1] + 2 * max(rule.window for _, rule in rules.values()) + 2 * step
    for number, (low, high) in enumerate(zip([None, *edges], [*edges, last])):
        part = records.where((F.lit(True) if low is None else F.col("window_start") > low) & (F.col("window_start") <= high)).withColumn("sign", F.lit(1))
        found = moves(part, rules, step).withColumn("clock", F.lit(high).cast("long"))
        found.unionByName(bells(spark, {}, high)).coalesce(1).write.parquet(f"{folder}/moves/batch={number}")
    alert_stream(spark, folder, rules, f"{folder}/state", step, replay=True).awaitTermination()
    return fired(spark, folder).select("rule_id", "tenant_id", "group", "fired_at", "value", "until")


def fired(spark: SparkSession, root: str) -> DataFrame:
    """All alerts filed so far."""
    # An empty first batch makes the table exist.
    return spark.read.schema(ALERT + ", evidence array<string>").parquet(f"{root}/alerts").drop("batch")


__all__ = ["alert_stream", "file_moves", "fired", "firing", "moves", "replayed_alerts"]
