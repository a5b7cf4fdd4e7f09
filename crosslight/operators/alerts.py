"""Alert rules: conditions, measures, comparison, cooldown, transitions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cooldown_key
from .filters import RECORD_FILTERS, filtered
from .latest import append_version, latest

# Columns that alerts may group by, comparators, bounds of windows and cooldowns in seconds, evidence.
GROUPS = {
    "request_host": "request_host",
    "client_ip": "client_ip",
    "country": "client_country",
    "disagreement_kind": "disagreement_kind",
    "combined_outcome": "combined_outcome",
    "confidence": "confidence",
}
AGGREGATES, COMPARATORS = ("count", "distinct_ips", "rate"), ("gt", "gte", "lt", "lte")
WINDOWS, COOLDOWNS, EVIDENCE, MAX_GROUPS = (30, 86_400), (60, 7 * 86_400), 20, 3
#: Deliveries of an alert that are tried.
ATTEMPTS = 5


@dataclass(frozen=True)
class Condition:
    """What a rule measures and when it fires."""

    aggregate: str
    comparator: str
    threshold: float
    window: int
    cooldown: int
    filters: dict = field(default_factory=dict)
    group_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.aggregate not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.aggregate}")
        if self.comparator not in COMPARATORS:
            raise ValueError(f"unknown comparator {self.comparator}")
        if not WINDOWS[0] <= self.window <= WINDOWS[1]:
            raise ValueError("the window is out of bounds")
        if not max(COOLDOWNS[0], self.window) <= self.cooldown <= COOLDOWNS[1]:
            raise ValueError("the cooldown is out of bounds or shorter than the window")
        if len(self.group_by) > MAX_GROUPS or len(set(self.group_by)) < len(self.group_by) or any(g not in GROUPS for g in self.group_by):
            raise ValueError("the groups are too many, repeated or unknown")
        for name in self.filters:
            if name not in RECORD_FILTERS and name != "only_disagreements":
                raise ValueError(f"unknown filter {name}")

    @classmethod
    def parse(cls, text: str) -> Condition:
        """From JSON; unknown fields are an error."""
        data = json.loads(text)
        if not isinstance(data, dict) or (odd := set(data) - set(cls.__dataclass_fields__)):
            raise ValueError(f"not a condition: {sorted(odd) if isinstance(data, dict) else data}")
        return cls(**data | {"group_by": tuple(data.get("group_by", ()))})


def compare(value: Column, comparator: str, threshold: float) -> Column:
    """Whether a value passes the threshold; an unknown comparator never fires."""
    return {"gt": value > threshold, "gte": value >= threshold, "lt": value < threshold, "lte": value <= threshold}.get(comparator, F.lit(False))


def measure(records: DataFrame, condition: Condition, end: int, rate_compat: bool = False) -> DataFrame:
    """Value and evidence of each group in the window that ends at `end`: the groups, value, evidence, fires.

    A rate is the share of the window's records that pass the filters, by group; `rate_compat` counts
    among those that pass only, which is always 1. Evidence is the EVIDENCE smallest record ids.
    """
    recent = records.where((F.col("window_start") >= end - condition.window) & (F.col("window_start") < end))
    keys = [F.col(GROUPS[g]).alias(g) for g in condition.group_by]
    hits = filtered(recent, condition.filters, RECORD_FILTERS)
    value = {"count": F.count("*").cast("double"), "distinct_ips": F.count_distinct("client_ip").cast("double"), "rate": F.count("*").cast("double")}[condition.aggregate]
    ranked = hits.select(*keys, "client_ip", "correlation_id")
    out = ranked.groupBy(*condition.group_by).agg(value.alias("value"))
    few = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*condition.group_by, *([] if condition.group_by else [F.lit(1)])).orderBy("correlation_id"))).where(F.col("_n") <= EVIDENCE)
    evidence = few.groupBy(*condition.group_by).agg(F.array_sort(F.collect_list("correlation_id")).alias("evidence"))
    join = lambda a, b: a.join(b, [a[g].eqNullSafe(b[g]) for g in condition.group_by], "left").select(a["*"], *(b[c] for c in b.columns if c not in condition.group_by)) if condition.group_by else a.join(b, how="left")
    if condition.aggregate == "rate":
        if rate_compat:
            out = out.withColumn("value", F.when(F.col("value") > 0, F.lit(1.0)).otherwise(0.0))
        else:
            every = recent.select(*keys).groupBy(*condition.group_by).agg(F.count("*").alias("_all"))
            out = join(out, every).withColumn("value", F.coalesce(F.try_divide("value", "_all"), F.lit(0.0))).drop("_all")
    out = join(out, evidence)
    return out.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>"))).withColumn("fires", compare(F.col("value"), condition.comparator, condition.threshold))


def preview(records: DataFrame, condition: Condition, start: int, end: int, step: int = 30) -> DataFrame:
    """What a rule would have measured at each tick start, start + step, ... up to `end`: tick, the groups, value, fires.

    A record counts at every tick within `window` seconds after it. It is added up where it enters and
    where it leaves, and values are running sums, so there is no row for each record and tick. Without
    groups every tick is listed; with groups those of a group that has hits, as `measure` does.
    """
    n = max(0, (end - start) // step + 1)
    rows = records.where((F.col("window_start") >= start - condition.window) & (F.col("window_start") < end))
    groups = list(condition.group_by)
    first = F.greatest(F.lit(0), F.floor((F.col("window_start") - start) / step) + 1).cast("long")
    last = F.least(F.lit(n - 1), F.floor((F.col("window_start") + condition.window - start) / step)).cast("long")

    def moves(frame: DataFrame, hit: int) -> DataFrame:
        keyed = frame.select(*(F.col(GROUPS[g]).alias(g) for g in groups), "client_ip", first.alias("a"), last.alias("b")).where("a <= b")
        ends = F.explode(F.array(F.struct(F.col("a").alias("k"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("k"), F.lit(-1).alias("d"))))
        return keyed.select(*groups, "client_ip", ends.alias("m")).select(*groups, "client_ip", "m.k", (F.col("m.d") * hit).alias("hits"), (F.col("m.d") * (1 - hit)).alias("every"))

    met = moves(filtered(rows, condition.filters, RECORD_FILTERS), 1)
    if condition.aggregate == "rate":
        met = met.unionByName(moves(rows, 0))
    if condition.aggregate == "distinct_ips":
        # An address counts from where it is first seen until all of its records have left.
        along = Window.partitionBy(*groups, "client_ip").orderBy("k")
        met = met.where("client_ip IS NOT NULL").groupBy(*groups, "client_ip", "k").agg(F.sum("hits").alias("d")).withColumn("there", (F.sum("d").over(along) > 0).cast("int"))
        met = met.select(*groups, "k", (F.col("there") - F.coalesce(F.lag("there").over(along), F.lit(0))).alias("hits"), F.lit(0).alias("every"))
    summed = met.groupBy(*groups, "k").agg(F.sum("hits").alias("hits"), F.sum("every").alias("every"))
    along = Window.partitionBy(*(groups or [F.lit(1)])).orderBy("k")  # a row for each tick of a group at most
    until = F.least(F.lit(n), F.coalesce(F.lead("k").over(along), F.lit(n)))
    held = summed.select(*groups, "k", F.sum("hits").over(along).alias("hits"), F.sum("every").over(along).alias("every"), until.alias("until")).where("k < until AND hits > 0")
    value = F.coalesce(F.try_divide("hits", "every"), F.lit(0.0)) if condition.aggregate == "rate" else F.col("hits").cast("double")
    out = held.select(F.explode(F.sequence("k", F.col("until") - 1)).alias("k"), *groups, value.alias("value"))
    if not groups:
        out = records.sparkSession.range(n).withColumnRenamed("id", "k").join(out, "k", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return out.select((F.lit(start) + F.col("k") * step).cast("long").alias("tick"), *groups, "value").withColumn("fires", compare(F.col("value"), condition.comparator, condition.threshold))


def with_cooldown(firings: DataFrame, fired: DataFrame, rule_id: str, group_by: tuple[str, ...], now: int) -> DataFrame:
    """Firings whose rule and group aren't cooling down after an earlier one (fired: key, until)."""
    group = F.create_map(*(x for g in group_by for x in (F.lit(g), F.coalesce(F.col(g).cast("string"), F.lit(""))))) if group_by else F.create_map().cast("map<string,string>")
    keyed = firings.where("fires").withColumn("key", cooldown_key(F.lit(rule_id), group))
    return keyed.join(fired.where(F.col("until") > now).select("key"), "key", "left_anti")


def list_alerts(alerts: DataFrame, start: int, end: int, state: str | None = None, severity: str | None = None, rule: str | None = None, notify: str | None = None, limit: int = 100) -> DataFrame:
    rows = latest(alerts, ["alert_id"], "version").where((F.col("fired_at") >= start) & (F.col("fired_at") < end))
    for column, value in (("state", state), ("severity", severity), ("rule_id", rule), ("notify_status", notify)):
        if value:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("fired_at"), F.desc("alert_id")).limit(min(limit, 500))


def pending_deliveries(alerts: DataFrame, now: int | None = None, limit: int = 50) -> DataFrame:
    """Undelivered alerts whose next attempt is due at `now` (any, without it), oldest first."""
    rows = latest(alerts, ["alert_id"], "version").where("notify_status = 'pending'")
    if now is not None:
        rows = rows.where(F.coalesce("next_attempt_at", F.lit(0)) <= now)
    return rows.orderBy("fired_at", "alert_id").limit(limit)


def after_attempts(alerts: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """New versions of pending alerts after a delivery (outcomes: alert_id, delivered): sent, tried again later, or given up."""
    met = latest(alerts, ["alert_id"], "version").where("notify_status = 'pending'").join(outcomes.select("alert_id", "delivered"), "alert_id")
    attempt = F.coalesce("attempts", F.lit(0)) + 1
    delays = [retry_delay(k) for k in range(1, ATTEMPTS + 1)]
    delay = F.try_element_at(F.array(*(F.lit(x).cast("long") for x in delays)), attempt.cast("int"))
    changed = (
        met.withColumn("notify_status", F.when(F.col("delivered"), "sent").when(delay.isNull(), "failed").otherwise("pending"))
        .withColumn("next_attempt_at", F.when(~F.col("delivered"), F.lit(now) + delay).cast("long"))
        .withColumn("attempts", attempt.cast("int"))
        .drop("delivered")
    )
    return append_version(alerts, changed, ["alert_id"])


def transition(alerts: DataFrame, alert_ids: list[str], state: str, at: int) -> DataFrame:
    """New versions of alerts: new becomes acknowledged or resolved; resolving stamps both times, and none goes back."""
    if state not in ("acknowledged", "resolved"):
        raise ValueError(f"unknown state {state}")
    now = latest(alerts, ["alert_id"], "version").where(F.col("alert_id").isin(alert_ids) & (F.col("state") != "resolved") & (F.col("state") != state))
    changed = now.withColumn("state", F.lit(state)).withColumn("acknowledged_at", F.coalesce("acknowledged_at", F.lit(at)))
    if state == "resolved":
        changed = changed.withColumn("resolved_at", F.lit(at).cast("long"))
    return append_version(alerts, changed, ["alert_id"])


def retry_delay(attempt: int) -> int | None:
    """Seconds before a delivery is tried again; none after five attempts."""
    return min(300, 2 * 2 ** (attempt - 1)) if attempt < ATTEMPTS else None
