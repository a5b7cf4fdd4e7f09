"""Health of feeds and of correlation, drift of schemas, rates for operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bucket_start

# Limits in seconds (silence, delay, duration of a search) and shares (drift, rejections, failed requests).
HOUR, SILENCE, DRIFT = 3_600, 900, 0.01
LAG, SLOW, REJECTED, FAILED = 60, 3.0, 0.01, 0.02


def feed_minutes(samples: DataFrame) -> DataFrame:
    """Samples of a feed added up by minute: additive counts, the largest lag, the least credential state."""
    return samples.groupBy("tenant_id", "feed_id", bucket_start(F.col("at"), 60).alias("minute")).agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.sum("drifted").alias("drifted"), F.max("lag").alias("lag"), F.min("credential_ok").alias("credential_ok")
    )


def feed_health(minutes: DataFrame, now: int) -> DataFrame:
    """Each feed's last hour. `silent` is null for a feed that was never active in it."""
    recent = minutes.where((F.col("minute") > now - HOUR) & (F.col("minute") <= now))
    out = recent.groupBy("tenant_id", "feed_id").agg(
        F.sum("accepted").alias("accepted"),
        F.sum("rejected").alias("rejected"),
        F.max("lag").alias("lag"),
        F.max(F.when(F.col("accepted") > 0, F.col("minute"))).alias("last_active"),
        F.min(F.when(F.col("minute") > now - 300, F.col("credential_ok"))).alias("credential_ok"),
        F.round(F.sum("accepted") / HOUR, 6).alias("events_per_s"),
        (F.coalesce(F.try_divide(F.sum("drifted"), F.sum("accepted")), F.lit(0.0)) > DRIFT).alias("drifting"),
    )
    return out.withColumn("silent", (F.lit(now) - F.col("last_active")) > SILENCE)


def correlation_health(minutes: DataFrame, now: int, ttl: int = 1_110) -> DataFrame:
    """State of correlation over 15 minutes: what fails, rests, stalls, loses or lags, in this order."""
    out = minutes.where((F.col("minute") > now - 900) & (F.col("minute") <= now)).groupBy("tenant_id").agg(
        F.sum("filed").alias("filed"), F.sum("emitted").alias("emitted"), F.sum("failures").alias("failures"), F.sum("dropped").alias("dropped"), F.max("due").alias("due"), F.max("lag").alias("lag")
    )
    share = F.coalesce(F.try_divide("dropped", "filed"), F.lit(0.0))
    status = (
        F.when((F.col("failures") > 0) & (F.col("emitted") == 0), "failing")
        .when(F.col("filed") == 0, "idle")
        .when(F.col("emitted") == 0, "stalled")
        .when(share > 0.05, "losing")
        .when((F.col("due") >= 8_192) & (F.col("lag") > ttl / 2), "behind")
        .otherwise("healthy")
    )
    return out.withColumn("status", status)


def drift(events: DataFrame, unknown: str = "unknown_fields", width: int = 600, most: int = 50) -> DataFrame:
    """Windows of a feed in which over one event of a hundred had fields that the schema doesn't know."""
    at = bucket_start(F.col("event_time"), width).alias("window_start")
    rows = events.select("tenant_id", "feed_id", at, (F.size(unknown) > 0).alias("odd"), unknown)
    fields = rows.select("tenant_id", "feed_id", "window_start", F.explode(unknown).alias("field")).distinct().groupBy("tenant_id", "feed_id", "window_start").agg(F.array_sort(F.collect_list("field")).alias("fields"))
    out = rows.groupBy("tenant_id", "feed_id", "window_start").agg(F.count("*").alias("events"), F.sum(F.when(F.col("odd"), 1).otherwise(0)).alias("drifted"))
    out = out.where(F.col("drifted") > DRIFT * F.col("events"))
    return out.join(fields, ["tenant_id", "feed_id", "window_start"]).withColumn("fields", F.slice("fields", 1, most))


def operational_rates(events: DataFrame, rejected: DataFrame, now: int) -> DataFrame:
    """Silence, delay and share of rejections of each feed in the last hour, with which limits they pass."""
    recent = events.where(F.col("received_at").between(now - HOUR, now)).groupBy("feed_id").agg(
        F.count("*").alias("accepted"), F.max("received_at").alias("last"), F.percentile_approx(F.col("received_at") - F.col("event_time"), 0.95).alias("lag_p95")
    )
    lost = rejected.where(F.col("received_at").between(now - HOUR, now)).groupBy("feed_id").agg(F.count("*").alias("rejected"))
    out = recent.join(lost, "feed_id", "left").withColumn("rejected", F.coalesce("rejected", F.lit(0)))
    share = F.col("rejected") / (F.col("rejected") + F.col("accepted"))
    return out.withColumn("silent", F.lit(now) - F.col("last") > SILENCE).withColumn("late", F.col("lag_p95") > 60).withColumn("rejecting", share > 0.01)


def ingest_minutes(events: DataFrame, rejected: DataFrame, unknown: str = "unknown_fields") -> DataFrame:
    """States of each tenant, feed and minute: counts, the last receipt, and a KLL sketch of the delays. States of any minutes can be merged."""
    key = ["tenant_id", "feed_id", "minute"]
    at = bucket_start(F.col("received_at"), 60).alias("minute")
    own = events.groupBy("tenant_id", "feed_id", at).agg(
        F.count("*").alias("accepted"), F.count(F.when(F.size(unknown) > 0, 1)).alias("drifted"), F.max("received_at").alias("last"), F.kll_sketch_agg_bigint(F.col("received_at") - F.col("event_time")).alias("delays")
    )
    lost = rejected.groupBy("tenant_id", "feed_id", at).agg(F.count("*").alias("rejected"))
    return own.join(lost, key, "full").fillna(0, ["accepted", "drifted", "rejected"])


def ingest_rates(minutes: DataFrame, now: int, span: int = HOUR) -> DataFrame:
    """Silence, 95 % delay, rejections and drift of each tenant's feeds in the `span` seconds before `now`, with which limits they pass."""
    recent = minutes.where((F.col("minute") > now - span) & (F.col("minute") <= now))
    out = recent.groupBy("tenant_id", "feed_id").agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.sum("drifted").alias("drifted"), F.max("last").alias("last"), F.kll_merge_agg_bigint("delays").alias("delays")
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.select(
        "tenant_id", "feed_id", "accepted", "rejected", "drifted", "last",
        # A feed of rejections alone has an empty sketch, which has no quantiles.
        F.when(F.col("accepted") > 0, F.kll_sketch_get_quantile_bigint("delays", F.lit(0.95))).alias("lag_p95"),
        (F.lit(now) - F.col("last") > SILENCE).alias("silent"),
        (share(F.col("rejected"), F.col("rejected") + F.col("accepted")) > REJECTED).alias("rejecting"),
        (share(F.col("drifted"), F.col("accepted")) > DRIFT).alias("drifting"),
    ).withColumn("late", F.col("lag_p95") > LAG)


def request_minutes(requests: DataFrame) -> DataFrame:
    """States of each tenant and minute of requests to the service (at, status, seconds): counts, and a KLL sketch of how long they took."""
    return requests.groupBy("tenant_id", bucket_start(F.col("at"), 60).alias("minute")).agg(
        F.count("*").alias("requests"), F.count(F.when(F.col("status") >= 500, 1)).alias("errors"), F.kll_sketch_agg_double(F.col("seconds").cast("double")).alias("took")
    )


def request_rates(minutes: DataFrame, now: int, span: int = 300) -> DataFrame:
    """Share of failed requests and 95 % duration of each tenant in the `span` seconds before `now`, with which limits they pass."""
    recent = minutes.where((F.col("minute") > now - span) & (F.col("minute") <= now))
    out = recent.groupBy("tenant_id").agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("took").alias("took"))
    out = out.select("tenant_id", "requests", "errors", F.kll_sketch_get_quantile_double("took", F.lit(0.95)).alias("took_p95"))
    return out.withColumn("failing", F.col("errors") / F.col("requests") > FAILED).withColumn("slow", F.col("took_p95") > SLOW)


def quota(events: DataFrame, per_second: int, bytes_per_day: int, size: str = "bytes") -> DataFrame:
    """Seconds and days of a tenant in which it passed its quota."""
    seconds = events.groupBy("tenant_id", F.lit("second").alias("span"), F.col("received_at").alias("at")).agg(F.count("*").alias("used")).where(F.col("used") > per_second)
    days = events.groupBy("tenant_id", F.lit("day").alias("span"), bucket_start(F.col("received_at"), 86_400).alias("at")).agg(F.sum(size).alias("used")).where(F.col("used") > bytes_per_day)
    return seconds.unionByName(days)
