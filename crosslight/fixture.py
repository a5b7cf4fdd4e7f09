"""The test tables seen as vendor logs: every row of `events` is a request that up to three vendors report.

The expressions are plain enough to mean the same in Spark and in DuckDB, so operators and their SQL
counterparts start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAY = "'ray-' || CAST(id AS STRING)"
VERDICT = (
    "CASE WHEN ver = 2 AND vendor = 'f5' THEN 'rate_limited' WHEN value >= 120 AND ord < 2 THEN 'blocked' "
    "WHEN value >= 80 AND value < 120 AND ord = 1 THEN 'blocked' WHEN event_type = 'error' AND value < 80 AND ord = 2 THEN 'challenged' ELSE 'allowed' END"
)
#: Column of an observation and its expression over id, sec, user_id, event_type, value, ord, vendor, ver.
COLUMNS = {
    "tenant_id": "'tenant-' || CAST(user_id % 3 AS STRING)",
    "feed_id": "'feed-' || vendor",
    "event_id": "vendor || '-' || CAST(id AS STRING)",
    "vendor": "vendor",
    "event_time": "CAST(sec + ord AS BIGINT)",
    "received_at": "CAST(sec + ord + 90 + id % 60 AS BIGINT)",
    "vendor_request_id": f"CASE WHEN vendor = 'cloudflare' OR id % 5 = 0 THEN {RAY} ELSE vendor || '-req-' || CAST(id AS STRING) END",
    "linked_request_id": f"CASE WHEN vendor = 'f5' AND id % 7 = 0 THEN {RAY} WHEN vendor = 'datadome' AND id % 11 = 0 THEN 'f5-req-' || CAST(id AS STRING) ELSE '' END",
    "client_ip": "CASE WHEN user_id % 97 = 0 THEN NULL ELSE '203.0.113.' || CAST(user_id % 200 AS STRING) END",
    "client_ip_shared": "user_id % 13 = 0",
    "client_asn": "CAST(CASE WHEN vendor = 'f5' THEN 0 WHEN vendor = 'datadome' AND id % 9 = 0 THEN 13335 ELSE 64500 + user_id % 20 END AS BIGINT)",
    "client_country": "CASE WHEN vendor = 'f5' AND id % 2 = 0 THEN '' WHEN user_id % 5 = 0 THEN 'US' WHEN user_id % 5 = 1 THEN 'DE' WHEN user_id % 5 = 2 THEN 'FR' WHEN user_id % 5 = 3 THEN 'GB' ELSE 'JP' END",
    "request_host": "CASE WHEN vendor = 'datadome' AND id % 23 = 0 THEN '' ELSE 'h' || CAST(user_id % 7 AS STRING) || '.example.com' END",
    "request_path": "'/' || event_type",
    "request_method": "CASE WHEN event_type = 'purchase' OR event_type = 'signup' THEN 'POST' ELSE 'GET' END",
    "user_agent": "'agent ' || CAST(user_id % 11 AS STRING) || ' probe' || CAST(id % 3 AS STRING)",
    "http_status": f"CAST(CASE WHEN {VERDICT} = 'blocked' THEN 403 WHEN {VERDICT} = 'rate_limited' THEN 429 ELSE 200 END AS INT)",
    "ja4": "CASE WHEN vendor = 'cloudflare' THEN 't13d' || CAST(id % 30 AS STRING) ELSE '' END",
    "verdict": VERDICT,
    "rule_id": f"CASE WHEN vendor = 'cloudflare' AND ({VERDICT} <> 'allowed' OR id % 10 = 0) THEN 'r' || CAST(id % 9 AS STRING) WHEN vendor = 'f5' AND {VERDICT} <> 'allowed' THEN 'policy-' || CAST(id % 4 AS STRING) ELSE '' END",
    "score": "CASE WHEN vendor = 'datadome' THEN CAST((id * 7) % 101 AS DOUBLE) / 1e2 WHEN vendor = 'f5' THEN CAST(id % 6 AS DOUBLE) ELSE NULL END",
    "score_kind": "CASE WHEN vendor = 'datadome' THEN 'bot' WHEN vendor = 'f5' THEN 'threat' ELSE 'none' END",
    "waf_attack_score": "CAST(CASE WHEN vendor = 'cloudflare' THEN (id * 13) % 101 ELSE 0 END AS INT)",
    "waf_action": "CASE WHEN vendor <> 'cloudflare' THEN '' WHEN id % 6 = 0 THEN 'block' WHEN id % 6 = 1 THEN 'log' WHEN id % 6 = 2 THEN 'skip' WHEN id % 6 = 3 THEN 'challenge' WHEN id % 6 = 4 THEN 'simulate' ELSE '' END",
    "waf_source": "CASE WHEN vendor <> 'cloudflare' THEN '' WHEN id % 4 = 0 THEN 'firewallManaged' ELSE 'firewallCustom' END",
    "matched_rule": "CASE WHEN vendor = 'cloudflare' AND id % 4 = 0 THEN 'm' || CAST(id % 9 AS STRING) ELSE '' END",
    "violation": "CASE WHEN vendor = 'f5' THEN 'VIOL-' || CAST(id % 5 AS STRING) ELSE '' END",
    "ingest_version": "CAST(ver AS BIGINT)",
}
BASE = ("id", "sec", "user_id", "event_type", "value", "ord", "vendor", "ver")

#: The same rows in DuckDB: a chain of common table expressions that ends with `obs`.
OBS_SQL = f"""
base AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, user_id, event_type, value FROM events),
seen AS (
    SELECT base.*, o.ord, o.vendor, v.ver FROM base,
        (VALUES (0, 'cloudflare'), (1, 'f5'), (2, 'datadome')) o(ord, vendor), (VALUES (1), (2)) v(ver)
    WHERE (ord = 0 OR (ord = 1 AND id % 3 <> 0) OR (ord = 2 AND id % 4 <> 0)) AND (ver = 1 OR id % 17 = 0)),
obs AS (SELECT {', '.join(f'{e} AS {n}' for n, e in COLUMNS.items())} FROM seen)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations, redeliveries with a higher version included."""
    vendors = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(v).alias("vendor")) for k, v in enumerate(("cloudflare", "f5", "datadome"))))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"), "user_id", "event_type", "value"
    )
    seen = (
        events.withColumn("v", F.explode(vendors))
        .select("*", "v.ord", "v.vendor", F.explode(F.array(F.lit(1), F.lit(2))).alias("ver"))
        .where("(ord = 0 OR (ord = 1 AND id % 3 <> 0) OR (ord = 2 AND id % 4 <> 0)) AND (ver = 1 OR id % 17 = 0)")
    )
    return seen.selectExpr(*(f"{e} AS {n}" for n, e in COLUMNS.items()))
