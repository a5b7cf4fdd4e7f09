"""Rows that the registered queries start from, in Spark and as DuckDB tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixture import OBS_SQL, observations
from ..operators.components import cut
from ..operators.correlate import records
from ..operators.latest import latest

_kept: dict[tuple, str] = {}
#: Spark's setting that removes a query's shuffle files at its end.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir)


def events(spark: SparkSession, sf_dir: str, fixed: Column | None = None) -> DataFrame:
    """Newest version of each observation; `fixed` is a filter on what its versions share."""
    return latest(observations(spark, sf_dir), ["tenant_id", "event_id"], fixed=fixed)


def _state(spark: SparkSession, path: str) -> tuple:
    """What tells whether a table's files have changed: their number, bytes and last change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return tuple(files.agg(F.count("*"), F.sum("length"), F.max("modificationTime")).first())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path, where driver and executors both find it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        cut(spark.range(1))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Within, a step's shuffled rows are freed as soon as the step is done, and not when the driver comes to collect its garbage."""
    before = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], None]) -> DataFrame:
    """A table that `build` writes to a path, built once for a session and state of the input and read from then on."""
    key = (spark.sparkContext.applicationId, name, sf_dir, _state(spark, f"{sf_dir}/events.parquet"))
    if key in _kept:
        try:
            return spark.read.parquet(_kept[key])
        except AnalysisException:  # the folder was cleared meanwhile
            del _kept[key]
    path = shared_path(spark, name)
    with freed(spark):
        build(path)
    _kept[key] = path
    return spark.read.parquet(path)


def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated records as a stored table."""
    return stored(spark, sf_dir, "records", lambda path: records(events(spark, sf_dir)).write.parquet(path))


def joined(column: str) -> Column:
    """A list as text, for comparison."""
    return F.array_join(column, ",")


def map_text(column: str) -> Column:
    """A map as sorted text, for comparison."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


EVENTS_SQL = f"""{OBS_SQL},
ev AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, event_id ORDER BY ingest_version DESC) AS n FROM obs) WHERE n = 1)"""

RECORDS_SQL = f"""{EVENTS_SQL},
ids AS (
    SELECT DISTINCT tenant_id, event_id, vendor, 't1|' || tenant_id || '|' || rid AS rid
    FROM (SELECT tenant_id, event_id, vendor, unnest([trim(vendor_request_id), trim(linked_request_id)]) AS rid FROM ev) WHERE rid <> ''),
pairs AS (SELECT tenant_id, event_id, vendor, min(rid) AS a, max(rid) AS b FROM ids GROUP BY ALL),
edges AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs)),
reach AS (SELECT DISTINCT a AS node, a AS root FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.root = e.a),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
keyed AS (SELECT p.tenant_id, p.event_id, p.vendor, r.root AS exact_key FROM pairs p JOIN roots r ON p.a = r.node),
exact AS (
    SELECT tenant_id, event_id, exact_key FROM keyed
    WHERE exact_key IN (SELECT exact_key FROM keyed GROUP BY exact_key HAVING count(DISTINCT vendor) > 1)),
shaped AS (
    SELECT tenant_id, event_id, floor(event_time / 5)::BIGINT AS w,
        CASE WHEN coalesce(request_host, '') <> '' AND coalesce(client_ip, '') <> '' THEN
            't2|' || tenant_id || '|' || client_ip || '|' || lower(request_host) || '|' || lower(request_path) || '|' || upper(request_method) END AS shape
    FROM ev WHERE (tenant_id, event_id) NOT IN (SELECT (tenant_id, event_id) FROM exact)),
runs AS (
    SELECT shape, w, w - row_number() OVER (PARTITION BY shape ORDER BY w) AS run
    FROM (SELECT DISTINCT shape, w FROM shaped WHERE shape IS NOT NULL)),
paired AS (SELECT shape, w, first_w + 2 * ((w - first_w) // 2) AS g FROM (SELECT *, min(w) OVER (PARTITION BY shape, run) AS first_w FROM runs)),
grp AS (
    SELECT ev.*, exact_key AS group_key, 1 AS join_tier FROM ev JOIN exact USING (tenant_id, event_id)
    UNION ALL
    SELECT ev.*, CASE WHEN s.shape IS NULL THEN 'solo|' || event_id ELSE s.shape || '|' || p.g END, CASE WHEN s.shape IS NULL THEN 0 ELSE 2 END
    FROM ev JOIN shaped s USING (tenant_id, event_id) LEFT JOIN paired p ON p.shape = s.shape AND p.w = s.w),
per_vendor AS (
    SELECT tenant_id, group_key, join_tier, vendor, count(*) AS n,
        last(verdict ORDER BY event_time, event_id) AS verdict,
        last(rule_id ORDER BY event_time, event_id) FILTER (WHERE rule_id <> '') AS rule_id,
        last(score ORDER BY event_time, event_id) FILTER (WHERE score IS NOT NULL) AS score
    FROM grp GROUP BY ALL),
by_vendor AS (
    SELECT tenant_id, group_key, max(n) AS most, string_agg(vendor || '=' || verdict, ',' ORDER BY vendor) AS verdicts,
        coalesce(string_agg(vendor || '=' || rule_id, ',' ORDER BY vendor) FILTER (WHERE rule_id IS NOT NULL), '') AS rule_ids,
        max(verdict) FILTER (WHERE vendor = 'f5') AS f5_verdict, max(verdict) FILTER (WHERE vendor = 'cloudflare') AS cf_verdict,
        max(rule_id) FILTER (WHERE vendor = 'cloudflare') AS cf_rule
    FROM per_vendor GROUP BY ALL),
built AS (
    SELECT tenant_id, group_key, join_tier, min(event_time) AS first_event_time, max(event_time) AS last_event_time,
        count(DISTINCT vendor)::INT AS vendor_count, string_agg(DISTINCT vendor, ',' ORDER BY vendor) AS vendors,
        string_agg(event_id, ',' ORDER BY event_time, vendor, event_id) AS event_ids, list(event_id) AS id_list,
        bool_or(client_ip_shared) AS client_ip_shared,
        first(client_ip ORDER BY event_time, vendor, event_id) FILTER (WHERE coalesce(client_ip, '') <> '') AS client_ip,
        first(request_host ORDER BY event_time, vendor, event_id) FILTER (WHERE request_host <> '') AS request_host,
        first(request_path ORDER BY event_time, vendor, event_id) AS request_path,
        first(request_method ORDER BY event_time, vendor, event_id) AS request_method,
        first(client_asn ORDER BY CASE vendor WHEN 'cloudflare' THEN 0 WHEN 'datadome' THEN 1 ELSE 2 END, event_time, event_id)
            FILTER (WHERE client_asn > 0 AND (client_asn <> 13335 OR vendor = 'cloudflare')) AS client_asn,
        first(client_country ORDER BY CASE vendor WHEN 'cloudflare' THEN 0 WHEN 'datadome' THEN 1 ELSE 2 END, event_time, event_id)
            FILTER (WHERE client_country <> '') AS client_country,
        bool_or(verdict = 'allowed') AS has_allowed, bool_or(verdict IN ('blocked', 'rate_limited')) AS has_stop, bool_or(verdict = 'challenged') AS has_challenge,
        bool_and(verdict = 'allowed') AS all_allowed, max(score) FILTER (WHERE score_kind = 'bot') AS bot,
        max(CASE verdict WHEN 'blocked' THEN 5 WHEN 'rate_limited' THEN 4 WHEN 'challenged' THEN 3 WHEN 'monitored' THEN 2 WHEN 'allowed' THEN 1 ELSE 0 END) AS worst,
        list_sort(list(DISTINCT matched_rule) FILTER (WHERE matched_rule <> '')) AS matched_rules
    FROM grp GROUP BY ALL),
rec0 AS (
    SELECT b.*, v.verdicts, v.rule_ids, coalesce(v.f5_verdict, '') AS f5_verdict, coalesce(v.cf_verdict, '') AS cf_verdict, coalesce(v.cf_rule, '') AS cf_rule,
        CASE WHEN join_tier = 1 THEN 1 ELSE v.most END AS candidate_count, ['unknown', 'allowed', 'monitored', 'challenged', 'rate_limited', 'blocked'][worst + 1] AS combined_outcome,
        CASE WHEN vendor_count < 2 THEN 'none' WHEN has_allowed AND has_stop THEN 'allow_vs_block' WHEN has_allowed AND has_challenge THEN 'allow_vs_challenge'
            WHEN all_allowed AND coalesce(bot >= 0.8, false) THEN 'score_conflict' ELSE 'none' END AS disagreement_kind,
        sha256(strlen(group_key)::VARCHAR || ':' || group_key) AS h,
        CASE WHEN join_tier = 2 THEN regexp_extract(group_key, '(-?[0-9]+)$', 1)::BIGINT * 5 ELSE floor(first_event_time / 5)::BIGINT * 5 END AS window_start
    FROM built b JOIN by_vendor v USING (tenant_id, group_key)),
rec AS (
    SELECT *, CASE WHEN vendor_count = 1 OR join_tier = 1 THEN 'high' WHEN client_ip_shared OR candidate_count > 1 THEN 'low' ELSE 'medium' END AS confidence,
        substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS correlation_id
    FROM rec0)"""


def over_obs(select: str) -> str:
    return f"WITH {OBS_SQL} {select}"


def over_events(select: str) -> str:
    return f"WITH {EVENTS_SQL} {select}"


def over_records(select: str) -> str:
    return f"WITH RECURSIVE {RECORDS_SQL} {select}"
