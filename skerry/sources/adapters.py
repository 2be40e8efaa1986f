"""The monitored system's tables, derived from the driver's `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import parsing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def between(e: DataFrame, since_ms: int | None, until_ms: int | None) -> DataFrame:
    """Rows of `events` from one moment to another, both included: as bounds of the stored column, which the scan takes over."""
    for ms, ok in ((since_ms, lambda t, at: t >= at), (until_ms, lambda t, at: t <= at)):
        if ms is not None:
            at = F.timestamp_millis(F.lit(ms))
            e = e.where(ok(F.col("ts"), at.cast(e.schema["ts"].dataType)))
    return e


def log_events(spark: SparkSession, sf_dir: str, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Log records: three clocks in epoch ms, two entities, severity, family and message."""
    e = between(table(spark, sf_dir, "events"), since_ms, until_ms)
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    raw = F.when(kind.isin("click", "purchase"), "I").when(kind == "view", "D").when(kind == "signup", "W").when(kind == "error", "E")
    rows = e.select(
        "event_id", "user_id", "event_type", "value", ms.alias("collector_ms"),
        (ms - F.floor("value").cast("long")).alias("event_ms"),
        (ms + F.col("event_id") % 5000).alias("ingest_ms"),
        F.concat(F.lit("epn"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("origin_host"),
        F.concat(F.lit("node-"), F.lpad((F.col("user_id") % 3 + 1).cast("string"), 2, "0")).alias("node"),
        raw.alias("severity"),
        F.when(F.col("user_id") % 3 == 0, "infologger").when(F.col("user_id") % 3 == 1, "local").otherwise("central").alias("family"),
        F.concat(kind, F.lit(" k="), F.get_json_object("props", "$.k")).alias("message"),
    )
    return rows.select(
        "*", parsing.severity_norm(F.col("severity")).alias("severity_norm"),
        (F.col("collector_ms") - F.col("event_ms")).alias("enter_system_lag_ms"), (F.col("ingest_ms") - F.col("collector_ms")).alias("ingest_lag_ms"),
    )


#: The same for the oracle.
LOG = """log_events AS (
  SELECT *, collector_ms - event_ms AS enter_system_lag_ms, ingest_ms - collector_ms AS ingest_lag_ms,
    CASE severity WHEN 'I' THEN 'info' WHEN 'D' THEN 'debug' WHEN 'W' THEN 'warning' WHEN 'E' THEN 'error' ELSE 'unknown' END AS severity_norm
  FROM (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS collector_ms,
    epoch_us(ts) // 1000 - CAST(floor(value) AS BIGINT) AS event_ms, epoch_us(ts) // 1000 + event_id % 5000 AS ingest_ms,
    'epn' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS origin_host, 'node-' || lpad(CAST(user_id % 3 + 1 AS VARCHAR), 2, '0') AS node,
    CASE event_type WHEN 'click' THEN 'I' WHEN 'purchase' THEN 'I' WHEN 'view' THEN 'D' WHEN 'signup' THEN 'W' WHEN 'error' THEN 'E' END AS severity,
    CASE user_id % 3 WHEN 0 THEN 'infologger' WHEN 1 THEN 'local' ELSE 'central' END AS family,
    event_type || ' k=' || json_extract_string(props, '$.k') AS message FROM events))"""


def metric_samples(spark: SparkSession, sf_dir: str, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Health samples of all kinds in one sparse table, as the poller writes them."""
    e = between(table(spark, sf_dir, "events"), since_ms, until_ms).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return e.selectExpr(*_SAMPLE_COLUMNS)


_KIND = "CASE WHEN event_id % 20 = 0 THEN 'alertmanager' WHEN event_id % 20 = 1 THEN 'projector' WHEN event_type = 'click' THEN 'fleet' WHEN event_type = 'view' THEN 'fluentbit' WHEN event_type = 'signup' THEN 'node' WHEN event_type = 'purchase' THEN 'cluster' WHEN event_type = 'error' THEN 'osd' END"
#: One list for both dialects.
_SAMPLE_COLUMNS = [
    "event_id", "ms AS ts", f"{_KIND} AS kind",
    "concat('node-', lpad(cast(user_id % 12 + 1 as string), 2, '0')) AS collector_id",
    "concat('os-', cast(user_id % 5 as string)) AS os_node",
    "CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS heartbeat_missing",
    "CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END AS fb_healthy",
    "CASE WHEN event_id % 97 = 0 THEN event_id % 5 ELSE 0 END AS output_dropped_delta",
    "CASE WHEN event_id % 89 = 0 THEN 1 ELSE 0 END AS output_retries_failed_delta",
    "event_id % 1000 AS output_records_delta", "event_id % 3 AS output_errors_delta", "event_id % 2 AS output_retries_delta",
    "value / 5.0 AS disk_used_percent", "60.0 + value / 12.5 AS heap_percent", "value / 6.0 AS cpu_percent",
    "event_id % 400 AS indexing_delta",
    "CASE WHEN event_id % 101 = 0 THEN 2 ELSE 0 END AS admission_rejections_delta",
    "event_id % 4 AS cluster_status_code", "event_id % 3 AS unassigned_shards",
    "value AS event_loop_delay", "value * 2 AS response_avg_ms", "event_id AS requests_total",
    "event_id * 7 % 5003 AS output_records", "CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS am_up",
]
METRICS = "metric_samples AS (SELECT " + ", ".join(c.replace("as string", "as varchar") for c in _SAMPLE_COLUMNS) + " FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events))"


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective-dated topology: a snapshot each week, with the hosts of `events` assigned to collectors."""
    hosts = log_events(spark, sf_dir).select("origin_host", "user_id").distinct()
    weeks = spark.range(5).select(F.col("id").alias("week"))
    # weeks is five rows: one copy of the hosts for each
    return hosts.join(F.broadcast(weeks)).select(
        F.concat(F.lit("v"), F.col("week")).alias("topology_version"),
        (F.lit(1704067200000 + 2 * 86_400_000) + F.col("week") * 7 * 86_400_000).alias("effective_from"),
        "origin_host",
        F.when((F.col("user_id") + F.col("week")) % 9 != 0, F.concat(F.lit("node-"), F.lpad(((F.col("user_id") + F.col("week")) % 12 + 1).cast("string"), 2, "0"))).alias("collector_id"),
    ).where("collector_id is not null")


ROSTER = """roster AS (SELECT 'v' || week AS topology_version, 1704067200000 + 2 * 86400000 + week * 7 * 86400000 AS effective_from, origin_host,
    'node-' || lpad(CAST((user_id + week) % 12 + 1 AS VARCHAR), 2, '0') AS collector_id
  FROM (SELECT DISTINCT origin_host, user_id FROM log_events), range(5) t(week) WHERE (user_id + week) % 9 <> 0)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert documents: orders as alerts of the catalog's monitors, opened at the order date."""
    o = table(spark, sf_dir, "orders").withColumn("ms", F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    return o.selectExpr(*_ALERT_COLUMNS)


_ALERT_COLUMNS = [
    "concat('a', cast(o_orderkey as string)) AS id",
    "CASE o_orderkey % 5 WHEN 0 THEN 'collector-down' WHEN 1 THEN 'data-loss' WHEN 2 THEN 'heap-spiral' WHEN 3 THEN 'fleet-fb-silence' ELSE 'no-such-monitor' END AS monitor_name",
    "CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'P' THEN 'ERROR' ELSE 'COMPLETED' END AS state",
    "CASE WHEN o_orderkey % 4 = 0 THEN '1' ELSE '2' END AS severity",
    "ms AS start_time", "ms + o_custkey % 1000 AS last_notification_time",
    "CASE WHEN o_orderstatus = 'F' THEN ms + 60000 * (1 + o_orderkey % 50) END AS end_time",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('node-', lpad(cast(o_custkey % 40 + 1 as string), 3, '0')) END AS bucket_key",
]
ALERTS = "alerts AS (SELECT " + ", ".join(c.replace("as string", "as varchar") for c in _ALERT_COLUMNS) + " FROM (SELECT *, epoch_us(o_orderdate) // 1000 AS ms FROM orders))"
