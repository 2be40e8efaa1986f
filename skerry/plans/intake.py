"""Queries of intake: record stages, overlapping reads, generated sources, health documents and windows of streams (inventory A, B, I, N5)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import parsing as p
from skerry.operators import detection, metrics, ordered, records
from skerry.plans.registry import query
from skerry.session import AS_OF, DAY
from skerry.sources import sinks, synthetic
from skerry.sources.adapters import LOG, METRICS, ROSTER, log_events, metric_samples, roster, table
from skerry.sources.incremental import Lane
from skerry.sources.shared import home
from skerry.streaming import jobs

W, M = f"WITH {LOG} ", f"WITH {METRICS} "


@query("record_modifier", "SELECT event_id, event_type, 'infologger' AS log_source, 'node-07' AS node FROM events")
def record_modifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with constants added and keys dropped."""
    rows = table(spark, sf_dir, "events").withColumn("node", F.lit("stale"))
    return records.modified(rows, ["user_id", "value", "ts", "props"], log_source="infologger", node="node-07").select("event_id", "event_type", "log_source", "node")


@query("conditional_drop", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'epn' || user_id WHEN event_id % 3 = 1 THEN 'col' || user_id END AS origin_host FROM events WHERE coalesce(CASE WHEN event_id % 3 = 0 THEN 'epn' || user_id WHEN event_id % 3 = 1 THEN 'col' || user_id END, '') <> 'col7'")
def conditional_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all hosts but one, judged after enrichment: the host comes from either of two fields."""
    raw = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("epn"), "user_id")).alias("hostname"), F.when(F.col("event_id") % 3 < 2, F.concat(F.lit("col"), "user_id")).alias("host"))
    enriched = raw.select("event_id", p.origin_host(F.col("hostname"), F.col("host")).alias("origin_host"))
    return records.without(enriched, "origin_host", "col7")


@query("clean_baseline", W + f"SELECT event_id FROM log_events WHERE event_id % 9 <> 0 AND collector_ms BETWEEN {AS_OF - 4 * DAY} AND {AS_OF}")
def clean_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_events(spark, sf_dir, AS_OF - 4 * DAY, AS_OF).withColumn("poison_run_id", F.when(F.col("event_id") % 9 == 0, "run"))
    return records.clean_baseline(rows, "collector_ms", AS_OF, "poison_run_id", 4 * DAY).select("event_id")


@query("live_records", "SELECT event_id::VARCHAR AS run, CASE event_id % 4 WHEN 0 THEN 'given' ELSE CASE event_type WHEN 'click' THEN 'info' WHEN 'error' THEN 'error' ELSE 'unknown' END END AS severity_norm, CASE WHEN event_id % 2 = 0 THEN 'h' || user_id WHEN event_id % 3 = 0 THEN 'c' || user_id END AS origin_host, CASE event_id % 5 WHEN 0 THEN 'm' WHEN 1 THEN event_type ELSE '' END AS message FROM events")
def live_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live lane's shape of sparse records; fields that it doesn't know are left out."""
    k = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(
        k.cast("string").alias("run"), F.when(k % 4 == 0, "given").alias("severity_norm"), F.when(F.col("event_type") == "click", "I").when(F.col("event_type") == "error", "E").alias("severity"),
        F.when(k % 2 == 0, F.concat(F.lit("h"), "user_id")).alias("hostname"), F.when(k % 3 == 0, F.concat(F.lit("c"), "user_id")).alias("host"), F.when(k % 5 == 0, "m").alias("message"),
        F.when(k % 5 == 1, F.col("event_type")).alias("log"), F.lit(1).alias("unheard_of"),
    )
    got = records.live(raw)
    if "unheard_of" in got.columns or "log" in got.columns:
        raise ValueError("the live lane let an unknown field through")
    return got.select("run", "severity_norm", "origin_host", "message")


@query("client_queues", "SELECT client_id, event_id, row_number() OVER (PARTITION BY client_id ORDER BY event_id) > 2000 AS dropped FROM events JOIN (VALUES ('a', -1), ('b', 100), ('c', 900)) c(client_id, seen) ON event_id > seen")
def client_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each client of the live lane gets of a burst, and what overflows its queue."""
    clients = spark.createDataFrame([("a", -1), ("b", 100), ("c", 900)], "client_id string, seen long")
    return records.for_clients(table(spark, sf_dir, "events").select("event_id"), clients, "event_id")


@query("incremental_read", f"SELECT event_id FROM events WHERE epoch_us(ts) // 1000 >= {AS_OF - 21 * DAY}")
def incremental_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cycles of a lane with a failed one between them: rows of the overlap come twice and are kept once, and the failure skips none."""
    rows = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.col("event_id") % 4).alias("part"))
    root = f"{home(spark)}/lane-{uuid.uuid4().hex}"
    lane = Lane(root, "events", overlap_ms=DAY, first_ms=10 * DAY)

    def fail(_: DataFrame) -> None:
        raise RuntimeError("the consumer failed")

    keep = lambda batch: sinks.upsert(batch, f"{root}/kept", ["event_id"], "part")
    lane.cycle(rows.where(F.col("ms") <= AS_OF - 10 * DAY), "ms", AS_OF - 10 * DAY, keep)
    try:
        lane.cycle(rows, "ms", AS_OF, fail)
    except RuntimeError:
        pass
    lane.cycle(rows, "ms", AS_OF, keep)
    return spark.read.parquet(f"{root}/kept").select("event_id")


@query("seq_gap_epochs", "WITH r AS (SELECT event_id, user_id, event_id - event_id % 3 AS s, event_id // 400 AS e FROM events), t AS (SELECT *, coalesce(e <> lag(e) OVER (PARTITION BY user_id ORDER BY event_id), false) AS unknown FROM r) SELECT event_id, unknown, CASE WHEN NOT unknown THEN greatest(coalesce(s - max(s) OVER w - 1, 0), 0) END::BIGINT AS gap, coalesce(s <= max(s) OVER w, false) AS duplicate FROM t WINDOW w AS (PARTITION BY user_id, e ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def seq_gap_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of each stream's numbers, which start over with an epoch."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") - F.col("event_id") % 3).alias("s"), F.floor(F.col("event_id") / 400).alias("e"))
    return ordered.epoch_gaps(rows, "s", "e", ["user_id"], ["event_id"]).select("event_id", "unknown", "gap", "duplicate")


_DRAW = "id * 7919 % 1000"


@query("synthetic_families", f"SELECT f AS family, CASE WHEN {_DRAW} < 900 THEN 'info' WHEN {_DRAW} < 980 THEN CASE f WHEN 'dds' THEN 'unknown' ELSE 'warning' END WHEN {_DRAW} < 995 THEN 'error' ELSE CASE f WHEN 'dds' THEN 'unknown' ELSE 'fatal' END END AS severity_norm, count(*)::BIGINT AS n FROM range(20000) t(id), (VALUES ('infologger'), ('dds'), ('stdout')) v(f) WHERE NOT (f = 'stdout' AND id % 11 = 0) GROUP BY ALL")
def synthetic_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated records of three families, read back by the parsers; output lines without a severity aren't counted."""
    start, n = AS_OF - DAY, 20_000
    one = synthetic.infologger(spark, n, start).select(F.lit("infologger").alias("family"), "severity")
    two = synthetic.dds(spark, n, start).select(F.lit("dds").alias("family"), p.dds_fields(F.col("value"))["severity"].alias("severity"))
    three = synthetic.stdout(spark, n, start).select(F.lit("stdout").alias("family"), p.stdout_fields(F.col("value"))["severity"].alias("severity")).where("severity is not null")
    return one.unionByName(two).unionByName(three).groupBy("family", p.severity_norm(F.col("severity")).alias("severity_norm")).agg(F.count("*").alias("n"))


@query("load_gun", "SELECT id AS second, CASE WHEN id % 150 < 30 THEN 40 ELSE 5 END::BIGINT AS records FROM range(600) t(id)")
def load_gun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a burst profile offers in each second of ten minutes."""
    return synthetic.load(spark, 600, "burst", 5.0, 40.0).groupBy("second").agg(F.count("*").alias("records"))


@query("axis_rounding", "SELECT event_id, CASE WHEN value <= 0 THEN 1.0 ELSE (SELECT min(s * p) FROM (SELECT unnest([1.0, 2.0, 2.5, 5.0, 10.0]) AS s, power(10, floor(log10(value))) AS p) WHERE value <= s * p * (1 + 1e-12)) END::DOUBLE AS top FROM events")
def axis_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", p.nice_max(F.col("value")).alias("top"))


@query("lossy_decode", "SELECT event_id, event_type || chr(65533) || user_id AS text FROM events")
def lossy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a byte that isn't UTF-8, which becomes one replacement character."""
    data = F.concat(F.encode("event_type", "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.col("user_id").cast("string"), "UTF-8"))
    return table(spark, sf_dir, "events").select("event_id", p.decoded(data).alias("text"))


_CLUSTER_SQL = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' WHEN 2 THEN 'red' ELSE 'unknown' END AS cluster_status, event_id % 4 AS cluster_status_code, user_id AS active_shards, (event_id % 3)::BIGINT AS unassigned_shards, 0 AS pending_tasks FROM events"


@query("metric_cluster", _CLUSTER_SQL)
def metric_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster samples from health documents; a document without a status is unknown, and a missing count is 0."""
    status = F.element_at(F.array(*map(F.lit, ('"status":"green",', '"status":"yellow",', '"status":"red",', ""))), (F.col("event_id") % 4 + 1).cast("int"))
    body = F.concat(F.lit("{"), status, F.lit('"active_shards":'), F.col("user_id"), F.lit(',"unassigned_shards":'), F.col("event_id") % 3, F.lit("}"))
    return metrics.cluster(table(spark, sf_dir, "events").select("event_id", body.alias("body"))).select("event_id", "cluster_status", "cluster_status_code", "active_shards", "unassigned_shards", "pending_tasks")


@query("metric_index", "WITH r AS (SELECT event_id AS ts, 'logs-' || user_id % 5 AS index_name, event_id * 31 % 997 AS docs_count, event_id * 17 % 1009 AS indexing_total FROM events) SELECT ts, index_name, docs_count, greatest(coalesce(docs_count - lag(docs_count) OVER w, 0), 0)::BIGINT AS docs_delta, greatest(coalesce(indexing_total - lag(indexing_total) OVER w, 0), 0)::BIGINT AS indexing_delta, 1 AS pri, 0 AS rep FROM r WINDOW w AS (PARTITION BY index_name ORDER BY ts)")
def metric_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index samples from listings, hidden indices aside, with deltas of documents and operations."""
    k, name = F.col("event_id"), F.concat(F.lit("logs-"), F.col("user_id") % 5)
    body = F.concat(F.lit('[{"index":"'), name, F.lit('","health":"green","pri":"1","rep":null,"docs.count":"'), k * 31 % 997, F.lit('","store.size":"10"},{"index":".hidden","docs.count":"1"},{"index":"top_queries-1"}]'))
    rows = table(spark, sf_dir, "events")
    operations = rows.select(k.alias("ts"), name.alias("index"), (k * 17 % 1009).alias("indexing_total"))
    return metrics.indices(rows.select(k.alias("ts"), body.alias("body")), "ts", operations).select("ts", "index_name", "docs_count", "docs_delta", "indexing_delta", "pri", "rep")


@query("metric_node", "WITH r AS (SELECT event_id AS ts, 'os-' || user_id % 3 AS os_node, event_id * 13 % 1013 AS t, CASE WHEN event_id % 4 <> 0 THEN event_id * 7 % 101 END AS a, event_id % 1000 AS free FROM events) SELECT ts, os_node, round_even(100.0 * (1000 - free) / 1000, 1) AS disk_used_percent, greatest(coalesce(t - lag(t) OVER w, 0), 0)::BIGINT AS indexing_delta, coalesce(greatest(coalesce(CASE WHEN a IS NOT NULL THEN a - last_value(a IGNORE NULLS) OVER (PARTITION BY os_node ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, 0), 0), 0)::BIGINT AS admission_rejections_delta FROM r WINDOW w AS (PARTITION BY os_node ORDER BY ts)")
def metric_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node samples from status documents; a node that the rejections' listing lacks keeps its counter's state."""
    k, name = F.col("event_id"), F.concat(F.lit("os-"), F.col("user_id") % 3)
    body = F.concat(F.lit('{"name":"'), name, F.lit('","fs":{"total":{"total_in_bytes":1000,"available_in_bytes":'), k % 1000, F.lit('}},"indices":{"indexing":{"index_total":'), k * 13 % 1013, F.lit("}}}"))
    rows = table(spark, sf_dir, "events")
    rejections = rows.where(k % 4 != 0).select(k.alias("ts"), name.alias("os_node"), (k * 7 % 101).alias("admission_rejections_total"))
    return metrics.nodes(rows.select(k.alias("ts"), body.alias("body")), "ts", rejections).select("ts", "os_node", "disk_used_percent", "indexing_delta", "admission_rejections_delta")


@query("metric_dashboards", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unreachable' WHEN event_id % 5 = 1 THEN 'unknown' WHEN event_id % 5 = 2 THEN 'yellow' ELSE 'green' END AS osd_state, CASE WHEN event_id % 5 < 2 THEN 3 WHEN event_id % 5 = 2 THEN 1 ELSE 0 END AS osd_state_code, CASE WHEN event_id % 5 <> 0 THEN user_id END AS requests_total FROM events")
def metric_dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    status = F.when(k == 1, "").when(k == 2, '"status":{"overall":{"state":"yellow"}},').otherwise('"status":{"overall":{"state":"green"}},')
    body = F.when(k != 0, F.concat(F.lit("{"), status, F.lit('"metrics":{"requests":{"total":'), F.col("user_id"), F.lit("}}}")))
    return metrics.dashboards(table(spark, sf_dir, "events").select("event_id", body.alias("body"))).select("event_id", "osd_state", "osd_state_code", "requests_total")


@query("metric_fleet", f"WITH {LOG}, {ROSTER}, {METRICS} SELECT collector_id, CASE WHEN {AS_OF} - last_ms <= {3 * DAY} THEN 0 ELSE 1 END AS heartbeat_missing, {AS_OF} - last_ms AS heartbeat_age_ms, coalesce(fb_healthy, 0) AS fb_healthy FROM (SELECT DISTINCT collector_id FROM roster) LEFT JOIN (SELECT collector_id, max(ts) AS last_ms, arg_max(fb_healthy, (ts, event_id)) AS fb_healthy FROM metric_samples WHERE kind = 'fluentbit' GROUP BY collector_id) USING (collector_id)")
def metric_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fleet(metric_samples(spark, sf_dir).where("kind = 'fluentbit'"), roster(spark, sf_dir), AS_OF, 3 * DAY).select("collector_id", "heartbeat_missing", "heartbeat_age_ms", "fb_healthy")


_DELAYED = next(d for d in detection.DETECTORS if d.name == "il-per-epn")


@query("feature_window_delay", W + f"SELECT origin_host AS entity, collector_ms // {DAY} * {DAY} AS window_ms, count(message)::DOUBLE AS volume FROM log_events WHERE family = 'infologger' AND (collector_ms // {DAY} + 1) * {DAY} + 2 * {DAY} <= {AS_OF - 9 * DAY} GROUP BY ALL")
def feature_window_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of a detector that waits two of them: those whose delay had passed at a moment."""
    return detection.feature_rows(_DELAYED, log_events(spark, sf_dir), "collector_ms", 1440, as_of=AS_OF - 9 * DAY).select("entity", "window_ms", "volume")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _collected(spark: SparkSession, windows: DataFrame, keys: list[str], mode: str) -> DataFrame:
    place = f"{home(spark)}/stream-{uuid.uuid4().hex}"
    flat = windows.select(F.unix_millis("window.start").alias("window_ms"), *[c for c in windows.columns if c != "window"])
    jobs.run_once(flat, jobs.upsert_each(f"{place}/rows", keys), f"{place}/checkpoint", mode)
    return spark.read.schema(flat.schema).parquet(f"{place}/rows")


@query("stream_sliding_counts", f"SELECT s AS window_ms, event_type, count(*)::BIGINT AS n FROM (SELECT event_type, unnest(range(epoch_us(ts) // 1000 // {DAY} * {DAY} - {4 * DAY}, epoch_us(ts) // 1000 // {DAY} * {DAY} + 1, {DAY})) AS s FROM events) GROUP BY ALL")
def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over five days, every day, by a stream: a record is in five windows."""
    return _collected(spark, jobs.sliding(_stream(spark, sf_dir), "ts", "5 days", "1 day", "2 minutes", ["event_type"], F.count("*").alias("n")), ["window_ms", "event_type"], "update")


@query("stream_closed_windows", f"SELECT epoch_us(ts) // 1000 // {DAY} * {DAY} AS window_ms, count(*)::BIGINT AS n FROM events WHERE (epoch_us(ts) // 1000 // {DAY} + 1) * {DAY} <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 120000 GROUP BY 1")
def stream_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that have closed, two minutes after their end, by a stream in append mode: the day that goes on isn't there."""
    return _collected(spark, jobs.tumbling(_stream(spark, sf_dir), "ts", "1 day", "2 minutes", [], F.count("*").alias("n")), ["window_ms"], "append")
