"""Queries of notification scoring, further gates, outage probes, synthetic sources and a stream (inventory A, I, M, N)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.operators import joins as j
from skerry.operators import ordered
from skerry.plans.projection import SIGNALS_SQL, signals
from skerry.plans.registry import query
from skerry.plans.rollups import META_SQL, ROLL_SQL, rolled, rolled_meta
from skerry.session import DAY
from skerry.sources import logs, sinks
from skerry.sources.adapters import LOG, METRICS, log_events, metric_samples, table
from skerry.sources.shared import home
from skerry.streaming import jobs

W, M, S = f"WITH {LOG} ", f"WITH {METRICS} ", f"WITH {SIGNALS_SQL} "
BREAK_GLASS = ("signal-projector-stale", "alertmanager-down")


@query("unlinked_notifications", "SELECT event_id AS note FROM events WHERE event_type = 'error' AND event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AND user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unlinked_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications that name no known signal and no known episode."""
    o = table(spark, sf_dir, "orders")
    by_id = (o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("event_id")), "event_id")
    by_episode = (o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id")), "user_id")
    return j.uncovered(table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id"), by_id, by_episode).select(F.col("event_id").alias("note"))


@query("group_purity", S + "SELECT 'logs/' || alertname || '/' || scope_label AS group_id, count(DISTINCT alertname)::BIGINT AS names, count(DISTINCT scope_label)::BIGINT AS scopes, count(DISTINCT incident_id)::BIGINT AS incidents FROM signals GROUP BY 1")
def group_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).groupBy("group_id").agg(F.count_distinct("alertname").alias("names"), F.count_distinct("scope_label").alias("scopes"), F.count_distinct("incident_id").alias("incidents"))


@query("break_glass", "SELECT event_id, name FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'signal-projector-stale' WHEN 1 THEN 'alertmanager-down' ELSE 'data-loss' END AS name, user_id % 2 AS direct FROM events) WHERE name IN ('signal-projector-stale', 'alertmanager-down') AND direct = 0")
def break_glass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Break-glass alerts that did not go out on the direct path."""
    name = F.when(F.col("event_id") % 4 == 0, BREAK_GLASS[0]).when(F.col("event_id") % 4 == 1, BREAK_GLASS[1]).otherwise("data-loss")
    rows = table(spark, sf_dir, "events").select("event_id", name.alias("name"), (F.col("user_id") % 2).alias("direct"))
    return rows.where(F.col("name").isin(*BREAK_GLASS) & (F.col("direct") == 0)).select("event_id", "name")


@query("false_inhibition", S + "SELECT s.source_id FROM signals s WHERE s.severity = 'page' AND s.alertname = 'data-loss' AND s.state = 'firing' AND NOT EXISTS (SELECT 1 FROM signals c WHERE c.alertname = 'collector-down' AND c.state = 'firing' AND c.collector_id = s.collector_id)")
def false_inhibition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that would have been muted although no cause fires for their collector."""
    rows = signals(spark, sf_dir)
    causes = rows.where("alertname = 'collector-down' and state = 'firing'").select("collector_id")
    pages = rows.where("severity = 'page' and alertname = 'data-loss' and state = 'firing'")
    return pages.join(causes, "collector_id", "left_anti").select("source_id")


@query("recall", S + "SELECT alertname, count(DISTINCT source_id)::BIGINT AS raw, count(DISTINCT CASE WHEN state = 'firing' THEN source_id END)::BIGINT AS firing, round(count(DISTINCT CASE WHEN state = 'firing' THEN source_id END) / count(DISTINCT source_id), 4) AS share FROM signals GROUP BY alertname")
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    firing = F.count_distinct(F.when(F.col("state") == "firing", F.col("source_id")))
    got = signals(spark, sf_dir).groupBy("alertname").agg(F.count_distinct("source_id").alias("raw"), firing.alias("firing"))
    return got.withColumn("share", F.round(F.col("firing") / F.col("raw"), 4))


@query("gate_commit_cover", f"WITH {META_SQL} SELECT ts FROM meta GROUP BY ts HAVING count(*) <> 5 OR bool_or(truncated)")
def gate_commit_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets that lack a cohort or were cut."""
    got = rolled_meta(spark, sf_dir).groupBy("ts").agg(F.count("*").alias("n"), F.bool_or("truncated").alias("cut"))
    return got.where("n <> 5 or cut").select("ts")


@query("gate_imputed_fleet", f"WITH {ROLL_SQL} SELECT ts, family, entity_kind FROM (SELECT * FROM rollup UNION ALL SELECT * FROM imputed) GROUP BY ts, family, entity_kind HAVING sum(doc_count) <> max(fleet_count) OR min(fleet_count) <> max(fleet_count)")
def gate_imputed_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts whose rows don't add up to their fleet; imputed zeros must not change it."""
    got = rolled(spark, sf_dir).groupBy("ts", "family", "entity_kind").agg(F.sum("doc_count").alias("n"), F.max("fleet_count").alias("a"), F.min("fleet_count").alias("b"))
    return got.where("n <> a or a <> b").select("ts", "family", "entity_kind")


@query("gate_sample_gaps", M + f"SELECT kind, from_ms, ts AS until_ms, (ts - from_ms) // {DAY // 4} AS missing FROM (SELECT kind, ts, lag(ts) OVER (PARTITION BY kind ORDER BY ts) AS from_ms FROM metric_samples) WHERE ts - from_ms > {DAY // 4}")
def gate_sample_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skerry.operators import quality

    return quality.missing_intervals(metric_samples(spark, sf_dir).select("kind", "ts"), "kind", "ts", DAY // 4).select("kind", "from_ms", "until_ms", "missing")


@query("outage_alert", "SELECT event_id, user_id, CASE WHEN f AND p THEN 'firing' WHEN NOT f AND p AND pp THEN 'resolved' END AS state FROM (SELECT event_id, user_id, event_type = 'error' AS f, lag(event_type = 'error') OVER w AS p, lag(event_type = 'error', 2) OVER w AS pp FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE (f AND p) OR (NOT f AND p AND pp)")
def outage_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert that bypasses the store: fires on a probe's second failure in a row, resolves on the next success."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    bad = F.col("event_type") == "error"
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", bad.alias("f"), F.lag(bad).over(w).alias("p"), F.lag(bad, 2).over(w).alias("pp"))
    return rows.select("event_id", "user_id", F.when(F.col("f") & F.col("p"), "firing").when(~F.col("f") & F.col("p") & F.col("pp"), "resolved").alias("state")).where("state is not null")


@query("webhook_rows", """SELECT CASE WHEN event_id % 3 = 0 THEN 'group' WHEN event_id % 3 = 1 THEN 'action' ELSE 'message' END AS record_kind, count(DISTINCT k)::BIGINT AS n FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'g' || user_id WHEN 1 THEN event_type ELSE 'none' END || '/' || epoch_us(ts) // 60000000 AS k FROM events) GROUP BY 1""")
def webhook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications by kind; repeats within a minute are one."""
    body = F.expr("""CASE event_id % 3 WHEN 0 THEN concat('{"status":"firing","groupKey":"g', user_id, '","alerts":[{"labels":{"alertname":"x"}}]}') WHEN 1 THEN concat('{"monitor_name":"', event_type, '"}') ELSE '{"message":"m"}' END""")
    rows = table(spark, sf_dir, "events").select(body.alias("body"), F.unix_millis(F.col("ts").cast("timestamp")).alias("received_ms"))
    return sinks.webhook_rows(rows).groupBy("record_kind").agg(F.count("*").alias("n"))


@query("synthetic_logs", "SELECT severity, count(*)::BIGINT AS n FROM (SELECT CASE WHEN id * 7919 % 1000 < 900 THEN 'I' WHEN id * 7919 % 1000 < 980 THEN 'W' WHEN id * 7919 % 1000 < 995 THEN 'E' ELSE 'F' END AS severity FROM range(50000) t(id)) GROUP BY severity")
def synthetic_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities of generated records: 90, 8, 1.5 and 0.5 percent, by a fixed rule."""
    k = F.col("id") * 7919 % 1000
    severity = F.when(k < 900, "I").when(k < 980, "W").when(k < 995, "E").otherwise("F")
    return spark.range(50_000).groupBy(severity.alias("severity")).agg(F.count("*").alias("n"))


@query("strict_mapping", "SELECT count(*)::BIGINT AS accepted FROM events WHERE event_id % 7 <> 0")
def strict_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a strict mapping takes: none of their keys is unknown."""
    line = F.expr("""CASE WHEN event_id % 7 = 0 THEN concat('{"id":', event_id, ',"extra":1}') ELSE concat('{"id":', event_id, ',"kind":"', event_type, '"}') END""")
    return logs.strict_fields(table(spark, sf_dir, "events").select(line.alias("value")), ["id", "kind"]).agg(F.count("*").alias("accepted"))


@query("families_union", W + "SELECT count(*)::BIGINT AS n, count(node)::BIGINT AS with_node, count(errcode)::BIGINT AS with_errcode FROM (SELECT node, NULL AS errcode FROM log_events WHERE family = 'local' UNION ALL SELECT NULL, event_id FROM log_events WHERE family = 'infologger')")
def families_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over tables of different columns, as over an index pattern."""
    rows = log_events(spark, sf_dir)
    both = logs.union_all(rows.where("family = 'local'").select("node"), rows.where("family = 'infologger'").select(F.col("event_id").alias("errcode")))
    return both.agg(F.count("*").alias("n"), F.count("node").alias("with_node"), F.count("errcode").alias("with_errcode"))


@query("latest_upsert", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What upserts by key leave: of each key the latest row of the batch that wrote it last."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("user_id") % 8).alias("part"))
    path = f"{home(spark)}/upsert-{uuid.uuid4().hex}"
    for batch in (rows.where("event_id % 2 = 0"), rows.where("user_id % 8 < 4"), rows, rows):
        sinks.upsert(batch, path, ["user_id"], "part", "event_id")
    return spark.read.parquet(path).select("user_id", "event_id")


@query("snapshot_change", f"WITH {LOG} SELECT day, hosts FROM (SELECT collector_ms // {DAY} AS day, count(DISTINCT origin_host)::BIGINT AS hosts, lag(count(DISTINCT origin_host)) OVER (ORDER BY collector_ms // {DAY}) AS before FROM log_events GROUP BY 1) WHERE before IS NULL OR before <> hosts")
def snapshot_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose fleet differs from the day before: what a create-only sink would append."""
    days = log_events(spark, sf_dir).groupBy(F.floor(F.col("collector_ms") / DAY).alias("day")).agg(F.count_distinct("origin_host").alias("hosts"))
    w = Window.partitionBy(F.lit(0)).orderBy("day")
    return days.withColumn("before", F.lag("hosts").over(w)).where("before is null or before <> hosts").drop("before")


@query("stream_daily_counts", f"WITH {LOG} SELECT collector_ms // {DAY} * {DAY} AS window_ms, family, count(*)::BIGINT AS n FROM log_events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by a stream that reads what is there, upserts every batch and stops."""
    place = f"{home(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    family = F.when(F.col("user_id") % 3 == 0, "infologger").when(F.col("user_id") % 3 == 1, "local").otherwise("central")
    counted = jobs.tumbling(rows.withColumn("family", family), "ts", "1 day", "2 minutes", ["family"], F.count("*").alias("n"))
    flat = counted.select(F.unix_millis("window.start").alias("window_ms"), "family", "n")
    jobs.run_once(flat, jobs.upsert_each(f"{place}/counts", ["window_ms", "family"]), f"{place}/checkpoint")
    return spark.read.parquet(f"{place}/counts")
