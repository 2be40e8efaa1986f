"""Queries of scoring, quality gates, status reports and panels (inventory N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import parsing as p
from skerry.operators import aggregates as a
from skerry.operators import evaluation as v
from skerry.operators import quality
from skerry.plans.projection import FOLD_SQL, SIGNALS_SQL, monitor_episodes, signals
from skerry.plans.registry import query
from skerry.session import AS_OF, DAY
from skerry.sources.adapters import ALERTS, LOG, METRICS, ROSTER, alerts, log_events, metric_samples, roster, table

W, M, S = f"WITH {LOG} ", f"WITH {METRICS} ", f"WITH {SIGNALS_SQL} "


@query("purity", S + "SELECT incident_id, count(DISTINCT entity_id)::BIGINT AS n_entity_id, count(DISTINCT collector_id)::BIGINT AS n_collector_id, count(DISTINCT topology_version)::BIGINT AS n_topology_version, count(DISTINCT entity_kind)::BIGINT AS n_entity_kind FROM (SELECT *, 'v' || (length(source_id) % 3) AS topology_version FROM signals) GROUP BY incident_id HAVING count(DISTINCT topology_version) > 1 OR count(DISTINCT entity_id) > 1 OR count(DISTINCT collector_id) > 1 OR count(DISTINCT entity_kind) > 1")
def purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.impure(signals(spark, sf_dir).withColumn("topology_version", F.concat(F.lit("v"), (F.length("source_id") % 3).cast("string"))))


@query("fragmentation", S + "SELECT alertname, entity_kind, count(DISTINCT incident_id || topic)::BIGINT AS incidents, count(DISTINCT entity_id)::BIGINT AS entities FROM (SELECT *, length(source_id)::VARCHAR AS topic FROM signals) GROUP BY alertname, entity_kind HAVING count(DISTINCT incident_id || topic) > count(DISTINCT entity_id)")
def fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = signals(spark, sf_dir).withColumn("incident_id", F.concat("incident_id", F.length("source_id").cast("string")))
    return v.fragmented(split)


@query("time_to_notify", S + "SELECT incident_id, n - s AS wait_ms FROM (SELECT incident_id, min(first_seen) AS s, min(CASE WHEN state = 'resolved' THEN last_seen END) AS n FROM signals GROUP BY incident_id)")
def time_to_notify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir)
    starts = rows.groupBy("incident_id").agg(F.min("first_seen").alias("start"))
    return v.time_to(rows.where("state = 'resolved'"), starts, "incident_id", "last_seen", "start", "wait_ms")


@query("scorecard", S + "SELECT 'unprojected' AS rule, count(*)::BIGINT AS n, count(*) = 0 AS passed FROM alerts WHERE monitor_name = 'no-such-monitor' UNION ALL SELECT 'impure', count(*), count(*) = 0 FROM (SELECT incident_id FROM signals GROUP BY incident_id HAVING count(DISTINCT entity_id) > 1) UNION ALL SELECT 'unlabelled', count(*), count(*) = 0 FROM signals WHERE entity_id IS NULL OR collector_id = ''")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skerry.sources.adapters import alerts

    rows = signals(spark, sf_dir)
    return v.verdict(unprojected=v.unprojected(alerts(spark, sf_dir), "id", rows, "monitor"), impure=v.impure(rows.withColumn("topology_version", F.lit("v"))), unlabelled=quality.unlabelled(rows, ["entity_id", "collector_id"]))


@query("poison_score", "SELECT k AS detector, count(*)::BIGINT AS evaluations, count(*) FILTER (g > 0.5)::BIGINT AS raw_hits, round(max(g), 6) AS max_grade, round(max(c), 6) AS max_confidence, count(DISTINCT CASE WHEN g > 0.5 THEN w END)::BIGINT AS windows, count(*) FILTER (g > 0.5) > 0 AS detected FROM (SELECT user_id % 10 AS k, value / 490.0 AS g, (event_id % 100) / 100.0 AS c, epoch_us(ts) // 1000 // 86400000 AS w FROM events WHERE event_id % 50 <> 0) GROUP BY k")
def poison_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each detector made of a poisoned window: evaluations, hits, the best grade and distinct windows."""
    rows = table(spark, sf_dir, "events").where("event_id % 50 <> 0").select((F.col("user_id") % 10).alias("detector"), (F.col("value") / 490.0).alias("grade"), ((F.col("event_id") % 100) / 100.0).alias("confidence"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / DAY).alias("window"))
    return quality.detector_scores(rows)


@query("gate_roster_order", f"WITH {LOG}, {ROSTER} SELECT topology_version, effective_from FROM (SELECT DISTINCT topology_version, effective_from FROM roster) QUALIFY lag(effective_from) OVER (ORDER BY topology_version) >= effective_from")
def gate_roster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that take effect no later than the one before them; none may."""
    return quality.disordered(roster(spark, sf_dir).select("topology_version", "effective_from").distinct(), "topology_version", "effective_from")


@query("gate_unknown_collectors", f"WITH {LOG}, {ROSTER}, {METRICS} SELECT DISTINCT collector_id FROM metric_samples WHERE collector_id NOT IN (SELECT collector_id FROM roster WHERE topology_version = 'v0')")
def gate_unknown_collectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_samples(spark, sf_dir).select("collector_id").subtract(roster(spark, sf_dir).where("topology_version = 'v0'").select("collector_id"))


@query("gate_field_presence", W + "SELECT family, count(*)::BIGINT AS n, count(*) FILTER (severity_norm IS NULL OR severity_norm = 'unknown')::BIGINT AS no_severity, count(*) FILTER (origin_host IS NULL)::BIGINT AS no_host, count(*) FILTER (ingest_lag_ms < 0)::BIGINT AS negative_lag FROM log_events GROUP BY family")
def gate_field_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_events(spark, sf_dir)
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.count_if(F.col("severity_norm").isNull() | (F.col("severity_norm") == "unknown")).alias("no_severity"), F.count_if(F.col("origin_host").isNull()).alias("no_host"), F.count_if(F.col("ingest_lag_ms") < 0).alias("negative_lag"))


@query("gate_generated_vs_declared", "SELECT name FROM ((SELECT DISTINCT event_type AS name FROM events EXCEPT SELECT unnest(['click', 'view', 'vanished'])) UNION (SELECT unnest(['click', 'view', 'vanished']) EXCEPT SELECT DISTINCT event_type FROM events))")
def gate_generated_vs_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = spark.createDataFrame([("click",), ("view",), ("vanished",)], "name string")
    return quality.symmetric_difference(table(spark, sf_dir, "events").select(F.col("event_type").alias("name")), declared)


@query("status_clocks", W + f"SELECT family, min(collector_ms) AS first_ms, max(collector_ms) AS last_ms, {AS_OF} - max(collector_ms) AS idle_ms, count(*)::BIGINT AS n FROM log_events GROUP BY family")
def status_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).groupBy("family").agg(F.min("collector_ms").alias("first_ms"), F.max("collector_ms").alias("last_ms"), (F.lit(AS_OF) - F.max("collector_ms")).alias("idle_ms"), F.count("*").alias("n"))


_SEARCHES = {
    "errors": ("severity_norm in ('error', 'fatal')", "severity_norm IN ('error', 'fatal')"),
    "warnings": ("severity_norm = 'warning'", "severity_norm = 'warning'"),
    "not_info": ("coalesce(severity_norm, '') <> 'info'", "coalesce(severity_norm, '') <> 'info'"),
    "one_host": ("origin_host = 'epn000003'", "origin_host = 'epn000003'"),
    "host_prefix": ("origin_host like 'epn00001%'", "origin_host LIKE 'epn00001%'"),
    "one_node": ("node = 'node-02'", "node = 'node-02'"),
    "family_local": ("family = 'local'", "family = 'local'"),
    "slow_entry": ("enter_system_lag_ms >= 250", "enter_system_lag_ms >= 250"),
}


def _search(name: str, where: str, sql: str) -> None:
    @query(f"search_{name}", W + f"SELECT event_id, collector_ms, origin_host, severity_norm FROM log_events WHERE {sql} ORDER BY collector_ms DESC, event_id DESC")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A saved search: all records that match, the last first."""
        return log_events(spark, sf_dir).where(where).select("event_id", "collector_ms", "origin_host", "severity_norm").orderBy(F.desc("collector_ms"), F.desc("event_id"))


for _name, (_where, _sql) in _SEARCHES.items():
    _search(_name, _where, _sql)


@query("search_text", "SELECT doc_id FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), ['tcp', 'connection', 'refused', 'timeout', 'worthless'])")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(p.any_token(F.col("text"), "tcp", "connection", "refused", "timeout", "worthless")).select("doc_id")


def _signals(name: str, where: str) -> None:
    @query(f"search_signals_{name}", S + f"SELECT source_id, alertname, severity, last_seen FROM signals WHERE {where} ORDER BY severity, last_seen DESC, source_id")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return signals(spark, sf_dir).where(where).select("source_id", "alertname", "severity", "last_seen").orderBy("severity", F.desc("last_seen"), "source_id")


for _name, _where in {"firing": "state = 'firing'", "resolved": "state = 'resolved'", "all": "true"}.items():
    _signals(_name, _where)


@query("search_alerts_active", f"WITH {ALERTS} SELECT id, monitor_name, severity, state, start_time FROM alerts WHERE state = 'ACTIVE' ORDER BY start_time DESC, id")
def search_alerts_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(spark, sf_dir).where("state = 'ACTIVE'").select("id", "monitor_name", "severity", "state", "start_time").orderBy(F.desc("start_time"), "id")


def _episodes(name: str, where: str, latest: str) -> None:
    @query(f"search_episodes_{name}", f"{FOLD_SQL} SELECT episode_id, incident_id, severity, episode_state, opened_at, last_seen, resolved_at FROM episodes WHERE {where} ORDER BY {latest} DESC, episode_id")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A saved search over the episodes of monitors, the latest first."""
        return monitor_episodes(spark, sf_dir).where(where).select("episode_id", "incident_id", "severity", "episode_state", "opened_at", "last_seen", "resolved_at").orderBy(F.desc(latest), "episode_id")


for _name, _where, _latest in (("open", "state = 'firing'", "last_seen"), ("history", "true", "opened_at"), ("resolved", "state = 'resolved'", "resolved_at")):
    _episodes(_name, _where, _latest)


@query("panel_distribution", W + "SELECT family, round(quantile_cont(enter_system_lag_ms, 0.5), 3) AS p50, round(quantile_cont(enter_system_lag_ms, 0.95), 3) AS p95, max(enter_system_lag_ms) AS most FROM log_events GROUP BY family")
def panel_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lag = "enter_system_lag_ms"
    return log_events(spark, sf_dir).groupBy("family").agg(F.round(F.percentile(lag, F.lit(0.5)), 3).alias("p50"), a.p95(lag).alias("p95"), F.max(lag).alias("most"))


@query("panel_worst_hosts", W + "SELECT origin_host, sum(CASE WHEN severity_norm = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors, count(*)::BIGINT AS n FROM log_events GROUP BY origin_host ORDER BY errors DESC, origin_host LIMIT 10")
def panel_worst_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).groupBy("origin_host").agg(F.sum(F.when(F.col("severity_norm") == "error", 1).otherwise(0)).alias("errors"), F.count("*").alias("n")).orderBy(F.desc("errors"), "origin_host").limit(10)


@query("panel_fleet_counters", M + "SELECT ts // 86400000 * 86400000 AS bucket_ms, collector_id, sum(output_records_delta)::BIGINT AS records, sum(output_errors_delta)::BIGINT AS errors, sum(output_dropped_delta)::BIGINT AS dropped FROM metric_samples WHERE kind = 'fluentbit' GROUP BY ALL")
def panel_fleet_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metric_samples(spark, sf_dir).where("kind = 'fluentbit'")
    return rows.groupBy((F.floor(F.col("ts") / DAY) * DAY).alias("bucket_ms"), "collector_id").agg(F.sum("output_records_delta").alias("records"), F.sum("output_errors_delta").alias("errors"), F.sum("output_dropped_delta").alias("dropped"))


@query("panel_status_strip", M + "SELECT kind, count(*)::BIGINT AS n, max(ts) AS last_ms, max(CASE WHEN kind = 'cluster' THEN cluster_status_code END)::BIGINT AS worst_status, min(CASE WHEN kind = 'fluentbit' THEN fb_healthy END)::INTEGER AS healthy FROM metric_samples GROUP BY kind")
def panel_status_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_samples(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.max("ts").alias("last_ms"), F.max(F.when(F.col("kind") == "cluster", F.col("cluster_status_code"))).alias("worst_status"), F.min(F.when(F.col("kind") == "fluentbit", F.col("fb_healthy"))).alias("healthy"))


@query("ops_snapshot", W + f"SELECT family, count(*)::BIGINT AS n, count(*) FILTER (collector_ms >= {AS_OF - 2 * DAY})::BIGINT AS recent, count(*) FILTER (severity_norm = 'error' AND collector_ms >= {AS_OF - 2 * DAY})::BIGINT AS recent_errors FROM log_events GROUP BY family")
def ops_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = F.col("collector_ms") >= AS_OF - 2 * DAY
    return log_events(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"), F.count_if(recent).alias("recent"), F.count_if(recent & (F.col("severity_norm") == "error")).alias("recent_errors"))


@query("soak_report", M + "SELECT collector_id, offered, delivered, round(100.0 * (offered - delivered) / offered, 4) AS undelivered_percent, lost FROM (SELECT collector_id, sum(output_records_delta)::BIGINT AS offered, (sum(output_records_delta) - sum(output_dropped_delta) - sum(output_errors_delta))::BIGINT AS delivered, sum(output_dropped_delta)::BIGINT AS lost FROM metric_samples WHERE kind = 'fluentbit' GROUP BY collector_id) WHERE offered > 0")
def soak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metric_samples(spark, sf_dir).where("kind = 'fluentbit'").groupBy("collector_id").agg(F.sum("output_records_delta").alias("offered"), (F.sum("output_records_delta") - F.sum("output_dropped_delta") - F.sum("output_errors_delta")).alias("delivered"), F.sum("output_dropped_delta").alias("lost"))
    return got.where("offered > 0").withColumn("undelivered_percent", F.round(100.0 * (F.col("offered") - F.col("delivered")) / F.col("offered"), 4))


@query("backtest_window", W + f"SELECT count(*)::BIGINT AS results, count(*) FILTER (event_id % 50 = 0)::BIGINT AS historical, min(collector_ms) AS from_ms, least(max(collector_ms), min(collector_ms) + {20 * DAY}) AS until_ms FROM log_events")
def backtest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).agg(F.count("*").alias("results"), F.count_if(F.col("event_id") % 50 == 0).alias("historical"), F.min("collector_ms").alias("from_ms"), F.least(F.max("collector_ms"), F.min("collector_ms") + 20 * DAY).alias("until_ms"))
