"""Queries of boards, payloads, quality gates, status reports and panels (inventory D, M, N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry import catalog
from skerry.operators import aggregates as a
from skerry.operators import detection, monitors, quality
from skerry.operators import evaluation as v
from skerry.operators import projection as j
from skerry.plans.projection import _EP, _MON, SIGNALS_SQL, _results, incidents, signals
from skerry.plans.registry import query
from skerry.plans.rollups import META_SQL, ROLL_SQL, rolled, rolled_meta
from skerry.session import AS_OF, DAY
from skerry.sources.adapters import ALERTS, LOG, METRICS, ROSTER, alerts, log_events, metric_samples, roster, table

W, M, S = f"WITH {LOG} ", f"WITH {METRICS} ", f"WITH {SIGNALS_SQL} "

#: Episodes with what a board reads: a grade, a state and a severity.
_OPEN = f"""{_EP}, open AS (SELECT *, round((last_seen // 1000 % 997) / 997.0, 4) AS worst_grade, CASE WHEN last_seen // 1000 % 3 = 0 THEN 'STALE' ELSE 'OPEN' END AS episode_state, CASE WHEN length(entity_id) % 2 = 0 THEN 'page' ELSE 'warn' END AS severity FROM eps WHERE fires)"""


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor(F.col("last_seen") / 1000)
    return incidents(spark, sf_dir).select(
        "*", F.round(k % 997 / 997.0, 4).alias("worst_grade"), F.when(k % 3 == 0, "STALE").otherwise("OPEN").alias("episode_state"), F.when(F.length("entity_id") % 2 == 0, "page").otherwise("warn").alias("severity")
    )


@query("episode_board", f"WITH {_OPEN} SELECT group_id, count(*)::BIGINT AS episodes, min(opened_at) AS opened, max(last_seen) AS last, sum(member_count)::BIGINT AS members, max(worst_grade) AS worst, count(DISTINCT entity_id)::BIGINT AS entity_total, count(*) FILTER (episode_state = 'OPEN')::BIGINT AS opens, count(*) FILTER (episode_state = 'STALE')::BIGINT AS stales, count(*) FILTER (severity = 'page')::BIGINT AS pages, (SELECT string_agg(entity_id || ':' || kid_last || ':' || kid_pages, ',' ORDER BY kid_last DESC, entity_id) FROM (SELECT entity_id, max(last_seen) AS kid_last, count(*) FILTER (severity = 'page') AS kid_pages FROM open k WHERE k.group_id = o.group_id GROUP BY entity_id ORDER BY kid_last DESC, entity_id LIMIT {j.CHILD_ROWS})) AS children FROM open o GROUP BY group_id")
def episode_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board: a card a group of open episodes, with its latest entities below it."""
    listed = F.transform("children", lambda c: F.concat_ws(":", c["entity_id"], c["kid_last"].cast("string"), c["pages"].cast("string")))
    return j.board(_episodes(spark, sf_dir)).withColumn("children", F.array_join(listed, ","))


@query("mass_silence_class", f"WITH {_EP}, m AS (SELECT CASE WHEN bool_or(alertname = 'fleet-fb-silence') OR count(DISTINCT CASE WHEN alertname = 'collector-down' THEN entity_id END) >= 20 THEN 'unknown-mass-silence' END AS mass FROM signals WHERE state = 'firing' AND class = 'single') SELECT incident_id, CASE WHEN mass IS NOT NULL AND fires AND class = 'single' AND alertname IN ('fleet-fb-silence', 'collector-down') THEN mass ELSE class END AS class FROM eps, m")
def mass_silence_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode's class once the fleet's silence is known."""
    return j.with_mass_class(incidents(spark, sf_dir), j.mass_silence(signals(spark, sf_dir), 40)).select("incident_id", "class")


@query("alert_annotations", f"WITH {_EP} SELECT incident_id, 'monitor' AS source, 'none' AS family, CASE WHEN entity_kind = 'fleet' OR entity_id IN ('all', 'none') THEN 'whole fleet' ELSE CASE entity_kind WHEN 'epn' THEN 'EPN' WHEN 'os_node' THEN 'search node' ELSE entity_kind END || ' ' || entity_id END AS affected, member_count::VARCHAR AS member_count, 'false' AS signal_ids_truncated, class, group_id, 17 AS annotations, 9 AS labels, true AS has_text, true AS names_entity FROM eps")
def alert_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels and annotations of what is sent: a title and a diagnosis that names the entity are never empty."""
    rows = incidents(spark, sf_dir).select("*", F.col("incident_id").alias("episode_id"), F.lit("warn").alias("severity"), F.lit("logs").alias("cluster_id"), F.col("last_seen").alias("resolved_at"))
    sent = j.payloads(rows, presentation=catalog.presentation(spark))
    note, label = F.col("annotations"), F.col("labels")
    return sent.select(
        note["incident_id"].alias("incident_id"), label["source"].alias("source"), label["family"].alias("family"), *[note[c].alias(c) for c in ("affected", "member_count", "signal_ids_truncated", "class", "group_id")],
        F.size(note).alias("annotations"), F.size(label).alias("labels"), ((note["title"] != "") & (note["operator_action"] != "")).alias("has_text"), note["diagnosis"].contains(label["entity_id"]).alias("names_entity"),
    )


@query("topology_restart", S + "SELECT split_part(incident_id, '@', 1) AS incident_id, count(DISTINCT r)::BIGINT AS episodes, count(*)::BIGINT AS signals FROM (SELECT incident_id, sum(t) OVER (PARTITION BY incident_id ORDER BY first_seen, last_seen, source_id) AS r FROM (SELECT *, coalesce((v <> lag(v) OVER (PARTITION BY incident_id ORDER BY first_seen, last_seen, source_id))::INTEGER, 0) AS t FROM (SELECT *, 'v' || first_seen // 604800000 % 3 AS v FROM signals))) GROUP BY 1")
def topology_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each incident has once a change of topology starts a new one."""
    rows = signals(spark, sf_dir).withColumn("topology_version", F.concat(F.lit("v"), (F.floor(F.col("first_seen") / (7 * DAY)) % 3).cast("string")))
    got = j.restarted(rows).select(F.split("incident_id", "@")[0].alias("incident"), "incident_id")
    return got.groupBy(F.col("incident").alias("incident_id")).agg(F.count_distinct("incident_id").alias("episodes"), F.count("*").alias("signals"))


_STALE = f"SELECT user_id % 7 AS alertname, {AS_OF} - (event_id % 900) * 1000 AS since FROM events WHERE event_id % 3 = 0"


@query("stale_dwell", f"SELECT alertname, count(*)::BIGINT AS stale_episodes, list_sort(list({AS_OF} - since))[CAST(round_even(0.5 * (count(*) - 1), 0) AS BIGINT) + 1] AS stale_dwell_p50_ms, list_sort(list({AS_OF} - since))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1] AS stale_dwell_p95_ms FROM ({_STALE}) GROUP BY alertname")
def stale_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long stale episodes of each detector have waited."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("alertname"), F.when(F.col("event_id") % 3 == 0, "STALE").otherwise("OPEN").alias("episode_state"), (F.lit(AS_OF) - F.col("event_id") % 900 * 1000).alias("stale_since"))
    return j.dwell(rows, AS_OF, ["alertname"])


@query("time_to_resolve", S + "SELECT incident_id, t - s AS resolve_ms FROM (SELECT incident_id, min(first_seen) AS s, max(end_time) AS t FROM signals GROUP BY incident_id)")
def time_to_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an incident's first signal to the last end that any of its signals has."""
    return signals(spark, sf_dir).groupBy("incident_id").agg((F.max("end_time") - F.min("first_seen")).alias("resolve_ms"))


@query("dropped_results", W + "SELECT reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN event_id % 3 <> 0 AND event_id % 17 = 0 THEN 'no grade' WHEN user_id % 4 = 3 THEN 'unknown detector' WHEN event_id % 10 = 9 THEN 'no category' WHEN event_id % 13 = 0 THEN 'wrong category' END AS reason FROM log_events WHERE event_id % 50 <> 0) WHERE reason IS NOT NULL GROUP BY reason")
def dropped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector results that become no signal, by why."""
    rows = _results(spark, sf_dir).join(F.broadcast(catalog.detectors(spark).select("alertname", "entity_column")), "alertname", "left")
    named = rows.withColumn("category", F.when(F.col("source_id").cast("long") % 13 == 0, "no_such_field").otherwise(F.col("entity_column"))).drop("entity_column")
    return j.dropped_results(named, catalog.detectors(spark))


@query("gate_category_agreement", W + "SELECT 'wrong category' AS reason, count(*)::BIGINT AS n FROM log_events WHERE event_id % 50 <> 0 AND NOT (event_id % 3 <> 0 AND event_id % 17 = 0) AND user_id % 4 <> 3 AND event_id % 10 <> 9 AND event_id % 13 = 0 HAVING count(*) > 0")
def gate_category_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that name their entity by another field than their detector declares; none may."""
    return dropped_results(spark, sf_dir).where("reason = 'wrong category'")


@query("gate_signal_labels", S + "SELECT label, n FROM (SELECT 'end_time' AS label, count(*) FILTER (end_time IS NULL)::BIGINT AS n FROM signals UNION ALL SELECT 'entity_id', count(*) FILTER (entity_id IS NULL OR entity_id = '') FROM signals UNION ALL SELECT 'collector_id', count(*) FILTER (collector_id IS NULL OR collector_id = '') FROM signals UNION ALL SELECT 'severity', count(*) FILTER (severity IS NULL) FROM signals) WHERE n > 0")
def gate_signal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that some signal lacks; an end may be missing, an identity may not."""
    return quality.empty_labels(signals(spark, sf_dir), ["entity_id", "collector_id", "severity", "end_time"])


@query("gate_episode_grouping", f"WITH {_EP} SELECT count(*)::BIGINT AS episodes, count(DISTINCT group_id)::BIGINT AS groups, count(*) FILTER (group_id IS NULL AND last_seen >= {AS_OF - 400 * DAY})::BIGINT AS ungrouped, count(*) FILTER (entity_id = 'none' AND class NOT IN ('monitor-error', 'entity-missing') AND last_seen >= {AS_OF - 400 * DAY})::BIGINT AS anonymous, (SELECT max(n) FROM (SELECT count(*)::BIGINT AS n FROM eps WHERE fires GROUP BY group_id)) AS widest FROM eps WHERE fires")
def gate_episode_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open episodes and their groups; none may lack a group, and none may name nobody."""
    return quality.grouping(incidents(spark, sf_dir), AS_OF - 400 * DAY)


@query("gate_board_sums", f"WITH {_OPEN} SELECT (SELECT count(*) FROM open)::BIGINT AS episodes, (SELECT count(*) FROM open)::BIGINT AS on_board, true AS agrees")
def gate_board_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board's cards add up to the open episodes, no more and no less."""
    rows = _episodes(spark, sf_dir)
    cards = j.board(rows).agg(F.sum("episodes").alias("on_board"), F.bool_and(F.col("opens") + F.col("stales") == F.col("episodes")).alias("states"))
    return rows.where("state = 'firing'").agg(F.count("*").alias("episodes")).join(F.broadcast(cards)).select("episodes", "on_board", ((F.col("episodes") == F.col("on_board")) & F.col("states")).alias("agrees"))


_PERCENTILES = [(d.name, sum(e.startswith("percentile(") for e in d.features.values())) for d in detection.DETECTORS]


@query("gate_single_percentile", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {k})" for n, k in _PERCENTILES) + ") v(detector, percentiles) WHERE percentiles > 0")
def gate_single_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors of a percentile and how many they ask for: a result has room for one."""
    return spark.createDataFrame(_PERCENTILES, "detector string, percentiles int").where("percentiles > 0")


_DECLARED = [("event_id", "bigint"), ("collector_ms", "bigint"), ("severity_norm", "string"), ("enter_system_lag_ms", "double"), ("rolename", "string")]


@query("gate_mapping", "SELECT * FROM (VALUES ('enter_system_lag_ms', 'double', 'bigint'), ('rolename', 'string', 'absent')) v(field, declared, live)")
def gate_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared fields that the records lack or hold as another type."""
    return spark.createDataFrame(quality.mapping_differences(log_events(spark, sf_dir).dtypes, _DECLARED), "field string, declared string, live string")


@query("gate_absence_rows", f"WITH {LOG}, {ROSTER}, {METRICS} SELECT DISTINCT collector_id FROM roster WHERE collector_id NOT IN (SELECT collector_id FROM metric_samples WHERE kind = 'fleet' AND ts >= {AS_OF - 3 * DAY})")
def gate_absence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rostered collectors without an absence row of late: a monitor can't fire for them."""
    told = metric_samples(spark, sf_dir, AS_OF - 3 * DAY).where("kind = 'fleet'").select("collector_id")
    return roster(spark, sf_dir).select("collector_id").distinct().join(told, "collector_id", "left_anti")


@query("gate_unknown_monitors", f"WITH {ALERTS}, {_MON} SELECT monitor_name, count(*)::BIGINT AS n FROM alerts WHERE monitor_name NOT IN (SELECT alertname FROM monitors) GROUP BY monitor_name")
def gate_unknown_monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitors with alerts that the catalog doesn't have."""
    known = catalog.monitors(spark).select(F.col("alertname").alias("monitor_name"))
    return alerts(spark, sf_dir).join(F.broadcast(known), "monitor_name", "left_anti").groupBy("monitor_name").agg(F.count("*").alias("n"))


@query("gate_bucket_entities", f"WITH {ALERTS}, {_MON} SELECT alertname, count(*)::BIGINT AS n FROM alerts JOIN monitors ON monitor_name = alertname WHERE constant_entity IS NULL AND bucket_key IS NULL AND state <> 'ERROR' GROUP BY alertname")
def gate_bucket_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-entity monitors whose alerts name no entity."""
    per_entity = catalog.monitors(spark).where("constant_entity is null").select(F.col("alertname").alias("monitor_name"))
    bad = alerts(spark, sf_dir).join(F.broadcast(per_entity), "monitor_name").where("bucket_key is null and state <> 'ERROR'")
    return bad.groupBy(F.col("monitor_name").alias("alertname")).agg(F.count("*").alias("n"))


@query("gate_retention", W + f"SELECT collector_ms // {DAY} * {DAY} AS day_ms, count(*)::BIGINT AS n FROM log_events WHERE collector_ms < {AS_OF - 20 * DAY} GROUP BY 1")
def gate_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that retention should have deleted."""
    return quality.over_age(log_events(spark, sf_dir), "collector_ms", AS_OF, 20 * DAY)


@query("poison_verdict", f"WITH r AS (SELECT user_id % 10 AS k, value / 490.0 AS g, event_id FROM events WHERE event_id % 50 <> 0), d AS (SELECT 'detector' AS kind, k::VARCHAR AS name, count(*) FILTER (g > 0.999)::BIGINT AS raw_hits, count(DISTINCT CASE WHEN g > 0.998 THEN event_id // 100 END)::BIGINT AS episodes FROM r GROUP BY k), {ALERTS}, m AS (SELECT 'monitor' AS kind, name, NULL::BIGINT AS raw_hits, count(DISTINCT id)::BIGINT AS episodes FROM (VALUES ('data-loss'), ('heap-spiral'), ('cluster-red')) t(name) LEFT JOIN alerts ON monitor_name = name AND state <> 'COMPLETED' GROUP BY name), u AS (SELECT *, episodes < 1 OR coalesce(raw_hits < 1, false) AS missing FROM (SELECT * FROM d UNION ALL SELECT * FROM m)) SELECT *, (SELECT NOT bool_or(missing) FROM u) AS passed FROM u")
def poison_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What detectors and monitors made of a poisoned run, what missed it, and whether it passed."""
    rows = table(spark, sf_dir, "events").where("event_id % 50 <> 0").select((F.col("user_id") % 10).alias("detector"), (F.col("value") / 490.0).alias("grade"), F.lit(0.9).alias("confidence"), F.floor(F.col("event_id") / 100).alias("window"))
    opened = rows.where("grade > 0.998").select(F.col("detector").cast("string").alias("name"), F.col("window").alias("episode_id"))
    aimed = spark.createDataFrame([("data-loss",), ("heap-spiral",), ("cluster-red",)], "name string")
    shown = alerts(spark, sf_dir).where("state <> 'COMPLETED'").select(F.col("monitor_name").alias("name"), F.col("id").alias("episode_id"))
    return quality.poison_verdict(quality.detector_scores(rows, 0.999), opened, aimed, shown)


@query("scorecard_all", S + f", r AS (SELECT 'unprojected' AS rule, count(*) AS n FROM alerts WHERE monitor_name = 'no-such-monitor' UNION ALL SELECT 'impure', count(*) FROM (SELECT incident_id FROM signals GROUP BY incident_id HAVING count(DISTINCT entity_id) > 1 OR count(DISTINCT collector_id) > 1 OR count(DISTINCT entity_kind) > 1) UNION ALL SELECT 'fragmented', count(*) FROM (SELECT alertname FROM signals GROUP BY alertname, entity_kind HAVING count(DISTINCT incident_id) > count(DISTINCT entity_id)) UNION ALL SELECT 'unlabelled', count(*) FROM signals WHERE entity_id IS NULL OR collector_id = '' UNION ALL SELECT 'late', count(*) FROM (SELECT incident_id FROM signals GROUP BY incident_id HAVING min(last_seen) - min(first_seen) > 600) UNION ALL SELECT 'unknown_monitor', count(DISTINCT monitor_name) FROM alerts WHERE monitor_name NOT IN (SELECT alertname FROM monitors)) SELECT rule, n::BIGINT AS n, n = 0 AS passed FROM r")
def scorecard_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the injection scorecard that applies to alerts, with what failed it."""
    rows = signals(spark, sf_dir).withColumn("topology_version", F.lit("v"))
    waits = rows.groupBy("incident_id").agg((F.min("last_seen") - F.min("first_seen")).alias("wait_ms")).where("wait_ms > 600")
    return v.verdict(unprojected=v.unprojected(alerts(spark, sf_dir), "id", rows, "monitor"), impure=v.impure(rows), fragmented=v.fragmented(rows), unlabelled=quality.unlabelled(rows, ["entity_id", "collector_id"]), late=waits, unknown_monitor=gate_unknown_monitors(spark, sf_dir))


@query("report_family_clocks", W + f"SELECT family, count(*)::BIGINT AS n, min(event_ms) AS event_lo, max(event_ms) AS event_hi, min(collector_ms) AS collector_lo, max(collector_ms) AS collector_hi, count(*) FILTER (event_ms > {AS_OF - 5 * DAY})::BIGINT AS future, count(*) FILTER (event_ms < {AS_OF - 25 * DAY})::BIGINT AS old FROM log_events GROUP BY family")
def report_family_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both clocks of each family, and records outside of the range that panels show."""
    c = F.col
    return log_events(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"), F.min("event_ms").alias("event_lo"), F.max("event_ms").alias("event_hi"), F.min("collector_ms").alias("collector_lo"), F.max("collector_ms").alias("collector_hi"), F.count_if(c("event_ms") > AS_OF - 5 * DAY).alias("future"), F.count_if(c("event_ms") < AS_OF - 25 * DAY).alias("old"))


_RES = f"{LOG}, res AS (SELECT CASE user_id % 4 WHEN 0 THEN 'il-per-epn' WHEN 1 THEN 'ingest-flow' WHEN 2 THEN 'node-health' ELSE 'no-such' END AS alertname, collector_ms AS window_ms, event_id, CASE WHEN event_id % 3 = 0 THEN value / 490.0 WHEN event_id % 17 <> 0 THEN 0.0 END AS grade FROM log_events WHERE event_id % 50 <> 0)"


@query("report_detectors", f"WITH {_RES} SELECT alertname, count(*)::BIGINT AS results, count(*) FILTER (grade > 0)::BIGINT AS graded, count(*) FILTER (grade > 0.5)::BIGINT AS high, round(max(grade), 6) AS top, max(window_ms) AS last_ms, count(*) FILTER (grade IS NULL)::BIGINT AS errors FROM res GROUP BY alertname")
def report_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detector's realtime results: how many, how high, the last one, and those without a grade."""
    g = F.col("grade")
    return _results(spark, sf_dir).where("task_id is null").groupBy("alertname").agg(F.count("*").alias("results"), F.count_if(g > 0).alias("graded"), F.count_if(g > 0.5).alias("high"), F.round(F.max(g), 6).alias("top"), F.max("window_ms").alias("last_ms"), F.count_if(g.isNull()).alias("errors"))


@query("report_detector_signals", f"WITH {_RES} SELECT event_id::VARCHAR AS source_id, alertname, window_ms, round(grade, 4) AS grade FROM res WHERE grade > 0.5 AND alertname <> 'no-such' AND event_id % 10 <> 9 ORDER BY window_ms DESC, source_id LIMIT 10")
def report_detector_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest detector signals above the floor: a report's list."""
    rows = j.anomaly_signals(_results(spark, sf_dir), catalog.detectors(spark)).where("state = 'firing'")
    return rows.select("source_id", "alertname", "window_ms", "grade").orderBy(F.desc("window_ms"), "source_id").limit(10)


@query("report_projector", M + "SELECT collector_id, ts AS last_ms, event_id, event_id % 3 <> 0 AS healthy FROM metric_samples WHERE kind = 'projector' QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) = 1")
def report_projector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projector's last heartbeat and whether its cycle went well."""
    last = metric_samples(spark, sf_dir).where("kind = 'projector'").agg(F.max_by(F.struct("collector_id", "ts", "event_id"), F.struct("ts", "event_id")).alias("r")).where("r is not null")
    return last.select("r.collector_id", F.col("r.ts").alias("last_ms"), "r.event_id", (F.col("r.event_id") % 3 != 0).alias("healthy"))


@query("report_monitors", f"WITH {ALERTS}, {_MON} SELECT alertname, count(id)::BIGINT AS alerts, count(id) FILTER (state = 'ACTIVE')::BIGINT AS active, max(start_time) AS last_start FROM monitors LEFT JOIN alerts ON monitor_name = alertname GROUP BY alertname")
def report_monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every declared monitor with its alerts, those that never fired too."""
    counts = alerts(spark, sf_dir).groupBy(F.col("monitor_name").alias("alertname")).agg(F.count("*").alias("alerts"), F.count_if(F.col("state") == "ACTIVE").alias("active"), F.max("start_time").alias("last_start"))
    return catalog.monitors(spark).select("alertname").join(counts, "alertname", "left").fillna(0, ["alerts", "active"])


@query("report_alerts", f"WITH {ALERTS} SELECT state, monitor_name, count(*)::BIGINT AS n, max(start_time) AS newest FROM alerts GROUP BY state, monitor_name")
def report_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(spark, sf_dir).groupBy("state", "monitor_name").agg(F.count("*").alias("n"), F.max("start_time").alias("newest"))


@query("report_rollup", f"WITH {ROLL_SQL} SELECT family, count(*)::BIGINT AS n, max(ts) AS newest FROM (SELECT * FROM rollup UNION ALL SELECT * FROM imputed) GROUP BY family")
def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolled(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))


@query("panel_counts", W + "SELECT count(*)::BIGINT AS total, count(*) FILTER (severity_norm IN ('error', 'fatal', 'warning'))::BIGINT AS errors_warnings FROM log_events")
def panel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("severity_norm").isin("error", "fatal", "warning")).alias("errors_warnings"))


@query("panel_by_source", W + "SELECT family, count(*)::BIGINT AS n FROM log_events GROUP BY family")
def panel_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.terms(log_events(spark, sf_dir), "family", 10).select("family", "n")


@query("panel_top_hosts", W + "SELECT origin_host, count(*)::BIGINT AS n FROM log_events WHERE family <> 'infologger' GROUP BY origin_host ORDER BY n DESC, origin_host LIMIT 10")
def panel_top_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.terms(log_events(spark, sf_dir).where("family <> 'infologger'"), "origin_host", 10).select("origin_host", "n")


@query("panel_latest_status", M + "SELECT arg_max(cluster_status_code, (ts, event_id)) FILTER (kind = 'cluster') AS cluster_status, max(unassigned_shards) FILTER (kind = 'cluster') AS unassigned, arg_max(event_loop_delay, (ts, event_id)) FILTER (kind = 'osd') AS loop_delay FROM metric_samples")
def panel_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest metrics of the strip: each from the last sample of its kind."""
    last = lambda c, kind: F.max_by(c, F.when(F.col("kind") == kind, F.struct("ts", "event_id")))
    return metric_samples(spark, sf_dir).agg(last("cluster_status_code", "cluster").alias("cluster_status"), F.max(F.when(F.col("kind") == "cluster", F.col("unassigned_shards"))).alias("unassigned"), last("event_loop_delay", "osd").alias("loop_delay"))


_LAST = "SELECT collector_id, arg_max(fb_healthy, (ts, event_id)) AS healthy, arg_max(heartbeat_missing, (ts, event_id)) AS missing FROM metric_samples WHERE kind = 'fluentbit' GROUP BY collector_id"


@query("panel_fleet_states", M + f"SELECT count(*)::BIGINT AS collectors, count(*) FILTER (missing = 0 AND healthy = 1)::BIGINT AS healthy, count(*) FILTER (missing = 0 AND healthy = 0)::BIGINT AS degraded, count(*) FILTER (missing = 1)::BIGINT AS down FROM ({_LAST})")
def panel_fleet_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collectors by the state of their last sample."""
    order = F.struct("ts", "event_id")
    last = metric_samples(spark, sf_dir).where("kind = 'fluentbit'").groupBy("collector_id").agg(F.max_by("fb_healthy", order).alias("healthy"), F.max_by("heartbeat_missing", order).alias("missing"))
    up = F.col("missing") == 0
    return last.agg(F.count("*").alias("collectors"), F.count_if(up & (F.col("healthy") == 1)).alias("healthy"), F.count_if(up & (F.col("healthy") == 0)).alias("degraded"), F.count_if(~up).alias("down"))


@query("panel_not_healthy", M + "SELECT collector_id, min(fb_healthy) AS healthy, sum(output_dropped_delta)::BIGINT AS dropped, sum(output_errors_delta)::BIGINT AS errors FROM metric_samples WHERE kind = 'fluentbit' AND fb_healthy = 0 GROUP BY collector_id")
def panel_not_healthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metric_samples(spark, sf_dir).where("kind = 'fluentbit' and fb_healthy = 0")
    return rows.groupBy("collector_id").agg(F.min("fb_healthy").alias("healthy"), F.sum("output_dropped_delta").alias("dropped"), F.sum("output_errors_delta").alias("errors"))


@query("panel_worst_collectors", M + "SELECT collector_id, sum(output_dropped_delta)::BIGINT AS dropped, sum(output_retries_failed_delta)::BIGINT AS failed, sum(output_errors_delta)::BIGINT AS errors FROM metric_samples WHERE kind = 'fluentbit' GROUP BY collector_id ORDER BY dropped DESC, collector_id LIMIT 10")
def panel_worst_collectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten collectors that lost most records: a table of ten."""
    got = metric_samples(spark, sf_dir).where("kind = 'fluentbit'").groupBy("collector_id").agg(F.sum("output_dropped_delta").alias("dropped"), F.sum("output_retries_failed_delta").alias("failed"), F.sum("output_errors_delta").alias("errors"))
    return got.orderBy(F.desc("dropped"), "collector_id").limit(10)


@query("panel_shipped_distribution", M + f"SELECT ts // {DAY} * {DAY} AS bucket_ms, round(quantile_cont(output_records_delta, 0.5), 3) AS p50, round(quantile_cont(output_records_delta, 0.95), 3) AS p95, max(output_records_delta) AS most, sum(output_dropped_delta)::BIGINT AS dropped FROM metric_samples WHERE kind = 'fluentbit' GROUP BY 1")
def panel_shipped_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fleet's distribution of shipped records over time, and what was lost."""
    rows = metric_samples(spark, sf_dir).where("kind = 'fluentbit'").groupBy((F.floor(F.col("ts") / DAY) * DAY).alias("bucket_ms"))
    return rows.agg(F.round(F.percentile("output_records_delta", F.lit(0.5)), 3).alias("p50"), a.p95("output_records_delta").alias("p95"), F.max("output_records_delta").alias("most"), F.sum("output_dropped_delta").alias("dropped"))


@query("panel_node_charts", M + f"SELECT ts // {DAY} * {DAY} AS bucket_ms, os_node, round(avg(heap_percent), 6) AS heap, sum(indexing_delta)::BIGINT AS operations, round(max(disk_used_percent), 6) AS disk FROM metric_samples WHERE kind = 'node' GROUP BY ALL")
def panel_node_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metric_samples(spark, sf_dir).where("kind = 'node'").groupBy((F.floor(F.col("ts") / DAY) * DAY).alias("bucket_ms"), "os_node")
    return rows.agg(F.round(F.avg("heap_percent"), 6).alias("heap"), F.sum("indexing_delta").alias("operations"), F.round(F.max("disk_used_percent"), 6).alias("disk"))


@query("panel_dashboard_latency", M + f"SELECT ts // {DAY} * {DAY} AS bucket_ms, round(avg(response_avg_ms), 6) AS mean, round(max(response_avg_ms), 6) AS most FROM metric_samples WHERE kind = 'osd' GROUP BY 1")
def panel_dashboard_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metric_samples(spark, sf_dir).where("kind = 'osd'").groupBy((F.floor(F.col("ts") / DAY) * DAY).alias("bucket_ms"))
    return rows.agg(F.round(F.avg("response_avg_ms"), 6).alias("mean"), F.round(F.max("response_avg_ms"), 6).alias("most"))


@query("panel_latest_table", M + "SELECT os_node, heap_percent, disk_used_percent, event_id FROM metric_samples WHERE kind = 'node' QUALIFY row_number() OVER (PARTITION BY os_node ORDER BY ts DESC, event_id DESC) = 1")
def panel_latest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each node."""
    from skerry.operators import ordered

    return ordered.latest(metric_samples(spark, sf_dir).where("kind = 'node'"), ["os_node"], F.struct("ts", "event_id"), ["heap_percent", "disk_used_percent", "event_id"])


@query("panel_incident_summary", f"WITH {_OPEN} SELECT count(*)::BIGINT AS open, count(DISTINCT group_id)::BIGINT AS groups, count(*) FILTER (severity = 'page')::BIGINT AS pages, count(*) FILTER (episode_state = 'STALE')::BIGINT AS stale FROM open")
def panel_incident_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _episodes(spark, sf_dir).where("state = 'firing'")
    return rows.agg(F.count("*").alias("open"), F.count_distinct("group_id").alias("groups"), F.count_if(F.col("severity") == "page").alias("pages"), F.count_if(F.col("episode_state") == "STALE").alias("stale"))


@query("panel_active_alerts", f"WITH {ALERTS} SELECT monitor_name, count(*)::BIGINT AS n, count(*) FILTER (severity = '1')::BIGINT AS pages, min(start_time) AS oldest FROM alerts WHERE state = 'ACTIVE' GROUP BY monitor_name")
def panel_active_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts(spark, sf_dir).where("state = 'ACTIVE'").groupBy("monitor_name")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "1").alias("pages"), F.min("start_time").alias("oldest"))


@query("ops_overview", f"WITH {SIGNALS_SQL}, {_RES} SELECT (SELECT count(*) FROM signals WHERE state = 'firing')::BIGINT AS signals_open, (SELECT count(DISTINCT incident_id) FROM signals WHERE state = 'firing')::BIGINT AS incidents_open, (SELECT count(*) FROM res WHERE grade > 0.5 AND window_ms > {AS_OF - 3 * DAY} AND window_ms <= {AS_OF})::BIGINT AS anomalies, (SELECT count(*) FROM log_events WHERE collector_ms > {AS_OF - 3 * DAY} AND collector_ms <= {AS_OF})::BIGINT AS records")
def ops_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open signals and incidents, and the anomalies and records of late, in one row."""
    late = lambda c: (F.col(c) > AS_OF - 3 * DAY) & (F.col(c) <= AS_OF)
    one = signals(spark, sf_dir).where("state = 'firing'").agg(F.count("*").alias("signals_open"), F.count_distinct("incident_id").alias("incidents_open"))
    two = _results(spark, sf_dir).where(F.col("task_id").isNull() & (F.col("grade") > 0.5) & late("window_ms")).agg(F.count("*").alias("anomalies"))
    three = log_events(spark, sf_dir, AS_OF - 3 * DAY, AS_OF).where(late("collector_ms")).agg(F.count("*").alias("records"))
    return one.join(F.broadcast(two)).join(F.broadcast(three))


@query("soak_outputs", M + f"SELECT collector_id, 'out-' || event_id % 3 AS output, sum(output_records_delta)::BIGINT AS offered, sum(output_dropped_delta)::BIGINT AS lost, round(100.0 * sum(output_dropped_delta) / sum(output_records_delta), 4) AS lost_percent, max(heap_percent) AS peak FROM metric_samples WHERE kind = 'fluentbit' GROUP BY ALL HAVING sum(output_records_delta) > 0")
def soak_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each output of each collector was offered and lost for good, and the peak of its memory."""
    rows = metric_samples(spark, sf_dir).where("kind = 'fluentbit'").groupBy("collector_id", F.concat(F.lit("out-"), F.col("event_id") % 3).alias("output"))
    got = rows.agg(F.sum("output_records_delta").alias("offered"), F.sum("output_dropped_delta").alias("lost"), F.max("heap_percent").alias("peak")).where("offered > 0")
    return got.withColumn("lost_percent", F.round(100.0 * F.col("lost") / F.col("offered"), 4))


@query("report_rules", "SELECT * FROM (VALUES " + ", ".join(f"('{r.name}', {r.minutes}, {r.severity}, {r.period})" for r in monitors.RULES) + ") v(name, minutes, severity, period)")
def report_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thresholds' rules as declared."""
    return spark.createDataFrame([(r.name, r.minutes, r.severity, r.period) for r in monitors.RULES], "name string, minutes int, severity int, period int")


@query("gate_commit_counts", f"WITH {META_SQL} SELECT ts, count(*)::BIGINT AS cohorts FROM meta GROUP BY ts HAVING count(*) <> 5")
def gate_commit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets whose commit would lack a cohort; none may."""
    return rolled_meta(spark, sf_dir).groupBy("ts").agg(F.count("*").alias("cohorts")).where("cohorts <> 5")
