"""Queries of signals and episodes (inventory M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry import catalog
from skerry.operators import projection as j
from skerry.plans.registry import query
from skerry.session import AS_OF
from skerry.sources.adapters import ALERTS, LOG, alerts, log_events, table

_MON = "monitors(alertname, entity_kind, scope, healthy_required, constant_entity) AS (VALUES " + ", ".join(f"('{n}', '{k}', '{s}', {h}, {'NULL' if c is None else repr(c)})" for n, k, _, s, _, h, c in catalog.MONITORS) + ")"
SIGNALS_SQL = f"""{ALERTS}, {_MON}, m0 AS (SELECT id, min(start_time) AS first_seen, max(greatest(last_notification_time, coalesce(end_time, 0))) AS last_seen, max(end_time) AS end_time, any_value(state) AS state, any_value(severity) AS severity, any_value(monitor_name) AS alertname, any_value(bucket_key) AS bucket_key FROM alerts GROUP BY id),
  s0 AS (SELECT *, coalesce(constant_entity, bucket_key) AS k, CASE WHEN state = 'ERROR' THEN 'monitor-error' WHEN coalesce(constant_entity, bucket_key) IS NULL THEN 'entity-missing' ELSE 'single' END AS class FROM m0 JOIN monitors USING (alertname)),
  s1 AS (SELECT id AS source_id, alertname, class, CASE WHEN state IN ('ACTIVE', 'ERROR') THEN 'firing' ELSE 'resolved' END AS state, CASE WHEN severity = '1' THEN 'page' ELSE 'warn' END AS severity,
    CASE WHEN class = 'single' THEN entity_kind ELSE 'monitor' END AS entity_kind, CASE WHEN class = 'single' THEN k ELSE alertname END AS entity_id, CASE WHEN class = 'single' AND entity_kind = 'collector' THEN k ELSE 'none' END AS collector_id, scope, first_seen, last_seen, end_time, healthy_required FROM s0),
  signals AS (SELECT *, CASE WHEN scope = 'fleet' THEN 'fleet' ELSE 'collector:' || collector_id END AS scope_label,
    substr(sha256('{{"alertname":"' || alertname || '","entity_id":"' || entity_id || '","entity_kind":"' || entity_kind || '","scope":"' || CASE WHEN scope = 'collector' THEN collector_id ELSE 'fleet' END || '","source_kind":"monitor"}}'), 1, 32) AS incident_id FROM s1)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.alert_signals(j.merged(alerts(spark, sf_dir)), catalog.monitors(spark))


@query("alert_signals", f"WITH {SIGNALS_SQL} SELECT source_id, alertname, class, state, severity, entity_kind, entity_id, collector_id, first_seen, last_seen, end_time, incident_id, 'logs/' || alertname || '/' || scope_label AS group_id FROM signals")
def alert_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("source_id", "alertname", "class", "state", "severity", "entity_kind", "entity_id", "collector_id", "first_seen", "last_seen", "end_time", "incident_id", "group_id")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector results derived from log records; grades fall to zero on two of three records."""
    rows = log_events(spark, sf_dir)
    name = F.element_at(F.array(*map(F.lit, ("il-per-epn", "ingest-flow", "node-health", "no-such"))), (F.col("user_id") % 4 + 1).cast("int"))
    return rows.select(F.col("event_id").cast("string").alias("source_id"), name.alias("alertname"), F.when(F.col("event_id") % 10 != 9, F.col("origin_host")).alias("entity_id"), F.col("collector_ms").alias("window_ms"), F.when(F.col("event_id") % 3 == 0, F.col("value") / 490.0).when(F.col("event_id") % 17 != 0, 0.0).alias("grade"), F.lit(0.9).alias("confidence"), F.when(F.col("event_id") % 50 == 0, "backtest").alias("task_id"))


_ANOM = f"""{LOG}, anomalies AS (SELECT CAST(event_id AS VARCHAR) AS source_id, CASE user_id % 4 WHEN 0 THEN 'il-per-epn' WHEN 1 THEN 'ingest-flow' WHEN 2 THEN 'node-health' END AS alertname, origin_host AS entity_id, collector_ms AS window_ms,
  CASE WHEN event_id % 3 = 0 THEN value / 490.0 WHEN event_id % 17 <> 0 THEN 0.0 END AS g FROM log_events WHERE event_id % 50 <> 0 AND event_id % 10 <> 9 AND user_id % 4 <> 3)"""


@query("anomaly_signals", f"WITH {_ANOM} SELECT source_id, alertname, entity_id, window_ms, CASE WHEN g > 0.5 THEN 'firing' ELSE 'evidence' END AS state, round(g, 4) AS grade FROM anomalies WHERE g IS NOT NULL")
def anomaly_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.anomaly_signals(_results(spark, sf_dir), catalog.detectors(spark)).select("source_id", "alertname", "entity_id", "window_ms", "state", "grade")


#: The fold as a recursion, a step a row of each incident in time order.
FOLD_SQL = f"""WITH RECURSIVE {SIGNALS_SQL},
  r AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY first_seen, last_seen, (state <> 'firing')::INTEGER, source_id) AS k, coalesce(end_time, last_seen) AS cleared FROM signals),
  f AS (SELECT incident_id, k, 1 AS run, first_seen AS opened_at, last_seen, severity, state = 'resolved' AS clears, healthy_required AS need,
      CASE WHEN state = 'resolved' AND cleared > 0 THEN 1 ELSE 0 END AS healthy, CASE WHEN state = 'resolved' THEN greatest(cleared, 0) ELSE 0 END AS last, CASE WHEN state = 'resolved' THEN cleared END AS resolved_at,
      CASE WHEN state = 'resolved' AND healthy_required <= 1 THEN cleared END AS closed, [source_id] AS members FROM r WHERE k = 1
    UNION ALL SELECT r.incident_id, r.k, n.run, n.opened_at, greatest(n.last_seen, r.last_seen), CASE WHEN r.severity = 'page' THEN 'page' ELSE n.severity END, r.state = 'resolved', f.need,
      CASE WHEN r.state = 'resolved' THEN n.healthy + (r.cleared > n.last)::INTEGER ELSE 0 END, CASE WHEN r.state = 'resolved' THEN greatest(n.last, r.cleared) ELSE 0 END, CASE WHEN r.state = 'resolved' THEN r.cleared END,
      CASE WHEN r.state <> 'resolved' THEN NULL WHEN n.healthy + (r.cleared > n.last)::INTEGER >= f.need THEN greatest(coalesce(n.closed, r.cleared), r.cleared) ELSE n.closed END, list_append(n.members, r.source_id)
    FROM f JOIN r ON r.incident_id = f.incident_id AND r.k = f.k + 1,
      LATERAL (SELECT f.closed IS NOT NULL AND r.first_seen > f.closed AS fresh) z,
      LATERAL (SELECT f.run + z.fresh::INTEGER AS run, CASE WHEN z.fresh THEN r.first_seen ELSE f.opened_at END AS opened_at, CASE WHEN z.fresh THEN 0 ELSE f.last_seen END AS last_seen, CASE WHEN z.fresh THEN r.severity ELSE f.severity END AS severity,
        CASE WHEN z.fresh THEN 0 ELSE f.healthy END AS healthy, CASE WHEN z.fresh THEN 0 ELSE f.last END AS last, CASE WHEN NOT z.fresh THEN f.closed END AS closed, CASE WHEN z.fresh THEN [] ELSE f.members END AS members) n),
  done AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY incident_id, run ORDER BY k DESC) = 1),
  episodes AS (SELECT incident_id, incident_id || '.' || opened_at AS episode_id, opened_at, last_seen, CASE WHEN healthy >= need THEN resolved_at END AS resolved_at, CASE WHEN healthy >= need THEN 'RESOLVED' WHEN healthy > 0 THEN 'RECOVERING' ELSE 'OPEN' END AS episode_state,
    CASE WHEN healthy >= need THEN 'resolved' ELSE 'firing' END AS state, severity, healthy::INTEGER AS healthy_windows, members[1:{j.MAX_MEMBERS}] AS members, len(members) > {j.MAX_MEMBERS} AS truncated FROM done)"""


@query("monitor_episodes", f"{FOLD_SQL} SELECT * FROM episodes")
def monitor_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of monitor signals with each monitor's own hysteresis."""
    return j.monitor_episodes(signals(spark, sf_dir))


_DET = "detectors(alertname, entity_kind, healthy_required) AS (VALUES " + ", ".join(f"('{n}', '{k}', {h})" for n, k, _, _, _, _, h in catalog.DETECTORS) + ")"
_DETECTOR_FOLD = f"""WITH RECURSIVE {_ANOM}, {_DET},
  s AS (SELECT source_id, window_ms, CASE WHEN g > 0.5 THEN 'firing' ELSE 'evidence' END AS state, round(g, 4) AS grade, healthy_required AS need,
    substr(sha256('{{"alertname":"' || alertname || '","entity_id":"' || entity_id || '","entity_kind":"' || entity_kind || '","scope":"' || CASE WHEN entity_kind = 'collector' THEN entity_id ELSE 'fleet' END || '","source_kind":"detector"}}'), 1, 32) AS incident_id
    FROM anomalies JOIN detectors USING (alertname) WHERE g IS NOT NULL AND entity_id IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY window_ms, state, source_id) AS k FROM s),
  f AS (SELECT incident_id, 0::BIGINT AS k, 0 AS run, NULL::BIGINT AS opened_at, NULL::BIGINT AS last_seen, NULL::BIGINT AS resolved_at, 'NONE' AS st, 0 AS healthy, 0::BIGINT AS breach, 0::BIGINT AS calm, 0.0::DOUBLE AS worst, []::VARCHAR[] AS members FROM r WHERE k = 1
    UNION ALL SELECT r.incident_id, r.k, n.run, n.opened_at,
      CASE WHEN z.hit THEN greatest(n.last_seen, r.window_ms) ELSE n.last_seen END, CASE WHEN z.hit THEN NULL WHEN z.heals AND n.healthy + 1 >= r.need THEN r.window_ms ELSE n.resolved_at END,
      CASE WHEN z.hit THEN 'OPEN' WHEN z.heals THEN CASE WHEN n.healthy + 1 >= r.need THEN 'RESOLVED' ELSE 'RECOVERING' END ELSE n.st END,
      CASE WHEN z.hit THEN 0 WHEN z.heals THEN n.healthy + 1 ELSE n.healthy END, CASE WHEN z.hit THEN r.window_ms ELSE n.breach END, CASE WHEN z.hit THEN 0 WHEN z.heals THEN r.window_ms ELSE n.calm END,
      CASE WHEN n.st = 'NONE' THEN n.worst ELSE greatest(n.worst, r.grade) END, CASE WHEN z.hit THEN list_append(n.members, r.source_id) ELSE n.members END
    FROM f JOIN r ON r.incident_id = f.incident_id AND r.k = f.k + 1,
      LATERAL (SELECT r.state = 'firing' AND (f.st = 'NONE' OR (f.st = 'RESOLVED' AND r.window_ms > f.resolved_at)) AS fresh, f.st = 'RESOLVED' AND r.window_ms > f.resolved_at AS over) q,
      LATERAL (SELECT f.run + q.fresh::INTEGER AS run, CASE WHEN q.fresh THEN r.window_ms ELSE f.opened_at END AS opened_at, CASE WHEN q.fresh THEN r.window_ms ELSE f.last_seen END AS last_seen, CASE WHEN NOT q.fresh THEN f.resolved_at END AS resolved_at, CASE WHEN q.fresh THEN 'OPEN' ELSE f.st END AS st,
        CASE WHEN q.fresh THEN 0 ELSE f.healthy END AS healthy, CASE WHEN q.fresh THEN 0 ELSE f.breach END AS breach, CASE WHEN q.fresh THEN 0 ELSE f.calm END AS calm, CASE WHEN q.fresh THEN 0.0 ELSE CASE WHEN q.over THEN f.worst ELSE f.worst END END AS worst, CASE WHEN q.fresh THEN [] ELSE f.members END AS members, q.over AND NOT q.fresh AS idle) n,
      LATERAL (SELECT n.st <> 'NONE' AND NOT n.idle AND r.state = 'firing' AND r.window_ms > n.breach AS hit, n.st NOT IN ('NONE', 'RESOLVED') AND r.state = 'evidence' AND r.grade <= 0 AND r.window_ms > greatest(n.calm, n.breach) AS heals) z),
  done AS (SELECT * FROM f WHERE run > 0 QUALIFY row_number() OVER (PARTITION BY incident_id, run ORDER BY k DESC) = 1)"""


@query("detector_episodes", f"{_DETECTOR_FOLD} SELECT incident_id, incident_id || '.' || opened_at AS episode_id, opened_at, last_seen, resolved_at, st AS episode_state, CASE WHEN st = 'RESOLVED' THEN 'resolved' ELSE 'firing' END AS state, healthy::INTEGER AS healthy_windows, breach AS last_breach_window, calm AS last_healthy_window, worst AS worst_grade, members[1:{j.MAX_MEMBERS}] AS members, len(members) > {j.MAX_MEMBERS} AS truncated FROM done")
def detector_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.detector_episodes(j.anomaly_signals(_results(spark, sf_dir), catalog.detectors(spark)))


_EP = f"""{SIGNALS_SQL}, eps AS (SELECT incident_id, alertname, any_value(entity_id) AS entity_id, any_value(entity_kind) AS entity_kind, min(class) AS class, 'logs/' || alertname || '/' || scope_label AS group_id, bool_or(state = 'firing') AS fires, min(first_seen) AS opened_at, max(last_seen) AS last_seen, count(DISTINCT source_id)::BIGINT AS member_count FROM signals GROUP BY incident_id, alertname, scope_label)"""


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an incident: its extent, members and whether any signal fires."""
    rows = signals(spark, sf_dir).groupBy("incident_id", "alertname", "group_id").agg(
        F.any_value("entity_id").alias("entity_id"), F.any_value("entity_kind").alias("entity_kind"), F.min("class").alias("class"),
        F.bool_or(F.col("state") == "firing").alias("fires"), F.min("first_seen").alias("opened_at"), F.max("last_seen").alias("last_seen"), F.count_distinct("source_id").alias("member_count"),
    )
    return rows.withColumn("state", F.when(F.col("fires"), "firing").otherwise("resolved"))


@query("episode_card", f"WITH {_EP} SELECT group_id, count(*)::BIGINT AS episodes, count(*) FILTER (fires)::BIGINT AS firing, min(opened_at) AS first_opened, max(last_seen) AS last_seen, sum(member_count)::BIGINT AS members, count(DISTINCT entity_id)::BIGINT AS entities, list_sort(list(DISTINCT entity_id))[1:3] AS sample FROM eps GROUP BY group_id")
def episode_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.cards(incidents(spark, sf_dir))


@query("mass_silence", f"WITH {SIGNALS_SQL} SELECT silent, CASE WHEN fleet OR silent >= 20 THEN 'unknown-mass-silence' END AS class FROM (SELECT count(DISTINCT CASE WHEN alertname = 'collector-down' THEN entity_id END)::BIGINT AS silent, bool_or(alertname = 'fleet-fb-silence') AS fleet FROM signals WHERE state = 'firing' AND class = 'single')")
def mass_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.mass_silence(signals(spark, sf_dir), 40)


@query(
    "stale_age",
    f"WITH e AS (SELECT concat('p', event_id) AS episode_id, CASE WHEN event_id % 3 = 0 THEN 'detector' ELSE 'monitor' END AS source_kind, CASE WHEN event_id % 5 = 0 THEN 'none' ELSE concat('n', user_id) END AS entity_id, user_id, CASE WHEN event_id % 4 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS st, CASE WHEN event_id % 2 = 0 THEN 'collector' ELSE 'epn' END AS kind, {AS_OF} - (event_id % 900) * 1000 AS ev FROM events), c AS (SELECT *, st <> 'RESOLVED' AND (entity_id = 'none' OR (source_kind = 'detector' AND kind = 'collector' AND user_id % 7 = 0)) AS closing FROM e), s AS (SELECT *, st <> 'RESOLVED' AND NOT closing AND source_kind = 'detector' AND {AS_OF} - ev > 240000 AS stale FROM c) SELECT episode_id, CASE WHEN closing THEN 'CLOSED_EXPECTED' WHEN stale THEN 'STALE' ELSE st END AS episode_state, CASE WHEN closing THEN 'resolved' ELSE CASE WHEN stale OR st = 'OPEN' THEN 'firing' ELSE 'resolved' END END AS state, CASE WHEN closing THEN {AS_OF} END::BIGINT AS resolved_at, CASE WHEN stale THEN {AS_OF} END::BIGINT AS stale_since FROM s",
)
def stale_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    episodes = e.selectExpr(
        "concat('p', event_id) AS episode_id", "CASE WHEN event_id % 3 = 0 THEN 'detector' ELSE 'monitor' END AS source_kind", "'ingest-flow' AS alertname", "'single' AS class",
        "CASE WHEN event_id % 5 = 0 THEN 'none' ELSE concat('n', user_id) END AS entity_id", "CASE WHEN event_id % 4 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS episode_state", "CASE WHEN event_id % 4 = 0 THEN 'resolved' ELSE 'firing' END AS state",
        "CASE WHEN event_id % 2 = 0 THEN 'collector' ELSE 'epn' END AS entity_kind", f"{AS_OF} - (event_id % 900) * 1000 AS last_evaluation", "cast(null AS long) AS resolved_at", "cast(null AS long) AS stale_since",
    )
    collectors = e.where("user_id % 7 <> 0").selectExpr("concat('n', user_id) AS collector_id")
    return j.aged(episodes, collectors, AS_OF, catalog.detectors(spark))


@query("alert_payload", f"WITH {_EP} SELECT incident_id AS episode_id, entity_id AS entity, strftime(to_timestamp(opened_at // 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS starts_at, CASE WHEN NOT fires THEN strftime(to_timestamp(last_seen // 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') END AS ends_at FROM eps")
def alert_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incidents(spark, sf_dir).select("*", F.col("incident_id").alias("episode_id"), F.lit("warn").alias("severity"), F.lit("logs").alias("cluster_id"), F.lit("none").alias("collector_id"), F.lit("fleet").alias("scope_label"), F.col("state").alias("episode_state"), F.col("last_seen").alias("resolved_at"))
    return j.payloads(rows).select("episode_id", F.col("labels")["entity_id"].alias("entity"), F.col("startsAt").alias("starts_at"), F.col("endsAt").alias("ends_at"))


@query("projector_heartbeat", f"WITH {_EP} SELECT count(*)::BIGINT AS incidents, count(*) FILTER (fires)::BIGINT AS open, count(DISTINCT CASE WHEN fires THEN group_id END)::BIGINT AS groups, (SELECT max(n) FROM (SELECT count(*)::BIGINT AS n FROM eps WHERE fires GROUP BY group_id)) AS largest_group FROM eps")
def projector_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = incidents(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n"), F.count_if("fires").alias("firing"))
    return groups.agg(F.sum("n").alias("incidents"), F.sum("firing").alias("open"), F.count_if(F.col("firing") > 0).alias("groups"), F.max(F.when(F.col("firing") > 0, F.col("firing"))).alias("largest_group"))


@query("delivery_groups", f"WITH {SIGNALS_SQL} SELECT alertname, scope_label, count(*)::BIGINT AS alerts, bool_or(severity = 'page') AS pages FROM signals WHERE state = 'firing' GROUP BY alertname, scope_label")
def delivery_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).where("state = 'firing'").groupBy("alertname", "scope_label").agg(F.count("*").alias("alerts"), F.bool_or(F.col("severity") == "page").alias("pages"))
