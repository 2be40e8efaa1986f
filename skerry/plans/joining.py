"""Queries of joins and set operations (inventory C and G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry import catalog
from skerry.operators import aggregates as a
from skerry.operators import joins as j
from skerry.plans.registry import query
from skerry.session import AS_OF, DAY
from skerry.sources.adapters import ALERTS, LOG, METRICS, ROSTER, alerts, log_events, metric_samples, roster, table

W = f"WITH {LOG} "
R = f"WITH {LOG}, {ROSTER} "


_SNAPSHOTS = "SELECT DISTINCT topology_version, effective_from FROM roster"


@query("roster_asof", R + f"SELECT event_id, coalesce(s.topology_version, 'none') AS topology_version, coalesce(r.collector_id, 'none') AS collector_id FROM log_events e ASOF LEFT JOIN ({_SNAPSHOTS}) s ON e.collector_ms >= s.effective_from LEFT JOIN roster r ON r.topology_version = s.topology_version AND r.origin_host = e.origin_host")
def roster_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collector of each record's host in the snapshot in force: a host that the snapshot lacks has none, whatever older ones say."""
    rows = roster(spark, sf_dir)
    events = log_events(spark, sf_dir).select("event_id", "origin_host", "collector_ms")
    placed = j.as_of(events, rows.select("topology_version", "effective_from").distinct(), "collector_ms", "effective_from")
    found = j.lookup(placed, rows, ["topology_version", "origin_host"], collector_id="collector_id")
    return found.select("event_id", F.coalesce("topology_version", F.lit(catalog.NONE)).alias("topology_version"), "collector_id")


@query("host_history_asof", R + "SELECT event_id, r.collector_id FROM log_events e ASOF LEFT JOIN roster r ON e.origin_host = r.origin_host AND e.collector_ms >= r.effective_from")
def host_history_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with the last assignment its host ever had until then."""
    events = log_events(spark, sf_dir).select("event_id", "origin_host", "collector_ms")
    return j.as_of(events, roster(spark, sf_dir), "collector_ms", "effective_from", ["origin_host"]).select("event_id", "collector_id")


@query("snapshot_asof", R + "SELECT event_id, topology_version FROM log_events e ASOF LEFT JOIN (SELECT DISTINCT topology_version, effective_from FROM roster) r ON e.collector_ms >= r.effective_from")
def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = roster(spark, sf_dir).select("topology_version", "effective_from").distinct()
    return j.as_of(log_events(spark, sf_dir).select("event_id", "collector_ms"), snapshots, "collector_ms", "effective_from").select("event_id", "topology_version")


@query("host_collector_lookup", R + "SELECT event_id, coalesce(r.collector_id, 'none') AS collector_id FROM log_events e LEFT JOIN (SELECT * FROM roster WHERE topology_version = 'v3') r USING (origin_host)")
def host_collector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = roster(spark, sf_dir).where("topology_version = 'v3'")
    return j.lookup(log_events(spark, sf_dir).select("event_id", "origin_host"), current, ["origin_host"], collector_id="collector_id").select("event_id", "collector_id")


@query("heartbeat_absence", f"WITH {LOG}, {ROSTER}, {METRICS} SELECT collector_id, CASE WHEN {AS_OF} - last_ms <= {2 * DAY} THEN 0 ELSE 1 END::INTEGER AS missing, {AS_OF} - last_ms AS age_ms FROM (SELECT DISTINCT collector_id FROM roster) LEFT JOIN (SELECT collector_id, max(ts) AS last_ms FROM metric_samples WHERE kind = 'fluentbit' GROUP BY collector_id) USING (collector_id)")
def heartbeat_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absence by all fluentbit samples."""
    seen = metric_samples(spark, sf_dir).where("kind = 'fluentbit'")
    return j.heartbeat_absence(roster(spark, sf_dir), seen, "collector_id", "ts", AS_OF, 2 * DAY)


_CATALOG = "monitors(monitor_name, entity_kind, scope) AS (VALUES " + ", ".join(f"('{n}', '{k}', '{s}')" for n, k, _, s, *_ in catalog.MONITORS) + ")"


@query("catalog_enrichment", f"WITH {ALERTS}, {_CATALOG} SELECT id, monitor_name, entity_kind, scope FROM alerts JOIN monitors USING (monitor_name)")
def catalog_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = catalog.monitors(spark).select(F.col("alertname").alias("monitor_name"), "entity_kind", "scope")
    return alerts(spark, sf_dir).join(F.broadcast(known), "monitor_name").select("id", "monitor_name", "entity_kind", "scope")


@query("detector_names", "SELECT event_id, name FROM events JOIN (VALUES (0, 'ingest-flow'), (1, 'node-health'), (2, 'dashboards-health')) d(k, name) ON event_id % 5 = k")
def detector_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = catalog.detectors(spark).where("alertname in ('ingest-flow', 'node-health', 'dashboards-health')")
    named = ids.select(F.when(F.col("alertname") == "ingest-flow", 0).when(F.col("alertname") == "node-health", 1).otherwise(2).cast("long").alias("k"), F.col("alertname").alias("name"))
    return table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 5).join(F.broadcast(named), "k").select("event_id", "name")


_SIGNALS = "CASE event_id % 6 WHEN 0 THEN 'collector-down' WHEN 1 THEN 'data-loss' WHEN 2 THEN 'ingest-flow' WHEN 3 THEN 'telemetry-silence' WHEN 4 THEN 'heap-spiral' ELSE 'shipping-breaking' END"
_EDGES = "edges(cause, symptom) AS (VALUES " + ", ".join(f"('{c}', '{s}')" for c, (_, symptoms) in catalog.CAUSES.items() for s in symptoms) + ")"


@query("causal_interval", f"{W}, {_EDGES}, first AS (SELECT {_SIGNALS} AS alertname, origin_host AS scope, min(collector_ms) AS ms FROM log_events GROUP BY ALL) SELECT cause, symptom, a.scope, b.ms - a.ms AS lead_ms, b.ms < a.ms AS late FROM first a JOIN edges ON a.alertname = cause JOIN first b ON b.alertname = symptom AND b.scope = a.scope WHERE abs(b.ms - a.ms) <= {5 * DAY}")
def causal_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_events(spark, sf_dir).select(F.expr(_SIGNALS).alias("alertname"), F.col("origin_host").alias("scope"), F.col("collector_ms").alias("ts"))
    return j.cause_intervals(rows, catalog.edges(spark), 5 * DAY)


@query("edge_evidence", f"{W}, {_EDGES}, first AS (SELECT {_SIGNALS} AS alertname, origin_host AS scope, min(collector_ms) AS ms FROM log_events GROUP BY ALL), hits AS (SELECT cause, symptom, count(DISTINCT a.scope)::BIGINT AS hits FROM first a JOIN edges ON a.alertname = cause JOIN first b ON b.alertname = symptom AND b.scope = a.scope WHERE b.ms - a.ms BETWEEN 0 AND {5 * DAY} GROUP BY ALL) SELECT cause, symptom, hits, scopes, round(hits / scopes, 4) AS probability FROM hits JOIN (SELECT alertname AS cause, count(*)::BIGINT AS scopes FROM first GROUP BY 1) USING (cause)")
def edge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skerry.operators import evaluation

    rows = log_events(spark, sf_dir).select(F.expr(_SIGNALS).alias("alertname"), F.col("origin_host").alias("scope"), F.col("collector_ms").alias("ts"))
    return evaluation.edge_evidence(j.cause_intervals(rows, catalog.edges(spark), 5 * DAY), rows)


_EP = "concat('e', event_id) AS incident_id, {s} AS alertname, CASE WHEN event_id % 4 = 0 THEN 'resolved' ELSE 'firing' END AS state, concat('c', user_id % 50) AS cluster_id, concat('n', user_id) AS collector_id, event_id AS opened_at".replace("{s}", _SIGNALS)
_CAUSE_SQL = f"""WITH ep AS (SELECT {_EP} FROM events), f AS (SELECT * FROM ep WHERE state = 'firing'),
  e(cause, symptom, pair) AS (VALUES {", ".join(f"('{c}', '{s}', {'true' if len(k) > 1 else 'false'})" for c, (k, symptoms) in catalog.CAUSES.items() for s in symptoms)}),
  wide AS (SELECT alertname, cluster_id, min(struct_pack(id := incident_id, o := opened_at)) AS c FROM f GROUP BY ALL),
  near AS (SELECT alertname, cluster_id, collector_id, min(struct_pack(id := incident_id, o := opened_at)) AS c FROM f GROUP BY ALL),
  m AS (SELECT s.incident_id, s.opened_at, e.cause, x.c FROM f s JOIN e ON e.symptom = s.alertname AND NOT e.pair JOIN wide x ON x.alertname = e.cause AND x.cluster_id = s.cluster_id
    UNION ALL SELECT s.incident_id, s.opened_at, e.cause, x.c FROM f s JOIN e ON e.symptom = s.alertname AND e.pair JOIN near x ON x.alertname = e.cause AND x.cluster_id = s.cluster_id AND x.collector_id = s.collector_id)
  SELECT incident_id, string_agg(cause, ',' ORDER BY cause) AS causes, string_agg(c.id, ',' ORDER BY cause) AS cause_ids, round(1 - product(0.5), 4) AS belief, false AS measured, bool_and(c.o <= opened_at) AS precedes FROM m GROUP BY incident_id"""


@query("causal_candidates", _CAUSE_SQL)
def causal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causes of all firing episodes; the SQL joins with the first cause of each key, as no edge leads to its own label."""
    got = j.candidate_causes(table(spark, sf_dir, "events").selectExpr(*_split(_EP)), catalog.edges(spark))
    return got.withColumn("causes", F.array_join("causes", ",")).withColumn("cause_ids", F.array_join("cause_ids", ","))


def _split(columns: str) -> list[str]:
    """A select list without nested commas inside CASE as its expressions."""
    out, depth, part = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


@query("inhibit_anti", f"WITH ep AS (SELECT {_EP} FROM events), muted AS (SELECT DISTINCT cluster_id, collector_id FROM ep WHERE state = 'firing' AND alertname = 'collector-down') SELECT incident_id FROM ep WHERE NOT (alertname IN ('collector-unhealthy', 'data-loss', 'shipping-breaking', 'ingest-flow') AND EXISTS (SELECT 1 FROM muted m WHERE m.cluster_id = ep.cluster_id AND m.collector_id = ep.collector_id))")
def inhibit_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that are left if the edges of collector-down were proven."""
    proven = catalog.edges(spark).where("cause = 'collector-down'").withColumn("proven", F.lit(True))
    return j.inhibited(table(spark, sf_dir, "events").selectExpr(*_split(_EP)), proven).select("incident_id")


@query("lossless_recon", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber > 1 AND l_returnflag = 'R')")
def lossless_recon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skerry.operators import evaluation

    projected = table(spark, sf_dir, "lineitem").where("l_linenumber > 1 and l_returnflag = 'R'").select(F.lit("order").alias("source_kind"), F.col("l_orderkey").alias("source_id"))
    return evaluation.unprojected(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", projected, "order")


@query("notification_membership", "WITH n AS (SELECT user_id AS note, event_id + 1 AS id, user_id % 20 AS ep FROM events WHERE event_id % 3 = 0) SELECT note, event_id AS signal FROM events JOIN n ON id = event_id UNION SELECT note, event_id FROM events JOIN (SELECT DISTINCT note, ep FROM n) ON ep = user_id")
def notification_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals by all notifications, by either id; each third event is a notification."""
    e = table(spark, sf_dir, "events")
    notes = e.where("event_id % 3 = 0").groupBy(F.col("user_id").alias("note")).agg(F.collect_list(F.col("event_id") + 1).alias("ids"), F.collect_set(F.col("user_id") % 20).alias("eps"))
    signals = e.select(F.col("event_id").alias("signal"), F.col("event_id").alias("source_id"), F.col("user_id").alias("episode_id"))
    return j.members(signals, notes, "signal", {"source_id": "ids", "episode_id": "eps"}, "note")


@query("never_notified", "SELECT event_id FROM events WHERE event_type = 'error' AND user_id % 50 <> 7 AND event_id NOT IN (SELECT event_id + 1 FROM events WHERE event_id % 3 = 0) AND user_id NOT IN (SELECT user_id % 20 FROM events)")
def never_notified(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    by_id = (e.where("event_id % 3 = 0").select((F.col("event_id") + 1).alias("event_id")), "event_id")
    by_episode = (e.select((F.col("user_id") % 20).alias("user_id")), "user_id")
    return j.uncovered(e.where("event_type = 'error'").select("event_id", "user_id"), by_id, by_episode, exempt=F.col("user_id") % 50 == 7).select("event_id")


@query("id_multiget", "SELECT event_id, event_type FROM events WHERE event_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def id_multiget(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("event_id"))
    return table(spark, sf_dir, "events").join(ids, "event_id", "left_semi").select("event_id", "event_type")


@query("entity_membership", W + "SELECT event_id FROM log_events WHERE origin_host = 'epn000007' OR node = 'node-02'")
def entity_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose entity array holds a value."""
    entity = F.array(F.struct(F.lit("origin_host").alias("name"), F.col("origin_host").alias("value")), F.struct(F.lit("node").alias("name"), F.col("node").alias("value")))
    rows = log_events(spark, sf_dir).withColumn("entity", entity)
    return rows.where(F.exists("entity", lambda e: e["value"].isin("epn000007", "node-02"))).select("event_id")


@query("group_totals", W + "SELECT event_id, count(*) OVER (PARTITION BY family, collector_ms // 86400000)::BIGINT AS fleet FROM log_events")
def group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with its cohort's total; totals are aggregated first and joined, so a hot cohort is no window."""
    rows = log_events(spark, sf_dir).withColumn("day", F.floor(F.col("collector_ms") / DAY))
    totals = rows.groupBy("family", "day").agg(F.count("*").alias("fleet"))
    return rows.join(totals, ["family", "day"]).select("event_id", "fleet")


@query("discover_roster", W + "SELECT origin_host, node AS collector_id, n, ambiguous FROM (SELECT origin_host, node, count(*)::BIGINT AS n, count(*) OVER (PARTITION BY origin_host) > 1 AS ambiguous, row_number() OVER (PARTITION BY origin_host ORDER BY count(*) DESC, node) AS k FROM (SELECT origin_host, CASE WHEN event_id % 6 = 0 THEN 'node-09' ELSE node END AS node FROM log_events) GROUP BY origin_host, node) WHERE k = 1")
def discover_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_events(spark, sf_dir).withColumn("node", F.when(F.col("event_id") % 6 == 0, "node-09").otherwise(F.col("node")))
    return a.mode(rows, ["origin_host"], "node").select("origin_host", F.col("node").alias("collector_id"), "n", "ambiguous")


@query("set_operations", W + "SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT origin_host FROM log_events WHERE family = 'local' UNION ALL SELECT origin_host FROM log_events WHERE severity = 'E') UNION ALL SELECT 'except', count(*) FROM (SELECT origin_host FROM log_events EXCEPT SELECT origin_host FROM log_events WHERE event_type = 'error') UNION ALL SELECT 'intersect', count(*) FROM (SELECT origin_host FROM log_events WHERE severity = 'E' INTERSECT SELECT origin_host FROM log_events WHERE severity = 'W') UNION ALL SELECT 'symmetric', count(*) FROM ((SELECT origin_host FROM log_events WHERE severity = 'E' EXCEPT SELECT origin_host FROM log_events WHERE severity = 'W') UNION (SELECT origin_host FROM log_events WHERE severity = 'W' EXCEPT SELECT origin_host FROM log_events WHERE severity = 'E'))")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_events(spark, sf_dir)
    e, w = rows.where("severity = 'E'").select("origin_host"), rows.where("severity = 'W'").select("origin_host")
    parts = {
        "union": rows.where("family = 'local'").select("origin_host").unionByName(e),
        "except": rows.select("origin_host").exceptAll(rows.select("origin_host").limit(0)).subtract(rows.where("event_type = 'error'").select("origin_host")),
        "intersect": e.intersect(w),
        "symmetric": e.subtract(w).union(w.subtract(e)),
    }
    counts = [d.agg(F.lit(op).alias("op"), F.count("*").alias("n")) for op, d in parts.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("alert_merge", f"WITH {ALERTS} SELECT id, min(start_time) AS first_seen, max(greatest(last_notification_time, coalesce(end_time, 0))) AS last_seen, max(end_time) AS end_time FROM (SELECT * FROM alerts UNION ALL SELECT * REPLACE (NULL AS end_time, start_time - 5 AS start_time) FROM alerts WHERE state <> 'ACTIVE') GROUP BY id")
def alert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current and history rows of one alert merged: the end that any of them has, and the widest extent."""
    from skerry.operators import projection

    current = alerts(spark, sf_dir)
    history = current.where("state <> 'ACTIVE'").withColumn("end_time", F.lit(None).cast("long")).withColumn("start_time", F.col("start_time") - 5)
    return projection.merged(current.unionByName(history)).select("id", "first_seen", "last_seen", "end_time")
