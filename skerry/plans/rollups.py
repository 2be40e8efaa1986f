"""Queries of rollups (inventory N1-N3, D16-D18, C4, E5)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import rollup as r
from skerry.plans.registry import query
from skerry.session import DAY
from skerry.sources.adapters import LOG, log_events
from skerry.sources.shared import home

BACK = 3 * DAY

ROLL_SQL = f"""{LOG}, entity_rows AS (
    SELECT collector_ms // {DAY} * {DAY} AS ts, family, 'host' AS entity_kind, origin_host AS entity, severity_norm, enter_system_lag_ms, ingest_lag_ms FROM log_events
    UNION ALL SELECT collector_ms // {DAY} * {DAY}, family, 'node', node, severity_norm, enter_system_lag_ms, ingest_lag_ms FROM log_events WHERE family <> 'central'),
  rollup0 AS (SELECT ts, family, entity_kind, entity, count(*)::BIGINT AS doc_count, sum(CASE WHEN severity_norm IN ('error', 'fatal') THEN 1 ELSE 0 END)::BIGINT AS ef_count,
    round(quantile_cont(enter_system_lag_ms, 0.95), 3) AS p95_entry_lag_ms, round(quantile_cont(ingest_lag_ms, 0.95), 3) AS p95_shipping_lag_ms,
    round(avg(enter_system_lag_ms), 3) AS avg_entry_lag_ms, round(avg(ingest_lag_ms), 3) AS avg_shipping_lag_ms FROM entity_rows GROUP BY ALL),
  rollup AS (SELECT *, sum(doc_count) OVER w::BIGINT AS fleet_count, sum(ef_count) OVER w::BIGINT AS fleet_ef_count, false AS imputed FROM rollup0 WINDOW w AS (PARTITION BY ts, family, entity_kind)),
  cohorts AS (SELECT DISTINCT ts, family, entity_kind, fleet_count, fleet_ef_count FROM rollup),
  imputed AS (SELECT c.ts, c.family, c.entity_kind, e.entity, 0::BIGINT AS doc_count, 0::BIGINT AS ef_count, NULL::DOUBLE AS p95_entry_lag_ms, NULL::DOUBLE AS p95_shipping_lag_ms, NULL::DOUBLE AS avg_entry_lag_ms, NULL::DOUBLE AS avg_shipping_lag_ms, c.fleet_count, c.fleet_ef_count, true AS imputed
    FROM cohorts c JOIN (SELECT DISTINCT family, entity_kind, entity FROM rollup) e USING (family, entity_kind)
    WHERE EXISTS (SELECT 1 FROM rollup x WHERE x.family = c.family AND x.entity_kind = c.entity_kind AND x.entity = e.entity AND x.ts < c.ts AND x.ts >= c.ts - {BACK})
    AND NOT EXISTS (SELECT 1 FROM rollup x WHERE x.family = c.family AND x.entity_kind = c.entity_kind AND x.entity = e.entity AND x.ts = c.ts))"""
META_SQL = f"""{ROLL_SQL}, whole AS (SELECT * FROM rollup UNION ALL SELECT * FROM imputed),
  meta AS (SELECT b.ts, k.family, k.entity_kind, least(count(w.entity), {r.ENTITY_CAP})::BIGINT AS entity_count, count(*) FILTER (w.imputed)::BIGINT AS imputed_count, coalesce(sum(w.doc_count), 0)::BIGINT AS doc_count, count(w.entity) > {r.ENTITY_CAP} AS truncated
    FROM (SELECT DISTINCT ts FROM rollup) b CROSS JOIN (VALUES ('infologger', 'host'), ('infologger', 'node'), ('central', 'host'), ('local', 'host'), ('local', 'node')) k(family, entity_kind)
    LEFT JOIN whole w ON w.ts = b.ts AND w.family = k.family AND w.entity_kind = k.entity_kind GROUP BY ALL)"""


_COMMITTED: dict[tuple[str, str], str] = {}


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily entity rows with imputed silence. They are rolled once an application and read from then on, a partition a bucket.

    So a rule's bounds on `ts` and its cohort reach the scan of the rollup, and raw logs aren't read again.
    """
    key = spark.sparkContext.applicationId, sf_dir
    rows = r.roll(log_events(spark, sf_dir), DAY)
    if key not in _COMMITTED:
        path = f"{home(spark)}/rollup-{uuid.uuid4().hex}"
        rows.unionByName(r.impute(rows, DAY, BACK)).write.partitionBy("ts").parquet(path)
        _COMMITTED[key] = path
    return spark.read.schema(rows.schema).parquet(_COMMITTED[key]).select(*rows.columns)


def rolled_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = rolled(spark, sf_dir)
    return r.meta(whole, whole.where("not imputed"))


@query("rollup_entity", f"WITH {ROLL_SQL} SELECT * FROM rollup")
def rollup_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.roll(log_events(spark, sf_dir), DAY)


@query("impute_silent", f"WITH {ROLL_SQL} SELECT * FROM imputed")
def impute_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.impute(r.roll(log_events(spark, sf_dir), DAY), DAY, BACK)


@query("rollup_meta", f"WITH {META_SQL} SELECT * FROM meta")
def rollup_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolled_meta(spark, sf_dir)


@query("rollup_commit", f"WITH {META_SQL} SELECT ts, NOT bool_or(truncated) AS complete, count(*)::BIGINT AS observed_cohort_count, string_agg(family || '/' || entity_kind || ':' || entity_count || ':' || doc_count, ',' ORDER BY family || '/' || entity_kind) AS cohorts FROM meta GROUP BY ts")
def rollup_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.transform("commit_cohorts", lambda c: F.concat(c["cohort"], F.lit(":"), c["entity_count"].cast("string"), F.lit(":"), c["doc_count"].cast("string")))
    return r.commits(rolled_meta(spark, sf_dir)).select("ts", "complete", "observed_cohort_count", F.array_join(listed, ",").alias("cohorts"))


@query("entity_cap", f"WITH {META_SQL} SELECT ts, family, entity_kind, entity FROM whole QUALIFY row_number() OVER (PARTITION BY ts, family, entity_kind ORDER BY entity) <= {r.ENTITY_CAP}")
def entity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.capped(rolled(spark, sf_dir)).select("ts", "family", "entity_kind", "entity")


@query("fleet_share", f"WITH {ROLL_SQL} SELECT ts, family, entity, round(doc_count / fleet_count, 9) AS share FROM rollup WHERE entity_kind = 'host'")
def fleet_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.roll(log_events(spark, sf_dir), DAY).where("entity_kind = 'host'").select("ts", "family", "entity", F.round(F.col("doc_count") / F.col("fleet_count"), 9).alias("share"))


@query("back_fill", f"WITH {ROLL_SQL} SELECT ts, family, entity_kind, entity, doc_count FROM rollup WHERE ts >= (SELECT max(ts) FROM rollup) - {2 * DAY}")
def back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three buckets rolled again, as each cycle does for late rows; only their records are aggregated."""
    events = log_events(spark, sf_dir)
    last = events.agg((F.floor(F.max("collector_ms") / DAY) * DAY - 2 * DAY).alias("from_ms"))
    recent = events.join(F.broadcast(last)).where(F.col("collector_ms") >= F.col("from_ms")).drop("from_ms")
    return r.roll(recent, DAY).select("ts", "family", "entity_kind", "entity", "doc_count")
