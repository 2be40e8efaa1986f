"""Threshold, absence and watchdog rules, each a declaration: filter, window, group, aggregates and predicate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MINUTE = 60_000


@dataclass(frozen=True)
class Rule:
    """A monitor. Expressions are SQL over the samples and, in `fires`, over the named aggregates and `n`.

    Windows are closed at both ends. Without a group the rule sees one row, which is there even when no sample is.
    `recent` counts samples of the window's last minutes as n_recent.
    """

    name: str
    where: str
    minutes: int
    fires: str
    group: str | None = None
    values: dict[str, str] = field(default_factory=dict)
    severity: int = 2
    period: int = 1
    recent: int | None = None


#: Thresholds, windows, severities (1 pages, 2 warns) and periods in minutes.
RULES = (
    Rule("collector-down", "kind = 'fleet'", 2, "missing = 1", "collector_id", {"missing": "max(heartbeat_missing)"}, 1),
    Rule("collector-unhealthy", "kind = 'fluentbit'", 2, "healthy = 0", "collector_id", {"healthy": "max(fb_healthy)"}),
    Rule("data-loss", "kind = 'fluentbit'", 2, "dropped > 0", "collector_id", {"dropped": "sum(output_dropped_delta)"}, 1),
    Rule("shipping-breaking", "kind = 'fluentbit'", 2, "failed > 0", "collector_id", {"failed": "sum(output_retries_failed_delta)"}),
    Rule("disk-cliff-warn", "kind = 'node'", 2, "disk > 85 and disk <= 92", "os_node", {"disk": "max(disk_used_percent)"}),
    Rule("disk-cliff-page", "kind = 'node'", 2, "disk > 92", "os_node", {"disk": "max(disk_used_percent)"}, 1),
    Rule("heap-spiral", "kind = 'node'", 5, "heap > 90", "os_node", {"heap": "min(heap_percent)"}),
    Rule("admission-rejections", "kind = 'node'", 5, "rejected > 0", "os_node", {"rejected": "sum(admission_rejections_delta)"}),
    Rule("cluster-red", "kind = 'cluster' and cluster_status_code = 2", 2, "n > 0", severity=1),
    Rule("shards-stuck", "kind = 'cluster'", 5, "stuck > 0", None, {"stuck": "min(unassigned_shards)"}),
    Rule("telemetry-silence", "kind in ('cluster', 'osd')", 5, "n = 0", severity=1),
    Rule("fleet-fb-silence", "kind = 'fleet'", 2, "known > 0 and missing >= 0.5 * known", None, {"missing": "sum(heartbeat_missing)", "known": "count(heartbeat_missing)"}, 1),
    Rule("signal-projector-stale", "kind = 'projector'", 1440, "n > 0 and n_recent = 0", severity=1, recent=10),
    Rule("alertmanager-down", "kind = 'alertmanager'", 5, "n > 0 and up = 0", None, {"up": "max(am_up)"}, 1),
)


def evaluate(rule: Rule, samples: DataFrame, as_of: int, scale: int = 1, time: str = "ts") -> DataFrame:
    """entity, n, the rule's values and `fires`, for every group in the window (or one row); scale stretches the windows."""
    inside = samples.where(F.expr(rule.where) & F.col(time).between(as_of - rule.minutes * MINUTE * scale, as_of))
    aggs = [F.count("*").alias("n"), *[F.expr(e).cast("double").alias(n) for n, e in rule.values.items()]]
    if rule.recent:
        aggs.append(F.count_if(F.col(time) > as_of - rule.recent * MINUTE * scale).alias("n_recent"))
    got = inside.where(F.col(rule.group).isNotNull()).groupBy(F.col(rule.group).alias("entity")).agg(*aggs) if rule.group else inside.agg(*aggs).select(F.lit("all").alias("entity"), "*")
    return got.withColumn("fires", F.coalesce(F.expr(rule.fires), F.lit(False)))


def family_silence(meta: DataFrame, as_of: int, day_ms: int = 86_400_000, recent_ms: int = 40 * MINUTE, min_rows: int = 6, min_docs: int = 50) -> DataFrame:
    """Families whose hosts have all fallen silent while the rollup goes on; a dead rollup has no recent rows and doesn't fire."""
    recent = F.col("ts") >= as_of - recent_ms
    rows = meta.where((F.col("entity_kind") == "host") & (F.col("ts") >= as_of - day_ms) & (F.col("ts") < as_of))
    got = rows.groupBy("family").agg(F.count("*").alias("n_rows"), F.sum("doc_count").alias("docs"), F.count_if(recent).alias("recent_rows"), F.coalesce(F.sum(F.when(recent, F.col("doc_count"))), F.lit(0)).alias("recent_docs"))
    return got.withColumn("fires", (F.col("recent_rows") > 0) & (F.col("recent_docs") == 0) & (F.col("n_rows") >= min_rows) & (F.col("docs") > 0) & (F.col("docs") >= min_docs * F.col("n_rows")))


def rollup_stale(commits: DataFrame, as_of: int, day_ms: int = 86_400_000, recent_ms: int = 40 * MINUTE) -> DataFrame:
    done = commits.where(F.col("complete") & (F.col("ts") >= as_of - day_ms) & (F.col("ts") < as_of))
    got = done.agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= as_of - recent_ms).alias("n_recent"))
    return got.withColumn("fires", (F.col("n") > 0) & (F.col("n_recent") == 0))


def entity_cap(meta: DataFrame, as_of: int, hour_ms: int = 60 * MINUTE, near: int = 1800) -> DataFrame:
    got = meta.where((F.col("ts") >= as_of - hour_ms) & (F.col("ts") < as_of)).agg(F.coalesce(F.max("entity_count"), F.lit(0)).alias("most"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("cut"))
    return got.withColumn("fires", F.col("cut") | (F.col("most") >= near))


def forecast_high(forecasts: DataFrame, as_of: int, limit: float = 85.0, hour_ms: int = 60 * MINUTE) -> DataFrame:
    live = forecasts.where(F.col("task_id").isNull() & F.col("ts").between(as_of - hour_ms, as_of))
    got = live.agg(F.max("forecast_value").alias("highest"))
    return got.withColumn("fires", F.coalesce(F.col("highest") > limit, F.lit(False)))


def high_grade(results: DataFrame, as_of: int, window_ms: int = 2 * MINUTE, least: float = 0.7) -> DataFrame:
    """Fires if the highest grade and the confidence of that very result are both above the limit; historical runs don't count."""
    live = results.where(F.col("task_id").isNull() & F.col("execution_ms").between(as_of - window_ms, as_of))
    got = live.agg(F.max("grade").alias("grade"), F.max_by("confidence", F.struct("grade", "event_id")).alias("confidence"))
    return got.withColumn("fires", F.coalesce((F.col("grade") > least) & (F.col("confidence") > least), F.lit(False)))
