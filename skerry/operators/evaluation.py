"""Scoring of a run with injected faults: losslessness, purity, notification and causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def burst_size(p95: Column, step: int, least: int, most: int) -> Column:
    """Records of a poison step: 12 times the p95, three times as many each step, within bounds."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(p95 * 12 * 3 ** (step - 1)))).cast("long")


def unprojected(raw: DataFrame, raw_id: str, signals: DataFrame, kind: str) -> DataFrame:
    """Raw rows that became no signal of a kind."""
    seen = signals.where(F.col("source_kind") == kind).select(F.col("source_id").alias(raw_id)).distinct()
    return raw.join(seen, raw_id, "left_anti")


def impure(signals: DataFrame, by: str = "incident_id") -> DataFrame:
    """Incidents that hold more than one entity, collector, topology or kind of entity."""
    columns = ("entity_id", "collector_id", "topology_version", "entity_kind")
    counts = signals.groupBy(by).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])
    return counts.where(F.greatest(*[F.col(f"n_{c}") for c in columns]) > 1)


def fragmented(signals: DataFrame) -> DataFrame:
    """Alerts with more incidents than entities."""
    got = signals.groupBy("alertname", "entity_kind").agg(F.count_distinct("incident_id").alias("incidents"), F.count_distinct("entity_id").alias("entities"))
    return got.where("incidents > entities")


def edge_evidence(intervals: DataFrame, signals: DataFrame, scope: str = "scope") -> DataFrame:
    """Measured probability of each edge: scopes with both within the window, of scopes with the cause."""
    had = signals.groupBy(F.col("alertname").alias("cause")).agg(F.count_distinct(scope).alias("scopes"))
    hits = intervals.where("not late").groupBy("cause", "symptom").agg(F.count_distinct(scope).alias("hits"))
    return hits.join(had, "cause").select("cause", "symptom", "hits", "scopes", F.round(F.col("hits") / F.col("scopes"), 4).alias("probability"))


def time_to(events: DataFrame, starts: DataFrame, key: str, time: str, start: str, name: str) -> DataFrame:
    """How long after its start each key's first event came; null if none did."""
    first = events.groupBy(key).agg(F.min(time).alias("first_ms"))
    return starts.select(key, start).join(first, key, "left").select(key, (F.col("first_ms") - F.col(start)).alias(name))


def verdict(**failures: DataFrame) -> DataFrame:
    """rule, n and passed: a row for each named table of failures, empty ones too."""
    out = None
    for rule, rows in failures.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n", (F.col("n") == 0).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out
