"""Expectations: each returns the rows that violate it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unlabelled(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows with a label that is null or empty instead of a sentinel."""
    bad = F.lit(False)
    for c in labels:
        bad = bad | F.col(c).isNull() | (F.col(c) == "")
    return rows.where(bad)


def disordered(snapshots: DataFrame, order: str, time: str) -> DataFrame:
    """Snapshots whose time doesn't rise; snapshots are versions of one topology, so few."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    return snapshots.withColumn("before", F.lag(time).over(w)).where(F.col("before") >= F.col(time)).drop("before")


def symmetric_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.subtract(two).union(two.subtract(one))


def detector_scores(results: DataFrame, floor: float = 0.5) -> DataFrame:
    """Evaluations, hits, best grade and confidence, and distinct hit windows of each detector."""
    hit = F.col("grade") > floor
    return results.groupBy("detector").agg(
        F.count("*").alias("evaluations"), F.count_if(hit).alias("raw_hits"), F.round(F.max("grade"), 6).alias("max_grade"), F.round(F.max("confidence"), 6).alias("max_confidence"),
        F.count_distinct(F.when(hit, F.col("window"))).alias("windows"), (F.count_if(hit) > 0).alias("detected"),
    )


def poison_verdict(detectors: DataFrame, detector_episodes: DataFrame, monitors: DataFrame, monitor_episodes: DataFrame) -> DataFrame:
    """kind, name, raw_hits, episodes, missing and passed of a poisoned run: a row for each detector and monitor that should have seen it.

    detectors: detector_scores(); monitors: names that were aimed at; the episodes have a name and an episode_id. A detector is
    missing without a hit or an episode, a monitor without an episode; `passed` is the whole run's: nothing is missing.
    """
    seen = lambda e: e.groupBy("name").agg(F.count_distinct("episode_id").alias("episodes"))
    one = detectors.select(F.lit("detector").alias("kind"), F.col("detector").cast("string").alias("name"), "raw_hits").join(seen(detector_episodes), "name", "left")
    two = monitors.select(F.lit("monitor").alias("kind"), "name", F.lit(None).cast("long").alias("raw_hits")).join(seen(monitor_episodes), "name", "left")
    rows = one.unionByName(two).withColumn("episodes", F.coalesce("episodes", F.lit(0).cast("long")))
    rows = rows.withColumn("missing", (F.col("episodes") < 1) | F.coalesce(F.col("raw_hits") < 1, F.lit(False)))
    return rows.join(F.broadcast(rows.agg((F.count_if("missing") == 0).alias("passed")))).select("kind", "name", "raw_hits", "episodes", "missing", "passed")


def empty_labels(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """label and n: how many rows have a label null or empty, for those of which any has."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in labels])
    flat = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c in labels])))
    return flat.where("n > 0")


def grouping(episodes: DataFrame, since_ms: int, own_classes: Sequence[str] = ("monitor-error", "entity-missing")) -> DataFrame:
    """One row: open episodes, their groups, the widest one, and what must be 0: recent ones without a group, and without an entity."""
    open_ = episodes.where("state = 'firing'")
    recent = F.col("last_seen") >= since_ms
    nobody = (F.col("entity_id") == "none") & ~F.col("class").isin(*own_classes)
    widest = open_.where(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("widest"))
    got = open_.agg(F.count("*").alias("episodes"), F.count_distinct("group_id").alias("groups"), F.count_if(F.col("group_id").isNull() & recent).alias("ungrouped"), F.count_if(nobody & recent).alias("anonymous"))
    return got.join(F.broadcast(widest))


def mapping_differences(live: Sequence[tuple[str, str]], declared: Sequence[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(field, declared type, live type) of declared fields that a table lacks or has as another type."""
    have = dict(live)
    return [(f, t, have.get(f, "absent")) for f, t in declared if have.get(f) != t]


def over_age(rows: DataFrame, time: str, now_ms: int, keep_ms: int) -> DataFrame:
    """day and n of rows that retention should have deleted."""
    old = rows.where(F.col(time) < now_ms - keep_ms)
    return old.groupBy((F.floor(F.col(time) / 86_400_000) * 86_400_000).alias("day_ms")).agg(F.count("*").alias("n"))


def missing_intervals(samples: DataFrame, key: str, ms: str, interval_ms: int) -> DataFrame:
    """Gaps of each key's samples longer than the interval: from, until and how many samples are missing."""
    w = Window.partitionBy(key).orderBy(ms)
    gaps = samples.withColumn("from_ms", F.lag(ms).over(w)).where(F.col(ms) - F.col("from_ms") > interval_ms)
    return gaps.select(key, "from_ms", F.col(ms).alias("until_ms"), (F.floor((F.col(ms) - F.col("from_ms")) / interval_ms)).alias("missing"))
