"""Joins of the monitored system: as-of, absence, membership, interval, and edges with keys of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry import catalog


def as_of(events: DataFrame, snapshots: DataFrame, time: str, from_: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each event with the snapshot in force: the one of its keys with the greatest `from_` at or before `time`, or nulls.

    Both sides meet in one ordered stream by key, and a running last value carries the snapshot on: a single
    shuffle, no range join, and no limit on the number of snapshots. Without keys see _as_of_days().
    """
    columns = [c for c in snapshots.columns if c not in (*keys, from_)]
    if not keys:
        return _as_of_days(events, snapshots, time, from_)
    held = snapshots.select(*keys, F.col(from_).alias("t_"), F.lit(0).alias("side_"), F.struct(F.col(from_).alias(from_), *columns).alias("snap_"), F.lit(None).cast(events.schema).alias("event_"))
    asked = events.select(*keys, F.col(time).alias("t_"), F.lit(1).alias("side_"), F.lit(None).cast(held.schema["snap_"].dataType).alias("snap_"), F.struct(*[F.col(c) for c in events.columns]).alias("event_"))
    w = Window.partitionBy(*keys).orderBy("t_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    met = held.unionByName(asked).withColumn("snap_", F.last("snap_", ignorenulls=True).over(w))
    return met.where("side_ = 1").select("event_.*", "snap_.*")


def _as_of_days(events: DataFrame, snapshots: DataFrame, time: str, from_: str, day_ms: int = 86_400_000) -> DataFrame:
    """as_of() without keys, by day: each day has the snapshot that it begins with and those that take effect within it.

    So events meet the few snapshots of their own day by an equi join. Only distinct days and snapshots pass through one task, to carry the last
    snapshot on from day to day. Of snapshots that take effect at once the last by its other columns counts.
    """
    columns = [c for c in snapshots.columns if c != from_]
    day = lambda c: F.floor(F.col(c) / day_ms)
    held = snapshots.select(F.col(from_).alias("t_"), F.lit(1).alias("side_"), F.struct(F.col(from_).alias(from_), *columns).alias("snap_"))
    days = events.select(day(time).alias("day_")).distinct().select((F.col("day_") * day_ms).alias("t_"), F.lit(0).alias("side_"), F.lit(None).cast(held.schema["snap_"].dataType).alias("snap_"))
    w = Window.partitionBy(F.lit(0)).orderBy("t_", "side_", "snap_").rowsBetween(Window.unboundedPreceding, 0)
    begins = days.unionByName(held).withColumn("snap_", F.last("snap_", ignorenulls=True).over(w)).where((F.col("side_") == 0) & F.col("snap_").isNotNull())
    within = held.select(day("t_").alias("day_"), "snap_")
    offered = begins.select(day("t_").alias("day_"), "snap_").unionByName(within)
    until = F.lead(F.col("snap_")[from_]).over(Window.partitionBy("day_").orderBy("snap_"))
    offered = offered.withColumn("until_", until)
    inside = (F.col(time) >= F.col("snap_")[from_]) & (F.col("until_").isNull() | (F.col(time) < F.col("until_")))
    met = events.withColumn("at_day_", day(time)).join(offered, (F.col("at_day_") == F.col("day_")) & inside, "left")
    return met.select(*[events[c] for c in events.columns], "snap_.*")


def lookup(rows: DataFrame, dimension: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """Left join with a dimension; what isn't found is the sentinel, never null."""
    side = dimension.select(*keys, *[F.col(c).alias(n) for n, c in columns.items()])
    return rows.join(side, list(keys), "left").withColumns({n: F.coalesce(n, F.lit(catalog.NONE)) for n in columns})


def heartbeat_absence(roster: DataFrame, seen: DataFrame, key: str, time: str, now_ms: int, grace_ms: int) -> DataFrame:
    """A row for each rostered key: missing (0 or 1) and age_ms; no roster gives no rows."""
    last = seen.groupBy(key).agg(F.max(time).alias("last_ms"))
    age = F.lit(now_ms) - F.col("last_ms")
    return roster.select(key).distinct().join(last, key, "left").select(key, F.when(age <= grace_ms, 0).otherwise(1).alias("missing"), age.alias("age_ms"))


def uncovered(rows: DataFrame, *covers: tuple[DataFrame, str], exempt: Column | None = None) -> DataFrame:
    """Rows that no cover has by its column: an OR of memberships as one anti join each."""
    out = rows if exempt is None else rows.where(~exempt)
    for side, column in covers:
        out = out.join(side.select(column).distinct(), column, "left_anti")
    return out


def members(rows: DataFrame, lists: DataFrame, row_key: str, by: dict[str, str], list_key: str) -> DataFrame:
    """Pairs (list_key, row_key) where the row's column is in the list's array, for any (column, array) of `by`.

    Each array is exploded and met by an equi join; the union of the pairs replaces a nested loop with OR.
    """
    out = None
    for column, array in by.items():
        flat = lists.select(list_key, F.explode(array).alias(column))
        pairs = rows.select(row_key, column).join(flat, column).select(list_key, row_key)
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def candidate_causes(episodes: DataFrame, edges: DataFrame, most: int = catalog.MAX_CAUSES, prior: float = catalog.UNMEASURED_PRIOR) -> DataFrame:
    """For each firing episode that has any: its causes by falling probability, their combined belief, and how sure it is.

    An edge names the labels that cause and symptom must share. There are few distinct label sets, so edges are split by
    set and each is an equi join; the first cause by id stands for all that share the labels.
    """
    firing = episodes.where("state = 'firing'")
    found = None
    for keys in (("cluster_id",), ("cluster_id", "collector_id")):
        some = edges.where(F.array_sort("equal") == F.array(*[F.lit(k) for k in sorted(keys)]))
        first = firing.groupBy(F.col("alertname").alias("cause"), *keys).agg(F.min(F.struct("incident_id", "opened_at")).alias("c"), F.max(F.struct("incident_id", "opened_at")).alias("c2"))
        hits = firing.join(F.broadcast(some.withColumnRenamed("symptom", "alertname")), "alertname").join(first, ["cause", *keys])
        hits = hits.withColumn("c", F.when(F.col("c.incident_id") == F.col("incident_id"), F.col("c2")).otherwise(F.col("c"))).where(F.col("c.incident_id") != F.col("incident_id"))
        hits = hits.select("incident_id", "opened_at", "cause", F.coalesce("probability", F.lit(prior)).alias("p"), F.col("probability").isNotNull().alias("measured"), F.col("c.opened_at").alias("cause_opened"), F.col("c.incident_id").alias("cause_id"))
        found = hits if found is None else found.unionByName(hits)
    w = Window.partitionBy("incident_id").orderBy(F.desc("p"), "cause")
    best = found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    listed = F.array_sort(F.collect_list(F.struct("k", "cause", "cause_id")))
    return best.groupBy("incident_id").agg(
        F.transform(listed, lambda x: x["cause"]).alias("causes"), F.transform(listed, lambda x: x["cause_id"]).alias("cause_ids"),
        F.round(1 - F.product(1 - F.col("p")), 4).alias("belief"), F.bool_and("measured").alias("measured"), F.bool_and(F.col("cause_opened") <= F.col("opened_at")).alias("precedes"),
    )


def inhibited(episodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Episodes left when proven causes that fire mute their symptoms."""
    proven = edges.where("proven")
    out = episodes
    for keys in (("cluster_id",), ("cluster_id", "collector_id")):
        some = proven.where(F.array_sort("equal") == F.array(*[F.lit(k) for k in sorted(keys)])).select("cause", F.col("symptom").alias("alertname"))
        muted = episodes.where("state = 'firing'").select(F.col("alertname").alias("cause"), *keys).distinct().join(F.broadcast(some), "cause").select("alertname", *keys).distinct()
        out = out.join(muted, ["alertname", *keys], "left_anti")
    return out


def cause_intervals(signals: DataFrame, edges: DataFrame, window_ms: int = 120_000, scope: str = "scope") -> DataFrame:
    """cause, symptom, scope and lead_ms where a cause's and a symptom's first signals in a scope lie within the window."""
    first = signals.groupBy("alertname", scope).agg(F.min("ts").alias("first_ms"))
    causes = first.select(F.col("alertname").alias("cause"), scope, F.col("first_ms").alias("cause_ms"))
    symptoms = first.select(F.col("alertname").alias("symptom"), scope, F.col("first_ms").alias("symptom_ms"))
    met = causes.join(F.broadcast(edges.select("cause", "symptom").distinct()), "cause").join(symptoms, ["symptom", scope])
    lead = F.col("symptom_ms") - F.col("cause_ms")
    return met.where(F.abs(lead) <= window_ms).select("cause", "symptom", scope, lead.alias("lead_ms"), (lead < 0).alias("late"))
