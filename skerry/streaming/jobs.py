"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skerry.operators import projection, rollup
from skerry.sources import sinks


def event_stream(spark: SparkSession, path: str, per_trigger: int = 8) -> DataFrame:
    """A Parquet table's files as a stream, with its schema; `ts` becomes a zoned timestamp, which watermarks ask for."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, time: str, width: str, settle: str, keys: list[str], *aggs: Column) -> DataFrame:
    """Windows that close `settle` after their end, by collector time: replayed records are weeks old by their own clock."""
    return events.withWatermark(time, settle).groupBy(F.window(time, width), *keys).agg(*aggs)


def sliding(events: DataFrame, time: str, width: str, step: str, settle: str, keys: list[str], *aggs: Column) -> DataFrame:
    return events.withWatermark(time, settle).groupBy(F.window(time, width, step), *keys).agg(*aggs)


def deduplicated(events: DataFrame, time: str, keys: list[str], within: str = "60 seconds") -> DataFrame:
    """The first of events that share keys within the watermark."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """All that is there now, batch by batch, then stop; a restart goes on after the last batch that succeeded."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query


def upsert_each(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch function that upserts: late rows correct their bucket, and a batch that runs twice changes nothing."""
    return lambda batch, _: sinks.upsert(batch, path, keys)


def rollup_each(root: str, bucket_ms: int, back_fill: int = rollup.BACK_FILL, back_ms: int = sinks.DAY_MS) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps records, then rolls the last buckets again, imputes silence and commits them, rows first.

    That is back-fill: late records within the last `back_fill` buckets are counted, unlike with a watermark. A batch's records stand in a
    folder of its own number, so a batch that runs twice replaces what it wrote. Of records and of committed rows only the
    days that the buckets and the look-back touch are read.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        day = F.floor(F.col("collector_ms") / sinks.DAY_MS)
        batch.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{root}/events/batch={number}")
        touched = batch.agg(F.min("collector_ms"), F.max("collector_ms")).first()
        if touched[0] is None:
            return
        first = max(touched[0], touched[1] - (back_fill - 1) * bucket_ms) // bucket_ms * bucket_ms
        recent = spark.read.parquet(f"{root}/events").where((F.col("day") >= first // sinks.DAY_MS) & (F.col("collector_ms") >= first)).drop("day", "batch")
        spoken = rollup.roll(recent, bucket_ms)
        known = spoken
        if sinks.exists(spark, f"{root}/rows"):
            earlier = spark.read.parquet(f"{root}/rows").where((F.col("day") >= (first - back_ms) // sinks.DAY_MS) & (F.col("ts") >= first - back_ms) & (F.col("ts") < first) & ~F.col("imputed"))
            known = spoken.unionByName(earlier.drop("day"))
        staged = f"{root}/staged-{number}"  # computed once, and free of the tables that the commit replaces
        spoken.unionByName(rollup.impute(known, bucket_ms, back_ms).where(F.col("ts") >= first)).write.mode("overwrite").parquet(staged)
        rows = spark.read.parquet(staged)
        meta = rollup.meta(rows, rows.where("not imputed"))
        sinks.commit_bucket(rows, meta, rollup.commits(meta), root)
        sinks.remove(spark, staged)

    return each


def heartbeat_watch(seen: DataFrame, key: str, time: str, roster: DataFrame, now_ms: Callable[[], int], grace_ms: int, report: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """After every batch, what each rostered key's heartbeat says; a key that never spoke is reported too, as the roster leads."""
    from skerry.operators.joins import heartbeat_absence

    last = seen.groupBy(key).agg(F.max(time).alias(time))

    def each(batch: DataFrame, _: int) -> None:
        report(heartbeat_absence(roster, batch, key, time, now_ms(), grace_ms))

    return run_once(last, each, checkpoint, "complete")


_STATE = "episodes string"


def detector_lifecycle(signals: DataFrame, overdue_ms: int | None = 360_000) -> DataFrame:
    """Episodes of detector signals, kept as state by incident: updated as results arrive, stale when they stop.

    Rows: incident_id, source_id, state, window_ms, grade, healthy_required. Replayed results change nothing, since breach and
    healthy marks only move forward. Without overdue_ms nothing turns stale: a query that is to stop when all is read needs
    that, since a timer keeps it alive.
    """
    import json

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        episodes = json.loads(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            for e in episodes:
                if e["episode_state"] not in projection.TERMINAL:
                    e["episode_state"] = "STALE"
        else:
            rows = pd.concat(list(batches)).sort_values(["window_ms", "state", "source_id"])
            found = [SimpleNamespace(**r) for r in rows.to_dict("records")]
            for e in episodes:
                if e["episode_state"] == "STALE":
                    e["episode_state"] = "OPEN"
            episodes = projection.fold_detector(key[0], iter(found), int(rows["healthy_required"].iloc[0]), episodes)
        state.update((json.dumps(episodes, default=int),))
        if overdue_ms is not None:
            state.setTimeoutDuration(overdue_ms)
        names = [c.split()[0] for c in projection.DETECTOR_EPISODE.split(", ")]
        yield pd.DataFrame(episodes, columns=names).astype({"resolved_at": "Int64"})

    return signals.groupBy("incident_id").applyInPandasWithState(step, projection.DETECTOR_EPISODE, _STATE, "update", GroupStateTimeout.NoTimeout if overdue_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def resend_open(episodes: Callable[[], DataFrame], send: Callable[[DataFrame], None], spark: SparkSession, checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """Send every open episode on each tick: the receiver's resolve timeout must be over twice the tick."""

    def each(_: DataFrame, __: int) -> None:
        send(projection.payloads(episodes().where("state = 'firing'")))

    return spark.readStream.format("rate").load().writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(each).start()
