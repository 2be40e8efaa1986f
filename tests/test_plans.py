"""What plans must look like to hold at scale: bounds in the scan, one scan of a rollup, and no nested loops."""

import pytest
from pyspark.sql import functions as F

from skerry.functions import parsing as p
from skerry.operators import joins
from skerry.plans import registry

from .conftest import SF

QUERIES, _ = registry.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["monitor_trend_il_volume", "monitor_trend_central_errors", "monitor_trend_local_entry_lag", "flagship_volume_verdict"])
def test_trend_rules_read_the_committed_rollup_once(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert text.count("FileScan") == 1 and "Join" not in text
    filters = text.partition("PartitionFilters: [")[2].partition("]")[0]
    assert "ts#" in filters and ">=" in filters and "<" in filters
    assert "EqualTo(family" in text and "EqualTo(entity_kind" in text


@pytest.mark.parametrize("name", ["monitor_collector_down", "monitor_heap_spiral", "monitor_telemetry_silence"])
def test_bounds_of_time_reach_the_scan(spark, name):
    pushed = plan(QUERIES[name](spark, SF)).partition("PushedFilters: [")[2].partition("ReadSchema")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed


@pytest.mark.parametrize("name", ["snapshot_asof", "roster_asof", "host_history_asof", "causal_candidates", "notification_membership"])
def test_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, SF).select(F.lit(1)))
    # the roster of the test tables is its own hosts by five weeks, which is the one nested loop that may be there
    assert text.count("NestedLoop") <= text.count("Range (0, 5")
    assert "CartesianProduct" not in text


def test_as_of_by_day_against_a_plain_version(spark):
    day = 86_400_000
    snapshots = [("v1", day // 2), ("v2", 2 * day), ("v3", 2 * day + 5), ("v4", 9 * day), ("tie a", 12 * day), ("tie b", 12 * day)]
    times = [0, day // 2 - 1, day // 2, day, 2 * day - 1, 2 * day, 2 * day + 4, 2 * day + 5, 8 * day, 9 * day, 30 * day, 12 * day + 1, None]
    got = joins.as_of(spark.createDataFrame([(k, t) for k, t in enumerate(times)], "k int, t long"), spark.createDataFrame(snapshots, "v string, since long"), "t", "since")
    want = {k: max(((s, v) for v, s in snapshots if t is not None and s <= t), default=(None, None)) for k, t in enumerate(times)}
    assert {r.k: (r.since, r.v) for r in got.collect()} == want


def test_clocks_of_every_type(spark):
    rows = spark.createDataFrame([(1704067200.0, 1704067200.5, 1704067200123.0, 1704067200, "1704067200.9", "1.7E9", None)], "a double, b double, c double, d long, e string, f string, g double")
    got = rows.select(*[p.epoch_ms(F.col(c)).alias(c) for c in rows.columns]).first()
    assert tuple(got) == (1704067200000, 1704067200000, 1704067200123, 1704067200000, 1704067200000, 1000, -1)


def test_tokens_are_whole_words(spark):
    texts = ["a refused_connection", "Connection REFUSED.", "refused", "unrefused", "tcp2", None, "x-tcp-y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert {r.k for r in rows.where(p.any_token(F.col("t"), "refused", "TCP")).collect()} == {1, 2, 6}
