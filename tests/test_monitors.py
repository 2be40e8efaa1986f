"""Monitors, detectors and joins with the production constants on literal rows."""

import numpy as np
import pytest

from skerry import catalog
from skerry.operators import detection, joins, monitors

NOW = 10_000_000
SAMPLES = "ts long, kind string, collector_id string, os_node string, heartbeat_missing int, fb_healthy int, output_dropped_delta long, output_retries_failed_delta long, disk_used_percent double, heap_percent double, admission_rejections_delta long, cluster_status_code int, unassigned_shards int, am_up int"
FIELDS = [c.split()[0] for c in SAMPLES.split(", ")]


def fires(spark, name, *rows):
    rule = next(r for r in monitors.RULES if r.name == name)
    data = [tuple({"ts": NOW - 1000, **r}.get(f) for f in FIELDS) for r in rows]
    return {r.entity: r.fires for r in monitors.evaluate(rule, spark.createDataFrame(data, SAMPLES), NOW).collect()}


def test_every_monitor_of_the_catalog_is_there():
    from skerry.plans import registry

    names = {"monitor_" + n.replace("-", "_") for n, *_ in catalog.MONITORS}
    assert names <= set(registry.load()[0])


@pytest.mark.parametrize(
    ("name", "rows", "want"),
    [
        ("collector-down", [{"kind": "fleet", "collector_id": "a", "heartbeat_missing": 1}, {"kind": "fleet", "collector_id": "b", "heartbeat_missing": 0}], {"a": True, "b": False}),
        ("collector-unhealthy", [{"kind": "fluentbit", "collector_id": "a", "fb_healthy": 0}, {"kind": "fluentbit", "collector_id": "b", "fb_healthy": 0}, {"kind": "fluentbit", "collector_id": "b", "fb_healthy": 1}], {"a": True, "b": False}),
        ("disk-cliff-warn", [{"kind": "node", "os_node": "a", "disk_used_percent": 92.0}, {"kind": "node", "os_node": "b", "disk_used_percent": 92.1}, {"kind": "node", "os_node": "c", "disk_used_percent": 85.0}], {"a": True, "b": False, "c": False}),
        ("disk-cliff-page", [{"kind": "node", "os_node": "a", "disk_used_percent": 92.1}], {"a": True}),
        ("heap-spiral", [{"kind": "node", "os_node": "a", "heap_percent": 95.0}, {"kind": "node", "os_node": "a", "heap_percent": 89.0}], {"a": False}),
        ("telemetry-silence", [{"kind": "fleet"}], {"all": True}),
        ("telemetry-silence", [{"kind": "osd"}], {"all": False}),
        ("cluster-red", [{"kind": "cluster", "cluster_status_code": 2}], {"all": True}),
        ("fleet-fb-silence", [{"kind": "fleet", "heartbeat_missing": 1}, {"kind": "fleet", "heartbeat_missing": 0}], {"all": True}),
        ("fleet-fb-silence", [{"kind": "osd"}], {"all": False}),
        ("shards-stuck", [{"kind": "cluster", "unassigned_shards": 1}, {"kind": "cluster", "unassigned_shards": 0}], {"all": False}),
        ("signal-projector-stale", [{"kind": "projector", "ts": NOW - 700_000}], {"all": True}),
        ("signal-projector-stale", [{"kind": "projector"}], {"all": False}),
        ("alertmanager-down", [{"kind": "alertmanager", "am_up": 0}], {"all": True}),
        ("alertmanager-down", [{"kind": "osd"}], {"all": False}),
    ],
)
def test_rule(spark, name, rows, want):
    assert fires(spark, name, *rows) == want


def test_windows_are_closed_at_both_ends(spark):
    row = {"kind": "fleet", "collector_id": "a", "heartbeat_missing": 1}
    assert fires(spark, "collector-down", row | {"ts": NOW - 120_000}) == {"a": True}
    assert fires(spark, "collector-down", row | {"ts": NOW - 120_001}) == {}


META = "ts long, family string, entity_kind string, entity_count long, doc_count long, truncated boolean"


def test_a_dead_rollup_is_not_a_silent_family(spark):
    now = 200 * 600_000
    old = [(now - k * 600_000, "local", "host", 3, 900, False) for k in range(5, 20)]
    silent = [(now - k * 600_000, "local", "host", 3, 0, False) for k in range(1, 5)]
    assert monitors.family_silence(spark.createDataFrame(old + silent, META), now).first().fires
    assert not monitors.family_silence(spark.createDataFrame(old, META), now).first().fires


def test_high_grade_needs_the_confidence_of_the_same_result(spark):
    rows = [(NOW, 0.9, 0.5, None, 1), (NOW, 0.8, 0.9, None, 2), (NOW, 1.0, 1.0, "task", 3)]
    df = spark.createDataFrame(rows, "execution_ms long, grade double, confidence double, task_id string, event_id long")
    assert not monitors.high_grade(df, NOW).first().fires and monitors.high_grade(df.where("grade < 0.85"), NOW).first().fires


def test_forest_finds_the_odd_point_and_repeats_itself():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(300, 4))
    points[123] += 12
    s = detection.score(points)
    assert s.argmax() == 123 and (s == detection.score(points)).all()


def test_as_of_takes_the_snapshot_in_force(spark):
    snaps = spark.createDataFrame([("v1", 10), ("v2", 20)], "version string, effective_from long")
    events = spark.createDataFrame([(5,), (10,), (19,), (20,), (99,)], "t long")
    assert [(r.t, r.version) for r in joins.as_of(events, snaps, "t", "effective_from").orderBy("t").collect()] == [(5, None), (10, "v1"), (19, "v1"), (20, "v2"), (99, "v2")]
    keyed = joins.as_of(events.selectExpr("'k' AS k", "t"), snaps.selectExpr("'k' AS k", "version", "effective_from"), "t", "effective_from", ["k"])
    assert [(r.t, r.version) for r in keyed.orderBy("t").collect()] == [(5, None), (10, "v1"), (19, "v1"), (20, "v2"), (99, "v2")]
