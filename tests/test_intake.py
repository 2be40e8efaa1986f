"""Record stages, overlapping reads and folds on literal rows: nulls, empty tables and failures."""

import pytest
from pyspark.sql import functions as F

from skerry.operators import aggregates, metrics, ordered, projection, quality, records
from skerry.sources.incremental import Lane


def test_a_failed_cycle_leaves_the_mark(spark, tmp_path):
    lane = Lane(str(tmp_path), "a", overlap_ms=10, first_ms=100)
    rows = spark.createDataFrame([(t,) for t in (850, 895, 950, 990)], "t long")
    seen = []
    with pytest.raises(RuntimeError):
        lane.cycle(rows, "t", 1000, lambda df: (_ for _ in ()).throw(RuntimeError()))
    assert lane.mark(spark) is None and lane.lower(spark, 1000) == 890
    assert lane.cycle(rows, "t", 1000, lambda df: seen.extend(r.t for r in df.collect())) == 990
    assert sorted(seen) == [895, 950, 990] and lane.lower(spark, 5000) == 980
    late = spark.createDataFrame([(981,), (970,)], "t long")
    seen.clear()
    assert lane.cycle(late, "t", 5000, lambda df: seen.extend(r.t for r in df.collect())) == 981 and seen == [981]
    assert lane.cycle(late.where("false"), "t", 6000, lambda df: None) == 980  # nothing new: the mark stays where it was
    assert lane.mark(spark) == 990


def test_record_stages_and_nulls(spark):
    rows = spark.createDataFrame([("x", None), (None, 1), ("y", 2)], "origin_host string, n int")
    assert {r.origin_host for r in records.without(rows, "origin_host", "x").collect()} == {None, "y"}
    assert records.modified(rows, ["n"], node="a").columns == ["origin_host", "node"] and records.modified(rows.where("false"), ["n"]).count() == 0
    live = records.live(spark.createDataFrame([(None, "", "h", None, None)], "severity string, hostname string, host string, message string, log string")).first()
    assert (live.severity_norm, live.origin_host, live.message) == ("unknown", "h", "")


def test_a_new_epoch_has_an_unknown_gap(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 4), (3, "b", 1), (4, "b", 1), (5, "b", 3)], "k int, e string, s long").withColumn("one", F.lit(1))
    got = [(r.gap, r.unknown, r.duplicate) for r in ordered.epoch_gaps(rows, "s", "e", ["one"], ["k"]).orderBy("k").collect()]
    assert got == [(0, False, False), (2, False, False), (None, True, False), (0, False, True), (1, False, False)]


def test_tree_totals():
    text = '{"x": [{"k": 2}, {"k": {"a": 3, "b": 1.5, "c": {"d": 9}, "e": true}}], "k": 4, "y": {"z": {"k": -1}}, "s": "\\"k\\": 7"}'
    assert aggregates.tree_total(text, "k") == 8 and aggregates.tree_total(None, "k") == 0 and aggregates.tree_total("no", "k") == 0


def test_nearest_ranks(spark):
    rows = spark.createDataFrame([("a", v) for v in (5, 1, 9, 9, 3)] + [("b", 7), ("c", None)], "k string, v long")
    got = {r.k: (r.lo, r.mid, r.hi) for r in aggregates.nearest_ranks(rows, ["k"], "v", lo=0.0, mid=0.5, hi=0.95).collect()}
    assert got == {"a": (1, 5, 9), "b": (7, 7, 7), "c": (0, 0, 0)}


def test_health_documents_that_lack_parts(spark):
    bodies = spark.createDataFrame([(1, "{}"), (2, None), (3, '{"status":{"overall":{"state":"green"}}}')], "ts long, body string")
    assert [(r.ts, r.osd_state, r.osd_state_code) for r in metrics.dashboards(bodies).orderBy("ts").collect()] == [(1, "unknown", 3), (2, "unreachable", 3), (3, "green", 0)]
    assert [(r.ts, r.cluster_status_code, r.active_shards) for r in metrics.cluster(bodies.where("ts = 1")).collect()] == [(1, 3, 0)]
    nodes = metrics.nodes(bodies.where("ts = 1"), "ts").first()
    assert (nodes.os_node, nodes.disk_used_percent, nodes.indexing_delta, nodes.admission_rejections_delta) == ("unknown", 0.0, 0, 0)
    assert metrics.indices(bodies.where("false"), "ts").count() == 0


EPISODE = "incident_id string, group_id string, entity_id string, state string, episode_state string, severity string, class string, alertname string, opened_at long, last_seen long, member_count long, worst_grade double"


def test_a_board_of_a_large_group_lists_its_latest(spark):
    rows = [(f"i{k}", "g", f"e{k:03d}", "firing", "OPEN", "warn", "single", "collector-down", k, 1000 + k, 2, k / 100) for k in range(60)] + [("z", "g", "e000", "resolved", "RESOLVED", "page", "single", "x", 0, 9999, 5, 1.0)]
    card = projection.board(spark.createDataFrame(rows, EPISODE)).first()
    assert (card.episodes, card.entity_total, card.members, card.worst, card.last, len(card.children)) == (60, 60, 120, 0.59, 1059, 25)
    assert [c.entity_id for c in card.children[:2]] == ["e059", "e058"]
    silent = spark.createDataFrame([(40, "unknown-mass-silence")], "silent long, class string")
    assert {r["class"] for r in projection.with_mass_class(spark.createDataFrame(rows, EPISODE), silent).where("state = 'firing'").collect()} == {"unknown-mass-silence"}
    assert projection.board(spark.createDataFrame([], EPISODE)).count() == 0


def test_a_detector_episode_says_when_its_members_are_cut(spark, monkeypatch):
    rows = [("i", f"r{k}", "firing", 1000 * k + 1, 0.9, 3) for k in range(5)]
    monkeypatch.setattr(projection, "MAX_MEMBERS", 3)
    episodes = projection.fold_detector("i", iter(_Row(*r[1:]) for r in rows), 3, [])
    assert len(episodes) == 1 and episodes[0]["members"] == ["r0", "r1", "r2"] and episodes[0]["truncated"]


class _Row:
    def __init__(self, source_id, state, window_ms, grade, required):
        self.source_id, self.state, self.window_ms, self.grade = source_id, state, window_ms, grade


def test_a_poisoned_run_passes_only_if_nothing_is_missing(spark):
    seen = spark.createDataFrame([("d1", 2), ("d2", 0)], "detector string, raw_hits long")
    episodes = spark.createDataFrame([("d1", "e"), ("d2", "f")], "name string, episode_id string")
    aimed = spark.createDataFrame([("m1",)], "name string")
    got = {r.name: (r.missing, r.passed) for r in quality.poison_verdict(seen, episodes, aimed, episodes.where("false")).collect()}
    assert got == {"d1": (False, False), "d2": (True, False), "m1": (True, False)}
    fine = quality.poison_verdict(seen.where("raw_hits > 0"), episodes, aimed, spark.createDataFrame([("m1", "x")], "name string, episode_id string"))
    assert {(r.missing, r.passed) for r in fine.collect()} == {(False, True)}
