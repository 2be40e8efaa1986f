"""Episodes: hysteresis, replay, ageing, causes, imputation and trend verdicts on literal rows."""

import random

from pyspark.sql import functions as F

from skerry import catalog
from skerry.operators import joins, projection, rollup

ALERT = "incident_id string, source_id string, state string, severity string, first_seen long, last_seen long, end_time long, healthy_required int"


def episodes(spark, rows, required):
    data = [("i", f"s{k}", "resolved" if end else "firing", "warn", start, end or start, end, required) for k, (start, end) in enumerate(rows)]
    got = projection.monitor_episodes(spark.createDataFrame(data, ALERT)).orderBy("opened_at").collect()
    return [(r.opened_at, r.episode_state, len(r.members)) for r in got]


def test_flapping_below_the_count_is_one_open_episode(spark):
    assert episodes(spark, [(1000, 2000), (3000, 4000), (5000, None)], 3) == [(1000, "OPEN", 3)]


def test_three_clearings_close_and_the_next_breach_opens_another(spark):
    assert episodes(spark, [(1000, 1500), (2000, 2500), (3000, 3500), (5000, None)], 3) == [(1000, "RESOLVED", 3), (5000, "OPEN", 1)]


def test_one_clearing_closes_where_one_is_asked_for(spark):
    assert episodes(spark, [(1000, 2000), (5000, None)], 1) == [(1000, "RESOLVED", 1), (5000, "OPEN", 1)]


def test_order_of_rows_does_not_matter(spark):
    rows = [(1000, 1500), (2000, 2500), (3000, 3500), (5000, None), (7000, 7100)]
    want = episodes(spark, rows, 3)
    data = [("i", f"s{k}", "resolved" if e else "firing", "warn", s, e or s, e, 3) for k, (s, e) in enumerate(rows)]
    random.Random(1).shuffle(data)
    got = projection.monitor_episodes(spark.createDataFrame(data, ALERT)).orderBy("opened_at").collect()
    assert [(r.opened_at, r.episode_state, len(r.members)) for r in got] == want


class Row:
    def __init__(self, window_ms, grade):
        self.window_ms, self.grade, self.state, self.source_id = window_ms, grade, "firing" if grade > 0.5 else "evidence", f"r{window_ms}"


def test_detector_recovers_after_k_healthy_windows_and_replay_changes_nothing():
    rows = [Row(10_000, 0.9), Row(70_000, 0.0), Row(130_000, 0.0), Row(190_000, 0.0), Row(250_000, 0.8)]
    got = projection.fold_detector("i", rows, 3, [])
    assert [(e["opened_at"], e["episode_state"]) for e in got] == [(10_000, "RESOLVED"), (250_000, "OPEN")]
    ids = [e["episode_id"] for e in got]
    for _ in range(3):
        got = projection.fold_detector("i", rows, 3, got)
    assert [e["episode_id"] for e in got] == ids and [e["episode_state"] for e in got] == ["RESOLVED", "OPEN"]


def test_two_healthy_windows_only_recover():
    got = projection.fold_detector("i", [Row(1, 0.9), Row(2, 0.0), Row(3, 0.0)], 3, [])
    assert got[0]["episode_state"] == "RECOVERING" and got[0]["state"] == "firing"


def test_monitor_in_error_and_alert_without_entity_point_at_the_monitor(spark):
    alerts = spark.createDataFrame(
        [("a", "data-loss", "ERROR", "1", "node-1", 1, 2, None), ("b", "data-loss", "ACTIVE", "2", None, 1, 2, None), ("c", "data-loss", "COMPLETED", "2", "node-2", 1, 2, 3), ("d", "unknown", "ACTIVE", "2", "x", 1, 2, None)],
        "id string, monitor_name string, state string, severity string, bucket_key string, first_seen long, last_seen long, end_time long",
    )
    got = {r.source_id: r for r in projection.alert_signals(alerts, catalog.monitors(spark)).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"]["class"], got["a"].entity_id, got["a"].severity) == ("monitor-error", "data-loss", "page")
    assert (got["b"]["class"], got["b"].entity_kind, got["b"].scope_label) == ("entity-missing", "monitor", "collector:none")
    assert (got["c"].state, got["c"].collector_id, got["c"].group_id) == ("resolved", "node-2", "logs/data-loss/collector:node-2")


def test_catalog_sizes(spark):
    assert catalog.monitors(spark).count() == 28 and catalog.detectors(spark).count() == 17 and catalog.edges(spark).count() == 22


def test_causes_share_the_labels_of_their_edge(spark):
    rows = [("e1", "collector-down", "firing", "c", "n1", 5), ("e2", "data-loss", "firing", "c", "n1", 9), ("e3", "data-loss", "firing", "c", "n2", 9), ("e4", "fleet-fb-silence", "resolved", "c", "none", 1)]
    got = joins.candidate_causes(spark.createDataFrame(rows, "incident_id string, alertname string, state string, cluster_id string, collector_id string, opened_at long"), catalog.edges(spark)).collect()
    assert [(r.incident_id, r.causes, r.cause_ids, r.belief, r.measured, r.precedes) for r in got] == [("e2", ["collector-down"], ["e1"], 0.5, False, True)]


EVENTS = "collector_ms long, family string, origin_host string, node string, severity_norm string, enter_system_lag_ms long, ingest_lag_ms long"


def test_silent_host_gets_a_zero_row_that_does_not_inflate_the_fleet(spark):
    rows = [(0, "infologger", h, "n1", "info", 5, 6) for h in ("epn1", "epn2", "epn3")] + [(600_000, "infologger", "epn1", "n1", "error", 5, 6)] * 500 + [(600_000, "infologger", "epn2", "n1", "info", 5, 6)] * 400
    rolled = rollup.roll(spark.createDataFrame(rows, EVENTS))
    zero = rollup.impute(rolled).where("entity_kind = 'host'").collect()
    assert [(r.ts, r.entity, r.doc_count, r.fleet_count, r.fleet_ef_count, r.p95_entry_lag_ms, r.imputed) for r in zero] == [(600_000, "epn3", 0, 900, 500, None, True)]


def test_an_empty_cohort_imputes_nothing_but_has_a_meta_row(spark):
    rows = [(0, "local", "epn1", "n1", "info", 5, 6), (1_200_000, "infologger", "epn9", "n1", "info", 5, 6)]
    rolled = rollup.roll(spark.createDataFrame(rows, EVENTS))
    assert rollup.impute(rolled).count() == 0
    meta = rollup.meta(rolled, rolled)
    assert meta.count() == 10 and meta.where("entity_count = 0").count() == 6
    assert rollup.commits(rollup.meta(rolled, rolled, cap=0)).where("complete").count() == 0


ROLL = "ts long, entity string, doc_count long, fleet_count long, ef_count long, lag double"
UNIT = rollup.BUCKET_MS


def _rows(entity, base, slices):
    old = [(k * UNIT, entity, base[0], base[1], 1, 100.0) for k in range(90, 96)]
    return old + [((96 + k) * UNIT, entity, d, f, e, lag) for k, (d, f, e, lag) in enumerate(slices)]


def test_volume_verdict_with_the_production_constants(spark):
    hot = _rows("hot", (100, 1000), [(250, 1000, 0, 1.0)] * 3)
    cold = _rows("cold", (100, 1000), [(40, 1000, 0, 1.0)] * 3)
    mixed = _rows("mixed", (100, 1000), [(250, 1000, 0, 1.0), (250, 1000, 0, 1.0), (100, 1000, 0, 1.0)])
    dead = _rows("dead", (100, 1000), [(250, 1000, 0, 1.0), (0, 0, 0, 1.0), (250, 1000, 0, 1.0)])
    short = [(k * UNIT, "short", 100, 1000, 0, 1.0) for k in (94, 95)] + [((96 + k) * UNIT, "short", 250, 1000, 0, 1.0) for k in range(3)]
    got = {r.entity: (r.hi, r.lo, r.fires) for r in rollup.volume_verdicts(spark.createDataFrame(hot + cold + mixed + dead + short, ROLL), 100 * UNIT).collect()}
    assert got == {"hot": (True, False, True), "cold": (False, True, True), "mixed": (False, False, False), "dead": (False, False, False), "short": (False, False, False)}


def test_error_and_lag_verdicts(spark):
    bad = _rows("bad", (100, 1000), [(100, 1000, 30, 900.0)] * 3)
    good = _rows("good", (100, 1000), [(100, 1000, 1, 100.0)] * 3)
    late = _rows("late", (100, 1000), [(100, 1000, 1, 4e6)] * 3)
    df = spark.createDataFrame(bad + good + late, ROLL)
    assert {r.entity: r.fires for r in rollup.ef_verdicts(df, 100 * UNIT).collect()} == {"bad": True, "good": False, "late": False}
    assert {r.entity: r.fires for r in rollup.lag_verdicts(df, "lag", 100 * UNIT, ceiling=3.6e6).collect()} == {"bad": True, "good": False, "late": False}


def test_stale_stays_firing_and_retired_collectors_close(spark):
    rows = [("e1", "detector", "ingest-flow", "single", "n1", "OPEN", "firing", "collector", 0, None, None), ("e2", "detector", "ingest-flow", "single", "gone", "OPEN", "firing", "collector", 10**9, None, None)]
    eps = spark.createDataFrame(rows, "episode_id string, source_kind string, alertname string, class string, entity_id string, episode_state string, state string, entity_kind string, last_evaluation long, resolved_at long, stale_since long")
    got = {r.episode_id: (r.episode_state, r.state, r.stale_since) for r in projection.aged(eps, spark.createDataFrame([("n1",)], "collector_id string"), 10**9, catalog.detectors(spark)).collect()}
    assert got == {"e1": ("STALE", "firing", 10**9), "e2": ("CLOSED_EXPECTED", "resolved", None)}


def test_mass_silence(spark):
    s = spark.createDataFrame([("collector-down", f"n{k}", "firing", "single") for k in range(3)], "alertname string, entity_id string, state string, class string")
    assert projection.mass_silence(s, 6).first()["class"] == "unknown-mass-silence" and projection.mass_silence(s, 7).first()["class"] is None
    assert s.where(F.col("state") == "firing").count() == 3
