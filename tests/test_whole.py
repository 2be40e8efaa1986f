"""Queries over whole tables, on tables that reach past the bounds of their bounded twins."""

import datetime as dt

import pytest

from skerry import catalog
from skerry.plans import registry

QUERIES, ORACLES = registry.load()
START = dt.datetime(2024, 1, 1)
KINDS = ("click", "view", "signup", "purchase", "error")


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """4,000 events of 60 users."""
    folder = tmp_path_factory.mktemp("whole")
    rows = [(k, (k * 7 + k // 60) % 60, KINDS[k % 5], float(k % 490), START + dt.timedelta(minutes=10 * k), '{"k": 1}') for k in range(4000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder), rows


def test_members_of_all_notifications(spark, events):
    sf, rows = events
    notes = {(r[1], r[0] + 1, r[1] % 20) for r in rows if r[0] % 3 == 0}
    by_id, by_episode = {}, {}
    for note, i, episode in notes:
        by_id.setdefault(i, set()).add(note)
        by_episode.setdefault(episode, set()).add(note)
    want = {(note, r[0]) for r in rows for note in by_id.get(r[0], set()) | by_episode.get(r[1], set())}
    got = [(r.note, r.signal) for r in QUERIES["notification_membership"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(s for _, s in got) > 2002


def test_causes_of_all_firing_episodes(spark, events):
    sf, rows = events
    names = ("collector-down", "data-loss", "ingest-flow", "telemetry-silence", "heap-spiral", "shipping-breaking")
    firing = [(f"e{i}", names[i % 6], f"c{u % 50}", f"n{u}") for i, u, *_ in rows if i % 4]
    want = {}
    for incident, symptom, cluster, collector in firing:
        found = {}
        for cause, (keys, symptoms) in catalog.CAUSES.items():
            ids = [c[0] for c in firing if symptom in symptoms and c[1] == cause and c[2] == cluster and (len(keys) == 1 or c[3] == collector)]
            if ids:
                found[cause] = min(ids)
        if found:
            want[incident] = (",".join(sorted(found)), ",".join(found[c] for c in sorted(found)))
    got = {r.incident_id: (r.causes, r.cause_ids) for r in QUERIES["causal_candidates"](spark, sf).collect()}
    assert got == want and any(int(i[1:]) >= 3000 for i in got)


def test_searches_return_every_match_in_order(spark, events):
    sf, rows = events
    want = [r[0] for r in reversed(rows) if r[2] == "error"]
    assert [r.event_id for r in QUERIES["search_errors"](spark, sf).collect()] == want and len(want) > 100
    assert not any("LIMIT" in sql for name, sql in ORACLES.items() if name.startswith("search_"))


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """1,500 alerts of 60 customers, all of them open and shut in turn."""
    folder = tmp_path_factory.mktemp("alerts")
    rows = [(k, k * 11 % 60, "OFP"[k % 3], START + dt.timedelta(days=k * 13 % 50)) for k in range(1500)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    return str(folder), rows


def test_searches_over_signals_alerts_and_episodes(spark, orders):
    sf, rows = orders
    active = [r for r in rows if r[2] == "O"]
    got = [r.id for r in QUERIES["search_alerts_active"](spark, sf).collect()]
    assert got == [f"a{r[0]}" for r in sorted(active, key=lambda r: (-r[3].timestamp(), f"a{r[0]}"))]
    known = [r for r in rows if r[0] % 5 != 4]
    assert QUERIES["search_signals_all"](spark, sf).count() == len(known) > 100
    assert QUERIES["search_signals_firing"](spark, sf).count() == len([r for r in known if r[2] != "F"]) > 100
    history = QUERIES["search_episodes_history"](spark, sf).collect()
    opened = QUERIES["search_episodes_open"](spark, sf).collect()
    resolved = QUERIES["search_episodes_resolved"](spark, sf).collect()
    assert [r.opened_at for r in history] == sorted((r.opened_at for r in history), reverse=True)
    assert {r.episode_id for r in history} == {r.episode_id for r in opened + resolved} and len(history) == len(opened) + len(resolved)


def test_every_incident_has_its_order(spark, orders):
    sf, rows = orders
    names = ("collector-down", "data-loss", "heap-spiral", "fleet-fb-silence", "no-such-monitor")
    want = {}
    for k, customer, status, day in sorted(rows, key=lambda r: (r[3], r[1] % 1000, r[2] == "F", f"a{r[0]}")):
        bucket = None if k % 13 == 0 else f"node-{customer % 40 + 1:03d}"
        want.setdefault((names[k % 5], bucket), []).append(f"a{k}")
    got = {(r.monitor_name, r.bucket_key): r.ids.split(",") for r in QUERIES["lifecycle_sort"](spark, sf).collect()}
    assert got == want and len({b for _, b in got}) > 1


def test_heartbeats_of_all_samples_count(spark, tmp_path):
    """A collector whose samples have ids that the ninth part lacks was seen; one without samples is missing."""
    now = dt.datetime(2024, 1, 30)
    rows = [(10, 0, "view", 1.0, now), (11, 1, "click", 1.0, now), (9, 12, "view", 1.0, now - dt.timedelta(days=9))]
    spark.createDataFrame([(*r, '{"k": 1}') for r in rows], "event_id long, user_id long, event_type string, value double, ts timestamp_ntz, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.collector_id: (r.missing, r.age_ms) for r in QUERIES["heartbeat_absence"](spark, str(tmp_path)).collect()}
    assert got["node-01"] == (0, 86_400_000) and got["node-03"] == (1, None)


def test_fifty_hosts_are_no_truncated_cohort(spark, tmp_path):
    """More hosts a family than the old cap of 45 and fewer than that of production."""
    rows = [(k, k % 180, "click", 1.0, START + dt.timedelta(days=25, minutes=k), '{"k": 1}') for k in range(180)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz, props string").write.parquet(f"{tmp_path}/events.parquet")
    meta = QUERIES["rollup_meta"](spark, str(tmp_path)).where("entity_kind = 'host'").collect()
    assert {r.entity_count for r in meta} == {60} and not any(r.truncated for r in meta)
    assert QUERIES["rollup_commit"](spark, str(tmp_path)).first().complete
    stale = QUERIES["monitor_trend_rollup_stale"](spark, str(tmp_path)).first()
    assert (stale.n, stale.n_recent, stale.fires) == (1, 0, True)
    from skerry.operators import rollup
    from skerry.plans import rollups

    whole = rollups.rolled(spark, str(tmp_path))
    assert rollup.meta(whole, whole, cap=59).where("truncated").count() == 3
