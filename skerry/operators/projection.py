"""From alerts and anomalies to signals, and from signals to episodes of incidents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry import catalog
from skerry.functions import parsing as p

#: Members an episode lists, samples it shows, and the share of silent collectors that is a mass silence.
MAX_MEMBERS, MAX_SAMPLES, MASS_SHARE = 2000, 10, 0.5
#: Entities that a board lists below a group.
CHILD_ROWS = 25
TERMINAL = ("RESOLVED", "CLOSED_EXPECTED")


def merged(alerts: DataFrame) -> DataFrame:
    """One row an alert id: the first start, the last time seen, and the end that any row has, with that row's state."""
    best = F.max_by(F.struct("state", "severity", "monitor_name", "bucket_key"), F.struct(F.col("end_time").isNotNull(), "last_notification_time"))
    got = alerts.groupBy("id").agg(F.min("start_time").alias("first_seen"), F.max(F.greatest("last_notification_time", F.coalesce("end_time", F.lit(0)))).alias("last_seen"), F.max("end_time").alias("end_time"), best.alias("b"))
    return got.select("id", "first_seen", "last_seen", "end_time", "b.*")


def _identity(rows: DataFrame) -> DataFrame:
    """incident_id, scope_label and group_id from a signal's labels."""
    scope = F.when(F.col("scope") == "collector", F.col("collector_id")).otherwise("fleet")
    hashed = p.content_hash(source_kind=F.col("source_kind"), alertname=F.col("alertname"), entity_kind=F.col("entity_kind"), entity_id=F.col("entity_id"), scope=scope)
    label = p.scope_label(F.col("scope"), F.col("collector_id"))
    return rows.withColumn("incident_id", hashed).withColumn("scope_label", label).withColumn("group_id", F.concat_ws("/", "cluster_id", "alertname", "scope_label"))


def alert_signals(alerts: DataFrame, monitors: DataFrame, cluster: str = "logs") -> DataFrame:
    """Signals of merged alerts; a monitor that isn't in the catalog makes none.

    A monitor in error, and one of an entity kind whose alert names no entity, are signals about the monitor itself.
    """
    rows = alerts.join(F.broadcast(monitors), alerts["monitor_name"] == monitors["alertname"])
    key = F.coalesce("constant_entity", "bucket_key")
    kind = F.when(F.col("state") == "ERROR", "monitor-error").when(key.isNull(), "entity-missing").otherwise("single")
    own = kind == "single"
    rows = rows.select(
        F.col("id").alias("source_id"), F.lit("monitor").alias("source_kind"), "alertname", kind.alias("class"),
        F.when(F.col("state").isin("ACTIVE", "ERROR"), "firing").otherwise("resolved").alias("state"),
        F.when(F.col("severity") == "1", "page").otherwise("warn").alias("severity"),
        F.when(own, F.col("entity_kind")).otherwise("monitor").alias("entity_kind"), F.when(own, key).otherwise(F.col("alertname")).alias("entity_id"),
        F.when(own & (F.col("entity_kind") == "collector"), key).otherwise(catalog.NONE).alias("collector_id"),
        "scope", F.lit(cluster).alias("cluster_id"), "first_seen", "last_seen", "end_time", "healthy_required",
    )
    return _identity(rows)


def dropped_results(results: DataFrame, detectors: DataFrame) -> DataFrame:
    """reason and n of realtime results that make no signal. category: the field that a result names its entity by, where it says so."""
    known = detectors.select("alertname", "entity_column", F.lit(True).alias("known"))
    rows = results.where(F.col("task_id").isNull()).join(F.broadcast(known), "alertname", "left")
    reason = (
        F.when(F.col("grade").isNull(), "no grade").when(F.col("known").isNull(), "unknown detector").when(F.col("entity_id").isNull(), "no category")
        .when(F.col("category").isNotNull() & (F.col("category") != F.col("entity_column")), "wrong category")
    )
    return rows.withColumn("reason", reason).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def anomaly_signals(results: DataFrame, detectors: DataFrame, floor: float = 0.5, cluster: str = "logs") -> DataFrame:
    """Signals of realtime detector results; ungraded, unknown and entity-less results, and those by a wrong category, make none.

    Grades over the floor fire. dropped_results() counts what is left out.
    """
    live = results.where(F.col("task_id").isNull() & F.col("grade").isNotNull())
    rows = live.join(F.broadcast(detectors), "alertname").where(F.col("entity_id").isNotNull())
    if "category" in results.columns:
        rows = rows.where(F.col("category").isNull() | (F.col("category") == F.col("entity_column")))
    rows = rows.select(
        "source_id", F.lit("detector").alias("source_kind"), "alertname", F.lit("single").alias("class"), F.when(F.col("grade") > floor, "firing").otherwise("evidence").alias("state"),
        F.lit("warn").alias("severity"), "entity_kind", "entity_id", F.when(F.col("entity_kind") == "collector", F.col("entity_id")).otherwise(catalog.NONE).alias("collector_id"),
        F.when(F.col("entity_kind") == "collector", "collector").otherwise("fleet").alias("scope"), F.lit(cluster).alias("cluster_id"),
        F.col("window_ms"), F.round("grade", 4).alias("grade"), F.round("confidence", 4).alias("confidence"), "healthy_required",
    )
    return _identity(rows)


def _members(ids: list[str]) -> tuple[list[str], bool]:
    distinct = list(dict.fromkeys(ids))
    return distinct[:MAX_MEMBERS], len(distinct) > MAX_MEMBERS


EPISODE = "incident_id string, episode_id string, opened_at long, last_seen long, resolved_at long, episode_state string, state string, severity string, healthy_windows int, members array<string>, truncated boolean"


def monitor_episodes(signals: DataFrame) -> DataFrame:
    """Episodes of monitor signals: an incident's rows in time order are one run until enough clearings in a row close it.

    A clearing counts once for each later end; firing starts the count over; a row that begins after the closing end
    starts the next run. Rows of one incident are few; incidents are the unit of parallelism, and Arrow carries them in bulk.
    """

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_r=(rows["state"] != "firing").astype(int)).sort_values(["first_seen", "last_seen", "_r", "source_id"])
        required, out = int(rows["healthy_required"].iloc[0]), []
        end, healthy, last = None, 0, 0
        for r in rows.itertuples():
            if not out or (end is not None and r.first_seen > end):
                end, healthy, last = None, 0, 0
                out.append({"opened_at": r.first_seen, "last_seen": 0, "resolved_at": None, "severity": r.severity, "ids": []})
            run = out[-1]
            run["ids"].append(r.source_id)
            run["last_seen"] = max(run["last_seen"], r.last_seen)
            if r.severity == "page":
                run["severity"] = "page"
            if r.state == "resolved":
                cleared = int(r.end_time) if pd.notna(r.end_time) else int(r.last_seen)
                run["resolved_at"] = cleared
                if cleared > last:
                    last, healthy = cleared, healthy + 1
                if healthy >= required:
                    end = cleared if end is None else max(end, cleared)
            else:
                end, healthy, last = None, 0, 0
                run["resolved_at"] = None
            run["healthy_windows"] = healthy
        for run in out:
            closed = run["healthy_windows"] >= required
            run["episode_state"] = "RESOLVED" if closed else "RECOVERING" if run["healthy_windows"] else "OPEN"
            run["state"] = "resolved" if closed else "firing"
            run["resolved_at"] = run["resolved_at"] if closed else None
            run["incident_id"], run["episode_id"] = key[0], f"{key[0]}.{int(run['opened_at'])}"
            run["members"], run["truncated"] = _members(run.pop("ids"))
        return pd.DataFrame(out)[[c.split()[0] for c in EPISODE.split(", ")]].astype({"resolved_at": "Int64"})

    columns = ["incident_id", "source_id", "state", "severity", "first_seen", "last_seen", "end_time", "healthy_required"]
    return signals.select(*columns).groupBy("incident_id").applyInPandas(reduce, EPISODE)


DETECTOR_EPISODE = "incident_id string, episode_id string, opened_at long, last_seen long, resolved_at long, episode_state string, state string, healthy_windows int, last_breach_window long, last_healthy_window long, worst_grade double, members array<string>, truncated boolean"


def fold_detector(key: str, rows: Iterator, required: int, episodes: list[dict], close: float = 0.0) -> list[dict]:
    """Fold detector results, in time order, into an incident's episodes; replaying rows changes nothing.

    A result belongs to the latest episode that began by its window, unless that one had closed before; only a firing
    result opens an episode. Evidence at or below `close` after the last breach heals; enough of it closes.
    """
    for r in rows:
        window = int(r.window_ms)
        covering = next((e for e in reversed(episodes) if e["opened_at"] <= window), None)
        if covering is not None and covering["episode_state"] in TERMINAL and window > covering["resolved_at"]:
            covering = None
        elif covering is None and episodes:
            continue
        if covering is None:
            if r.state != "firing":
                continue
            covering = {"incident_id": key, "episode_id": f"{key}.{window}", "opened_at": window, "last_seen": window, "resolved_at": None, "episode_state": "OPEN", "state": "firing", "healthy_windows": 0, "last_breach_window": 0, "last_healthy_window": 0, "worst_grade": 0.0, "members": [], "truncated": False}
            episodes.append(covering)
            episodes.sort(key=lambda e: e["opened_at"])
        e = covering
        e["worst_grade"] = max(e["worst_grade"], float(r.grade))
        if r.state == "firing":
            if window > e["last_breach_window"]:
                e |= {"last_breach_window": window, "last_healthy_window": 0, "healthy_windows": 0, "episode_state": "OPEN", "state": "firing", "resolved_at": None, "last_seen": max(e["last_seen"], window)}
                if r.source_id not in e["members"]:
                    if len(e["members"]) < MAX_MEMBERS:
                        e["members"].append(r.source_id)
                    else:
                        e["truncated"] = True
        elif e["episode_state"] not in TERMINAL and r.grade <= close and window > max(e["last_healthy_window"], e["last_breach_window"]):
            e["last_healthy_window"], e["healthy_windows"] = window, e["healthy_windows"] + 1
            closed = e["healthy_windows"] >= required
            e |= {"episode_state": "RESOLVED", "state": "resolved", "resolved_at": window} if closed else {"episode_state": "RECOVERING", "state": "firing"}
    return episodes


def detector_episodes(signals: DataFrame) -> DataFrame:
    """Episodes of detector signals, incident by incident."""

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["window_ms", "state", "source_id"])
        got = fold_detector(key[0], rows.itertuples(), int(rows["healthy_required"].iloc[0]), [])
        columns = [c.split()[0] for c in DETECTOR_EPISODE.split(", ")]
        return pd.DataFrame(got, columns=columns).astype({"resolved_at": "Int64"})

    return signals.select("incident_id", "source_id", "state", "window_ms", "grade", "healthy_required").groupBy("incident_id").applyInPandas(reduce, DETECTOR_EPISODE)


def aged(episodes: DataFrame, collectors: DataFrame, now_ms: int, detectors: DataFrame) -> DataFrame:
    """Open episodes whose evidence has run out: of nobody or of a retired collector, closed; overdue ones of detectors, stale but firing."""
    known = collectors.select(F.col("collector_id").alias("entity_id"), F.lit(True).alias("rostered")).distinct()
    budget = detectors.select("alertname", ((F.col("interval_min") + F.col("lateness_min")) * 60_000).alias("budget_ms"))
    rows = episodes.join(known, "entity_id", "left").join(F.broadcast(budget), "alertname", "left")
    open_ = ~F.col("episode_state").isin(*TERMINAL)
    detector = F.col("source_kind") == "detector"
    nobody = (F.col("entity_id") == catalog.NONE) & ~F.col("class").isin("monitor-error", "entity-missing")
    gone = detector & (F.col("entity_kind") == "collector") & F.col("rostered").isNull()
    closing = open_ & (nobody | gone)
    stale = open_ & ~closing & detector & (F.lit(now_ms) - F.col("last_evaluation") > F.coalesce("budget_ms", F.lit(360_000)))
    return rows.select(
        "episode_id",
        F.when(closing, "CLOSED_EXPECTED").when(stale, "STALE").otherwise(F.col("episode_state")).alias("episode_state"),
        F.when(closing, "resolved").when(stale, "firing").otherwise(F.col("state")).alias("state"),
        F.when(closing, F.lit(now_ms)).otherwise(F.col("resolved_at")).alias("resolved_at"),
        F.when(stale, F.coalesce("stale_since", F.lit(now_ms))).otherwise(F.col("stale_since")).alias("stale_since"),
    )


def board(episodes: DataFrame, most: int = CHILD_ROWS) -> DataFrame:
    """A row for each notification group of open episodes: counts by state and severity, the worst grade, and its entities.

    children: entity, last seen, worst grade and states of the group's entities, the latest first, at most `most`: each group's first
    are picked before they are collected, so a group of any size is one short list.
    """
    from skerry.operators import ordered

    open_ = episodes.where("state = 'firing'")
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    flags = [is_("episode_state", "OPEN").alias("opens"), is_("episode_state", "STALE").alias("stales"), is_("severity", "page").alias("pages")]
    groups = open_.groupBy("group_id").agg(
        F.count("*").alias("episodes"), F.min("opened_at").alias("opened"), F.max("last_seen").alias("last"), F.sum("member_count").alias("members"), F.max("worst_grade").alias("worst"),
        F.count_distinct("entity_id").alias("entity_total"), *flags,
    )
    entities = open_.groupBy("group_id", "entity_id").agg(F.max("last_seen").alias("kid_last"), F.max("worst_grade").alias("kid_grade"), *flags)
    top = ordered.top_n(entities, most, ["group_id"], [F.desc("kid_last"), "entity_id"], "k")
    listed = F.array_sort(F.collect_list(F.struct("k", "entity_id", "kid_last", "kid_grade", "opens", "stales", "pages")))
    return groups.join(top.groupBy("group_id").agg(listed.alias("children")), "group_id")


def cards(episodes: DataFrame) -> DataFrame:
    """A row for each notification group: its episodes summed, entities and a sample of them. board() has the worst grade and children."""
    firing = F.col("state") == "firing"
    return episodes.groupBy("group_id").agg(
        F.count("*").alias("episodes"), F.count_if(firing).alias("firing"), F.min("opened_at").alias("first_opened"), F.max("last_seen").alias("last_seen"), F.sum("member_count").alias("members"),
        F.count_distinct("entity_id").alias("entities"), F.slice(F.array_sort(F.collect_set("entity_id")), 1, 3).alias("sample"),
    )


def mass_silence(signals: DataFrame, roster_size: Column | int) -> DataFrame:
    """One row: the class that overrides all others when the fleet falls silent, or null."""
    single = signals.where("state = 'firing' and class = 'single'")
    got = single.agg(F.coalesce(F.bool_or(F.col("alertname") == "fleet-fb-silence"), F.lit(False)).alias("fleet"), F.count_distinct(F.when(F.col("alertname") == "collector-down", F.col("entity_id"))).alias("silent"))
    size = F.lit(roster_size) if isinstance(roster_size, int) else roster_size
    return got.select("silent", F.when(F.col("fleet") | ((size > 0) & (F.col("silent") >= F.lit(MASS_SHARE) * size)), "unknown-mass-silence").alias("class"))


def with_mass_class(episodes: DataFrame, silence: DataFrame) -> DataFrame:
    """Episodes with the class of mass_silence(), where it has one, put on the firing ones that a silent fleet explains."""
    mass = F.broadcast(silence.select(F.col("class").alias("mass_")))
    explained = F.col("mass_").isNotNull() & (F.col("state") == "firing") & (F.col("class") == "single") & F.col("alertname").isin("fleet-fb-silence", "collector-down")
    return episodes.join(mass).withColumn("class", F.when(explained, F.col("mass_")).otherwise(F.col("class"))).drop("mass_")


def restarted(signals: DataFrame) -> DataFrame:
    """Signals whose incident_id starts over with each change of topology: an episode never spans two versions.

    Signals of an incident are numbered by the changes of topology_version before them, in time order.
    """
    w = Window.partitionBy("incident_id").orderBy("first_seen", "last_seen", "source_id")
    turned = F.coalesce((F.col("topology_version") != F.lag("topology_version").over(w)).cast("int"), F.lit(0))
    runs = signals.withColumn("turn_", turned).withColumn("run_", F.sum("turn_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("incident_id", F.when(F.col("run_") == 0, F.col("incident_id")).otherwise(F.concat_ws("@", "incident_id", "topology_version", "run_"))).drop("turn_", "run_")


def dwell(episodes: DataFrame, now_ms: int, keys: list[str] | None = None) -> DataFrame:
    """How many episodes are stale, and how long they have been: the median and the 95th percentile, by nearest rank (and by key)."""
    from skerry.operators import aggregates

    stale = episodes.where("episode_state = 'STALE'").withColumn("dwell_ms", F.lit(now_ms) - F.col("stale_since"))
    counted = stale.groupBy(*(keys or [])).agg(F.count("*").alias("stale_episodes"))
    ranks = aggregates.nearest_ranks(stale, keys or [], "dwell_ms", stale_dwell_p50_ms=0.5, stale_dwell_p95_ms=0.95)
    return counted.join(ranks, keys) if keys else counted.join(F.broadcast(ranks))


def affected(kind: Column, entity: Column) -> Column:
    """Who is hit, in words."""
    words = {"epn": "EPN", "os_node": "search node"}
    named = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in words.items()], kind)
    return F.when((kind == "fleet") | entity.isin("all", catalog.NONE), F.lit("whole fleet")).otherwise(F.concat_ws(" ", named, entity))


#: Labels and annotations of what is sent, and how many ids it lists.
LABELS = ("alertname", "source", "cluster_id", "severity", "entity_kind", "entity_id", "collector_id", "family", "notification_scope")
ANNOTATIONS = (
    "incident_id", "episode_id", "episode_state", "member_count", "signal_ids", "signal_ids_truncated", "entity_samples", "topology_version", "class", "group_id", "title", "diagnosis", "operator_action",
    "affected", "candidate_causes", "cause_belief", "run_id",
)
MAX_IDS = 500


def payloads(episodes: DataFrame, generator: str = "", presentation: DataFrame | None = None) -> DataFrame:
    """What is sent for each episode: labels, annotations, and an end only once it is resolved.

    Columns that episodes lack are sent as their sentinel or as empty. presentation: alertname, title, diagnosis and action, in which
    {entity} stands for the entity; an episode of a class of its own speaks of its monitor.
    """
    has = set(episodes.columns)
    col = lambda c, default="": F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in has else F.lit(default)
    listed = lambda c: F.col(c) if c in has else F.array().cast("array<string>")
    rows = episodes
    if presentation is not None:
        rows = rows.join(F.broadcast(presentation.select("alertname", F.col("title").alias("title_"), F.col("diagnosis").alias("diagnosis_"), F.col("action").alias("action_"))), "alertname", "left")
    say = lambda c, default: F.coalesce(p.render(F.col(f"{c}_"), entity=F.col("entity_id")), default) if presentation is not None else default
    sentinel = catalog.NONE
    labels = {
        "alertname": F.col("alertname"), "source": col("source_kind", "monitor"), "cluster_id": F.col("cluster_id"), "severity": F.col("severity"), "entity_kind": F.col("entity_kind"), "entity_id": col("entity_id", sentinel),
        "collector_id": col("collector_id", sentinel), "family": col("family", sentinel), "notification_scope": col("scope_label", "fleet"),
    }
    ids, more = listed("signal_ids"), F.col("truncated") if "truncated" in has else F.lit(False)
    notes = {
        "incident_id": F.col("incident_id"), "episode_id": F.col("episode_id"), "episode_state": col("episode_state", "OPEN"), "member_count": col("member_count", "0"), "signal_ids": F.array_join(F.slice(ids, 1, MAX_IDS), ","),
        "signal_ids_truncated": ((F.size(ids) > MAX_IDS) | more).cast("string"), "entity_samples": F.array_join(listed("entity_samples"), ","), "topology_version": col("topology_version", sentinel), "class": col("class", "single"),
        "group_id": F.col("group_id"), "title": say("title", F.col("alertname")), "diagnosis": say("diagnosis", F.lit("")), "operator_action": say("action", F.lit("")), "affected": affected(F.col("entity_kind"), col("entity_id", sentinel)),
        "candidate_causes": F.array_join(listed("candidate_causes"), ","), "cause_belief": col("cause_belief"), "run_id": F.lit(sentinel),
    }
    pairs = lambda m, names: F.create_map(*[x for n in names for x in (F.lit(n), m[n])])
    labels, notes, episodes = pairs(labels, LABELS), pairs(notes, ANNOTATIONS), rows
    return episodes.select("episode_id", labels.alias("labels"), notes.alias("annotations"), p.iso_seconds(F.col("opened_at")).alias("startsAt"), F.when(F.col("state") == "resolved", p.iso_seconds(F.col("resolved_at"))).alias("endsAt"), F.lit(generator).alias("generatorURL"))
