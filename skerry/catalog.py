"""Fixed values of the monitored system: severities, monitors, detectors and causal edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Raw severity codes of the three log families and the common scale.
SEVERITIES = {
    "I": "info", "W": "warning", "E": "error", "F": "fatal", "D": "debug",
    "Info": "info", "Warning": "warning", "Error": "error", "Fatal": "fatal", "Sys": "system",
    "inf": "info", "err": "error", "cout": "info",
}
UNKNOWN_SEVERITY = "unknown"
NONE = "none"  # the sentinel of a label that has no value

#: Line formats of the two text families, and of file paths.
DDS_LINE = r"(?s)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)\s+(\S+)\s+(\S+)\s+(<[^>]*>)\s+(.*)$"
STDOUT_LINE = r"(?s)^(?:(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+) )?(?:(Info|Warning|Error|Fatal|Sys) in <([^>]*)>: )?(.*)$"
PATH = r"^(?:.*/)?((epn\d+)?[^/]*)$"
NAME_TIME = r"_(\d{4})-(\d{2})-(\d{2})-(\d{2})-(\d{2})-(\d{2})_"
#: The first line of a record, by family.
RECORD_START = {"dds": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+\s", "stdout": r"^\S"}

#: Name, entity kind, family, scope, feed, healthy windows to close, and the entity where it is constant.
MONITORS = (
    ("collector-down", "collector", NONE, "collector", "fleet-fb", 1, None),
    ("collector-unhealthy", "collector", NONE, "collector", "fleet-fb", 1, None),
    ("data-loss", "collector", NONE, "collector", "fleet-fb", 1, None),
    ("shipping-breaking", "collector", NONE, "collector", "fleet-fb", 1, None),
    ("disk-cliff-warn", "os_node", NONE, "fleet", "control-plane", 1, None),
    ("disk-cliff-page", "os_node", NONE, "fleet", "control-plane", 1, None),
    ("heap-spiral", "os_node", NONE, "fleet", "control-plane", 1, None),
    ("admission-rejections", "os_node", NONE, "fleet", "control-plane", 1, None),
    ("disk-fill-forecast", "fleet", NONE, "fleet", "control-plane", 1, "all"),
    ("cluster-red", "cluster", NONE, "fleet", "control-plane", 1, "logs"),
    ("shards-stuck", "cluster", NONE, "fleet", "control-plane", 1, "logs"),
    ("telemetry-silence", "service", NONE, "fleet", "self", 1, "metrics"),
    ("fleet-fb-silence", "fleet", NONE, "fleet", "self", 1, "all"),
    ("log-family-silence", "fleet", NONE, "fleet", "logs", 1, None),
    ("ad-high-grade", "fleet", NONE, "fleet", "anomaly", 3, "all"),
    ("trend-rollup-stale", "service", NONE, "fleet", "self", 1, "trend-rollup"),
    ("trend-entity-cap", "service", NONE, "fleet", "self", 1, "trend-rollup"),
    ("signal-projector-stale", "service", NONE, "fleet", "self", 1, "signal-projector"),
    ("alertmanager-down", "service", NONE, "fleet", "self", 1, "alertmanager"),
    ("trend-il-volume", "epn", "infologger", "fleet", "logs", 3, None),
    ("trend-il-ef", "epn", "infologger", "fleet", "logs", 3, None),
    ("trend-il-entry-lag", "epn", "infologger", "fleet", "logs", 3, None),
    ("trend-il-shipping-lag", "collector", "infologger", "collector", "logs", 3, None),
    ("trend-central-volume", "epn", "central", "fleet", "logs", 3, None),
    ("trend-central-errors", "epn", "central", "fleet", "logs", 3, None),
    ("trend-local-volume", "epn", "local", "fleet", "logs", 3, None),
    ("trend-local-entry-lag", "epn", "local", "fleet", "logs", 3, None),
    ("trend-local-shipping-lag", "collector", "local", "collector", "logs", 3, None),
)
MONITOR_SCHEMA = "alertname string, entity_kind string, family string, scope string, feed string, healthy_required int, constant_entity string"

#: Minute detectors with entity kind, entity column, family and lateness in minutes. All but the first
#: three have a slow twin of 30-minute intervals, which closes after 2 healthy windows instead of 3.
FAST_DETECTORS = (
    ("ingest-flow", "collector", "collector_id", NONE, 3),
    ("node-health", "os_node", "os_node", NONE, 3),
    ("dashboards-health", "service", None, NONE, 3),
    ("il-per-epn", "epn", "origin_host", "infologger", 5),
    ("il-per-epn-entry-lag", "epn", "origin_host", "infologger", 5),
    ("il-collector-shipping-lag", "collector", "node", "infologger", 5),
    ("central-per-epn", "epn", "origin_host", "central", 5),
    ("local-volume", "epn", "origin_host", "local", 5),
    ("local-per-epn-entry-lag", "epn", "origin_host", "local", 5),
    ("local-collector-shipping-lag", "collector", "node", "local", 5),
)
DETECTORS = tuple((*d, 1, 3) for d in FAST_DETECTORS) + tuple((f"{n}-slow", k, c, f, 35, 30, 2) for n, k, c, f, _ in FAST_DETECTORS[3:])
DETECTOR_SCHEMA = "alertname string, entity_kind string, entity_column string, family string, lateness_min int, interval_min int, healthy_required int"

#: What each cause mutes, and the labels that must agree; no edge's probability is measured yet.
CAUSES = {
    "collector-down": (("cluster_id", "collector_id"), ("collector-unhealthy", "data-loss", "shipping-breaking", "ingest-flow", "il-collector-shipping-lag", "il-collector-shipping-lag-slow", "local-collector-shipping-lag", "local-collector-shipping-lag-slow", "trend-il-shipping-lag", "trend-local-shipping-lag")),
    "telemetry-silence": (("cluster_id",), ("cluster-red", "shards-stuck", "disk-cliff-warn", "disk-cliff-page", "heap-spiral", "node-health", "dashboards-health")),
    "fleet-fb-silence": (("cluster_id",), ("collector-down", "collector-unhealthy", "data-loss", "shipping-breaking", "ingest-flow")),
}
UNMEASURED_PRIOR, MAX_CAUSES = 0.5, 5


def monitors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MONITORS), MONITOR_SCHEMA)


def detectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DETECTORS), DETECTOR_SCHEMA)


def presentation(spark: SparkSession) -> DataFrame:
    """alertname, title, diagnosis and action of every rule and detector, said from its own declaration; {entity} is the entity's place."""
    from skerry.operators.detection import DETECTORS as read
    from skerry.operators.monitors import RULES

    rules, kinds = {r.name: r for r in RULES}, {n: k for n, k, *_ in MONITORS}
    look = {"fleet-fb": "the collector's service, buffers and network path", "control-plane": "the node's disk, heap and load", "self": "the pipeline's own services", "logs": "the producers and the collectors' queues", "anomaly": "the detector's feature values"}
    rows = []
    for name, kind, family, _, feed, *_ in MONITORS:
        words = name.replace("-", " ")
        rule = rules.get(name)
        why = f"({rule.fires}) held over {rule.minutes} minutes" if rule else "its baseline was left for several buckets" if name.startswith("trend-") else "the rule's condition held"
        rows.append((name, f"{words[0].upper()}{words[1:]} ({kinds[name].replace('_', ' ')})", f"{{entity}}: {why}" + (f", family {family}." if family != NONE else "."), f"Check {look[feed]} of {{entity}}."))
    for d in read:
        words = d.name.replace("-", " ")
        rows.append((d.name, f"Unusual {words}", f"{{entity}}: {', '.join(d.features)} left the learned range in {d.minutes}-minute intervals.", "Read the detector's features and their direction before escalating."))
    return spark.createDataFrame(rows, "alertname string, title string, diagnosis string, action string")


def edges(spark: SparkSession) -> DataFrame:
    rows = [(cause, symptom, list(keys), None, False, k + 1) for k, (cause, (keys, symptoms)) in enumerate(CAUSES.items()) for symptom in symptoms]
    return spark.createDataFrame(rows, "cause string, symptom string, equal array<string>, probability double, proven boolean, promotion_order int")
