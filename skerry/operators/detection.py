"""Detectors: feature queries, imputation, a robust random cut forest, and a linear forecaster."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators import ordered

ERRORS = "sum(CASE WHEN severity_norm IN ('error', 'fatal') THEN 1 ELSE 0 END)"


@dataclass(frozen=True)
class Detector:
    """What a detector reads: SQL filter, clock, entity column, SQL features, interval, delay and imputation."""

    name: str
    source: str  # logs or metrics
    where: str
    entity: str | None
    features: dict[str, str] = field(default_factory=dict)
    minutes: int = 1
    delay: int = 1
    zero: bool = False


#: Features and settings of the minute detectors.
FAST = (
    Detector("ingest-flow", "metrics", "kind = 'fluentbit'", "collector_id", {"records": "sum(output_records_delta)", "errors": "sum(output_errors_delta)", "retries": "sum(output_retries_delta)"}, zero=True),
    Detector("node-health", "metrics", "kind = 'node'", "os_node", {"heap": "avg(heap_percent)", "cpu": "avg(cpu_percent)", "indexing": "sum(indexing_delta)", "disk": "avg(disk_used_percent)"}),
    Detector("dashboards-health", "metrics", "kind = 'osd'", None, {"delay": "avg(event_loop_delay)", "response": "avg(response_avg_ms)", "requests": "avg(requests_total)"}),
    Detector("il-per-epn", "logs", "family = 'infologger'", "origin_host", {"volume": "count(message)", "errors": ERRORS}, delay=2, zero=True),
    Detector("central-per-epn", "logs", "family = 'central'", "origin_host", {"volume": "count(message)", "errors": ERRORS}, delay=2, zero=True),
    Detector("local-volume", "logs", "family = 'local'", "origin_host", {"volume": "count(message)"}, delay=2, zero=True),
    Detector("il-per-epn-entry-lag", "logs", "family = 'infologger'", "origin_host", {"p95": "percentile(enter_system_lag_ms, 0.95)"}, delay=2),
    Detector("local-per-epn-entry-lag", "logs", "family = 'local'", "origin_host", {"p95": "percentile(enter_system_lag_ms, 0.95)"}, delay=2),
    Detector("il-collector-shipping-lag", "logs", "family = 'infologger'", "node", {"p95": "percentile(ingest_lag_ms, 0.95)"}, delay=2),
    Detector("local-collector-shipping-lag", "logs", "family = 'local'", "node", {"p95": "percentile(ingest_lag_ms, 0.95)"}, delay=2),
)
DETECTORS = FAST + tuple(Detector(f"{d.name}-slow", d.source, d.where, d.entity, d.features, 30, d.delay, d.zero) for d in FAST[3:])


def feature_rows(d: Detector, rows: DataFrame, time: str, scale: int = 1, as_of: int | None = None) -> DataFrame:
    """window_ms, entity and the features of each interval that has samples; with as_of, of those that are due by then.

    An interval is due once the detector's delay has passed after its end, so that late samples are in.
    """
    width = d.minutes * 60_000 * scale
    if as_of is not None:
        rows = rows.where(F.col(time) < due(d, as_of, scale))
    window = (F.floor(F.col(time) / width) * width).alias("window_ms")
    entity = (F.col(d.entity) if d.entity else F.lit("all")).alias("entity")
    features = [F.round(F.expr(e).cast("double"), 6).alias(n) for n, e in d.features.items()]
    some = rows.where(d.where)
    return (some.where(F.col(d.entity).isNotNull()) if d.entity else some).groupBy(window, entity).agg(*features)


def due(d: Detector, as_of: int, scale: int = 1) -> int:
    """The end of the last interval that is due."""
    width = d.minutes * 60_000 * scale
    return (as_of - d.delay * 60_000 * scale) // width * width


def imputed(d: Detector, features: DataFrame, scale: int = 1) -> DataFrame:
    """Features with a zero row for each interval that an entity missed between its first and its last; only for detectors that impute."""
    if not d.zero:
        return features
    width = d.minutes * 60_000 * scale
    span = features.groupBy("entity").agg(F.min("window_ms").alias("a"), F.max("window_ms").alias("b"))
    every = span.select("entity", F.explode(F.sequence("a", "b", F.lit(width).cast("long"))).alias("window_ms"))
    names = list(d.features)
    return every.join(features, ["entity", "window_ms"], "left").select("window_ms", "entity", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def _displacements(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Collusive displacement of each point in one random cut tree of them: the most that leaving with its group would change.

    A cut picks a dimension in proportion to its extent and a place uniformly; a leaf's displacement is the largest
    ratio, over its ancestors, of the sibling's size to its own side's.
    """
    out = np.zeros(len(points))
    stack = [(np.arange(len(points)), 0.0)]
    while stack:
        ids, worst = stack.pop()
        low, high = points[ids].min(axis=0), points[ids].max(axis=0)
        extent = high - low
        if len(ids) == 1 or not extent.sum() > 0:
            out[ids] = np.maximum(out[ids], worst)
            continue
        k = rng.choice(len(extent), p=extent / extent.sum())
        side = points[ids, k] <= rng.uniform(low[k], high[k])
        if side.all() or not side.any():
            side = points[ids, k] <= (low[k] + high[k]) / 2
        left, right = ids[side], ids[~side]
        stack += [(left, max(worst, len(right) / len(left))), (right, max(worst, len(left) / len(right)))]
    return out


def score(points: np.ndarray, seed: int = 7, trees: int = 24, sample: int = 256) -> np.ndarray:
    """Mean displacement of each point over trees of random samples (Guha et al. 2016); the same for the same seed."""
    rng = np.random.default_rng(seed)
    total, n = np.zeros(len(points)), np.zeros(len(points))
    for _ in range(max(trees, trees * -(-len(points) // sample))):
        ids = rng.choice(len(points), min(sample, len(points)), replace=False)
        total[ids] += _displacements(points[ids], rng)
        n[ids] += 1
    return np.divide(total, n, out=np.zeros(len(points)), where=n > 0)


RESULT = "entity string, window_ms long, grade double, confidence double"


def grades(d: Detector, features: DataFrame, shingle: int = 8, warm_up: int = 32) -> DataFrame:
    """Grade and confidence of each entity's intervals after the warm-up; grades in [0, 1], mostly 0.

    The model is the published forest, not any product's: the contract of results is kept, not their numbers. An entity's
    intervals are one group: a point a minute, so a month is some forty thousand rows of a few numbers.
    """
    names = list(d.features)
    whole = features
    for n in names:
        whole = whole.where(F.col(n).isNotNull())
    rows = ordered.shingles(whole, names, ["entity"], ["window_ms"], shingle)
    flat = rows.select("entity", "window_ms", F.flatten(F.transform("shingle", lambda x: F.array(*[x[n].cast("double") for n in names]))).alias("point"))

    def run(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("window_ms")
        points = np.array(got["point"].tolist(), float)
        spread = points.std(axis=0)
        points = (points - points.mean(axis=0)) / np.where(spread > 0, spread, 1)
        s = score(points)
        middle, wide = np.median(s), np.median(np.abs(s - np.median(s))) * 1.4826 + 1e-9
        z = (s - middle) / wide
        grade = np.where(z > 3, np.clip((z - 3) / 7, 0, 1), 0.0)
        seen = np.arange(1, len(s) + 1)
        out = pd.DataFrame({"entity": key[0], "window_ms": got["window_ms"].to_numpy(), "grade": np.round(grade, 4), "confidence": np.round(1 - np.exp(-seen / warm_up), 4)})
        return out[seen > warm_up - shingle]

    return flat.groupBy("entity").applyInPandas(run, RESULT)


def forecast(samples: DataFrame, as_of: int, value: str = "disk_used_percent", entity: str = "os_node", hours: int = 24, history: int = 168, scale: int = 1) -> DataFrame:
    """entity, the trend of hourly maxima over the history, and its value at the horizon, by least squares in the engine."""
    hour = 3_600_000 * scale
    inside = samples.where((F.col("ts") >= as_of - history * hour) & (F.col("ts") < as_of))
    hourly = inside.groupBy(F.col(entity).alias("entity"), F.floor(F.col("ts") / hour).alias("h")).agg(F.max(value).cast("double").alias("y"))
    x = (F.col("h") - F.lit(as_of // hour)).cast("double")
    got = hourly.groupBy("entity").agg(F.count("*").alias("n"), F.regr_slope("y", x).alias("slope"), F.regr_intercept("y", x).alias("now"))
    return got.select("entity", "n", F.round("slope", 6).alias("slope"), F.round(F.col("now") + F.col("slope") * hours, 6).alias("forecast_value"))
