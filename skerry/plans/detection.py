"""Queries of detectors and the forecaster (inventory L, D31, I7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.operators import detection as d
from skerry.plans.registry import query
from skerry.session import AS_OF, DAY
from skerry.sources.adapters import LOG, METRICS, log_events, metric_samples

SCALE = 1440  # a minute becomes a day


def _rows(spark: SparkSession, sf_dir: str, x: d.Detector) -> tuple[DataFrame, str]:
    return (metric_samples(spark, sf_dir), "ts") if x.source == "metrics" else (log_events(spark, sf_dir), "collector_ms")


def _sql(x: d.Detector) -> str:
    width = x.minutes * 60_000 * SCALE
    cte, name, time = (METRICS, "metric_samples", "ts") if x.source == "metrics" else (LOG, "log_events", "collector_ms")
    features = ", ".join(f"round(CAST({e.replace('percentile(', 'quantile_cont(')} AS DOUBLE), 6) AS {n}" for n, e in x.features.items())
    entity = x.entity or "'all'"
    return f"WITH {cte} SELECT {time} // {width} * {width} AS window_ms, {entity} AS entity, {features} FROM {name} WHERE {x.where} GROUP BY 1, 2"


def _register(x: d.Detector) -> None:
    @query("feature_" + x.name.replace("-", "_"), _sql(x))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, time = _rows(spark, sf_dir, x)
        return d.feature_rows(x, rows, time, SCALE)


for _x in d.DETECTORS:
    _register(_x)

_VOLUME = next(x for x in d.DETECTORS if x.name == "local-volume")


@query("feature_zero_imputed", f"WITH {LOG}, f AS (SELECT origin_host AS entity, collector_ms // {DAY} * {DAY} AS window_ms, count(message)::DOUBLE AS volume FROM log_events WHERE family = 'local' GROUP BY ALL), s AS (SELECT entity, unnest(generate_series(min(window_ms), max(window_ms), {DAY})) AS window_ms FROM f GROUP BY entity) SELECT s.window_ms, s.entity, coalesce(volume, 0.0)::DOUBLE AS volume FROM s LEFT JOIN f USING (entity, window_ms)")
def feature_zero_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, time = _rows(spark, sf_dir, _VOLUME)
    return d.imputed(_VOLUME, d.feature_rows(_VOLUME, rows, time, SCALE), SCALE)


@query("detector_grades")
def detector_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest grades of the host volumes, on six-hour intervals."""
    rows, time = _rows(spark, sf_dir, _VOLUME)
    got = d.imputed(_VOLUME, d.feature_rows(_VOLUME, rows, time, 360), 360)
    return d.grades(_VOLUME, got)


@query("disk_forecast", f"WITH {METRICS}, h AS (SELECT os_node AS entity, ts // 14400000 AS h, max(disk_used_percent) AS y FROM metric_samples WHERE ts >= {AS_OF - 168 * 14400000} AND ts < {AS_OF} GROUP BY ALL) SELECT entity, count(*)::BIGINT AS n, round(regr_slope(y, h - {AS_OF // 14400000}), 6) AS slope, round(regr_intercept(y, h - {AS_OF // 14400000}) + 24 * regr_slope(y, h - {AS_OF // 14400000}), 6) AS forecast_value FROM h GROUP BY entity")
def disk_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.forecast(metric_samples(spark, sf_dir), AS_OF, scale=4)
