"""The 28 monitors as queries (inventory K). Windows are stretched, as the driver's events are sparse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import monitors as m
from skerry.operators import rollup as r
from skerry.plans.registry import query
from skerry.plans.rollups import META_SQL, ROLL_SQL, rolled, rolled_meta
from skerry.session import AS_OF, DAY
from skerry.sources.adapters import METRICS, metric_samples, table

SCALE = 720  # two minutes become a day


def _sql(rule: m.Rule) -> str:
    values = "".join(f", CAST({e} AS DOUBLE) AS {n}" for n, e in rule.values.items())
    if rule.recent:
        values += f", count(*) FILTER (ts > {AS_OF - rule.recent * 60000 * SCALE})::BIGINT AS n_recent"
    inside = f"FROM metric_samples WHERE ({rule.where}) AND ts >= {AS_OF - rule.minutes * 60000 * SCALE} AND ts <= {AS_OF}"
    inner = f"SELECT {rule.group} AS entity, count(*)::BIGINT AS n{values} {inside} GROUP BY {rule.group}" if rule.group else f"SELECT 'all' AS entity, count(*)::BIGINT AS n{values} {inside}"
    return f"WITH {METRICS} SELECT *, coalesce({rule.fires}, false) AS fires FROM ({inner})"


def _register(rule: m.Rule) -> None:
    @query("monitor_" + rule.name.replace("-", "_"), _sql(rule))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return m.evaluate(rule, metric_samples(spark, sf_dir, AS_OF - rule.minutes * m.MINUTE * SCALE, AS_OF), AS_OF, SCALE)


for _rule in m.RULES:
    _register(_rule)

#: Loose constants for the sparse events: a bucket of a day, a baseline of all earlier days, a recent baseline of eight.
LONG, SHORT = 60 * DAY, 12 * DAY


def _slices_sql(family: str, kind: str, *measures: tuple[str, str]) -> str:
    cols = []
    spans = [(f"s{k}", f"ts >= {AS_OF - (k + 2) * DAY} AND ts < {AS_OF - (k + 1) * DAY}") for k in range(3)] + [("long", f"ts >= {AS_OF - LONG} AND ts < {AS_OF - 4 * DAY}"), ("short", f"ts >= {AS_OF - SHORT} AND ts < {AS_OF - 4 * DAY}")]
    for span, inside in spans:
        for name, value in measures:
            agg = f"avg(CASE WHEN {inside} THEN {value} END)" if name == "lag" else f"coalesce(sum(CASE WHEN {inside} THEN {value} END), 0)::BIGINT"
            cols.append(f"{agg} AS {name}_{span}")
        cols.append(f"count(*) FILTER ({inside})::BIGINT AS rows_{span}")
    return f"WITH {ROLL_SQL}, t AS (SELECT entity, {', '.join(cols)} FROM (SELECT * FROM rollup UNION ALL SELECT * FROM imputed) WHERE family = '{family}' AND entity_kind = '{kind}' AND ts < {AS_OF} GROUP BY entity)"


def _volume_sql(family: str) -> str:
    docs, fleet, rows = (f"(CASE WHEN fleet_long > 0 THEN {x}_long ELSE {x}_short END)" for x in ("docs", "fleet", "rows"))
    return _slices_sql(family, "host", ("docs", "doc_count"), ("fleet", "fleet_count")) + f""", b AS (SELECT *, CASE WHEN {fleet} > 0 THEN {docs} / {fleet} END AS base0, coalesce(fleet_s0 > 0 AND fleet_s1 > 0 AND fleet_s2 > 0 AND {fleet} > 0 AND {rows} >= 6 AND {docs} > 0, false) AS guard FROM t),
      c AS (SELECT *, CASE WHEN guard THEN round(docs_s0 / fleet_s0 / base0, 6) END AS r0, CASE WHEN guard THEN round(docs_s1 / fleet_s1 / base0, 6) END AS r1, CASE WHEN guard THEN round(docs_s2 / fleet_s2 / base0, 6) END AS r2 FROM b),
      d AS (SELECT *, coalesce(guard AND least(docs_s0, docs_s1, docs_s2) >= 1 AND least(r0, r1, r2) >= 1.2, false) AS hi, coalesce(guard AND rows_short > 0 AND docs_short >= rows_short AND greatest(r0, r1, r2) <= 1 / 1.2, false) AS lo FROM c)
      SELECT entity, docs_s0, docs_s1, docs_s2, r0, r1, r2, round(base0, 9) AS base, hi, lo, hi OR lo AS fires FROM d"""


def _family(spark: SparkSession, sf_dir: str, family: str, kind: str) -> DataFrame:
    return rolled(spark, sf_dir).where((F.col("family") == family) & (F.col("entity_kind") == kind))


def _trends() -> None:
    for short, family in (("il", "infologger"), ("central", "central"), ("local", "local")):

        @query(f"monitor_trend_{short}_volume", _volume_sql(family))
        def volume(spark: SparkSession, sf_dir: str, family: str = family) -> DataFrame:
            return r.volume_verdicts(_family(spark, sf_dir, family, "host"), AS_OF, DAY, LONG, SHORT, min_docs=1, ratio=1.2)

    for name, family in (("il_ef", "infologger"), ("central_errors", "central")):
        docs, ef, rows = (f"(CASE WHEN docs_long > 0 THEN {x}_long ELSE {x}_short END)" for x in ("docs", "ef", "rows"))
        base = f"(CASE WHEN {docs} > 0 THEN greatest({ef} / {docs}, 0.001) END)"
        each = " AND ".join(f"docs_s{k} >= 1 AND ef_s{k} >= 1 AND ef_s{k} / nullif(docs_s{k}, 0) / {base} >= 1.5" for k in range(3))
        sql = _slices_sql(family, "host", ("docs", "doc_count"), ("ef", "ef_count")) + f" SELECT entity, docs_s0, docs_s1, docs_s2, ef_s0, ef_s1, ef_s2, round({base}, 9) AS base, coalesce({docs} > 0 AND {rows} >= 6 AND {each}, false) AS fires FROM t"

        @query(f"monitor_trend_{name}", sql)
        def errors(spark: SparkSession, sf_dir: str, family: str = family) -> DataFrame:
            return r.ef_verdicts(_family(spark, sf_dir, family, "host"), AS_OF, DAY, LONG, SHORT, min_docs=1, min_ef=1, ratio=1.5)

    for short, family in (("il", "infologger"), ("local", "local")):
        for lag, kind, column, ceiling in (("entry", "host", "p95_entry_lag_ms", 3.6e6), ("shipping", "node", "p95_shipping_lag_ms", None)):
            base, rows = "(CASE WHEN coalesce(lag_long > 0, false) THEN lag_long ELSE lag_short END)", "(CASE WHEN coalesce(lag_long > 0, false) THEN rows_long ELSE rows_short END)"
            top = "AND lag_s{k} <= 3.6e6 " if ceiling else ""
            each = " AND ".join(f"lag_s{k} IS NOT NULL AND docs_s{k} >= 1 AND lag_s{k} >= 10 {top.format(k=k)}AND lag_s{k} / {base} >= 1.1" for k in range(3))
            sql = _slices_sql(family, kind, ("docs", "doc_count"), ("lag", column)) + f" SELECT entity, round(lag_s0, 3) AS lag_s0, round(lag_s1, 3) AS lag_s1, round(lag_s2, 3) AS lag_s2, round({base}, 6) AS base, coalesce({base} > 0 AND {rows} >= 6 AND {each}, false) AS fires FROM t"

            @query(f"monitor_trend_{short}_{lag}_lag", sql)
            def tail(spark: SparkSession, sf_dir: str, family: str = family, kind: str = kind, column: str = column, ceiling: float | None = ceiling) -> DataFrame:
                return r.lag_verdicts(_family(spark, sf_dir, family, kind), column, AS_OF, DAY, LONG, SHORT, min_docs=1, min_lag=10.0, ceiling=ceiling, ratio=1.1)


_trends()


@query("flagship_volume_verdict", _volume_sql("infologger"))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which host's share of its fleet's volume moved against its own baseline; every host with its ratios."""
    return r.volume_verdicts(_family(spark, sf_dir, "infologger", "host"), AS_OF, DAY, LONG, SHORT, min_docs=1, ratio=1.2)


@query("monitor_log_family_silence", f"WITH {META_SQL} SELECT *, recent_rows > 0 AND recent_docs = 0 AND n_rows >= 6 AND docs > 0 AND docs >= 50 * n_rows AS fires FROM (SELECT family, count(*)::BIGINT AS n_rows, sum(doc_count)::BIGINT AS docs, count(*) FILTER (ts >= {AS_OF - 2 * DAY})::BIGINT AS recent_rows, coalesce(sum(CASE WHEN ts >= {AS_OF - 2 * DAY} THEN doc_count END), 0)::BIGINT AS recent_docs FROM meta WHERE entity_kind = 'host' AND ts >= {AS_OF - 20 * DAY} AND ts < {AS_OF} GROUP BY family)")
def log_family_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.family_silence(rolled_meta(spark, sf_dir), AS_OF, 20 * DAY, 2 * DAY)


@query("monitor_trend_rollup_stale", f"WITH {META_SQL} SELECT n, n_recent, n > 0 AND n_recent = 0 AS fires FROM (SELECT count(*)::BIGINT AS n, count(*) FILTER (ts >= {AS_OF - 2 * DAY})::BIGINT AS n_recent FROM (SELECT ts, NOT bool_or(truncated) AS complete FROM meta GROUP BY ts) WHERE complete AND ts >= {AS_OF - 20 * DAY} AND ts < {AS_OF})")
def trend_rollup_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.rollup_stale(r.commits(rolled_meta(spark, sf_dir)), AS_OF, 20 * DAY, 2 * DAY)


@query("monitor_trend_entity_cap", f"WITH {META_SQL} SELECT coalesce(max(entity_count), 0)::BIGINT AS most, coalesce(bool_or(truncated), false) AS cut, coalesce(bool_or(truncated), false) OR coalesce(max(entity_count), 0) >= 1800 AS fires FROM meta WHERE ts >= {AS_OF - 10 * DAY} AND ts < {AS_OF}")
def trend_entity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.entity_cap(rolled_meta(spark, sf_dir), AS_OF, 10 * DAY)


@query("monitor_disk_fill_forecast", f"SELECT highest, coalesce(highest > 85, false) AS fires FROM (SELECT max(value / 5.0) AS highest FROM events WHERE event_id % 3 <> 0 AND epoch_us(ts) // 1000 >= {AS_OF - 5 * DAY} AND epoch_us(ts) // 1000 <= {AS_OF})")
def disk_fill_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), (F.col("value") / 5.0).alias("forecast_value"), F.when(F.col("event_id") % 3 == 0, "task").alias("task_id"))
    return m.forecast_high(e, AS_OF, hour_ms=5 * DAY)


@query("monitor_ad_high_grade", f"SELECT grade, confidence, coalesce(grade > 0.7 AND confidence > 0.7, false) AS fires FROM (SELECT max(value / 490.0) AS grade, arg_max((event_id % 100) / 100.0, (value / 490.0, event_id)) AS confidence FROM events WHERE event_id % 3 <> 0 AND epoch_us(ts) // 1000 >= {AS_OF - 5 * DAY} AND epoch_us(ts) // 1000 <= {AS_OF})")
def ad_high_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("execution_ms"), (F.col("value") / 490.0).alias("grade"), ((F.col("event_id") % 100) / 100.0).alias("confidence"), F.when(F.col("event_id") % 3 == 0, "task").alias("task_id"))
    return m.high_grade(e, AS_OF, window_ms=5 * DAY)
