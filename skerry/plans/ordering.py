"""Queries of ordered computation, sorts and top-k (inventory E and F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import ordered as o
from skerry.operators.aggregates import date_histogram
from skerry.plans.registry import query
from skerry.session import DAY
from skerry.sources.adapters import ALERTS, LOG, METRICS, alerts, log_events, metric_samples, table

W, M = f"WITH {LOG} ", f"WITH {METRICS} "


@query("counter_delta", M + "SELECT event_id, greatest(coalesce(output_records - lag(output_records) OVER (PARTITION BY collector_id ORDER BY ts, event_id), 0), 0)::BIGINT AS output_records_delta FROM metric_samples WHERE kind = 'fluentbit'")
def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metric_samples(spark, sf_dir).where("kind = 'fluentbit'").drop("output_records_delta")
    return o.counter_delta(rows, "output_records", ["collector_id"], ["ts", "event_id"]).select("event_id", F.col("output_records_delta").cast("long"))


@query("counter_delta_nulls", M + "SELECT event_id, CASE WHEN x IS NOT NULL THEN greatest(coalesce(x - last_value(x IGNORE NULLS) OVER (PARTITION BY collector_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) END::BIGINT AS delta FROM (SELECT *, CASE WHEN event_id % 4 <> 0 THEN output_records END AS x FROM metric_samples WHERE kind = 'fluentbit')")
def counter_delta_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metric_samples(spark, sf_dir).where("kind = 'fluentbit'").select("event_id", "collector_id", "ts", F.when(F.col("event_id") % 4 != 0, F.col("output_records")).alias("x"))
    return o.counter_delta(rows, "x", ["collector_id"], ["ts", "event_id"], skip_null=True).select("event_id", F.col("x_delta").cast("long").alias("delta"))


@query("latest_per_kind", M + "SELECT kind, collector_id, ts, event_id FROM metric_samples QUALIFY row_number() OVER (PARTITION BY kind, collector_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.latest(metric_samples(spark, sf_dir), ["kind", "collector_id"], F.struct("ts", "event_id"), ["ts", "event_id"])


@query("card_rank", W + "SELECT family, origin_host, n, child, dense_rank() OVER (ORDER BY total DESC, family)::INTEGER AS card FROM (SELECT family, origin_host, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY family ORDER BY count(*) DESC, origin_host)::INTEGER AS child, sum(count(*)) OVER (PARTITION BY family) AS total FROM log_events GROUP BY family, origin_host) WHERE child <= 3")
def card_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each family by volume, and its three loudest hosts; the rank of cards is over a row a family."""
    hosts = log_events(spark, sf_dir).groupBy("family", "origin_host").agg(F.count("*").alias("n"))
    cards = o.numbered(hosts.groupBy("family").agg(F.sum("n").alias("total")), [], [F.desc("total"), "family"], "k")
    children = o.top_n(hosts, 3, ["family"], [F.desc("n"), "origin_host"], "child")
    return children.join(F.broadcast(cards), "family").select("family", "origin_host", "n", "child", (F.col("k") + 1).cast("int").alias("card"))


@query("shingle", W + "SELECT origin_host, day, len(list(n) OVER w)::INTEGER AS size, list_sum(list(n) OVER w)::BIGINT AS total FROM (SELECT origin_host, collector_ms // 86400000 AS day, count(*) AS n FROM log_events GROUP BY ALL) WINDOW w AS (PARTITION BY origin_host ORDER BY day ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) QUALIFY size = 8")
def shingle(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = log_events(spark, sf_dir).groupBy("origin_host", F.floor(F.col("collector_ms") / DAY).alias("day")).agg(F.count("*").alias("n"))
    got = o.shingles(days, ["n"], ["origin_host"], ["day"])
    return got.select("origin_host", "day", F.size("shingle").alias("size"), F.aggregate("shingle", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("total"))


@query("seq_gap", "SELECT event_id, greatest(coalesce(s - m - 1, 0), 0)::BIGINT AS gap, coalesce(s <= m, false) AS duplicate FROM (SELECT event_id, s, max(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT *, event_id - event_id % 3 AS s FROM events))")
def seq_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("s", F.col("event_id") - F.col("event_id") % 3)
    return o.sequence_gaps(rows, "s", ["user_id"], ["event_id"]).select("event_id", "gap", "duplicate")


@query("episode_k1", f"WITH {ALERTS}, s AS (SELECT monitor_name || '/' || bucket_key AS k, id, start_time AS a, coalesce(end_time, start_time + 86400000) AS b FROM alerts WHERE bucket_key IS NOT NULL), f AS (SELECT *, CASE WHEN max(b) OVER w IS NULL OR a > max(b) OVER w THEN 1 ELSE 0 END AS fresh FROM s WINDOW w AS (PARTITION BY k ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY a, b, id) AS island FROM f) SELECT k, min(a) AS opened, max(b) AS closed, count(*)::BIGINT AS members FROM i GROUP BY k, island")
def episode_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that one clearing closes: runs of alerts that touch, as islands."""
    rows = alerts(spark, sf_dir).where("bucket_key is not null").select(F.concat_ws("/", "monitor_name", "bucket_key").alias("k"), F.col("start_time").alias("a"), F.coalesce("end_time", F.col("start_time") + DAY).alias("b"))
    return o.islands(rows, ["k"], "a", "b").groupBy("k", "island").agg(F.min("a").alias("opened"), F.max("b").alias("closed"), F.count("*").alias("members")).drop("island")


@query("sample_rate", M + "SELECT event_id, CASE WHEN ts > p THEN round(greatest(output_records - r, 0) * 1000.0 / (ts - p), 9) END AS rate FROM (SELECT *, lag(ts) OVER w AS p, lag(output_records) OVER w AS r FROM metric_samples WHERE kind = 'fluentbit' WINDOW w AS (PARTITION BY collector_id ORDER BY ts, event_id))")
def sample_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = metric_samples(spark, sf_dir).where("kind = 'fluentbit'").drop("output_records_delta")
    w = Window.partitionBy("collector_id").orderBy("ts", "event_id")
    got = o.counter_delta(rows, "output_records", ["collector_id"], ["ts", "event_id"]).withColumn("p", F.lag("ts").over(w))
    return got.select("event_id", F.when(F.col("ts") > F.col("p"), F.round(F.col("output_records_delta") * 1000.0 / (F.col("ts") - F.col("p")), 9)).alias("rate"))


@query("running_worst", W + "SELECT event_id, max(value) OVER (PARTITION BY origin_host ORDER BY collector_ms, event_id) AS worst FROM log_events")
def running_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("origin_host").orderBy("collector_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return log_events(spark, sf_dir).select("event_id", F.max("value").over(w).alias("worst"))


@query("sorted_limits", W + "SELECT event_id, severity_norm, collector_ms FROM log_events ORDER BY severity_norm, collector_ms DESC, event_id LIMIT 25")
def sorted_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).select("event_id", "severity_norm", "collector_ms").orderBy("severity_norm", F.desc("collector_ms"), "event_id").limit(25)


@query("lifecycle_sort", f"WITH {ALERTS} SELECT monitor_name, bucket_key, string_agg(id, ',' ORDER BY start_time, last_notification_time, CASE WHEN state IN ('ACTIVE', 'ERROR') THEN 0 ELSE 1 END, id) AS ids FROM alerts GROUP BY monitor_name, bucket_key")
def lifecycle_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of every incident in order; those without a bucket are one incident of their monitor."""
    rank = F.when(F.col("state").isin("ACTIVE", "ERROR"), 0).otherwise(1)
    held = F.array_sort(F.collect_list(F.struct("start_time", "last_notification_time", rank.alias("rank"), "id")))
    return alerts(spark, sf_dir).groupBy("monitor_name", "bucket_key").agg(F.array_join(F.transform(held, lambda x: x["id"]), ",").alias("ids"))


@query("bounded_membership", W + "SELECT origin_host, least(count(*), 10)::INTEGER AS kept, count(*) > 10 AS truncated, string_agg(event_id, ',' ORDER BY event_id) FILTER (k <= 10) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY origin_host ORDER BY event_id) AS k FROM log_events) GROUP BY origin_host")
def bounded_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 ids of each host and whether there are more: a top-k before collecting, so no list grows."""
    rows = log_events(spark, sf_dir)
    some = o.top_n(rows, 10, ["origin_host"], ["event_id"], "k").groupBy("origin_host").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    counts = rows.groupBy("origin_host").agg(F.count("*").alias("n"))
    return some.join(counts, "origin_host").select("origin_host", F.size("ids").alias("kept"), (F.col("n") > 10).alias("truncated"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("hourly_histogram", W + "SELECT collector_ms // 3600000 * 3600000 AS bucket_ms, count(*)::BIGINT AS n, sum(enter_system_lag_ms)::BIGINT AS lag FROM log_events GROUP BY 1")
def hourly_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return date_histogram(log_events(spark, sf_dir), "collector_ms", 3_600_000, lag=F.sum("enter_system_lag_ms"))
