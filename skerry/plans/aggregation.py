"""Queries of aggregations (inventory D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import aggregates as a
from skerry.operators import ordered
from skerry.plans.registry import query
from skerry.session import AS_OF, DAY
from skerry.sources.adapters import LOG, METRICS, log_events, metric_samples, table

W, M = f"WITH {LOG} ", f"WITH {METRICS} "
BAD = "CASE WHEN severity_norm IN ('error', 'fatal') THEN 1 ELSE 0 END"


@query("composite_counts", W + "SELECT origin_host, severity_norm, count(*)::BIGINT AS doc_count, count(message)::BIGINT AS messages FROM log_events WHERE origin_host IS NOT NULL AND severity_norm IS NOT NULL GROUP BY ALL")
def composite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.composite(log_events(spark, sf_dir), ["origin_host", "severity_norm"], doc_count=F.count("*"), messages=F.count("message"))


@query("filter_subagg", W + "SELECT family, count(*)::BIGINT AS n, sum(CASE WHEN severity_norm IN ('error', 'fatal') THEN 1 ELSE 0 END)::BIGINT AS bad, coalesce(sum(CASE WHEN severity_norm = 'fatal' THEN enter_system_lag_ms END), 0)::BIGINT AS fatal_lag, avg(CASE WHEN severity_norm = 'fatal' THEN enter_system_lag_ms END)::DOUBLE AS avg_fatal FROM log_events GROUP BY family")
def filter_subagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    fatal = F.when(F.col("severity_norm") == "fatal", F.col("enter_system_lag_ms"))
    return log_events(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"), F.sum(F.expr(BAD)).alias("bad"), F.coalesce(F.sum(fatal), F.lit(0)).alias("fatal_lag"), F.avg(fatal).alias("avg_fatal"))


@query("filters_agg", W + "SELECT 'all' AS name, count(*)::BIGINT AS n FROM log_events UNION ALL SELECT 'errors', count(*) FROM log_events WHERE severity_norm = 'error' UNION ALL SELECT 'slow', count(*) FROM log_events WHERE enter_system_lag_ms > 200 UNION ALL SELECT 'local', count(*) FROM log_events WHERE family = 'local'")
def filters_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.filters(log_events(spark, sf_dir), {"all": F.lit(True), "errors": F.col("severity_norm") == "error", "slow": F.col("enter_system_lag_ms") > 200, "local": F.col("family") == "local"})


@query("p95_by_host", W + "SELECT origin_host, round(quantile_cont(enter_system_lag_ms, 0.95), 3) AS p95, round(avg(enter_system_lag_ms), 6) AS mean, min(enter_system_lag_ms) AS low, max(enter_system_lag_ms) AS high FROM log_events GROUP BY origin_host")
def p95_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    lag = "enter_system_lag_ms"
    return log_events(spark, sf_dir).groupBy("origin_host").agg(a.p95(lag).alias("p95"), F.round(F.avg(lag), 6).alias("mean"), F.min(lag).alias("low"), F.max(lag).alias("high"))


@query("cardinality", W + "SELECT family, count(DISTINCT origin_host)::BIGINT AS hosts FROM log_events GROUP BY family")
def cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).groupBy("family").agg(F.count_distinct("origin_host").alias("hosts"))


@query("terms_topn", W + "SELECT origin_host, count(*)::BIGINT AS n FROM log_events GROUP BY origin_host ORDER BY n DESC, origin_host LIMIT 10")
def terms_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.terms(log_events(spark, sf_dir), "origin_host", 10)


@query("nested_terms_topn", W + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, origin_host)::INTEGER AS rank FROM (SELECT family, origin_host, count(*)::BIGINT AS n FROM log_events GROUP BY ALL)) WHERE rank <= 5")
def nested_terms_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.terms(log_events(spark, sf_dir), "family", 5, "origin_host").select("family", "origin_host", "n", "rank")


@query("gap_fill_hist", W + f"SELECT b AS bucket_ms, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(generate_series((SELECT min(collector_ms // 3600000 * 3600000) FROM log_events WHERE family = 'local' AND event_type = 'error' AND collector_ms < {AS_OF - 20 * DAY}), (SELECT max(collector_ms // 3600000 * 3600000) FROM log_events WHERE family = 'local' AND event_type = 'error' AND collector_ms < {AS_OF - 20 * DAY}), 3600000)) AS b) LEFT JOIN (SELECT collector_ms // 3600000 * 3600000 AS c, count(*) AS n FROM log_events WHERE family = 'local' AND event_type = 'error' AND collector_ms < {AS_OF - 20 * DAY} GROUP BY 1) ON b = c")
def gap_fill_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_events(spark, sf_dir).where((F.col("family") == "local") & (F.col("event_type") == "error") & (F.col("collector_ms") < AS_OF - 20 * DAY))
    return a.date_histogram(rows, "collector_ms", 3_600_000, fill=True)


@query("grade_histogram", "SELECT floor(value / 490.0 * 10) / 10 AS bucket, count(*)::BIGINT AS n FROM events GROUP BY 1")
def grade_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.histogram(table(spark, sf_dir, "events").withColumn("grade", F.col("value") / F.lit(490.0)), "grade", 10)


@query("top_hit", W + "SELECT origin_host, event_id, severity_norm, collector_ms FROM (SELECT *, row_number() OVER (PARTITION BY origin_host ORDER BY CASE severity_norm WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END DESC, collector_ms DESC, event_id DESC) AS k FROM log_events) WHERE k = 1")
def top_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst, then latest, record of each host."""
    worst = F.when(F.col("severity_norm") == "error", 2).when(F.col("severity_norm") == "warning", 1).otherwise(0)
    return ordered.latest(log_events(spark, sf_dir), ["origin_host"], F.struct(worst, "collector_ms", "event_id"), ["event_id", "severity_norm", "collector_ms"])


@query("having_selector", W + "SELECT origin_host, count(*)::BIGINT AS n, sum(CASE WHEN severity_norm = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors FROM log_events GROUP BY origin_host HAVING sum(CASE WHEN severity_norm = 'error' THEN 1 ELSE 0 END) * 5 > count(*)")
def having_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = a.composite(log_events(spark, sf_dir), ["origin_host"], n=F.count("*"), errors=F.sum(F.when(F.col("severity_norm") == "error", 1).otherwise(0)))
    return got.where(F.col("errors") * 5 > F.col("n"))


@query("query_trigger", W + f"SELECT count(*)::BIGINT AS n, count(*) > 0 AND max(enter_system_lag_ms) > 400 AS fires FROM log_events WHERE collector_ms > {AS_OF - 3 * DAY}")
def query_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = log_events(spark, sf_dir).where(F.col("collector_ms") > AS_OF - 3 * DAY).agg(F.count("*").alias("n"), F.max("enter_system_lag_ms").alias("m"))
    return got.select("n", ((F.col("n") > 0) & (F.col("m") > 400)).alias("fires"))


@query("re_aggregation", W + "SELECT origin_host, sum(n)::BIGINT AS docs, count(*)::BIGINT AS buckets, round(avg(p), 6) AS lag FROM (SELECT origin_host, collector_ms // 86400000 AS d, count(*) AS n, round(quantile_cont(enter_system_lag_ms, 0.95), 3) AS p FROM log_events GROUP BY ALL) GROUP BY origin_host")
def re_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = log_events(spark, sf_dir).groupBy("origin_host", F.floor(F.col("collector_ms") / DAY).alias("d")).agg(F.count("*").alias("n"), a.p95("enter_system_lag_ms").alias("p"))
    return daily.groupBy("origin_host").agg(F.sum("n").alias("docs"), F.count("*").alias("buckets"), F.round(F.avg("p"), 6).alias("lag"))


@query("noisy_or", "SELECT user_id, round(1 - product(1 - CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0.01 * (event_id % 7) END), 4) AS belief FROM events GROUP BY user_id")
def noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    p_ = F.when(F.col("event_id") % 3 != 0, F.lit(0.01) * (F.col("event_id") % 7))
    return table(spark, sf_dir, "events").withColumn("p", p_).groupBy("user_id").agg(a.noisy_or("p", 0.5).alias("belief"))


@query("nearest_rank_p95", W + "SELECT family, list_sort(list(enter_system_lag_ms))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1] AS p95, list_sort(list(enter_system_lag_ms))[CAST(round_even(0.5 * (count(*) - 1), 0) AS BIGINT) + 1] AS p50 FROM log_events WHERE event_type = 'error' GROUP BY family")
def nearest_rank_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.nearest_ranks(log_events(spark, sf_dir).where("event_type = 'error'"), ["family"], "enter_system_lag_ms", p95=0.95, p50=0.5)


@query("ceil_rank_p95", W + "SELECT origin_host, list_sort(list(n))[CAST(ceil(0.95 * count(*)) AS BIGINT)]::BIGINT AS p95, least(2000, greatest(50, ceil(list_sort(list(n))[CAST(ceil(0.95 * count(*)) AS BIGINT)] * 12 * 9)))::BIGINT AS burst FROM (SELECT origin_host, collector_ms // 86400000 AS d, count(*) AS n FROM log_events GROUP BY ALL) GROUP BY origin_host")
def ceil_rank_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p95 of non-empty buckets, and the burst that a third poison step would send."""
    from skerry.operators import evaluation

    buckets = log_events(spark, sf_dir).groupBy("origin_host", F.floor(F.col("collector_ms") / DAY).alias("d")).agg(F.count("*").alias("n"))
    return buckets.groupBy("origin_host").agg(a.ceil_rank("n", 0.95).alias("p95")).withColumn("burst", evaluation.burst_size(F.col("p95"), 3, 50, 2000))


@query("modal_parent", W + "SELECT origin_host, first(family ORDER BY n DESC, family) AS family, max(n)::BIGINT AS n, count(*) > 1 AS ambiguous FROM (SELECT origin_host, CASE WHEN event_id % 5 = 0 THEN 'other' ELSE family END AS family, count(*) AS n FROM log_events GROUP BY ALL) GROUP BY origin_host")
def modal_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_events(spark, sf_dir).withColumn("family", F.when(F.col("event_id") % 5 == 0, "other").otherwise(F.col("family")))
    return a.mode(rows, ["origin_host"], "family")


@query("json_tree_sum", "SELECT event_id, (event_id % 7 + event_id % 5 + 3 + event_id % 3 + 4)::BIGINT AS rejections, (user_id + event_id)::BIGINT AS counters FROM events")
def json_tree_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = F.format_string('{"a":{"rejection_count":%d,"b":[{"rejection_count": %d},{"rejection_count":1.5}]},"rejection_count":3,"other":9,"c":{"rejection_count":{"x":%d,"y":4,"z":{"w":8},"v":"7"}}}', F.col("event_id") % 7, F.col("event_id") % 5, F.col("event_id") % 3)
    counters = F.create_map(F.lit("x"), F.col("user_id"), F.lit("y"), F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", a.tree_sum(tree, "rejection_count").alias("rejections"), a.map_sum(counters).alias("counters"))


@query("baseline_window", W + f"SELECT family, min(collector_ms) AS first_ms, max(collector_ms) AS last_ms, count(*)::BIGINT AS n, least(max(collector_ms) - min(collector_ms), {DAY}) AS span_ms FROM log_events GROUP BY family")
def baseline_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = log_events(spark, sf_dir).groupBy("family").agg(F.min("collector_ms").alias("first_ms"), F.max("collector_ms").alias("last_ms"), F.count("*").alias("n"))
    return got.withColumn("span_ms", F.least(F.col("last_ms") - F.col("first_ms"), F.lit(DAY)))


@query("feature_coverage", W + f"SELECT origin_host, buckets, covered FROM (SELECT origin_host, count(*)::BIGINT AS buckets, count(*) FILTER (n > 0 AND p IS NOT NULL)::BIGINT AS covered, sum(n) AS docs FROM (SELECT origin_host, collector_ms // {DAY} AS d, count(*) AS n, quantile_cont(CASE WHEN event_id % 2 = 0 THEN enter_system_lag_ms END, 0.95) AS p FROM log_events GROUP BY ALL) GROUP BY origin_host) ORDER BY docs DESC, origin_host LIMIT 1")
def feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_events(spark, sf_dir).withColumn("lag", F.when(F.col("event_id") % 2 == 0, F.col("enter_system_lag_ms")))
    buckets = rows.groupBy("origin_host", F.floor(F.col("collector_ms") / DAY).alias("d")).agg(F.count("*").alias("n"), F.percentile("lag", F.lit(0.95)).alias("p"))
    got = buckets.groupBy("origin_host").agg(F.count("*").alias("buckets"), F.count_if((F.col("n") > 0) & F.col("p").isNotNull()).alias("covered"), F.sum("n").alias("docs"))
    return got.orderBy(F.desc("docs"), "origin_host").limit(1).select("origin_host", "buckets", "covered")


@query("soak_summary", M + "SELECT kind, max(output_records)::BIGINT AS peak, arg_max(output_records, (ts, event_id))::BIGINT AS last, round(max(cpu_percent), 6) AS cpu FROM metric_samples GROUP BY kind")
def soak_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_samples(spark, sf_dir).groupBy("kind").agg(F.max("output_records").alias("peak"), F.max_by("output_records", F.struct("ts", "event_id")).alias("last"), F.round(F.max("cpu_percent"), 6).alias("cpu"))


@query("severity_over_time", W + "SELECT collector_ms // 86400000 * 86400000 AS bucket_ms, severity_norm, count(*)::BIGINT AS n FROM log_events GROUP BY ALL")
def severity_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).groupBy((F.floor(F.col("collector_ms") / DAY) * DAY).alias("bucket_ms"), "severity_norm").agg(F.count("*").alias("n"))


@query("drop_accounting", "SELECT reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN value < 5 THEN 'grade-missing' WHEN user_id % 10 = 0 THEN 'unknown-detector' WHEN event_type = 'view' THEN 'category-missing' END AS reason FROM events) WHERE reason IS NOT NULL GROUP BY reason")
def drop_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a projection drops, by the first reason that holds."""
    reason = F.when(F.col("value") < 5, "grade-missing").when(F.col("user_id") % 10 == 0, "unknown-detector").when(F.col("event_type") == "view", "category-missing")
    return table(spark, sf_dir, "events").select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query("doc_tokens", r"SELECT lang, count(*)::BIGINT AS docs, sum(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')))::BIGINT AS words FROM documents GROUP BY lang")
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("long").alias("words"))
