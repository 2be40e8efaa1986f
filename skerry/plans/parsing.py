"""Queries of scans, projections, filters and parsers (inventory A and B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import parsing as p
from skerry.operators import multiline, ordered
from skerry.plans.registry import query
from skerry.session import AS_OF, DAY
from skerry.sources.adapters import LOG, METRICS, log_events, metric_samples, table

W = f"WITH {LOG} "


@query("severity_normalize", W + "SELECT severity, severity_norm, count(*)::BIGINT AS n FROM log_events GROUP BY ALL")
def severity_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).groupBy("severity", "severity_norm").agg(F.count("*").alias("n"))


_RAW = "CASE event_id % 6 WHEN 0 THEN 'inf' WHEN 1 THEN 'cout' WHEN 2 THEN 'err' WHEN 3 THEN 'Info' WHEN 4 THEN 'wrn' END"


@query(
    "severity_route",
    f"SELECT source, raw, tier, count(*)::BIGINT AS n FROM (SELECT source, raw, CASE WHEN source = 'dds' THEN CASE WHEN raw = 'inf' THEN 'local' WHEN raw IS NOT NULL THEN 'central' END ELSE CASE WHEN raw = 'Info' THEN 'local' ELSE 'central' END END AS tier FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'dds' ELSE 'stdout' END AS source, {_RAW.replace('event_id % 6', '(event_id // 2) % 6')} AS raw FROM events)) GROUP BY ALL",
)
def severity_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.expr("CASE WHEN event_id % 2 = 0 THEN 'dds' ELSE 'stdout' END").alias("source"), F.expr(_RAW.replace("event_id % 6", "(event_id div 2) % 6")).alias("raw"), "event_type")
    return e.select("source", "raw", p.route(F.col("source"), F.col("raw"), F.col("event_type")).alias("tier")).groupBy("source", "raw", "tier").agg(F.count("*").alias("n"))


_DDS = "concat('2024-01-0', event_id % 9 + 1, ' 10:00:00.', event_id % 1000, '   ', CASE WHEN event_id % 3 = 0 THEN 'inf' ELSE 'err' END, '  src', user_id, ' <', event_id, ':', user_id, '>  ', event_type, ' value\n  ', props)"


@query(
    "dds_parse",
    rf"SELECT event_id, g[1] AS time, g[2] AS severity, g[3] AS source, g[4] AS tid, CASE WHEN g[1] = '' THEN line ELSE g[5] END AS message FROM (SELECT event_id, line, [CASE WHEN k = 5 THEN regexp_extract(line, pat, 5) WHEN k = 4 THEN nullif(regexp_extract(line, pat, 4), '') WHEN k = 3 THEN nullif(regexp_extract(line, pat, 3), '') WHEN k = 2 THEN nullif(regexp_extract(line, pat, 2), '') ELSE nullif(regexp_extract(line, pat, 1), '') END FOR k IN [1, 2, 3, 4, 5]] AS g FROM (SELECT event_id, CASE WHEN event_id % 10 = 7 THEN event_type ELSE {_DDS} END AS line, '(?s)^(\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}\.\d+)\s+(\S+)\s+(\S+)\s+(<[^>]*>)\s+(.*)$' AS pat FROM events))".replace("g[1] = ''", "g[1] IS NULL").replace("regexp_extract(line, pat, ", r"regexp_extract(line, '(?s)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)\s+(\S+)\s+(\S+)\s+(<[^>]*>)\s+(.*)$', "),
)
def dds_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select("event_id", F.expr(f"CASE WHEN event_id % 10 = 7 THEN event_type ELSE {_DDS.replace(chr(10), chr(92) + 'n')} END").alias("line"))
    return lines.select("event_id", p.dds_fields(F.col("line")).alias("f")).select("event_id", "f.*")


_OUT = "CASE event_id % 3 WHEN 0 THEN concat('2024-01-01 10:00:00.', event_id, ' Error in <', event_type, '>: bad ', value) WHEN 1 THEN concat('Info in <x>: ', event_type) ELSE event_type END"
_STD = r"'(?s)^(?:(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+) )?(?:(Info|Warning|Error|Fatal|Sys) in <([^>]*)>: )?(.*)$'"


@query("stdout_parse", f"SELECT event_id, nullif(regexp_extract(line, {_STD}, 1), '') AS time, nullif(regexp_extract(line, {_STD}, 2), '') AS severity, nullif(regexp_extract(line, {_STD}, 3), '') AS facility, regexp_extract(line, {_STD}, 4) AS message FROM (SELECT event_id, {_OUT.replace('value', 'user_id')} AS line FROM events)")
def stdout_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select("event_id", F.expr(_OUT.replace("value", "user_id")).alias("line"))
    return lines.select("event_id", p.stdout_fields(F.col("line")).alias("f")).select("event_id", "f.*")


_PATH = "CASE event_id % 3 WHEN 0 THEN concat('/data/', event_type, '/epn', user_id, '_2024-01-05-10-11-1', event_id % 10, '_out.log') WHEN 1 THEN concat('/x/other', user_id, '_err.log') ELSE 'plain.log' END"


@query("path_parse", rf"SELECT event_id, regexp_extract(path, '^(?:.*/)?((epn\d+)?[^/]*)$', 1) AS source_file, nullif(regexp_extract(path, '^(?:.*/)?((epn\d+)?[^/]*)$', 2), '') AS host, CASE WHEN path LIKE '%2024-01-05%' THEN 1704449471000 - 1000 + 1000 * (event_id % 10) END::BIGINT AS name_ms FROM (SELECT event_id, {_PATH} AS path FROM events)")
def path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "events").select("event_id", F.expr(_PATH).alias("path"))
    return paths.select("event_id", p.path_fields(F.col("path")).alias("f"), p.name_time(F.col("path")).alias("name_ms")).select("event_id", "f.*", "name_ms")


_CLOCK = "CASE event_id % 5 WHEN 0 THEN cast(1704067200 + event_id as varchar) WHEN 1 THEN cast(1704067200000 + event_id as varchar) WHEN 2 THEN concat('2024-01-02 03:04:0', event_id % 10) WHEN 3 THEN concat('2024-01-02T03:04:0', event_id % 10, 'Z') ELSE 'never' END"


@query("epoch_coerce", f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN (1704067200 + event_id) * 1000 WHEN 1 THEN 1704067200000 + event_id WHEN 2 THEN 1704164640000 + 1000 * (event_id % 10) WHEN 3 THEN 1704164640000 + 1000 * (event_id % 10) ELSE -1 END::BIGINT AS ms FROM (SELECT event_id, {_CLOCK} AS clock FROM events)")
def epoch_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(_CLOCK.replace("varchar", "string")).alias("clock")).select("event_id", p.epoch_ms(F.col("clock")).alias("ms"))


@query("epoch_numbers", "SELECT event_id, ms // 1000 * 1000 AS from_seconds, ms AS from_millis, ms // 1000 * 1000 AS from_long, ms AS from_text FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events)")
def epoch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clock as a double of seconds, a double and a long of either, and as text."""
    rows = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    forms = {"from_seconds": F.col("ms") / 1000.0, "from_millis": F.col("ms").cast("double"), "from_long": F.floor(F.col("ms") / 1000), "from_text": F.col("ms").cast("string")}
    return rows.select("event_id", *[p.epoch_ms(c).alias(n) for n, c in forms.items()])


@query("log_lags", W + "SELECT event_id, ingest_lag_ms, enter_system_lag_ms FROM log_events")
def log_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_events(spark, sf_dir)
    return rows.select("event_id", p.lag_ms(F.col("ingest_ms"), F.col("collector_ms")).alias("ingest_lag_ms"), p.lag_ms(F.col("collector_ms"), F.col("event_ms")).alias("enter_system_lag_ms"))


@query("collector_stamp", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE epoch_us(ts) // 1000 END::BIGINT AS collector_ms FROM events")
def collector_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    known = F.when(F.col("event_id") % 3 == 0, F.lit(1).cast("long"))
    return e.select("event_id", F.coalesce(known, F.unix_millis(F.col("ts").cast("timestamp"))).alias("collector_ms"))


@query("event_time_ffill", W + "SELECT event_id, last_value(CASE WHEN event_id % 4 <> 0 THEN event_ms END IGNORE NULLS) OVER (PARTITION BY origin_host ORDER BY collector_ms, event_id) AS event_ms FROM log_events")
def event_time_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_events(spark, sf_dir).withColumn("t", F.when(F.col("event_id") % 4 != 0, F.col("event_ms")))
    return ordered.carry_forward(rows, "t", ["origin_host"], ["collector_ms", "event_id"]).select("event_id", F.col("t").alias("event_ms"))


@query("multiline_fold", r"SELECT file, island, count(*)::BIGINT AS lines, string_agg(line, chr(10) ORDER BY event_id) AS record FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '^\S') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY event_id)::BIGINT AS island FROM (SELECT event_id, concat('f', user_id) AS file, CASE WHEN event_id % 3 = 0 THEN concat('  ', event_type) ELSE event_type END AS line FROM events)) GROUP BY ALL")
def multiline_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").selectExpr("event_id", "concat('f', user_id) AS file", "CASE WHEN event_id % 3 = 0 THEN concat('  ', event_type) ELSE event_type END AS line")
    return multiline.fold(lines, "file", "event_id", "line", "stdout")


@query("kql_filter", W + "SELECT event_id FROM log_events WHERE origin_host LIKE 'epn00000%' AND (severity_norm = 'error' OR severity_norm = 'warning') AND NOT coalesce(family, '') = 'local'")
def kql_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).where(F.col("origin_host").like("epn00000%") & F.col("severity_norm").isin("error", "warning") & ~(F.coalesce("family", F.lit("")) == "local")).select("event_id")


@query("kql_token_match", "SELECT doc_id FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), ['license', 'stupid', 'token'])")
def kql_token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(p.any_token(F.col("text"), "license", "stupid", "token")).select("doc_id")


@query("term_range_exists", W + f"SELECT count(*)::BIGINT AS n, count(message)::BIGINT AS n_message FROM log_events WHERE family IN ('local', 'central') AND collector_ms >= {AS_OF - 7 * DAY} AND collector_ms <= {AS_OF} AND message IS NOT NULL")
def term_range_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_events(spark, sf_dir).where(F.col("family").isin("local", "central") & F.col("collector_ms").between(AS_OF - 7 * DAY, AS_OF) & F.col("message").isNotNull())
    return rows.agg(F.count("*").alias("n"), F.count("message").alias("n_message"))


@query("live_filter", W + "SELECT event_id FROM log_events WHERE severity_norm IN ('error', 'warning') AND contains(lower(origin_host), '00') AND contains(lower(concat_ws(' ', message, origin_host)), 'k=1')")
def live_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "message", "origin_host"))
    return log_events(spark, sf_dir).where(F.col("severity_norm").isin("error", "warning") & F.lower("origin_host").contains("00") & text.contains("k=1")).select("event_id")


@query("canonical_hash", W + """SELECT event_id, substr(sha256('{"alertname":"' || event_type || '","entity_id":"' || origin_host || '","scope":"fleet"}'), 1, 32) AS content_hash, sha1(length(family) || ':' || family || ':' || event_id) AS uid FROM log_events""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_events(spark, sf_dir)
    return rows.select("event_id", p.content_hash(scope=F.lit("fleet"), alertname=F.col("event_type"), entity_id=F.col("origin_host")).alias("content_hash"), p.source_uid(F.col("family"), F.col("event_id").cast("string")).alias("uid"))


@query("shard_route", W + "SELECT shard, count(*)::BIGINT AS n FROM (SELECT CAST(regexp_replace(origin_host, '[^0-9]', '', 'g') AS BIGINT) % 4 AS shard FROM log_events) GROUP BY shard")
def shard_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).groupBy(p.host_shard(F.col("origin_host"), 4).alias("shard")).agg(F.count("*").alias("n"))


@query("label_and_id_lists", "SELECT event_id, ['k=' || json_extract_string(props, '$.k'), 'type=' || event_type] AS labels, list_distinct_ordered AS ids FROM (SELECT *, CASE WHEN user_id = event_id % 7 THEN [CAST(user_id AS VARCHAR), 'x'] ELSE [CAST(user_id AS VARCHAR), CAST(event_id % 7 AS VARCHAR), 'x'] END AS list_distinct_ordered FROM events)")
def label_and_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    ids = F.concat(F.col("user_id").cast("string"), F.lit(", "), (F.col("event_id") % 7).cast("string"), F.lit(",, x,x"))
    return table(spark, sf_dir, "events").select("event_id", p.label_list(labels).alias("labels"), p.id_list(ids).alias("ids"))


@query("scalar_parsing", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE (event_id % 100)::DOUBLE END AS pct, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END::INTEGER AS code, CASE WHEN event_id % 50 = 0 THEN 0.0 ELSE round_even(100.0 * ((event_id % 50) - (event_id % 50) // 3) / (event_id % 50), 1) END::DOUBLE AS disk, strftime(to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM events")
def scalar_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 4 == 3, "-").otherwise(F.concat((F.col("event_id") % 100).cast("string"), F.lit("%")))
    status = F.element_at(F.array(*map(F.lit, ("green", "yellow", "red", "grey"))), (F.col("event_id") % 4 + 1).cast("int"))
    total = (F.col("event_id") % 50).cast("double")
    return e.select("event_id", p.percent(text).alias("pct"), p.status_code(status).alias("code"), p.disk_percent(total, F.floor(total / 3)).cast("double").alias("disk"), p.iso_seconds(F.unix_millis(F.col("ts").cast("timestamp"))).alias("iso"))


@query("scope_and_render", W + "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'fleet' ELSE 'collector:' || node END AS scope, event_type || ' on ' || origin_host || ' (' || family || ')' AS title FROM log_events")
def scope_and_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_events(spark, sf_dir)
    scope = F.when(F.col("event_id") % 2 == 0, "fleet").otherwise("collector")
    return rows.select("event_id", p.scope_label(scope, F.col("node")).alias("scope"), p.render(F.lit("{kind} on {entity} ({family})"), kind=F.col("event_type"), entity=F.col("origin_host"), family=F.col("family")).alias("title"))


@query("rate_profiles", "SELECT second::BIGINT AS second, 20000.0::DOUBLE AS steady, (5000.0 + 45000.0 * least(1.0, second / 600.0))::DOUBLE AS ramp, CASE WHEN second % 150 < 30 THEN 50000.0 ELSE 5000.0 END::DOUBLE AS burst FROM range(900) t(second)")
def rate_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("id").cast("double")
    return spark.range(900).select(F.col("id").alias("second"), p.rate_at(s, "steady", 0, 20000).alias("steady"), p.rate_at(s, "ramp", 5000, 50000).alias("ramp"), p.rate_at(s, "burst", 5000, 50000).alias("burst"))


@query("clock_shift", f"SELECT event_id, epoch_us(ts) // 1000 + ({AS_OF} - (SELECT min(epoch_us(ts) // 1000) FROM events)) AS shifted_ms FROM events")
def clock_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return ordered.shift_clock(rows, "ms", AS_OF).select("event_id", F.col("ms").alias("shifted_ms"))


@query("line_times", "SELECT event_id, '2024-01-05 10:11:10.' || lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS VARCHAR), 6, '0') AS line_time FROM events")
def line_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.numbered(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "k")
    return rows.select("event_id", p.line_time(F.lit(1704449470000), F.col("k")).alias("line_time"))


@query("live_projection", W + "SELECT event_id, severity_norm, origin_host, coalesce(nullif(message, ''), '') AS message, row_number() OVER (ORDER BY collector_ms DESC, event_id DESC)::BIGINT AS age FROM log_events QUALIFY age <= 500")
def live_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 500 records, as the live lane's ring buffer holds them."""
    last = log_events(spark, sf_dir).orderBy(F.desc("collector_ms"), F.desc("event_id")).limit(500)
    return ordered.numbered(last, [], [F.desc("collector_ms"), F.desc("event_id")], "k").select("event_id", "severity_norm", "origin_host", F.coalesce("message", F.lit("")).alias("message"), (F.col("k") + 1).alias("age"))


@query("sample_kinds", f"WITH {METRICS} SELECT kind, count(*)::BIGINT AS n FROM metric_samples WHERE NOT (kind LIKE '.%' OR kind LIKE 'top_queries-%') GROUP BY kind")
def sample_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ~F.col("kind").startswith(".") & ~F.col("kind").startswith("top_queries-")
    return metric_samples(spark, sf_dir).where(own).groupBy("kind").agg(F.count("*").alias("n"))
