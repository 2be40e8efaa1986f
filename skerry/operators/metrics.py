"""Health samples of the store and its dashboards: projections of their status documents, and deltas of their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import parsing as p
from skerry.operators import ordered

#: Shapes of the status documents, as far as they are read.
CLUSTER = "struct<status:string,number_of_nodes:int,active_shards:int,relocating_shards:int,initializing_shards:int,unassigned_shards:int,number_of_pending_tasks:int>"
INDEX = "struct<index:string,health:string,pri:string,rep:string,`docs.count`:string,`store.size`:string>"
NODE = "struct<name:string,jvm:struct<mem:struct<heap_used_percent:double>>,os:struct<cpu:struct<percent:double>>,fs:struct<total:struct<total_in_bytes:bigint,available_in_bytes:bigint>>,indices:struct<docs:struct<count:bigint>,store:struct<size_in_bytes:bigint>,indexing:struct<index_total:bigint>>>"
DASHBOARDS = "struct<status:struct<overall:struct<state:string>>,metrics:struct<process:struct<memory:struct<resident_set_size_in_bytes:bigint>,event_loop_delay:double>,os:struct<load:struct<`1m`:double>>,response_times:struct<avg_in_millis:double,max_in_millis:double>,requests:struct<total:bigint>,concurrent_connections:bigint>>"


def _or0(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def cluster(bodies: DataFrame, body: str = "body") -> DataFrame:
    """kind, status, its code and the shard counts of cluster health documents, beside the columns that came with them."""
    j = bodies.withColumn("j", F.from_json(body, CLUSTER)).where(F.col("j").isNotNull())
    rest = [c for c in bodies.columns if c != body]
    status = F.coalesce("j.status", F.lit("unknown"))
    counts = {"nodes_count": "number_of_nodes", "active_shards": "active_shards", "relocating_shards": "relocating_shards", "initializing_shards": "initializing_shards", "unassigned_shards": "unassigned_shards", "pending_tasks": "number_of_pending_tasks"}
    return j.select(*rest, F.lit("cluster").alias("kind"), status.alias("cluster_status"), p.status_code(status).alias("cluster_status_code"), *[_or0(f"j.{c}").alias(n) for n, c in counts.items()])


def indices(bodies: DataFrame, time: str, operations: DataFrame | None = None, body: str = "body") -> DataFrame:
    """A row for each index of index listings (arrays), with what its documents and operations rose by; hidden indices are left out.

    operations: index, time and indexing_total, where known.
    """
    rows = bodies.select(time, F.explode(F.from_json(body, f"array<{INDEX}>")).alias("j")).where(~F.col("j.index").startswith(".") & ~F.col("j.index").startswith("top_queries-"))
    got = rows.select(
        time, F.lit("index").alias("kind"), F.col("j.index").alias("index_name"), F.coalesce("j.health", F.lit("unknown")).alias("index_health"), _or0(F.col("j.pri").try_cast("int")).alias("pri"),
        _or0(F.col("j.rep").try_cast("int")).alias("rep"), _or0(F.col("j.`docs.count`").try_cast("long")).alias("docs_count"), _or0(F.col("j.`store.size`").try_cast("long")).alias("store_bytes"),
    )
    if operations is None:
        got = got.withColumn("indexing_total", F.lit(0).cast("long"))
    else:
        got = got.join(operations.select(time, F.col("index").alias("index_name"), "indexing_total"), [time, "index_name"], "left").withColumn("indexing_total", _or0("indexing_total"))
    for counter, name in (("docs_count", "docs_delta"), ("indexing_total", "indexing_delta")):
        got = ordered.counter_delta(got, counter, ["index_name"], [time]).withColumnRenamed(f"{counter}_delta", name)
    return got


def nodes(bodies: DataFrame, time: str, rejections: DataFrame | None = None, body: str = "body") -> DataFrame:
    """A row for each node document, with disk use and what its counters rose by.

    rejections: os_node, time and admission_rejections_total; a node that the listing lacks leaves its counter's state alone.
    """
    j = bodies.select(time, F.from_json(body, NODE).alias("j")).where(F.col("j").isNotNull())
    got = j.select(
        time, F.lit("node").alias("kind"), F.coalesce("j.name", F.lit("unknown")).alias("os_node"), _or0("j.jvm.mem.heap_used_percent").alias("heap_percent"), _or0("j.os.cpu.percent").alias("cpu_percent"),
        p.disk_percent(_or0("j.fs.total.total_in_bytes"), _or0("j.fs.total.available_in_bytes")).alias("disk_used_percent"), _or0("j.indices.docs.count").alias("docs_count"),
        _or0("j.indices.store.size_in_bytes").alias("store_bytes"), _or0("j.indices.indexing.index_total").alias("indexing_total"),
    )
    got = ordered.counter_delta(got, "indexing_total", ["os_node"], [time]).withColumnRenamed("indexing_total_delta", "indexing_delta")
    if rejections is None:
        return got.withColumn("admission_rejections_total", F.lit(0).cast("long")).withColumn("admission_rejections_delta", F.lit(0).cast("long"))
    got = got.join(rejections, [time, "os_node"], "left")
    got = ordered.counter_delta(got, "admission_rejections_total", ["os_node"], [time], skip_null=True).withColumnRenamed("admission_rejections_total_delta", "admission_rejections_delta")
    return got.withColumn("admission_rejections_total", _or0("admission_rejections_total")).withColumn("admission_rejections_delta", _or0("admission_rejections_delta"))


def dashboards(bodies: DataFrame, body: str = "body") -> DataFrame:
    """kind, state, its code and load of dashboard status documents; no document at all is `unreachable`."""
    j = bodies.withColumn("j", F.from_json(body, DASHBOARDS))
    rest = [c for c in bodies.columns if c != body]
    state = F.when(F.col(body).isNull(), "unreachable").otherwise(F.coalesce("j.status.overall.state", F.lit("unknown")))
    load = {
        "rss_bytes": "process.memory.resident_set_size_in_bytes", "event_loop_delay": "process.event_loop_delay", "load_1m": "os.load.`1m`", "response_avg_ms": "response_times.avg_in_millis",
        "response_max_ms": "response_times.max_in_millis", "requests_total": "requests.total", "concurrent_connections": "concurrent_connections",
    }
    return j.select(*rest, F.lit("osd").alias("kind"), state.alias("osd_state"), p.status_code(state).alias("osd_state_code"), *[F.when(F.col(body).isNotNull(), _or0(f"j.metrics.{c}")).alias(n) for n, c in load.items()])


def fleet(samples: DataFrame, roster: DataFrame, now_ms: int, grace_ms: int) -> DataFrame:
    """A heartbeat row for each rostered collector: missing, age, and the health that its last sample gave."""
    last = samples.groupBy("collector_id").agg(F.max("ts").alias("last_ms"), F.max_by("fb_healthy", F.struct("ts", "event_id")).alias("fb_healthy"))
    age = F.lit(now_ms) - F.col("last_ms")
    return roster.select("collector_id").distinct().join(last, "collector_id", "left").select(
        F.lit("fleet").alias("kind"), "collector_id", F.when(age <= grace_ms, 0).otherwise(1).alias("heartbeat_missing"), age.alias("heartbeat_age_ms"), F.coalesce("fb_healthy", F.lit(0)).alias("fb_healthy")
    )
