"""Sinks: upsert by key, append, create-only, ordered commits, retention, purge and migration, over Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.functions import parsing as p

DAY_MS = 86_400_000


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, at, _ = _fs(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at, _ = _fs(spark, path)
    fs.delete(at, True)


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Put a whole written table in another's place. A crash between the two renames is mended by the next _recover()."""
    fs, at, jvm = _fs(spark, path)
    old = jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    if fs.exists(at):
        fs.delete(old, True)
        fs.rename(at, old)
    fs.rename(jvm.org.apache.hadoop.fs.Path(new), at)
    fs.delete(old, True)


def _recover(spark: SparkSession, path: str) -> None:
    """Bring back a table that a crashed _swap() had set aside."""
    fs, at, jvm = _fs(spark, path)
    old = jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    if not fs.exists(at) and fs.exists(old):
        fs.rename(old, at)


def latest_by_key(rows: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if isinstance(order, str) else order.desc())
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert(rows: DataFrame, path: str, keys: Sequence[str], partition: str | None = None, order: str | None = None) -> None:
    """Write rows over those of the same keys; writing the same rows again changes nothing.

    With a partition column, which must follow from the keys, only the partitions that rows touch are read and replaced; without one the whole
    table is rewritten, which suits small tables only. Of rows that share a key the one with the greatest `order` is
    written; without an order they must be alike.
    """
    spark = rows.sparkSession
    _recover(spark, path)
    new = latest_by_key(rows, keys, order) if order else rows.dropDuplicates(list(keys))
    if not exists(spark, path):
        writer = new.write.partitionBy(partition) if partition else new.write
        writer.parquet(path)
        return
    old = spark.read.parquet(path)
    if partition:
        touched = [r[0] for r in new.select(partition).distinct().collect()]  # partitions of one batch: as literals they prune the scan
        old = old.where(F.col(partition).isin(touched))
    both = old.join(new, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)
    staged = f"{path}.new-{uuid.uuid4().hex}"
    both.write.parquet(staged)
    if partition:
        spark.read.parquet(staged).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(partition).parquet(path)
        remove(spark, staged)
    else:
        _swap(spark, staged, path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def create_only(rows: DataFrame, path: str, version: str, order: str) -> bool:
    """Append a snapshot if its version differs from the latest one's; whether it was appended."""
    spark = rows.sparkSession
    now = rows.agg(F.max_by(version, order)).first()[0]
    if exists(spark, path):
        last = spark.read.parquet(path).agg(F.max_by(version, order)).first()[0]
        if last == now:
            return False
    append(rows, path)
    return True


def publish_roster(assignments: DataFrame, collectors: DataFrame, path: str, now_ms: int) -> str | None:
    """Append a topology snapshot (a row an assignment) unless the one in force is the same; its version, or None if nothing was appended.

    The version is a hash of the sorted content. A roster without collectors and an assignment to an unknown collector
    are refused. collectors: collector_id; assignments: origin_host and collector_id.
    """
    spark = assignments.sparkSession
    known = collectors.select("collector_id").where("collector_id is not null").distinct()
    if known.isEmpty():
        raise ValueError("a roster without collectors is never a valid publication")
    unknown = sorted(r[0] for r in assignments.select("collector_id").subtract(known).limit(10).collect() if r[0])
    if unknown:
        raise ValueError(f"assignments name collectors outside the roster: {unknown}")
    pairs = assignments.select("origin_host", "collector_id").distinct()
    hosts = pairs.agg(F.array_sort(F.collect_list(F.struct("origin_host", "collector_id"))).alias("a"))
    names = known.agg(F.array_sort(F.collect_list("collector_id")).alias("c"))
    version = hosts.join(F.broadcast(names)).select(F.substring(F.sha2(F.to_json(F.struct("a", "c")), 256), 1, 32)).first()[0]
    if exists(spark, path) and spark.read.parquet(path).agg(F.max_by("topology_version", "effective_from")).first()[0] == version:
        return None
    append(pairs.withColumn("topology_version", F.lit(version)).withColumn("effective_from", F.lit(now_ms).cast("long")), path)
    return version


def commit_bucket(rows: DataFrame, meta: DataFrame, commits: DataFrame, root: str) -> None:
    """Rows, then metadata, then commit markers: a reader that asks for a complete marker sees all that it covers.

    A failure at any step leaves no marker, and the next run writes the same keys again. Tables are partitioned by day, so that
    a commit touches the days of its buckets and no more.
    """
    for table, name, keys in ((rows, "rows", ["ts", "family", "entity_kind", "entity"]), (meta, "meta", ["ts", "family", "entity_kind"]), (commits, "commits", ["ts"])):
        upsert(table.withColumn("day", F.floor(F.col("ts") / DAY_MS)), f"{root}/{name}", keys, "day")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """Rows of buckets whose marker says complete."""
    done = spark.read.parquet(f"{root}/commits").where("complete").select("ts")
    return spark.read.parquet(f"{root}/rows").join(done, "ts", "left_semi").drop("day")


def retain(spark: SparkSession, path: str, keep: Column) -> None:
    """Delete rows that `keep` doesn't hold for."""
    staged = f"{path}.new-{uuid.uuid4().hex}"
    spark.read.parquet(path).where(keep).write.parquet(staged)
    _swap(spark, staged, path)


def drop_old_partitions(spark: SparkSession, path: str, column: str, cutoff: str) -> list[str]:
    """Delete partitions below the cutoff by their folders' names alone; what was deleted."""
    fs, at, jvm = _fs(spark, path)
    gone = []
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.startswith(f"{column}=") and name.partition("=")[2] < cutoff:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def purge(spark: SparkSession, root: str, derived: Sequence[str]) -> None:
    """Delete derived tables and checkpoints; dimension tables beside them stay."""
    for name in derived:
        remove(spark, f"{root}/{name}")


def migrate(spark: SparkSession, old: str, new: str) -> int:
    """Copy a table to another place and count what arrived."""
    spark.read.parquet(old).write.parquet(new)
    return spark.read.parquet(new).count()


def webhook_rows(payloads: DataFrame, column: str = "body", received_ms: str = "received_ms") -> DataFrame:
    """Notification rows of webhook payloads in any of three shapes; the same alert within a minute is one row.

    Shapes: a grouped notification (`alerts` array), a monitor's action (`monitor_name`), and a bare message.
    """
    shape = "struct<status:string,receiver:string,groupKey:string,alerts:array<struct<labels:map<string,string>>>,monitor_name:string,trigger_name:string,signal_ids:string,message:string>"
    rows = payloads.select(F.col(received_ms).alias("received_ms"), F.col(column).alias("body"), F.from_json(column, shape).alias("j"))
    kind = F.when(F.col("j.alerts").isNotNull(), "group").when(F.col("j.monitor_name").isNotNull(), "action").otherwise("message")
    name = F.coalesce(F.col("j.alerts")[0]["labels"]["alertname"], F.col("j.monitor_name"), F.lit("none"))
    key = F.sha2(F.concat_ws("|", kind, F.coalesce("j.groupKey", name), F.coalesce("j.status", F.lit("")), F.floor(F.col("received_ms") / 60_000).cast("string")), 256)
    ids = p.id_list(F.coalesce("j.signal_ids", F.lit("")))
    labels = F.when(F.col("j.alerts").isNotNull(), p.label_list(F.col("j.alerts")[0]["labels"])).otherwise(F.array().cast("array<string>"))
    out = rows.select(key.alias("notification_id"), "received_ms", kind.alias("record_kind"), F.col("j.status").alias("status"), F.col("j.receiver").alias("receiver"), name.alias("alertname"), F.coalesce(F.size("j.alerts"), F.lit(0)).alias("alert_count"), labels.alias("labels_kv"), ids.alias("signal_ids"), "body")
    return out.dropDuplicates(["notification_id"])
