"""Generated log records and load, by fixed rules, so that every run gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import parsing as p

#: Of a thousand records so many are below each bound, and their codes by family.
SHARES = (900, 980, 995)
CODES = {"infologger": ("I", "W", "E", "F"), "dds": ("inf", "wrn", "err", "fat"), "stdout": ("Info", "Warning", "Error", "Fatal")}


def draw(id_: Column) -> Column:
    """0 to 999, spread over ids."""
    return id_ * 7919 % 1000


def severity(id_: Column, family: str) -> Column:
    """90, 8, 1.5 and 0.5 percent information, warnings, errors and fatal errors, in the family's codes."""
    codes = CODES[family]
    return F.when(draw(id_) < SHARES[0], codes[0]).when(draw(id_) < SHARES[1], codes[1]).when(draw(id_) < SHARES[2], codes[2]).otherwise(codes[3])


def _clock(start_ms: int) -> Column:
    return F.date_format(F.timestamp_millis(F.lit(start_ms) + F.col("id") * 10), "yyyy-MM-dd HH:mm:ss.SSS")


def infologger(spark: SparkSession, n: int, start_ms: int, hosts: int = 8) -> DataFrame:
    """Structured records: id, hostname, severity, timestamp (seconds, a double) and message."""
    host = F.concat(F.lit("epn"), F.lpad((F.col("id") % hosts).cast("string"), 6, "0"))
    return spark.range(n).select("id", host.alias("hostname"), severity(F.col("id"), "infologger").alias("severity"), ((F.lit(start_ms) + F.col("id") * 10) / 1000.0).alias("timestamp"), F.concat(F.lit("record "), F.col("id").cast("string")).alias("message"))


def dds(spark: SparkSession, n: int, start_ms: int) -> DataFrame:
    """Lines of the agents' format: id and value; every tenth record has a second line."""
    more = F.when(F.col("id") % 10 == 0, F.lit("\n  continued")).otherwise(F.lit(""))
    line = F.concat(_clock(start_ms), F.lit("  "), severity(F.col("id"), "dds"), F.lit("  agent  <"), F.col("id").cast("string"), F.lit(":1>  record "), F.col("id").cast("string"), more)
    return spark.range(n).select("id", line.alias("value"))


def stdout(spark: SparkSession, n: int, start_ms: int) -> DataFrame:
    """Lines of tasks' output: id and value; every seventh has no clock, every eleventh no severity."""
    head = F.when(F.col("id") % 7 != 0, F.concat(_clock(start_ms), F.lit(" "))).otherwise(F.lit(""))
    mark = F.when(F.col("id") % 11 != 0, F.concat(severity(F.col("id"), "stdout"), F.lit(" in <task>: "))).otherwise(F.lit(""))
    return spark.range(n).select("id", F.concat(head, mark, F.lit("record "), F.col("id").cast("string")).alias("value"))


def load(spark: SparkSession, seconds: int, profile: str, low: float, high: float) -> DataFrame:
    """second and record of a load gun: each second offers the records that its profile's rate asks for."""
    rate = F.round(p.rate_at(F.col("id"), profile, low, high)).cast("long")
    return spark.range(seconds).where(rate > 0).select(F.col("id").alias("second"), F.explode(F.sequence(F.lit(0).cast("long"), rate - 1)).alias("record"))
