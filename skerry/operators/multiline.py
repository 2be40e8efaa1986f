"""Assembly of records that span lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry import catalog


def fold(lines: DataFrame, file: str, number: str, line: str, family: str) -> DataFrame:
    """file, island, lines and record: a record is a line that starts one and the lines up to the next start.

    Lines before a file's first start are island 0. A file is the unit of order, so files are the unit of parallelism.
    """
    w = Window.partitionBy(file).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when(F.col(line).rlike(catalog.RECORD_START[family]), 1).otherwise(0).cast("long")
    islands = lines.withColumn("island", F.sum(starts).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("k"), F.col(line).alias("t")))), lambda x: x["t"]), "\n")
    return islands.groupBy(file, "island").agg(F.count("*").alias("lines"), joined.alias("record"))
