"""Ordered computation: running values, deltas, gaps, slices and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[str | Column]


def carry_forward(df: DataFrame, column: str, keys: Sequence[str], order: Order) -> DataFrame:
    """The last non-null value of a column, by key in order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def counter_delta(df: DataFrame, column: str, keys: Sequence[str], order: Order, skip_null: bool = False) -> DataFrame:
    """How much a counter rose: 0 at the first sample and after a reset. A null counts as 0, or, with skip_null, leaves the state alone."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if skip_null:
        before = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn(f"{column}_delta", F.when(F.col(column).isNotNull(), F.greatest(F.coalesce(F.col(column) - before, F.lit(0)), F.lit(0))))
    return df.withColumn(f"{column}_delta", F.greatest(F.coalesce(F.col(column) - F.lag(column).over(w), F.lit(0)), F.lit(0)))


def latest(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest order: an aggregate, so partial results are merged and no window is sorted."""
    best = F.max_by(F.struct(*columns), order).alias("row")
    return df.groupBy(*keys).agg(best).select(*keys, "row.*")


def numbered(df: DataFrame, keys: Sequence[str], order: Order, name: str) -> DataFrame:
    """Gapless numbers from 0 in each key; without keys only for inputs already cut to a bounded size."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def top_n(df: DataFrame, n: int, keys: Sequence[str], order: Order, name: str = "rank") -> DataFrame:
    """The first n rows of each key, with their rank; Spark keeps only n rows a key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def shingles(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Order, size: int = 8) -> DataFrame:
    """The last `size` vectors of each key as one array; rows with fewer are left out."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(size - 1), 0)
    return df.withColumn("shingle", F.collect_list(F.struct(*columns)).over(w)).where(F.size("shingle") == size)


def sequence_gaps(df: DataFrame, column: str, keys: Sequence[str], order: Order) -> DataFrame:
    """gap (numbers missing before this row) and duplicate (number not above the greatest seen), by key in order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(column).over(w)
    return df.withColumn("gap", F.greatest(F.coalesce(F.col(column) - seen - 1, F.lit(0)), F.lit(0))).withColumn("duplicate", F.coalesce(F.col(column) <= seen, F.lit(False)))


def epoch_gaps(df: DataFrame, column: str, epoch: str, keys: Sequence[str], order: Order) -> DataFrame:
    """sequence_gaps() where a new epoch starts the numbers over: its first row has an `unknown` gap, not a number."""
    w = Window.partitionBy(*keys).orderBy(*order)
    turned = F.coalesce(F.col(epoch) != F.lag(epoch).over(w), F.lit(False))
    runs = df.withColumn("unknown", turned).withColumn("run_", F.sum(F.col("unknown").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = sequence_gaps(runs, column, [*keys, "run_"], order)
    return got.withColumn("gap", F.when(~F.col("unknown"), F.col("gap"))).drop("run_")


def shift_clock(df: DataFrame, column: str, now_ms: int) -> DataFrame:
    """All clocks moved so that the earliest is now; the minimum is one row, joined to all."""
    first = df.agg(F.min(column).alias("first_ms"))
    return df.join(F.broadcast(first)).withColumn(column, F.col(column) + (F.lit(now_ms) - F.col("first_ms"))).drop("first_ms")


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """A number for each run of intervals that touch: a run ends where the next interval starts after all ends so far."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    return df.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")
