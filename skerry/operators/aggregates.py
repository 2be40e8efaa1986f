"""Aggregations of the search store's vocabulary, in one pass each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from json import loads

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators import ordered


def composite(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """All groups of keys; groups with a null key don't exist."""
    some = df
    for k in keys:
        some = some.where(F.col(k).isNotNull())
    return some.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def filters(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """name and n of overlapping named predicates: one scan, one row a name."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in predicates.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in predicates])))


def p95(column: str) -> Column:
    """The exact 95th percentile, linearly interpolated, to three places; null over nothing."""
    return F.round(F.percentile(column, F.lit(0.95)), 3)


def nearest_ranks(df: DataFrame, keys: Sequence[str], values: str, **fractions: float) -> DataFrame:
    """sorted[round(fraction * (n - 1))] of each key's values, halves to even; 0 for a key that has none.

    Equal values are counted before the shuffle, and a running count over the distinct ones finds the ranks, so no list is held.
    """
    counts = df.groupBy(*keys, F.col(values).alias("v_")).agg(F.count(values).alias("c_"))
    w = Window.partitionBy(*keys)
    upto = counts.withColumn("n_", F.sum("c_").over(w)).withColumn("upto_", F.sum("c_").over(w.orderBy("v_")))
    rank = lambda f: F.bround(F.lit(f) * (F.col("n_") - 1))
    return upto.groupBy(*keys).agg(*[F.coalesce(F.min(F.when((F.col("c_") > 0) & (F.col("upto_") > rank(f)), F.col("v_"))), F.lit(0)).alias(n) for n, f in fractions.items()])


def ceil_rank(values: str, fraction: float, default: int = 1) -> Column:
    """sorted[ceil(fraction * n) - 1]; the default over nothing. The discrete percentile is that, from counts of distinct values."""
    return F.coalesce(F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {values})"), F.lit(default))


def noisy_or(probability: str, prior: float) -> Column:
    """1 - the product of 1 - p, to four places; an unmeasured p counts as the prior."""
    return F.round(1 - F.product(1 - F.coalesce(F.col(probability), F.lit(prior))), 4)


def terms(df: DataFrame, key: str, n: int, *sub: str, **aggs: Column) -> DataFrame:
    """The n most frequent values of a key (ties by value); with sub, the same again for the pairs below each."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), *[a.alias(x) for x, a in aggs.items()])
    top = counted.orderBy(F.desc("n"), key).limit(n)
    if not sub:
        return top
    pairs = df.join(top.select(key), key, "left_semi").groupBy(key, *sub).agg(F.count("*").alias("n"))
    return ordered.top_n(pairs, n, [key], [F.desc("n"), *sub])


def histogram(df: DataFrame, column: str, per_unit: int) -> DataFrame:
    """Counts by floor(x * per_unit) / per_unit."""
    return df.groupBy((F.floor(F.col(column) * per_unit) / per_unit).alias("bucket")).agg(F.count("*").alias("n"))


def date_histogram(df: DataFrame, ms: str, interval_ms: int, fill: bool = False, **aggs: Column) -> DataFrame:
    """Rows by fixed buckets of epoch ms; fill adds the empty buckets between the first and the last."""
    bucket = (F.floor(F.col(ms) / interval_ms) * interval_ms).cast("long").alias("bucket_ms")
    got = df.groupBy(bucket).agg(F.count("*").alias("n"), *[a.alias(x) for x, a in aggs.items()])
    if not fill:
        return got
    span = got.agg(F.min("bucket_ms").alias("a"), F.max("bucket_ms").alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b", F.lit(interval_ms).cast("long"))).alias("bucket_ms"))
    return every.join(got, "bucket_ms", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each key, ties by value, its count, and whether others are there too."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("best")
    return counts.groupBy(*keys).agg(best, (F.count("*") > 1).alias("ambiguous")).select(*keys, F.col("best.v").alias(value), (-F.col("best.n")).alias("n"), "ambiguous")


def tree_total(text: str | None, key: str) -> int:
    """The sum of all whole numbers under `key` anywhere in a JSON text: a number itself, or an object's numbers; not below that."""
    try:
        stack, total = [loads(text)], 0
    except (TypeError, ValueError):
        return 0
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    while stack:
        at = stack.pop()
        if isinstance(at, list):
            stack.extend(at)
        elif isinstance(at, dict):
            for name, value in at.items():
                if name != key:
                    stack.append(value)
                elif isinstance(value, dict):
                    total += sum(filter(whole, value.values()))
                elif whole(value):
                    total += value
    return total


def tree_sum(json: Column, key: str) -> Column:
    """tree_total() of each text; 0 for what isn't JSON. Trees have no schema to walk by expressions, so batches go through Arrow."""

    @F.pandas_udf("long")
    def total(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tree_total(t, key))

    return total(json)


def map_sum(values: Column) -> Column:
    return F.aggregate(F.map_values(values), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0)))
