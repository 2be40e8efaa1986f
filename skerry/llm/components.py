"""Connected components of a table of links, by alternating star operations over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.store import written


def _large(e: DataFrame) -> DataFrame:
    """Every node tells its larger neighbours the least of itself and its neighbours."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Every node tells its smaller neighbours, and itself, the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    told = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return told.where("u <> v").distinct()


def roots(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root, the least node it is linked with directly or through others; roots themselves have no row.

    Kiveris et al. 2014: the rounds grow with the logarithm of the longest chain; each is written to the shared
    folder, and only a count and a checksum come to the driver.
    """
    e = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    last = None
    while True:
        e = written(_small(_large(e)), "stars")
        now = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == last or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
