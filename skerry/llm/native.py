"""Column expressions shared by the operators that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The separators of words in most contracts: space and the controls 9 to 13.
SPACES = "\\x20\\x09-\\x0D"
LOW32 = 0xFFFFFFFF
#: Copies of a row are counted out in runs of this many, so that no array is longer than their number's root or so.
RUN = 1 << 16


def n_words(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def bits(key: Column, part: int) -> Column:
    """32 bits (part 0 or 1) of the MD5 of key as text, as a long; a null key counts as an empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("long")


def counted_out(rows: DataFrame, n: str, name: str) -> DataFrame:
    """Each row n times (n at least 1), with the count from 0 as `name`, without an array of length n."""
    run = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / RUN).cast("long"))))
    left = F.least(F.lit(RUN).cast("long"), F.col(n) - F.col("run") * RUN)
    return run.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), left - 1))).withColumn(name, F.col("run") * RUN + F.col(name)).drop("run")
