"""Incremental reads that overlap: late rows are seen again, and the mark moves only once all was consumed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.sources import sinks

MINUTE = 60_000


@dataclass(frozen=True)
class Lane:
    """A named read of one source: its mark stands under root; each read starts `overlap_ms` before it, the first `first_ms` before now.

    What consumes the rows must be idempotent by key, as rows of the overlap come again.
    """

    root: str
    name: str
    overlap_ms: int = 15 * MINUTE
    first_ms: int = 120 * MINUTE

    def _path(self) -> str:
        return f"{self.root}/watermarks/{self.name}"

    def mark(self, spark: SparkSession) -> int | None:
        """The mark of the last cycle that succeeded."""
        if not sinks.exists(spark, self._path()):
            return None
        return spark.read.schema("mark long").parquet(self._path()).agg(F.max("mark")).first()[0]

    def lower(self, spark: SparkSession, now_ms: int) -> int:
        mark = self.mark(spark)
        return (now_ms - self.first_ms if mark is None else mark) - self.overlap_ms

    def cycle(self, source: DataFrame, column: str, now_ms: int, consume: Callable[[DataFrame], None]) -> int:
        """Consume the rows from the lower bound on, then move the mark to the highest clock seen; a failure leaves it where it was."""
        spark = source.sparkSession
        lower = self.lower(spark, now_ms)
        rows = source.where(F.col(column) >= lower)
        highest = max(lower, rows.agg(F.max(column)).first()[0] or lower)
        consume(rows.where(F.col(column) <= highest))
        sinks.append(spark.createDataFrame([(highest,)], "mark long"), self._path())
        return highest
