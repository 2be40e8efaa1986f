"""Tables that cut lineage: written under the cluster's shared checkpoint folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from skerry.sources.shared import delete, home, shared_dir

__all__ = ["clear", "scratch", "shared_dir", "written"]

#: The tables of the scratch() that a thread is in, if any.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes inside are deleted at the end; what is to outlive them is written with keep, or after."""
    made: list[str] = []
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in made:
            delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written; DataFrames that read them are no longer of use."""
    delete(spark, home(spark))


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    The table outlives executors, so later jobs never rerun what made it, and lasts until scratch() or the application ends.
    keep: it outlives a scratch() as well.
    """
    spark = df.sparkSession
    path = f"{home(spark)}/{name}-{uuid.uuid4().hex}"
    scope = _SCOPE.get()
    if scope is not None and not keep:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
