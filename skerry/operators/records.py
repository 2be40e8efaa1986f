"""Record-level stages of intake: modifiers, conditional drops, baselines and the live lane's shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import parsing as p

#: The fields that the live lane keeps.
LIVE_FIELDS = (
    "@timestamp", "collector_time", "severity", "severity_norm", "origin_host", "host", "hostname", "node", "log_source", "source_file", "source", "facility",
    "message", "rolename", "run", "partition", "detector", "system", "pid", "username", "level", "errcode", "errsource", "errline",
)


def modified(df: DataFrame, drop: Sequence[str] = (), **constants: str) -> DataFrame:
    """A record modifier: named keys go, and constants are added or put in a key's place."""
    return df.drop(*drop).withColumns({n: F.lit(v) for n, v in constants.items()}) if constants else df.drop(*drop)


def without(df: DataFrame, column: str, value: str) -> DataFrame:
    """Records but those whose column has the value; records without it stay. To be used after enrichment has filled the column."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def clean_baseline(df: DataFrame, time: str, now_ms: int, marker: str, back_ms: int = 7_200_000) -> DataFrame:
    """Recent records that no fault injection has marked: what a baseline may learn from."""
    return df.where(F.col(marker).isNull() & (F.col(time) >= now_ms - back_ms) & (F.col(time) <= now_ms))


def live(df: DataFrame) -> DataFrame:
    """The live lane's records: those of its fields that there are, severity, host and message filled."""
    has = set(df.columns)
    get = lambda c: F.col(f"`{c}`") if c in has else F.lit(None).cast("string")
    blank = lambda c: F.nullif(get(c), F.lit(""))
    filled: dict[str, Column] = {
        "severity_norm": F.coalesce(blank("severity_norm"), p.severity_norm(get("severity"))),
        "origin_host": F.coalesce(blank("origin_host"), p.origin_host(get("hostname"), get("host"))),
        "message": p.live_message(get("message").cast("string"), get("log").cast("string")),
    }
    return df.select(*[(filled[c] if c in filled else F.col(f"`{c}`")).alias(c) for c in LIVE_FIELDS if c in has or c in filled])


def for_clients(df: DataFrame, clients: DataFrame, order: str, most: int = 2000) -> DataFrame:
    """client_id, order and dropped: each client's queue after a burst: the first `most` records past what it has seen are queued, later ones dropped.

    clients: rows of client_id and seen; they are a handful of open connections.
    """
    from skerry.operators import ordered

    waiting = df.join(F.broadcast(clients), F.col(order) > F.col("seen")).select("client_id", order)
    return ordered.numbered(waiting, ["client_id"], [order], "k").withColumn("dropped", F.col("k") >= most).drop("k")
