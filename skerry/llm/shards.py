"""Sharding by jump consistent hashing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.native import LOW32, bits, counted_out

#: The multiplier of the linear congruential generator in the published
#: algorithm (Lamping and Veach, 2014), as two 32-bit halves.
LCG = 2862933555777941757
LCG_HIGH, LCG_LOW = LCG >> 32, LCG & LOW32
#: Rows that one slot-numbering task sorts.
BIN_ROWS = 50_000


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next state, key * LCG + 1 modulo 2**64, on 32-bit halves: no product passes 2**63."""
    p1 = F.shiftright(low, 16) * F.lit(LCG_LOW)
    p0 = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(LCG_LOW)
    t = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    cross = F.shiftleft((F.shiftright(high, 16) * F.lit(LCG_LOW)).bitwiseAND(F.lit(0xFFFF)), 16) + high.bitwiseAND(F.lit(0xFFFF)) * F.lit(LCG_LOW)
    top = F.shiftright(t, 32) + F.shiftright(p1, 16) + (low * F.lit(LCG_HIGH)).bitwiseAND(F.lit(LOW32)) + cross.bitwiseAND(F.lit(LOW32))
    return top.bitwiseAND(F.lit(LOW32)), t.bitwiseAND(F.lit(LOW32))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a key of any type that casts to text.

    Each round draws where the key would jump next as shards are appended; the last place before
    `shards` is its shard. A key takes some ln(shards) rounds. All keys take a first run of rounds that nearly every key ends in; only those
    that don't go on, at most `shards` rounds in all, as a jump always goes up. No ring table is kept, and
    going from n to n + 1 shards moves about one key in n + 1, all of them into the new shard.
    """

    def jump(state: Column, _: Column) -> Column:
        high, low = _step(state["high"], state["low"])
        at = F.floor((state["next"] + 1).cast("double") * F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))
        on = state["next"] < F.lit(shards)
        return F.when(on, F.struct(state["next"].alias("at"), at.alias("next"), high.alias("high"), low.alias("low"))).otherwise(state)

    zero = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"), bits(key, 0).alias("high"), bits(key, 1).alias("low"))
    few = min(shards, int(math.log(shards + 1) + 4 * math.sqrt(math.log(shards + 1))) + 2)
    # the rest of the rounds is an empty sequence for a key that is there already
    rest = lambda s: F.when(s["next"] < F.lit(shards), F.sequence(F.lit(few + 1), F.lit(shards))).otherwise(F.array().cast("array<int>"))
    started = F.aggregate(F.sequence(F.lit(0), F.lit(few)), zero, jump)
    if few == shards:
        return started["at"].cast("int")
    # one-element transform: names the state, so that it is computed once
    return F.element_at(F.transform(F.array(started), lambda s: F.aggregate(rest(s), s, jump, lambda e: e["at"].cast("int"))), 1)


def assign(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", bin_rows: int = BIN_ROWS) -> DataFrame:
    """The shard of every row, its slot in the shard, and its shard once one more is appended.

    Columns: `key`, size (UTF-8 bytes of the text and 1; a null text counts as none), text_crc32 (null for a null
    text), law, shard, slot, grown_shard. Rows with one key share a shard; a null key is a key of its
    own. Slots are gapless from 0 in each shard. They are numbered by bins of the key's hash: each bin is sorted by one
    task, and only the bins' counts are summed across a shard, so a shard may be of any size. Rows that repeat are counted before they
    are shuffled, and get a slot each from their count, so they may be of any number. More input columns, whatever their names, are left aside; an empty table gives an empty one.
    """
    bins = max(1, -(-docs.count() // (shards * bin_rows)))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
    ).select(
        "*",
        F.lit("key").alias("law"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
        # doc_id alone may repeat without bound, so the text's checksum takes part in the bin
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(bins)).alias("bin"),
    )
    alike = rows.groupBy(*rows.columns).agg(F.count("*").alias("m"))
    counts = rows.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = alike.withColumn("at", F.coalesce(F.sum("m").over(within), F.lit(0)))
    each = counted_out(ranked.join(starts, ["shard", "bin"]), "m", "copy")
    return each.select(
        F.col("doc_id").alias(key), "size", "text_crc32", "law", "shard", (F.col("start") + F.col("at") + F.col("copy")).alias("slot"), "grown_shard"
    )


def shard_column(docs: DataFrame, shards: int = 16, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with the shard of each row as one more column; where docs has a column of that name it stays, and the new one gets underscores.

    Rows without a key share a shard, repeated rows stay as they are, and an empty table gives an empty one; texts aren't read.
    """
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return docs.withColumn(name, jump_shard(F.col(key), shards))


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """Write docs as Parquet under path/shard=N/."""
    marked = shard_column(docs, shards, key)
    marked.write.partitionBy(marked.columns[-1]).parquet(path)
