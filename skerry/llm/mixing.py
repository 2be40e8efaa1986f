"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.native import counted_out, n_words
from skerry.llm.store import written

#: Weights of the sources in order, over and over; the mix's size as a share of all; the most a source is repeated.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Rows that one flight takes.
BLOCK_ROWS = 4096
#: A source's shortest units, left out of the last flight: with the two it leaves open they make the landing problem.
LANDING = 8
#: Units of a block, the longest, that are settled before its flight.
LONG = 16
_EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Move inclusion probabilities p, in place, until at most two lie strictly between 0 and 1.

    Each move is along a null vector of the two constraints, sum(p) and sum(p * size), of three units at a time,
    to one of the two ends of the allowed segment, at random so that the mean stays put (Deville and
    Tille 2004; the fast flight of Chauvet and Tille 2006).
    """
    window: list[int] = []
    for k in range(len(p)):
        if _EPS < p[k] < 1 - _EPS:
            window.append(k)
        if len(window) < 3:
            continue
        a, b, c = window
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])  # its sum, and its sum with the sizes, is 0
        if not any(u):
            u = (1.0, -1.0, 0.0)
        at = (p[a], p[b], p[c])
        up = min((1 - x) / v if v > 0 else x / -v for x, v in zip(at, u, strict=True) if v)
        down = min(x / v if v > 0 else (1 - x) / -v for x, v in zip(at, u, strict=True) if v)
        step = up if rng.random() * (up + down) < down else -down
        for k2, v in zip(window, u, strict=True):
            p[k2] = min(1.0, max(0.0, p[k2] + step * v))
        window = [j for j in window if _EPS < p[j] < 1 - _EPS]


def settle_long(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, n: int) -> None:
    """Move the first n units, in place, to 0 or 1 each, against all later open units together.

    A long unit hardly moves in a flight of three, and left to the landing it would cost the
    balance its whole size. The null vector here spreads the unit's rows and words over all later units.
    """
    for k in range(n):
        for _ in range(8):
            rest = np.flatnonzero((p > _EPS) & (p < 1 - _EPS) & (np.arange(len(p)) > k))
            if not _EPS < p[k] < 1 - _EPS or len(rest) < 16:
                break
            z = size[rest]
            system = np.array([[len(z), z.sum()], [z.sum(), (z * z).sum()]])
            if abs(np.linalg.det(system)) < 1e-6:
                break
            a, b = np.linalg.solve(system, [-1.0, -size[k]])
            u, at = np.concatenate([[1.0], a + b * z]), np.concatenate([[p[k]], p[rest]])
            some = np.abs(u) > 1e-15
            room, fall = np.where(u > 0, 1 - at, at)[some] / np.abs(u[some]), np.where(u > 0, at, 1 - at)[some] / np.abs(u[some])
            up, down = room.min(), fall.min()
            step = up if rng.random() * (up + down) < down else -down
            moved = np.clip(at + step * u, 0, 1)
            p[k], p[rest] = moved[0], moved[1:]


def land(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Settle what few probabilities are left: of all ways to round, one nearest the token total."""
    loose = [k for k in range(len(p)) if _EPS < p[k] < 1 - _EPS]
    want, count = sum(p[k] * size[k] for k in loose), sum(p[k] for k in loose)
    ways = sorted(range(1 << len(loose)), key=lambda w: (abs(sum(size[k] for j, k in enumerate(loose) if w >> j & 1) - want), abs(w.bit_count() - count), rng.random()))
    for j, k in enumerate(loose):
        p[k] = ways[0] >> j & 1


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """source, source_size and target from rows of (source, source_size), a row a source.

    Sources in code point order, null last, weigh `weights` over and over. `share` of all sizes is dealt by weight; a source stops at
    `repeats` times its size, and the excess goes to the others by weight. That has a closed form: a
    source stops if its cap per weight is below a water level, so one ordered pass over the sources finds the level.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - stopped) / open_weight
    levels = weighed.withColumn("level", level)
    # the first source, by cap per weight, whose cap its level doesn't pass settles it; levels after that one only fall
    water = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every)
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * water, F.col("cap")))
    return levels.select("source", "source_size", target.alias("target"))


def _balanced(rows: DataFrame) -> DataFrame:
    """A flight in each group of (source, block); a source's only block also lands."""

    def fly(key: tuple, table: pa.Table) -> pa.Table:
        last = table["blocks"][0].as_py() == 1
        order = np.lexsort([table["h"].to_numpy(), -table["size"].to_numpy()])  # the longest first: what stays open to the end is short
        p, size = table["p"].to_numpy()[order].copy(), table["size"].to_numpy()[order].astype(float)
        rng = np.random.default_rng(key[0].as_py() & 0xFFFFFFFFFFFFFFFF)
        stop = max(3, len(p) - LANDING) if last else len(p)
        settle_long(p, size, rng, min(LONG, stop, len(p)))
        flight(p[:stop], size[:stop], rng)
        if last:
            land(p, size, rng)
        out = np.empty(len(p))
        out[order] = np.where(p < _EPS, 0.0, np.where(p > 1 - _EPS, 1.0, p))
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(out))

    return rows.groupBy("g").applyInArrow(fly, rows.schema)


def _blocked(rows: DataFrame, blocks: Column, seed: int) -> DataFrame:
    return rows.withColumn("blocks", blocks).withColumn("g", F.xxhash64(F.lit(seed), "source", F.col("source").isNull(), "blocks", F.pmod(F.xxhash64("h", "blocks"), F.col("blocks"))))


def _row_hash(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits of hash of a whole row: h and k, never null."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(1), *columns).alias("k")


def choose(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, block_rows: int = BLOCK_ROWS, seed: int = 1) -> DataFrame:
    """Units (rows alike in every column) with doc_id, h, k (hashes), source, size, m, source_size, target and total.

    m rows are alike; together they are taken `total` times. A row is taken floor(target / source_size) times, and once
    more if it is in a balanced sample drawn with the remaining probability: the sample's rows and
    words both come near their expected totals. Flights run in blocks of about block_rows units of a source; the two that
    a block may leave open go on to blocks of the next level, until a source has one block, which
    lands. So no task sees more than a block or two, however large a source, and each level has a two-thousandth of the
    last one's units. Null text has size 0; null is a source; a source without words takes none. Reruns agree: draws are seeded
    by a hash of source and block, and units are ordered by a hash of their content.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), *_row_hash(docs))
    units = written(rows.groupBy("doc_id", "source", "size", "h", "k").agg(F.count("*").alias("m")), "units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"))
    aims = written(targets(sources.select("source", "source_size"), weights, share, repeats).join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    expected = units.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("due", rate * F.col("m"))
    started = expected.withColumn("base", F.floor(F.col("due") + F.lit(_EPS)).cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("due") - F.col("base")))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block_rows))).cast("long")
    level = _blocked(started, blocks, seed)
    n = aims.agg(F.max("n")).first()[0] or 0
    open_, done = level, None
    while True:
        flown = written(_balanced(open_), "flight")
        settled = flown.where("p <= 0 or p >= 1")
        done = settled if done is None else done.unionByName(settled)
        if n <= block_rows:
            break
        n = 2 * -(-n // block_rows)
        fewer = F.greatest(F.lit(1), F.ceil(2 * F.col("blocks") / F.lit(block_rows))).cast("long")
        open_ = _blocked(flown.where("p > 0 and p < 1"), fewer, seed)
    return done.select("doc_id", "h", "k", "source", "size", "m", "source_size", "target", (F.col("base") + F.col("p").cast("long")).alias("total"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row; rows alike share their unit's copies evenly."""
    each = counted_out(choose(docs), "m", "at")
    copies = F.floor(F.col("total") / F.col("m")) + F.when(F.col("at") < F.col("total") % F.col("m"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs' rows, with docs' own columns, each as many times as the mix takes it.

    Rows alike meet in the map-side aggregate; the one shuffle of texts, by the rows' hashes, serves the join with the units too.
    Copies of one row are counted out by one task, one at a time.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), *_row_hash(docs))
    units = choose(docs, **options).where("total > 0").select("h", "k", "total")
    found = keyed.groupBy("h", "k").agg(F.first("own").alias("own")).join(units.hint("merge"), ["h", "k"])
    return counted_out(found, "total", "at").select("own.*")
