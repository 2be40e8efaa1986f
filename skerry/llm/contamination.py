"""Benchmark decontamination with suffix arrays over shards of the training text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm import textkit as tk
from skerry.llm.store import written
from skerry.llm.textkit import U

#: Words in a window.
WINDOW = 13
#: Bytes of benchmark text that a pass holds; a larger benchmark is taken in passes, one block of about half this size each.
BLOCK_BYTES = 8 << 20


def terminated(w: tk.Words) -> np.ndarray:
    """The words' hashes as positive numbers, text after text, with a 0 after each text: text r begins at w.rows[r] + r."""
    v = np.zeros(len(w.hash) + len(w.rows) - 1, np.int64)
    v[np.arange(len(w.hash)) + w.row_of()] = (w.hash >> U(1)).astype(np.int64) | 1
    return v


def suffix_array(v: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes of `v` (each ends at the next 0) in the order of their first `depth` values at least.

    Ranks of runs are built from ranks of runs a third (in long arrays half) as long, so a sort of whole numbers a step.
    """
    n = len(v)
    ends = np.flatnonzero(v == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) if n else ends
    rank, width = np.unique(v, return_inverse=True)[1].astype(np.int64), 1
    fold = 3 if n < 1 << 21 else 2
    while width < depth and n:
        key = rank
        for k in range(1, fold):
            step = k * width
            later = np.zeros(n, np.int64)
            later[: max(0, n - step)] = np.where(left[: max(0, n - step)] > step, rank[step:], 0)
            key = (key << (21 if fold == 3 else 31)) | later
        distinct, rank = np.unique(key, return_inverse=True)
        width *= fold
        if len(distinct) == n:
            break
    starts = np.flatnonzero(v)
    return starts[np.argsort(rank[starts], kind="stable")]


def _bound(v: np.ndarray, order: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray, want: np.ndarray, past: bool) -> np.ndarray:
    """Binary search, for all queries at once: where in order[low:high], which agrees before `depth`, the values at `depth` reach `want`."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        value = v[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, len(v) - 1)]
        go = open_ & ((value <= want) if past else (value < want))
        low, high = np.where(go, mid + 1, low), np.where(open_ & ~go, mid, high)
    return low


def descend(v: np.ndarray, order: np.ndarray, queries: np.ndarray, starts: np.ndarray, limits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the suffix of `queries` at each of `starts`: how many values some suffix of `v` begins with, and the range of `order` that does.

    The array is searched value by value, each time within the range that the values before left; limits: values wanted at most.
    """
    low, high, depth = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64), np.zeros(len(starts), np.int64)
    active, j = np.arange(len(starts)), 0
    while len(active) and len(order):
        if limits is not None:
            active = active[limits[active] > j]
        want = queries[starts[active] + j]
        active, want = active[want > 0], want[want > 0]
        a = _bound(v, order, j, low[active], high[active], want, False)
        b = _bound(v, order, j, a, high[active], want, True)
        some = b > a
        active = active[some]
        low[active], high[active], depth[active] = a[some], b[some], j + 1
        j += 1
    return depth, low, high


@dataclass
class Block:
    """Test suffixes of some benchmark items: their values, the distinct windows among them, and their own full suffix array."""

    items: list[str]
    v: np.ndarray
    begin: np.ndarray  # of each item in v
    order: np.ndarray
    starts: np.ndarray  # of one occurrence of each distinct window
    widths: np.ndarray  # words in each window
    holders: np.ndarray  # items with window k: holders[first[k]:first[k + 1]]
    first: np.ndarray


def block_of(rows: list[tuple], window: int = WINDOW) -> Block | None:
    """The test suffixes of (item_id, text) rows; items without an id, text or word have none."""
    rows = sorted({(str(i), t) for i, t in rows if i is not None and t is not None})
    w = tk.words(pa.array([t for _, t in rows], pa.large_string()), tk.NOT_WORD, tk.LOWER)
    if not len(w.hash):
        return None
    v = terminated(w)
    begin = w.rows[:-1] + np.arange(len(rows))
    order = suffix_array(v, int(w.counts.max()))
    item = np.searchsorted(begin, order, "right") - 1
    width = np.minimum(window, w.counts[item])
    whole = w.rows[item + 1] + item - order >= width  # the window ends within its item
    order_w, item, width = order[whole], item[whole], width[whole]
    same = np.zeros(len(order_w), bool)  # as the window before it in the array
    if len(order_w) > 1:
        same[1:] = width[1:] == width[:-1]
        for j in range(window):
            inside = width[1:] > j
            a, b = (v[np.minimum(x + j, len(v) - 1)] for x in (order_w[1:], order_w[:-1]))
            same[1:] &= ~inside | (a == b)
    # equal windows of unequal width classes can alternate in the array, so windows are numbered by content
    number, rank = np.cumsum(~same) - 1, np.lexsort((item, np.cumsum(~same)))
    keep = np.ones(len(rank), bool)
    keep[1:] = (number[rank][1:] != number[rank][:-1]) | (item[rank][1:] != item[rank][:-1])
    holders, owner = item[rank][keep], number[rank][keep]
    first = np.searchsorted(owner, np.arange(number[-1] + 2))
    heads = np.flatnonzero(~same)
    return Block([i for i, _ in rows], v, begin, order, order_w[heads], width[heads], holders, first)


@dataclass
class Hits:
    """Matches in one shard, by text: spans of words, items, and the longest verbatim run."""

    words: np.ndarray
    spans: list[list[tuple[int, int]]]
    items: list[list[str]]
    longest: list[tuple[int, int, str | None]]


def matches(texts: pa.Array, block: Block | None, window: int = WINDOW) -> Hits:
    """All test windows' matches: a suffix array of the texts is built, and every test window is searched in it.

    The longest match of a text is found the other way round: its suffixes where a window matches descend in the block's
    array as far as they go; ties go to the first place in the text.
    """
    w = tk.words(texts, tk.NOT_WORD, tk.LOWER)
    n = len(w.rows) - 1
    out = Hits(w.counts, [[] for _ in range(n)], [[] for _ in range(n)], [(0, 0, None)] * n)
    if block is None or not len(w.hash):
        return out
    v = terminated(w)
    order = suffix_array(v, window)
    depth, low, high = descend(v, order, block.v, block.starts, block.widths)
    hit = np.flatnonzero(depth == block.widths)
    if not len(hit):
        return out
    size = (high - low)[hit]
    at = order[np.repeat(low[hit] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
    begin = w.rows[:-1] + np.arange(n)
    row_of = lambda p: np.searchsorted(begin, p, "right") - 1
    inside = tk.covered(at, np.repeat(block.widths[hit], size), len(v))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        r = int(row_of(a))
        out.spans[r].append((int(a - begin[r]), int(b - begin[r])))
    held: dict[int, set[int]] = {}
    pairs = np.unique(row_of(at) * len(block.starts) + np.repeat(hit, size))
    for r, k in zip((pairs // len(block.starts)).tolist(), (pairs % len(block.starts)).tolist(), strict=True):
        held.setdefault(r, set()).update(block.holders[block.first[k] : block.first[k + 1]].tolist())
    for r, found in held.items():
        out.items[r] = sorted({block.items[i] for i in found})
    at = np.unique(at)
    depth, low, _ = descend(block.v, block.order, v, at)
    row = row_of(at)
    for k in np.lexsort((-at, depth)):  # the last of a row is its longest, and of those the first in the text
        place = block.order[low[k]]
        item = int(np.searchsorted(block.begin, place, "right") - 1)
        out.longest[row[k]] = (int(depth[k]), int(at[k] - begin[row[k]]), block.items[item])
    return out


_FOUND = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>,longest:bigint,longest_start:bigint,longest_item:string>"
_KIND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_start", pa.int64()), ("longest_item", pa.string())])


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Block]:
    """Test suffixes by block, made one at a time: about half of block_bytes of text each, by a hash of item and text, or one longer item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    bytes_ = F.octet_length("text") + F.octet_length("item_id") + 16
    long_ = bytes_ > block_bytes // 2
    total, longs = items.agg(F.sum(F.when(~long_, bytes_)), F.count_if(long_)).first()
    n = -(-2 * (total or 0) // block_bytes)
    key = F.xxhash64("item_id", "text")
    parts = [items.where(~long_ & (F.pmod(key, F.lit(n)) == k)) for k in range(n)]
    # a longer item is a block of its own: its key alone comes to the driver first
    parts += [items.where(long_ & (key == k)) for k in sorted({r[0] for r in items.where(long_).select(key).collect()})] if longs else []
    for part in parts:
        block = block_of([tuple(r) for r in part.collect()], window)
        if block is not None:
            yield block


def _with(got: dict | None, hits: Hits, k: int) -> dict:
    """A row's matches with those of one more block."""
    new = {"n_words": int(hits.words[k]), "spans": hits.spans[k], "items": hits.items[k], "longest": hits.longest[k][0], "longest_start": hits.longest[k][1], "longest_item": hits.longest[k][2]}
    if got:
        if got["longest"] >= new["longest"]:
            new |= {c: got[c] for c in ("longest", "longest_start", "longest_item")}
        new["spans"] = _merged(new["spans"] + [(s["start"], s["end"]) for s in got["spans"]])
        new["items"] = sorted({*new["items"], *got["items"]})
    new["spans"] = [{"start": a, "end": b} for a, b in new["spans"]]
    return new


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row's matches with the benchmark: struct columns `own` (all columns of docs) and `found`.

    `found` has n_words, spans (of words in windows that match, merged), items (ids as strings,
    sorted), and longest, longest_start, longest_item: the longest verbatim run. A shard is a few megabytes of whole texts in
    one task: its suffix array is built, searched by all test windows and dropped, so nothing is shuffled. A benchmark over
    block_bytes is taken in passes, each with one block and written before the next, so that no task ever
    holds two; each adds to the row's lists. A very long text is a shard of its own. A null or empty text has no words; an empty benchmark
    matches nothing; repeated rows, and rows that share a doc_id or have none, are rows of their own; clashing names can't
    meet, as docs' columns stay in `own`.
    """
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.lit(None).cast(_FOUND).alias("found"))
    schema = T.StructType([found.schema["own"], T.StructField("found", T._parse_datatype_string(_FOUND))])
    spark, held = docs.sparkSession, None

    def searching(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in tk.chunks(batches, "text"):
                hits = matches(batch.column(2), held and held.value, window)
                rows = [_with(got, hits, k) for k, got in enumerate(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _KIND)], ["own", "found"])

        return found.select("own", "found", F.col("own.text").cast("string").alias("text")).mapInArrow(run, schema)

    for block in _blocks(benchmark, window, block_bytes):
        if held:
            found = written(found, "matched")  # the pass with the block before
            held.destroy()
        held = spark.sparkContext.broadcast(block)
        found = searching(held)
    return found if held else searching(None)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def hit_words() -> Column:
    return F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))


def contaminated() -> Column:
    """True where at least a twentieth of the words, and one, lie in matching windows."""
    return (F.size("found.spans") > 0) & (20 * hit_words() >= F.col("found.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with docs' own columns, that are not contaminated."""
    return annotate(docs, benchmark, window).where(~contaminated()).select("own.*")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match."""
    found = annotate(docs.select("doc_id", "text"), benchmark, window)
    return found.select(
        "own.doc_id", "found.n_words", hit_words().alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
        F.col("found.longest").alias("longest_match"), F.col("found.longest_start").alias("longest_start"), F.col("found.longest_item").alias("longest_item"),
    )
