"""Long verbatim repeats: what the two substring operators share.

Whole texts are dealt to chunks of some megabytes by a hash of doc_id and text, once, a chunk a task. What chunks tell one another goes
through buckets, a bucket a task, as packed arrays of hashes:

1. `anchors`  - each chunk sends the keys of its anchors, each distinct key once, to the key's bucket;
2. `met`      - a bucket sorts the keys of all chunks and answers which occur at two places;
3. `extend`   - a chunk sends what stands around its met anchors, once each;
4. `judge`    - a bucket answers which windows occur at two places;
5. `finish`   - a chunk takes the union of its repeated windows.

A passage that a third of all texts share is one key a chunk, so no bucket or task gathers a hot group,
and no pair of places is ever formed. Buckets and chunks are as many as the input's size asks for. Only rows that are alike in both
doc_id and text can't be told apart, and share a chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm import textkit as tk
from skerry.llm.textkit import U

#: Bytes of text in a chunk, and words whose keys a bucket gets.
CHUNK_BYTES, BUCKET_WORDS = 6 << 20, 3 << 20
_SEND = "bucket int, chunk int, n long, keys binary"
_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("n", pa.int64()), ("keys", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("keys", pa.binary())])

#: Keys that more chunks hold than this, or that one chunk holds more often than this, are hot: what stands around them is not gathered.
HOT_CHUNKS, HOT_PLACES = 64, 256

#: Finds anchors: words -> (keys as rows of uint32 columns, most significant first; positions; flags).
Anchors = Callable[[tk.Words], tuple[list[np.ndarray], np.ndarray, np.ndarray]]


def _packed(columns: list[np.ndarray]) -> bytes:
    """Rows as planes of 16 bits: a sorted column's upper plane is long runs, which Spark's codec removes."""
    return b"".join(p.astype(np.uint16).tobytes() for c in columns for p in (c >> np.uint32(16), c & np.uint32(0xFFFF)))


def _unpacked(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(data, np.uint16).reshape(2 * columns, n).astype(np.uint32)
    return [(planes[2 * k] << np.uint32(16)) | planes[2 * k + 1] for k in range(columns)]


def _split(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> U(32)).astype(np.uint32), (h & U(0xFFFFFFFF)).astype(np.uint32)]


def _groups(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sort order of rows, and where runs of equal rows begin in it."""
    if len(columns) == 1:
        order = np.argsort(columns[0], kind="stable")
    elif len(columns) == 2:
        order = np.argsort((columns[0].astype(U) << U(32)) | columns[1], kind="stable")
    else:
        first = (columns[0].astype(U) << U(32)) | columns[1]
        order = np.lexsort([*columns[:1:-1], first])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _dealt(columns: list[np.ndarray], buckets: int) -> list[tuple[int, int, int]]:
    """bucket, begin and end of each run of sorted rows that belong to one bucket."""
    bucket = (columns[0].astype(U) * U(buckets) >> U(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(bucket)][: len(cuts)], strict=True)]


def _sent(chunk: int, columns: list[np.ndarray], flags: np.ndarray, buckets: int) -> pa.Table:
    """A row for each bucket with the distinct keys that belong there; the lowest two bits of a key's last column carry flags."""
    order, begin = _groups(columns)
    if not len(order):
        return _SENT.empty_table()
    flag = np.bitwise_or.reduceat(flags[order], begin)
    keys = [c[order[begin]] for c in columns]
    keys[-1] = (keys[-1] & ~np.uint32(3)) | flag.astype(np.uint32)
    rows = [(bucket, chunk, b - a, _packed([c[a:b] for c in keys])) for bucket, a, b in _dealt(keys, buckets)]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SENT.types, strict=True)], schema=_SENT)


def _twice(columns: int, need: int, hot: bool = False) -> Callable[[tuple, pa.Table], pa.Table]:
    """A bucket's answers: for each chunk, its keys that occur at two places and have all flags of `need` set somewhere.

    Flag 1: at two places in the chunk that sent it; flag 2: as the operator says. hot: flag 2 says that a chunk holds the key too
    often, and answers have flag 1 where the key is hot.
    """

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        chunks, ns = table["chunk"].to_numpy(), table["n"].to_numpy()
        parts = [_unpacked(d.as_py(), n, columns) for d, n in zip(table["keys"], ns, strict=True)]
        whole = [np.concatenate([p[k] for p in parts]) for k in range(columns)]
        flags = (whole[-1] & np.uint32(3)).astype(np.uint8)
        whole[-1] &= ~np.uint32(3)
        order, begin = _groups(whole)
        size = np.diff(begin, append=len(order))
        any_of = np.bitwise_or.reduceat(flags[order], begin)
        hit = ((size > 1) | (any_of & 1 > 0)) & (any_of & need == need)
        met = np.zeros(len(order), bool)
        met[order] = np.repeat(hit, size)
        if hot:
            whole[-1][order] |= np.repeat((size > HOT_CHUNKS) | (any_of & 2 > 0), size).astype(np.uint32)
        at, out = 0, []
        for chunk, n in zip(chunks, ns, strict=True):
            found = met[at : at + n]
            if found.any():
                out.append((chunk, _packed([c[at : at + n][found] for c in whole])))
            at += n
        return pa.Table.from_arrays([pa.array([c for c, _ in out], pa.int32()), pa.array([k for _, k in out], pa.binary())], schema=_ANSWER)

    return answer


def _answers(table: pa.Table, columns: int) -> list[np.ndarray]:
    parts = [_unpacked(d.as_py(), len(d.as_py()) // (4 * columns), columns) for d in table["keys"]]
    return [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.uint32) for k in range(columns)]


def _among(columns: list[np.ndarray], found: list[np.ndarray]) -> np.ndarray:
    """Which rows of columns are among rows `found`; the last column's flag bits don't count."""
    out = np.zeros(len(columns[0]), bool)
    if not len(found[0]) or not len(out):
        return out
    seen = np.zeros(1 << 20, bool)
    seen[found[0] >> np.uint32(12)] = True
    maybe = np.flatnonzero(seen[columns[0] >> np.uint32(12)])
    last = columns[-1][maybe] & ~np.uint32(3)
    rows = [*(c[maybe] for c in columns[:-1]), last]
    joined = [np.concatenate([a, b]) for a, b in zip(found, rows, strict=True)]
    order, begin = _groups(joined)
    size = np.diff(begin, append=len(order))
    known = np.zeros(len(order), np.uint8)
    known[: len(found[0])] = 1
    hit = np.maximum.reduceat(known[order], begin) > 0
    met = np.zeros(len(order), bool)
    met[order] = np.repeat(hit, size)
    out[maybe[met[len(found[0]) :]]] = True
    return out


def _window_keys(w: tk.Words, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """94-bit hashes of all windows of `width` words, and which lie in one text."""
    left = w.left()
    a = tk.mix(tk.windows(w.hash, width))
    b = tk.mix(tk.windows(w.hash ^ U(0x5851F42D4C957F2D), width, 0x2545F4914F6CDD1D))
    return [*_split(a), (b & U(0xFFFFFFFF)).astype(np.uint32)], left[: len(a)] >= width


def _near(positions: np.ndarray, reach: int, n: int) -> np.ndarray:
    """Which of n starts have one of the positions at most `reach` after them."""
    mark = np.zeros(n + reach + 1, np.int32)
    mark[positions] = 1
    total = np.concatenate([[0], np.cumsum(mark)])
    return total[reach + 1 : n + reach + 1] - total[:n] > 0


#: Step 3 to 5 as functions of (key, tables), made for a number of buckets, and the columns of the tables that steps 3 and 4 send.
Steps = Callable[[int], tuple[Callable, Callable, Callable, str, str]]


def exchange(docs: DataFrame, anchors: Anchors, columns: int, need: int, hot: bool, steps: Steps, schema: T.StructType) -> DataFrame:
    """What `finish` makes of each chunk's rows (doc_id, text) and the answers it got.

    `anchors` must give every repeated window an anchor near its start, with equal keys of `columns` columns wherever the window occurs.
    """
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(1, -(-size // CHUNK_BYTES)), max(1, size // (5 * BUCKET_WORDS))
    extend, judge, finish, send_ddl, answer_ddl = steps(buckets)
    # ids are small numbers, so each chunk and each bucket is a partition of its own
    place = lambda df, n, c: df.repartitionById(n, F.col(c).cast("int"))
    dealt = place(given.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")), chunks, "chunk")

    def send(key: tuple, table: pa.Table) -> pa.Table:
        keys, positions, flags = anchors(tk.words(table["text"]))
        order, begin = _groups(keys)  # flag 1: at two places here
        size = np.diff(begin, append=len(order))
        twice = np.zeros(len(order), np.uint8)
        if len(order):
            twice[order] = np.repeat(size > 1, size)
            if hot:
                flags[order] = np.repeat(size > HOT_PLACES, size)
        return _sent(key[0].as_py(), keys, flags * 2 + twice, buckets)

    by_chunk = dealt.groupBy("chunk")
    met = place(by_chunk.applyInArrow(send, _SEND), buckets, "bucket").groupBy("bucket").applyInArrow(_twice(columns, need, hot), "chunk int, keys binary")
    sent = by_chunk.cogroup(place(met, chunks, "chunk").groupBy("chunk")).applyInArrow(extend, send_ddl)
    repeated = place(sent, buckets, "bucket").groupBy("bucket").applyInArrow(judge, answer_ddl)
    return by_chunk.cogroup(place(repeated, chunks, "chunk").groupBy("chunk")).applyInArrow(finish, schema)


def around(w: tk.Words, met: np.ndarray, width: int, reach: int, within: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the windows that start at most `reach` words before one of the met positions, and flag 1 where they stand at two places here."""
    near, whole = _window_keys(w, width)
    starts = np.flatnonzero(whole & _near(met, reach, len(whole)))
    keys = [k[starts] for k in near]
    masked = [*keys[:-1], keys[-1] & ~np.uint32(3)]
    order, begin = _groups(masked)
    flags = np.zeros(len(order), np.uint8)
    if len(order):
        if within:
            twice = np.diff(begin, append=len(order)) > 1
        else:
            row = w.row_of()[starts][order]
            twice = np.maximum.reduceat(row, begin) > np.minimum.reduceat(row, begin)
        flags[order] = np.repeat(twice, np.diff(begin, append=len(order)))
    return masked, flags


def starts_of(w: tk.Words, found: list[np.ndarray], width: int) -> np.ndarray:
    """Where the windows begin whose keys are among `found`."""
    keys, whole = _window_keys(w, width)
    return np.flatnonzero(_among(keys, found) & whole)


Cover = Callable[[pa.Table, tk.Words, np.ndarray], pa.Table]


def find(docs: DataFrame, width: int, anchors: Anchors, columns: int, need: int, reach: int, within: bool, cover: Cover, schema: T.StructType) -> DataFrame:
    """cover() of each chunk's rows (doc_id, text), its words, and which words lie in a repeated window of `width` words.

    An anchor of a repeated window must start at most `reach` words after the window. Hits are extended to all windows around them, which
    are compared by hash. within: a window that repeats in one text only counts too.
    """

    def steps(buckets: int) -> tuple:
        def extend(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows or not left.num_rows:
                return _SENT.empty_table()
            w = tk.words(left["text"])
            keys, positions, _ = anchors(w)
            return _sent(key[0].as_py(), *around(w, positions[_among(keys, _answers(right, columns))], width, reach, within), buckets)

        def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            w = tk.words(left["text"])
            inside = np.zeros(len(w.hash), bool)
            if right.num_rows and left.num_rows and len(w.hash) >= width:
                inside = tk.covered(starts_of(w, _answers(right, 3), width), width, len(w.hash))
            return cover(left, w, inside)

        return extend, _twice(3, 0), finish, _SEND, "chunk int, keys binary"

    return exchange(docs, anchors, columns, need, False, steps, schema)
