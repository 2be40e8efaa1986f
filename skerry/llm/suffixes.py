"""Suffix-array dedup: a sparse suffix array over minimiser positions of all texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skerry.llm import repeats
from skerry.llm import textkit as tk
from skerry.llm.textkit import U

#: Words of the shortest repeat, of a minimiser, and of a retained suffix's key.
WIDTH, GRAM, DEPTH = 50, 8, 32


def minimisers(w: tk.Words, gram: int, span: int) -> np.ndarray:
    """Positions whose gram has the least hash of some `span` neighbouring grams in its text.

    The choice depends on content alone: equal passages of gram + span - 1 words choose alike.
    """
    h = tk.mix(tk.windows(w.hash, gram))
    fits = w.left()[: len(h)] >= gram
    h = np.where(fits, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    n = len(h) - span + 1
    if n <= 0:
        return np.flatnonzero(fits)
    ok = w.left()[:n] >= gram + span - 1
    low, size = h, 1  # low[i] is the least of h[i:i + size]
    while 2 * size <= span:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    least = np.minimum(low[:n], low[span - size : span - size + n])
    chosen = np.zeros(len(h), bool)
    for k in range(span):
        chosen[k : k + n] |= ok & (h[k : k + n] == least)
    return np.flatnonzero(chosen & fits)


def _anchors(width: int, gram: int, depth: int) -> repeats.Anchors:
    """Suffixes at minimisers, each keyed by its next `depth` words, `gram` at a time.

    A minimiser's own hash is the least of many, so it is mixed anew: buckets take keys by their first column, and are filled evenly.
    """

    def find(w: tk.Words) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        at = minimisers(w, gram, width - depth + 1)
        at = at[w.left()[at] >= depth] if len(at) else at
        rolled = tk.mix(tk.mix(tk.windows(w.hash, gram)) ^ U(0x94D049BB133111EB))
        keys = [(rolled[at + k] >> U(32)).astype(np.uint32) for k in range(0, depth, gram)]
        keys[-1] = keys[-1] & ~np.uint32(3)
        return keys, at, np.zeros(len(at), np.uint8)

    return find


def contexts(w: tk.Words, at: np.ndarray, depth: int, reach: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The `reach` words before each suffix's start, nearest first, and those after its `depth` words: 32 bits of hash each, 0 past a text's end."""
    word = np.maximum(w.hash >> U(32), U(1)).astype(np.uint32)
    after = w.left()[at] - depth
    before = at - np.repeat(w.rows[:-1], w.counts)[at]
    last = len(word) - 1
    left = [np.where(before > k, word[np.maximum(at - 1 - k, 0)], 0).astype(np.uint32) for k in range(reach)]
    right = [np.where(after > k, word[np.minimum(at + depth + k, last)], 0).astype(np.uint32) for k in range(reach)]
    return left, right


def _names(columns: list[np.ndarray]) -> np.ndarray:
    """64 bits of hash of each row: a name that doesn't depend on the order in which a chunk's texts arrive."""
    total = np.zeros(len(columns[0]), U)
    for c in columns:
        total = tk.mix(total * U(0x9E3779B97F4A7C15) + c + U(1))
    return total


def _order(keys: list[np.ndarray], words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by key and words, and of each how many of the words it has in common with the one before (-1 with another key)."""
    order = np.lexsort([*words[::-1], *keys[::-1]])
    common = np.zeros(len(order), np.int64)
    going = np.ones(len(order), bool)
    going[:1] = False
    for c in keys:
        going[1:] &= c[order][1:] == c[order][:-1]
    common[~going] = -1
    for c in words:
        s = c[order]
        going[1:] &= (s[1:] == s[:-1]) & (s[1:] > 0)
        common += going
    return order, common


def repeated_windows(keys: list[np.ndarray], left: list[np.ndarray], right: list[np.ndarray], text: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each suffix a mask: bit j is set if the window that begins j words before it also stands in another text.

    The suffixes are sorted, and so are the words before them, read backwards; in both orders each is compared with its neighbour. A window of j words
    to the left and the rest to the right stands wherever the first order's neighbours share the rest and the second's share
    the j, so its places are the rows of one run in both: a match grows to either side as far as neighbours agree, and no pair is formed.
    text: where each row stands; many: rows that stand for several texts.
    """
    n, reach = len(text), len(right)
    mask = np.zeros(n, np.uint32)
    if not n:
        return mask
    (forth, common_r), (back, common_l) = _order(keys, right), _order(keys, left)
    size_r, size_l = (np.sum([c > 0 for c in side], axis=0) for side in (right, left))
    for j in range(reach + 1):
        run_r, run_l = np.empty(n, np.int64), np.empty(n, np.int64)
        run_r[forth], run_l[back] = np.cumsum(common_r < reach - j), np.cumsum(common_l < j)
        whole = np.flatnonzero((size_l >= j) & (size_r >= reach - j))
        place = run_l[whole] * (n + 1) + run_r[whole]
        order = np.argsort(place, kind="stable")
        begin = np.flatnonzero(np.diff(place[order], prepend=-1))
        if not len(begin):
            continue
        rows = whole[order]
        hit = (np.maximum.reduceat(text[rows], begin) > np.minimum.reduceat(text[rows], begin)) | np.logical_or.reduceat(many[rows], begin)
        mask[rows[np.repeat(hit, np.diff(begin, append=len(rows)))]] |= np.uint32(1 << j)
    return mask


_SEND = "bucket int, chunk int, kind int, n long, keys binary"
_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("keys", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary())])
#: What a message is about: suffixes with the words around them, or windows of hot passages.
_SUFFIXES, _WINDOWS = 0, 1


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)


def _steps(width: int, gram: int, depth: int, within: bool) -> repeats.Steps:
    """Matches grow in buckets, from sorted suffixes and the words around them.

    A suffix that stands in so many chunks, or so often in one, that its bucket would gather a crowd is hot: windows around it are hashed and sent
    each to a bucket of its own instead, which finds the same.
    """
    anchors, reach, columns = _anchors(width, gram, depth), width - depth, depth // gram

    def steps(buckets: int) -> tuple:
        def extend(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows or not left.num_rows:
                return _SENT.empty_table()
            chunk, w = key[0].as_py(), tk.words(left["text"])
            keys, at, _ = anchors(w)
            found = repeats._answers(right, columns)
            is_hot = (found[-1] & np.uint32(1)) > 0
            cold, hot = (repeats._among(keys, [*(c[some] for c in found[:-1]), found[-1][some] & ~np.uint32(3)]) for some in (~is_hot, is_hot))
            around_l, around_r = contexts(w, at, depth, reach)
            name, place = _names([*keys, *around_l, *around_r]), np.arange(len(at)) if within else w.row_of()[at]
            mine = np.flatnonzero(cold)
            mine = mine[np.argsort(name[mine], kind="stable")]
            begin = np.flatnonzero(np.append(True, name[mine][1:] != name[mine][:-1])[: len(mine)])
            if len(mine):
                many = np.maximum.reduceat(place[mine], begin) > np.minimum.reduceat(place[mine], begin)
                heads = mine[begin]
                order = np.lexsort([k[heads] for k in keys[::-1]])
                heads, many = heads[order], many[order]
            else:
                heads, many = mine, np.empty(0, bool)
            sent = [c[heads] for c in keys]
            sent[-1] = sent[-1] | many.astype(np.uint32)
            sent += [c[heads] for c in (*around_l, *around_r)] + [place[heads].astype(np.uint32), *repeats._split(name[heads])]
            rows = [(bucket, chunk, _SUFFIXES, b - a, repeats._packed([c[a:b] for c in sent])) for bucket, a, b in repeats._dealt(sent, buckets)]
            if hot.any():
                windows = repeats._sent(chunk, *repeats.around(w, at[hot], width, reach, within), buckets)
                rows += [(r["bucket"], chunk, _WINDOWS, r["n"], r["keys"]) for r in windows.to_pylist()]
            return _table(rows, _SENT)

        def judge(key: tuple, table: pa.Table) -> pa.Table:
            kind, out = table["kind"].to_numpy(), []
            windows = table.filter(pa.array(kind == _WINDOWS))
            if windows.num_rows:
                out += [(r["chunk"], _WINDOWS, r["keys"]) for r in repeats._twice(3, 0)(key, windows).to_pylist()]
            mine = table.filter(pa.array(kind == _SUFFIXES))
            chunks, ns = mine["chunk"].to_numpy(), mine["n"].to_numpy()
            width_ = columns + 2 * reach + 3
            parts = [repeats._unpacked(d.as_py(), n, width_) for d, n in zip(mine["keys"], ns, strict=True)]
            if parts:
                whole = [np.concatenate([p[k] for p in parts]) for k in range(width_)]
                many = (whole[columns - 1] & np.uint32(1)) > 0
                keys = [*whole[: columns - 1], whole[columns - 1] & ~np.uint32(3)]
                text = (np.repeat(chunks, ns).astype(np.int64) << 32) | whole[-3]
                mask = repeated_windows(keys, whole[columns : columns + reach], whole[columns + reach : -3], text, many)
                ends = np.cumsum(ns)
                for chunk, a, b in zip(chunks.tolist(), (ends - ns).tolist(), ends.tolist(), strict=True):
                    hit = np.flatnonzero(mask[a:b]) + a
                    if len(hit):
                        out.append((chunk, _SUFFIXES, repeats._packed([whole[-2][hit], whole[-1][hit], mask[hit]])))
            return _table(out, _ANSWER)

        def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            w = tk.words(left["text"])
            inside = np.zeros(len(w.hash), bool)
            if right.num_rows and left.num_rows and len(w.hash) >= width:
                kind = right["kind"].to_numpy()
                keys, at, _ = anchors(w)
                around_l, around_r = contexts(w, at, depth, reach)
                name = _names([*keys, *around_l, *around_r])
                high, low, masks = repeats._answers(right.filter(pa.array(kind == _SUFFIXES)), 3)
                told = (high.astype(U) << U(32)) | low
                order = np.argsort(told)
                told, masks = np.append(told[order], U(0)), np.append(masks[order], np.uint32(0))
                slot = np.minimum(np.searchsorted(told[:-1], name), len(told) - 1)
                mask = np.where(told[slot] == name, masks[slot], np.uint32(0))
                starts = [at[(mask >> np.uint32(j)) & np.uint32(1) > 0] - j for j in range(reach + 1)]
                windows = right.filter(pa.array(kind == _WINDOWS))
                if windows.num_rows:
                    starts.append(repeats.starts_of(w, repeats._answers(windows, 3), width))
                inside = tk.covered(np.concatenate(starts), width, len(w.hash))
            return _cover(left, w, inside)

        return extend, judge, finish, _SEND, "chunk int, kind int, keys binary"

    return steps


def _cover(table: pa.Table, w: tk.Words, inside: np.ndarray) -> pa.Table:
    """Runs of words inside, by text."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    row = w.row_of()
    change = np.zeros(len(inside) + 1, bool)
    change[w.rows[:-1][w.counts > 0]] = True
    start = np.flatnonzero(((edge[:-1] == 1) | change[:-1]) & inside)
    ends = np.flatnonzero(inside & np.append(~inside[1:] | change[1:-1], True)) + 1 if len(inside) else start
    r = row[start] if len(start) else np.empty(0, np.int64)
    begin = w.rows[r] if len(r) else r
    ids = table["doc_id"].take(pa.array(r, pa.int64()))
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return pa.table([ids, pa.array(start - begin, pa.int64()), pa.array(ends - begin, pa.int64()), pa.array(w.counts[r] if len(r) else r, pa.int64())], names=["doc_id", "start", "end", "n_words"])


def spans(docs: DataFrame, width: int = WIDTH, within: bool = False) -> DataFrame:
    """doc_id, start, end and n_words: maximal runs of words that lie in repeated windows of `width` words.

    A window counts if its sequence also stands in another text (within: or elsewhere in its own). Positions count words, end
    exclusive. Suffixes are retained at minimisers only, some in ten words. They are sorted and compared with their neighbours; those that
    share DEPTH words with another are met, and matches grow left and right as far as sorted neighbours agree. Texts without a repeat have no
    row; so have null, empty and shorter texts. Repeated rows, and rows that share a doc_id or have none, are texts of their own, however
    long. More columns of docs are left aside; an empty table gives an empty one.
    """
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("start", "end", "n_words"))])
    return repeats.exchange(docs, _anchors(width, GRAM, DEPTH), DEPTH // GRAM, 0, True, _steps(width, GRAM, DEPTH, within), schema)
