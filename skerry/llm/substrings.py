"""Substring dedup with fixed-block anchors."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skerry.llm import repeats
from skerry.llm import textkit as tk

WIDTH = 35


def block_words(width: int) -> int:
    """The longest block of which every window of `width` words holds a whole one, wherever the blocks begin."""
    return (width + 1) // 2


def _anchors(block: int) -> repeats.Anchors:
    """Every rolling window of `block` words is a probe; flagged are those that are a text's reference blocks."""

    def find(w: tk.Words) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        rolled = tk.mix(tk.windows(w.hash, block))
        at = np.flatnonzero(w.left()[: len(rolled)] >= block)
        offset = at - np.repeat(w.rows[:-1], w.counts)[at]
        h = rolled[at]
        # 46 bits of hash: a false meeting only costs work, as windows are compared later
        return [(h >> tk.U(32)).astype(np.uint32), (h & tk.U(0xFFFC0000)).astype(np.uint32)], at, (offset % block == 0).astype(np.uint8)

    return find


def _text_rows(table: pa.Table, w: tk.Words) -> list[bytes]:
    _, offsets = tk.buffers(table["text"])
    return [w.data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _cover(with_text: bool) -> repeats.Cover:
    def cover(table: pa.Table, w: tk.Words, inside: np.ndarray) -> pa.Table:
        removed = np.concatenate([[0], np.cumsum(inside)])
        n_removed = removed[w.rows[1:]] - removed[w.rows[:-1]]
        kept = []
        for k, text in enumerate(_text_rows(table, w)):
            found = text.split()
            if n_removed[k]:
                found = compress(found, (~inside[w.rows[k] : w.rows[k + 1]]).tolist())
            kept.append(b" ".join(found))
        last = pa.array(kept, pa.binary()).cast(pa.string()) if with_text else pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())
        return pa.table([table["doc_id"].combine_chunks() if isinstance(table["doc_id"], pa.ChunkedArray) else table["doc_id"], pa.array(w.counts, pa.int64()), pa.array(n_removed, pa.int64()), last], names=["doc_id", "n_words", "n_removed", "text" if with_text else "kept_sha256"])

    return cover


def removed(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and what is kept of each row: as `text`, or its digest as kept_sha256.

    Words in any window of `width` words whose sequence also starts elsewhere, in this text or another, are removed, all
    occurrences alike; windows are judged on the input. Non-overlapping blocks of each text are the index, every rolling window
    is a probe, and a hit is extended to all windows around it, whose repeated ones join to maximal exact repeats. Kept words
    are joined by one space. Null and empty texts have no words; shorter texts than a window keep all; repeated rows are rows of their own
    (and so remove one another, if long enough); more columns of docs are left aside; an empty table gives an empty one.
    """
    block = block_words(width)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text" if with_text else "kept_sha256", T.StringType())])
    return repeats.find(docs, width, _anchors(block), 2, 2, width - block, True, _cover(with_text), schema)


def report(docs: DataFrame) -> DataFrame:
    return removed(docs, with_text=False)
