"""Words, windows and hashes of whole columns of text, in numpy over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text that one round of array work takes: some fifteen arrays of eight bytes a word live at a time.
CHUNK_BYTES = 4 << 20

_BYTES = np.arange(256)
#: Bytes that separate words, for the two word patterns in use.
SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
NOT_WORD = (_BYTES <= 0x2F) | ((_BYTES >= 0x3A) & (_BYTES <= 0x60)) | ((_BYTES >= 0x7B) & (_BYTES <= 0x7F))
#: A-Z to a-z, all else as it is.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
SAME = _BYTES.astype(np.uint8)

#: An odd multiplier for polynomial hashes modulo 2**64, and its inverse there.
_M = 0x9E3779B97F4A7C15 | 1
_M_INV = pow(_M, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: one bit's change in x changes half of the result's bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_POWERS = {"up": _powers(_M, 1 << 16), "down": _powers(_M_INV, 1 << 16)}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        _POWERS.update(up=_powers(_M, 2 * n), down=_powers(_M_INV, 2 * n))
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """The words of some texts, one after another: their hashes, byte spans, and where each text's begin."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)

    def left(self) -> np.ndarray:
        """How many words, itself included, each word has up to its text's end."""
        return np.repeat(self.rows[1:], self.counts) - np.arange(len(self.hash))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty), and the offsets of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(texts: pa.Array, separator: np.ndarray = SPACE, fold: np.ndarray = SAME) -> Words:
    """Words are runs of bytes after `fold` that `separator` doesn't mark; a word never spans two texts."""
    raw, offsets = buffers(texts)
    data = raw if fold is SAME else fold[raw]
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(none.astype(U), none, none, np.zeros(len(offsets), np.int64), raw)
    inside = ~separator[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True  # of a text
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(_hashes(data, start, end), start, end, np.searchsorted(start, offsets), raw)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of data[start:end] for each span; blocks of whole spans bound the memory."""
    out = np.empty(len(start), U)
    k = 0
    while k < len(start):
        stop = max(k + 1, int(np.searchsorted(end, start[k] + block, "right")))
        lo, hi = start[k], end[stop - 1]
        up, down = _power_table(int(hi - lo) + 1)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum((data[lo:hi].astype(U) + U(1)) * up[: hi - lo], out=total[1:])
        a, b = start[k:stop] - lo, end[k:stop] - lo
        out[k:stop] = (total[b] - total[a]) * down[a] + (b - a).astype(U)
        k = stop
    return mix(out)


def windows(h: np.ndarray, width: int, multiplier: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hash of each run of `width` values, texts' ends ignored; by doubling, log2(width) steps."""
    total, length, power, size = None, 0, h, 1
    while width:
        if width & 1:
            if total is None:
                total, length = power, size
            else:
                total = total[: max(0, len(power) - length)] * U(pow(multiplier, size, 1 << 64)) + power[length:][: max(0, len(total))]
                length += size
        width >>= 1
        if width:
            power = power[: max(0, len(power) - size)] * U(pow(multiplier, size, 1 << 64)) + power[size:]
            size *= 2
    return total


def covered(starts: np.ndarray, width, n: int) -> np.ndarray:
    """Which of n places lie in any [start, start + width)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:n]) > 0


def chunks(batches: Iterable[pa.RecordBatch], text: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches of about `size` bytes of text at most; a longer text comes alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < len(ends):
            used = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, used + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop
