"""Words of Arrow text columns as numpy arrays: spans, 64-bit hashes, n-gram hashes.

A word is a maximal run of bytes other than space and \\x09-\\x0D; for UTF-8 this
equals the character class ``[^\\x20\\x09-\\x0D]+``. All hashes are fixed functions
of the bytes, so every task computes the same ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multiplications)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h


_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words, and each text's first word index
    (one more entry at the end). Words never run across texts."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~BLANK[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    head = solid.copy()
    head[1:] &= ~solid[:-1] | edge[1:n]
    tail = solid
    tail[:-1] &= ~solid[1:] | edge[1:n]
    start = np.flatnonzero(head)
    end = np.flatnonzero(tail) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, also of an empty one: its bytes are taken eight at a time."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))
    size = end - start
    h = mix((eight[start] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _P)
    done, more = 8, np.flatnonzero(size > 8)
    while len(more):
        part = eight[start[more] + done] & _MASK[np.minimum(size[more] - done, 8)]
        h[more] = mix(h[more] * _P + part)
        done += 8
        more = more[size[more] > done]
    return h


def grams(h: np.ndarray, k: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hash of the k words from each position on; the last k-1 positions are left out.
    Callers drop windows that run across texts with :func:`inside`."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    q = np.uint64(seed | 1)
    acc = h[:m].copy()
    for t in range(1, k):
        acc *= q
        acc += h[t:t + m]
    return mix(acc)


def doc_of(first: np.ndarray) -> np.ndarray:
    """The text index of each word."""
    return np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))


def inside(doc: np.ndarray, k: int) -> np.ndarray:
    """Positions whose window of k words lies in one text."""
    m = len(doc) - k + 1
    return doc[:m] == doc[k - 1:] if m > 0 else np.zeros(0, bool)


def table_words(col):
    """(buf, start, end, first, hashes) of an Arrow text column."""
    buf, offs = text_buffer(col)
    start, end, first = spans(buf, offs)
    return buf, start, end, first, word_hashes(buf, start, end)


def column(table, name: str):
    """One column of a table or batch as a single Arrow array."""
    col = table.column(name) if not isinstance(table, pa.RecordBatch) else table.column(table.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    return col


def ints(table, name: str) -> np.ndarray:
    """A long column; null becomes the largest long, and so orders last."""
    return pc.fill_null(column(table, name), (1 << 63) - 1).to_numpy(zero_copy_only=False).astype(np.int64)


class Table:
    """Rows of distinct 64-bit hashes in an open-addressing table of at least twice as many slots."""

    def __init__(self, room: int):
        size = 1 << max(4, (2 * room - 1).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, np.uint64)
        self.rows = np.zeros(size, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 where it is not there."""
        h = np.where(h == 0, np.uint64(1), h)
        slot = (h & self.mask).astype(np.int64)
        seen = self.keys[slot]
        out = np.where(seen == h, self.rows[slot], -1)
        more = np.flatnonzero((seen != h) & (seen != 0))
        while len(more):
            slot[more] = (slot[more] + 1) & int(self.mask)
            seen = self.keys[slot[more]]
            good = seen == h[more]
            out[more[good]] = self.rows[slot[more[good]]]
            more = more[~good & (seen != 0)]
        return out

    def add(self, h: np.ndarray, first_row: int) -> None:
        """Distinct hashes that are not there yet, as rows from ``first_row`` on."""
        h = np.where(h == 0, np.uint64(1), h)
        left, slot = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(left):
            free = self.keys[slot[left]] == 0
            self.keys[slot[left[free]]] = h[left[free]]
            won = self.keys[slot[left]] == h[left]
            self.rows[slot[left[won]]] = first_row + left[won]
            left = left[~won]
            slot[left] = (slot[left] + 1) & int(self.mask)
