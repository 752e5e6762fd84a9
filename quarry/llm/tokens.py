"""Token ids of a public byte-level word-BPE tokenizer for Arrow text columns.

Texts are lower-cased and split into the tokenizer's parts with numpy; the tokenizer's model
encodes each distinct part once per Python worker, and ids are gathered from a table.
Words with characters whose case or class numpy does not decide here are parts of their
own, encoded by the whole tokenizer. White space never joins two parts.
"""

from __future__ import annotations

import numpy as np

from . import words as W

CACHE_PARTS = 1 << 20
LETTER, DIGIT, OTHER, WHOLE = 1, 2, 3, 4


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: its class, and whether a word that has it is left to the whole tokenizer.
    Bytes C3 80 to C3 BF are letters (but for two signs, seen to below)."""
    cls, odd = np.full(256, OTHER, np.uint8), np.zeros(256, bool)
    cls[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
    cls[48:58] = DIGIT
    cls[W.BLANK] = 0
    odd[:33] = odd[127:] = True
    odd[W.BLANK] = False
    odd[0x80:0xC0] = False  # what follows C3; any other lead byte marks the word
    odd[[0xC3]] = False
    odd[ord("'")] = True  # contractions
    odd[ord("|")] = True  # special tokens
    return cls, odd


_CLASS, _ODD = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where
    it is printable Latin-1, else the next unused character from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def parts(buf: np.ndarray, offs: np.ndarray):
    """(bytes, start, end, first, whole): the lower-cased buffer, the spans of all parts, each text's
    first part, and which parts are words for the whole tokenizer (their bytes are unchanged)."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return buf, z, z, np.zeros(len(offs), np.int64), np.zeros(0, bool)
    cls = _CLASS[buf]
    odd = _ODD[buf]
    lead = buf == 0xC3
    after = np.concatenate([[False], lead[:-1]])
    sign = after & ((buf == 0x97) | (buf == 0xB7))
    odd |= sign
    low = _LOWER[buf]
    low[after & (buf >= 0x80) & (buf <= 0x9E)] += 32
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    solid = cls > 0
    head = solid.copy()
    head[1:] &= ~solid[:-1] | edge[1:n]
    tail = solid.copy()
    tail[:-1] &= ~solid[1:] | edge[1:n]
    if odd.any():
        ws, we = np.flatnonzero(head), np.flatnonzero(tail) + 1
        marks = np.flatnonzero(odd)
        hit = np.unique(np.searchsorted(ws, marks, side="right") - 1)
        size = we[hit] - ws[hit]
        at = np.repeat(ws[hit] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        cls[at] = WHOLE
        low[at] = buf[at]
    cut = np.empty(n, bool)
    cut[0] = True
    cut[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == DIGIT) | edge[1:n]
    cut &= solid
    start = np.flatnonzero(cut)
    stop = np.empty(n, bool)
    stop[-1] = True
    stop[:-1] = cut[1:] | ~solid[1:] | edge[1:n]
    stop &= solid
    end = np.flatnonzero(stop) + 1
    return low, start, end, np.searchsorted(start, offs), cls[start] == WHOLE


class PartEncoder:
    """Ids of distinct parts by 64-bit hash, up to CACHE_PARTS of them, then emptied
    (and larger only for a single text with more distinct parts)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.clear()

    def clear(self, least: int = CACHE_PARTS) -> None:
        self.room = max(CACHE_PARTS, least)
        self.table = W.Table(self.room)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.pool = np.zeros(0, self.dtype)

    def add(self, h: np.ndarray, coded: list[list[int]]) -> None:
        """Distinct hashes that are not there yet, with their ids."""
        size = np.fromiter(map(len, coded), np.int32, len(coded))
        self.table.add(h, len(self.at))
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(size, dtype=np.int64) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, np.fromiter((i for x in coded for i in x), self.dtype, int(size.sum()))])

    def one(self, raw: bytes, whole: bool) -> list[int]:
        if whole:
            return self.tok.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids
        text = raw.decode() if raw.isascii() else raw.decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(text)]

    def encode(self, buf, start, end, whole) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each part)."""
        h = W.word_hashes(buf, start, end)
        row = self.table.find(h)
        missing = np.flatnonzero(row < 0)
        if len(missing):
            new, where = np.unique(h[missing], return_index=True)
            if len(self.at) + len(new) > self.room:
                missing = np.arange(len(h))
                new, where = np.unique(h, return_index=True)
                self.clear(len(new))
            first = missing[where]
            self.add(new, [self.one(buf[start[i]:end[i]].tobytes(), whole[i]) for i in first])
            row[missing] = self.table.find(h[missing])
        n = self.size[row].astype(np.int64)
        out = np.cumsum(n) - n
        take = np.repeat(self.at[row] - out, n) + np.arange(int(n.sum()))
        return self.pool[take], n


_ENCODERS: dict[str, PartEncoder] = {}


def encoder(path: str) -> PartEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PartEncoder(path)
    return _ENCODERS[path]


def encode_column(path: str, col, chunk: int = 2 << 20):
    """Yield (index of the first text, list of id arrays) for runs of texts of about ``chunk`` bytes."""
    enc = encoder(path)
    buf, offs = W.text_buffer(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + chunk, side="right")) - 1))
        low, start, end, first, whole = parts(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
        ids, size = enc.encode(low, start, end, whole)
        edge = np.concatenate([[0], np.cumsum(size)])[first]
        yield i, [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        i = j
