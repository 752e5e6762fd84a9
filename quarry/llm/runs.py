"""Periodic runs of words: stretches that repeat a block of q words at least four times.

By the runs theorem, every maximal repetition is the extension of a Lyndon root: a longest Lyndon word that starts
at some position, under an order of the symbols or under the inverse order. The lengths of these words (the Lyndon
array) are what the first phase of Baier's suffix sorter yields: it sorts suffixes into groups by their
longest Lyndon prefix, takes groups from the highest down, and lengthens the prefix of the
nearest lower position to the left of each member by the group's word. Phase two is not needed. Each root (i, p) is then
extended both ways by the longest common extension of i and i + p.

A stretch of words where some pair of neighbours occurs fewer than three times can hold no such
repetition (four blocks of q words hold every pair at least three times), so the sorter runs on
the stretches that are left, all those of a batch at once with a lowest symbol between them.
Extensions compare prefix hashes of 64 bits; every run is then checked word by word (by word hashes).

On Spark this is one map over the documents: nothing is shuffled, and a task holds a few MB of
text at a time, or one document if that is longer (some 300 bytes a word in such stretches).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

TIMES = 4  # a run is at least so many periods long,
LEAST = 6  # and at least so many words
BYTES = 4 << 20  # of text taken at one time

RESULT = "struct<n_words:long, runs:array<struct<start:long, length:long, period:long>>, collapsed:string>"


def lyndon(s: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each position: groups of phase one of Baier's sorter.

    ``above`` and ``below`` chain the groups by rank. Positions count from 1; ``left[i]`` leads to the
    nearest position at or before i whose group is not taken yet (0: none).
    """
    n = len(s)
    symbols = sorted(set(s))
    rank = {c: g for g, c in enumerate(symbols)}
    group = [0] + [rank[c] for c in s]
    members: list[list[int]] = [[] for _ in symbols]
    for i in range(1, n + 1):
        members[group[i]].append(i)
    above = list(range(1, len(symbols) + 1))
    below = list(range(-1, len(symbols) - 1))
    if symbols:
        above[-1] = -1
    size = [1] * (n + 1)
    left = list(range(n + 1))
    now = len(symbols) - 1
    while now >= 0:
        mine = [i for i in members[now] if group[i] == now]
        members[now] = []
        for i in mine:
            left[i] = i - 1
        times: dict[int, int] = {}
        for i in mine:
            j = i - 1
            while left[j] != j:
                left[j] = left[left[j]]
                j = left[j]
            if j:
                times[j] = times.get(j, 0) + 1
        if times:
            word = size[mine[0]]
            moved: dict[tuple[int, int], list[int]] = {}
            for j, k in times.items():
                moved.setdefault((group[j], k), []).append(j)
            for g, k in sorted(moved, reverse=True):  # directly above their group, more repeats of the word higher
                new = len(members)
                members.append(moved[g, k])
                above.append(above[g])
                below.append(g)
                below[above[g]] = new  # the group that is taken now is higher than any that grows
                above[g] = new
                for j in moved[g, k]:
                    group[j] = new
                    size[j] += k * word
        now = below[now]
    return size[1:]


class Extensions:
    """Longest common extensions of pairs of positions, to the right and to the left, by prefix hashes."""

    def __init__(self, x: np.ndarray, longest: int):
        self.x, self.steps = x, max(1, longest).bit_length()
        n = len(x)
        base = np.full(n + 1, 0x9E3779B97F4A7C15, np.uint64)
        base[0] = 1
        self.power = np.cumprod(base)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(W.mix(x) * self.power[:n], out=self.sum[1:])

    def _equal(self, i, j, m):
        """Whether m symbols from i on equal those from j on (j >= i)."""
        return (self.sum[i + m] - self.sum[i]) * self.power[j - i] == self.sum[j + m] - self.sum[j]

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        got, n = np.zeros(len(i), np.int64), len(self.x)
        for k in range(self.steps - 1, -1, -1):
            m = 1 << k
            at = np.flatnonzero(j + got + m <= n)
            at = at[self._equal(i[at] + got[at], j[at] + got[at], m)]
            got[at] += m
        return got

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the symbols before i and before j."""
        got = np.zeros(len(i), np.int64)
        for k in range(self.steps - 1, -1, -1):
            m = 1 << k
            at = np.flatnonzero(i - got >= m)
            at = at[self._equal(i[at] - got[at] - m, j[at] - got[at] - m, m)]
            got[at] += m
        return got


def _slow(x: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """(start, end) of the stretch of period p around i, by comparing words."""
    lo, hi = i, i + p
    while hi < len(x) and x[hi] == x[hi - p]:
        hi += 1
    while lo > 0 and x[lo - 1] == x[lo - 1 + p]:
        lo -= 1
    return lo, hi


def repetitions(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(start, end, period) rows, sorted, of all maximal runs in ``x`` (64-bit symbols) that do not cross a position
    where ``cut`` is true; symbols there are different from all others."""
    n = len(x)
    _, rank = np.unique(x, return_inverse=True)
    walls = np.flatnonzero(np.concatenate([[True], cut, [True]]))
    ext = Extensions(x, int(np.diff(walls).max(initial=1)))
    top = int(rank.max(initial=0)) + 1
    found = []
    for symbols in (rank + 1, top - rank):
        size = np.array(lyndon(np.where(cut, 0, symbols).tolist()), np.int64)
        i = np.flatnonzero((np.arange(n) + size < n) & ~cut)
        p = size[i]
        after, before = ext.right(i, i + p), ext.left(i, i + p)
        good = after + before + p >= np.maximum(LEAST, TIMES * p)
        found.append(np.stack([i - before, i + p + after, p, i], axis=1)[good])
    rows = np.concatenate(found)
    if not len(rows):
        return rows[:, :3]
    rows = rows[np.unique(rows[:, :3], axis=0, return_index=True)[1]]
    for r in rows:
        lo, hi, p, i = (int(v) for v in r)
        true = np.array_equal(x[lo:hi - p], x[lo + p:hi])
        if not true:  # two stretches of equal hash: the root is extended word by word
            r[0], r[1] = _slow(x, i, p)
    long = rows[:, 1] - rows[:, 0] >= np.maximum(LEAST, TIMES * rows[:, 2])
    return np.unique(rows[long, :3], axis=0)


def stretches(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches of words in which every pair of neighbours occurs three times or more, of LEAST
    words or more. No run reaches out of one."""
    at = np.flatnonzero(W.inside(doc, 2))
    pair = W.grams(h, 2)[at] if len(at) else np.zeros(0, np.uint64)
    part = doc[at].astype(np.uint64)
    while len(at):
        _, inv, count = np.unique(W.mix(pair + W.mix(part)), return_inverse=True, return_counts=True)
        keep = count[inv] >= TIMES - 1
        kept, of = at[keep], part[keep]
        new = np.ones(len(kept), bool)
        new[1:] = (np.diff(kept) > 1) | (of[1:] != of[:-1])
        run = np.cumsum(new) - 1
        long = np.bincount(run, minlength=1)[run] >= LEAST - 1 if len(run) else np.zeros(0, bool)
        done = len(kept) == len(at) and bool(long.all())
        at, pair, part = kept[long], pair[keep][long], run[long].astype(np.uint64)
        if done:
            break
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return at[first], at[last] + 2


def find_runs(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(text, start, length, period) rows, sorted, of the runs of texts given by word hashes and first words."""
    doc = W.doc_of(first)
    lo, hi = stretches(h, doc)
    if not len(lo):
        return np.zeros((0, 4), np.int64)
    size = hi - lo + 1  # a wall after each
    ends = np.cumsum(size)
    at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(lo, size)
    cut = np.zeros(len(at), bool)
    cut[ends - 1] = True
    x = h[np.minimum(at, len(h) - 1)].copy()
    x[cut] = W.mix(np.arange(len(ends), dtype=np.uint64) + np.uint64(0xABCDEF1234567))
    rows = repetitions(x, cut)
    start = at[rows[:, 0]]
    d = doc[start] if len(start) else np.zeros(0, np.int64)
    out = np.stack([d, start - first[d], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1).astype(np.int64)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def dropped(rows: np.ndarray, n: int) -> np.ndarray:
    """Which of a text's n words lie in a run after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, rows[:, 1] + rows[:, 3], 1)
    np.add.at(step, rows[:, 1] + rows[:, 2], -1)
    return np.cumsum(step)[:n] > 0


def _pieces(col) -> Iterator[tuple[int, int]]:
    """Slices of a text column of about BYTES, one text at least."""
    _, offs = W.text_buffer(col)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + BYTES, side="right")) - 1)
        yield lo, hi
        lo = hi


def _batch(b: pa.RecordBatch) -> pa.Array:
    """RESULT of a batch's ``text``."""
    buf, start, end, first, h = W.table_words(b)
    rows = find_runs(h, first)
    per = np.searchsorted(rows[:, 0], np.arange(len(first)))
    texts = []
    for d, text in enumerate(b.to_pylist()):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if per[d] < per[d + 1]:
            gone = dropped(rows[per[d]:per[d + 1]], len(words))
            words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
    fields = [pa.array(rows[:, c]) for c in (1, 2, 3)]
    runs = pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return pa.StructArray.from_arrays([pa.array(np.diff(first).astype(np.int64)), runs, pa.array(texts, pa.string())], ["n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, name: str = "periodic") -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, runs (start, length and period in words, by start, then period)
    and the collapsed text: words in a run after its first period are left out, the others joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch with smallest period q and at least max(LEAST, TIMES * q) words that no
    neighbouring word extends. A null or empty text has no words, no runs and an empty collapsed text. Every row
    is judged by itself, so repeated rows and ids get equal results; other columns stay as they are.
    """
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name!r}")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DataType.fromDDL(RESULT))])

    def run(batches):
        for b in batches:
            col = W.column(b, "text")
            for lo, hi in _pieces(col):
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns), _batch(col.slice(lo, hi - lo))], names=[*b.schema.names, name])

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)
