"""Second-order histogram boosting for two classes (M6, M7), level by level on executors.

Features become at most 256 bins at approximate quantiles, once. Rows are kept as packed blocks with
their margin. A round grows one tree: at each level tasks add up gradients, Hessians and counts of
their rows by (leaf, bin), one grouped aggregation merges them, and the driver, which sees leaves x bins
sums and never rows, picks the best split of each leaf. Only the smaller child of a split is summed; its
sibling is the parent less the child. With ``max_leaves``, the tree is then cut back to the leaves that a
best-first queue would have opened, which needs no further pass: all gains are known.

A table of at most LOCAL_ROWS rows is one task's work for every pass, so there the same loop runs
inside that task, ROUNDS_A_JOB rounds at a time; the trees are those of the many-task form (tested). A process for each core of the
executor holds a share of the rows and adds up its sums; the task adds theirs and picks the splits.

Over PROCESS_ROWS rows, features of few bins share a code, so that one pass over the rows adds up the sums of several. Gradients and Hessians are
rounded there to multiples of a power of two so small that every sum of them is exact: trees do not depend on the order of rows,
on how they are dealt or on how features share codes.

Trees go to a folder every few rounds, and a fit that was cut off goes on from there. Column
samples depend on (seed, round), row samples on (row key, round), so a resumed fit gives the same trees.
"""

from __future__ import annotations

import heapq
import json
import multiprocessing
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stats import qcol
from quarry.session import executor_cores

BINS = 256
CODES = 512  # of the features that share one, at most (a single feature has 256)
LOCAL_ROWS = 8_388_608  # some 300 bytes a row while a tree grows
PROCESS_ROWS = 50_000  # of a process at least; up to as many rows, sums are plain ones in the order of rows
ROUNDS_A_JOB = 250
CHECKPOINT_ROUNDS = 10
EPS = 1e-6

TREE_SCHEMA = "round int, node int, feature int, threshold double, bin int, left int, right int, value double, gain double"
BLOCK_SCHEMA = "block long, n int, bins binary, y binary, w binary, key binary, margin binary"


@dataclass(frozen=True)
class Params:
    """``l1`` and ``l2`` act on leaf values; a child has at least ``min_child_weight`` Hessian and ``min_child_samples`` rows;
    a split gains more than ``gamma``; ``max_leaves`` 0 means all leaves down to ``depth``."""

    rounds: int = 500
    depth: int = 8
    lr: float = 0.05
    subsample: float = 1.0
    colsample: float = 1.0
    min_child_weight: float = 1e-3
    min_child_samples: int = 0
    gamma: float = 0.0
    l1: float = 0.0
    l2: float = 1.0
    max_leaves: int = 0
    seed: int = 42


@dataclass
class Layout:
    """Cut points of each feature, and where its bins start in the row of all bins. Gradients are rounded to multiples of ``unit``
    (0: not at all, and every feature has a code of its own). ``groups`` are the features that share a code, each as (feature, codes to its next bin)."""

    cuts: list[list[float]]
    unit: float = 0.0
    size: np.ndarray = field(init=False)
    start: np.ndarray = field(init=False)
    feature: np.ndarray = field(init=False)
    last: np.ndarray = field(init=False)

    def __post_init__(self):
        size = np.array([len(c) + 1 for c in self.cuts], np.int64)
        self.size = size
        self.start = np.concatenate([[0], np.cumsum(size)])[:-1]
        self.feature = np.repeat(np.arange(len(size)), size)
        self.last = np.zeros(int(size.sum()), bool)
        self.last[self.start + size - 1] = True
        self.groups: list[list[tuple[int, int]]] = []
        self.codes: list[int] = []
        for f in sorted(range(len(size)), key=lambda f: -size[f]):
            n = int(size[f])
            i = next((i for i, c in enumerate(self.codes) if self.unit and c * n <= CODES), len(self.codes))
            if i == len(self.codes):
                self.groups.append([])
                self.codes.append(1)
            self.groups[i].append((f, self.codes[i]))
            self.codes[i] *= n
        self.place = {f: (i, step) for i, group in enumerate(self.groups) for f, step in group}

    @property
    def width(self) -> int:
        return len(self.feature)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers: how many cuts lie below a value."""
        out = np.zeros(x.shape, np.uint8)
        for j, c in enumerate(self.cuts):
            out[:, j] = np.searchsorted(c, x[:, j], side="left")
        return out

    def coded(self, bins: np.ndarray) -> list[np.ndarray]:
        """The codes of rows, an array a group."""
        out = []
        for group in self.groups:
            code = np.zeros(len(bins), np.uint16)
            for f, step in group:
                code += bins[:, f] * np.uint16(step)
            out.append(code)
        return out

    def low(self, f: int, cut: int) -> tuple[int, np.ndarray]:
        """(group, whether a code's bin of ``f`` is at most ``cut``, by code)."""
        i, step = self.place[f]
        return i, np.arange(self.codes[i]) // step % self.size[f] <= cut

    def by_feature(self, i: int, sums: np.ndarray, out: np.ndarray) -> None:
        """Sums by code of group i (..., codes) added up to the bins of its features, in ``out`` (..., bins)."""
        for f, step in self.groups[i]:
            n = int(self.size[f])
            out[..., self.start[f]:self.start[f] + n] = sums.reshape(*sums.shape[:-1], -1, n, step).sum(axis=(-3, -1))


class Tree:
    """Nodes as parallel lists; a row goes left if its bin is at most ``bin``; a leaf has feature -1."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.value, self.gain = [-1], [0], [0], [0], [0.0], [0.0]

    def split(self, node: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node], self.gain[node] = feature, cut, at, at + 1, gain
        for column, blank in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
            column += [blank, blank]
        return at, at + 1

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.bin, self.left, self.right))
        leaf, own = feature < 0, np.arange(len(feature))
        child = np.stack([np.where(leaf, own, left), np.where(leaf, own, right)], axis=1).ravel()  # a row stays in its leaf
        feature = np.where(leaf, 0, feature)
        flat, first, node = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1], np.zeros(len(bins), np.int64)
        depth = np.zeros(len(leaf), np.int64)
        for n in np.flatnonzero(~leaf):  # children come after their parents
            depth[[left[n], right[n]]] = depth[n] + 1
        for _ in range(int(depth[child].max())):
            node = child[2 * node + (flat[first + feature[node]] > cut[node])]
        return node


def _soft(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _score(g, h, p: Params):
    a = np.maximum(np.abs(g) - p.l1, 0.0)
    a *= a
    a /= h + p.l2
    return a


def best_splits(g: np.ndarray, h: np.ndarray, n: np.ndarray, layout: Layout, use: np.ndarray, p: Params):
    """(gain, bin position, left sums, totals) of the best split of each row of sums (leaves, bins); gain -inf where none is allowed."""
    first = int(use[0])  # any used feature holds all rows of the leaf
    own = layout.feature == first
    total = [a[:, own].sum(axis=1) for a in (g, h, n)]
    low = []
    for a in (g, h, n):
        c = np.cumsum(a, axis=1)
        before = np.where(layout.start > 0, c[:, layout.start - 1], 0.0)
        low.append(c - before[:, layout.feature])
    gl, hl, nl = low
    gr, hr, nr = (t[:, None] - x for t, x in zip(total, low, strict=True))
    fit = np.isin(layout.feature, use) & ~layout.last
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _score(gl, hl, p) + _score(gr, hr, p) - _score(total[0], total[1], p)[:, None]
    ok = fit[None, :] & (hl >= p.min_child_weight) & (hr >= p.min_child_weight) & (nl >= max(1, p.min_child_samples)) & (nr >= max(1, p.min_child_samples))
    gain = np.where(ok & (gain > max(p.gamma, EPS)), gain, -np.inf)
    at = np.argmax(gain, axis=1)
    row = np.arange(len(g))
    return gain[row, at], at, (gl[row, at], hl[row, at], nl[row, at]), total


def grow(sums: Callable, layout: Layout, use: np.ndarray, p: Params) -> Tree:
    """One tree. ``sums(tree, nodes)`` adds up (gradients, Hessians, counts), each (nodes, bins), of the rows in those leaves."""
    tree = Tree()
    stats: dict[int, tuple] = {}
    level, hist = [0], None
    for depth in range(p.depth):
        if depth == 0:
            hist = np.stack(sums(tree, [0]))
        gain, at, lows, total = best_splits(*hist, layout, use, p)
        if depth == 0:
            stats[0] = tuple(float(t[0]) for t in total[:2])
        kept, children = [], []
        for i, node in enumerate(level):
            if gain[i] == -np.inf:
                continue
            f = int(layout.feature[at[i]])
            a, b = tree.split(node, f, int(at[i] - layout.start[f]), float(gain[i]))
            gl, hl, nl = (float(x[i]) for x in lows)
            stats[a], stats[b] = (gl, hl), (float(total[0][i]) - gl, float(total[1][i]) - hl)
            kept.append(i)
            children.append((a, b, nl * 2 <= total[2][i]))
        if not kept or depth + 1 == p.depth:
            break
        small = np.stack(sums(tree, [a if first else b for a, b, first in children]))
        rest = hist[:, kept] - small
        level, rows = [], []
        for k, (a, b, first) in enumerate(children):
            level += [a, b]
            rows += [small[:, k], rest[:, k]] if first else [rest[:, k], small[:, k]]
        hist = np.stack(rows, axis=1)
    if p.max_leaves:
        _cut_back(tree, p.max_leaves)
    for node, (g, h) in stats.items():
        tree.value[node] = float(-_soft(np.float64(g), p.l1) / (h + p.l2) * p.lr) if h + p.l2 > 0 else 0.0
    return tree


def _cut_back(tree: Tree, most: int) -> None:
    """Only the splits that a best-first queue opens until there are ``most`` leaves stay."""
    queue = [(-tree.gain[0], 0)] if tree.feature[0] >= 0 else []
    opened, leaves = set(), 1
    while queue and leaves < most:
        node = heapq.heappop(queue)[1]
        opened.add(node)
        leaves += 1
        for child in (tree.left[node], tree.right[node]):
            if tree.feature[child] >= 0:
                heapq.heappush(queue, (-tree.gain[child], child))
    for node, f in enumerate(tree.feature):
        if f >= 0 and node not in opened:
            tree.feature[node], tree.gain[node] = -1, 0.0


def _chosen(layout: Layout, p: Params, r: int) -> np.ndarray:
    """The features of round r."""
    n = len(layout.cuts)
    if p.colsample >= 1:
        return np.arange(n)
    return np.sort(np.random.default_rng((p.seed, r)).permutation(n)[:max(1, int(p.colsample * n))])


def _drawn(key: np.ndarray, p: Params, r: int) -> np.ndarray | None:
    """Which rows take part in round r; None: all."""
    if p.subsample >= 1:
        return None
    h = key ^ np.uint64((r * 0x9E3779B97F4A7C15 + p.seed) & ((1 << 64) - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) < np.uint64(int(p.subsample * 2 ** 64))


class Rows:
    """A block of rows, and its part of the sums of a round."""

    def __init__(self, bins, y, w, key, margin):
        self.bins, self.y, self.w, self.key, self.margin = bins, y, w, key, margin
        self.codes = None

    def begin(self, layout: Layout, p: Params, r: int) -> None:
        if self.codes is None:
            self.layout, self.codes = layout, layout.coded(self.bins)
        prob = 1.0 / (1.0 + np.exp(-self.margin))
        self.g, self.h = self.w * (prob - self.y), np.maximum(self.w * prob * (1.0 - prob), 1e-16)
        if layout.unit:
            self.g, self.h = np.rint(self.g / layout.unit) * layout.unit, np.maximum(np.rint(self.h / layout.unit), 1.0) * layout.unit
        use = set(_chosen(layout, p, r).tolist())
        self.use = [i for i, group in enumerate(layout.groups) if any(f in use for f, _ in group)]
        drawn = _drawn(self.key, p, r)
        self.parts = {0: slice(None) if drawn is None else np.flatnonzero(drawn)}  # rows by node
        self.rest = np.zeros(0, np.int64) if drawn is None else np.flatnonzero(~drawn)

    def _fall(self, tree: Tree, parts: dict) -> None:
        """Rows in nodes that are split go on to their leaves."""
        split = [n for n in parts if tree.feature[n] >= 0]
        while split:
            n = split.pop()
            rows = parts.pop(n)
            i, low = self.layout.low(tree.feature[n], tree.bin[n])
            left = low[self.codes[i][rows]]
            for child, to in ((tree.left[n], left), (tree.right[n], ~left)):
                parts[child] = np.flatnonzero(to) if isinstance(rows, slice) else rows[to]
                if tree.feature[child] >= 0:
                    split.append(child)

    def sums(self, layout: Layout, tree: Tree, nodes: list[int]):
        """(gradients, Hessians, counts), each (nodes, bins), of drawn rows."""
        self._fall(tree, self.parts)
        out, by_code = np.zeros((3, len(nodes), layout.width)), {i: np.zeros((3, len(nodes), layout.codes[i])) for i in self.use}
        for k, node in enumerate(nodes):
            rows = self.parts[node]
            g, h = self.g[rows], self.h[rows]
            for i, to in by_code.items():
                code = self.codes[i][rows].astype(np.intp)
                for a, v in zip(to, (g, h, None), strict=True):
                    a[k] = np.bincount(code, v, layout.codes[i])
        for i, to in by_code.items():
            layout.by_feature(i, to, out)
        return tuple(out)

    def add(self, tree: Tree) -> None:
        """Margins after a whole tree."""
        if self.codes is None:
            self.margin = self.margin + np.array(tree.value)[tree.leaves_of(self.bins)]
            return
        whole = {0: slice(None)} if not hasattr(self, "parts") else {0: self.rest}
        self._fall(tree, whole)
        self._fall(tree, self.parts)
        leaf = tree.value.copy()  # of a node below a leaf, the leaf's
        for n, (f, a, b) in enumerate(zip(tree.feature, tree.left, tree.right, strict=True)):
            if f < 0 and a:
                leaf[a] = leaf[b] = leaf[n]
        self.margin = self.margin.copy()
        for parts in (whole, self.parts):
            for n, rows in parts.items():
                self.margin[rows] += leaf[n]


def fit_rows(rows: Rows, layout: Layout, p: Params, first: int, rounds: int, processes: int = 1) -> list[Tree]:
    """Rounds ``first`` and on over rows in memory."""
    out = []
    with _shares(rows, layout, p, processes) as share:
        for r in range(first, first + rounds):
            share.begin(r)
            tree = grow(share.sums, layout, _chosen(layout, p, r), p)
            share.add(tree)
            out.append(tree)
    return out


class _One:
    """All rows in this process."""

    def __init__(self, rows: Rows, layout: Layout, p: Params):
        self.rows, self.layout, self.p = rows, layout, p

    def begin(self, r: int) -> None:
        self.rows.begin(self.layout, self.p, r)

    def sums(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        return np.stack(self.rows.sums(self.layout, tree, nodes))

    def add(self, tree: Tree) -> None:
        self.rows.add(tree)


class _Many:
    """Shares of the rows in processes of their own, told what to do through pipes."""

    def __init__(self, pipes: list, width: int):
        self.pipes, self.width = pipes, width

    def _tell(self, *what) -> None:
        for pipe in self.pipes:
            pipe.send(what)

    def begin(self, r: int) -> None:
        self._tell("begin", r)

    def sums(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        self._tell("sums", tree, nodes)
        out = np.zeros((3, len(nodes), self.width))
        for pipe in self.pipes:
            out += np.frombuffer(pipe.recv_bytes()).reshape(out.shape)
        return out

    def add(self, tree: Tree) -> None:
        self._tell("add", tree)


def _serve(pipe, others: list, rows: Rows, layout: Layout, p: Params) -> None:
    for other in others:  # so that a pipe ends with the task that holds its other end
        other.close()
    share = _One(rows, layout, p)
    try:
        while True:
            what, *args = pipe.recv()
            out = getattr(share, what)(*args)
            if what == "sums":
                pipe.send_bytes(memoryview(out).cast("B"))
    except (EOFError, BrokenPipeError):
        return


@contextmanager
def _shares(rows: Rows, layout: Layout, p: Params, processes: int) -> Iterator:
    if processes < 2:
        yield _One(rows, layout, p)
        return
    fork, pipes, started = multiprocessing.get_context("fork"), [], []
    try:
        for at in np.array_split(np.arange(len(rows.y)), processes):
            share = slice(int(at[0]), int(at[-1]) + 1) if len(at) else slice(0)
            own, theirs = fork.Pipe()
            pipes.append(own)
            mine = Rows(*(getattr(rows, c)[share] for c in ("bins", "y", "w", "key", "margin")))
            started.append(fork.Process(target=_serve, args=(theirs, list(pipes), mine, layout, p), daemon=True))
            started[-1].start()
            theirs.close()
        yield _Many(pipes, layout.width)
    finally:
        for pipe in pipes:
            pipe.close()
        for process in started:
            process.join(10)
            if process.is_alive():
                process.kill()


# ---------------------------------------------------------------- on Spark
def cut_points(df: DataFrame, features: list[str], bins: int = BINS) -> Layout:
    """Quantile cuts of all features in one aggregate."""
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(qcol(c).cast("double"), probs, 10_000).alias(f"c{i}") for i, c in enumerate(features)]).first()
    return Layout([sorted({float(v) for v in (row[f"c{i}"] or [])}) for i in range(len(features))])


def _blocks(layout: Layout, k: int):
    def run(batches):
        for b in batches:
            x = np.stack([b.column(j).to_numpy(zero_copy_only=False) for j in range(k)], axis=1) if k else np.zeros((b.num_rows, 0))
            y, w, key, margin = (b.column(k + i).to_numpy(zero_copy_only=False) for i in range(4))
            data = [layout.bins(x).tobytes(), y.astype(np.float64).tobytes(), w.astype(np.float64).tobytes(),
                    key.astype(np.int64).tobytes(), margin.astype(np.float64).tobytes()]
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([int(key[0])]), pa.array([b.num_rows], pa.int32()), *[pa.array([d], pa.binary()) for d in data]],
                                                 names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])
    return run


def _unpack(b: pa.RecordBatch, width: int):
    for r in b.to_pylist():
        n = r["n"]
        yield r, Rows(np.frombuffer(r["bins"], np.uint8).reshape(n, width), np.frombuffer(r["y"]), np.frombuffer(r["w"]),
                      np.frombuffer(r["key"], np.uint64), np.frombuffer(r["margin"]))


def _level(layout: Layout, p: Params, r: int, tree: Tree, nodes: list[int]):
    """Sums of a task's blocks as (slot, bin, g, h, n) rows."""
    def run(batches):
        total = None
        for b in batches:
            for _, rows in _unpack(b, len(layout.cuts)):
                rows.begin(layout, p, r)
                one = np.stack(rows.sums(layout, tree, nodes))
                total = one if total is None else total + one
        if total is not None:
            slot, at = np.nonzero(total[2])
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(at.astype(np.int32)), *[pa.array(t[slot, at]) for t in total]],
                                             names=["slot", "bin", "g", "h", "n"])
    return run


def _moved(layout: Layout, trees: list[Tree]):
    """Blocks with the margins after ``trees``."""
    def run(batches):
        for b in batches:
            margins = []
            for _, rows in _unpack(b, len(layout.cuts)):
                for t in trees:
                    rows.add(t)
                margins.append(rows.margin.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(margins, pa.binary())], names=b.schema.names)
    return run


def _local(layout: Layout, p: Params, first: int, rounds: int, processes: int):
    """Rounds over all blocks of one task, as TREE rows."""
    def run(batches):
        all_ = [rows for b in batches for _, rows in _unpack(b, len(layout.cuts))]
        if all_:
            joined = Rows(*(np.concatenate([getattr(x, c) for x in all_]) for c in ("bins", "y", "w", "key", "margin")))
            all_.clear()
            for i, tree in enumerate(fit_rows(joined, layout, p, first, rounds, min(processes, -(-len(joined.y) // PROCESS_ROWS)))):
                yield pa.RecordBatch.from_pylist(_tree_rows(first + i, tree, layout), schema=_TREES)
    return run


_TREES = pa.schema([("round", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("threshold", pa.float64()), ("bin", pa.int32()),
                    ("left", pa.int32()), ("right", pa.int32()), ("value", pa.float64()), ("gain", pa.float64())])


def _tree_rows(r: int, t: Tree, layout: Layout) -> list[dict]:
    return [{"round": r, "node": i, "feature": f, "threshold": layout.cuts[f][t.bin[i]] if f >= 0 else None, "bin": t.bin[i],
             "left": t.left[i], "right": t.right[i], "value": t.value[i], "gain": t.gain[i]} for i, f in enumerate(t.feature)]


def _trees(rows) -> list[Tree]:
    """Trees of collected TREE rows, by round."""
    out: dict[int, Tree] = {}
    for r in sorted(rows, key=lambda r: (r["round"], r["node"])):
        t = out.setdefault(r["round"], Tree())
        if r["node"] == 0:
            for c in ("feature", "bin", "left", "right", "value", "gain"):
                setattr(t, c, [])
        for c in ("feature", "bin", "left", "right", "value", "gain"):
            getattr(t, c).append(r[c])
    return [out[r] for r in sorted(out)]


class BoostedModel:
    """Trees over named features; scores with numpy over Arrow batches."""

    def __init__(self, features: list[str], base: float, layout: Layout, trees: list[Tree]):
        self.features, self.base, self.layout, self.trees = features, base, layout, trees

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = self.layout.bins(x)
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += np.array(t.value)[t.leaves_of(bins)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability_high``. A missing feature value goes to the highest bin."""
        @F.pandas_udf(T.DoubleType())
        def high(*cols: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in cols], axis=1)
            return pd.Series(1.0 / (1.0 + np.exp(-self.margins(x))))

        return df.withColumn("probability_high", high(*[qcol(f).cast("double") for f in self.features]))

    def importances(self) -> list[float]:
        """Gain by feature, summing to 1."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[f] += g
        return list(total / total.sum()) if total.sum() else list(total)

    def save(self, spark: SparkSession, path: str) -> str:
        rows = [tuple(r.values()) for i, t in enumerate(self.trees) for r in _tree_rows(i, t, self.layout)]
        spark.createDataFrame(rows, TREE_SCHEMA).coalesce(1).write.parquet(path + "/trees")
        spark.createDataFrame([(json.dumps({"features": self.features, "base": self.base, "cuts": self.layout.cuts}),)], "meta string") \
            .coalesce(1).write.text(path + "/meta")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedModel":
        meta = json.loads(spark.read.text(path + "/meta").first()[0])
        trees = _trees(spark.read.schema(TREE_SCHEMA).parquet(path + "/trees").collect())
        return BoostedModel(meta["features"], meta["base"], Layout(meta["cuts"]), trees)


def fit(df: DataFrame, features: list[str], p: Params, label: str = "target", weight: str = "weight", key: str = "ID",
        saved: Callable[[], list] | None = None, save: Callable[[int, list[Tree], Layout], None] | None = None,
        local_rows: int = LOCAL_ROWS) -> BoostedModel:
    """Boosted trees for ``label`` (0/1) with row weights. ``saved()`` gives TREE rows of earlier rounds, ``save(first, trees, layout)``
    is called with new trees every few rounds. Rows must have no missing feature values."""
    from quarry.sources.sinks import materialize

    spark = df.sparkSession
    layout = cut_points(df, features)
    s = df.agg(F.sum(F.col(weight) * F.col(label)).alias("pos"), F.sum(F.col(weight)).alias("all"), F.count(F.lit(1)).alias("n")).first()
    if not s["n"]:
        raise ValueError("no training rows")
    if s["n"] > PROCESS_ROWS:  # no sum of gradients is larger than that of the weights
        layout = Layout(layout.cuts, 2.0 ** float(np.ceil(np.log2(s["all"])) - 52))
    rate = min(max(s["pos"] / s["all"], 1e-6), 1 - 1e-6)
    base = float(np.log(rate / (1 - rate)))
    trees = _trees(saved()) if saved else []
    table = df.select(*[qcol(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y"),
                      F.col(weight).cast("double").alias("w"), F.xxhash64(qcol(key)).alias("key"), F.lit(base).alias("margin"))
    small = s["n"] <= local_rows
    state = materialize(table.mapInArrow(_blocks(layout, len(features)), BLOCK_SCHEMA), "boost-blocks")
    if trees:
        state = materialize(state.mapInArrow(_moved(layout, trees), BLOCK_SCHEMA), "boost-blocks")
    while len(trees) < p.rounds:
        first = len(trees)
        if small:
            n = min(ROUNDS_A_JOB, p.rounds - first)
            new = _trees(state.coalesce(1).mapInArrow(_local(layout, p, first, n, executor_cores(spark)), TREE_SCHEMA).collect())
            state = materialize(state.mapInArrow(_moved(layout, new), BLOCK_SCHEMA), "boost-blocks") if first + n < p.rounds else state
        else:
            n = min(CHECKPOINT_ROUNDS, p.rounds - first)
            new, now = [], state
            for r in range(first, first + n):
                tree = grow(_spark_sums(now, layout, p, r), layout, _chosen(layout, p, r), p)
                new.append(tree)
                later = now.mapInArrow(_moved(layout, [tree]), BLOCK_SCHEMA).persist()
                if now is not state:
                    later.count()
                    now.unpersist()
                now = later
            state = materialize(now, "boost-blocks") if first + n < p.rounds else state
            now.unpersist()
        trees += new
        if save:
            save(first, new, layout)
    return BoostedModel(list(features), base, layout, trees)


def _spark_sums(state: DataFrame, layout: Layout, p: Params, r: int) -> Callable:
    def sums(tree: Tree, nodes: list[int]):
        part = state.mapInArrow(_level(layout, p, r, tree, nodes), "slot int, bin int, g double, h double, n double")
        got = part.groupBy("slot", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
        out = np.zeros((3, len(nodes), layout.width))
        slot, at = (got.column(c).to_numpy() for c in ("slot", "bin"))
        for k, c in enumerate(("g", "h", "n")):
            out[k, slot, at] = got.column(c).to_numpy()
        return tuple(out)
    return sums
