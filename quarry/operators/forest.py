"""Random forest for two classes (M5): trees are dealt to tasks, each of which grows its trees over the binned rows.

The rules are those of Spark ML's forest with the same parameters: Poisson(1) bootstrap counts, 32 quantile bins, a new draw of
ceil(sqrt(k)) features at every node, weighted Gini gain above zero, at least ``min_leaf`` drawn rows a child, and the
mean of the leaves' class shares as probability. Spark ML adds up sums for every (node, feature, bin) of
every partition and shuffles them; by estimate, not measured, at depth 15 that is gigabytes a level. Here a level's sums stay in the
task that grows the tree. A task holds the rows (one byte a feature), so this form is for at most boosting.LOCAL_ROWS of them.

A tree depends on (seed, tree) and the rows in key order, not on how they or the trees are dealt.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stats import qcol
from quarry.operators.boosting import BLOCK_SCHEMA, Layout, _blocks, _unpack, cut_points

BINS = 32
PACK = 2.0 ** 26
REPACK = 3  # levels
RUN = 32_768
FIELDS = {"feature": np.int32, "bin": np.uint8, "left": np.int32, "value": np.float64, "gain": np.float64}
FOREST_SCHEMA = "tree int, " + ", ".join(f"{c} binary" for c in FIELDS)


@dataclass(frozen=True)
class Params:
    trees: int = 300
    depth: int = 15
    min_leaf: int = 4
    seed: int = 42


@dataclass
class Tree:
    """Nodes as arrays; a row goes to ``left`` if its bin is at most ``bin``, else to the node after it; a leaf has feature -1."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        leaf = self.feature < 0
        feature, cut = np.where(leaf, 0, self.feature), np.where(leaf, 255, self.bin)
        left = np.where(leaf, np.arange(len(leaf)), self.left)  # a row stays in its leaf: no bin is over 255
        flat, first, node = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1], np.zeros(len(bins), np.int64)
        while True:
            to = left[node] + (flat[first + feature[node]] > cut[node])
            if np.array_equal(to, node):
                return node
            node = to


def _gini(pos, total):
    """Weighted Gini impurity times the weight."""
    return 2.0 * pos * (total - pos) / np.where(total > 0, total, 1.0)


def _values(y: np.ndarray, w: np.ndarray, n: np.ndarray):
    """(arrays to add up, a function of their sums that gives (draws, weight, weight of the high class)) for rows drawn ``n`` times.

    Where each class has one weight, draws and high draws share a number, and one exact sum has both; rows of a single run
    are few, and added up plainly."""
    high = y > 0
    own = [w[of][:1] for of in (~high, high)]
    low_w, high_w = (float(v[0]) if len(v) else 0.0 for v in own)
    if len(n) > RUN and n.sum() < PACK and np.array_equal(w, np.where(high, high_w, low_w)) and np.array_equal(y, high):
        def apart(sums):
            tops = np.floor(sums[0] / PACK)
            draws = sums[0] - tops * PACK
            return draws, low_w * (draws - tops) + high_w * tops, high_w * tops
        return [n + PACK * (n * high)], apart
    return [n, n * w, n * w * y], tuple


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, drawn: np.ndarray, p: Params, rng: np.random.Generator) -> Tree:
    """One tree over rows that were drawn ``drawn`` times each."""
    k = bins.shape[1]
    take = int(np.ceil(np.sqrt(k)))
    rows = np.flatnonzero(drawn)
    values, apart = _values(y[rows], w[rows], drawn[rows].astype(np.float64))
    flat, place, at = np.ascontiguousarray(bins[rows]).ravel(), np.arange(len(rows)) * k, np.zeros(len(rows), np.int64)
    levels, first, many = [], 0, 1  # nodes of a level are numbered from ``first`` on
    for depth in range(p.depth + 1):
        draws, all_, high = apart([np.bincount(at, v, many) for v in values])
        best = np.full(many, 1e-9) * all_
        feature, cut, split = np.full(many, -1, np.int32), np.zeros(many, np.uint8), np.zeros(many, bool)
        if depth < p.depth and len(at):
            drawn_features = np.argsort(rng.random((many, k)), axis=1)[:, :take]
            able = np.flatnonzero((draws >= 2 * p.min_leaf) & (high > 0) & (high < all_))  # no other node has a split that gains
            number = np.full(many, -1)
            number[able] = np.arange(len(able))
            at = number[at]
            if len(able) < many:
                keep = at >= 0
                place, at, values = place[keep], at[keep], [v[keep] for v in values]
            if depth % REPACK == 0 and depth:  # rows of a node lie together again
                order = np.argsort(at.astype(np.uint16) if len(able) <= 1 << 16 else at, kind="stable")
                flat = flat.reshape(-1, k)[place[order] // k].ravel()
                place, at, values = np.arange(len(at)) * k, at[order], [v[order] for v in values]
            sums = _sums(flat, place, at, values, drawn_features[able])
            own, all_able, high_able, best_able = _gini(high[able], all_[able]), all_[able], high[able], best[able]
            for j in range(take):
                nl, tl, pl = apart([s[j].cumsum(axis=1) for s in sums])
                gain = own[:, None] - _gini(pl, tl) - _gini(high_able[:, None] - pl, all_able[:, None] - tl)
                gain[(nl < p.min_leaf) | (nl[:, -1:] - nl < p.min_leaf)] = -np.inf
                c = gain.argmax(axis=1)
                top = gain[np.arange(len(able)), c]
                better = top > best_able
                best_able[better] = top[better]
                feature[able[better]], cut[able[better]] = drawn_features[able[better], j], c[better]
            best[able] = best_able
            split = feature >= 0
        left = np.full(many, 0, np.int32)
        left[split] = first + many + 2 * np.arange(int(split.sum()))
        levels.append((feature, cut, left, high / np.where(all_ > 0, all_, 1.0), np.where(split, best, 0.0)))
        if not split.any():
            break
        of = able[at]
        keep = split[of]
        if not keep.all():
            place, of, values = place[keep], of[keep], [v[keep] for v in values]
        at = left[of] - first - many + (flat[place + feature[of]] > cut[of])
        first, many = first + many, 2 * int(split.sum())
    return Tree(*(np.concatenate([level[i] for level in levels]) for i in range(5)))


def _sums(flat: np.ndarray, place: np.ndarray, at: np.ndarray, values: list, features: np.ndarray) -> list[np.ndarray]:
    """For each of ``values`` its sums by (draw of a feature, node, bin). Rows are taken in runs, whose nodes are few next to each other."""
    many, take = features.shape
    out = [np.zeros((take, many, BINS)) for _ in values]
    for lo in range(0, len(at), RUN):
        run = at[lo:lo + RUN]
        a, b = int(run.min()), int(run.max()) + 1
        key, where, own = (run - a) * BINS, place[lo:lo + RUN], [v[lo:lo + RUN] for v in values]
        for j in range(take):
            code = key + flat[where + features[run, j]]
            for s, v in zip(out, own, strict=True):
                s[j, a:b] += np.bincount(code, v, (b - a) * BINS).reshape(b - a, BINS)
    return out


def _forest(p: Params, parts: int, width: int):
    """The trees of a part, over all blocks."""
    def run(key, t):
        blocks = [rows for b in t.to_batches() for _, rows in _unpack(b, width)]
        order = np.argsort(np.concatenate([r.key for r in blocks]), kind="stable")
        bins, y, w = (np.concatenate([getattr(r, c) for r in blocks])[order] for c in ("bins", "y", "w"))
        blocks.clear()
        out = []
        for i in range(int(key[0].as_py()), p.trees, parts):
            rng = np.random.default_rng((p.seed, i))
            tree = grow(bins, y, w, rng.poisson(1.0, len(y)), p, rng)
            out.append({"tree": i, **{c: getattr(tree, c).astype(t_).tobytes() for c, t_ in FIELDS.items()}})
        return pa.Table.from_pylist(out, schema=pa.schema([("tree", pa.int32()), *[(c, pa.binary()) for c in FIELDS]]))
    return run


class ForestModel:
    """Trees over named features; scores with numpy over Arrow batches."""

    def __init__(self, features: list[str], layout: Layout, trees: list[Tree]):
        self.features, self.layout, self.trees = features, layout, trees

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        bins = self.layout.bins(x)
        out = np.zeros(len(x))
        for t in self.trees:
            out += t.value[t.leaves_of(bins)]
        return np.clip(out / len(self.trees), 0.0, 1.0)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability_high``. A missing feature value goes to the highest bin."""
        @F.pandas_udf(T.DoubleType())
        def high(*cols: pd.Series) -> pd.Series:
            return pd.Series(self.probabilities(np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in cols], axis=1)))

        return df.withColumn("probability_high", high(*[qcol(f).cast("double") for f in self.features]))

    def importances(self) -> list[float]:
        """Gain by feature, each tree's summing to 1, then the mean's."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            one = np.bincount(t.feature[t.feature >= 0], t.gain[t.feature >= 0], len(total))
            total += one / one.sum() if one.sum() else 0.0
        return list(total / total.sum()) if total.sum() else list(total)

    def save(self, spark: SparkSession, path: str) -> str:
        rows = [(i, *[getattr(t, c).astype(t_).tobytes() for c, t_ in FIELDS.items()]) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, FOREST_SCHEMA).write.parquet(path + "/trees")
        spark.createDataFrame([(json.dumps({"features": self.features, "cuts": self.layout.cuts}),)], "meta string") \
            .coalesce(1).write.text(path + "/meta")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ForestModel":
        meta = json.loads(spark.read.text(path + "/meta").first()[0])
        return ForestModel(meta["features"], Layout(meta["cuts"]), _trees(spark.read.schema(FOREST_SCHEMA).parquet(path + "/trees")))


def _trees(rows: DataFrame) -> list[Tree]:
    """Some 25 bytes a node and, whatever the rows, 2 ** (depth + 1) nodes a tree at most."""
    t = sorted(rows.toArrow().to_pylist(), key=lambda r: r["tree"])
    return [Tree(*(np.frombuffer(r[c], t_) for c, t_ in FIELDS.items())) for r in t]


def fit(df: DataFrame, features: list[str], p: Params, label: str = "target", weight: str = "weight", key: str = "ID") -> ForestModel:
    """A forest for ``label`` (0/1) with row weights. Rows must have no missing feature values."""
    from quarry.sources.sinks import materialize

    layout = cut_points(df, features, BINS)
    table = df.select(*[qcol(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y"),
                      F.col(weight).cast("double").alias("w"), F.xxhash64(qcol(key)).alias("key"), F.lit(0.0).alias("margin"))
    blocks = materialize(table.mapInArrow(_blocks(layout, len(features)), BLOCK_SCHEMA), "forest-blocks").withColumn("margin", F.lit(b""))
    parts = min(p.trees, 2 * df.sparkSession.sparkContext.defaultParallelism)  # each is sent all rows
    dealt = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    trees = materialize(dealt.groupBy("part").applyInArrow(_forest(p, parts, len(features)), FOREST_SCHEMA), "forest-trees")
    return ForestModel(list(features), layout, _trees(trees))
