"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a vector by FUNCTIONS Gaussian projections, cut into cells of a width
fitted to the data; the cells together are its bucket. A query visits its own bucket and
perturbed ones, with some cells moved by one, in the order of a probing template: sets of
boundary distances, by rank, of least expected sum of squares (Lv et al., 2007). All tables'
candidates are merged and ranked by exact distance.

The number of probes is fitted on a bounded sample: the least that finds TARGET of the
sample's true neighbours. Every vector is indexed. Where MAX_PROBES do not reach the target, all queries
are answered by the exact scan, in parts.

On Spark: equal vectors become one with its k + 1 smallest ids. Vectors go to (table, region of
buckets, part); a region with more than PART_ROWS vectors has several parts, so a hot
bucket is split. Queries go to the regions that they probe and all their parts. Each part
answers with k rows a query at most, and a window ranks them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph as G
from . import words as W

TABLES = 6
FUNCTIONS = 10
WIDTH = 2.0  # of a cell, in standard deviations of a projection
MAX_PROBES = 2048
TARGET = 0.96
SAMPLE = 8000  # vectors, and a hundredth as many queries but SAMPLE_QUERIES at least
SAMPLE_QUERIES = 60
PART_ROWS = 20_000


def template(m: int, most: int) -> list[tuple[int, ...]]:
    """Sets of ranks (0 the nearest of 2m boundaries) by falling estimated success: rising expected sum of
    squared distances. Ranks j and 2m - 1 - j are the two sides of one cell, and never together."""
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4.0 * (m + 1) * (m + 2))
    k = 2 * m + 1 - np.arange(m + 1, 2 * m + 1)
    far = 1 - k / (m + 1) + k * (k + 1) / (4.0 * (m + 1) * (m + 2))
    cost = np.concatenate([near, far])
    out: list[tuple[int, ...]] = [()]
    heap = [(float(cost[0]), (0,))]
    while heap and len(out) < most:
        c, s = heapq.heappop(heap)
        if len({min(x, 2 * m - 1 - x) for x in s}) == len(s):
            out.append(s)
        if s[-1] + 1 < 2 * m:
            up = s[-1] + 1
            heapq.heappush(heap, (c - float(cost[s[-1]]) + float(cost[up]), (*s[:-1], up)))
            heapq.heappush(heap, (c + float(cost[up]), (*s, up)))
    return out


class Hashing:
    """The projections, and bucket and probe keys of vectors."""

    def __init__(self, dim: int, spread: float, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH):
        rng = np.random.default_rng(11)
        self.tables, self.m = tables, functions
        self.a = rng.normal(size=(dim, tables * functions))
        self.shift = rng.random(tables * functions)
        self.width = max(width * spread, 1e-12)
        self.code = rng.integers(1, 1 << 63, size=tables * functions, dtype=np.uint64) | np.uint64(1)
        self.probes = 1
        self.exact = False  # the sample's target was not reached: queries are answered by the exact scan

    def cells(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(x @ self.a / self.width + self.shift, -1e15, 1e15)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Keys, vectors by tables."""
        c = np.floor(self.cells(x)).astype(np.int64).view(np.uint64) * self.code
        return c.reshape(len(x), self.tables, self.m).sum(axis=2, dtype=np.uint64)

    def probe_keys(self, x: np.ndarray, plan: list[tuple[int, ...]]) -> np.ndarray:
        """Keys, queries by tables by probes."""
        f = self.cells(x)
        low = f - np.floor(f)
        base = self.buckets(x)
        # Per table 2m boundaries: the first m below (cell - 1), the others above.
        dist = np.concatenate([low.reshape(len(x), self.tables, self.m), 1 - low.reshape(len(x), self.tables, self.m)], axis=2)
        order = np.argsort(dist, axis=2, kind="stable")
        code = self.code.reshape(self.tables, self.m)
        move = np.concatenate([np.uint64(0) - code, code], axis=1)
        moved = np.take_along_axis(np.broadcast_to(move, (len(x), *move.shape)), order, axis=2)
        out = np.empty((len(x), self.tables, len(plan)), np.uint64)
        for p, s in enumerate(plan):
            out[:, :, p] = base + moved[:, :, list(s)].sum(axis=2, dtype=np.uint64) if s else base
        return out


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    with np.errstate(over="ignore"):
        return np.sqrt(((x - q) ** 2).sum(axis=1))


def fit(sample: np.ndarray, k: int, target: float = TARGET) -> Hashing:
    """A hashing whose probes find ``target`` of the k true neighbours on the sample."""
    scale = float(np.sqrt((sample ** 2).sum(axis=1).mean())) if len(sample) else 1.0
    h = Hashing(sample.shape[1], scale)
    if len(sample) < 2:
        return h
    nq = min(len(sample), max(SAMPLE_QUERIES, len(sample) // 100))
    b = h.buckets(sample)
    plan = template(h.m, MAX_PROBES)
    first = np.full((nq, min(k, len(sample) - 1)), len(plan))
    keys = h.probe_keys(sample[:nq], plan)
    for i in range(nq):
        d = exact(sample[i], sample)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[:first.shape[1]]
        for t in range(h.tables):
            order = np.argsort(keys[i, t], kind="stable")
            at = np.searchsorted(keys[i, t][order], b[near, t])
            ok = (at < len(plan)) & (keys[i, t][order][np.minimum(at, len(plan) - 1)] == b[near, t])
            first[i, ok] = np.minimum(first[i, ok], order[at[ok]])
    need = np.sort(first.reshape(-1))
    last = need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)]
    h.probes, h.exact = int(min(len(plan), last + 1)), bool(last >= len(plan))
    return h


def _matrix(col, dim: int) -> np.ndarray:
    data = [np.frombuffer(x, np.float64) for x in col.to_pylist()]
    return np.stack(data) if data else np.zeros((0, dim))


def _clean(k: int):
    """Distinct valid vectors of each batch with their k + 1 smallest ids."""
    def run(batches):
        for b in batches:
            ids = W.column(b, "vec_id").to_numpy(zero_copy_only=False)
            vec = W.column(b, "embedding")
            lens = vec.value_lengths().to_numpy()
            flat = vec.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            data = [x.tobytes() for x in np.split(flat + 0.0, np.cumsum(lens)[:-1])] if len(lens) else []
            best: dict[bytes, list[int]] = {}
            for i, x in sorted(zip(ids.tolist(), data, strict=True)):
                own = best.setdefault(x, [])
                if len(own) <= k:
                    own.append(i)
            yield pa.RecordBatch.from_pydict({"vec": pa.array(list(best), pa.binary()), "ids": pa.array(list(best.values()), pa.list_(pa.int64()))})
    return run


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of vectors that take part: not null, not zero, without null or non-finite components,
    of the commonest dimension (ties: the larger)."""
    e = F.col("embedding")
    inf = F.lit(float("inf"))
    good = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull()).where(
        F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False))) & F.exists(e, lambda x: x != 0))
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))
    dim = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.where(F.size("embedding") == (dim["d"] if dim else -1))


def search(vectors: DataFrame, queries: Column, k: int = 10, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each valid row of ``vectors`` (vec_id, embedding) where ``queries`` is
    true (a condition on vec_id), the k nearest found among all other valid rows, by Euclidean distance,
    ties to the smaller vec_id.

    A query that the index finds fewer than k rows for is answered by an exact scan, so it has
    all candidates if there are fewer. Rows of equal vec_id are one id; a query's own id is left out.
    """
    spark = vectors.sparkSession
    good = valid(vectors)
    merged = good.select("vec_id", "embedding").mapInArrow(_clean(k), "vec binary, ids array<long>")

    def merge(key, t):
        best: dict[bytes, list[int]] = {}
        for x, ids in zip(t.column("vec").to_pylist(), t.column("ids").to_pylist(), strict=True):
            best[x] = sorted({*best.get(x, []), *ids})[:k + 1]
        return pa.table({"vec": pa.array(list(best), pa.binary()), "ids": pa.array(list(best.values()), pa.list_(pa.int64()))})

    shards = max(1, -(-good.count() // PART_ROWS))
    distinct = G.written(merged.groupBy(F.pmod(F.xxhash64("vec"), F.lit(shards)).alias("h")).applyInArrow(merge, "vec binary, ids array<long>"), "vectors")
    n = distinct.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    u = F.pmod(F.xxhash64("vec", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    rows = sorted(bytes(r["vec"]) for r in distinct.where(u < min(1.0, SAMPLE / n)).select("vec").collect())
    if not rows:
        rows = [bytes(distinct.first()["vec"])]
    sample = np.stack([np.frombuffer(x, np.float64) for x in rows])
    sample = sample[np.random.default_rng(5).permutation(len(sample))]
    h = fit(sample, k, target)
    dim = sample.shape[1]
    plan = template(h.m, MAX_PROBES)[:h.probes]
    regions = max(1, -(-n // PART_ROWS))
    shared = spark.sparkContext.broadcast((h, plan))

    def index(batches):
        for b in batches:
            x = _matrix(W.column(b, "vec"), dim)
            if len(x):
                key = shared.value[0].buckets(x)
                for t in range(key.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t, np.int32)), pa.array((key[:, t] % np.uint64(regions)).astype(np.int32)),
                         pa.array(key[:, t].view(np.int64)), *b.columns], names=["tab", "region", "bucket", *b.schema.names])

    def probe(batches):
        for b in batches:
            x = _matrix(W.column(b, "vec"), dim)
            ids, vec = W.column(b, "query_id").to_pylist(), W.column(b, "vec").to_pylist()
            for lo in range(0, len(x), 64):
                keys = shared.value[0].probe_keys(x[lo:lo + 64], shared.value[1])
                out: list[tuple] = []
                for i in range(len(keys)):
                    for t in range(keys.shape[1]):
                        own = np.unique(keys[i, t])
                        at = own % np.uint64(regions)
                        out += [(t, int(r), ids[lo + i], vec[lo + i], own[at == r].tobytes()) for r in np.unique(at)]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({"tab": pa.array(cols[0], pa.int32()), "region": pa.array(cols[1], pa.int32()),
                                                  "query_id": pa.array(cols[2], pa.int64()), "vec": pa.array(cols[3], pa.binary()), "keys": pa.array(cols[4], pa.binary())})

    def rank(key, t, q):
        found = _nearest(t, q, dim, k)
        return pa.table({"query_id": pa.array([r[0] for r in found], pa.int64()), "vec_id": pa.array([r[1] for r in found], pa.int64()),
                         "score": pa.array([r[2] for r in found], pa.float64())})

    asked = good.where(queries).select(F.col("vec_id").alias("query_id"), "embedding").mapInArrow(_as_bytes, "query_id long, vec binary")
    asked = G.written(asked.dropDuplicates(["query_id"]), "queries")
    indexed = distinct.mapInArrow(index, "tab int, region int, bucket long, vec binary, ids array<long>")
    # TABLES rows for PART_ROWS vectors. Said to be the side that is broadcast: the probes of a query are some 100 KB, but Spark takes
    # them for about as small as the table of queries that they come from, and would send them all through the driver.
    parts = F.broadcast(indexed.groupBy("tab", "region").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")))
    split = indexed.join(parts, ["tab", "region"]).withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int"))
    sent = asked.where(F.lit(not h.exact)).mapInArrow(probe, "tab int, region int, query_id long, vec binary, keys binary").join(parts, ["tab", "region"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    by = ["tab", "region", "part"]
    near = split.select(*by, "bucket", "vec", "ids").groupBy(*by).cogroup(sent.select(*by, "query_id", "vec", "keys").groupBy(*by)).applyInArrow(
        rank, "query_id long, vec_id long, score double")
    near = G.written(_top(near, k), "near")
    short = asked.join(near.groupBy("query_id").count(), "query_id", "left").where(F.coalesce("count", F.lit(0)) < k).select("query_id", "vec")
    if not short.isEmpty():
        scan = distinct.select(F.pmod(F.xxhash64("vec"), F.lit(regions)).cast("int").alias("region"), F.lit(0).cast("long").alias("bucket"), "vec", "ids")
        everywhere = short.select(F.explode(F.sequence(F.lit(0), F.lit(regions - 1))).alias("region"), "query_id", "vec", F.lit(None).cast("binary").alias("keys"))
        rest = scan.groupBy("region").cogroup(everywhere.groupBy("region")).applyInArrow(rank, "query_id long, vec_id long, score double")
        near = near.join(short.select("query_id"), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(_top(rest, k))
    return near.select("query_id", "rank", "vec_id", "score")


def _as_bytes(batches):
    for b in batches:
        data = [np.asarray(x, np.float64) + 0.0 for x in W.column(b, "embedding").to_pylist()]
        yield pa.RecordBatch.from_arrays([W.column(b, "query_id"), pa.array([x.tobytes() for x in data], pa.binary())], names=["query_id", "vec"])


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, each id once, ranked from 1."""
    from pyspark.sql import Window

    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)


def _nearest(t, q, dim: int, k: int):
    """Up to k (query, id, distance) rows per query from one part's vectors in probed buckets (all, if keys is null)."""
    out: list[tuple[int, int, float]] = []
    if not t.num_rows or not q.num_rows:
        return out
    x = _matrix(t.column("vec"), dim)
    ids = t.column("ids").to_pylist()
    bucket, inv = np.unique(t.column("bucket").to_numpy().view(np.uint64), return_inverse=True)
    norm = (x ** 2).sum(axis=1)
    qs, names, keys = _matrix(q.column("vec"), dim), q.column("query_id").to_pylist(), q.column("keys").to_pylist()
    for lo in range(0, len(qs), 64):
        part = qs[lo:lo + 64]
        rough = norm[None, :] - 2 * (part @ x.T)
        for i in range(len(part)):
            row = rough[i]
            if keys[lo + i] is not None:
                own = np.frombuffer(keys[lo + i], np.uint64)
                at = np.minimum(np.searchsorted(own, bucket), len(own) - 1)
                row = np.where((own[at] == bucket)[inv], row, np.inf)
            take = min(len(row), 2 * k + 2)
            best = np.argpartition(row, take - 1)[:take] if take < len(row) else np.arange(len(row))
            best = best[row[best] < np.inf]
            d = exact(part[i], x[best])
            mine = sorted((float(dist), v) for dist, j in zip(d, best, strict=True) for v in ids[int(j)] if v != names[lo + i])[:k]
            out += [(names[lo + i], v, dist) for dist, v in mine]
    return out
