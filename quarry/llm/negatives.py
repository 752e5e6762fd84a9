"""Hard-negative mining with exact integer scores by the method of Four Russians.

Components become integers, floor(SCALE * x). A candidate is kept as bit planes of its integers in two's
complement: a byte holds one bit of eight dimensions. An anchor has, for each group of eight dimensions, a table
of its 256 subset sums. A plane's share of the inner product is then one lookup a group, and planes are joined by
shift and add from the sign plane down: as many lookups as the candidate has bytes, and a full, exact score.

On Spark: candidates and anchors (a stated query set) are dealt into parts of about PART_ROWS and
ANCHOR_ROWS rows by a number of their own, so no label, id or vector that many rows share makes a part larger, and
each pair of parts is one bounded group. A first pass scores rows of the anchor's label
and keeps each anchor's best; a second scores the other labels and keeps the best in each band. Every group
answers with a bounded number of rows an anchor, which a window ranks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G
from . import words as W

SCALE = 256
PART_ROWS = 32_768
ANCHOR_ROWS = 4_096
BLOCK = 64  # anchors with tables at one time
STEP = 2_048  # candidates scored at one time
LAST = (1 << 63) - 1

#: Row b: the bits of byte b, the highest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q) of the rows that take part: label and vector not null, no component null or not finite.
    ``q`` holds floor(SCALE * x) of each component, x as double."""
    x = F.col("embedding").cast("array<double>")
    fit = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))  # NaN is above infinity
    scaled = F.transform(x, lambda v: F.floor(v * float(SCALE)))
    return vectors.where(F.col("label").isNotNull() & x.isNotNull() & fit).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), scaled.alias("q"),
        F.aggregate(x, F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v))).alias("most"))


def planes(q: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes (rows, bits, groups of eight dimensions) of integers (rows, dimensions), the sign plane first."""
    shift = np.arange(bits - 1, -1, -1, dtype=np.int64)
    return np.packbits(((q[:, None, :] >> shift[None, :, None]) & 1).astype(np.uint8), axis=2)


def subset_sums(a: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each group of eight dimensions and each byte, the sum of the components it picks."""
    n, dim = a.shape
    groups = -(-dim // 8)
    full = np.zeros((n, groups * 8), np.int64)
    full[:, :dim] = a
    return np.einsum("bk,ngk->gbn", BITS, full.reshape(n, groups, 8))


def scores(tables: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products (candidates, anchors) from the anchors' tables and the candidates' planes."""
    out = np.zeros((len(p), tables.shape[2]), tables.dtype)
    got = np.empty_like(out)
    for b in range(p.shape[1]):
        out <<= 1
        for g in range(p.shape[2]):
            np.take(tables[g], p[:, b, g], axis=0, out=got)
            out += got
        if b == 0:  # two's complement: the highest plane counts negative
            np.negative(out, out=out)
    return out


def first_k(s: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Up to k of ``rows`` (ascending, in order of preference among ties) by falling score ``s[rows]``."""
    v = s[rows]
    if len(v) > k:
        least = np.partition(v, len(v) - k)[len(v) - k]
        above = np.flatnonzero(v > least)
        keep = np.sort(np.concatenate([above, np.flatnonzero(v == least)[:k - len(above)]]))
        rows, v = rows[keep], v[keep]
    return rows[np.argsort(-v, kind="stable")]


def _matrix(col, dtype, shape) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(shape)


def _pack(bits: int):
    """Rows with their planes, and with their integers for those that may be anchors."""
    def run(batches):
        for b in batches:
            q = W.column(b, "q")
            size = np.diff(q.offsets.to_numpy())
            flat = q.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            packed: list = [b""] * len(size)
            raw: list = [b""] * len(size)
            for d in np.unique(size):
                of = np.flatnonzero(size == d)
                x = flat[(at[of][:, None] + np.arange(d)[None, :])]
                for i, row, p in zip(of, x, planes(x, bits), strict=True):
                    packed[i], raw[i] = p.tobytes(), row.tobytes()
            asked = W.column(b, "anchor").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [W.column(b, "row"), W.column(b, "vec_id"), W.column(b, "label"), pa.array(size.astype(np.int32)),
                 pa.array(packed, pa.binary()), pa.array([r if a else None for r, a in zip(raw, asked, strict=True)], pa.binary())],
                names=["row", "vec_id", "label", "dim", "planes", "ints"])
    return run


FOUND = "anchor long, band long, row long, vec_id long, score long"


def _scan(cands: DataFrame, anchors: DataFrame, parts: int, chunks: int, pick) -> DataFrame:
    """Every part of candidates scored against every part of anchors; ``pick`` yields the kept rows."""
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = cands.select("row", "vec_id", "label", "dim", "planes", deal(parts).alias("part"), every(chunks).alias("chunk"))
    right = anchors.withColumn("chunk", deal(chunks)).withColumn("part", every(parts))

    def run(c, a):
        out = list(_score(c, a, pick)) if c.num_rows and a.num_rows else []
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        vec = pa.array(cols[3], pa.int64(), mask=cols[3] == LAST)
        return pa.table([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), vec, pa.array(cols[4])],
                        names=["anchor", "band", "row", "vec_id", "score"])

    by = ["part", "chunk"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, FOUND)


def _score(c, a, pick):
    labels, code = np.unique(np.array([*c.column("label").to_pylist(), *a.column("label").to_pylist()], object), return_inverse=True)
    c_label, a_label = code[:c.num_rows], code[c.num_rows:]
    ids, rows = W.ints(c, "vec_id"), W.ints(c, "row")
    c_dim, a_dim = (W.column(t, "dim").to_numpy().astype(np.int64) for t in (c, a))
    bands = a.column("bands").to_pylist() if "bands" in a.column_names else None
    a_row = W.ints(a, "row")
    for d in np.intersect1d(c_dim, a_dim):
        of = np.flatnonzero(c_dim == d)
        of = of[np.lexsort((rows[of], ids[of]))]
        mine = np.flatnonzero(a_dim == d)
        mine = mine[np.argsort(a_label[mine], kind="stable")]
        groups = -(-int(d) // 8)
        data = c.column("planes").take(pa.array(of))
        size = len(data[0].as_py()) if len(data) else 0
        p = _matrix(data, np.uint8, (len(of), size // groups if groups else 1, groups))
        ints = _matrix(a.column("ints").take(pa.array(mine)), np.int64, (len(mine), int(d)))
        yield from pick(p, ids[of], rows[of], c_label[of], ints, a_row[mine], a_label[mine], [bands[i] for i in mine] if bands else None)


def _tables(ints: np.ndarray, bits: int) -> np.ndarray:
    t = subset_sums(ints)
    most = int(np.abs(ints).sum(axis=1).max(initial=0)) << bits
    return t.astype(np.int32) if most < 1 << 31 else t


def _all(tables: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(anchors, candidates), scored STEP candidates at a time."""
    out = np.empty((tables.shape[2], len(p)), np.int64)
    for lo in range(0, len(p), STEP):
        out[:, lo:lo + STEP] = scores(tables, p[lo:lo + STEP]).T
    return out


def _same_label(k: int):
    def pick(p, ids, rows, labels, ints, a_row, a_label, bands):
        for lab in np.unique(a_label):
            of, asked = np.flatnonzero(labels == lab), np.flatnonzero(a_label == lab)
            if not len(of):
                continue
            sub = p[of]
            for lo in range(0, len(asked), BLOCK):
                block = asked[lo:lo + BLOCK]
                s = _all(_tables(ints[block], p.shape[1]), sub)
                for i, a in enumerate(block):
                    best = first_k(s[i], np.flatnonzero(rows[of] != a_row[a]), k)
                    n = len(best)
                    yield np.full(n, a_row[a]), np.zeros(n, np.int64), rows[of][best], ids[of][best], s[i][best]
    return pick


def _other_labels(k: int, low: int, high: int):
    def pick(p, ids, rows, labels, ints, a_row, a_label, bands):
        for lo in range(0, len(a_row), BLOCK):
            s = _all(_tables(ints[lo:lo + BLOCK], p.shape[1]), p)
            for i in range(len(s)):
                other = labels != a_label[lo + i]
                for band in bands[lo + i]:
                    # low * band <= 100 * score <= high * band, in whole numbers
                    fits = other & (s[i] >= -(-low * band // 100)) & (s[i] <= high * band // 100)
                    best = first_k(s[i], np.flatnonzero(fits), k)
                    n = len(best)
                    yield np.full(n, a_row[lo + i]), np.full(n, band), rows[best], ids[best], s[i][best]
    return pick


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every
    anchor, that is of every valid row of ``vectors`` (vec_id, embedding, label) where ``anchors`` is true (a
    condition on vec_id).

    An anchor's positives are its first ``positives`` other rows of its label; of each, the first
    ``negatives`` rows of other labels with low * positive_score <= 100 * score <= high * positive_score
    are returned. First is by falling score, ties by smaller vec_id (no id: last).

    Rows with a null label, a null vector or a component that is null or not finite take no part (see
    :func:`valid`). Every row counts for itself, also where rows or ids repeat; a row without vec_id is no
    anchor but may be found. Vectors of another length than the anchor's are not compared with it. Scores are
    exact; where they might pass 63 bits, ValueError is raised. Other columns are not read.
    """
    spark = vectors.sparkSession
    good = valid(vectors.select("vec_id", "embedding", "label"))
    seen = good.agg(F.max("most").alias("most"), F.max(F.size("q")).alias("dim"), F.count("*").alias("n")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not seen["n"]:
        return spark.createDataFrame([], schema)
    most = int(seen["most"] * SCALE) + 1
    if max(1, seen["dim"]) * most * most >= 1 << 62:
        raise ValueError(f"scores of {seen['dim']} components up to {seen['most']} pass 63 bits")
    bits = most.bit_length() + 1
    numbered = good.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "q", F.coalesce(anchors, F.lit(False)).alias("anchor"))
    table = G.written(numbered.mapInArrow(_pack(bits), "row long, vec_id long, label string, dim int, planes binary, ints binary"), "planes")
    asked = G.written(table.where(F.col("ints").isNotNull()).select("row", F.col("vec_id").alias("anchor_id"), "label", "dim", "ints"), "anchors")
    parts, chunks = (max(1, -(-n // size)) for n, size in ((seen["n"], PART_ROWS), (asked.count(), ANCHOR_ROWS)))

    best = F.row_number().over(Window.partitionBy("anchor", "band").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    near = _scan(table, asked.select("row", "label", "dim", "ints"), parts, chunks, _same_label(positives))
    near = G.written(near.withColumn("rank", best).where(F.col("rank") <= positives).drop("rank", "band"), "positives")
    bands = near.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("score").alias("bands"))  # at most ``positives``
    far = _scan(table, asked.join(bands, "row").select("row", "label", "dim", "ints", "bands"), parts, chunks, _other_labels(negatives, low, high))
    far = far.withColumn("rank", best).where(F.col("rank") <= negatives)
    pairs = near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("band"))
    out = far.join(pairs, ["anchor", "band"]).join(asked.select(F.col("row").alias("anchor"), "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("band").alias("positive_score"),
                      F.col("score").alias("negative_score"))
