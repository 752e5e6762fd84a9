"""Distributed statistics that stay exact without funnelling data into one task.

* ``ranged`` — rows in range partitions of (keys, value), written to the shared
  folder with their range number. Spark samples the rows for the range bounds, so
  ranges hold about equally many rows whatever the values are.
* ``exact_quantiles`` — linear-interpolated quantiles (pandas / DuckDB
  ``quantile_cont`` semantics). Values are first reduced to distinct
  ``(value, count)`` pairs (map-side combine, so a value held by a third of
  the rows costs one row per task). Range totals are cumulated over a handful of
  rows, and only the ranges that hold a wanted rank are ranked row by row.
* ``running_totals`` — the two-level prefix sum for any monotone bucket
  (used by the ranking metrics and the label codes).
* ``column_modes`` — most frequent value per column, smallest on ties.
* ``co_moments``, ``pairwise_corr`` — masked Gram sums of all column pairs in one pass, and
  Pearson r on pairwise-complete rows, NULL (not an ANSI division error) for a constant column.
* ``kth_smallest`` — ranks of hashes by counting, without a sort.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qcol(name: str) -> Column:
    """Column reference that tolerates names like ``Distance(mi)``."""
    return F.col(f"`{name}`")


def to_long(df: DataFrame, columns: list[str], by: list[str] | tuple = (),
            cast: str = "double", value: str = "v") -> DataFrame:
    """Unpivot ``columns`` into ``(by…, column, v)`` (an Expand, no shuffle)."""
    by = list(by)
    safe = [f"_c{i}" for i in range(len(columns))]
    wide = df.select(*[qcol(b) for b in by],
                     *[qcol(c).cast(cast).alias(s) for c, s in zip(columns, safe)])
    long = wide.unpivot(by or [], safe, "_var", value)
    names = F.create_map(*[x for s, c in zip(safe, columns) for x in (F.lit(s), F.lit(c))])
    return long.select(*by, F.element_at(names, F.col("_var")).alias("column"), value)


def ranged(df: DataFrame, keys: list[str], order_col: str, ranges: int | None = None) -> DataFrame:
    """``df`` and a column ``_range``, ascending with (keys, order_col): rows of one key with
    a smaller ``_range`` have a smaller ``order_col``, and equal ones share a range.

    Written once, so that every reader sees the same ranges and a lost executor re-reads files.
    Without ``ranges`` there are ``spark.sql.shuffle.partitions`` of them, small ones merged by AQE."""
    from quarry.sources.sinks import materialize

    by = [qcol(c) for c in [*keys, order_col]]
    split = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return materialize(split.withColumn("_range", F.spark_partition_id()), "ranged")


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    by: list[str] | tuple = (), ranges: int | None = None) -> DataFrame:
    """Exact quantiles → ``(by…, column, prob, value)``; NULLs are skipped."""
    by = list(by)
    keys = by + ["column"]
    long = to_long(df, columns, by).where(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = ranged(long.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n")), keys, "v", ranges)

    wanted = F.array(*[F.lit(float(p)) for p in probs])

    def pos(p: Column) -> Column:
        return p * (F.col("_N") - 1)

    def wanted_in(start: Column, end: Column) -> Column:
        def inside(r: Column) -> Column:
            return (start <= r) & (r < end)
        return F.filter(wanted, lambda p: inside(F.floor(pos(p))) | inside(F.ceil(pos(p))))

    totals = counts.groupBy(*keys, "_range").agg(F.sum("n").alias("_bn"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_range", "_bn",
                           F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"),
                           F.sum("_bn").over(Window.partitionBy(*keys)).alias("_N"))
    held = totals.where(F.size(wanted_in(F.col("_off"), F.col("_off") + F.col("_bn"))) > 0).drop("_bn")

    upto = Window.partitionBy(*keys, "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (counts.join(held, keys + ["_range"])
              .withColumn("_end", F.col("_off") + F.sum("n").over(upto))      # ranks [start, end)
              .withColumn("_start", F.col("_end") - F.col("n")))
    hits = (ranked.withColumn("_hits", wanted_in(F.col("_start"), F.col("_end"))).where(F.size("_hits") > 0)
            .select(*keys, "v", "_start", "_end", "_N", F.explode("_hits").alias("prob")))
    p = pos(F.col("prob"))

    def at(r: Column) -> Column:
        return F.max(F.when((F.col("_start") <= r) & (r < F.col("_end")), F.col("v")))

    agg = hits.groupBy(*keys, "prob").agg(at(F.floor(p)).alias("_lo"), at(F.ceil(p)).alias("_hi"), F.max("_N").alias("_N"))
    return agg.select(*keys, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (p - F.floor(p))).alias("value"))


def approx_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                     by: list[str] | tuple = (), accuracy: int = 10000) -> DataFrame:
    """Sketch quantiles (``percentile_approx``: bounded memory, one partial
    aggregation, rank error ≈ 1/accuracy) in the shape of ``exact_quantiles``."""
    by = list(by)
    keys = by + ["column"]
    long = to_long(df, columns, by).where(F.col("v").isNotNull() & ~F.isnan("v"))
    qs = long.groupBy(*keys).agg(
        F.percentile_approx("v", [float(p) for p in probs], accuracy).alias("_q"))
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("_q").alias("value"))
    return qs.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.prob", "_p.value")


def column_modes_df(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mode): most frequent non-null value, smallest value on ties.
    Distinct (column, value) pairs are counted with a map-side combine."""
    long = to_long(df, columns, cast="string").where(F.col("v").isNotNull())
    counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.min_by("v", F.struct((-F.col("n")).alias("k"), F.col("v").alias("t"))).alias("mode"))


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Collected ``column_modes_df`` (one value per column)."""
    if not columns:
        return {}
    return {r["column"]: r["mode"] for r in column_modes_df(df, columns).collect()}


def running_totals(df: DataFrame, keys: list[str], order_col: str, sum_cols: list[str],
                   bucket: Column, descending: bool = False, prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``sum_cols`` along ``order_col`` within ``keys``.

    ``bucket`` must be monotone in ``order_col`` (same direction); rows are
    cumulated inside a bucket and shifted by the total of earlier buckets,
    which is a window over (keys × buckets) rows only.
    """
    keys = list(keys)
    d = df.withColumn("_b", bucket)
    totals = d.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sum_cols)])
    border = F.col("_b").desc() if descending else F.col("_b").asc()
    before = Window.partitionBy(*keys).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", *[
        F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}")
        for i in range(len(sum_cols))])
    oorder = F.col(order_col).desc() if descending else F.col(order_col).asc()
    upto = Window.partitionBy(*keys, "_b").orderBy(oorder).rowsBetween(Window.unboundedPreceding, 0)
    j = d.join(offsets, keys + ["_b"])
    return j.select(*[c for c in d.columns if c != "_b"], *[
        (F.col(f"_o{i}") + F.sum(c).over(upto)).alias(prefix + c) for i, c in enumerate(sum_cols)])


_MOMENTS = "part int, n binary, x binary, y binary, xx binary, yy binary, xy binary"


def _task_moments(batches):
    """One row a task: counts, means and centred sums of each pair of columns over the rows that have both."""
    total = None
    for b in batches:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns], axis=1)
        there = ~np.isnan(x)
        m = there.astype(np.float64)
        n = m.T @ m
        shift = np.where(there.any(axis=0), np.nansum(x, axis=0) / np.maximum(there.sum(axis=0), 1), 0.0)
        v = np.where(there, x - shift, 0.0)     # near zero, so that the products below lose no digits
        safe = np.maximum(n, 1.0)
        sx, sy = v.T @ m, m.T @ v
        sxx, syy = (v * v).T @ m, m.T @ (v * v)
        one = (n, sx / safe + shift[:, None], sy / safe + shift[None, :], sxx - sx * sx / safe, syy - sy * sy / safe, v.T @ v - sx * sy / safe)
        total = one if total is None else _merged_moments(total, one)
    if total is not None:
        yield _moment_row(0, total)


def _merged_moments(a, b):
    """Moments of two sets of rows together (pairwise update of centred sums)."""
    n = a[0] + b[0]
    safe = np.maximum(n, 1.0)
    dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * b[0] / safe
    return (n, np.where(a[0] > 0, a[1] + dx * b[0] / safe, b[1]), np.where(a[0] > 0, a[2] + dy * b[0] / safe, b[2]),
            a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w)


def _moment_row(part: int, m) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in m]],
                                      names=[c.split()[0] for c in _MOMENTS.split(", ")])


def _merge_moments(key, t):
    total = None
    for r in t.to_pylist():
        one = tuple(np.frombuffer(r[c]) for c in ("n", "x", "y", "xx", "yy", "xy"))
        total = one if total is None else _merged_moments(total, one)
    return pa.Table.from_batches([_moment_row(int(key[0].as_py()), total)])


def co_moments(df: DataFrame, columns: list[str], parts: int = 64) -> DataFrame:
    """(col_a, col_b, n, mean_a, mean_b, var_a, var_b, cov) of every pair a before b, population moments over the rows where both are
    present. One pass: a task adds up masked Gram sums and hands on one row, which are merged in ``parts`` groups and then in one."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    schema = "col_a string, col_b string, n long, mean_a double, mean_b double, var_a double, var_b double, cov double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    k = len(columns)

    def unfold(batches):
        for b in batches:
            for r in b.to_pylist():
                n, x, y, xx, yy, xy = (np.frombuffer(r[c]).reshape(k, k) for c in ("n", "x", "y", "xx", "yy", "xy"))
                rows = [(columns[i], columns[j], int(n[i, j]), *([float(v[i, j]) for v in (x, y)] + [float(v[i, j] / n[i, j]) for v in (xx, yy, xy)]
                                                               if n[i, j] else [None] * 5)) for i, j in pairs]
                yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in rows], schema=types)

    names = [c.split()[0] for c in schema.split(", ")]
    types = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[t]) for c, t in (f.split() for f in schema.split(", "))])
    task = df.select(*[qcol(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(_task_moments, _MOMENTS)
    some = task.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts))).groupBy("part").applyInArrow(_merge_moments, _MOMENTS)
    return some.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(_merge_moments, _MOMENTS).mapInArrow(unfold, schema)


def pairwise_corr(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long Pearson matrix ``(col_a, col_b, r)`` for pairs a < b by position, on rows where both are present; NULL for a
    constant column and for a table without rows (then no pair is listed)."""
    r = F.try_divide(F.col("cov"), F.sqrt("var_a") * F.sqrt("var_b"))
    return co_moments(df, columns).select("col_a", "col_b", r.alias("r"))


def kth_smallest(df: DataFrame, group: str | None, text: str, ranks: dict, digits: int = 3, few: int = 20_000) -> dict:
    """{group value: [the k-th smallest ``text`` for each k in ``ranks[group value]``]} of hexadecimal texts of one
    length (hashes), k from 1, without a sort: rows are counted by their first digits, and only the range that
    holds a rank is counted by further digits, until it has few rows. All ranks of all groups share a pass over the
    rows a round, and one for the last few rows. Bounds on the driver: 16 ** digits counts a rank and round, ``few`` rows a rank.
    A rank of 0 gives the empty text, one beyond the last row the last."""
    g = qcol(group) if group else F.lit(0)
    found = {(value, k): "" for value, ks in ranks.items() for k in ks}
    open_ = {at: ("", 0) for at in found if at[1] > 0}  # rank: first digits, rows before them
    last: dict = {}                                     # rank: first digits of few rows, rows before them

    def held(some: dict) -> DataFrame:
        """The rows of the groups and first digits of ``some`` ranks."""
        wanted: dict = {}
        for (value, _), (prefix, _) in some.items():
            wanted.setdefault(value, set()).add(prefix)
        mine = [g.eqNullSafe(F.lit(value)) & F.substring(qcol(text), 1, len(next(iter(p)))).isin(sorted(p))
                for value, ps in wanted.items() for p in ({x for x in ps if len(x) == n} for n in sorted({len(x) for x in ps}))]
        return df.select(g.alias("g"), qcol(text).alias("t")).where(reduce(or_, mine))

    while open_:
        size = len(next(iter(open_.values()))[0]) + digits  # all open ranks have as many digits
        counts: dict = {}
        for r in held(open_).groupBy("g", F.substring("t", 1, size).alias("d")).count().collect():
            counts.setdefault(r["g"], []).append((r["d"], r["count"]))
        now, open_ = open_, {}
        for (value, k), (prefix, before) in now.items():
            some = sorted(c for c in counts.get(value, ()) if c[0].startswith(prefix))
            for d, n in some:
                if before + n >= k or d == some[-1][0]:
                    break
                before += n
            if not some or d == prefix:  # no rows, or all that are left share one text
                found[value, k] = prefix
            elif n <= few:
                last[value, k] = (d, before)
            else:
                open_[value, k] = (d, before)
    if last:
        texts: dict = {}
        for r in held(last).collect():
            texts.setdefault(r["g"], []).append(r["t"])
        for (value, k), (prefix, before) in last.items():
            some = sorted(t for t in texts[value] if t.startswith(prefix))
            found[value, k] = some[min(k - before, len(some)) - 1]
    return {value: [found[value, k] for k in ks] for value, ks in ranks.items()}
