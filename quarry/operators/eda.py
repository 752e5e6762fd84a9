"""Exploratory aggregates (A1–A19), top-k (T1–T5), grids and semi-joins (J1–J7),
hash sampling (SM2).

All are single ``groupBy`` jobs (partial aggregation before the shuffle) or
compositions of them; nothing ranks or windows over un-aggregated rows.
Grouping keys that can be NULL are filtered first (the reference drops NULL
groups).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.stats import kth_smallest, exact_quantiles, qcol

DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _nn(df: DataFrame, keys) -> DataFrame:
    cond = None
    for k in keys:
        c = qcol(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df


# ------------------------------------------------------------------ A1 / T1
def value_counts(df: DataFrame, col: str, normalize: bool = False, name: str = "count") -> DataFrame:
    """A1: (value, count[, share]). The share divides by a one-row total
    joined on a constant key (no un-partitioned window over the values)."""
    out = _nn(df, [col]).groupBy(qcol(col).alias(col)).agg(F.count(F.lit(1)).alias(name))
    if normalize:
        total = out.agg(F.sum(name).alias("_total")).withColumn("_k", F.lit(1))
        out = out.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k") \
            .select(qcol(col), name, (F.col(name) / F.col("_total")).alias("share"))
    return out


def top_k(df: DataFrame, col: str, k: int, name: str = "count") -> DataFrame:
    """K most frequent values; ties by value ascending (TakeOrderedAndProject)."""
    return value_counts(df, col, name=name).orderBy(F.col(name).desc(), qcol(col)).limit(k)


# ------------------------------------------------------------------ A2–A7
def counts_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """A3 (and friends): row count per key combination."""
    return _nn(df, keys).groupBy(*[qcol(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"))


def mean_and_count(df: DataFrame, key: str, value: str = "Severity",
                   key_alias: str | None = None, mean_alias: str = "avg_severity",
                   digits: int | None = None) -> DataFrame:
    """One aggregation gives both the count and the mean."""
    mean = F.avg(qcol(value))
    if digits is not None:
        mean = F.round(mean, digits)
    return _nn(df, [key]).groupBy(qcol(key).alias(key_alias or key)).agg(
        mean.alias(mean_alias), F.count(F.lit(1)).alias("count"))


def monthly_counts(df: DataFrame) -> DataFrame:
    """A5: count per year-month with a ``YYYY-MM`` period label."""
    g = counts_by(df, ["year", "month"])
    return g.select(F.concat_ws("-", F.col("year").cast("string"),
                                F.lpad(F.col("month").cast("string"), 2, "0")).alias("period"), "count")


def dataset_stats(df: DataFrame, top_states: int = 10) -> DataFrame:
    """A2: tidy (metric, key, value) rows: total, by severity, top states,
    mean temperature and visibility (2 dp), first and last year."""
    g = df.agg(
        F.count(F.lit(1)).cast("double").alias("total"),
        F.round(F.avg(qcol("Temperature(F)")), 2).alias("avg_temperature"),
        F.round(F.avg(qcol("Visibility(mi)")), 2).alias("avg_visibility"),
        F.min("year").cast("double").alias("year_min"),
        F.max("year").cast("double").alias("year_max"))
    overall = g.unpivot([], ["total", "avg_temperature", "avg_visibility", "year_min", "year_max"],
                        "metric", "value").select("metric", F.lit(None).cast("string").alias("key"), "value")
    sev = value_counts(df, "Severity").select(
        F.lit("by_severity").alias("metric"), F.col("Severity").cast("string").alias("key"),
        F.col("count").cast("double").alias("value"))
    st = top_k(df, "State", top_states).select(
        F.lit("by_state").alias("metric"), F.col("State").alias("key"), F.col("count").cast("double").alias("value"))
    return overall.unionByName(sev).unionByName(st)


# ------------------------------------------------------------------ A8 / A9
def marginal_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per value of each key in one pass (GROUPING SETS)."""
    sets = ", ".join(f"(`{k}`)" for k in keys)
    which = " ".join(f"WHEN grouping(`{k}`) = 0 THEN '{k}'" for k in keys)
    val = " ".join(f"WHEN grouping(`{k}`) = 0 THEN CAST(`{k}` AS INT)" for k in keys)
    return df.sparkSession.sql(
        f"SELECT CASE {which} END AS dimension, CASE {val} END AS value, count(*) AS count "
        f"FROM {{t}} GROUP BY GROUPING SETS ({sets})", t=df.select(*[qcol(k) for k in keys])) \
        .where(F.col("value").isNotNull())


def marginal_means(df: DataFrame, keys: list[str], value: str = "Severity") -> DataFrame:
    """Mean of ``value`` per value of each key, one GROUPING SETS pass."""
    sets = ", ".join(f"(`{k}`)" for k in keys)
    which = " ".join(f"WHEN grouping(`{k}`) = 0 THEN '{k}'" for k in keys)
    val = " ".join(f"WHEN grouping(`{k}`) = 0 THEN CAST(`{k}` AS STRING)" for k in keys)
    return df.sparkSession.sql(
        f"SELECT CASE {which} END AS dimension, CASE {val} END AS value, "
        f"avg(`{value}`) AS mean_value, count(*) AS count "
        f"FROM {{t}} GROUP BY GROUPING SETS ({sets})",
        t=df.select(*[qcol(k) for k in keys], qcol(value))).where(F.col("value").isNotNull())


# ------------------------------------------------------------------ A10 / A11
def flag_stats(df: DataFrame, flags: list[str], value: str = "Severity", digits: int = 3) -> DataFrame:
    """A10: per true flag, row count and mean severity, sorted by count."""
    present = [f for f in flags if f in df.columns]
    long = df.select(qcol(value).alias("_v"), *[F.coalesce(qcol(f), F.lit(False)).alias(f) for f in present]) \
        .unpivot(["_v"], present, "flag", "is_set")
    return long.where("is_set").groupBy("flag").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("_v"), digits).alias("avg_severity"))


def rate_by(df: DataFrame, key: str, target: str = "target") -> DataFrame:
    """High-severity rate (%) per key."""
    return _nn(df, [key]).groupBy(key).agg((F.avg(target) * 100).alias("high_severity_rate"),
                                           F.count(F.lit(1)).alias("count"))


# ------------------------------------------------------------------ A12–A15, J4, J5
def _literal_rows(df: DataFrame, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small literal table (JVM-side, no Python data transfer), typed like ``df``'s columns."""
    structs = [F.struct(*[F.lit(v).cast(df.schema[n].dataType).alias(n) for n, v in zip(names, r)]) for r in rows]
    return df.sparkSession.range(1).select(F.explode(F.array(*structs)).alias("_r")).select(
        *[F.col("_r")[n].alias(n) for n in names])


def zero_filled_grid(df: DataFrame, row_key: str, col_key: str,
                     row_values: list | None = None, col_values: list | None = None) -> DataFrame:
    """Counts for every (row, col) combination, zero where absent.

    The spine comes from given lists or from the aggregate's own keys, on the
    executors: its distinct rows, each exploded over the one array of its
    distinct columns. The data are read by the aggregate only."""
    agg = counts_by(df, [row_key, col_key])
    if row_values is not None:
        rows = _literal_rows(df, [row_key], [(v,) for v in row_values])
    else:
        rows = agg.select(row_key).where(qcol(row_key).isNotNull()).distinct()
    if col_values is not None:
        cols = F.explode(F.array(*[F.lit(v).cast(df.schema[col_key].dataType) for v in col_values]))
        spine = rows.select(row_key, cols.alias(col_key))
    else:
        every = agg.where(qcol(col_key).isNotNull()).agg(F.collect_set(col_key).alias("_cols"))
        spine = rows.join(every).select(row_key, F.explode("_cols").alias(col_key))
    return spine.join(agg, [row_key, col_key], "left").withColumn(
        "count", F.coalesce(F.col("count"), F.lit(0)).cast("long"))


def pivot_counts(df: DataFrame, row_key: str, col_key: str, col_values: list,
                 prefix: str, row_values: list | None = None) -> DataFrame:
    """Wide pivot with a fixed column list, zero-filled; rows from a
    spine when given (J4) so absent rows still appear."""
    aggs = [F.count_if(F.col(col_key) == v).cast("long").alias(f"{prefix}{v}") for v in col_values]
    wide = _nn(df, [row_key]).groupBy(row_key).agg(*aggs)
    if row_values is None:
        return wide
    spine = _literal_rows(df, [row_key], [(v,) for v in row_values])
    out = spine.join(wide, row_key, "left")
    return out.select(row_key, *[F.coalesce(F.col(f"{prefix}{v}"), F.lit(0)).cast("long").alias(f"{prefix}{v}")
                                 for v in col_values])


def rollup_sum(agg: DataFrame, key: str, value: str = "count", name: str = "total") -> DataFrame:
    """Second-level sum over an aggregate."""
    return agg.groupBy(key).agg(F.sum(value).alias(name))


# ------------------------------------------------------------------ A16 / H6
def report_facts(df: DataFrame) -> DataFrame:
    """One row of headline facts (one quantile job + one aggregation)."""
    med = {r["column"]: r["value"] for r in
           exact_quantiles(df, ["Distance(mi)", "duration_min"], [0.5]).collect()}
    n = F.count(F.lit(1))
    pos = F.count_if(F.col("target") == 1)
    facts = df.agg(
        n.alias("n_rows"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.avg("target").alias("target_rate"),
        F.avg(F.col("month").isin(12, 1, 2).cast("double")).alias("winter_share"),
        F.avg((F.col("Sunrise_Sunset") == "Day").cast("double")).alias("daylight_share"),
        F.try_divide((n - pos).cast("double"), pos.cast("double")).alias("imbalance_ratio"))
    return facts.select("*", F.lit(med.get("Distance(mi)")).cast("double").alias("median_distance"),
                        F.lit(med.get("duration_min")).cast("double").alias("median_duration"))


def arg_max(df: DataFrame, key: str, value: str = "count", k: int = 1) -> DataFrame:
    """T4: the k keys with the largest value (ties: smaller key first)."""
    return df.orderBy(F.col(value).desc(), qcol(key)).limit(k)


# ------------------------------------------------------------------ T2 / J3
def top_cities(df: DataFrame, n: int = 15) -> DataFrame:
    """N ∈ [5, 50]; label ``City, State``; ties by (City, State)."""
    if not 5 <= n <= 50:
        raise ValueError("top_n must be within [5, 50]")
    g = counts_by(df, ["City", "State"])
    return g.orderBy(F.col("count").desc(), "City", "State").limit(n).select(
        F.concat_ws(", ", "City", "State").alias("city_state"), "count")


def semi_join_top(df: DataFrame, col: str, k: int) -> DataFrame:
    """Rows whose ``col`` is among the top-k values; the k-row side is broadcast."""
    top = top_k(df, col, k).select(col)
    return df.join(F.broadcast(top), col, "left_semi")


# ------------------------------------------------------------------ A17–A19
def box_stats(df: DataFrame, value: str, by: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles per group, whiskers at the furthest points inside the
    1.5·IQR fences, outlier count. Quantiles per group come from the
    distributed exact-quantile job; the per-group fences (one row per group)
    join back for a second aggregation."""
    d = df.select(qcol(by).alias(by), qcol(value).cast("double").alias("_v")).where(
        F.col(by).isNotNull() & F.col("_v").isNotNull())
    q = exact_quantiles(d, ["_v"], [0.25, 0.5, 0.75], by=[by])
    qw = q.groupBy(by).agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"))
    qw = qw.withColumn("_lo", F.col("q1") - whisker * (F.col("q3") - F.col("q1"))) \
           .withColumn("_hi", F.col("q3") + whisker * (F.col("q3") - F.col("q1")))
    # Fences meet the distinct (group, value, count) table, not the rows:
    # same answer, and a hot group arrives already collapsed map-side.
    counts = d.groupBy(by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    j = counts.join(qw, by)
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    return j.groupBy(by).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("_n")).otherwise(0)).alias("n_outliers"),
        F.sum("_n").alias("count"))


def filter_flag(df: DataFrame, flag: str) -> DataFrame:
    """P10: rows where a boolean flag is true. ``flag = true`` drops NULL like
    a false flag, and unlike ``coalesce`` it is pushed into the parquet scan."""
    return df.where(qcol(flag) == F.lit(True))


# ------------------------------------------------------------------ SM2
def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """SM2: the n rows with the smallest md5(seed ‖ key): reproducible and independent of partitioning. The n-th
    smallest hash is found by counting, and a filter keeps the rows up to it: no sort, no single task.
    Keys are unique (rows that share the last one all stay); rows without key are left out."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), qcol(key).cast("string")))
    bound = kth_smallest(df.select(h.alias("_h")).where("_h IS NOT NULL"), None, "_h", {0: [n]})[0][0]
    return df.where(h <= F.lit(bound))
