"""Profiling and data-quality facts (Q1–Q10) as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.stats import exact_quantiles, qcol, to_long
from quarry.operators.clean import coordinates_ok, numeric_columns, severity_ok


def missing_fraction(df: DataFrame, only_positive: bool = True, percent: bool = False) -> DataFrame:
    """Q1: (column, missing_frac) sorted descending; one aggregation."""
    aggs = [F.avg(qcol(c).isNull().cast("double")).alias(f"_m{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("missing_frac"))
        for i, c in enumerate(df.columns)]))
    out = wide.select(stacked.alias("s")).select("s.column", "s.missing_frac")
    if percent:
        out = out.withColumn("missing_frac", F.col("missing_frac") * 100)
    if only_positive:
        out = out.where(F.col("missing_frac") > 0)
    return out.orderBy(F.col("missing_frac").desc(), "column")


def total_missing(df: DataFrame) -> DataFrame:
    """Q2: one row, total NULL cells."""
    total = None
    for c in df.columns:
        term = F.count_if(qcol(c).isNull())
        total = term if total is None else total + term
    return df.agg(total.cast("long").alias("missing_cells"))


def type_count_table(df: DataFrame) -> DataFrame:
    """Q3: (type, n_columns), from the schema alone."""
    from collections import Counter
    rows = sorted(Counter(t for _, t in df.dtypes).items())
    return df.sparkSession.createDataFrame(rows, "type string, n_columns long")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q4: count, mean, sample std, min, exact quartiles, max per numeric column."""
    cols = columns or numeric_columns(df)
    long = to_long(df, cols)
    basic = long.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    qw = q.groupBy("column").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q25"),
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("q50"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q75"))
    return basic.join(qw, "column", "left")


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q5: distinct count, top value (smallest on ties) and its count, per column.

    One shuffle of distinct (column, value) pairs, combined map-side."""
    long = to_long(df, columns, cast="string").where(F.col("v").isNotNull())
    counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.min_by("v", F.struct((-F.col("n")).alias("k"), F.col("v").alias("t"))).alias("top_value"),
        F.max("n").alias("top_count"))


def removed_rows(raw: DataFrame, key: str = "ID", order_by: str = "_order") -> DataFrame:
    """Q6: rows removed by each cleaning rule, applied in pipeline order
    (de-duplication first, then coordinates, then severity)."""
    from quarry.operators.clean import dedup
    dups = raw.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("_extra")).agg(
        F.lit("duplicates").alias("rule"), F.sum("_extra").cast("long").alias("removed_rows"))
    first = dedup(raw.select(key, order_by, "Start_Lat", "Start_Lng", "Severity"), key, order_by)
    coord = F.coalesce(coordinates_ok(), F.lit(False))
    sev_ok = F.coalesce(severity_ok(), F.lit(False))
    rules = first.agg(F.count_if(~coord).cast("long").alias("bad_coordinates"),
                      F.count_if(coord & ~sev_ok).cast("long").alias("bad_severity")) \
        .unpivot([], ["bad_coordinates", "bad_severity"], "rule", "removed_rows")
    return dups.unionByName(rules)


def constant_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q7: per numeric column min, max, whether constant and whether max is 0."""
    cols = columns or numeric_columns(df)
    long = to_long(df, cols)
    return long.groupBy("column").agg(F.min("v").alias("min"), F.max("v").alias("max")) \
        .withColumn("is_constant", F.coalesce(F.col("min") == F.col("max"), F.lit(True))) \
        .withColumn("max_is_zero", F.coalesce(F.col("max") == 0, F.lit(False)))


def period_caveat(df: DataFrame, ts: str = "Start_Time") -> DataFrame:
    """Q7: last year and month present (an incomplete last year is a caveat)."""
    return df.agg(F.year(F.max(ts)).alias("last_year"), F.month(F.max(ts)).alias("last_month"))


def missing_pattern(sample: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Q8: 0/1 NULL matrix of an (already sampled) frame; ``keep`` columns pass through."""
    return sample.select(*[qcol(c) for c in keep],
                         *[qcol(c).isNull().cast("int").alias(c) for c in sample.columns if c not in keep])


# The accepted range of each scoring-request field (None = open).
REQUEST_RULES = [
    ("hour", 0, 23), ("day_of_week", 0, 6), ("month", 1, 12), ("year", 2016, 2030),
    ("is_weekend", 0, 1), ("is_rush_hour", 0, 1), ("is_night", 0, 1), ("season", 0, 3),
    ("duration_min", 0, None), ("weather_severity_score", 0, 5), ("road_feature_count", 0, None),
    ("Distance(mi)", 0, None), ("Temperature(F)", None, None), ("Humidity(%)", 0, 100),
    ("Pressure(in)", None, None), ("Visibility(mi)", 0, None), ("Wind_Speed(mph)", 0, None),
    ("Precipitation(in)", 0, None),
]


def request_violations(df: DataFrame) -> DataFrame:
    """Q9: adds ``violations`` (array of failed field names; a missing field
    fails). ``rejected_requests`` keeps the rows with any."""
    checks = []
    for name, lo, hi in REQUEST_RULES:
        c = qcol(name) if name in df.columns else F.lit(None)
        ok = c.isNotNull()
        if lo is not None:
            ok = ok & (c >= lo)
        if hi is not None:
            ok = ok & (c <= hi)
        checks.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)))
    return df.withColumn("violations", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def rejected_requests(df: DataFrame) -> DataFrame:
    return request_violations(df).where(F.size("violations") > 0)


def shape(df: DataFrame) -> DataFrame:
    """Q10: row and column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
