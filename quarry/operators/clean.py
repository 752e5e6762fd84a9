"""Projections, filters and cleaning transforms.

The clean pipeline runs three small statistics jobs (null fractions,
quantiles, modes) whose results are bounded by the number of columns; all
row work stays in lazy DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.calendar import clip
from quarry.functions.stats import approx_quantiles, column_modes, exact_quantiles, qcol
from quarry.functions.text import standardise

# Fixed values from the reference configuration and rules.
DROP_THRESHOLD = 0.5
IQR_FACTOR = 3.0
LAT_RANGE = (24.0, 50.0)
LNG_RANGE = (-125.0, -66.0)
SEVERITY_RANGE = (1, 4)
CAP_COLUMNS = ["Distance(mi)", "Temperature(F)", "Humidity(%)", "Pressure(in)",
               "Visibility(mi)", "Wind_Speed(mph)", "Precipitation(in)"]
STRING_COLUMNS = ["City", "County", "Street", "Weather_Condition"]

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


# ---------------------------------------------------------------- C1
def dedup(df: DataFrame, key: str = "ID", order_by: str = "_order",
          keep_order: bool = False) -> DataFrame:
    """First row per key in ``order_by`` order.

    The winner per key is a fixed-width ``min(order)`` hash aggregation,
    combined map-side, so a key holding a third of the table costs one row
    per task in that shuffle. Rows are then kept by a semi-join on the pair
    (key, order), which is unique per row: the hot key's rows hash to many
    partitions, so the join is not skewed either. (``order_by`` must be
    unique per row, like a file position.)
    """
    first = df.groupBy(key).agg(F.min(qcol(order_by)).alias(order_by))
    out = df.join(first, [key, order_by], "left_semi")
    return out if keep_order else out.drop(order_by)


# ---------------------------------------------------------------- Q1 / P1
def null_fractions(df: DataFrame) -> dict[str, float]:
    """One pass: fraction of NULL (or NaN) per column, collected (≤ #columns values)."""
    aggs = []
    for f in df.schema.fields:
        c = qcol(f.name)
        missing = c.isNull()
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            missing = missing | F.isnan(c)
        aggs.append(F.avg(missing.cast("double")).alias(f.name))
    row = df.agg(*aggs).first()
    return {k: (row[k] if row[k] is not None else 0.0) for k in df.columns}


def drop_high_missing(df: DataFrame, threshold: float = DROP_THRESHOLD,
                      fractions: dict[str, float] | None = None) -> DataFrame:
    """Drop columns whose missing fraction is strictly above ``threshold``."""
    fr = fractions if fractions is not None else null_fractions(df)
    return df.drop(*[c for c, v in fr.items() if v > threshold])


# ---------------------------------------------------------------- P2–P6, P8, P10
def coordinates_ok(lat: str = "Start_Lat", lng: str = "Start_Lng") -> Column:
    return F.col(lat).between(*LAT_RANGE) & F.col(lng).between(*LNG_RANGE)


def severity_ok(col: str = "Severity") -> Column:
    return F.col(col).between(*SEVERITY_RANGE)


def validate_coordinates(df: DataFrame) -> DataFrame:
    """Inclusive lat/lng box; NULL coordinates are removed."""
    return df.where(coordinates_ok())


def validate_severity(df: DataFrame) -> DataFrame:
    """Label in [1, 4]."""
    return df.where(severity_ok())


def complete_cases(df: DataFrame, subset: list[str]) -> DataFrame:
    """Drop rows with a NULL in ``subset``."""
    return df.na.drop(subset=list(subset))


def zero_fill(df: DataFrame, subset: list[str]) -> DataFrame:
    """P6."""
    return df.fillna(0, subset=list(subset))


def align_features(df: DataFrame, expected: list[str], keep: list[str] = ()) -> DataFrame:
    """Project to ``expected`` in order; absent features become 0."""
    have = set(df.columns)
    cols = [qcol(c) for c in keep if c in have]
    cols += [(qcol(f) if f in have else F.lit(0)).cast("double").alias(f) for f in expected]
    return df.select(*cols)


# ---------------------------------------------------------------- C5 / C2 / C3 / C4
def iqr_bounds(q: dict, columns: list[str], factor: float) -> dict[str, tuple[float, float]]:
    out = {}
    for c in columns:
        q1, q3 = q.get((c, 0.25)), q.get((c, 0.75))
        if q1 is None or q3 is None:
            continue
        iqr = q3 - q1
        out[c] = (q1 - factor * iqr, q3 + factor * iqr)
    return out


def cap_outliers(df: DataFrame, bounds: dict[str, tuple[float, float]],
                 skip_zero_iqr: bool = False) -> DataFrame:
    """Clip to [Q1 − f·IQR, Q3 + f·IQR]; NULL stays NULL."""
    repl = {}
    for c, (lo, hi) in bounds.items():
        if skip_zero_iqr and lo == hi:
            continue
        repl[c] = clip(qcol(c), lo, hi).cast(df.schema[c].dataType).alias(c)
    return df.select(*[repl.get(c, qcol(c)) for c in df.columns])


def quartiles(df: DataFrame, columns: list[str], exact: bool = True) -> dict:
    """{(column, prob): value} for probs .25 .5 .75 — one distributed job
    (``exact=False``: sketch quantiles, cheaper on very large columns)."""
    if not columns:
        return {}
    q = (exact_quantiles if exact else approx_quantiles)(df, columns, [0.25, 0.5, 0.75])
    return {(r["column"], r["prob"]): r["value"] for r in q.collect()}


def remove_outliers(df: DataFrame, factor: float = IQR_FACTOR,
                    columns: list[str] = CAP_COLUMNS, skip_zero_iqr: bool = False) -> DataFrame:
    cols = [c for c in columns if c in df.columns]
    return cap_outliers(df, iqr_bounds(quartiles(df, cols), cols, factor), skip_zero_iqr)


def fill_values(df: DataFrame, values: dict) -> DataFrame:
    """Replace NULL by a per-column literal (C2 medians, C3 modes, C4 False)."""
    out = []
    for f in df.schema.fields:
        if f.name in values and values[f.name] is not None:
            out.append(F.coalesce(qcol(f.name), F.lit(values[f.name]).cast(f.dataType)).alias(f.name))
        else:
            out.append(qcol(f.name))
    return df.select(*out)


def impute_missing(df: DataFrame, medians: dict | None = None,
                   modes: dict | None = None, columns_with_nulls: list[str] | None = None) -> DataFrame:
    """Numeric → median, text → mode (smallest on ties), boolean → False."""
    if columns_with_nulls is None:
        fr = null_fractions(df)
        columns_with_nulls = [c for c, v in fr.items() if v > 0]
    nulls = set(columns_with_nulls)
    if medians is None:
        num = [c for c in numeric_columns(df) if c in nulls]
        q = quartiles(df, num) if num else {}
        medians = {c: q.get((c, 0.5)) for c in num}
    if modes is None:
        modes = column_modes(df, [c for c in string_columns(df) if c in nulls])
    values = dict(medians)
    values.update(modes)
    values.update({c: False for c in boolean_columns(df)})
    return fill_values(df, values)


# ---------------------------------------------------------------- C6 / C8
def clean_strings(df: DataFrame, columns: list[str] = STRING_COLUMNS) -> DataFrame:
    """Trim + title case."""
    cols = set(columns)
    return df.select(*[standardise(qcol(c)).alias(c) if c in cols else qcol(c) for c in df.columns])


def percentile_clip(df: DataFrame, column: str, lo_q: float = 0.01, hi_q: float = 0.99) -> DataFrame:
    """Clip a column to its own [1 %, 99 %] percentiles (one quantile job)."""
    q = exact_quantiles(df, [column], [lo_q, hi_q])
    vals = {r["prob"]: r["value"] for r in q.collect()}
    return df.withColumn(column, clip(qcol(column), vals.get(lo_q), vals.get(hi_q)))


# ---------------------------------------------------------------- C7
def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing: NULL in every floating-point column."""
    nan = {f.name: F.nullif(qcol(f.name), F.lit(float("nan")).cast(f.dataType))
           for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(nan) if nan else df


def filtered(df: DataFrame, drop_threshold: float = DROP_THRESHOLD, key: str = "ID",
             order_by: str = "_order", materialize_as: str | None = None):
    """dedup → P1 → P2 → P3; returns (frame, null fractions after dedup)."""
    from quarry.sources.sinks import materialize

    df = nan_to_null(df)
    d = dedup(df, key, order_by) if key in df.columns else df
    if materialize_as:
        d = materialize(d, materialize_as)
    fr = null_fractions(d)
    d = d.drop(*[c for c, v in fr.items() if v > drop_threshold])
    if "Start_Lat" in d.columns and "Start_Lng" in d.columns:
        d = validate_coordinates(d)
    if "Severity" in d.columns:
        d = validate_severity(d)
    return d, fr


def clean(df: DataFrame, drop_threshold: float = DROP_THRESHOLD, iqr_factor: float = IQR_FACTOR,
          key: str = "ID", order_by: str = "_order", materialize_as: str | None = "filtered",
          skip_zero_iqr: bool = False, exact: bool = True) -> DataFrame:
    """Reference order: dedup → P1 → P2 → P3 → C5 → C2/C3/C4 → C6.

    Capping is monotone and its bounds lie outside [Q1, Q3], so the median
    after capping equals the median before: one quantile job gives both the
    IQR bounds and the imputation medians.
    """
    d, fr = filtered(df, drop_threshold, key, order_by, materialize_as)
    return finish(d, fr, drop_threshold, iqr_factor, skip_zero_iqr, exact)


def finish(d: DataFrame, fr: dict[str, float], drop_threshold: float = DROP_THRESHOLD,
           iqr_factor: float = IQR_FACTOR, skip_zero_iqr: bool = False, exact: bool = True) -> DataFrame:
    """C5 → C2/C3/C4 → C6 on what :func:`filtered` returns."""
    nulls = {c for c, v in fr.items() if 0 < v <= drop_threshold}
    caps = [c for c in CAP_COLUMNS if c in d.columns]
    med_cols = [c for c in numeric_columns(d) if c in nulls]
    q = quartiles(d, sorted(set(caps) | set(med_cols)), exact)
    d = cap_outliers(d, iqr_bounds(q, caps, iqr_factor), skip_zero_iqr)
    modes = column_modes(d, [c for c in string_columns(d) if c in nulls])
    medians = {c: q.get((c, 0.5)) for c in med_cols}
    d = impute_missing(d, medians=medians, modes=modes, columns_with_nulls=sorted(nulls))
    return clean_strings(d)
