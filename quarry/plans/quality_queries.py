"""Profiling queries (Q1–Q10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import eda, quality
from quarry.operators.features import derive
from quarry.plans.catalog import register
from quarry.plans.oracle_base import (RAW_COLUMNS, over_cleaned, over_processed, over_raw, q)
from quarry.plans.stages import cleaned, processed, raw

_MEASURES = ["Distance(mi)", "Temperature(F)", "Humidity(%)", "Pressure(in)", "Visibility(mi)",
             "Wind_Speed(mph)", "Precipitation(in)", "duration_min"]
_CATEGORICAL = ["State", "City", "Weather_Condition", "Wind_Direction", "Timezone", "Source"]


@register("missing_fraction", over_raw(
    "SELECT * FROM (" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS column, round(avg(CAST({q(c)} IS NULL AS DOUBLE)), 6) AS missing_frac FROM raw"
        for c in RAW_COLUMNS) + ") WHERE missing_frac > 0"))
def missing_fraction(spark, sf_dir):
    """Q1 on the raw incident table."""
    out = quality.missing_fraction(raw(spark, sf_dir))
    return out.withColumn("missing_frac", F.round("missing_frac", 6))


@register("total_missing", over_raw(
    "SELECT CAST(" + " + ".join(f"count(*) FILTER (WHERE {q(c)} IS NULL)" for c in RAW_COLUMNS)
    + " AS BIGINT) AS missing_cells FROM raw"))
def total_missing(spark, sf_dir):
    """Q2."""
    return quality.total_missing(raw(spark, sf_dir))


@register("describe", over_processed("\nUNION ALL ".join(
    f"SELECT '{c}' AS column, count({q(c)}) AS count, round(avg({q(c)}), 6) AS mean, "
    f"round(stddev_samp({q(c)}), 6) AS std, min({q(c)}) AS min, round(quantile_cont({q(c)}, 0.25), 6) AS q25, "
    f"round(quantile_cont({q(c)}, 0.5), 6) AS q50, round(quantile_cont({q(c)}, 0.75), 6) AS q75, "
    f"max({q(c)}) AS max FROM processed" for c in _MEASURES)))
def describe(spark, sf_dir):
    """Q4 with exact quartiles."""
    out = quality.describe(processed(spark, sf_dir), _MEASURES)
    return out.select("column", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min",
                      *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "max")


@register("cardinality", over_cleaned("\nUNION ALL ".join(
    f"SELECT '{c}' AS column, (SELECT count(DISTINCT {q(c)}) FROM cleaned) AS n_unique, "
    f"{q(c)} AS top_value, count(*) AS top_count FROM cleaned WHERE {q(c)} IS NOT NULL "
    f"GROUP BY {q(c)} QUALIFY row_number() OVER (ORDER BY count(*) DESC, {q(c)}) = 1"
    for c in _CATEGORICAL)))
def cardinality(spark, sf_dir):
    """Q5 on the cleaned table."""
    return quality.cardinality(cleaned(spark, sf_dir), _CATEGORICAL)


@register("removed_rows", over_raw("""
WITH first AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY ID ORDER BY _order) = 1),
flags AS (SELECT coalesce(Start_Lat BETWEEN 24 AND 50 AND Start_Lng BETWEEN -125 AND -66, false) AS coord,
                 coalesce(Severity BETWEEN 1 AND 4, false) AS sev FROM first)
SELECT 'duplicates' AS rule, (SELECT count(*) FROM raw) - (SELECT count(*) FROM first) AS removed_rows
UNION ALL SELECT 'bad_coordinates', count(*) FILTER (WHERE NOT coord) FROM flags
UNION ALL SELECT 'bad_severity', count(*) FILTER (WHERE coord AND NOT sev) FROM flags"""))
def removed_rows(spark, sf_dir):
    """Q6: rows removed by de-duplication and by each validity rule."""
    return quality.removed_rows(raw(spark, sf_dir))


_NUMERIC_FEATURES = ["Severity", "Distance(mi)", "Temperature(F)", "Humidity(%)", "Pressure(in)",
                     "Visibility(mi)", "Wind_Speed(mph)", "Precipitation(in)", "hour", "day_of_week",
                     "month", "year", "season", "duration_min", "weather_severity_score",
                     "road_feature_count"]


@register("constant_columns", over_processed("\nUNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(min({q(c)}) AS DOUBLE) AS min, CAST(max({q(c)}) AS DOUBLE) AS max, "
    f"coalesce(min({q(c)}) = max({q(c)}), true) AS is_constant, coalesce(max({q(c)}) = 0, false) AS max_is_zero "
    f"FROM processed" for c in _NUMERIC_FEATURES)))
def constant_columns(spark, sf_dir):
    """Q7: constant columns and all-zero maxima (report caveats)."""
    return quality.constant_columns(processed(spark, sf_dir), _NUMERIC_FEATURES)


@register("period_caveat", over_raw(
    "SELECT CAST(year(max(Start_Time)) AS INTEGER) AS last_year, "
    "CAST(month(max(Start_Time)) AS INTEGER) AS last_month FROM raw"))
def period_caveat(spark, sf_dir):
    """Q7: last year/month present."""
    return quality.period_caveat(raw(spark, sf_dir))


_PATTERN_COLS = ["Street", "Temperature(F)", "Visibility(mi)", "Precipitation(in)", "Weather_Condition",
                 "Timezone", "Station", "County"]


@register("missing_pattern", over_raw(
    "SELECT _order, " + ", ".join(f"CAST({q(c)} IS NULL AS INTEGER) AS {q(c)}" for c in _PATTERN_COLS)
    + " FROM raw ORDER BY md5('42:' || CAST(_order AS VARCHAR)), _order LIMIT 500"))
def missing_pattern(spark, sf_dir):
    """Q8: 0/1 NULL matrix of a reproducible 500-row hash sample."""
    sample = eda.hash_sample(raw(spark, sf_dir).select("_order", *[F.col(f"`{c}`") for c in _PATTERN_COLS]),
                             "_order", 500)
    return quality.missing_pattern(sample, keep=["_order"])


_REQ = ("hour", "day_of_week", "month", "year", "is_weekend", "is_rush_hour", "is_night", "season",
        "duration_min", "weather_severity_score", "road_feature_count", "Distance(mi)", "Temperature(F)",
        "Humidity(%)", "Pressure(in)", "Visibility(mi)", "Wind_Speed(mph)", "Precipitation(in)")


# The request rules in SQL.
_REQ_RULES = {
    "hour": "hour BETWEEN 0 AND 23", "day_of_week": "day_of_week BETWEEN 0 AND 6", "month": "month BETWEEN 1 AND 12",
    "year": "year BETWEEN 2016 AND 2030", "is_weekend": "is_weekend BETWEEN 0 AND 1",
    "is_rush_hour": "is_rush_hour BETWEEN 0 AND 1", "is_night": "is_night BETWEEN 0 AND 1", "season": "season BETWEEN 0 AND 3",
    "duration_min": "duration_min >= 0", "weather_severity_score": "weather_severity_score BETWEEN 0 AND 5",
    "road_feature_count": "road_feature_count >= 0", "Distance(mi)": '"Distance(mi)" >= 0',
    "Temperature(F)": '"Temperature(F)" IS NOT NULL', "Humidity(%)": '"Humidity(%)" BETWEEN 0 AND 100',
    "Pressure(in)": '"Pressure(in)" IS NOT NULL', "Visibility(mi)": '"Visibility(mi)" >= 0',
    "Wind_Speed(mph)": '"Wind_Speed(mph)" >= 0', "Precipitation(in)": '"Precipitation(in)" >= 0',
}


def _req_sql() -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({_REQ_RULES[n]}, false) THEN '{n}' END" for n in _REQ) + ")"


@register("request_violations", over_raw(f"""
WITH r AS (SELECT ID, _order, "Distance(mi)", "Temperature(F)", "Humidity(%)", "Pressure(in)",
    "Visibility(mi)", "Wind_Speed(mph)", "Precipitation(in)",
    CAST(hour(Start_Time) AS INTEGER) AS hour, CAST(isodow(Start_Time) - 1 AS INTEGER) AS day_of_week,
    CAST(month(Start_Time) AS INTEGER) AS month, CAST(year(Start_Time) AS INTEGER) AS year,
    CAST(isodow(Start_Time) - 1 >= 5 AS INTEGER) AS is_weekend,
    CAST(hour(Start_Time) IN (7, 8, 9, 16, 17, 18) AS INTEGER) AS is_rush_hour,
    CAST(hour(Start_Time) < 6 OR hour(Start_Time) >= 21 AS INTEGER) AS is_night,
    CAST(floor((month(Start_Time) % 12) / 3) AS INTEGER) AS season,
    least(greatest(date_diff('microsecond', Start_Time, End_Time) / CAST(60000000 AS DOUBLE), 0), 1440) AS duration_min,
    0.0 AS weather_severity_score, 0 AS road_feature_count FROM raw),
v AS (SELECT _order, ID, {_req_sql()} AS violations FROM r)
SELECT _order, ID, violations FROM v WHERE violations <> ''"""))
def request_violations(spark, sf_dir):
    """Q9: raw incidents as scoring requests; rejected ones with the failed fields."""
    req = derive(raw(spark, sf_dir)).select("_order", "ID", *[F.col(f"`{c}`") for c in _REQ])
    out = quality.rejected_requests(req)
    return out.select("_order", "ID", F.array_join("violations", ",").alias("violations"))


@register("shape", over_cleaned(
    "SELECT count(*) AS n_rows, 42 AS n_columns FROM cleaned"))
def shape(spark, sf_dir):
    """Q10."""
    return quality.shape(cleaned(spark, sf_dir))
