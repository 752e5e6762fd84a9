"""Chart-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.stats import pairwise_corr
from quarry.operators import charts
from quarry.plans.catalog import register
from quarry.plans.feature_queries import FEATURES
from quarry.plans.oracle_base import over_processed, q
from quarry.plans.stages import processed, processed_with_meta


def _hist_sql(col: str, bins: int, by: str | None, clip: tuple | None = None) -> str:
    g = f"{by} AS g, " if by else "0 AS g, "
    ret_g = f"s.g AS {by}, " if by else ""
    v = f"CAST({q(col)} AS DOUBLE)"
    if clip is not None:
        v = f"least(greatest({v}, {float(clip[0])}), {float(clip[1])})"
    return f"""
WITH hv AS (SELECT {g}{v} AS v FROM processed WHERE {q(col)} IS NOT NULL),
hr AS (SELECT g, min(v) AS lo, max(v) AS hi, count(*) AS n FROM hv GROUP BY g),
hc AS (SELECT hv.g, CASE WHEN hr.hi - hr.lo = 0 THEN 0
         ELSE least(CAST(floor((hv.v - hr.lo) / (hr.hi - hr.lo) * {bins}) AS INTEGER), {bins - 1}) END AS bin,
       count(*) AS count FROM hv JOIN hr ON hv.g = hr.g GROUP BY 1, 2),
hs AS (SELECT hr.*, CAST(b.bin AS INTEGER) AS bin FROM hr, (SELECT unnest(range({bins})) AS bin) b)
SELECT {ret_g}s.bin, round(s.lo + s.bin * ((s.hi - s.lo) / {bins}), 6) AS bin_lo,
  round(s.lo + (s.bin + 1) * ((s.hi - s.lo) / {bins}), 6) AS bin_hi,
  CAST(coalesce(c.count, 0) AS BIGINT) AS count,
  round(CASE WHEN s.hi = s.lo THEN NULL ELSE coalesce(c.count, 0) / (s.n * ((s.hi - s.lo) / {bins})) END, 6) AS density
FROM hs s LEFT JOIN hc c ON c.g = s.g AND c.bin = s.bin"""


def _round_hist(df):
    return df.select(*[F.round(c, 6).alias(c) if c in ("bin_lo", "bin_hi", "density") else F.col(c)
                       for c in df.columns])


@register("histogram", over_processed(_hist_sql("Temperature(F)", 50, None)))
def histogram(spark, sf_dir):
    """H1: 50 equal-width temperature bins, zero-filled."""
    return _round_hist(charts.histogram(processed(spark, sf_dir), "Temperature(F)", 50))


@register("visibility_histogram", over_processed(_hist_sql("Visibility(mi)", 40, None, (0, 15))))
def visibility_histogram(spark, sf_dir):
    """H1 + C8: visibility clipped to 0–15 mi, 40 bins."""
    return _round_hist(charts.histogram(processed(spark, sf_dir), "Visibility(mi)", 40, clip=(0, 15)))


@register("wind_histogram", over_processed(_hist_sql("Wind_Speed(mph)", 40, None, (0, 60))))
def wind_histogram(spark, sf_dir):
    """H1 + C8: wind speed clipped to 0–60 mph, 40 bins."""
    return _round_hist(charts.histogram(processed(spark, sf_dir), "Wind_Speed(mph)", 40, clip=(0, 60)))


_DAYS = "['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']"


@register("key_findings", over_processed(f"""
WITH n AS (SELECT count(*) AS n, avg(target) AS rate,
             avg(CAST(Sunrise_Sunset = 'Day' AS DOUBLE)) AS day FROM processed),
sv AS (SELECT Severity, count(*) AS c FROM processed GROUP BY Severity ORDER BY c DESC, Severity LIMIT 1),
hr AS (SELECT hour, count(*) AS c FROM processed GROUP BY hour ORDER BY c DESC, hour LIMIT 2),
dw AS (SELECT day_of_week, count(*) AS c FROM processed GROUP BY day_of_week ORDER BY c DESC, day_of_week LIMIT 1)
SELECT 'dominant_severity' AS finding, CAST(Severity AS VARCHAR) AS value FROM sv
UNION ALL SELECT 'dominant_severity_share_pct', printf('%.2f', sv.c / n.n * 100) FROM sv, n
UNION ALL SELECT 'target_rate_pct', printf('%.2f', rate * 100) FROM n
UNION ALL SELECT 'peak_hours', string_agg(CAST(hour AS VARCHAR), ' and ' ORDER BY c DESC, hour) FROM hr
UNION ALL SELECT 'busiest_weekday', {_DAYS}[day_of_week + 1] FROM dw
UNION ALL SELECT 'daylight_share_pct', printf('%.2f', day * 100) FROM n"""))
def key_findings(spark, sf_dir):
    """H6: headline findings of the report."""
    return charts.key_findings(processed(spark, sf_dir))


@register("density_by_class", over_processed(_hist_sql("duration_min", 50, "target")))
def density_by_class(spark, sf_dir):
    """H2: duration density per class, each class over its own range."""
    return _round_hist(charts.histogram(processed(spark, sf_dir), "duration_min", 50, by="target"))


CORR_COLUMNS = ["Severity", "Distance(mi)", "Temperature(F)", "Humidity(%)", "Pressure(in)",
                "Visibility(mi)", "Wind_Speed(mph)", "Precipitation(in)", "hour", "month",
                "duration_min", "weather_severity_score", "road_feature_count", "target"]


def _corr_sql(a: str, b: str) -> str:
    c = f"corr(CAST({q(a)} AS DOUBLE), CAST({q(b)} AS DOUBLE))"
    return f"CASE WHEN isnan({c}) THEN NULL ELSE round({c}, 6) END"


@register("corr_long", over_processed("\nUNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_corr_sql(a, b)} AS r FROM processed"
    for i, a in enumerate(CORR_COLUMNS) for b in CORR_COLUMNS[i + 1:])))
def corr_long(spark, sf_dir):
    """Pearson matrix (upper triangle, long form)."""
    out = pairwise_corr(processed(spark, sf_dir), CORR_COLUMNS)
    return out.withColumn("r", F.round("r", 6))


@register("target_corr", over_processed(
    "SELECT feature, r FROM (" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, {_corr_sql(c, 'target')} AS r FROM processed" for c in FEATURES)
    + ") ORDER BY abs(r) DESC NULLS LAST, feature LIMIT 20"))
def target_corr(spark, sf_dir):
    """Of all selected features (P7), the 20 most correlated with the target (by |r|)."""
    df, _, feats = processed_with_meta(spark, sf_dir)
    r = pairwise_corr(df, [*feats, "target"]).where("col_b = 'target'")
    out = r.select(F.col("col_a").alias("feature"), F.round("r", 6).alias("r"))
    return out.orderBy(F.abs("r").desc_nulls_last(), "feature").limit(20)


@register("map_points", over_processed(
    "SELECT ID, Start_Lat, Start_Lng, Severity, City, State FROM processed "
    "WHERE Start_Lat IS NOT NULL AND Start_Lng IS NOT NULL ORDER BY md5('42:' || ID), ID LIMIT 50000"))
def map_points(spark, sf_dir):
    """H3: reproducible 50,000-point sample for a map."""
    return charts.map_points(processed(spark, sf_dir), 50_000)
