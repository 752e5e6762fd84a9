"""EDA queries over the processed incident table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import eda
from quarry.plans.catalog import register
from quarry.plans.oracle_base import over_processed
from quarry.plans.stages import processed


@register("severity_by_hour", over_processed(
    "SELECT hour, Severity, count(*) AS count FROM processed GROUP BY hour, Severity"))
def severity_by_hour(spark, sf_dir):
    """A3."""
    return eda.counts_by(processed(spark, sf_dir), ["hour", "Severity"])


def _p(spark, sf_dir, cols=None):
    df = processed(spark, sf_dir)
    return df.select(*[F.col(f"`{c}`") for c in cols]) if cols else df


@register("severity_counts", over_processed(
    "SELECT Severity, count(*) AS count, count(*) / sum(count(*)) OVER () AS share "
    "FROM processed GROUP BY Severity"))
def severity_counts(spark, sf_dir):
    """A1 with shares."""
    return eda.value_counts(_p(spark, sf_dir), "Severity", normalize=True)


@register("target_share", over_processed(
    "SELECT target, count(*) AS count, count(*) / sum(count(*)) OVER () AS share "
    "FROM processed GROUP BY target"))
def target_share(spark, sf_dir):
    """F9 class shares (A1)."""
    return eda.value_counts(_p(spark, sf_dir), "target", normalize=True)


@register("stats", over_processed("""
SELECT 'total' AS metric, CAST(NULL AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM processed
UNION ALL SELECT 'avg_temperature', NULL, round(avg("Temperature(F)"), 2) FROM processed
UNION ALL SELECT 'avg_visibility', NULL, round(avg("Visibility(mi)"), 2) FROM processed
UNION ALL SELECT 'year_min', NULL, CAST(min(year) AS DOUBLE) FROM processed
UNION ALL SELECT 'year_max', NULL, CAST(max(year) AS DOUBLE) FROM processed
UNION ALL SELECT 'by_severity', CAST(Severity AS VARCHAR), CAST(count(*) AS DOUBLE) FROM processed GROUP BY Severity
UNION ALL SELECT * FROM (SELECT 'by_state', State, CAST(count(*) AS DOUBLE) FROM processed
  WHERE State IS NOT NULL GROUP BY State ORDER BY count(*) DESC, State LIMIT 10)"""))
def stats(spark, sf_dir):
    """A2."""
    return eda.dataset_stats(_p(spark, sf_dir))


@register("severity_by_state", over_processed(
    "SELECT State AS state, round(avg(Severity), 6) AS avg_severity, count(*) AS count "
    "FROM processed WHERE State IS NOT NULL GROUP BY State"))
def severity_by_state(spark, sf_dir):
    """A4."""
    return eda.mean_and_count(_p(spark, sf_dir), "State", key_alias="state", digits=6)


@register("over_time", over_processed(
    "SELECT CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS period, count(*) AS count "
    "FROM processed GROUP BY year, month"))
def over_time(spark, sf_dir):
    """A5."""
    return eda.monthly_counts(_p(spark, sf_dir))


@register("weather_impact", over_processed(
    "SELECT weather_severity_score AS weather_score, round(avg(Severity), 6) AS avg_severity, count(*) AS count "
    "FROM processed GROUP BY weather_severity_score"))
def weather_impact(spark, sf_dir):
    """A6."""
    return eda.mean_and_count(_p(spark, sf_dir), "weather_severity_score", key_alias="weather_score", digits=6)


@register("top_cities", over_processed(
    "SELECT City || ', ' || State AS city_state, count(*) AS count FROM processed "
    "WHERE City IS NOT NULL AND State IS NOT NULL GROUP BY City, State "
    "ORDER BY count(*) DESC, City, State LIMIT 15"))
def top_cities(spark, sf_dir):
    """T2 (n = 15)."""
    return eda.top_cities(_p(spark, sf_dir), 15)


@register("road_impact", over_processed(
    "SELECT road_feature_count AS feature_count, count(*) AS accident_count, "
    "round(avg(Severity), 3) AS avg_severity FROM processed GROUP BY road_feature_count"))
def road_impact(spark, sf_dir):
    """The count and mean come from one aggregation, no join."""
    return eda.mean_and_count(_p(spark, sf_dir), "road_feature_count", key_alias="feature_count",
                              digits=3).withColumnRenamed("count", "accident_count")


@register("marginals", over_processed("""
SELECT 'year' AS dimension, year AS value, count(*) AS count FROM processed GROUP BY year
UNION ALL SELECT 'month', month, count(*) FROM processed GROUP BY month
UNION ALL SELECT 'hour', hour, count(*) FROM processed GROUP BY hour
UNION ALL SELECT 'day_of_week', day_of_week, count(*) FROM processed GROUP BY day_of_week"""))
def marginals(spark, sf_dir):
    """Four marginal count tables in one GROUPING SETS pass."""
    return eda.marginal_counts(_p(spark, sf_dir), ["year", "month", "hour", "day_of_week"])


_MEAN_KEYS = ["hour", "day_of_week", "month", "season", "is_rush_hour", "weather_category", "road_feature_count"]


@register("mean_marginals", over_processed("\nUNION ALL ".join(
    f"SELECT '{k}' AS dimension, CAST({k} AS VARCHAR) AS value, round(avg(Severity), 6) AS mean_value, "
    f"count(*) AS count FROM processed WHERE {k} IS NOT NULL GROUP BY {k}" for k in _MEAN_KEYS)))
def mean_marginals(spark, sf_dir):
    """Mean severity per value of seven keys, one GROUPING SETS pass."""
    out = eda.marginal_means(_p(spark, sf_dir), _MEAN_KEYS)
    return out.withColumn("mean_value", F.round("mean_value", 6))


_FLAGS = ["Amenity", "Bump", "Crossing", "Give_Way", "Junction", "No_Exit", "Railway", "Roundabout",
          "Station", "Stop", "Traffic_Calming", "Traffic_Signal", "Turning_Loop"]


@register("flag_stats", over_processed("\nUNION ALL ".join(
    f"SELECT '{f}' AS flag, count(*) AS count, round(avg(Severity), 3) AS avg_severity "
    f"FROM processed WHERE {f} HAVING count(*) > 0" for f in _FLAGS)))
def flag_stats(spark, sf_dir):
    """A10."""
    return eda.flag_stats(_p(spark, sf_dir), _FLAGS)


@register("weather_rate", over_processed(
    "SELECT weather_category, round(avg(target) * 100, 6) AS high_severity_rate, count(*) AS count "
    "FROM processed GROUP BY weather_category"))
def weather_rate(spark, sf_dir):
    """A11."""
    out = eda.rate_by(_p(spark, sf_dir), "weather_category")
    return out.withColumn("high_severity_rate", F.round("high_severity_rate", 6))


_CATS = ["Snow/Ice", "Rain/Storm", "Fog/Haze", "Clear", "Cloudy", "Other"]


@register("weather_severity_grid", over_processed(
    "SELECT c.weather_category, s.Severity, CAST(coalesce(n.count, 0) AS BIGINT) AS count FROM "
    "(SELECT unnest(['" + "', '".join(_CATS) + "']) AS weather_category) c "
    "CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS Severity) s "
    "LEFT JOIN (SELECT weather_category, Severity, count(*) AS count FROM processed GROUP BY 1, 2) n "
    "ON n.weather_category = c.weather_category AND n.Severity = s.Severity"))
def weather_severity_grid(spark, sf_dir):
    """The full category × severity grid, zero-filled."""
    return eda.zero_filled_grid(_p(spark, sf_dir, ["weather_category", "Severity"]),
                                "weather_category", "Severity", _CATS, [1, 2, 3, 4])


@register("day_hour_pivot", over_processed(
    "SELECT d.day_of_week, " + ", ".join(
        f"CAST(coalesce(sum(CASE WHEN p.hour = {h} THEN 1 ELSE 0 END), 0) AS BIGINT) AS h{h}" for h in range(24))
    + " FROM (SELECT CAST(x AS INTEGER) AS day_of_week FROM (SELECT unnest(range(7)) AS x)) d "
    "LEFT JOIN processed p ON p.day_of_week = d.day_of_week "
    "GROUP BY d.day_of_week"))
def day_hour_pivot(spark, sf_dir):
    """Day × hour counts, every day row present, zero-filled."""
    return eda.pivot_counts(_p(spark, sf_dir, ["day_of_week", "hour"]), "day_of_week", "hour",
                            list(range(24)), "h", row_values=list(range(7)))


@register("severity_hour_pivot", over_processed(
    "SELECT Severity, " + ", ".join(
        f"CAST(sum(CASE WHEN hour = {h} THEN 1 ELSE 0 END) AS BIGINT) AS h{h}" for h in range(24))
    + " FROM processed GROUP BY Severity"))
def severity_hour_pivot(spark, sf_dir):
    """A14."""
    return eda.pivot_counts(_p(spark, sf_dir, ["Severity", "hour"]), "Severity", "hour", list(range(24)), "h")


@register("top_states", over_processed(
    "SELECT State, count(*) AS count FROM processed WHERE State IS NOT NULL GROUP BY State "
    "ORDER BY count(*) DESC, State LIMIT 15"))
def top_states(spark, sf_dir):
    """T1 (k = 15)."""
    return eda.top_k(_p(spark, sf_dir), "State", 15)


@register("hour_totals", over_processed(
    "SELECT hour, CAST(sum(count) AS BIGINT) AS total FROM (SELECT hour, Severity, count(*) AS count FROM processed "
    "GROUP BY hour, Severity) GROUP BY hour"))
def hour_totals(spark, sf_dir):
    """Roll-up of the hour × severity aggregate."""
    return eda.rollup_sum(eda.counts_by(_p(spark, sf_dir), ["hour", "Severity"]), "hour")


@register("peak_hours", over_processed(
    "SELECT hour, count(*) AS count FROM processed GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 2"))
def peak_hours(spark, sf_dir):
    """T4: the two peak hours."""
    return eda.arg_max(eda.counts_by(_p(spark, sf_dir), ["hour"]), "hour", k=2)


@register("report_facts", over_processed("""
SELECT count(*) AS n_rows, min(year) AS first_year, max(year) AS last_year,
  round(avg(target), 6) AS target_rate,
  round(avg(CAST(month IN (12, 1, 2) AS DOUBLE)), 6) AS winter_share,
  round(avg(CAST(Sunrise_Sunset = 'Day' AS DOUBLE)), 6) AS daylight_share,
  round(CAST(count(*) - count(*) FILTER (WHERE target = 1) AS DOUBLE) / count(*) FILTER (WHERE target = 1), 6)
    AS imbalance_ratio,
  round(quantile_cont("Distance(mi)", 0.5), 6) AS median_distance,
  round(quantile_cont(duration_min, 0.5), 6) AS median_duration
FROM processed"""))
def report_facts(spark, sf_dir):
    """A16."""
    out = eda.report_facts(_p(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if c in (
        "target_rate", "winter_share", "daylight_share", "imbalance_ratio", "median_distance",
        "median_duration") else F.col(c) for c in out.columns])


@register("top_weather_semi", over_processed(
    "SELECT ID, weather_category, Severity FROM processed WHERE weather_category IN ("
    "SELECT weather_category FROM processed GROUP BY weather_category "
    "ORDER BY count(*) DESC, weather_category LIMIT 3)"))
def top_weather_semi(spark, sf_dir):
    """Rows of the three most frequent weather categories."""
    df = _p(spark, sf_dir, ["ID", "weather_category", "Severity"])
    return eda.semi_join_top(df, "weather_category", 3)


@register("box_stats", over_processed("""
WITH bd AS (SELECT weather_category AS g, "Temperature(F)" AS v FROM processed WHERE "Temperature(F)" IS NOT NULL),
bq AS (SELECT g, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM bd GROUP BY g),
bf AS (SELECT d.g, d.v, q.q1, q.median, q.q3,
        d.v >= q.q1 - 1.5 * (q.q3 - q.q1) AND d.v <= q.q3 + 1.5 * (q.q3 - q.q1) AS inside
      FROM bd d JOIN bq q ON d.g = q.g)
SELECT g AS weather_category, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
  round(any_value(q3), 6) AS q3, min(v) FILTER (WHERE inside) AS whisker_low,
  max(v) FILTER (WHERE inside) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS n_outliers,
  count(*) AS count FROM bf GROUP BY g"""))
def box_stats(spark, sf_dir):
    """Temperature box statistics per weather category."""
    out = eda.box_stats(_p(spark, sf_dir), "Temperature(F)", "weather_category")
    return out.select("weather_category", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")],
                      "whisker_low", "whisker_high", "n_outliers", "count")


@register("top_weather", over_processed(
    "SELECT Weather_Condition, count(*) AS count FROM processed WHERE Weather_Condition IS NOT NULL "
    "GROUP BY Weather_Condition ORDER BY count(*) DESC, Weather_Condition LIMIT 10"))
def top_weather(spark, sf_dir):
    """T1 (k = 10) on the weather text."""
    return eda.top_k(_p(spark, sf_dir), "Weather_Condition", 10)


@register("top_city_states", over_processed(
    "SELECT State, CAST(sum(count) AS BIGINT) AS total FROM (SELECT City, State, count(*) AS count FROM processed "
    "WHERE City IS NOT NULL AND State IS NOT NULL GROUP BY City, State "
    "ORDER BY count(*) DESC, City, State LIMIT 20) GROUP BY State"))
def top_city_states(spark, sf_dir):
    """State totals over the 20 busiest cities."""
    top = eda.counts_by(_p(spark, sf_dir), ["City", "State"]).orderBy(
        F.col("count").desc(), "City", "State").limit(20)
    return eda.rollup_sum(top, "State")


@register("junction_severity", over_processed(
    "SELECT Severity, count(*) AS count FROM processed WHERE Junction GROUP BY Severity"))
def junction_severity(spark, sf_dir):
    """P10: incidents at junctions, by severity."""
    return eda.counts_by(eda.filter_flag(_p(spark, sf_dir, ["Junction", "Severity"]), "Junction"), ["Severity"])
