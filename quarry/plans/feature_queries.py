"""Feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.stats import qcol
from quarry.plans.catalog import register
from quarry.plans.oracle_base import ENCODED, over_processed, q
from quarry.plans.stages import processed, processed_with_meta


@register("temporal_features", over_processed(
    "SELECT ID, hour, day_of_week, month, year, is_weekend, is_rush_hour, is_night, season, "
    "round(duration_min, 6) AS duration_min FROM processed"))
def temporal_features(spark, sf_dir):
    """F1–F4."""
    return processed(spark, sf_dir).select(
        "ID", "hour", "day_of_week", "month", "year", "is_weekend", "is_rush_hour", "is_night", "season",
        F.round("duration_min", 6).alias("duration_min"))


@register("weather_features", over_processed(
    "SELECT ID, weather_severity_score, weather_category FROM processed"))
def weather_features(spark, sf_dir):
    """F5–F6."""
    return processed(spark, sf_dir).select("ID", "weather_severity_score", "weather_category")


@register("road_features", over_processed("SELECT ID, road_feature_count, target FROM processed"))
def road_features(spark, sf_dir):
    """F7 and F9."""
    return processed(spark, sf_dir).select("ID", "road_feature_count", "target")


@register("label_encode", over_processed("\nUNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS column, coalesce({q(c)}, 'nan') AS value, {q(c + '_enc')} AS code FROM processed"
    for c in ENCODED)))
def label_encode(spark, sf_dir):
    """F8: class list and code of every encoded column."""
    df, _, _ = processed_with_meta(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(qcol(c), F.lit("nan")).alias("value"),
                               F.col(c + "_enc").alias("code")) for c in ENCODED])
    return df.select(F.explode(pairs).alias("p")).select("p.*").distinct()


# Fixed: the feature list P7 yields on the processed table (checked in tests).
FEATURES = [
    "Start_Lat", "Start_Lng", "Distance(mi)", "Temperature(F)", "Humidity(%)", "Pressure(in)",
    "Visibility(mi)", "Wind_Speed(mph)", "Precipitation(in)", "Amenity", "Bump", "Crossing", "Give_Way",
    "Junction", "No_Exit", "Railway", "Roundabout", "Station", "Stop", "Traffic_Calming",
    "Traffic_Signal", "Turning_Loop", "hour", "day_of_week", "month", "year", "is_weekend",
    "is_rush_hour", "is_night", "season", "duration_min", "weather_severity_score",
    "road_feature_count", "State_enc", "Timezone_enc", "Wind_Direction_enc", "Sunrise_Sunset_enc",
    "Civil_Twilight_enc", "Nautical_Twilight_enc", "Astronomical_Twilight_enc", "Source_enc",
    "weather_category_enc"]
_BOOL = {"Amenity", "Bump", "Crossing", "Give_Way", "Junction", "No_Exit", "Railway", "Roundabout",
         "Station", "Stop", "Traffic_Calming", "Traffic_Signal", "Turning_Loop"}


def _feat_sql(c: str) -> str:
    if c in _BOOL:
        return f"CAST({q(c)} AS INTEGER) AS {q(c)}"
    return f"round(CAST({q(c)} AS DOUBLE), 6) AS {q(c)}"


@register("feature_table", over_processed(
    "SELECT ID, target, " + ", ".join(_feat_sql(c) for c in FEATURES) + " FROM processed"))
def feature_table(spark, sf_dir):
    """F10 + P7: model matrix (selected features in column order) and target."""
    df, _, feats = processed_with_meta(spark, sf_dir)
    cols = []
    for c in feats:
        if c in _BOOL:
            cols.append(qcol(c).cast("int").alias(c))
        else:
            cols.append(F.round(qcol(c).cast("double"), 6).alias(c))
    return df.select("ID", "target", *cols)
