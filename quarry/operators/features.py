"""Feature derivation (F1–F11, P7): one projection over the cleaned table plus
one fit (the table of label-encoder classes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import calendar as cal
from quarry.functions.stats import qcol, ranged, running_totals, to_long
from quarry.functions.weather import road_feature_count, weather_category, weather_score
from quarry.sources.incidents import ROAD_FLAGS

SEVERITY_THRESHOLD = 3
ENCODED = ["State", "Timezone", "Wind_Direction", "Sunrise_Sunset", "Civil_Twilight",
           "Nautical_Twilight", "Astronomical_Twilight", "Source", "weather_category"]
# Columns never used as model features.
EXCLUDE = {
    "ID", "Description", "Street", "City", "County", "Zipcode", "Airport_Code",
    "Start_Time", "End_Time", "Weather_Timestamp", "Country", "Severity", "target",
    "State", "Timezone", "Wind_Direction", "Sunrise_Sunset", "Civil_Twilight",
    "Nautical_Twilight", "Astronomical_Twilight", "Source", "Weather_Condition",
    "weather_category",
}


def temporal_features(df: DataFrame, start: str = "Start_Time", end: str = "End_Time") -> DataFrame:
    """F1–F4."""
    cols = cal.calendar_columns(F.col(start))
    out = df.select("*", *[c.alias(k) for k, c in cols.items()])
    if end in df.columns:
        out = out.withColumn("duration_min", cal.duration_min(F.col(start), F.col(end)))
    return out


def weather_features(df: DataFrame) -> DataFrame:
    """F5–F6."""
    out = df.withColumn("weather_severity_score", weather_score(df.columns))
    if "Weather_Condition" in df.columns:
        out = out.withColumn("weather_category", weather_category(F.col("Weather_Condition")))
    return out


def road_features(df: DataFrame) -> DataFrame:
    """F7."""
    return df.withColumn("road_feature_count", road_feature_count(df.columns, ROAD_FLAGS))


def build_target(df: DataFrame, threshold: int = SEVERITY_THRESHOLD) -> DataFrame:
    """F9."""
    return df.withColumn("target", (F.col("Severity") >= threshold).cast("int"))


def _class_text(c: str) -> Column:
    """NULL is encoded as the text 'nan' (what the reference's text conversion produces)."""
    return F.coalesce(qcol(c).cast("string"), F.lit("nan"))


def fit_encoders(df: DataFrame, columns: list[str] = ENCODED) -> DataFrame | None:
    """F8 fit: (column, value, code), classes sorted ascending, code = position.

    Distinct values are combined map-side and ranked in value ranges on the executors;
    any number of classes fits. The table is written once."""
    from quarry.sources.sinks import materialize

    cols = [c for c in columns if c in df.columns]
    if not cols:
        return None
    long = to_long(df.select(*[_class_text(c).alias(c) for c in cols]), cols, cast="string", value="value")
    classes = ranged(long.distinct().withColumn("one", F.lit(1)), ["column"], "value")
    ranked = running_totals(classes, ["column"], "value", ["one"], F.col("_range"))
    return materialize(ranked.select("column", "value", (F.col("cum_one") - 1).cast("int").alias("code")), "classes")


FEW_CLASSES = 64


def apply_encoders(df: DataFrame, classes: DataFrame | None) -> DataFrame:
    """F8 transform: adds ``<col>_enc`` int columns (unseen classes → class count). Columns of at most FEW_CLASSES
    classes are coded in one projection by a literal map; any other by a left join, which the planner broadcasts if its
    class table is small on disk."""
    if classes is None:
        return df
    size = {r["column"]: r["count"] for r in classes.groupBy("column").count().collect()}  # a row per encoded column
    few = [c for c, n in size.items() if n <= FEW_CLASSES]
    known: dict[str, list] = {}
    for r in classes.where(F.col("column").isin(few)).collect():  # FEW_CLASSES rows a column at most
        known.setdefault(r["column"], []).append((r["value"], r["code"]))
    order = [c for c in ENCODED if c in size] + sorted(set(size) - set(ENCODED))
    out = df.drop(*[c + "_enc" for c in order])
    for c in order:
        if c not in known:
            enc = c + "_enc"
            codes = classes.where(F.col("column") == c).select(F.col("value").alias("_class"), F.col("code").alias(enc))
            out = out.join(codes, _class_text(c) == F.col("_class"), "left").drop("_class")

    def code(c: str) -> Column:
        if c not in known:
            return qcol(c + "_enc")
        pairs = F.create_map(*[F.lit(x) for pair in sorted(known[c]) for x in pair])
        return F.try_element_at(pairs, _class_text(c))

    return out.select(*[qcol(c) for c in out.columns if c not in {x + "_enc" for x in order}],
                      *[F.coalesce(code(c), F.lit(size[c])).cast("int").alias(c + "_enc") for c in order])


def select_features(df: DataFrame) -> list[str]:
    """numeric/boolean columns not excluded, in column order."""
    keep = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType, T.BooleanType)
    return [f.name for f in df.schema.fields
            if f.name not in EXCLUDE and not f.name.startswith("_") and isinstance(f.dataType, keep)]


def derive(df: DataFrame, threshold: int = SEVERITY_THRESHOLD) -> DataFrame:
    """F1–F7 and F9 (everything except the encoder fit)."""
    out = road_features(weather_features(temporal_features(df)))
    return build_target(out, threshold) if "Severity" in out.columns else out


def build_features(df: DataFrame, threshold: int = SEVERITY_THRESHOLD,
                   encoders: DataFrame | None = None):
    """F1→F5→F7→F8→F9, returns (table, encoders, feature list)."""
    out = derive(df, threshold)
    if encoders is None:
        encoders = fit_encoders(out)
    out = apply_encoders(out, encoders)
    return out, encoders, select_features(out)


#: Fields of a scoring request and their types. Fixed: names and order of the reference's request.
REQUEST_FIELDS = {
    "hour": T.IntegerType(), "day_of_week": T.IntegerType(), "month": T.IntegerType(), "year": T.IntegerType(),
    "duration_min": T.DoubleType(), "road_feature_count": T.IntegerType(), "Distance(mi)": T.DoubleType(),
    "Temperature(F)": T.DoubleType(), "Humidity(%)": T.DoubleType(), "Pressure(in)": T.DoubleType(),
    "Visibility(mi)": T.DoubleType(), "Wind_Speed(mph)": T.DoubleType(), "Precipitation(in)": T.DoubleType(),
}

# What a field counts as where it is left open (or, in the second list, zero).
OPEN_DEFAULTS = {"duration_min": 30.0, "Pressure(in)": 29.9, "road_feature_count": 0, "Precipitation(in)": 0.0}
ZERO_DEFAULTS = {"Distance(mi)": 0.5, "Temperature(F)": 55.0, "Humidity(%)": 70.0, "Visibility(mi)": 10.0, "Wind_Speed(mph)": 10.0}


def fill_defaults(df: DataFrame) -> DataFrame:
    """scoring defaults. ``weather_severity_score`` is derived first, from what the request says: an open field is no
    bad weather, and neither is its default. An open or zero field of ZERO_DEFAULTS gets its default."""
    out = df
    if "weather_severity_score" not in out.columns:
        said = out.select(*[F.nullif(qcol(c), F.lit(0).cast(out.schema[c].dataType)).alias(c) if c in ZERO_DEFAULTS else qcol(c) for c in out.columns])
        out = said.withColumn("weather_severity_score", weather_score(said.columns))
    filled = {}
    for c, v in {**OPEN_DEFAULTS, **ZERO_DEFAULTS}.items():
        if c in out.columns:
            given = F.nullif(qcol(c), F.lit(0).cast(out.schema[c].dataType)) if c in ZERO_DEFAULTS else qcol(c)
            filled[c] = F.coalesce(given, F.lit(v).cast(out.schema[c].dataType))
    return out.withColumns(filled)


def request_features(df: DataFrame) -> DataFrame:
    """derive flags and season from hour/day/month on a scoring request, by the rules of
    training. Defaults are filled by :func:`fill_defaults`."""
    out = df
    if "day_of_week" in df.columns and "is_weekend" not in df.columns:
        out = out.withColumn("is_weekend", cal.is_weekend(F.col("day_of_week")))
    if "hour" in df.columns:
        if "is_rush_hour" not in df.columns:
            out = out.withColumn("is_rush_hour", cal.is_rush_hour(F.col("hour")))
        if "is_night" not in df.columns:
            out = out.withColumn("is_night", cal.is_night(F.col("hour")))
    if "month" in df.columns and "season" not in df.columns:
        out = out.withColumn("season", cal.season(F.col("month")))
    if "weather_severity_score" not in df.columns:
        out = out.withColumn("weather_severity_score", weather_score(out.columns))
    return out
