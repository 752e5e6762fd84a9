"""Parquet/JSON sinks, stage tables and fixed-schema result tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import stage_path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> str:
    """S6. Never write to the path the plan is reading (S8): use a new one."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a stage table under the shared checkpoint folder and read
    it back. Cuts lineage (a lost executor re-reads the files rather than
    recomputing joins and shuffles) and lets several statistics jobs scan
    columnar files instead of re-running the plan."""
    spark = df.sparkSession
    path = stage_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


METADATA_SCHEMA = "kind string, column string, name string, position int"


def write_metadata(features: list[str], classes: DataFrame, path: str) -> str:
    """The feature list and the encoder classes (column, value, code) as JSON lines."""
    listed = classes.sparkSession.range(1).select(
        F.lit("feature").alias("kind"), F.lit("").alias("column"),
        F.posexplode(F.array(*[F.lit(f) for f in features])).alias("position", "name"))
    known = classes.select(F.lit("class").alias("kind"), "column", F.col("value").alias("name"), F.col("code").alias("position"))
    listed.unionByName(known).write.json(path)
    return path


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).json(path)


# Fixed result schemas (the reference keeps these as relational tables).
METRICS_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("test_auc", T.DoubleType()),
    T.StructField("test_f1", T.DoubleType()),
    T.StructField("test_precision", T.DoubleType()),
    T.StructField("test_recall", T.DoubleType()),
    T.StructField("test_accuracy", T.DoubleType()),
    T.StructField("test_ap", T.DoubleType()),
    T.StructField("n_train", T.LongType()),
    T.StructField("n_test", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
])

# Fixed: column of the result table → column of the cleaned table, in order.
INCIDENT_COLUMNS = {
    "accident_id": "ID", "severity": "Severity", "start_time": "Start_Time", "start_lat": "Start_Lat", "start_lng": "Start_Lng",
    "city": "City", "state": "State", "county": "County", "zipcode": "Zipcode", "temperature_f": "Temperature(F)",
    "humidity_pct": "Humidity(%)", "visibility_mi": "Visibility(mi)", "wind_speed_mph": "Wind_Speed(mph)",
    "precipitation_in": "Precipitation(in)", "weather_condition": "Weather_Condition", "distance_mi": "Distance(mi)",
    "sunrise_sunset": "Sunrise_Sunset", "junction": "Junction", "traffic_signal": "Traffic_Signal", "crossing": "Crossing",
    "description": "Description",
}
_INCIDENT_TYPES = {"severity": T.IntegerType(), "start_time": T.TimestampType(), "junction": T.BooleanType(), "traffic_signal": T.BooleanType(),
                   "crossing": T.BooleanType(), **{c: T.DoubleType() for c in ("start_lat", "start_lng", "temperature_f", "humidity_pct", "visibility_mi",
                                                                            "wind_speed_mph", "precipitation_in", "distance_mi")}}
INCIDENT_SCHEMA = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, _INCIDENT_TYPES.get(c, T.StringType())) for c in INCIDENT_COLUMNS],
                                T.StructField("created_at", T.TimestampType())])

PREDICTION_LOG_SCHEMA = T.StructType([
    T.StructField("features", T.StringType()),
    T.StructField("prediction", T.IntegerType()),
    T.StructField("probability", T.DoubleType()),
    T.StructField("severity_label", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto a fixed schema: missing fields become typed NULLs."""
    cols = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in cols else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def prediction_log_rows(scored: DataFrame, feature_cols: list[str], model_name: str) -> DataFrame:
    """Prediction log rows: features as JSON text, class, probability, model, time."""
    feats = F.to_json(F.struct(*[F.col(f"`{c}`") for c in feature_cols]))
    return conform(scored.select(
        feats.alias("features"), F.col("prediction").cast("int").alias("prediction"),
        F.col("probability_high").alias("probability"), F.col("severity_label"), F.lit(model_name).alias("model_name"),
        F.current_timestamp().alias("created_at")), PREDICTION_LOG_SCHEMA)


def incident_rows(df: DataFrame) -> DataFrame:
    """Incidents in the fixed 23-column table; ``id`` is the rank of the incident's id, cumulated over ranges. Absent columns are NULL."""
    from quarry.functions.stats import ranged, running_totals

    have = {c.lower(): c for c in df.columns}
    named = df.select(*[F.col(f"`{have[c.lower()]}`").alias(n) for n, c in INCIDENT_COLUMNS.items() if c.lower() in have])
    ranks = running_totals(ranged(df.select(F.col("ID").alias("accident_id")).withColumn("_one", F.lit(1)), [], "accident_id"), [], "accident_id", ["_one"], F.col("_range"))
    out = named.join(ranks.select("accident_id", F.col("cum__one").alias("id")), "accident_id")
    return conform(out.withColumn("created_at", F.current_timestamp()), INCIDENT_SCHEMA)
