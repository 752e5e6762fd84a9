"""Operator tests on a few rows of our own, exact expected values."""

from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarry.operators import clean as C
from quarry.operators import features as FE
from quarry.functions.text import standardise

FLAGS_FALSE = ["Give_Way", "Bump", "No_Exit", "Railway", "Roundabout", "Station", "Stop",
               "Traffic_Calming", "Turning_Loop", "Amenity"]
SCHEMA = ("ID string, Severity int, Start_Lat double, Start_Lng double, Start_Time timestamp, "
          "End_Time timestamp, `Temperature(F)` double, `Humidity(%)` double, `Visibility(mi)` double, "
          "`Wind_Speed(mph)` double, `Precipitation(in)` double, Weather_Condition string, "
          "Junction boolean, Traffic_Signal boolean, Crossing boolean, "
          + ", ".join(f"{f} boolean" for f in FLAGS_FALSE))


def rows():
    base = [
        ("k1", 2, 47.6, -122.3, datetime(2021, 7, 5, 7, 15), datetime(2021, 7, 5, 8, 25), 61.0, 81.0, 9.0, 12.0, 0.0,
         "Sunny", True, False, True),
        ("k2", 4, 30.2, -97.7, datetime(2020, 2, 29, 23, 50), datetime(2020, 3, 1, 0, 20), 31.0, 77.0, 6.0, 4.0, 0.0,
         "Snow", False, False, False),
        ("k3", 3, 44.9, -93.2, datetime(2023, 10, 13, 13, 5), datetime(2023, 10, 13, 13, 6), 66.0, 41.0, 7.0, 9.0, 0.0,
         "Partly Cloudy", False, True, True),
        ("k4", 1, 36.1, -115.1, datetime(2019, 5, 19, 11, 0), datetime(2019, 5, 19, 14, 0), 97.0, 12.0, 10.0, 2.0, 0.0,
         "Clear", True, True, True),
        ("k5", 2, 40.7, -73.9, datetime(2022, 12, 24, 3, 0), datetime(2022, 12, 24, 3, 0), -4.0, 70.0, 8.0, 3.0, 0.0,
         "Clear", False, False, True),
    ]
    return [r + (False,) * len(FLAGS_FALSE) for r in base]


@pytest.fixture()
def fixture_df(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def test_features_exact(fixture_df):
    out, enc, feats = FE.build_features(fixture_df, threshold=3)
    got = {r["ID"]: r for r in out.collect()}
    expected = {
        "k1": (7, 0, 7, 2021, 0, 1, 0, 2, 70.0, "Clear", 2, 0),
        "k2": (23, 5, 2, 2020, 1, 0, 1, 0, 30.0, "Snow/Ice", 0, 1),
        "k3": (13, 4, 10, 2023, 0, 0, 0, 3, 1.0, "Cloudy", 2, 1),
        "k4": (11, 6, 5, 2019, 1, 0, 0, 1, 180.0, "Clear", 3, 0),
        "k5": (3, 5, 12, 2022, 1, 0, 1, 0, 0.0, "Clear", 1, 0),
    }
    cols = ["hour", "day_of_week", "month", "year", "is_weekend", "is_rush_hour", "is_night", "season",
            "duration_min", "weather_category", "road_feature_count", "target"]
    for k, exp in expected.items():
        assert tuple(got[k][c] for c in cols) == exp, k
    assert "weather_category_enc" in out.columns and "Junction" in feats


def test_drop_high_missing(spark, fixture_df):
    df = fixture_df.withColumn("rare", F.when(F.col("ID") == "k4", F.lit(1.0))).withColumn(
        "frequent", F.when(F.col("ID") != "k4", F.lit(1.0)))
    kept = C.drop_high_missing(df, 0.5).columns
    assert "rare" not in kept and "frequent" in kept


def test_impute_median(fixture_df):
    gone = F.col("ID").isin("k2", "k5")
    df = fixture_df.withColumn("Humidity(%)", F.when(~gone, F.col("`Humidity(%)`")))
    got = {r["ID"]: r["Humidity(%)"] for r in C.impute_missing(df).collect()}
    assert got == {"k1": 81.0, "k2": 41.0, "k3": 41.0, "k4": 12.0, "k5": 41.0}


def test_coordinate_and_severity_filters(fixture_df):
    moved = fixture_df.withColumn("Start_Lng", F.when(F.col("ID") == "k3", 12.5).otherwise(F.col("Start_Lng")))
    assert {r["ID"] for r in C.validate_coordinates(moved).collect()} == {"k1", "k2", "k4", "k5"}
    for wrong in (0, 7, None):
        df = fixture_df.withColumn("Severity", F.when(F.col("ID") == "k2", F.lit(wrong)).otherwise(F.col("Severity")))
        assert {r["ID"] for r in C.validate_severity(df).collect()} == {"k1", "k3", "k4", "k5"}


def test_iqr_capping_exact(spark):
    vals = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 500.0, -300.0, float("nan")]
    df = C.nan_to_null(spark.createDataFrame([(v,) for v in vals], "`Wind_Speed(mph)` double"))
    q = C.quartiles(df, ["Wind_Speed(mph)"])
    assert q[("Wind_Speed(mph)", 0.25)] == 1.75 and q[("Wind_Speed(mph)", 0.75)] == 7.25
    out = C.remove_outliers(df, 1.5, ["Wind_Speed(mph)"])
    top, low, n = out.agg(F.max("`Wind_Speed(mph)`"), F.min("`Wind_Speed(mph)`"), F.count("`Wind_Speed(mph)`")).first()
    assert (top, low, n) == (15.5, -6.5, 12)


def test_histogram_counts_inside_its_range(spark):
    from quarry.operators.charts import histogram
    df = spark.createDataFrame([(float(v), g) for v in range(20) for g in ("a", None)], "v double, g string")
    assert histogram(df, "v", bins=5, lo=5.0, hi=15.0).agg(F.sum(F.col("density") * 2)).first()[0] == pytest.approx(1)
    by = histogram(df, "v", bins=4, by="g").collect()
    assert {r["g"] for r in by} == {"a"} and sum(r["count"] for r in by) == 20


def test_auc_of_very_large_counts(spark):
    from quarry.operators.evaluation import roc_auc
    df = spark.createDataFrame([("m", 1, 0.9), ("m", 0, 0.1), ("m", 0, 0.9)], "model string, label int, score double")
    assert roc_auc(df).first()["auc"] == pytest.approx(0.75)


def test_edge_rows(spark):
    df = spark.createDataFrame([
        Row(ID="e1", Start_Time=datetime(2022, 1, 1, 10), End_Time=datetime(2022, 1, 1, 9),
            vis=1.0, wc="Heavy Snow with Thunder"),
        Row(ID="e2", Start_Time=datetime(2022, 1, 1, 10), End_Time=datetime(2022, 1, 3, 10),
            vis=3.0, wc=None),
        Row(ID="e3", Start_Time=None, End_Time=datetime(2022, 1, 3, 10), vis=None, wc=None),
    ]).withColumnRenamed("vis", "Visibility(mi)").withColumnRenamed("wc", "Weather_Condition")
    out = {r["ID"]: r for r in FE.derive(df).collect()}
    assert out["e1"]["duration_min"] == 0.0 and out["e2"]["duration_min"] == 1440.0
    assert out["e1"]["weather_severity_score"] == 1.0 and out["e2"]["weather_severity_score"] == 1.0
    assert out["e1"]["weather_category"] == "Snow/Ice" and out["e2"]["weather_category"] == "Other"
    assert out["e3"]["hour"] is None and out["e3"]["weather_severity_score"] == 0.0


def test_title_case(spark):
    df = spark.createDataFrame([("  o'brien ST-louis 5th ave ",), (None,), ("",)], "c string")
    got = [r[0] for r in df.select(standardise(F.col("c"))).collect()]
    assert got == ["O'Brien St-Louis 5Th Ave", None, ""]


def test_dedup_first_in_order_and_mode_tie(spark):
    df = spark.createDataFrame([("x", 2, "late"), ("x", 1, "early"), ("y", 3, "only")], "ID string, _order long, v string")
    got = {r["ID"]: r["v"] for r in C.dedup(df).collect()}
    assert got == {"x": "early", "y": "only"}
    from quarry.functions.stats import column_modes
    modes = column_modes(spark.createDataFrame([("b",), ("a",), (None,)], "s string"), ["s"])
    assert modes == {"s": "a"}


def test_request_rules(spark):
    from quarry.operators.quality import request_violations
    good = {"hour": 8, "day_of_week": 1, "month": 3, "year": 2022, "is_weekend": 0, "is_rush_hour": 1,
            "is_night": 0, "season": 1, "duration_min": 30.0, "weather_severity_score": 1.0,
            "road_feature_count": 2, "Distance(mi)": 0.5, "Temperature(F)": 55.0, "Humidity(%)": 70.0,
            "Pressure(in)": 29.9, "Visibility(mi)": 10.0, "Wind_Speed(mph)": 10.0, "Precipitation(in)": 0.0}
    bad = dict(good, hour=99)
    df = spark.createDataFrame([Row(**good), Row(**bad)])
    got = [r["violations"] for r in request_violations(df).collect()]
    assert got == [[], ["hour"]]


def test_report_tables(fixture_df):
    from quarry.operators.charts import report_tables
    t = report_tables(FE.build_features(fixture_df)[0])
    assert {r["Severity"]: r["count"] for r in t["severity"].collect()} == {1: 1, 2: 2, 3: 1, 4: 1}
    assert sum(r["count"] for r in t["years"].collect()) == 5
