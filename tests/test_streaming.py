"""Request files → validation → derived flags → model → prediction log."""

import tempfile

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import ml
from quarry.streaming.scoring import batch_writer, parse_requests, read_sink, scoring_stream

FIELDS = ["hour", "day_of_week", "month", "year", "duration_min", "road_feature_count", "Distance(mi)",
          "Temperature(F)", "Humidity(%)", "Pressure(in)", "Visibility(mi)", "Wind_Speed(mph)",
          "Precipitation(in)"]
FEATURES = FIELDS + ["is_weekend", "is_rush_hour", "is_night", "season", "weather_severity_score"]


def _requests(n, seed, bad=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rows.append((int(rng.integers(0, 24)) if i >= bad else 99, int(rng.integers(0, 7)), int(rng.integers(1, 13)),
                     2022, float(rng.uniform(0, 120)), int(rng.integers(0, 4)), float(rng.uniform(0, 3)),
                     float(rng.uniform(10, 100)), float(rng.uniform(0, 100)), float(rng.uniform(28, 31)),
                     float(rng.uniform(0, 10)), float(rng.uniform(0, 40)), float(rng.uniform(0, 0.3))))
    return rows


def test_stream_scores_valid_and_rejects_invalid(spark):
    from quarry.operators.features import request_features
    schema = ", ".join(f"`{c}` {'int' if c in ('hour', 'day_of_week', 'month', 'year', 'road_feature_count') else 'double'}"
                       for c in FIELDS)
    train = request_features(spark.createDataFrame(_requests(300, 1), schema))
    train = train.withColumn("target", (F.col("`Visibility(mi)`") < 3).cast("int")).withColumn("ID", F.monotonically_increasing_id())
    model, _ = ml.train_models(ml.model_matrix(train, FEATURES), FEATURES, "light", ["logistic_regression"])["logistic_regression"]

    base = tempfile.mkdtemp(prefix="quarry-stream-")
    src, sink = f"{base}/requests", f"{base}/sink"
    asked = spark.createDataFrame(_requests(40, 2, bad=3), schema)
    lines = [r["j"] for r in asked.select(F.to_json(F.struct("*")).alias("j")).collect()]
    lines += ['{"hour": 1', "[]", "", "not json", '{"hour": "x"}', '{"hour": 5, "day_of_week": 1, "month": 2, "year": 2020, "extra": [1]}',
              lines[5][:-1] + ', "model_name": "nobody"}', lines[5][:-1] + ', "model_name": "again"}', lines[5][:-1] + ', "model_name": ""}']
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(3).write.text(src)
    models = {"logistic_regression": model, "again": model}
    q = scoring_stream(spark, src, models, "logistic_regression", FEATURES, sink, f"{base}/ckpt")
    q.awaitTermination()

    def state():
        return [sorted(map(str, d.drop("created_at").collect())) for d in read_sink(spark, sink)]

    log, rej, dead = read_sink(spark, sink)
    assert (log.count(), rej.count(), dead.count()) == (40, 4, 5)
    assert log.where((F.col("probability") < 0) | (F.col("probability") > 1)).count() == 0
    assert {r["model_name"]: r["count"] for r in log.groupBy("model_name").count().collect()} == {"logistic_regression": 39, "again": 1}
    assert sorted(str(r["violations"]) for r in rej.collect()) == ["['hour']"] * 3 + ["['model_name']"]
    before = state()
    batch_writer(models, "logistic_regression", FEATURES, sink)(spark.read.text(src), 0)  # the batch is replayed
    assert state() == before
    spark.createDataFrame([(lines[6],)], "value string").write.mode("append").text(src)  # a second batch
    scoring_stream(spark, src, models, "logistic_regression", FEATURES, sink, f"{base}/ckpt").awaitTermination()
    assert read_sink(spark, sink)[0].count() == 41


def test_defaults(spark):
    from quarry.operators.features import fill_defaults
    rows = parse_requests(spark.createDataFrame([('{"Temperature(F)": 0, "Visibility(mi)": 0.5, "Precipitation(in)": 0.2}',), ("{}",), (None,)], "value string"))
    out = fill_defaults(rows).collect()
    assert [(r["Temperature(F)"], r["Visibility(mi)"], r["Wind_Speed(mph)"], r["Pressure(in)"], r["duration_min"], r["weather_severity_score"]) for r in out] == [
        (55.0, 0.5, 10.0, 29.9, 30.0, 3), (55.0, 10.0, 10.0, 29.9, 30.0, 0), (55.0, 10.0, 10.0, 29.9, 30.0, 0)]
    assert [r["_malformed"] for r in out] == [None, None, ""]


def test_a_batch_parses_each_request_once(spark, monkeypatch, tmp_path):
    """The sinks read kept requests; a filter on parsed fields does not bring the parsing of the text with it."""
    from quarry.streaming import scoring
    lines = spark.createDataFrame([('{"hour": 5, "day_of_week": 1, "month": 2, "year": 2020}',), ("x",)], "value string")
    checked = scoring.checked_requests(lines, {}, "m")
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    seen = []

    def outcomes(checked, models, features):
        seen.append(checked.storageLevel.useMemory)
        return [checked.where(F.size("violations") > 0).select("request")] * 3

    monkeypatch.setattr(scoring, "outcomes", outcomes)
    batch_writer({}, "m", [], str(tmp_path))(lines, 0)
    assert seen == [True]
