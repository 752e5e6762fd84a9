"""Model smoke tests on a seeded two-cluster fixture (500 × 20, ≈70/30)."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import evaluation as ev
from quarry.operators import ml


def _fixture(spark):
    rng = np.random.default_rng(42)
    n, d = 500, 20
    y = (rng.random(n) < 0.3).astype(int)
    X = rng.normal(0, 1, (n, d))
    X[:, :10] += y[:, None] * 1.0
    rows = [(f"r{i}", int(y[i]), *map(float, X[i])) for i in range(n)]
    cols = ["ID", "target"] + [f"f{j}" for j in range(d)]
    return spark.createDataFrame(rows, cols), cols[2:]


def test_train_score_metrics(spark):
    df, feats = _fixture(spark)
    data = ml.assign_split(df)
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    fitted = ml.train_models(train, feats, "light", ["logistic_regression", "random_forest"])
    for name, (model, secs) in fitted.items():
        s = ml.score(model, test)
        assert s.count() == test.count()
        assert s.where(~F.col("prediction").isin(0, 1)).count() == 0
        assert s.where((F.col("probability_high") < 0) | (F.col("probability_high") > 1)).count() == 0
        auc = ev.roc_auc(s.select(F.col("target").alias("label"), F.col("probability_high").alias("score")),
                         by=()).first()["auc"]
        assert auc > 0.6, name
        assert len(ml.feature_importance(model, feats)) == 20


def test_split_is_deterministic(spark):
    df, _ = _fixture(spark)
    a = {r["ID"]: r["split"] for r in ml.assign_split(df).collect()}
    b = {r["ID"]: r["split"] for r in ml.assign_split(df.repartition(9)).collect()}
    assert a == b and set(a.values()) == {"train", "val", "test"}


def test_grid_search(spark):
    df, feats = _fixture(spark)
    cvm = ml.tune(df, feats, folds=2, reg_params=(0.01, 1.0))
    assert len(cvm.avgMetrics) == 2 and max(cvm.avgMetrics) > 0.6


def test_model_store_roundtrip(spark):
    import tempfile
    df, feats = _fixture(spark)
    model, _ = ml.train_models(df, feats, "light", ["logistic_regression"])["logistic_regression"]
    path = ml.save_model(model, tempfile.mkdtemp(prefix="quarry-model-") + "/lr")
    again = ml.load_model(path)
    a = {r["ID"]: r["probability_high"] for r in ml.score(model, df).collect()}
    b = {r["ID"]: r["probability_high"] for r in ml.score(again, df).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
