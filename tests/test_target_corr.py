"""The feature-target correlation takes every feature that the selection stage yields."""

from quarry.plans import chart_queries


def test_every_selected_feature_is_correlated(spark, monkeypatch):
    rows = [(i % 2, float(i % 2), i % 3 == 0, i, 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "target int, `Give(way)` double, No_Exit boolean, left_out int, flat double")
    monkeypatch.setattr(chart_queries, "processed", lambda *a: df, raising=False)
    monkeypatch.setattr(chart_queries, "processed_with_meta", lambda *a: (df, None, ["Give(way)", "No_Exit", "flat"]), raising=False)
    got = [tuple(r) for r in chart_queries.target_corr(spark, "").collect()]
    assert got == [("Give(way)", 1.0), ("No_Exit", 0.0), ("flat", None)]


def test_its_oracle_lists_the_same_features():
    from quarry.plans.catalog import ORACLES
    from quarry.plans.feature_queries import FEATURES
    assert all(f"'{c}' AS feature" in ORACLES["target_corr"] for c in FEATURES)
