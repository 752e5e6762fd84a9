"""Registered queries against their DuckDB oracles at sf0.001 (the driver's gate)."""

import pytest

from oracle_compare import compare, duck_connect

SF = "/root/testdata/sf0.001"
FAST = ["severity_by_hour", "stats", "top_cities", "weather_severity_grid", "day_hour_pivot", "report_facts",
        "box_stats", "missing_fraction", "removed_rows", "request_violations", "impute", "clean_table",
        "title_case", "label_encode", "feature_table", "histogram", "roc_auc", "roc_curve", "class_report",
        "calibration", "threshold_sweep", "metrics_table", "split_sizes", "csv_roundtrip",
        "severity_counts", "key_findings", "visibility_histogram", "top_city_states", "corr_long",
        "test_split", "target_corr", "csv_malformed", "csv_ordered", "request_defaults", "exact_split", "exact_split_sizes",
        "hash_sample", "map_points", "map_hover", "report_tables", "state_totals", "type_counts", "preview", "distinct_states",
        "complete_cases", "zero_fill", "incident_table", "narrowed_table"]


@pytest.fixture(scope="module")
def env():
    import __spark_entry__ as E
    return E.queries(), E.oracle_sql(), duck_connect(SF)


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, env, name):
    qs, oracles, con = env
    ok, msg = compare(qs[name](spark, SF), con, oracles[name])
    assert ok, msg


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["hour", "Severity", "count"]
