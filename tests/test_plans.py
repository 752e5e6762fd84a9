"""Plan properties: no Python UDF nodes; aggregations combine map-side."""

import pytest

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def registered():
    import __spark_entry__ as E
    return E.queries()


@pytest.mark.parametrize("name", ["severity_by_hour", "stats", "mean_marginals", "describe", "box_stats",
                                  "roc_auc", "metrics_table", "threshold_sweep", "dedup"])
def test_no_python_udfs(spark, registered, name):
    plan = _plan(registered[name](spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in plan, name


def test_dedup_aggregates_before_shuffle(spark):
    from quarry.operators.clean import dedup
    from quarry.sources.incidents import incidents
    plan = _plan(dedup(incidents(spark, SF)))
    assert "partial_min" in plan


def test_metamorphic_repartition(spark):
    from quarry.operators import evaluation as ev
    from quarry.sources.scores import scores
    s = scores(spark, SF)
    a = sorted(ev.metrics_table(s).collect())
    b = sorted(ev.metrics_table(s.repartition(11)).collect())
    assert a == b


@pytest.mark.parametrize("name", ["describe", "box_stats", "iqr_cap", "roc_auc", "roc_curve",
                                  "roc_curve_compact", "average_precision", "pr_curve", "hash_sample", "map_points"])
def test_no_single_partition_exchange(spark, registered, name):
    """Quantile and ranking operators cumulate inside (key, bucket) windows:
    no stage may gather the data into one partition."""
    plan = _plan(registered[name](spark, SF))
    assert "SinglePartition" not in plan, name


def test_correlation_makes_no_row_a_pair(spark, registered):
    plan = _plan(registered["corr_long"](spark, SF))
    assert "Generate" not in plan and "Expand" not in plan and "MapInArrow" in plan
