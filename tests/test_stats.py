"""Distributed statistics against brute force (NumPy) on small data with ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.stats import exact_quantiles, pairwise_corr
from quarry.operators import evaluation as ev


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.normal(10, 5, 3000), 1)           # many ties, both signs, zeros
    vals[:50] = 0.0
    groups = rng.integers(0, 3, 3000)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, vals)], "g int, x double") \
        .repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r["g"], r["prob"]): r["value"] for r in exact_quantiles(df, ["x"], probs, by=["g"], ranges=13).collect()}
    for g in range(3):
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(vals[groups == g], p), abs=1e-9)


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0), (None, 1.0, 5.0)], "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in pairwise_corr(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1])
    assert got[("a", "c")] is None and got[("b", "c")] is None


def _brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def _brute_ap(y, s):
    order = np.argsort(-s, kind="stable")
    ap, prev_r = 0.0, 0.0
    for t in np.unique(s)[::-1]:
        sel = s >= t
        tp = (y[sel] == 1).sum()
        p, r = tp / sel.sum(), tp / (y == 1).sum()
        ap += (r - prev_r) * p
        prev_r = r
    del order
    return ap


def test_ranking_metrics_with_ties(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 800)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double").repartition(5)
    auc = ev.roc_auc(df, by=()).first()["auc"]
    ap = ev.average_precision(df, by=()).first()["ap"]
    assert auc == pytest.approx(_brute_auc(y, s), abs=1e-12)
    assert ap == pytest.approx(_brute_ap(y, s), abs=1e-12)
    cm = {(r["actual"], r["predicted"]): r["count"] for r in ev.confusion(df, by=()).collect()}
    assert cm[(1, 1)] == int(((y == 1) & (s >= 0.5)).sum()) and sum(cm.values()) == 800
    cal = ev.calibration(df, by=()).collect()
    assert sum(r["count"] for r in cal) == 800


def test_running_totals_match_cumsum(spark):
    from quarry.functions.stats import running_totals
    vals = list(range(200))
    df = spark.createDataFrame([(i, float(i % 7)) for i in vals], "k int, x double")
    out = running_totals(df, [], "k", ["x"], (F.col("k") / 13).cast("int")).orderBy("k").collect()
    assert [r["cum_x"] for r in out] == list(np.cumsum([float(i % 7) for i in vals]))


def test_roc_drop_intermediate_across_buckets(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 1500)
    s = np.round(rng.random(1500), 3)                      # ~1000 distinct scores over all buckets
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    got = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in
                 ev.roc_curve(df, by=(), drop_intermediate=True).collect())
    thr = np.unique(s)[::-1]
    tps = np.array([((s >= t) & (y == 1)).sum() for t in thr])
    fps = np.array([((s >= t) & (y == 0)).sum() for t in thr])
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
    P, N = (y == 1).sum(), (y == 0).sum()
    exp = sorted([(float(t), f / N, p / P) for t, f, p, k in zip(thr, fps, tps, keep) if k] + [(np.inf, 0.0, 0.0)])
    assert len(got) == len(exp)
    for a, b in zip(got, exp):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1]) and a[2] == pytest.approx(b[2])


def test_ranges_stay_even_for_crowded_values(spark):
    from quarry.functions.stats import ranged
    n, ranges = 40_000, 16
    epoch = spark.range(n).select((F.col("id") + 1_700_000_000).cast("double").alias("v"))      # one octave
    scores = spark.range(n).select((0.05 + F.col("id") / F.lit(n * 1000.0)).alias("v"))         # 0.050 to 0.051
    for df in (epoch, scores):
        sizes = [r["count"] for r in ranged(df, [], "v", ranges).groupBy("_range").count().collect()]
        assert sum(sizes) == n and len(sizes) == ranges and max(sizes) < 2 * n / ranges
    got = {r["prob"]: r["value"] for r in exact_quantiles(epoch, ["v"], [0.0, 0.3, 1.0], ranges=ranges).collect()}
    assert got == {0.0: 1.7e9, 0.3: pytest.approx(1.7e9 + 0.3 * (n - 1)), 1.0: 1.7e9 + n - 1}
    y = (F.col("id") % 3 == 0).cast("int")
    df = spark.range(3000).select(y.alias("label"), (0.05 + F.col("id") / 3e6).alias("score"))
    k = np.arange(3000)
    assert ev.roc_auc(df, by=(), ranges=ranges).first()["auc"] == pytest.approx(_brute_auc((k % 3 == 0).astype(int), k))


def test_approx_quantiles_close_to_exact(spark):
    from quarry.functions.stats import approx_quantiles
    rng = np.random.default_rng(5)
    vals = rng.normal(0, 1, 5000)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = {r["prob"]: r["value"] for r in approx_quantiles(df, ["x"], [0.25, 0.5, 0.75]).collect()}
    for p, v in got.items():
        rank = (vals <= v).mean()
        assert abs(rank - p) < 0.01


def test_co_moments_against_numpy(spark):
    import numpy as np
    from quarry.functions.stats import co_moments, pairwise_corr
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 5)) * [1, 1e-3, 50, 1, 1] + [0, 1e6, -3, 0, 0]
    x[:, 4] = 7.0
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) and k % 2 else float(v) for k, v in enumerate(r)) for r in x],
                               "a double, b double, `c(x)` double, d double, e double").repartition(7)
    names = ["a", "b", "c(x)", "d", "e"]
    got = {(r["col_a"], r["col_b"]): r for r in co_moments(df, names, parts=3).collect()}
    assert len(got) == 10
    for i, a in enumerate(names):
        for j in range(i + 1, 5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r, u, v = got[a, names[j]], x[both, i], x[both, j]
            assert r["n"] == both.sum()
            if r["n"]:
                want = [u.mean(), v.mean(), u.var(), v.var(), ((u - u.mean()) * (v - v.mean())).mean()]
                assert np.allclose([r[c] for c in ("mean_a", "mean_b", "var_a", "var_b", "cov")], want, rtol=1e-5, atol=1e-10)
    corr = {(r["col_a"], r["col_b"]): r["r"] for r in pairwise_corr(df, names).collect()}
    assert corr["a", "e"] is None and corr["a", "d"] is None and abs(corr["a", "b"]) < 0.2
    assert pairwise_corr(df.where("false"), names).count() == 0 and co_moments(df, ["a"]).count() == 0


def test_all_ranks_share_their_passes(spark):
    """kth_smallest reads the rows once a round and once for the last few, not once a rank and round."""
    from quarry.functions.stats import kth_smallest

    df = spark.range(3000).selectExpr("id % 2 AS g", "md5(cast(id AS string)) AS h").where("g IS NOT NULL")
    wanted = {0: [0, 1, 300, 9999], 1: [2, 700]}
    sorted_ = {g: sorted(r["h"] for r in df.where(f"g = {g}").collect()) for g in wanted}
    sc = spark.sparkContext
    sc.setJobGroup("ranks", "ranks")
    got = kth_smallest(df, "g", "h", wanted, digits=1, few=50)
    jobs = len(sc.statusTracker().getJobIdsForGroup("ranks"))
    sc.setJobGroup("rest", "rest")
    assert got == {g: ["" if k == 0 else sorted_[g][min(k, 1500) - 1] for k in ks] for g, ks in wanted.items()}
    assert jobs <= 8  # two or three rounds of two stages, and the last rows


def test_rows_of_a_small_file_are_spread(spark, tmp_path):
    from quarry.session import spread

    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert df.rdd.getNumPartitions() == 1
    sizes = [r["count"] for r in spread(df).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and sum(sizes) == 5000 and max(sizes) < 2500
