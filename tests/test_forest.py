"""The forest whose trees are dealt to tasks: splits against a loop, the same trees however rows are dealt, a stored copy."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import forest, ml
from quarry.operators.boosting import Layout


def test_a_split_equals_a_loop():
    r = np.random.default_rng(1)
    x, w = np.column_stack([r.integers(0, 9, 300), r.integers(0, 2, 300)]), r.choice([0.5, 2.0], 300)
    y = (x[:, 0] + 3 * x[:, 1] + r.normal(size=300) > 6).astype(float)
    bins, drawn = Layout([list(range(8)), [0]]).bins(x.astype(float)), r.poisson(1.0, 300)
    tree = forest.grow(bins, y, w, drawn, forest.Params(1, 1, 4), np.random.default_rng(0))

    def impurity(m):
        t, p = (w * drawn)[m].sum(), (w * drawn * y)[m].sum()
        return 2 * p * (t - p) / t if t else 0.0

    found = {}
    for j in range(2):
        for c in range(8):
            low = x[:, j] <= c
            if min(drawn[low].sum(), drawn[~low].sum()) >= 4:
                found[j, c] = impurity(low | ~low) - impurity(low) - impurity(~low)
    best = max(found, key=found.get)
    assert (int(tree.feature[0]), int(tree.bin[0])) == best and np.isclose(tree.gain[0], found[best])
    leaf = tree.leaves_of(bins)
    for node in (1, 2):
        assert np.isclose(tree.value[node], np.average(y[leaf == node], weights=(w * drawn)[leaf == node]))
        assert drawn[leaf == node].sum() >= 4


def table(spark, n=600):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 5)).round(2)
    y = (x[:, 0] - x[:, 1] + r.normal(size=n) > 0.5).astype(int)
    return spark.createDataFrame([(f"k{i}", int(y[i]), *map(float, x[i])) for i in range(n)],
                                 "ID string, target int, " + ", ".join(f"`f({j})` double" for j in range(5))), [f"f({j})" for j in range(5)]


def test_trees_are_the_same_however_rows_are_dealt(spark, tmp_path):
    df, feats = table(spark)
    p = forest.Params(trees=9, depth=6, min_leaf=4)
    w = df.withColumn("weight", F.lit(1.0))
    one, two = forest.fit(w.coalesce(1), feats, p), forest.fit(w.repartition(7), feats, p)
    scores = [{r["ID"]: r["probability_high"] for r in m.transform(df).collect()} for m in (one, two)]
    assert len(one.trees) == 9 and scores[0] == scores[1]
    assert len({t.value.tobytes() for t in one.trees}) == 9  # every tree has its own draw
    back = forest.ForestModel.load(spark, one.save(spark, str(tmp_path / "m")))
    assert {r["ID"]: r["probability_high"] for r in back.transform(df).collect()} == scores[0]
    v = one.importances()
    assert abs(sum(v) - 1) < 1e-9 and min(v[0], v[1]) > max(v[2:])


def test_the_forest_profile_is_dealt_to_tasks(spark):
    """Spark ML's forest shuffles sums of every node, feature and bin of every partition."""
    df, feats = table(spark, 300)
    model = ml.fit_model("random_forest", df, feats, "light")
    assert ml.kind_of(model) == "forest" and len(model.trees) == 20
    s = ml.score(model, df)
    assert s.where(~F.col("probability_high").between(0, 1)).count() == 0
    high, low = (s.where(F.col("target") == t).agg(F.avg("probability_high")).first()[0] for t in (1, 0))
    assert high > low + 0.2


def test_packed_sums_give_the_tree_of_plain_sums(monkeypatch):
    """Classes of one weight each share a number a row; runs of few rows and any repacking give the same tree."""
    r = np.random.default_rng(5)
    bins, y = r.integers(0, 32, (3000, 7)).astype(np.uint8), r.integers(0, 2, 3000).astype(float)
    y[bins[:, 0] > 20] = 1.0
    w, drawn, p = np.where(y == 1, 0.75, 1.5), r.poisson(1.0, 3000), forest.Params(1, 9, 4)

    def tree():
        t = forest.grow(bins, y, w, drawn, p, np.random.default_rng(1))
        return [getattr(t, c) for c in ("feature", "bin", "left", "value", "gain")]

    want = tree()
    assert len(want[0]) > 100
    monkeypatch.setattr(forest, "RUN", 50)
    monkeypatch.setattr(forest, "REPACK", 1)
    assert all(np.array_equal(a, b) for a, b in zip(want, tree(), strict=True))
    monkeypatch.setattr(forest, "PACK", 0.0)  # weights such as these add up exactly in plain sums too
    assert all(np.array_equal(a, b) for a, b in zip(want, tree(), strict=True))
