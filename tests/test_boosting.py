"""Histogram boosting against a loop over rows, its two forms against each other, and resumed fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import boosting as B


def rows(n, seed=0):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=n).round(3), r.integers(0, 2, n), r.integers(0, 12, n), r.normal(size=n), np.zeros(n)])
    y = (x[:, 0] + x[:, 1] * x[:, 3] + r.normal(size=n) > 0.4).astype(int)
    return x, y


def loop_tree(x, g, h, p):
    """(rows, value) of the leaves of one tree, each split found by trying every cut of every feature on the rows."""
    def score(g_, h_):
        return max(abs(g_) - p.l1, 0.0) ** 2 / (h_ + p.l2)

    def best(at):
        found = (max(p.gamma, B.EPS), None)
        for j in range(x.shape[1]):
            for c in np.unique(x[at, j])[:-1]:
                low, high = at[x[at, j] <= c], at[x[at, j] > c]
                if min(h[low].sum(), h[high].sum()) < p.min_child_weight or min(len(low), len(high)) < max(1, p.min_child_samples):
                    continue
                gain = score(g[low].sum(), h[low].sum()) + score(g[high].sum(), h[high].sum()) - score(g[at].sum(), h[at].sum())
                if gain > found[0] + 1e-12:
                    found = (gain, (low, high))
        return found

    leaves, queue = [], [(*best(np.arange(len(x))), np.arange(len(x)), 0)]
    while queue:
        queue.sort(key=lambda q: -q[0] if q[1] else 1)
        gain, halves, at, depth = queue.pop(0)
        if halves is None or depth == p.depth or (p.max_leaves and len(leaves) + len(queue) + 2 > p.max_leaves):
            leaves.append((sorted(at), -np.sign(g[at].sum()) * max(abs(g[at].sum()) - p.l1, 0) / (h[at].sum() + p.l2) * p.lr))
        else:
            queue += [(*best(half), half, depth + 1) for half in halves]
    return sorted((tuple(int(i) for i in a), round(float(v), 9)) for a, v in leaves)


@pytest.mark.parametrize("p", [
    B.Params(rounds=3, depth=3, lr=0.1, min_child_weight=2.0, gamma=0.2, l1=0.1),
    B.Params(rounds=3, depth=5, lr=0.3, min_child_samples=7, max_leaves=6, l1=0.05, l2=2.0),
    B.Params(rounds=2, depth=2, min_child_weight=1e9)])
def test_trees_equal_a_loop(p):
    x, y = rows(150)
    w = np.where(y == 1, 3.0, 1.0)
    layout = B.Layout([sorted(set(x[:, j])) for j in range(x.shape[1])])
    block = B.Rows(layout.bins(x), y.astype(float), w, np.arange(len(x), dtype=np.uint64), np.zeros(len(x)))
    margin = np.zeros(len(x))
    for r in range(p.rounds):
        prob = 1 / (1 + np.exp(-margin))
        want = loop_tree(x, w * (prob - y), w * prob * (1 - prob), p)
        tree, = B.fit_rows(block, layout, p, r, 1)
        at = tree.leaves_of(block.bins)
        assert sorted((tuple(int(i) for i in np.flatnonzero(at == n)), round(tree.value[n], 9)) for n in set(at)) == want
        for members, value in want:
            margin[list(members)] += value
        assert np.allclose(margin, block.margin, atol=1e-7)


def test_sibling_by_subtraction_and_bins():
    layout = B.Layout([[0.0, 1.5], [], [3.0]])
    assert layout.bins(np.array([[0.0, 9.0, 3.0], [0.1, 9.0, 3.1], [2.0, 9.0, float("nan")]])).tolist() == [[0, 0, 0], [1, 0, 1], [2, 0, 1]]
    assert layout.start.tolist() == [0, 3, 4] and layout.last.tolist() == [False, False, True, True, False, True]


def table(spark, n=900):
    x, y = rows(n, 4)
    data = [(f"k{i}", int(y[i]), 1.0 + (i % 3), *[float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(data, "ID string, target int, weight double, " + ", ".join(f"`f({j})` double" for j in range(5))).repartition(5), [f"f({j})" for j in range(5)]


P = B.Params(rounds=6, depth=4, lr=0.2, subsample=0.7, colsample=0.8, min_child_weight=1.0, max_leaves=9)


def test_one_task_and_many_tasks_give_the_same(spark, tmp_path, monkeypatch):
    df, feats = table(spark)
    one = B.fit(df, feats, P)
    many = B.fit(df, feats, P, local_rows=0)
    scored = [{r["ID"]: r["probability_high"] for r in m.transform(df).collect()} for m in (one, many)]
    assert scored[0].keys() == scored[1].keys() and all(abs(scored[0][k] - scored[1][k]) < 1e-9 for k in scored[0])
    back = B.BoostedModel.load(spark, one.save(spark, str(tmp_path / "m")))
    assert {r["ID"]: r["probability_high"] for r in back.transform(df).collect()} == scored[0]
    assert abs(sum(one.importances()) - 1) < 1e-9 and one.importances()[4] == 0.0
    high, low = (np.mean([scored[0][r["ID"]] for r in df.where(F.col("target") == t).collect()]) for t in (1, 0))
    assert high > low + 0.2


@pytest.mark.parametrize("local_rows", [0, 10_000])
def test_a_fit_that_was_cut_off_goes_on(spark, monkeypatch, local_rows):
    monkeypatch.setattr(B, "CHECKPOINT_ROUNDS", 2)
    monkeypatch.setattr(B, "ROUNDS_A_JOB", 2)
    df, feats = table(spark, 300)
    kept, calls = [], []

    def save(first, trees, layout):
        calls.append(first)
        kept.extend(r for i, t in enumerate(trees) for r in B._tree_rows(first + i, t, layout))
        if len(calls) == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        B.fit(df, feats, P, save=save, local_rows=local_rows)
    assert calls == [0, 2]
    resumed = B.fit(df, feats, P, saved=lambda: list(kept), save=save, local_rows=local_rows)
    assert calls == [0, 2, 4]
    whole = B.fit(df, feats, P, local_rows=local_rows)
    x = rows(50, 9)[0]
    assert np.allclose(resumed.margins(x), whole.margins(x), atol=1e-9)


def test_missing_feature_values_and_no_rows(spark):
    df, feats = table(spark, 60)
    model = B.fit(df, feats, B.Params(rounds=2, depth=2))
    odd = spark.createDataFrame([(None, 1.0, float("nan"), 0.0, 0.0)], ", ".join(f"`f({j})` double" for j in range(5)))
    assert 0 < model.transform(odd).first()["probability_high"] < 1
    with pytest.raises(ValueError, match="no training rows"):
        B.fit(df.where("false"), feats, P)


def test_sums_are_exact_in_any_order_and_processes():
    """Features that share codes, shares of the rows in other processes and shuffled rows give the very same trees."""
    x, y = rows(4000, 7)
    x = np.column_stack([x, x[:, 1], x[:, 2] % 3, 1 - x[:, 1]])  # equal and mirrored features: ties
    w = np.where(y == 1, 3.0, 1 / 3)
    layout = B.Layout([sorted(set(np.quantile(c, np.arange(1, 40) / 40))) for c in x.T], unit=2.0 ** -38)
    assert len(layout.groups) < x.shape[1] and sorted(f for g in layout.groups for f, _ in g) == list(range(x.shape[1]))
    p = B.Params(rounds=5, depth=6, lr=0.2, subsample=0.8, colsample=0.7, min_child_weight=0.5, max_leaves=20)
    key = np.arange(len(y), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def trees(order, processes):
        block = B.Rows(*(a[order] for a in (layout.bins(x), y.astype(float), w, key, np.zeros(len(y)))))
        return [vars(t) for t in B.fit_rows(block, layout, p, 0, 5, processes)]

    shuffled = np.random.default_rng(0).permutation(len(y))
    one = trees(np.arange(len(y)), 1)
    assert one == trees(shuffled, 1) == trees(shuffled, 3)


def test_codes_add_up_to_bins():
    x, y = rows(500, 2)
    layout = B.Layout([sorted(set(c))[:40] for c in x.T], unit=2.0 ** -40)
    assert len(layout.groups) < x.shape[1] and len(B.Layout(layout.cuts).groups) == x.shape[1]
    bins = layout.bins(x)
    block = B.Rows(bins, y.astype(float), np.ones(500), np.arange(500, dtype=np.uint64), np.zeros(500))
    block.begin(layout, B.Params(), 0)
    g, h, n = block.sums(layout, B.Tree(), [0])
    for f in range(x.shape[1]):
        own = slice(layout.start[f], layout.start[f] + layout.size[f])
        assert n[0, own].tolist() == np.bincount(bins[:, f], minlength=layout.size[f]).tolist()
        assert np.allclose(g[0, own], np.bincount(bins[:, f], block.g, layout.size[f]))


def test_a_table_over_a_million_rows_is_one_tasks_work():
    """A job a level, 8 a round, does not finish 500 rounds over the 4,033,231 rows of 60 times sf0.1."""
    assert B.LOCAL_ROWS > 4_033_231


def test_fits_over_many_rows_take_processes(spark, monkeypatch):
    """A table over PROCESS_ROWS rows has shared codes, exact sums and processes, and scores as the plain form does."""
    df, feats = table(spark)
    plain = B.fit(df, feats, P)
    assert plain.layout.unit == 0
    monkeypatch.setattr(B, "PROCESS_ROWS", 300)
    one = B.fit(df, feats, P)
    assert one.layout.unit > 0
    many = B.fit(df, feats, P, local_rows=0)
    x = rows(200, 11)[0]
    assert np.array_equal(one.margins(x), many.margins(x)) and np.allclose(one.margins(x), plain.margins(x), atol=1e-6)
