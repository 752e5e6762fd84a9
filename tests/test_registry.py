"""The model registry across sessions, exact splits and samples by selection."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quarry.functions.stats import kth_smallest
from quarry.operators import boosting, eda, ml
from quarry.sources import registry


def test_fingerprint_follows_files_and_parameters(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    a = registry.fingerprint(spark, [path], {"x": 1})
    assert a == registry.fingerprint(spark, [path], {"x": 1}) != registry.fingerprint(spark, [path], {"x": 2})
    spark.range(4).write.mode("overwrite").parquet(path)
    assert a != registry.fingerprint(spark, [path], {"x": 1})


def entry(store, name, path, seconds=1.0):
    store.commit(name=name, kind="boosted", path=path, train_time_sec=seconds, n_train=8, n_val=1, n_test=2, n_features=2,
                 features=["a", "b"], class_distribution={"0": 5, "1": 6})


def test_store_and_second_session(spark, tmp_path):
    store = registry.Registry(spark, "ab" * 16 + str(tmp_path).replace("/", "-"))
    assert store.models().count() == 0 and store.metrics().count() == 0 and store.partial_trees("m") == []
    with pytest.raises(KeyError):
        store.load("m")
    tree = boosting.Tree()
    tree.split(0, 1, 0, 2.0)
    tree.value = [0.0, -1.0, 1.0]
    model = boosting.BoostedModel(["a", "b"], 0.5, boosting.Layout([[0.0], [1.0]]), [tree])
    folder = store.new_folder("m")
    ml.save_model(model, folder + "/model")
    assert store.models().count() == 0  # nothing is visible before the manifest
    entry(store, "m", folder)
    entry(store, "m", "/nowhere", 2.0)  # a second session that fitted at the same time: the first entry counts
    assert [(r["name"], r["path"], r["class_distribution"]) for r in store.models().collect()] == [("m", folder, {"0": 5, "1": 6})]
    assert store.load("m").trees[0].value == [0.0, -1.0, 1.0]
    code = ("import sys; sys.path.insert(0, sys.argv[1])\n"
            "from quarry.session import get_session\nfrom quarry.sources.registry import Registry\n"
            "s = get_session(master='local[1]', extra={'spark.checkpoint.dir': sys.argv[2]})\n"
            "m = Registry(s, sys.argv[3]).load('m'); print('again', m.features, m.base, m.trees[0].gain[0])")
    from conftest import ROOT

    from quarry.session import checkpoint_dir
    out = subprocess.run([sys.executable, "-c", code, ROOT, checkpoint_dir(spark), store.print], capture_output=True, text=True, timeout=120)
    assert "again ['a', 'b'] 0.5 2.0" in out.stdout, out.stderr[-2000:]


def test_partial_trees_of_two_writers(spark, tmp_path):
    store = registry.Registry(spark, "cd" * 16 + str(tmp_path).replace("/", "-"))
    layout = boosting.Layout([[0.0]])
    for first, n in ((0, 2), (2, 1), (0, 1), (4, 1)):  # rounds 0 to 2 are whole, 0 twice, 3 is missing
        store.store_trees("m", first, [boosting.Tree() for _ in range(n)], layout)
    assert [r["round"] for r in sorted(store.partial_trees("m"), key=lambda r: r["round"])] == [0, 1, 2]


def test_exact_split_sizes_and_order(spark):
    data = [(f"id{i}", i % 7 == 0) for i in range(1003)]
    df = spark.createDataFrame([(k, int(t)) for k, t in data], "ID string, target int").repartition(5)
    rows = ml.exact_split(df).withColumn("h", ml.hash_key(F.col("ID"))).collect()
    for t in (0, 1):
        mine = sorted((r["h"], r["split"]) for r in rows if r["target"] == t)
        n = len(mine)
        test = -(-n // 5)
        val = -(-(n - test) // 8)
        assert [s for _, s in mine] == ["test"] * test + ["val"] * val + ["train"] * (n - test - val)


@pytest.mark.parametrize("few", [1, 50, 10_000])
def test_kth_smallest(spark, few):
    df = spark.range(700).select((F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    df = df.unionAll(df.limit(30))  # repeated hashes
    sorted_ = {g: sorted(r["h"] for r in df.where(F.col("g") == g).collect()) for g in (0, 1)}
    ks = [1, 2, 17, 300]
    got = kth_smallest(df, "g", "h", {g: [0, *ks, 10_000] for g in (0, 1)}, digits=2, few=few)
    assert got == {g: ["", *[sorted_[g][k - 1] for k in ks], sorted_[g][-1]] for g in (0, 1)}


def test_hash_sample(spark):
    df = spark.range(500).withColumn("x", F.col("id") * 2)
    want = [r["id"] for r in df.orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string")))).limit(77).collect()]
    out = eda.hash_sample(df, "id", 77)
    assert sorted(r["id"] for r in out.collect()) == sorted(want)
    assert "SinglePartition" not in out._jdf.queryExecution().toString() and eda.hash_sample(df, "id", 1000).count() == 500
    assert eda.hash_sample(df.where("false"), "id", 10).count() == 0
