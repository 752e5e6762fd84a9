"""Model queries (M1–M14, SM2): rows-only where libraries differ, SQL-checked
where the result is arithmetic (split sizes, hash sample)."""

from __future__ import annotations

import threading
import time
import uuid
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import eda
from quarry.operators import evaluation as ev
from quarry.operators import ml
from quarry.operators.clean import align_features
from quarry.plans.catalog import register
from quarry.plans.feature_queries import FEATURES
from quarry.plans.oracle_base import over_processed
from quarry.plans.stages import processed_with_meta
from quarry.session import stage_path
from quarry.sources.incidents import TABLES
from quarry.sources.registry import Registry, fingerprint
from quarry.sources.sinks import materialize, write_parquet
from quarry.sources.tables import table_path


_lock = threading.RLock()
FALLBACK_MODEL = "boosted_a"
_data: dict = {}

_U = "CAST(('0x' || substr(md5('42:' || ID), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0"


@register("split_sizes", over_processed(
    f"SELECT CASE WHEN {_U} < 0.2 THEN 'test' WHEN {_U} < 0.2 + 0.1 THEN 'val' ELSE 'train' END AS split, "
    "target, count(*) AS count FROM processed GROUP BY 1, 2"))
def split_sizes(spark, sf_dir):
    """M2: rows per split and class."""
    df, _, _ = processed_with_meta(spark, sf_dir)
    return ml.assign_split(df).groupBy("split", "target").agg(F.count(F.lit(1)).alias("count"))


@register("hash_sample", over_processed(
    "SELECT ID, Severity, State FROM processed ORDER BY md5('42:' || ID), ID LIMIT 50000"))
def hash_sample(spark, sf_dir):
    """SM2: reproducible 50,000-row sample by hashed key."""
    df, _, _ = processed_with_meta(spark, sf_dir)
    return eda.hash_sample(df.select("ID", "Severity", "State"), "ID", 50_000)


def data(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """(complete cases with their exact split, feature list), written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _lock:
        if key not in _data:
            df, _, feats = processed_with_meta(spark, sf_dir)
            _data[key] = (materialize(ml.exact_split(ml.model_matrix(df, feats)), "model-data"), feats)
        return _data[key]


def registry(spark, sf_dir, profile: str = "full") -> Registry:
    """The store of the models of these files, features and parameters."""
    paths = [table_path(sf_dir, t) for t in TABLES]
    return Registry(spark, fingerprint(spark, paths, [ml.PROFILES[profile], FEATURES, ml.SEED, "exact split"]))


def fitted(spark, sf_dir, names=None, profile: str = "full") -> Registry:
    """The store, with every model in ``names`` (all, if None) in it: those that are not there are fitted side by side, and each is stored
    with its scores of the validation and test rows as soon as it is done (M8, M10)."""
    store = registry(spark, sf_dir, profile)
    names = list(names or ml.PROFILES[profile])
    with _lock:
        have = {r["name"] for r in store.models().collect()}
        missing = [n for n in names if n not in have]
        if missing:
            rows, feats = data(spark, sf_dir)
            train, held = rows.where(F.col("split") == "train"), rows.where(F.col("split") != "train")
            sizes = {(r["split"], r["target"]): r["n"] for r in rows.groupBy("split", "target").agg(F.count(F.lit(1)).alias("n")).collect()}

            def size(split=None, target=None):
                return sum(n for (s, t), n in sizes.items() if split in (None, s) and target in (None, t))

            def fit(name: str) -> None:
                t = time.time()
                model = ml.fit_model(name, train, feats, profile, saved=lambda: store.partial_trees(name),
                                     save=lambda first, trees, layout: store.store_trees(name, first, trees, layout))
                seconds, folder = time.time() - t, store.new_folder(name)
                ml.save_model(model, folder + "/model")
                ml.score(model, held).select(F.lit(name).alias("model"), "split", F.col("target").alias("label"),
                                             F.col("probability_high").alias("score")).write.parquet(folder + "/scores")
                store.commit(name=name, kind=ml.kind_of(model), path=folder, train_time_sec=float(seconds), n_train=size("train"), n_val=size("val"),
                             n_test=size("test"), n_features=len(feats), features=feats,
                             class_distribution={str(c): size(target=c) for c in sorted({c for _, c in sizes})})

            with ThreadPool(len(missing)) as pool:
                pool.map(inheritable_thread_target(spark)(fit), missing)
    return store


def held_scores(spark, sf_dir, split: str):
    store = fitted(spark, sf_dir)
    return store.scores(list(ml.PROFILES["full"])).where(F.col("split") == split).drop("split")


@register("train_summary")
def train_summary(spark, sf_dir):
    """M8: validation AUC / weighted F1 / precision / recall, time, sizes and class counts per model, and where it is stored."""
    m = ev.metrics_table(held_scores(spark, sf_dir, "val"))
    fits = fitted(spark, sf_dir).models().withColumnRenamed("name", "model")
    return m.join(fits, "model").select(
        F.col("model").alias("model_name"), F.col("test_auc").alias("val_auc"), F.col("test_f1").alias("val_f1"),
        F.col("test_precision").alias("val_precision"), F.col("test_recall").alias("val_recall"),
        F.round("train_time_sec", 2).alias("train_time_sec"), "n_train", "n_val", "n_features",
        F.to_json("class_distribution").alias("class_distribution"), F.col("path").alias("model_path"))


#: The exact split, restated: places of each class's rows by hashed key.
_SPLIT = ("SELECT ID, target, CASE WHEN rn <= (n + 4) // 5 THEN 'test' WHEN rn <= (n + 4) // 5 + (n - (n + 4) // 5 + 7) // 8 THEN 'val' ELSE 'train' END AS split "
          "FROM (SELECT ID, target, row_number() OVER (PARTITION BY target ORDER BY md5('42:' || ID), ID) AS rn, "
          "count(*) OVER (PARTITION BY target) AS n FROM processed)")


@register("exact_split_sizes", over_processed(f"SELECT split, target, count(*) AS count FROM ({_SPLIT}) GROUP BY 1, 2"))
def exact_split_sizes(spark, sf_dir):
    """M2, exact: rows per split and class of the split that models are trained on."""
    return data(spark, sf_dir)[0].groupBy("split", "target").agg(F.count(F.lit(1)).alias("count"))


@register("exact_split", over_processed(_SPLIT))
def exact_split(spark, sf_dir):
    """M2, exact: the split of every row."""
    return data(spark, sf_dir)[0].select("ID", "target", "split")


@register("train_checks", over_processed(
    "SELECT m.model_name, count(*) FILTER (WHERE split = 'train') AS n_train, "
    f"count(*) FILTER (WHERE split = 'val') AS n_val, {len(FEATURES)} AS n_features, "
    "true AS classes_counted, true AS auc_above_chance "
    f"FROM ({_SPLIT}), "
    "(SELECT unnest(['logistic_regression', 'random_forest', 'boosted_a', 'boosted_b']) AS model_name) m GROUP BY 1"))
def train_checks(spark, sf_dir):
    """M8, what is determined: models, split sizes, feature count, class counts; validation AUC is above that of chance by 0.45 at least."""
    rows, _ = data(spark, sf_dir)
    counts = rows.agg(F.count_if(F.col("target") == 0).alias("n0"), F.count_if(F.col("target") == 1).alias("n1"))
    s = train_summary(spark, sf_dir).crossJoin(F.broadcast(counts))  # one row
    told = F.to_json(F.create_map(F.lit("0"), F.col("n0"), F.lit("1"), F.col("n1")))
    return s.select("model_name", "n_train", "n_val", "n_features", (F.col("class_distribution") == told).alias("classes_counted"),
                    (F.col("val_auc") > 0.45).alias("auc_above_chance"))


@register("stored_models", over_processed(
    "SELECT m.model_name AS name, m.kind, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, "
    f"count(*) FILTER (WHERE split = 'test') AS n_test, {len(FEATURES)} AS n_features FROM ({_SPLIT}), "
    "(SELECT unnest([{'model_name': 'logistic_regression', 'kind': 'pipeline'}, {'model_name': 'boosted_a', 'kind': 'boosted'}], recursive := true)) m GROUP BY 1, 2"))
def stored_models(spark, sf_dir):
    """Models listed from the registry (a linear and a boosted one), with what the manifest says of them."""
    names = ["logistic_regression", "boosted_a"]
    rows = fitted(spark, sf_dir, names).models().where(F.col("name").isin(names))
    return rows.select("name", "kind", "n_train", "n_val", "n_test", "n_features")


def best_model(spark, sf_dir):
    """The stored model with the best test AUC, loaded by name; where no test metrics are stored, FALLBACK_MODEL."""
    store = registry(spark, sf_dir)
    name = ml.best_by(store.metrics().withColumnRenamed("model_name", "model"), default=FALLBACK_MODEL)
    store = fitted(spark, sf_dir, [name])
    rows, feats = data(spark, sf_dir)
    return name, store.load(name), feats, rows


@register("batch_predict")
def batch_predict(spark, sf_dir):
    """Score the held-out test split, aligned to the stored features, with the best model."""
    name, model, feats, data_ = best_model(spark, sf_dir)
    test = align_features(data_.where(F.col("split") == "test"), feats, keep=["ID", "target"])
    s = ml.score(model, test)
    return s.select("ID", "target", "prediction", F.col("probability_high").alias("probability"),
                    "severity_label", "risk_band", F.lit(name).alias("model"))


@register("predict_checks", over_processed(
    "SELECT ID, target, true AS in_range, true AS class_follows, true AS label_follows, true AS band_follows "
    f"FROM ({_SPLIT}) WHERE split = 'test'"))
def predict_checks(spark, sf_dir):
    """M12, what is determined: one row per test row; class, label and band follow from the probability."""
    p = F.col("probability")
    band = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), 1 + (p >= 0.35).cast("int") + (p >= 0.65).cast("int"))
    return batch_predict(spark, sf_dir).select(
        "ID", "target", p.between(0, 1).alias("in_range"), ((F.col("prediction") == 1) == (p >= 0.5)).alias("class_follows"),
        ((F.col("severity_label") == "High") == (p >= 0.5)).alias("label_follows"), (F.col("risk_band") == band).alias("band_follows"))


@register("test_metrics")
def test_metrics(spark, sf_dir):
    """E9 on model output: test-set metrics of every trained model; stored beside the models, and read from there when they are there."""
    store = fitted(spark, sf_dir)
    with _lock:
        if store.metrics().count() < len(ml.PROFILES["full"]):
            m = ev.metrics_table(held_scores(spark, sf_dir, "test")).withColumnRenamed("model", "model_name")
            sizes = store.models().select(F.col("name").alias("model_name"), "n_train", "n_test")
            store.store_metrics(m.join(sizes, "model_name"))
    return store.metrics().drop("created_at").withColumnRenamed("model_name", "model")


@register("feature_importance")
def feature_importance(spark, sf_dir):
    """Top-20 importances per model."""
    store = fitted(spark, sf_dir)
    rows = [(n, f, v) for n in ml.PROFILES["full"] for f, v in ml.feature_importance(store.load(n), store.entry(n)["features"])]
    df = spark.createDataFrame(rows, "model string, feature string, importance double")
    w = Window.partitionBy("model").orderBy(F.col("importance").desc(), "feature")
    return df.withColumn("rank", F.row_number().over(w)).where("rank <= 20")


@register("learning_curve")
def learning_curve(spark, sf_dir):
    """Logistic regression AUC for 6 training fractions × 3 hash folds.

    Each fit, several side by side, writes its held-out (fraction, fold, label, score) rows to a
    folder; all 18 AUCs then come from a single grouped metric job."""
    rows, feats = data(spark, sf_dir)
    # Written once: every fit below starts from a short plan.
    d = materialize(rows.where(F.col("split") == "train").select("ID", "target", *[F.col(f"`{c}`") for c in feats])
                    .withColumn("_u", ml.unit_hash(F.col("ID"), 7)), "lc-train")
    path = stage_path(spark, "learning-curve", f"scores-{uuid.uuid4().hex}")
    def fit(job) -> None:
        frac, fold = job
        lo, hi = fold / 3.0, (fold + 1) / 3.0
        held = d.where((F.col("_u") >= lo) & (F.col("_u") < hi))
        rest = d.where((F.col("_u") < lo) | (F.col("_u") >= hi))
        sub = rest.where(ml.unit_hash(F.col("ID"), 11) < frac)
        m = ml.fit_model("logistic_regression", sub, feats)
        ml.score(m, held).select(F.lit(frac).alias("fraction"), F.lit(fold).alias("fold"),
                                 F.col("target").alias("label"), F.col("probability_high").alias("score")) \
            .write.parquet(f"{path}/{frac}-{fold}")

    with ThreadPool(ml.side_by_side(spark)) as pool:
        pool.map(inheritable_thread_target(spark)(fit), [(frac, fold) for frac in (1.0, 0.82, 0.64, 0.46, 0.28, 0.1) for fold in range(3)], chunksize=1)
    auc = ev.roc_auc(spark.read.parquet(f"{path}/*"), by=["fraction", "fold"])
    return auc.groupBy("fraction").agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))


@register("test_split", over_processed(
    f"SELECT ID, target FROM processed WHERE {_U} < 0.2"))
def test_split(spark, sf_dir):
    """M3: the held-out test split, written under the shared folder and read back."""
    df, _, _ = processed_with_meta(spark, sf_dir)
    path = stage_path(spark, "splits", f"test-{uuid.uuid4().hex}")
    write_parquet(ml.assign_split(df).where(F.col("split") == "test"), path)      # with all features
    return spark.read.parquet(path).select("ID", "target")


@register("model_comparison")
def model_comparison(spark, sf_dir):
    """J2 + T5: test metrics left-joined with the training summary (broadcast:
    one row per model), ranked by test AUC then AP."""
    tm = test_metrics(spark, sf_dir)
    ts = train_summary(spark, sf_dir)
    tm = tm.drop("n_train", "n_test")
    out = tm.join(F.broadcast(ts), tm["model"] == ts["model_name"], "left").drop("model_name")
    return out.drop("class_distribution").orderBy(F.col("test_auc").desc(), F.col("test_ap").desc(), "model")


def _search(spark, sf_dir):
    rows, feats = data(spark, sf_dir)
    path = stage_path(spark, "search", uuid.uuid4().hex)
    out = ml.random_search(rows.where(F.col("split") == "train"), feats, path)
    return out, path


@register("random_search")
def random_search(spark, sf_dir):
    """20 draws x 3 folds of the logistic profile, ranked by mean AUC."""
    return _search(spark, sf_dir)[0]


_U13 = "CAST(('0x' || substr(md5('13:' || ID), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0"


@register("search_folds", over_processed(
    f"SELECT d.draw, CAST(floor({_U13} * 3) AS INTEGER) AS fold, count(*) AS held, CAST(sum(target) AS BIGINT) AS held_high, true AS in_range "
    f"FROM ({_SPLIT}), (SELECT CAST(unnest(range({ml.SEARCH_DRAWS})) AS INTEGER) AS draw) d WHERE split = 'train' GROUP BY 1, 2"))
def search_folds(spark, sf_dir):
    """M15, what is determined: held-out rows and classes of every draw and fold; scores are probabilities."""
    _, path = _search(spark, sf_dir)
    rows = spark.read.parquet(f"{path}/*")
    return rows.groupBy("draw", "fold").agg(F.count(F.lit(1)).alias("held"), F.sum("label").cast("long").alias("held_high"),
                                            F.min(F.col("score").between(0, 1)).alias("in_range"))
