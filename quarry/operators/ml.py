"""Modelling on Spark ML.

Training is Spark ML's distributed optimisers / tree learners: the driver
loops over models, executors aggregate gradients and split statistics.
Boosting checkpoints to the shared checkpoint folder (set in the session)
so long fits survive executor loss. Splits are hash-based (no shuffle, no
``rand``), so a re-run or a recomputed partition gives the same rows.
"""

from __future__ import annotations

import time
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.stats import kth_smallest, qcol
from quarry.operators import boosting, forest

SEED = 42
TEST_SIZE, VAL_SIZE = 0.2, 0.1

# The reference's model configuration ("full", what every query fits), and a light
# profile with fewer/shallower trees that unit tests ask for.
PROFILES = {
    "full": {
        "logistic_regression": {"C": 1.0, "max_iter": 1000},
        "random_forest": {"trees": 300, "depth": 15, "min_leaf": 4},
        "boosted_a": {"rounds": 500, "depth": 8, "lr": 0.05, "subsample": 0.8, "colsample": 0.8, "min_child_weight": 5.0,
                      "gamma": 0.1, "l1": 0.1, "l2": 1.0, "pos_weight": 3.0},
        # Row samples of this profile's library are off unless a sampling frequency is set, which is not.
        "boosted_b": {"rounds": 500, "depth": 8, "lr": 0.05, "colsample": 0.8, "max_leaves": 63, "min_child_samples": 20,
                      "l1": 0.1, "l2": 1.0, "balanced": True},
    },
    "light": {
        "logistic_regression": {"C": 1.0, "max_iter": 100},
        "random_forest": {"trees": 20, "depth": 8, "min_leaf": 4},
        "boosted_a": {"rounds": 20, "depth": 5, "lr": 0.1, "subsample": 0.8, "pos_weight": 3.0},
        "boosted_b": {"rounds": 20, "depth": 5, "lr": 0.1, "max_leaves": 15, "min_child_samples": 20, "balanced": True},
    },
}


OWN = (boosting.BoostedModel, forest.ForestModel)


# ---------------------------------------------------------------- M2 split
def unit_hash(key: Column, seed: int = SEED) -> Column:
    """Deterministic uniform [0, 1) from md5(seed:key) (first 32 bits)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def assign_split(df: DataFrame, key: str = "ID", seed: int = SEED,
                 test_size: float = TEST_SIZE, val_size: float = VAL_SIZE) -> DataFrame:
    """70/10/20 by hash: proportions hold in every stratum in expectation,
    because the hash is independent of the label; no shuffle."""
    u = unit_hash(qcol(key), seed)
    return df.withColumn("split", F.when(u < test_size, "test")
                         .when(u < test_size + val_size, "val").otherwise("train"))


def hash_key(key: Column, seed: int = SEED) -> Column:
    """128 bits of hash as text of fixed length, whose order is a reproducible random order of the keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def exact_split(df: DataFrame, key: str = "ID", target: str = "target", seed: int = SEED) -> DataFrame:
    """M2, exact: of each class's n rows, ceil(n / 5) are test and an eighth of the rest (rounded up) val, by
    the order of hashed keys (unique, not null). A map with two bounds a class: no row is sorted or moved."""
    d = df.withColumn("_hash", hash_key(qcol(key), seed))
    sizes = {r[target]: r["n"] for r in df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    wanted = {}
    for c, n in sizes.items():
        test = -(-n // 5)
        wanted[c] = [test, test + -(-(n - test) // 8)]
    bounds = kth_smallest(d, target, "_hash", wanted)
    split = F.lit(None).cast("string")
    for c, (a, b) in bounds.items():
        mine = qcol(target).eqNullSafe(F.lit(c))
        split = F.when(mine, F.when(F.col("_hash") <= F.lit(a), "test").when(F.col("_hash") <= F.lit(b), "val").otherwise("train")).otherwise(split)
    return d.withColumn("split", split).drop("_hash")


# ---------------------------------------------------------------- M1 / M9
def model_matrix(df: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """M1: complete cases over features + target, booleans as numbers."""
    keep = [qcol(c) for c in df.columns if c not in features]
    cols = [qcol(f).cast("double").alias(f) for f in features]
    return df.select(*keep, *cols).na.drop(subset=[*features, target])


def with_class_weights(df: DataFrame, target: str = "target", mode: str = "balanced",
                       pos_weight: float = 3.0) -> DataFrame:
    """M9: ``balanced`` = N / (2·n_class) from one small aggregation; ``pos``
    = fixed positive-class weight."""
    if mode == "pos":
        return df.withColumn("weight", F.when(F.col(target) == 1, F.lit(pos_weight)).otherwise(F.lit(1.0)))
    counts = {r[target]: r["n"] for r in df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    w = {k: n / (2.0 * v) for k, v in counts.items() if v}
    expr = F.lit(1.0)
    for k, v in w.items():
        expr = F.when(F.col(target) == k, F.lit(v)).otherwise(expr)
    return df.withColumn("weight", expr)


# ---------------------------------------------------------------- M4–M7
def side_by_side(spark: SparkSession) -> int:
    """How many linear fits run at a time: an iteration is a job of short tasks, so one fit leaves most cores waiting for the driver."""
    return min(12, max(4, spark.sparkContext.defaultParallelism))


def build_pipeline(name: str, features: list[str], params: dict, n_weighted: float | None = None) -> Pipeline:
    asm = VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="keep")
    if name == "logistic_regression":
        scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
        reg = 1.0 / (params["C"] * (n_weighted or 1.0))
        clf = LogisticRegression(featuresCol="features", labelCol="target", weightCol="weight",
                                 maxIter=params["max_iter"], regParam=reg, elasticNetParam=0.0,
                                 standardization=False)
        return Pipeline(stages=[asm, scaler, clf])
    if name == "random_forest":
        clf = RandomForestClassifier(featuresCol="raw_features", labelCol="target", weightCol="weight",
                                     numTrees=params["trees"], maxDepth=params["depth"],
                                     minInstancesPerNode=params["min_leaf"], featureSubsetStrategy="sqrt",
                                     cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=1024, seed=SEED)
        return Pipeline(stages=[asm, clf])
    raise ValueError(name)


def probability_high(scored: DataFrame) -> DataFrame:
    """Positive-class probability as a plain double column."""
    return scored.withColumn("probability_high", vector_to_array("probability").getItem(1))


def boosting_params(p: dict) -> boosting.Params:
    return boosting.Params(**{k: v for k, v in p.items() if k not in ("pos_weight", "balanced")}, seed=SEED)


def fit_model(name: str, train: DataFrame, features: list[str], profile: str = "full", saved=None, save=None):
    """One fitted model of a profile (M4–M7). ``saved`` and ``save`` keep the trees of unfinished boosted models."""
    p = PROFILES[profile][name]
    d = with_class_weights(train, mode="pos", pos_weight=p["pos_weight"]) if "pos_weight" in p else with_class_weights(train)
    if name in ("boosted_a", "boosted_b"):
        return boosting.fit(d, features, boosting_params(p), saved=saved, save=save)
    size = d.agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).first()
    if name == "random_forest" and 0 < size["n"] <= boosting.LOCAL_ROWS:
        return forest.fit(d, features, forest.Params(p["trees"], p["depth"], p["min_leaf"], SEED))
    return build_pipeline(name, features, p, size["weight"]).fit(d)


def train_models(train: DataFrame, features: list[str], profile: str = "full",
                 models: list[str] | None = None, parallelism: int = 4) -> dict:
    """M8: fit every enabled model, ``parallelism`` at a time; returns {name: (model, seconds)}."""
    def fit(name: str):
        t = time.time()
        return name, (fit_model(name, train, features, profile), time.time() - t)

    with ThreadPool(parallelism) as pool:
        return dict(pool.map(inheritable_thread_target(train.sparkSession)(fit), models or list(PROFILES[profile])))


def score(model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Probability of the high class, class at ≥ threshold, labels and bands."""
    s = model.transform(df) if isinstance(model, OWN) else probability_high(model.transform(df))
    p = F.col("probability_high")
    return s.withColumn("prediction", (p >= threshold).cast("int")) \
        .withColumn("severity_label", F.when(F.col("prediction") == 1, "High").otherwise("Low")) \
        .withColumn("probability_4dp", F.round(p, 4)) \
        .withColumn("risk_band", F.when(p < 0.35, "low").when(p < 0.65, "medium").otherwise("high"))


def feature_importance(model, features: list[str]) -> list[tuple[str, float]]:
    """Tree importances, or absolute standardised coefficients."""
    if isinstance(model, OWN):
        return list(zip(model.features, [float(v) for v in model.importances()]))
    clf = model.stages[-1]
    if hasattr(clf, "featureImportances"):
        vals = clf.featureImportances.toArray()
    else:
        vals = [abs(v) for v in clf.coefficients.toArray()]
    return list(zip(features, [float(v) for v in vals]))


def kind_of(model) -> str:
    return {boosting.BoostedModel: "boosted", forest.ForestModel: "forest"}.get(type(model), "pipeline")


def save_model(model, path: str) -> str:
    """M10."""
    if isinstance(model, OWN):
        return model.save(SparkSession.active(), path)
    model.write().overwrite().save(path)
    return path


def best_by(metrics: DataFrame, by: str = "test_auc", default: str = "boosted_a") -> str:
    """The model with the highest ``by`` (ties: first name); ``default`` without metrics."""
    top = metrics.orderBy(F.col(by).desc_nulls_last(), "model").first()
    return top["model"] if top is not None else default


def load_model(path: str, kind: str = "pipeline"):
    own = {"boosted": boosting.BoostedModel, "forest": forest.ForestModel}.get(kind)
    if own:
        return own.load(SparkSession.active(), path)
    return PipelineModel.load(path)


def tune(train: DataFrame, features: list[str], folds: int = 3,
         reg_params=(0.001, 0.01, 0.1, 1.0), parallelism: int = 2):
    """K-fold grid search of the logistic-regression profile by exact
    ROC AUC (``numBins=0``); returns the fitted ``CrossValidatorModel``."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    d = with_class_weights(train)
    pipe = build_pipeline("logistic_regression", features, PROFILES["full"]["logistic_regression"])
    lr = pipe.getStages()[-1]
    grid = ParamGridBuilder().addGrid(lr.regParam, list(reg_params)).build()
    ev = BinaryClassificationEvaluator(labelCol="target", rawPredictionCol="rawPrediction",
                                       metricName="areaUnderROC", numBins=0)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=ev, numFolds=folds,
                        seed=SEED, parallelism=parallelism)
    return cv.fit(d)


#: Draws and folds of the random search.
SEARCH_DRAWS, SEARCH_FOLDS = 20, 3


def search_draws(n: int = SEARCH_DRAWS, seed: int = SEED) -> list[dict]:
    """Parameter draws of the logistic profile: inverse regularisation log-uniform in [1e-4, 1e2], elastic-net share uniform
    in [0, 1], and class weights balanced or none, each from its own stream of the seed."""
    import random

    c, share, balance = (random.Random(f"{seed}-{k}") for k in ("C", "l1_ratio", "weight"))
    return [{"draw": i, "C": 10 ** c.uniform(-4, 2), "l1_ratio": share.uniform(0, 1), "balanced": balance.random() < 0.5} for i in range(n)]


def random_search(train: DataFrame, features: list[str], scores: str, draws: list[dict] | None = None, folds: int = SEARCH_FOLDS,
                  key: str = "ID", target: str = "target", max_iter: int = 100, parallelism: int | None = None) -> DataFrame:
    """(draw, C, l1_ratio, balanced, mean_auc, std_auc, rank) of every draw over ``folds`` folds.

    Rows are dealt to folds by hashed key. Every fold's training rows are assembled and written once, and all
    draws fit on that table; each fit appends its held-out scores to ``scores``, and one grouped job gives all AUCs."""
    from quarry.operators.evaluation import roc_auc
    from quarry.sources.sinks import materialize

    spark = train.sparkSession
    draws = draws or search_draws()
    asm = VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="keep")
    fold = F.floor(unit_hash(qcol(key), 13) * folds).cast("int")
    rows = asm.transform(train).select(F.col(target).alias("target"), "raw_features", fold.alias("fold"))
    tables = []
    for k in range(folds):
        fit_rows = with_class_weights(rows.where(F.col("fold") != k))
        scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True).fit(fit_rows)
        tables.append((materialize(scaler.transform(fit_rows).withColumn("one", F.lit(1.0)).drop("raw_features"), "fold-train"),
                       materialize(scaler.transform(rows.where(F.col("fold") == k)).select("target", "features"), "fold-held")))
    sizes = [t.agg(F.sum("weight"), F.sum("one")).first() for t, _ in tables]

    def fit(job) -> None:
        d, k = job
        train_, held = tables[k]
        total = sizes[k][0 if d["balanced"] else 1] or 1.0
        lr = LogisticRegression(featuresCol="features", labelCol="target", weightCol="weight" if d["balanced"] else "one", maxIter=max_iter,
                                regParam=1.0 / (d["C"] * total), elasticNetParam=d["l1_ratio"], standardization=False)
        out = probability_high(lr.fit(train_).transform(held))
        out.select(F.lit(d["draw"]).alias("draw"), F.lit(k).alias("fold"), F.col("target").alias("label"), F.col("probability_high").alias("score")) \
            .write.parquet(f"{scores}/{d['draw']}-{k}")

    with ThreadPool(parallelism or side_by_side(spark)) as pool:
        pool.map(inheritable_thread_target(spark)(fit), [(d, k) for d in draws for k in range(folds)], chunksize=1)
    auc = roc_auc(spark.read.parquet(f"{scores}/*"), by=["draw", "fold"])
    told = spark.createDataFrame([(d["draw"], d["C"], d["l1_ratio"], d["balanced"]) for d in draws], "draw int, C double, l1_ratio double, balanced boolean")
    out = auc.groupBy("draw").agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc")).join(F.broadcast(told), "draw")
    from pyspark.sql import Window
    best = Window.orderBy(F.col("mean_auc").desc_nulls_last(), "draw")  # a row a draw
    return out.select("draw", "C", "l1_ratio", "balanced", "mean_auc", "std_auc", F.row_number().over(best).alias("rank"))
