"""Durable model registry (M8, M10, M11, S9): models, held-out scores, metrics and summaries by fingerprint.

The fingerprint covers the input files (path, size, time of change) and all training parameters, so a later session
finds what an earlier one has fitted and nothing stale. Everything of one fit goes to a folder of
its own; its row in the manifest comes last, so a reader sees whole models only. Every write is a folder of its
own and readers list the folders, so sessions that write at the same time do not meet. Of several entries of a name, the earliest counts. Trees of a
boosted model that is not finished are kept too, and a fit that was cut off goes on from them.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.boosting import TREE_SCHEMA, Layout, Tree, _tree_rows
from quarry.session import store_path
from quarry.sources.sinks import METRICS_SCHEMA, conform

MANIFEST = ("name string, kind string, path string, train_time_sec double, n_train long, n_val long, n_test long, n_features int, "
            "features array<string>, class_distribution map<string,long>, created_at timestamp")


def fingerprint(spark: SparkSession, paths: list[str], params) -> str:
    """MD5 over the files under ``paths`` (listed, not read) and ``params`` (JSON-able)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    listed = sorted((r["path"], r["length"], str(r["modificationTime"])) for r in files.select("path", "length", "modificationTime").collect())
    return hashlib.md5(json.dumps([listed, params], sort_keys=True, default=str).encode()).hexdigest()


class Registry:
    """The entries of one fingerprint."""

    def __init__(self, spark: SparkSession, print_: str):
        self.spark, self.print = spark, print_

    def folder(self, *parts: str) -> str:
        return store_path(self.spark, "models", self.print, *parts)

    def _read(self, schema, *parts: str, format: str = "json") -> DataFrame:
        try:
            return self.spark.read.schema(schema).format(format).load(self.folder(*parts, "*"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    # -------------------------------------------------------- models
    def models(self) -> DataFrame:
        """One row a stored model: the manifest's earliest entry of each name."""
        first = Window.partitionBy("name").orderBy("created_at", "path")  # a few rows a model
        return self._read(MANIFEST, "manifest").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")

    def entry(self, name: str):
        return self.models().where(F.col("name") == name).first()

    def new_folder(self, name: str) -> str:
        return self.folder("fits", f"{name}-{uuid.uuid4().hex}")

    def commit(self, **entry) -> None:
        """The manifest row of a model whose files are all written."""
        row = self.spark.createDataFrame([entry], MANIFEST.replace(", created_at timestamp", ""))
        row.withColumn("created_at", F.current_timestamp()).coalesce(1).write.json(self.folder("manifest", uuid.uuid4().hex))

    def load(self, name: str):
        """The stored model called ``name``; KeyError where there is none."""
        from quarry.operators.ml import load_model

        found = self.entry(name)
        if found is None:
            raise KeyError(name)
        return load_model(found["path"] + "/model", found["kind"])

    def scores(self, names: list[str]) -> DataFrame:
        """(model, split, label, score) of the held-out rows of stored models."""
        paths = [r["path"] + "/scores" for r in self.models().where(F.col("name").isin(names)).collect()]
        return self.spark.read.parquet(*paths)

    # -------------------------------------------------------- metrics
    def metrics(self) -> DataFrame:
        """Stored test metrics, one row a model."""
        first = Window.partitionBy("model_name").orderBy("created_at")
        rows = self._read(METRICS_SCHEMA, "metrics", format="parquet")
        return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")

    def store_metrics(self, rows: DataFrame) -> None:
        conform(rows.withColumn("created_at", F.current_timestamp()), METRICS_SCHEMA).coalesce(1).write.parquet(self.folder("metrics", uuid.uuid4().hex))

    # -------------------------------------------------------- unfinished boosted models
    def partial_trees(self, name: str) -> list:
        """Stored tree rows of an unfinished fit, up to the first round that is missing; of several writers one a round."""
        rows = self._read(TREE_SCHEMA + ", writer string", "partial", name, format="parquet")
        one = rows.withColumn("_w", F.min("writer").over(Window.partitionBy("round"))).where("writer = _w").drop("_w", "writer").collect()
        known = {r["round"] for r in one}
        whole = next(i for i in range(len(known) + 1) if i not in known)
        return [r for r in one if r["round"] < whole]

    def store_trees(self, name: str, first: int, trees: list[Tree], layout: Layout) -> None:
        rows = [tuple(r.values()) for i, t in enumerate(trees) for r in _tree_rows(first + i, t, layout)]
        writer = uuid.uuid4().hex
        self.spark.createDataFrame(rows, TREE_SCHEMA).withColumn("writer", F.lit(writer)).coalesce(1) \
            .write.parquet(self.folder("partial", name, writer))


def all_models(spark: SparkSession) -> DataFrame:
    """Every stored model of every fingerprint."""
    try:
        rows = spark.read.schema(MANIFEST).json(store_path(spark, "models", "*", "manifest", "*"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST + ", fingerprint string")
    return rows.withColumn("fingerprint", F.regexp_extract(F.col("path"), r"/models/([0-9a-f]{32})/", 1))
