"""Parquet sources: the driver's tables, one file (or directory) each."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; a column list is a projection Catalyst prunes into the scan."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def table_state(spark: SparkSession, sf_dir: str, names: list[str]) -> tuple:
    """(path, time of change, bytes, files) of each table: differs once a table was written again or added to. Files are
    summed by the file system; none is listed on the driver or read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
        fs = path.getFileSystem(conf)
        size = fs.getContentSummary(path)
        out.append((path.toString(), fs.getFileStatus(path).getModificationTime(), size.getLength(), size.getFileCount()))
    return tuple(out)
