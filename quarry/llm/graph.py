"""Written tables, and connected components of an edge table, in Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import stage_path


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows, written under the shared checkpoint folder and read again: lineage ends there. ``compression`` is a
    Parquet codec (none given: the session's)."""
    spark = df.sparkSession
    path = stage_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the smallest node of its component.

    Each round every node chooses the smallest node next to it (or itself), chains of choices are followed to
    their ends by doubling, and edges are drawn between ends, each once. At least half of the
    linked nodes go each round, and a star of any size goes in one. All is written each round.
    """
    left = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = written(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")), "labels")
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"))
        choice = written(ends.groupBy(F.col("e.x").alias("x")).agg(F.least(F.col("x"), F.min("e.y")).alias("to")), "choice")
        root = choice.select("x", F.col("to").alias("root"))
        while True:  # to the end of each chain of choices, by doubling
            onward = root.select(F.col("x").alias("root"), F.col("root").alias("far"))
            jumped = written(root.join(onward, "root").select("x", "root", "far"), "roots")
            root = jumped.select("x", F.col("far").alias("root"))
            if jumped.where("root != far").isEmpty():
                break
        of_a, of_b = (root.select(F.col("x").alias(c), F.col("root").alias("r" + c)) for c in ("a", "b"))
        moved = left.join(of_a, "a").join(of_b, "b").where("ra != rb")
        left = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        label = written(label.join(root.withColumnRenamed("x", "label"), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
    return label
