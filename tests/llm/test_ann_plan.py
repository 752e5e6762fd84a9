"""What op10 broadcasts: the number of parts of its regions, never the probes of its queries."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import ann


def joins(node):
    """(build side's columns) of each broadcast join below ``node``."""
    if node.nodeName() == "BroadcastHashJoin":
        side = node.left() if "Left" in node.buildSide().toString() else node.right()
        yield {side.output().apply(i).name() for i in range(side.output().size())}
    for i in range(node.children().size()):
        yield from joins(node.children().apply(i))


def test_probes_are_not_broadcast(spark, monkeypatch):
    r = np.random.default_rng(0)
    df = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(2000)], "vec_id long, embedding array<float>")
    built, written = [], ann.G.written

    def seen(frame, name, *a):
        if name == "near":
            built.extend(joins(frame._jdf.queryExecution().sparkPlan()))
        return written(frame, name, *a)

    monkeypatch.setattr(ann.G, "written", seen)
    out = ann.search(df, F.col("vec_id") == 7, k=3)
    assert out.count() == 3
    assert built and all("keys" not in columns and "parts" in columns for columns in built)
