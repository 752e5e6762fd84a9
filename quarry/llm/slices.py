"""Documents dealt into slices of bounded text size, and the exchange of packed keys.

Operators that must know which keys (word n-grams, words) occur elsewhere use two
group-bys: slices send their distinct keys, packed into binary columns, to buckets
chosen by the key's hash; buckets answer each slice. A key that is everywhere costs
one entry per slice, however many documents hold it, and no pairs are formed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20
MAX_SLICE_BYTES = 128 << 20
MAX_SLICES = 4000


@dataclass(frozen=True)
class Deal:
    """Slices of a document table: range bounds on doc_id, and the number of buckets."""

    bounds: tuple
    slices: int
    buckets: int


def deal(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> Deal:
    """Bounds for slices of about ``slice_bytes`` of text, ordered by doc_id.

    One aggregate over doc_id and text lengths; the driver gets the bounds only. Slices
    grow (to MAX_SLICE_BYTES) before their number passes MAX_SLICES, and then the
    number grows on.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    size = min(MAX_SLICE_BYTES, max(slice_bytes, total // MAX_SLICES))
    n = max(1, -(-total // size))
    cuts = []
    if n > 1:
        probs = [i / n for i in range(1, n)]
        got = docs.agg(F.percentile_approx("doc_id", probs, max(10000, 10 * n)).alias("q")).first()["q"]
        cuts = sorted(set(got or []))
    return Deal(tuple(cuts), len(cuts) + 1, max(4, n))


def with_slice(docs: DataFrame, d: Deal) -> DataFrame:
    """(_slice, doc_id, text, _rest): equal ids fall in one slice, and a smaller id never in
    a later one; null ids go to the last. ``_rest`` packs all other columns."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    bounds = np.array(d.bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(bounds), dtype=np.int32)
        out[known] = np.searchsorted(bounds, ids[known].astype("int64").to_numpy(), side="right")
        return pd.Series(out)

    return docs.select(
        (place(F.col("doc_id").cast("long")) if len(bounds) else F.lit(0)).alias("_slice"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        (F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("struct<x:int>")).alias("_rest"))


def split_sorted(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of each bucket's run in an ascending bucket array."""
    return np.searchsorted(bucket, np.arange(buckets + 1))


def packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())
