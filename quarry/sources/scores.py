"""Scored examples for the evaluation operators: ``labels ⋈ documents``.

label = ``quality``; each "model" is a fixed monotone score of the document
length, so that the metrics have ties and a DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.tables import load_table

# Spark: one join, then three (model, score) records a row.
_SPARK_SQL = """
SELECT s.model, doc_id, label, s.score
FROM (SELECT l.doc_id, l.quality AS label, explode(array(
        named_struct('model', 'length', 'score', CAST(d.n_chars AS DOUBLE) / (d.n_chars + 5000)),
        named_struct('model', 'brevity', 'score', CAST(5000 AS DOUBLE) / (d.n_chars + 5000)),
        named_struct('model', 'length_coarse', 'score',
                     CAST(floor(CAST(d.n_chars AS DOUBLE) / (d.n_chars + 5000) * 20) AS DOUBLE) / 20))) AS s
      FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id)
"""

_SQL = """
SELECT 'length' AS model, l.doc_id, l.quality AS label,
       CAST(d.n_chars AS DOUBLE) / (d.n_chars + 5000) AS score
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
UNION ALL
SELECT 'brevity' AS model, l.doc_id, l.quality AS label,
       CAST(5000 AS DOUBLE) / (d.n_chars + 5000) AS score
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
UNION ALL
SELECT 'length_coarse' AS model, l.doc_id, l.quality AS label,
       CAST(floor(CAST(d.n_chars AS DOUBLE) / (d.n_chars + 5000) * 20) AS DOUBLE) / 20 AS score
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
"""


def scores_sql(dialect: str = "spark") -> str:
    if dialect == "spark":
        return _SPARK_SQL
    return _SQL.format(labels="labels", documents="documents")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, doc_id, label, score)."""
    return spark.sql(_SPARK_SQL, labels=load_table(spark, sf_dir, "labels", ["doc_id", "quality"]),
                     documents=load_table(spark, sf_dir, "documents", ["doc_id", "n_chars"]))
