"""A corpus pipeline of five stages, from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. :func:`run` writes each stage's rows under the shared checkpoint folder and
reads them as the next one's input.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, graph, jaccard, langid, packing, substring

#: Cost in bits a character from which no learned language fits a text. A text in a learned language
#: costs 2 to 6; one whose every letter is a phrase costs about 15.
MAX_BITS = 9.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language. Texts that are null, have no letter, or fit no language go."""
    model = langid.train(docs.where(F.col("lang").isNotNull()).select("text", "lang"))
    name = graph.unused("_language", docs.columns)
    told = F.col(name)
    out = langid.identify(docs, model, name)
    return out.where((told["lang_pred"] != langid.UNDETERMINED) & (told["bits"] <= MAX_BITS)).drop(name)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class of near copies, one row of each (doc_id, text). Rows without doc_id
    stay, one of each text."""
    first = jaccard.join(docs.select("doc_id", "text")).where(F.col("class_id") == F.col("doc_id")).select(F.col("doc_id").alias("_first")).distinct()
    kept = docs.join(first, docs["doc_id"] == first["_first"], "left_semi")
    often = docs.groupBy(F.col("doc_id").alias("_often")).agg(F.count("*").alias("_n")).where("_n > 1 and _often is not null").drop("_n")
    alone = kept.join(often, kept["doc_id"] == often["_often"], "left_anti")
    again = kept.join(often, kept["doc_id"] == often["_often"], "left_semi").dropDuplicates(["doc_id", "text"])
    return alone.unionByName(again).unionByName(docs.where(F.col("doc_id").isNull()).dropDuplicates(["text"]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; n_chars follows. What loses all its words goes."""
    name = graph.unused("_dedup", docs.columns)
    out = substring.dedup_substrings(docs, name=name)
    gone = F.col(name)["n_removed"]
    left = out.where((gone == 0) | (gone < F.col(name)["n_words"]))
    return left.withColumn("n_chars", F.when(gone > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(name)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("n-gram Jaccard join", jaccard_join), ("substring dedup", substring_dedup),
          ("benchmark decontamination", decontamination), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        docs = graph.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
