"""All queries and stages on empty tables, on rows of nothing but nulls, and beside columns of clashing names."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quarry.llm import graph, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = {"documents": DOCS, "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string",
          "benchmark": "item_id long, text string", "embeddings": "vec_id long, embedding array<float>, label int"}
CLASH = ["_first", "_language", "language", "dedup", "_rest", "slice", "_slice", "bucket", "data", "key", "path", "class_id",
         "n_words", "n_removed", "score", "tokens", "ids", "start", "length", "sequence_id", "offset", "_bad", "item_id", "label"]


def write(spark, folder, rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="module")
def nulls(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("nulls"), {n: [(None,) * len(s.split(", "))] * 3 for n, s in TABLES.items()})


PER_ROW = {"op1_language_id", "op2_substring_dedup", "op3_toxicity", "op4_ngram_jaccard_join", "op6_url_filters", "op9_lm_scoring",
           "op12_warc", "op13_periodic_runs"}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_null_rows(spark, nulls, name):
    out = queries.QUERIES[name](spark, nulls).collect()
    if name in PER_ROW:
        assert len(out) == 3
    if name == "op5_packing":  # a null text is an empty one: its end is a token
        assert [r.length for r in out] == [1, 1, 1]
    if name in ("op7_license_scans", "op8_decontamination", "op10_ann", "op11_hard_negatives", "pipeline"):
        assert out == []


def test_stages_beside_clashing_columns(spark, empty):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(12)]
    texts += [texts[0], texts[1], None, "", " ".join(rng.choice(vocab) for _ in range(20_000))]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASH])
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = graph.written(stage(spark, now, empty), "edge")
        assert now.columns == docs.columns, name
    rows = now.collect()
    assert sorted(r.doc_id for r in rows) == [*range(12), 16]
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASH)
    assert {r.doc_id: r.text for r in rows} == {i: texts[i] for i in [*range(12), 16]}
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, empty).collect()
    assert {r.doc_id for r in pieces} == {*range(12), 16}
