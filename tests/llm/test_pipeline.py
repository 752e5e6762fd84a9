"""The pipeline's stages: their columns, and that their decisions take effect."""

import random

import corpus_pipeline
from quarry.llm import graph


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [prose(60) for _ in range(30)]
    passage, item = prose(60), prose(40)
    texts += [texts[0], texts[1] + " tail", prose(30) + " " + passage, prose(30) + " " + passage, prose(30) + " " + item, None, "", "12 34 !!"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)], schema)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = graph.written(stage(spark, now, str(tmp_path)), "t")
        seen[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert ids["language ID"] == set(range(35))
    assert ids["n-gram Jaccard join"] == set(range(35)) - {30, 31}
    kept = {r.doc_id: r.text for r in seen["substring dedup"].collect()}
    assert passage in kept[32] and passage not in kept[33] and kept[5] == texts[5]
    assert ids["benchmark decontamination"] == ids["substring dedup"] - {34}
    assert ids["packing"] == ids["benchmark decontamination"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
