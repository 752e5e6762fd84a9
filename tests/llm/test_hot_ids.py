"""Rows without ids, repeated rows, hosts of many pages, and long training texts."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, jaccard, lm, urlfilter

RNG = random.Random(11)
VOCAB = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def near(text):
    return text + " tail"


def test_join_of_rows_without_ids(spark):
    base = [prose(40) for _ in range(120)]
    texts = [t for b in base for t in (b, near(b), b)] + [prose(30) for _ in range(640)]
    rows = [(None, t) for t in texts]
    rows += [(7, t) for b in base[:40] for t in ("x " + b,)] + [(7, "same " + prose(30))] * 3 + [(i, near(near(base[i]))) for i in range(8, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    raw = jaccard._block_pairs

    def counted(df, by):
        if by == ["comp"]:
            seen.append(df.count())
        return raw(df, by)

    jaccard._block_pairs = counted
    try:
        out = jaccard.join(docs).collect()
    finally:
        jaccard._block_pairs = raw
    assert seen and seen[0] <= len(rows)  # not rows times sets
    assert len(out) == len(rows)
    linked = [r for r in out if r.n_links > 0]
    assert len(linked) == 3 * 120 + 40 + 3 + 12
    assert {r.n_links for r in out if r.doc_id is not None and 8 <= r.doc_id < 20} == {4}  # base twice, its near copy, and "x ..."
    assert sorted(r.n_links for r in out if r.doc_id is None)[:640] == [0] * 640


def test_pipeline_keeps_one_row_of_repeated_rows(spark):
    a, b, c, d = (prose(50) for _ in range(4))
    rows = [(1, a), (1, a), (2, near(a)), (3, b), (3, b), (3, c), (None, d), (None, d), (None, prose(20)), (4, c + " x")]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.jaccard_join(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text) for r in out.collect())
    assert got == sorted([(1, a), (3, b), (3, c), (0, d), (0, rows[8][1])])


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_the_kind_with_fewer_seeds_does_not_win(spark):
    rows = [(i, f"http://b.org/fr/{i}", "") for i in range(99)] + [(99, "http://b.org/x", ""), (100, "http://b.org/de", "")]
    rows += [(200 + i, f"http://h{i}.org/fr/", "") for i in range(25)] + [(300, "http://bad.net/x", ""), (301, "http://b.net/", "")]
    rows += [(101, "http://b.org.example.com/de/", "")]
    out = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert out[99].verdict == out[100].verdict == "allow" and out[99].trust > 0.9
    mixed = [(i, f"http://example.com/{'de' if i == 0 else 'x'}/{i}", "") for i in range(3)] + [(9, "http://q.org/fr/", "")]
    out = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(mixed, "page_id long, url string, html string"), RULES).collect()}
    assert out == {0: "block", 1: "block", 2: "block", 9: "allow"}


def power_iteration(n, links, weight):
    """Personalised ranks that sum to the seeds' weight, dangling hosts returning to the seeds."""
    step = np.zeros((n, n))
    for a, b, c in links:
        step[b, a] += c
    out = step.sum(axis=0)
    step[:, out > 0] /= out[out > 0]
    start = weight / weight.sum()
    x = start.copy()
    for _ in range(3000):
        x = urlfilter.DAMPING * (step @ x + start * x[out == 0].sum()) + (1 - urlfilter.DAMPING) * start
    return x * weight.sum()


def test_ranks_equal_power_iteration(spark):
    rng = np.random.default_rng(2)
    n = 40
    links = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, 30, 90), rng.integers(0, 40, 90), rng.integers(1, 4, 90), strict=True) if a != b]
    links += [(i, i + 1, 1) for i in range(100, 145)]  # a chain longer than 30 links
    n = 150
    trust, distrust = np.zeros(n), np.zeros(n)
    trust[[3, 100]], distrust[[5, 7, 9]] = [0.5, 1.0], [1.0, 0.25, 0.1]
    seeds = spark.createDataFrame([(str(i), float(trust[i]), float(distrust[i])) for i in np.flatnonzero(trust + distrust)], "host string, trust double, distrust double")
    table = spark.createDataFrame([(str(a), str(b), c) for a, b, c in links], "src string, dst string, n long").groupBy("src", "dst").agg(F.sum("n").alias("n"))
    got = {r.host: r for r in urlfilter.propagate(table, seeds, tolerance=1e-4).collect()}
    want_t, want_d = power_iteration(n, links, trust), power_iteration(n, [(b, a, c) for a, b, c in links], distrust)
    for i in range(n):
        r = got.get(str(i))
        assert abs((r.trust if r else 0) - want_t[i]) < 1e-3 and abs((r.distrust if r else 0) - want_d[i]) < 1e-3
    assert got["140"].trust > 0
    with pytest.raises(RuntimeError, match="still change"):
        urlfilter.propagate(table, seeds, rounds=3)


def test_training_documents_of_many_words(spark):
    """The end token is no frequent one, and a third of the rows is one text."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(1500)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(4000))) for i in range(20)]
    rows += [(100 + i, rows[0][1]) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = lm.score_documents(docs, F.lit(True), start_docs=5).collect()
    assert len(out) == 30 and {r.train_tokens for r in out} == {30 * 4001} and all(np.isfinite(r.score) for r in out)


def test_too_few_probes_mean_an_exact_scan(spark, monkeypatch):
    monkeypatch.setattr(ann, "MAX_PROBES", 1)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[50:60] = x[50]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 40 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(0, 400, 40):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1))
        want = [i for i in sorted(range(400), key=lambda i: (d[i], i)) if i != q][:10]
        assert [v for _, v in sorted(got[q])] == want
