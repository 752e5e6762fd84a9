"""Compression distance against a plain loop, calibration against a search of all thresholds."""

from __future__ import annotations

import math
import random

import numpy as np
import zstandard

from quarry.llm import toxicity

BAD = ["idiotic", "worthless", "scumbag", "moronic"]


def texts(n: int, seed: int):
    rng = random.Random(seed)
    said = ["".join(rng.choice("abdeilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    for i in range(n):
        w = [rng.choice(said) for _ in range(rng.randint(20, 90))]
        for _ in range(4 * (i % 3 == 0)):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        yield i, " ".join(w), int(i % 3 == 0)


def loop_score(model, text: str) -> float:
    """The score by one compressor call a window, without numpy."""
    how = zstandard.ZstdCompressionParameters.from_level(3, min_match=4, strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)
    sides = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
             for d in (model.ordinary, model.toxic)]
    folded = "".join(chr(c).lower() if chr(c).isascii() and chr(c).isalpha() else " " if c < 128 else chr(c) for c in text.encode("utf-8"))
    words = folded.encode("latin-1").split()
    gains = []
    for i in range(0, len(words), toxicity.WINDOW):
        w = bytes(range(1, 25)) + b" " + b" ".join(words[i:i + toxicity.WINDOW]) + b" "
        gains.append(len(sides[0].compress(w)) - len(sides[1].compress(w)))
    top = sorted(gains, reverse=True)[:toxicity.DEPTH] + [0] * toxicity.DEPTH
    rise = model.grow * math.log1p(len(gains))
    m = max(sum(top[:k + 1]) - rise - model.threshold[k] for k in range(toxicity.DEPTH))
    if top[0] <= 0:
        m = min(m, -1.0)
    return 1 / (1 + math.exp(-max(-30, min(30, model.slope * m))))


def test_scores_equal_a_plain_loop(spark):
    rows = list(texts(240, 3))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.where("doc_id < 160").select("doc_id", "toxic"))
    extra = [(1000, "", 0), (1001, "12 %%", 0), (1002, rows[0][1], 1), (1003, rows[0][1], 1), (1004, "É " + " ".join(BAD) * 3, 1), (1005, rows[1][1] * 40, 0)]
    both = spark.createDataFrame(rows + extra, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.toxicity for r in toxicity.score(both, model).collect()}
    for i, t, _ in rows + extra:
        assert abs(got[i] - loop_score(model, t)) < 1e-9
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, _, t in rows[160:]]) > 0.9
    assert got[1002] == got[1003] == got[0] and got[1000] < 0.5 and got[1001] < 0.5


def test_both_dictionaries_are_trained(spark):
    df = spark.createDataFrame(list(texts(240, 4)), "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    size = toxicity.TOXIC_BYTES
    ordinary, toxic = model.ordinary[:size].strip(b"\0"), model.toxic[:size].strip(b"\0")
    assert ordinary and toxic and model.ordinary[size:] == model.toxic[size:]
    assert any(b.encode() in toxic for b in BAD) and not any(b.encode() in ordinary for b in BAD)


def test_one_threshold_is_the_best_one(monkeypatch):
    monkeypatch.setattr(toxicity, "DEPTH", 1)
    monkeypatch.setattr(toxicity, "GROW", (0.0,))
    rng = np.random.default_rng(8)
    for _ in range(30):
        n = int(rng.integers(4, 60))
        y = (rng.random(n) < 0.4).astype(float)
        y[:2] = 0, 1
        x = np.c_[rng.integers(0, 12, n) + 4 * y, np.zeros(n)].astype(float)
        w = np.where(y > 0, 1.0, 3.0)
        model = toxicity.Model(b"", b"", np.full(1, np.inf))
        model.calibrate(x, y, w)
        wrong = w[(model.margin(x) >= 0) != (y > 0)].sum()
        assert wrong == min(w[((x[:, 0] >= t) & (x[:, 0] > 0)) != (y > 0)].sum() for t in range(1, 20))
