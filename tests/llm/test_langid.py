"""Wide alphabets against a parse by plain string search, ties, repeats, long texts."""

from __future__ import annotations

import random

import numpy as np

from quarry.llm import langid

HAN = [chr(0x4E00 + i) for i in range(700)]
FAR = [chr(0x30000 + i) for i in range(40)]


def phrases(own: str, text: str) -> int:
    """Phrases of a parse of ``text`` into longest matches in ``own``, restarted every SEGMENT characters."""
    n = 0
    for lo in range(0, len(text), langid.SEGMENT):
        seg, i = text[lo:lo + langid.SEGMENT], 0
        while i < len(seg):
            k = 1
            while i + k < len(seg) and seg[i:i + k + 1] in own:
                k += 1
            i, n = i + k, n + 1
    return n


def test_letters_without_a_column_are_parsed_alike():
    rng = random.Random(4)
    own = ["".join(rng.choice(pool) for _ in range(1500)) for pool in (HAN[:500], HAN[200:] + FAR)]
    model = langid.Model({"a": own[0], "b": own[1]})
    assert model.symbols > langid.DENSE + 300 and len(model.rare)
    seen = set("".join(own))
    texts = ["".join(rng.choice(HAN + FAR) for _ in range(rng.randint(1, 700))) for _ in range(10)]
    texts += [own[k][i:i + 400] for k in (0, 1) for i in (0, 333)]
    for text in texts:
        cost = model.costs(langid.normal(model.symbol, text), np.array([0, len(text)]))[0]
        told = "".join(c if c in seen else "?" for c in text)  # letters of neither language are one symbol
        for k in (0, 1):
            assert abs(cost[k] - phrases(own[k], told) * model.bits[k]) < 1e-6


def test_large_scripts_are_told_apart(spark):
    rng = random.Random(6)
    words = {"x": ["".join(rng.sample(HAN, 2)) for _ in range(300)], "y": ["".join(rng.sample(HAN, 2)) for _ in range(300)],
             "z": ["".join(rng.sample(FAR, 2)) for _ in range(300)]}
    rows = [(i, "".join(rng.choice(words[k]) for _ in range(60)), k) for i in range(120) for k in words]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id < 80"))
    got = langid.identify(df.where("doc_id >= 80"), model).collect()
    assert np.mean([r.lang == r.language.lang_pred for r in got]) > 0.97
    assert all(r.language.lang_pred == "z" for r in got if r.lang == "z")


def test_whole_texts_train_and_ties_go_to_the_first_name(spark):
    assert langid._fitting(["a" * 6, "b" * 9, "c" * 3, "d"], 10) == ["a" * 6, "c" * 3]
    same = "one text that both languages hold " * 5
    rows = [(1, same, "b"), (2, same, "a"), (3, same, "a"), (4, "long " * 30_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.langs == ["a", "b", "c"]
    got = {r.doc_id: r.language for r in langid.identify(df, model).collect()}
    assert got[1].lang_pred == "a" and got[1] == got[2] == got[3] and got[4].lang_pred == "c"
    assert abs(got[1].score - 0.5) < 1e-6
