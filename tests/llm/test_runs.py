"""Periodic runs against brute force over all periods, and Lyndon arrays against their definition."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import runs


def lyndon_brute(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


@given(st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=400, deadline=None)
def test_lyndon_array(s):
    assert runs.lyndon(s) == lyndon_brute(s)


def brute(ws):
    out = {}
    for q in range(1, len(ws) // 4 + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def expected(text):
    ws = (text or "").encode().split()
    found = brute(ws)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return len(ws), found, b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()


def text(rng):
    ws = []
    vocab = rng.choice([1, 2, 3, 8, 100])
    for _ in range(rng.randint(0, 8)):
        ws += [str(rng.randint(0, vocab)) for _ in range(rng.randint(1, 6))] * rng.randint(1, 6)
        if rng.random() < 0.3:
            ws.pop()
    return rng.choice(["", " \t"]) + rng.choice([" ", "\n", " \x0b "]).join(ws)


def test_documents(spark, monkeypatch):
    rng = random.Random(3)
    texts = [text(rng) for _ in range(800)]
    block = [f"w{i}é　" for i in range(700)]  # an ideographic space is part of a word
    texts += [None, "", " \n", "a", "a a a a a", "a a a a a a", "a a a a a a b", "x " + "a b " * 3, "A a " * 10, texts[0], " ".join(block * 5), " ".join(["b", *block] * 6), "z " * 2000]
    docs = spark.createDataFrame([(i % 900, t, "c", "d") for i, t in enumerate(texts)], "doc_id long, text string, runs string, collapsed string")
    monkeypatch.setattr(runs, "BYTES", 20_000)
    out = runs.periodic_runs(docs).collect()
    assert len(out) == len(texts)
    got = sorted((r.doc_id, r.text or "", r.periodic.n_words, [tuple(x) for x in r.periodic.runs], r.periodic.collapsed) for r in out)
    assert got == sorted((i % 900, t or "", *expected(t)) for i, t in enumerate(texts))
    assert {(r.runs, r.collapsed) for r in out} == {("c", "d")}


def test_equal_hashes_are_told_apart(monkeypatch):
    """Extensions that are too long (prefix hashes that say nothing) are found word by word."""
    import pyarrow as pa

    from quarry.llm import words as W

    monkeypatch.setattr(runs.Extensions, "_equal", lambda self, i, j, m: __import__("numpy").ones(len(i), bool))
    ws = ("p q r s " * 5 + "t u v w x y z " + "p q " * 9).split()
    _, _, _, first, h = W.table_words(pa.array([" ".join(ws)]))
    assert [tuple(int(v) for v in r[1:]) for r in runs.find_runs(h, first)] == brute(ws)
