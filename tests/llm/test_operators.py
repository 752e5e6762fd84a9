"""Each operator against a brute-force version or its contract, on small rows with nulls, empty texts, ties and repeats."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, decontaminate, graph, jaccard, langid, licences, lm, packing, substring, tokens, toxicity, urlfilter
from quarry.llm import words as W

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, n_words int, _slice string"
RNG = random.Random(7)
VOCAB = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 6))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@functools.cache
def corpus():
    base = [prose(RNG.randint(1, 120)) for _ in range(40)]
    passage = prose(30)
    texts = [*base, base[3], base[3], base[5].replace(" ", "\n"), base[6] + " " + passage, passage + " " + base[7], passage, None, "", "  \t\n ", "one", "é À ß 12!",
             " ".join([passage] * 3), base[8] + " x", base[8].upper(), prose(4000)]
    return [(i, t, "xx", 1, "s") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_and_hashes():
    texts = [t for _, t, *_ in corpus()] + ["\x0b\x0c a\rb", "x" * 40]
    buf, start, end, first, h = W.table_words(pa.array(texts))
    got = [[bytes(buf[start[i]:end[i]]).decode() for i in range(first[d], first[d + 1])] for d in range(len(texts))]
    assert got == [split(t) for t in texts]
    of = {}
    for i in range(len(start)):
        assert of.setdefault(bytes(buf[start[i]:end[i]]), h[i]) == h[i]
    assert len(set(of.values())) == len(of)


def test_substring_dedup(spark, docs, empty):
    words = {d: split(t) for d, t, *_ in corpus()}
    first = {}
    for d in sorted(words):
        for j in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][j:j + 13]), d)
    expected = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j:j + 13])] < d:
                gone[j:j + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert sum(v[1] for v in expected.values()) > 100
    for size in (500, 1 << 20):
        got = {r[0]: tuple(r)[1:] for r in substring.digest(docs, slice_bytes=size).collect()}
        assert got == expected
    out = substring.dedup_substrings(docs)
    assert out.columns == [*docs.columns, "dedup"] and out.count() == docs.count()
    assert substring.digest(empty).collect() == []
    twice = spark.createDataFrame([(1, prose(20)), (None, "a b")], "doc_id long, text string")
    twice = twice.union(twice)
    assert all(r.n_removed == 0 for r in substring.digest(twice).collect())


def brute_jaccard(rows):
    sets = []
    for _, t in rows:
        w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in split(t)]
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)]))
    up, links = list(range(len(rows))), collections.Counter()

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {rows[i][0]: (rows[top(i)][0], links[i]) for i in range(len(rows))}


def test_jaccard_join(spark, docs, empty):
    rng = random.Random(2)
    rows = [(d, t) for d, t, *_ in corpus()]
    base = prose(200, rng).split()
    for i in range(90):  # a crowd of near copies, more than a small bucket
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(200)] = rng.choice(VOCAB)
        rows.append((1000 + i, " ".join(w)))
    expected = brute_jaccard(rows)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == expected and len(got) == len(rows)
    assert jaccard.join(empty).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 90, 90: 90, 95: 90}


def test_tokens_equal_the_tokenizer():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aAzZéÉßİıſΣ ñ ,.!'sstdm_012½ª×÷中́ <|>\t\nŉ🙂") for _ in range(50)) for _ in range(400)] + [
        "a<|endoftext|>b", "don't we'll I'M", "", None, prose(500)]
    enc = tokens.encoder(TOKENIZER)
    expected = [enc.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = [x.tolist() for _, part in tokens.encode_column(TOKENIZER, pa.array(texts), chunk=2000) for x in part]
    assert got == expected


def test_packing(docs, empty):
    enc = tokens.encoder(TOKENIZER)
    want = {d: np.array([*enc.tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t, *_ in corpus()}
    rows = packing.pack(docs, TOKENIZER, length=256, shard_bytes=4000).collect()
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for d, ids in want.items():
        assert [s for s, _ in sorted(pieces[d])] == list(np.cumsum([0, *[n for _, n in sorted(pieces[d])]])[:-1])
        assert sum(n for _, n in pieces[d]) == len(ids)
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(empty, TOKENIZER).collect() == []


def test_sum_of_squares_choice():
    rng = random.Random(1)
    for _ in range(20):
        levels, counts = packing.Levels(24), collections.Counter()
        for _ in range(120):
            s = rng.randint(1, 23)
            options = [(sum(v * v for v in (counts + collections.Counter({s: 1})).values()), 1, 0)]
            for h in [h for h in counts if counts[h] and h + s <= 24]:
                after = counts.copy()
                after[h] -= 1
                if h + s < 24:
                    after[h + s] += 1
                options.append((sum(v * v for v in after.values()), 0, -h))
            _, new, h = min(options)
            before = levels.count.copy()
            levels.place(s, ("d", 0, s))
            if new:
                counts[s] += 1
            else:
                counts[-h] -= 1
                if s - h < 24:
                    counts[s - h] += 1
            assert {k: v for k, v in counts.items() if v} == {int(k): int(levels.count[k]) for k in np.flatnonzero(levels.count)}, before


def test_language_parse_and_learning(spark, docs, empty):
    a, b = ("".join(RNG.choice(c) for _ in range(400)) for c in ("abc ", "abd "))
    m = langid.Model({"a": a, "b": b})
    for _ in range(20):
        text = "".join(RNG.choice("abcdz  ") for _ in range(RNG.randint(1, 600)))
        codes = langid.normal(m.symbol, text)
        for k, own in enumerate((a, b)):
            own, phrases = bytes(langid.normal(m.symbol, own)), 0
            for lo in range(0, len(codes), langid.SEGMENT):
                seg, i = bytes(codes[lo:lo + langid.SEGMENT]), 0
                while i < len(seg):
                    n = 1
                    while i + n < len(seg) and seg[i:i + n + 1] in own:
                        n += 1
                    i, phrases = i + n, phrases + 1
            assert abs(m.costs(codes, np.array([0, len(codes)]))[0, k] - phrases * m.bits[k]) < 1e-6
    rows = [(i, " ".join(RNG.choice(w) for _ in range(40)), lang) for i in range(60) for lang, w in (("u", ["alpha", "beta", "gamma"]), ("v", ["uno", "dos", "tres"]))]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(labelled)
    out = langid.identify(labelled, model).collect()
    assert all(r.lang == r.language.lang_pred and 0 <= r.language.score <= 1 for r in out)
    odd = {r.doc_id: r.language.lang_pred for r in langid.identify(docs, model).collect()}
    assert all((odd[d] == "und") == (not any(c.isalpha() for c in t or "")) for d, t, *_ in corpus())
    none = langid.identify(docs, langid.train(empty)).collect()
    assert {r.language.lang_pred for r in none} == {"und"} and langid.identify(empty, model).collect() == []


def test_toxicity_held_out(spark, empty):
    rng = random.Random(5)
    bad = ["idiotic", "worthless", "scumbag"]
    rows = []
    for i in range(600):
        w = prose(60, rng).split()
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.where("doc_id < 400").select("doc_id", "toxic"))
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, model).collect()}
    right = np.mean([(got[i] >= 0.5) == bool(t) for i, _, t in rows[400:]])
    assert right > 0.9 and all(0 <= v <= 1 for v in got.values())
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "%% 12")], "doc_id long, text string")
    assert all(r.toxicity < 0.5 for r in toxicity.score(edge, model).collect())
    assert toxicity.train(df, empty.select("doc_id", F.lit(1).alias("toxic"))) is None
    assert toxicity.score(edge, None).count() == 3 and toxicity.score(empty, model).collect() == []


def test_toxicity_late_in_long_texts(spark):
    rng = random.Random(9)
    bad = ["idiotic", "worthless", "scumbag"]
    rows = []
    for i in range(150):
        w = prose(rng.randint(6500, 8000), rng).split()
        toxic = i % 3 == 0
        for _ in range(4 * toxic):
            w.insert(rng.randrange(6300, len(w)), " ".join(rng.choice(bad) for _ in range(3)))
        rows.append((i, " ".join(w), int(toxic)))
    assert all(not set(bad) & set(t[:20_000].split()) for _, t, _ in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.where("doc_id < 100").select("doc_id", "toxic"))
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, _, t in rows[100:]]) > 0.9


def test_alignment_and_decontamination(spark, docs, empty):
    for _ in range(60):
        a, b = (np.array([RNG.randint(0, 4) for _ in range(RNG.randint(1, 15))]) for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()
    item = prose(30).split()
    edited = list(item)
    edited[4], edited[20] = "zzz", "yyy"
    rows = [(1, "x y " + " ".join(item) + " z"), (2, prose(40) + " " + " ".join(edited).upper() + "!"), (3, prose(60)), (4, None), (5, ""), (6, " ".join(item[:8]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "too few words"[:7])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(df, bench, block_bytes=60).collect()}
    assert set(got) == {(1, 10), (2, 10)} and got[1, 10] == 1.0 and got[2, 10] < 1
    assert {r.doc_id for r in decontaminate.decontaminate(df, bench).collect()} == {3, 4, 5, 6}
    assert decontaminate.contaminated(empty, bench).collect() == [] and decontaminate.contaminated(docs, bench.limit(0)).collect() == []


@pytest.mark.parametrize("exact", [False, True])
def test_decontamination_finds_every_edited_copy(spark, exact):
    rng = random.Random(11)
    items = [prose(rng.randint(4, 45), rng).split() for _ in range(24)]

    def edited(words, share, kinds):
        out = []
        for w in words:
            kind = rng.choice(kinds) if rng.random() < share else "keep"
            out += {"keep": [w], "swap": [prose(1, rng)], "drop": [], "add": [w, prose(1, rng)]}[kind]
        return out

    texts = [prose(30, rng).split() + edited(w, share, kinds) + prose(30, rng).split()
             for w in items for share in (0.1, 0.15, 0.2, 0.25) for kinds in (["swap"], ["swap", "drop", "add"])]
    for w in items:
        texts += [[x for k, v in enumerate(w) for x in ([v, prose(1, rng)] if k % 2 else [v])], [x if k % step else "zzz" for step in (5, 7) for k, x in enumerate(w)],
                  [x for v in w for x in (v, "zzz")][:-1]]
    texts += items if exact else []
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    number = {w: i for i, w in enumerate({w for t in texts + items for w in t})}
    code = lambda t: np.array([number[w] for w in t], np.int64)
    share = {(d, i): decontaminate.align(code(w), code(t))[0] / (2 * len(w)) for d, t in enumerate(texts) for i, w in enumerate(items)}
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {k: s for k, s in share.items() if s >= decontaminate.THRESHOLD}


def test_language_model(spark, docs, empty):
    learn = F.col("doc_id") % 3 != 0
    texts = {d: [w.translate({i: i + 32 for i in range(65, 91)}) for w in split(t)] + ["\0"] for d, t, *_ in corpus()}
    count = collections.Counter(w for d, x in texts.items() if d % 3 for w in x)
    n, v = sum(count.values()), len(count)
    rows = lm.score_documents(docs, learn, slice_bytes=2000).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = texts[r.doc_id]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.score < 0
    assert lm.score_documents(empty, F.lit(True)).collect() == []


def test_language_model_gradient_and_lanes():
    rng = np.random.default_rng(0)
    vocab = lm.Vocabulary(np.array([16 * i + i % 16 for i in range(1, 40)], np.uint64), np.arange(40, 1, -1), 2000, 60, np.full(16, 50.0), np.full(16, 3.0))
    model = lm.GRU(vocab)
    hid = rng.normal(size=(3, lm.HIDDEN)).astype(np.float32)
    total = sum(np.exp(model.likelihood(hid, np.full(3, t))) for t in range(vocab.n_words + lm.KINDS))
    assert np.allclose(total, 1, atol=1e-4)
    sizes = np.array([5, 1, 40, 7, 300, 2])
    tok = rng.integers(0, vocab.n_words + lm.KINDS, int(sizes.sum())).astype(np.int32)
    whole, at = lm.text_scores(model, tok, sizes), 0
    for x, k in zip(whole, sizes, strict=True):
        assert abs(x - lm.text_scores(model, tok[at:at + k], np.array([k]), block=1000)[0]) < 1e-2
        at += k
    model.theta, at = model.theta.astype(np.float64), 0
    for name, shape in model.shapes.items():
        k = int(np.prod(shape))
        model.p[name] = model.theta[at:at + k].reshape(shape)
        at += k
    args = (rng.integers(0, vocab.n_words + 17, (6, 5)), rng.integers(0, vocab.n_words + 16, (6, 5)),
            (rng.random((6, 5)) > 0.2).astype(float), np.ones((6, 5), bool), rng.normal(size=(5, lm.HIDDEN)) * 0.1)
    grad = model.gradient(*args)[1]
    for i in rng.integers(0, len(model.theta), 30):
        old = model.theta[i]
        model.theta[i] = old + 1e-5
        up = model.gradient(*args)[0]
        model.theta[i] = old - 1e-5
        down = model.gradient(*args)[0]
        model.theta[i] = old
        assert abs(-(up - down) / 2e-5 / 30 - grad[i]) < 1e-4


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[50:60] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [
        (900, None), (1000, [0.0] * 12), (1100, [float("nan")] * 12), (1200, [None] * 12), (1300, [float("inf")] * 12), (1400, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 50 == 0, k=10).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 50))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(400), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(f[2] - d[f[1]]) < 1e-12 for f in found)
        assert [f[1:][::-1] for f in found] == sorted(f[1:][::-1] for f in found)
        hit += len({f[1] for f in found} & set(best.tolist()))
    assert hit >= 0.9 * 80
    few = ann.search(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert ann.search(df.limit(0), F.lit(True)).collect() == []


def test_urls_and_ranks(spark):
    link = '<a class=x href="https://{}/p">t</a>'
    rows = [(1, "http://Good.example.net/en/1", link.format("friend.com")), (2, "https://x.net/a?b", link.format("friend.com")),
            (3, "https://friend.com/1", ""), (4, "http://shady.com/", link.format("x.net") + link.format("x.net")), (5, None, None), (6, "no scheme", "<a>"),
            (7, "http://a.org/fr/x#y", ""), (8, "http://a.org/fr", ""), (9, "http://x.net", ""), (2, "https://x.net/a?b", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    got = collections.defaultdict(set)
    for r in urlfilter.judge(pages, rules).collect():
        got[r.page_id].add((r.host, r.path, r.rule, r.verdict))
    assert got[1] == {("good.example.net", "/en/1", "example.net/en/", "allow")} and got[2] == {("x.net", "/a", "net/", "block")}
    assert got[3] == {("friend.com", "/1", None, "allow")} and got[4] == {("shady.com", "/", None, "block")}
    assert got[5] == got[6] == {("", "", None, "allow")} and got[7] == {("a.org", "/fr/x", "org/fr/", "allow")}
    assert got[8] == {("a.org", "/fr", None, "allow")}
    assert urlfilter.judge(pages.limit(0), rules).collect() == []


def test_hosts_with_few_ruled_pages_are_seeds(spark):
    link = '<a href="https://{}/">t</a>'
    rows = [(1, "http://a.example.com/de/1", "")] + [(10 + i, f"http://a.example.com/x/{i}", "") for i in range(9)]
    rows += [(30, "http://b.org/fr/1", link.format("friend.info"))] + [(40 + i, f"http://b.org/x/{i}", "") for i in range(3)]
    rows += [(50, "http://shady.info/", link.format("a.example.com")), (51, "http://friend.info/", ""), (52, "http://other.info/", "")]
    rows += [(60, "http://mixed.example.com/de/1", ""), (61, "http://mixed.example.com/x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urlfilter.judge(pages, [("example.com/de/", "block"), ("org/fr/", "allow")]).collect()}
    assert {got[i].verdict for i in (1, 10, 50, 60, 61)} == {"block"} and {got[i].verdict for i in (30, 40, 51, 52)} == {"allow"}
    assert got[40].trust > got[51].trust > 0 and got[10].distrust > got[50].distrust > 0
    assert got[61].distrust > 4 * got[10].distrust


def test_licences(spark, docs):
    lines = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary",
             "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    rows = [(i, prose(30) + "\n" + t + "\n" + prose(200)) for i, t in enumerate(lines)] + [(100 + i, prose(50) + "\nthe rights of the work\n") for i in range(40)] + [(900, None), (901, "")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in got} == {(i, 1, f) for i, f in enumerate(lines.values())}


def test_wrapped_licences(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    gpl = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
           "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.")
    rng = random.Random(5)
    text = lambda n: "\n".join(prose(9, rng) for _ in range(n))
    comment = "\r\n".join(" * " + x for x in gpl.split("\n"))
    texts = {1: bsd, 2: gpl, 3: text(2) + "\n" + bsd + "\n" + text(3), 4: text(12) + "\n\n" + gpl + "\n\n" + text(2), 5: prose(150, rng) + "\n" + comment,
             6: bsd + "\n" + bsd, 7: bsd.replace("\n", " ") + "\n" + bsd, 8: bsd.replace("\n", "\n\n"), 9: text(30), 10: "Released under\nthe MIT License."}
    for i in range(8):
        texts[20 + i] = text(i) + "\n" + bsd + "\n\n" + text(i) + "\n" + gpl
    rows = [*texts.items(), *[(100 + i, prose(50, rng) + "\nthe rights of the work\n") for i in range(40)]]
    want = {(1, 0, "bsd"), (2, 0, "gpl"), (3, 2, "bsd"), (4, 13, "gpl"), (5, 1, "gpl"), (6, 0, "bsd"), (6, 3, "bsd"), (7, 0, "bsd"), (7, 1, "bsd"), (10, 0, "mit")}
    for i in range(8):
        lead = max(1, i)
        want |= {(20 + i, lead, "bsd"), (20 + i, lead + 4 + max(1, i), "gpl")}
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in got} == want
