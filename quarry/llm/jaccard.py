"""Near-duplicate documents: n-gram Jaccard join by chosen paths.

A document is its set of five-word shingles (words lower-cased in A-Z; all its words as one shingle
if it has fewer). Sets are sampled by SIGNATURE minhashes: a shared token. Each of RUNS runs splits all sets
by the tokens at a few positions chosen for the path so far, so that 1/THRESHOLD branches are followed on
average and a pair at the threshold shares a leaf with steady probability. Buckets of at most
SMALL sets are compared by brute force; in larger ones all sets are compared with a pivot, those nearly
equal to it leave, and the rest is split again on the longer path. What is still large after
LEVELS splits is compared in blocks. Runs repeat until a pair at the threshold is found
with probability RECALL.

These comparisons are of signatures, at LOOSE, and only tie sets into loose groups. Within a loose group
all pairs of different sets are then compared exactly, in blocks, on whole shingle sets: that
counts each document's links and gives the classes, the components of links. No pair is
ever emitted: blocks emit counts, and edges of spanning forests.

Documents with the same set are one set with a number of copies from the start, so a group
of exact copies costs one row after a map-side combine.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph as G
from . import words as W

SHINGLE = 5
THRESHOLD = 0.8
SIGNATURE = 64
LEVELS = 3
SMALL = 64
BLOCK = 384
LOOSE = 0.66
EQUAL = 0.95  # a set this close to a pivot leaves: what it links with is loosely tied to the pivot
RECALL = 0.99
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MULT = np.array([random.Random(i).getrandbits(64) | 1 for i in range(SIGNATURE)], dtype=np.uint64)


def sets(col, chunk: int = 2 << 20):
    """Yield (index of the first text, bounds, shingles): each text's distinct shingle hashes, ascending."""
    buf, offs = W.text_buffer(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + chunk, side="right")) - 1))
        part = _FOLD[buf[offs[i]:offs[j]]]
        start, end, first = W.spans(part, offs[i:j + 1] - offs[i])
        h = W.word_hashes(part, start, end)
        doc, size = W.doc_of(first), np.diff(first)
        g = W.grams(h, SHINGLE)
        ok = W.inside(doc, SHINGLE)
        all_g, all_doc = g[ok], doc[:len(g)][ok]
        short = np.flatnonzero((size > 0) & (size < SHINGLE))
        if len(short):
            whole = np.array([W.grams(h[first[d]:first[d + 1]], int(size[d]))[0] for d in short], dtype=np.uint64)
            all_g, all_doc = np.concatenate([all_g, whole]), np.concatenate([all_doc, short])
        order = np.lexsort((all_g, all_doc))
        all_g, all_doc = all_g[order], all_doc[order]
        new = np.ones(len(all_g), bool)
        new[1:] = (all_g[1:] != all_g[:-1]) | (all_doc[1:] != all_doc[:-1])
        all_g, all_doc = all_g[new], all_doc[new]
        yield i, np.searchsorted(all_doc, np.arange(j - i + 1)), all_g
        i = j


def set_keys(cut: np.ndarray, g: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set: equal sets have equal keys. 0 for an empty set."""
    size = np.diff(cut)
    total = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(g ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    key = W.mix((total[cut[1:]] - total[cut[:-1]]) + size.astype(np.uint64))
    return np.where(size > 0, key | np.uint64(1), np.uint64(0)).view(np.int64)


def signatures(cut: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The least value of each hash function over each set, its upper half; one row per non-empty set."""
    at = cut[:-1][np.diff(cut) > 0]
    out = np.empty((len(at), SIGNATURE), np.uint32)
    for i, m in enumerate(_MULT):
        out[:, i] = np.minimum.reduceat(g * m, at) >> np.uint64(32) if len(at) else 0
    return out


def _sign(batches):
    for b in batches:
        ids = W.column(b, "doc_id")
        for i, cut, g in sets(W.column(b, "text")):
            key, some = set_keys(cut, g), np.diff(cut) > 0
            sig = signatures(cut, g).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, len(key)).filter(pa.array(some)), pa.array(key[some]),
                 pa.ListArray.from_arrays(np.arange(len(sig) + 1, dtype=np.int32) * SIGNATURE, pa.array(sig.reshape(-1)))],
                names=["doc_id", "key", "sig"])


def runs_for(recall: float, levels: int = LEVELS, trials: int = 4000) -> int:
    """Runs until a pair at the threshold shares a leaf at the deepest level with probability ``recall``:
    the chance for one run is that a branching process lives, measured on sampled paths."""
    rng = np.random.default_rng(3)
    alive = np.ones(trials, np.int64)
    for _ in range(levels):
        branches = rng.binomial(alive * SIGNATURE, 1 / (THRESHOLD * SIGNATURE))
        alive = rng.binomial(np.maximum(branches, (alive > 0)), THRESHOLD) * (alive > 0)
    live = float((alive > 0).mean())
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - live))))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges (i, least of its group) that connect what the given edges connect."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new[label] == label).all():
            break
        label = new[label]
    return [(i, int(x)) for i, x in enumerate(label) if x != i]


_EDGE = "a long, b long"


def _edges(keys: np.ndarray, pairs) -> pa.Table:
    return pa.table({"a": pa.array([int(keys[i]) for i, _ in pairs], pa.int64()), "b": pa.array([int(keys[j]) for _, j in pairs], pa.int64())})


def _brute(key, t):
    """Loose edges among one bucket's sets."""
    keys = t.column("key").to_numpy()
    sig = _matrix(t.column("sig"))
    n = len(keys)
    close = np.zeros((n, n), np.float32)
    for i in range(n):
        close[i] = (sig == sig[i]).mean(axis=1)
    a, b = np.nonzero(np.triu(close >= LOOSE, 1))
    return _edges(keys, _forest(a, b, n))


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    return col.flatten().to_numpy().reshape(-1, SIGNATURE)


def loose_groups(signed: DataFrame, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) between set keys that tie every pair at the threshold, with probability ``recall`` or
    more, into one component. ``signed``: one row (key, sig) per set."""
    rng = random.Random(17)
    picks = [(r, i) for r in range(runs_for(recall)) for i in
             ([i for i in range(SIGNATURE) if rng.random() < 1 / (THRESHOLD * SIGNATURE)] or [rng.randrange(SIGNATURE)])]
    paths = signed.select("key", F.explode(F.array(*[F.xxhash64(F.lit(r), F.lit(i), F.col("sig")[i]) for r, i in picks])).alias("path"))
    found = []
    for level in range(LEVELS):
        crowd = paths.groupBy("path").agg(F.count("*").alias("n"), F.min("key").alias("pivot")).where("n > 1")
        live = paths.join(crowd, "path").join(signed, "key")
        live = G.written(live.select("path", "key", "n", "pivot", "sig"), "paths")
        found.append(live.where(F.col("n") <= SMALL).groupBy("path").applyInArrow(_brute, _EDGE))
        large = live.where(F.col("n") > SMALL)
        if large.isEmpty():
            return _union(found)
        head = large.where("key = pivot").select("path", F.col("sig").alias("pivot_sig")).dropDuplicates(["path"])
        same = F.aggregate(F.zip_with("sig", "pivot_sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        large = G.written(large.join(head, "path").withColumn("same", same / float(SIGNATURE)).drop("pivot_sig"), "large")
        found.append(large.where((F.col("same") >= LOOSE) & (F.col("key") != F.col("pivot"))).select(F.col("key").alias("a"), F.col("pivot").alias("b")))
        rest = large.where(F.col("same") < EQUAL)
        if level < LEVELS - 1:
            chosen = F.filter(F.sequence(F.lit(0), F.lit(SIGNATURE - 1)), lambda i: F.pmod(F.xxhash64("path", i), F.lit(int(THRESHOLD * SIGNATURE * 1000))) < 1000)
            chosen = F.when(F.size(chosen) > 0, chosen).otherwise(F.array(F.pmod(F.xxhash64("path"), F.lit(SIGNATURE)).cast("int")))
            paths = rest.select("key", F.explode(F.transform(chosen, lambda i: F.xxhash64("path", i, F.get("sig", i)))).alias("path"))
    # The rest, whole: each bucket in blocks, every pair of blocks.
    count = rest.groupBy("path").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    found.append(_block_pairs(rest.join(count, "path").select("path", "key", "sig", "blocks"), ["path"]).groupBy("path", "i", "j").applyInArrow(_brute, _EDGE))
    return _union(found)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _block_pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with (i, j) and their own block: each row goes to every pair of blocks that has its own."""
    own = F.pmod(F.xxhash64("key", F.lit(9)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return rows.withColumn("own", own).select("*", other).select(
        *[c for c in rows.columns], "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _exact(key, t):
    """Of one pair of blocks of a loose group: each set's links to sets of the other block (or its own), weighted by
    copies, and a spanning forest of the links. One row (key, links, b) per set and per edge."""
    i, j = key[1].as_py(), key[2].as_py()
    keys, first = np.unique(t.column("key").to_numpy(), return_index=True)
    own = t.column("own").to_numpy()[first]
    copies = t.column("copies").to_numpy()[first].astype(np.float64)
    raw = t.column("shingles")
    data = [np.frombuffer(raw[int(k)].as_py(), np.uint64) for k in first]
    n = len(keys)
    size = np.array([len(x) for x in data])
    row = np.repeat(np.arange(n), size)
    _, col = np.unique(np.concatenate(data), return_inverse=True)
    # Shingles that the same sets have are one column with a weight.
    code = W.mix(np.arange(1, n + 1, dtype=np.uint64))
    order = np.argsort(col, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], col[order][1:] != col[order][:-1]]))
    held = np.diff(np.append(at, len(order)))
    pattern = np.add.reduceat(code[row[order]], at)
    shared = np.flatnonzero(held > 1)
    _, one, weight = np.unique(pattern[shared], return_index=True, return_counts=True)
    common = np.zeros((n, n), np.float64)
    for lo in range(0, len(one), 4096):
        m = np.zeros((n, min(4096, len(one) - lo)), np.float32)
        for k, s in enumerate(shared[one[lo:lo + 4096]]):
            m[row[order[at[s]:at[s] + held[s]]], k] = 1
        common += (m * weight[lo:lo + 4096].astype(np.float32)) @ m.T
    whole = size[:, None] + size[None, :] - common
    link = common >= THRESHOLD * whole - 1e-6
    np.fill_diagonal(link, False)
    if i != j:
        link &= own[:, None] != own[None, :]
    links = (link * copies[None, :]).sum(axis=1)
    a, b = np.nonzero(np.triu(link, 1))
    pairs = _forest(a, b, n)
    return pa.table({
        "key": pa.array([*keys.tolist(), *[int(keys[x]) for x, _ in pairs]], pa.int64()),
        "links": pa.array([*links.astype(np.int64).tolist(), *[None] * len(pairs)], pa.int64()),
        "b": pa.array([*[None] * n, *[int(keys[y]) for _, y in pairs]], pa.int64())})


def _with_sets(batches):
    """Rows whose text has the row's set, with the shingles."""
    for b in batches:
        key = b.column(b.schema.get_field_index("key"))
        for i, cut, g in sets(W.column(b, "text")):
            mine = set_keys(cut, g)
            part = b.slice(i, len(mine))
            ok = mine == key.slice(i, len(mine)).to_numpy()
            data = pa.array([g[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            cols = [*[part.column(part.schema.get_field_index(c)) for c in ("key", "comp", "copies", "blocks")], data]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "comp", "copies", "blocks", "shingles"]).filter(pa.array(ok))


def _keyed(batches):
    """(key, shingles) of each text with a set."""
    for b in batches:
        for _, cut, g in sets(W.column(b, "text")):
            data = pa.array([g[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(cut, g)), data], names=["key", "shingles"])


def _one_text_a_set(texts: DataFrame, member: DataFrame, marked: DataFrame) -> DataFrame:
    """``member`` rows (key, comp, blocks, set_id, copies) with the shingles of their set. Where set_id names one row, texts are
    joined by it. It may be null, name several sets or several equal rows: those texts' sets are made first, made single by
    their key, and joined by key, so n rows of one id or none give n rows, not n * n."""
    out = ["key", "comp", "copies", "blocks"]
    rows = marked.where("doc_id is not null").groupBy("key", F.col("doc_id").alias("set_id")).agg(F.count("*").alias("rows")).where("rows > 1")
    of_id = member.where("set_id is not null").groupBy("set_id").agg(F.count("*").alias("sets")).where("sets > 1")
    member = G.written(member.join(rows, ["key", "set_id"], "left").join(of_id, "set_id", "left").withColumn(
        "vague", F.col("set_id").isNull() | F.col("rows").isNotNull() | F.col("sets").isNotNull()).drop("rows", "sets"), "members")
    # Members grow with the rows: the join is by shuffle at every size.
    plain = texts.join(member.where("not vague").hint("merge"), F.col("doc_id") == F.col("set_id")).select(*out, "text").mapInArrow(
        _with_sets, "key long, comp long, copies long, blocks int, shingles binary")
    vague = member.where("vague")
    if vague.isEmpty():
        return plain
    ids = vague.select(F.col("set_id").alias("doc_id")).where("doc_id is not null").distinct()
    asked = texts.where("doc_id is null").unionByName(texts.join(ids, "doc_id", "left_semi").select(*texts.columns))
    single = asked.select("text").mapInArrow(_keyed, "key long, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))
    return plain.unionByName(vague.select(*out).join(single, "key").select(*out, "shingles"))


def join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row (doc_id, class_id, set_id, copies, n_links) per document of ``docs`` (doc_id, text).

    class_id: the least doc_id of the documents that chains of links connect; set_id: the least doc_id with the
    same shingle set; copies: how many documents have that set; n_links: how many other documents
    are similar at 0.8 or more, copies included. A null text or one without words has no set: its own class,
    no links. Rows of equal doc_id count as documents each; null ids are kept out of the least ids, and
    class_id is null if a class has no other. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = G.written(texts.mapInArrow(_sign, f"doc_id long, key long, sig array<int>"), "signed")
    per_set = G.written(marked.groupBy("key").agg(F.min("doc_id").alias("set_id"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "sets")
    loose = G.components(loose_groups(per_set.select("key", "sig"), recall))
    size = loose.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = loose.join(size, "label").select(F.col("node").alias("key"), F.col("label").alias("comp"), "blocks").join(
        per_set.select("key", "set_id", "copies"), "key")
    shingled = _one_text_a_set(texts.where("text is not null"), member, marked)
    told = G.written(_block_pairs(shingled, ["comp"]).groupBy("comp", "i", "j").applyInArrow(_exact, "key long, links long, b long"), "links")
    links = told.where("b is null").groupBy("key").agg(F.sum("links").alias("links"))
    classes = G.components(told.where("b is not null").select(F.col("key").alias("a"), "b"))
    sets_out = per_set.select("key", "set_id", "copies").join(links, "key", "left").join(
        classes.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = sets_out.groupBy("label").agg(F.min("set_id").alias("class_id"))
    sets_out = sets_out.join(least, "label").select("key", "set_id", "copies", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    known = marked.select("doc_id", "key").join(sets_out, "key").select(
        "doc_id", "class_id", "set_id", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    bare = texts.where(F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(bare)
