"""Substring de-duplication by fixed-block anchors.

A repeat of ``window`` words or more contains a whole aligned block of
``block = (window + 1) // 2`` words of its reference text. So non-overlapping blocks are
indexed, every rolling window of ``block`` words probes them, and a hit is extended to
both sides for as long as each run of ``window`` words around it also stands in a text with a
smaller doc_id. The covered words form the maximal exact repeats, and are removed. Windows without a hit are never compared,
neither within a slice nor across slices.

On Spark: documents are dealt into slices by ranges of doc_id. Two exchanges of packed keys
(see :mod:`slices`) follow: one of block hashes, which tells each slice the probes that
hit, and one of the window hashes around the hits, which tells it the windows that an
earlier slice has. Each slice sends a key once, so a passage that stands in a third of all
documents is one entry a slice. Slices are read again by reusing one exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import slices as S
from . import words as W

WINDOW = 13
_SEED = 0x51ED270B7F4A7C15  # window hashes are independent of block hashes


def _blocks(doc, first, h, block: int, window: int, buckets: int):
    """Codes ``bucket << 32 | key`` of all rolling blocks of texts that have a whole window; the
    positions they start at; and which are aligned in their text."""
    g = W.grams(h, block)
    ok = W.inside(doc, block)
    long_enough = np.diff(first) >= window
    ok &= long_enough[doc[:len(g)]] if len(g) else ok
    pos = np.flatnonzero(ok)
    g = g[pos]
    code = (g % np.uint64(buckets) << np.uint64(32)) | (g >> np.uint64(32))
    return code, pos, (pos - first[doc[pos]]) % block == 0


def _distinct(code, aligned):
    """Distinct codes, ascending, the order that sorts ``code``, run starts, and whether any of a run is aligned."""
    order = np.argsort(code)
    s = code[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    hit = np.logical_or.reduceat(aligned[order], at) if len(s) else np.zeros(0, bool)
    return s[at], order, at, hit


def _anchored(doc, first, ids, h, block: int, window: int, buckets: int, far: list) -> np.ndarray:
    """Positions of the whole windows that hold a block that hits: one that texts of several ids in this slice hold, aligned in
    one of them, or one of the codes in ``far``."""
    code, pos, aligned = _blocks(doc, first, h, block, window, buckets)
    u, order, at, indexed = _distinct(code, aligned)
    if not len(u):
        return np.zeros(0, np.int64)
    who = ids[doc[pos]][order]
    local = np.minimum.reduceat(who, at) != np.maximum.reduceat(who, at)
    hit = (local & indexed) | (np.isin(u, np.concatenate(far)) if far else False)
    run = np.zeros(len(order), np.int64)
    run[at[1:]] = 1
    back = np.empty(len(order), bool)
    back[order] = hit[np.cumsum(run)]
    hot = np.zeros(len(doc) + 1, np.int64)
    hot[pos[back] + 1] = 1
    hot = np.cumsum(hot)
    whole = np.flatnonzero(W.inside(doc, window))
    return whole[hot[whole + window - block + 1] > hot[whole]]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, slice_bytes: int = S.SLICE_BYTES,
                     name: str = "dedup") -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, any others), with ``text`` the kept words joined
    by one space where words were removed and unchanged elsewhere, and n_words, n_removed,
    repeats (the word spans removed, [start, end)) in a struct column ``name``, replacing any of that name.

    A null text has no words and stays null. Rows of equal doc_id do not remove
    each other's words; a null doc_id counts as larger than all. Texts shorter than
    ``window`` words are kept. An empty table gives no rows.
    """
    block = (window + 1) // 2
    d = S.deal(docs, slice_bytes)
    buckets = d.buckets
    cut = S.with_slice(docs, d)
    grouped = cut.groupBy("_slice")
    packed = "bucket int, slice int, data binary, flags binary"

    def probe(key, t):
        _, _, _, first, h = W.table_words(t.column("text"))
        doc = W.doc_of(first)
        code, _, aligned = _blocks(doc, first, h, block, window, buckets)
        u, _, _, hit = _distinct(code, aligned)
        return _rows(u, hit, key[0].as_py(), buckets)

    def shared(key, t):
        """Of each slice's keys, those that another slice has too and that are indexed in some slice."""
        sl = t.column("slice").to_numpy()
        data = [np.frombuffer(x, np.uint32) for x in t.column("data").to_pylist()]
        n = np.array([len(x) for x in data])
        flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=k).astype(bool)
                 for f, k in zip(t.column("flags").to_pylist(), n, strict=True)]
        keys = np.concatenate(data)
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(at, len(s)))
        good = (size > 1) & np.logical_or.reduceat(np.concatenate(flags)[order], at)
        back = np.empty(len(keys), bool)
        back[order] = np.repeat(good, size)
        parts = np.split(back, np.cumsum(n)[:-1])
        keep = [i for i, p in enumerate(parts) if p.any()]
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(keep), pa.int32()),
                         "slice": pa.array([int(sl[i]) for i in keep], pa.int32()),
                         "data": pa.array([data[i][parts[i]].tobytes() for i in keep], pa.binary())})

    def windows(key, t, hits):
        """The hashes of windows around blocks that hit, each once."""
        if t.num_rows == 0:
            return _rows64(np.zeros(0, np.uint64), 0, buckets)
        _, _, _, first, h = W.table_words(t.column("text"))
        ids = W.ints(t, "doc_id")
        doc = W.doc_of(first)
        far = [np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(b << 32)
               for b, x in zip(hits.column("bucket").to_pylist(), hits.column("data").to_pylist(), strict=True)]
        at13 = _anchored(doc, first, ids, h, block, window, buckets, far)
        if not len(at13):
            return _rows64(np.zeros(0, np.uint64), 0, buckets)
        g = W.grams(h, window, _SEED)[at13]
        return _rows64(np.unique(g), key[0].as_py(), buckets)

    def earlier(key, t):
        """Of each slice's windows, those that a slice before it has too."""
        t = t.sort_by("slice")
        data = [np.frombuffer(x, np.uint64) for x in t.column("data").to_pylist()]
        keys = np.concatenate(data)
        order = np.argsort(keys, kind="stable")  # stable: within a key, the smallest slice comes first
        s = keys[order]
        again = np.concatenate([[False], s[1:] == s[:-1]])
        back = np.empty(len(keys), bool)
        back[order] = again
        parts = np.split(back, np.cumsum([len(x) for x in data])[:-1])
        keep = [i for i, p in enumerate(parts) if p.any()]
        sl = t.column("slice").to_pylist()
        return pa.table({"slice": pa.array([sl[i] for i in keep], pa.int32()),
                         "data": pa.array([data[i][parts[i]].tobytes() for i in keep], pa.binary())})

    out_type = _out_type(cut)

    def remove(key, t, flagged):
        buf, start, end, first, h = W.table_words(t.column("text"))
        ids = W.ints(t, "doc_id")
        doc = W.doc_of(first)
        n = len(doc)
        grams = W.grams(h, window, _SEED)
        # Within the slice, windows around hits are followed: those that a text of a smaller id has too.
        at13 = _anchored(doc, first, ids, h, block, window, buckets, [])
        g = grams[at13]
        order = np.argsort(g, kind="stable")
        s = g[order]
        gone = np.zeros(len(doc), bool)
        if len(s):
            at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            who = ids[doc[at13]][order]
            least = np.repeat(np.minimum.reduceat(who, at), np.diff(np.append(at, len(s))))
            gone[at13[order]] = least < who
        far = [np.frombuffer(x, np.uint64) for x in flagged.column("data").to_pylist()]
        if far:
            whole = np.flatnonzero(W.inside(doc, window))
            gone[whole] |= np.isin(grams[whole], np.concatenate(far))
        gone = np.flatnonzero(gone)
        cover = np.zeros(n + 1, np.int64)
        cover += np.bincount(gone, minlength=n + 1)
        cover -= np.bincount(gone + window, minlength=n + 1)
        removed = np.cumsum(cover)[:n] > 0
        count = np.concatenate([[0], np.cumsum(removed)])
        lost = count[first[1:]] - count[first[:-1]]
        old = W.column(t, "text")
        new, gaps = [], []
        for i in np.flatnonzero(lost):
            a, b = int(first[i]), int(first[i + 1])
            cut_here = removed[a:b]
            kept = np.flatnonzero(~cut_here) + a
            new.append(b" ".join([buf[start[k]:end[k]].tobytes() for k in kept]).decode())
            flip = np.flatnonzero(np.diff(np.concatenate([[0], cut_here.view(np.int8), [0]])))
            gaps.append([{"start": int(x), "end": int(y)} for x, y in zip(flip[::2], flip[1::2], strict=True)])
        text = old
        if new:
            text = pc.replace_with_mask(old, pa.array(lost > 0), pa.array(new, old.type))
        spans = [[] for _ in range(t.num_rows)]
        for i, x in zip(np.flatnonzero(lost), gaps, strict=True):
            spans[i] = x
        return pa.table({"doc_id": t.column("doc_id"), "text": text, "_rest": t.column("_rest"),
                         "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(lost, pa.int64()),
                         "repeats": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    entries = grouped.applyInArrow(probe, packed)
    hits = entries.groupBy("bucket").applyInArrow(shared, "bucket int, slice int, data binary")
    around = grouped.cogroup(hits.groupBy("slice")).applyInArrow(windows, "bucket int, slice int, data binary")
    flagged = around.groupBy("bucket").applyInArrow(earlier, "slice int, data binary")
    out = grouped.cogroup(flagged.groupBy("slice")).applyInArrow(remove, out_type)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cols = [F.col(f"_rest.`{c}`").alias(c) if c in rest else F.col(c) for c in docs.columns if c.lower() != name.lower()]
    return out.select(*cols, F.struct("n_words", "n_removed", "repeats").alias(name))


def _rows(u, flag, sl: int, buckets: int) -> pa.Table:
    """One row (bucket, slice, data, flags) for each bucket that has codes."""
    cut = np.searchsorted(u, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
    some = np.flatnonzero(np.diff(cut))
    key = u.astype(np.uint32)  # the low half
    return pa.table({"bucket": pa.array(some, pa.int32()), "slice": pa.array([sl] * len(some), pa.int32()),
                     "data": S.packed([key[cut[b]:cut[b + 1]] for b in some]),
                     "flags": S.packed([np.packbits(flag[cut[b]:cut[b + 1]]) for b in some])})


def _rows64(u, sl: int, buckets: int) -> pa.Table:
    """One row (bucket, slice, data) for each bucket that has hashes."""
    b = (u % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    u, cut = u[order], np.searchsorted(b[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cut))
    return pa.table({"bucket": pa.array(some, pa.int32()), "slice": pa.array([sl] * len(some), pa.int32()),
                     "data": S.packed([u[cut[x]:cut[x + 1]] for x in some])})


def _out_type(cut: DataFrame) -> T.StructType:
    keep = {f.name: f.dataType for f in cut.schema.fields}
    return T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_rest", keep["_rest"]),
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def digest(docs: DataFrame, window: int = WINDOW, slice_bytes: int = S.SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: of the kept words joined by one space."""
    out = dedup_substrings(docs.select("doc_id", "text"), window, slice_bytes)
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return out.select("doc_id", F.col("dedup.n_words").alias("n_words"), F.col("dedup.n_removed").alias("n_removed"),
                      F.sha2(flat, 256).alias("kept_sha256"))
