"""Benchmark decontamination: word pairs as seeds, then Smith-Waterman alignment.

An alignment of an item of n words at ``threshold`` has at most B = 2n(1 - threshold) to lose: 3 for a word
replaced or left out, 2 for one past either end, 1 for one put in. A pair of neighbours of the item meets in the
document side by side or with one word between, unless a word of it is lost or two are put in, so at least
n - 1 - 2B/3 pairs do meet, within n + B words. Half of so many pairs, those most frequent over all documents,
are left out; passages in which the others meet often enough are aligned with the item word by
word. By this count no alignment at a threshold above 1/4 is lost, however the copy was edited.

On Spark: the test set is taken in blocks of at most BLOCK_BYTES of text; a block's pairs are
broadcast and every document is read against them where it lies, without a shuffle of documents.
A test set of any size is processed, in as many blocks as it needs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

LEAST = 4  # words of an item
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5  # of the best alignment's score, as a share of the item's own
BLOCK_BYTES = 8 << 20
_CHUNK = 2 << 20
_HITS = 4 << 20  # of a group of texts, or one text
_Q = np.uint64(0x2545F4914F6CDD1D)


def _fold_table() -> np.ndarray:
    fold = np.full(256, 32, np.uint8)
    for lo, hi, to in ((48, 58, 48), (97, 123, 97), (65, 91, 97), (128, 256, 128)):
        fold[lo:hi] = np.arange(to, to + hi - lo)
    return fold


_FOLD = _fold_table()


def normal_words(col):
    """Yield (index of the first text, first word of each text, word hashes) for runs of texts. Words are
    runs of letters and digits, lower-cased (letters up to U+00FF)."""
    buf, offs = W.text_buffer(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + _CHUNK, side="right")) - 1))
        raw = buf[offs[i]:offs[j]]
        part = _FOLD[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
        upper = lead[(raw[lead] >= 0x80) & (raw[lead] <= 0x9E) & (raw[lead] != 0x97)]
        part[upper] += 32
        start, end, first = W.spans(part, offs[i:j + 1] - offs[i])
        yield i, first, W.word_hashes(part, start, end)
        i = j


def pairs(h: np.ndarray, step: int) -> np.ndarray:
    """Hash of each word and the one ``step`` further."""
    return W.mix(h[:-step] * _Q + h[step:])


class Items:
    """Test items: word hashes, and each pair's occurrences by a table of distinct pairs."""

    def __init__(self, ids: list, texts: list, threshold: float):
        self.ids, self.words, grams, item, at = ids, [], [], [], []
        for i0, first, h in normal_words(pa.array(texts, pa.string())):
            for k in range(len(first) - 1):
                w = h[first[k]:first[k + 1]]
                self.words.append(w)
                g = pairs(w, 1) if len(w) >= LEAST else w[:0]
                grams.append(g)
                item.append(np.full(len(g), i0 + k))
                at.append(np.arange(len(g)))
        empty = np.zeros(0, np.int64)
        self.gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.item = np.concatenate(item) if item else empty
        self.at = np.concatenate(at) if at else empty
        self.size = np.array([len(w) for w in self.words], np.int64)
        lose = MATCH * self.size * (1 - threshold)
        self.slack = np.ceil(lose).astype(np.int64) + 1
        self.least = np.maximum(1, np.ceil(self.size - 1 - lose * 2 / 3 - 1e-9)).astype(np.int64)
        self.need = self.least
        self.index(np.ones(len(self.gram), bool))

    def index(self, use: np.ndarray) -> None:
        """Let only these occurrences be seeds."""
        order = np.flatnonzero(use)
        order = order[np.argsort(self.gram[order], kind="stable")]
        self.seed, first = np.unique(self.gram[order], return_index=True)
        self.cut = np.append(first, len(order))
        self.where = order

    def open(self) -> W.Table:
        table = W.Table(max(1, len(self.seed)))
        table.add(self.seed, 0)
        return table

    def leave_out(self, counts: dict[int, int]) -> None:
        """Leave out each item's most frequent pairs, half as many as must meet, and need so many fewer."""
        n = np.array([counts.get(int(g), 0) for g in self.gram.view(np.int64)])
        order = np.lexsort((self.at, -n, self.item))
        size = np.bincount(self.item, minlength=len(self.ids))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        self.need = self.least - self.least // 2
        self.index(rank >= (self.least // 2)[self.item])


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(score, end in b) of the best local alignment of two word sequences, with linear gaps."""
    best, end = 0, 0
    row = np.zeros(len(b) + 1, np.int64)
    ramp = -GAP * np.arange(len(b) + 1)
    for w in a:
        new = np.zeros(len(b) + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(b == w, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + ramp) - ramp
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def hits(table: W.Table, first: np.ndarray, h: np.ndarray):
    """(position, row) of all pairs in the table, side by side or with one word between, by position."""
    doc = W.doc_of(first)
    at, rows = [], []
    for step in (1, 2):
        row = table.find(pairs(h, step))
        at.append(np.flatnonzero((row >= 0) & (doc[:-step] == doc[step:])))
        rows.append(row[at[-1]])
    at, rows = np.concatenate(at), np.concatenate(rows)
    order = np.argsort(at, kind="stable")
    return at[order], rows[order]


def passages(items: Items, table: W.Table, first: np.ndarray, h: np.ndarray):
    """Yield (text, item, start, end): word ranges of texts in which as many seeds of an item meet as a copy needs."""
    doc = W.doc_of(first)
    at, row = hits(table, first, h)
    n = items.cut[row + 1] - items.cut[row]
    total = np.cumsum(n)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(total, total[i] - n[i] + _HITS, side="right")))
        if j < len(at):
            border = int(np.searchsorted(at, first[doc[at[j]]]))
            j = border if border > i else int(np.searchsorted(at, first[doc[at[j]] + 1]))
        yield from _passages(items, doc, first, at[i:j], row[i:j])
        i = j


def _passages(items: Items, doc: np.ndarray, first: np.ndarray, at: np.ndarray, row: np.ndarray):
    n = items.cut[row + 1] - items.cut[row]
    occ = items.where[np.repeat(items.cut[row] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    at = np.repeat(at, n)
    key = doc[at].astype(np.int64) * len(items.ids) + items.item[occ]
    order = np.lexsort((at, key))
    key, at, occ = key[order], at[order], occ[order]
    of = items.item[occ]
    last = np.arange(len(key)) + items.need[of] - 1
    end = np.minimum(last, len(key) - 1)
    good = np.flatnonzero((last < len(key)) & (key[end] == key) & (at[end] - at < items.size[of] + items.slack[of]))
    key, at, occ, of = key[good], at[good], occ[good], of[good]
    lo = np.maximum(first[doc[at]], at - items.at[occ] - items.slack[of])
    hi = np.minimum(first[doc[at] + 1], at - items.at[occ] + items.size[of] + items.slack[of])
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    i = 0
    while i < len(key):
        j, end = i + 1, hi[i]
        while j < len(key) and key[j] == key[i] and lo[j] <= end:
            end = max(end, hi[j])
            j += 1
        yield int(key[i] // len(items.ids)), int(key[i] % len(items.ids)), int(lo[i]), int(end)
        i = j


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    known = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    total = known.agg(F.sum(F.octet_length("text") + 16).alias("b")).first()["b"] or 0
    n = -(-total // block_bytes)
    return [known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): each document and test item whose best alignment
    scores at least ``threshold`` of the item's own score, once, with the doc's word range that was
    aligned up to the best alignment's end.

    Items of fewer than LEAST words, null and empty texts match nothing. Rows of equal doc_id are judged
    one by one; equal items are reported each. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, first_word long, last_word long"
    found = []
    for block in _blocks(benchmark, block_bytes):
        rows = sorted(((r["item_id"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        items = Items([r[0] for r in rows], [r[1] for r in rows], threshold)
        if not len(items.gram):
            continue
        shared = spark.sparkContext.broadcast(items)
        counts = texts.select("text").mapInArrow(_counter(shared), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
        items.leave_out({r["gram"]: r["n"] for r in counts})
        found.append(texts.mapInArrow(_finder(spark.sparkContext.broadcast(items), threshold), schema))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def _counter(shared):
    def run(batches):
        items = shared.value
        table, n = items.open(), np.zeros(len(items.seed), np.int64)
        for b in batches:
            for _, first, h in normal_words(b.column(b.schema.get_field_index("text"))):
                n += np.bincount(hits(table, first, h)[1], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(items.seed[some].view(np.int64)), "n": pa.array(n[some])})
    return run


def _finder(shared, threshold: float):
    def run(batches):
        items = shared.value
        table = items.open()
        for b in batches:
            ids = W.column(b, "doc_id")
            out: list[tuple] = []
            for i0, first, h in normal_words(b.column(b.schema.get_field_index("text"))):
                best: dict[tuple[int, int], tuple] = {}
                for d, i, lo, hi in passages(items, table, first, h):
                    got, end = align(items.words[i], h[lo:hi])
                    share = got / (MATCH * len(items.words[i]))
                    if share >= threshold and share > best.get((d, i), (0,))[0]:
                        best[d, i] = (share, lo - int(first[d]), lo + end - int(first[d]))
                out += [(ids[i0 + d].as_py(), items.ids[i], *v) for (d, i), v in best.items()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r[0] for r in out], pa.int64()), "item_id": pa.array([r[1] for r in out], pa.int64()),
                "score": pa.array([r[2] for r in out], pa.float64()), "first_word": pa.array([r[3] for r in out], pa.int64()),
                "last_word": pa.array([r[4] for r in out], pa.int64())})
    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of the documents that no test item is found in. Rows with a null doc_id are kept."""
    bad = contaminated(docs, benchmark, threshold, block_bytes).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")
