"""Document likelihood under a gated recurrent language model.

Tokens are words (A-Z lower-cased) and one end per document. The model predicts each token in two
steps from a GRU's state: its class, then the word within the class. Classes hold the VOCAB
most frequent training words by falling frequency; every other word belongs to a class of
its own kind (by its last letter), within which it is as likely as its smoothed training count.
So probabilities sum to one over all words. The state starts at zero with each document and
is carried across the windows of truncated backpropagation and of scoring.

On Spark: (1) slices of documents send distinct words with counts to buckets by hash, buckets add
them up over all training documents and answer each slice (one exchange there and back, a hot word is
one entry per slice); (2) one task starts the model on a bounded sample of training documents;
(3) every partition of training documents goes on from there, and the weights are averaged by
tokens, in chunks, by a group-by; (4) each slice scores its documents whole.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import stage_path

from . import slices as S
from . import words as W

VOCAB = 1000
CLASSES = 24
HIDDEN = 16
STEPS = 24  # of truncated backpropagation
LANES = 384
RATE = 0.01
START_DOCS = 1500  # sampled training documents that start the model, about
START_BYTES = 4 << 20
SLICE_BYTES = 16 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_KINDS = b"entrsdhoaiug"  # last letters with a class of their own; then other letters, other scripts, the rest
KINDS = len(_KINDS) + 4
_KIND = np.full(256, len(_KINDS) + 2, np.uint8)
_KIND[97:123] = len(_KINDS)
_KIND[128:] = len(_KINDS) + 1
for _i, _c in enumerate(_KINDS):
    _KIND[_c] = _i
_KEY_BITS = np.uint64(15)
assert KINDS == 16  # a kind fits the low four bits of a word's key
END = np.uint64(0xA5A5A5A5A5A5A5A0 | (KINDS - 1))


def keys(col) -> tuple[np.ndarray, np.ndarray]:
    """(key of each word, each text's first word): a hash with the word's kind in the low bits."""
    buf, offs = W.text_buffer(col)
    buf = _FOLD[buf]
    start, end, first = W.spans(buf, offs)
    h = W.word_hashes(buf, start, end)
    if not len(h):
        return h, first
    last = buf[end - 1]
    sign = _KIND[last] == len(_KINDS) + 2
    last = np.where(sign & (end - start > 1), buf[np.maximum(end - 2, 0)], last)
    return (h & ~_KEY_BITS) | _KIND[last], first


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return sorted_keys[at], np.diff(np.append(at, len(sorted_keys)))


def word_counts(first: np.ndarray, k: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a slice, the end among them, ascending, and their counts in texts to learn from."""
    mask = np.repeat(learn, np.diff(first))
    u, _ = _runs(np.sort(np.append(k, END)))
    t, n = _runs(np.sort(k[mask]))
    count = np.zeros(len(u), np.int64)
    count[np.searchsorted(u, t)] = n
    count[np.searchsorted(u, END)] += int(learn.sum())
    return u, count


def _split(u: np.ndarray, buckets: int):
    """(bucket, indices of its keys) of each bucket that has some; the order only depends on the keys."""
    b = ((u >> np.uint64(4)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[order], np.arange(buckets + 1))
    return [(int(x), order[cut[x]:cut[x + 1]]) for x in np.flatnonzero(np.diff(cut))]


class Vocabulary:
    """Token numbers: the words of classes in turn, then one for each kind of other word."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, types: int, kind_count: np.ndarray, kind_types: np.ndarray):
        order = np.lexsort((words, -counts))
        self.words, self.counts = words[order], counts[order].astype(np.float64)
        self.total, self.types = int(total), int(types)
        root = np.sqrt(self.counts)
        share = np.minimum(CLASSES - 1, (np.cumsum(root) - root) * CLASSES // max(root.sum(), 1e-9)).astype(int)
        _, self.cls = np.unique(share, return_inverse=True)
        self.n_words = len(self.words)
        self.n_cls = int(self.cls.max()) + 1 if self.n_words else 0
        self.outputs = self.n_cls + KINDS
        kind = (self.words & _KEY_BITS).astype(int)
        taken = np.bincount(kind, self.counts + 0.5, KINDS) if self.n_words else np.zeros(KINDS)
        self.mass = np.maximum(kind_count + 0.5 * kind_types - taken, 0) + 0.5  # and one unseen word a kind
        self.first = np.searchsorted(self.cls, np.arange(self.n_cls + 1))

    def open(self) -> None:
        order = np.argsort(self.words)
        self._sorted, self._rank = self.words[order], order
        self.table = W.Table(max(1, self.n_words))
        self.table.add(self._sorted, 0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "_sorted", "_rank")}

    def tokens(self, k: np.ndarray) -> np.ndarray:
        if "table" not in self.__dict__:
            self.open()
        row = self.table.find(k)
        other = self.n_words + (k & _KEY_BITS).astype(np.int32)
        return np.where(row >= 0, self._rank[row] if self.n_words else 0, other).astype(np.int32)

    def target(self, tok: np.ndarray) -> np.ndarray:
        """The class of each token."""
        cls = np.append(self.cls, np.arange(KINDS) + self.n_cls)
        return cls[tok]


class GRU:
    """Parameters in one flat float32 vector."""

    def __init__(self, vocab: Vocabulary, theta: np.ndarray | None = None):
        self.v = vocab
        h = HIDDEN
        self.shapes = {"x": (vocab.n_words + KINDS + 1, 3 * h), "u": (h, 3 * h), "c": (h, vocab.outputs), "cb": (vocab.outputs,),
                       "w": (h, vocab.n_words), "wb": (vocab.n_words,)}
        size = sum(int(np.prod(s)) for s in self.shapes.values())
        self.theta = np.zeros(size, np.float32) if theta is None else np.asarray(theta, np.float32).copy()
        self.p, at = {}, 0
        for name, s in self.shapes.items():
            n = int(np.prod(s))
            self.p[name] = self.theta[at:at + n].reshape(s)
            at += n
        if theta is None:
            rng = np.random.default_rng(1)
            self.p["x"][:] = rng.normal(0, 0.3, self.shapes["x"])
            self.p["u"][:] = rng.normal(0, 0.25, self.shapes["u"])
            for name in ("c", "w"):
                self.p[name][:] = rng.normal(0, 0.02, self.shapes[name])
            by_class = np.bincount(vocab.cls, vocab.counts + 0.5, vocab.n_cls) if vocab.n_words else np.zeros(0)
            self.p["cb"][:] = np.log(np.append(by_class, vocab.mass))
            self.p["cb"] -= self.p["cb"].max()
            self.p["wb"][:] = np.log(vocab.counts + 0.5) - np.log(by_class)[vocab.cls] if vocab.n_words else 0

    def run(self, tok_in: np.ndarray, keep: np.ndarray, h: np.ndarray, train: bool = False):
        """States after each step. tok_in, keep: steps x lanes; keep is 0 where a document starts."""
        n, H = tok_in.shape[1], HIDDEN
        x, u = self.p["x"], self.p["u"]
        out = np.empty((len(tok_in), n, H), np.float32)
        saved = []
        for t in range(len(tok_in)):
            h = h * keep[t][:, None]
            a = x[tok_in[t]]
            b = h @ u
            zr = np.tanh(a[:, :2 * H] + b[:, :2 * H])
            zr *= 0.5
            zr += 0.5
            r = zr[:, H:]
            m = np.tanh(a[:, 2 * H:] + r * b[:, 2 * H:])
            z = zr[:, :H]
            new = m + z * (h - m)
            if train:
                saved.append((h, zr, m, b[:, 2 * H:]))
            h = new
            out[t] = h
        return out, h, saved

    def likelihood(self, hid: np.ndarray, target: np.ndarray, grad: bool = False):
        """Natural log of each target token's probability up to the word within its kind;
        with ``grad`` also the gradients of their negative sum."""
        v, p = self.v, self.p
        cls = v.target(target)
        logits = hid @ p["c"]
        logits += p["cb"]
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        s = e.sum(axis=1)
        rows = np.arange(len(target))
        out = logits[rows, cls] - np.log(s)
        g = {}
        if grad:
            e /= s[:, None]
            e[rows, cls] -= 1
            g["c"], g["cb"] = hid.T @ e, e.sum(axis=0)
            dh = e @ p["c"].T
            g["w"], g["wb"] = np.zeros_like(p["w"]), np.zeros_like(p["wb"])
        order = np.argsort(cls, kind="stable")
        cut = np.searchsorted(cls[order], np.arange(v.n_cls + 1))
        for c in range(v.n_cls):
            lo, hi = v.first[c], v.first[c + 1]
            at = order[cut[c]:cut[c + 1]]
            if hi - lo < 2 or not len(at):
                continue
            sub = hid[at]
            q = sub @ p["w"][:, lo:hi]
            q += p["wb"][lo:hi]
            q -= q.max(axis=1, keepdims=True)
            e = np.exp(q)
            s = e.sum(axis=1)
            k, word = np.arange(len(at)), target[at] - lo
            out[at] += q[k, word] - np.log(s)
            if grad:
                e /= s[:, None]
                e[k, word] -= 1
                g["w"][:, lo:hi], g["wb"][lo:hi] = sub.T @ e, e.sum(axis=0)
                dh[at] += e @ p["w"][:, lo:hi].T
        return (out, g, dh) if grad else out

    def gradient(self, tok_in, target, keep, live, h):
        """(sum of log probabilities, gradients of the negative mean, last state) of one window."""
        H, n = HIDDEN, tok_in.shape[1]
        hid, last, saved = self.run(tok_in, keep, h, train=True)
        flat, on = hid.reshape(-1, H), live.reshape(-1)
        ll, g, dflat = self.likelihood(flat[on], target.reshape(-1)[on], grad=True)
        dhid = np.zeros_like(flat)
        dhid[on] = dflat
        dhid = dhid.reshape(hid.shape)
        gx, gu = np.zeros_like(self.p["x"]), np.zeros_like(self.p["u"])
        u, carry = self.p["u"], np.zeros((n, H), np.float32)
        da = np.empty((len(tok_in), n, 3 * H), np.float32)
        for t in reversed(range(len(tok_in))):
            h0, zr, m, bn = saved[t]
            z, r = zr[:, :H], zr[:, H:]
            dh = dhid[t] + carry
            dm = dh * (1 - z) * (1 - m * m)
            db = np.empty((n, 3 * H), np.float32)
            db[:, :H] = dh * (h0 - m) * (2 * z * (1 - z))
            db[:, H:2 * H] = dm * bn * (2 * r * (1 - r))
            da[t, :, :2 * H], da[t, :, 2 * H:] = db[:, :2 * H], dm
            db[:, 2 * H:] = dm * r
            gu += h0.T @ db
            carry = (db @ u.T + dh * z) * keep[t][:, None]
        idx, vec = tok_in.reshape(-1), da.reshape(-1, 3 * H)
        order = np.argsort(idx, kind="stable")
        s = idx[order]
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        gx[s[at]] = np.add.reduceat(vec[order], at, axis=0)
        g["x"], g["u"] = gx, gu
        scale = np.float32(1 / max(1, int(on.sum())))
        return float(ll.sum()), np.concatenate([(g[k] * scale).reshape(-1) for k in self.shapes]), last

    def learn(self, streams, rate: float = RATE, epochs: int = 1, state: dict | None = None) -> int:
        """Adam over a stream of (tokens, text lengths with end); returns the tokens learned."""
        mom = state if state is not None else {}
        mom.setdefault("m", np.zeros_like(self.theta))
        mom.setdefault("s", np.zeros_like(self.theta))
        mom.setdefault("t", 0)
        seen = 0
        for tokens, sizes in streams:
            for _ in range(epochs):
                seen += len(tokens)
                for tok_in, target, keep, live in _windows(self.v, tokens, sizes):
                    h = np.zeros((tok_in.shape[1], HIDDEN), np.float32)
                    for a in range(0, len(tok_in), STEPS):
                        cut = slice(a, a + STEPS)
                        if not live[cut].any():
                            break
                        _, g, h = self.gradient(tok_in[cut], target[cut], keep[cut], live[cut], h)
                        mom["t"] += 1
                        norm = float(np.sqrt((g * g).sum()))
                        if norm > 1:
                            g /= norm
                        mom["m"] += 0.1 * (g - mom["m"])
                        mom["s"] += 0.01 * (g * g - mom["s"])
                        t = mom["t"]
                        step = rate * min(1.0, t / 20) / (1 + t / 2000)
                        self.theta -= step * (mom["m"] / (1 - 0.9 ** t)) / (np.sqrt(mom["s"] / (1 - 0.99 ** t)) + 1e-6)
        return seen


def _windows(v: Vocabulary, tokens: np.ndarray, sizes: np.ndarray):
    """Training lanes: the token stream cut into equal runs; the input is the token before, or the start."""
    lanes = int(np.clip(len(tokens) // 2000, 8, LANES))
    steps = -(-len(tokens) // lanes)
    start = v.n_words + KINDS
    before = np.concatenate([[start], tokens[:-1]]).astype(np.int32)
    heads = np.cumsum(sizes) - sizes
    before[heads] = start
    keep = np.ones(len(tokens), np.float32)
    keep[heads] = 0
    pad = lanes * steps - len(tokens)
    shape = lambda a, fill: np.concatenate([a, np.full(pad, fill, a.dtype)]).reshape(lanes, steps).T
    yield shape(before, start), shape(tokens, 0), shape(keep, 0), shape(np.ones(len(tokens), bool), False)


def text_scores(model: GRU, tokens: np.ndarray, sizes: np.ndarray, block: int = 96) -> np.ndarray:
    """Natural log probability of each text (tokens with ends; sizes of texts, 1 at least), each whole
    in one lane from a zero state: long ones first, to the lane with the least to do."""
    import heapq

    v, n = model.v, len(sizes)
    out = np.zeros(n)
    if not n:
        return out
    lanes = int(np.clip(len(tokens) // 8000, 16, LANES // 2))
    heap = [(0, i) for i in range(min(lanes, n))]
    queue: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-sizes, kind="stable"):
        load, lane = heapq.heappop(heap)
        queue[lane].append(int(d))
        heapq.heappush(heap, (load + int(sizes[d]), lane))
    queue.sort(key=lambda q: -int(sizes[q].sum()))
    total = np.array([int(sizes[q].sum()) for q in queue])
    head = np.cumsum(sizes) - sizes
    start = v.n_words + KINDS
    before = np.concatenate([[start], tokens[:-1]]).astype(np.int32)
    before[head] = start
    keep = np.ones(len(tokens), np.float32)
    keep[head] = 0
    owner = np.repeat(np.arange(n), sizes)
    order = [np.concatenate([np.arange(head[d], head[d] + sizes[d]) for d in q]) for q in queue]
    h = np.zeros((len(queue), HIDDEN), np.float32)
    for a in range(0, int(total[0]), block):
        live = int(np.searchsorted(-total, -a, side="left"))
        at = np.zeros((min(block, int(total[0]) - a), live), np.int64)
        on = np.zeros(at.shape, bool)
        for i in range(live):
            part = order[i][a:a + block]
            at[:len(part), i], on[:len(part), i] = part, True
        hid, h, _ = model.run(before[at], keep[at], h[:live])
        pick = at[on]
        ll = model.likelihood(hid.reshape(-1, HIDDEN)[on.reshape(-1)], tokens[pick])
        out += np.bincount(owner[pick], ll, n)
    return out


def score_documents(docs: DataFrame, learn: Column, slice_bytes: int = SLICE_BYTES, start_docs: int = START_DOCS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of all documents, learning from those
    where ``learn`` is true (null: false).

    base_score: log10 likelihood under add-a-half unigrams of the training tokens; score: under the
    recurrent model. A null or empty text is its end alone. Rows of equal doc_id are scored one by
    one. Other columns are not read. Without a row to learn from both come from empty counts.
    """
    spark = docs.sparkSession
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.coalesce(learn, F.lit(False)).alias("learn"))
    d = S.deal(marked, slice_bytes)
    buckets = d.buckets
    cut = S.with_slice(marked, d).select("_slice", "doc_id", "text", F.col("_rest.learn").alias("learn"))

    def gather(key, t):
        k, first = keys(t.column("text"))
        u, n = word_counts(first, k, W.column(t, "learn").to_numpy(zero_copy_only=False))
        parts = _split(u, buckets)
        return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int32()), "slice": pa.array([key[0].as_py()] * len(parts), pa.int32()),
                         "words": S.packed([u[i] for _, i in parts]), "counts": S.packed([n[i] for _, i in parts])})

    def add_up(key, t):
        """A row for each slice: the counts of its words over all slices. And a row of sums: tokens, types, both by kind, the top words."""
        sl = t.column("slice").to_pylist()
        data = [np.frombuffer(x, np.uint64) for x in t.column("words").to_pylist()]
        allk = np.concatenate(data)
        n = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist()])
        order = np.argsort(allk)
        u, size = _runs(allk[order])
        total = np.add.reduceat(n[order], np.cumsum(size) - size)
        back = np.empty(len(allk), np.int64)
        back[order] = np.repeat(total, size)
        seen = total > 0
        kind = (u & _KEY_BITS).astype(int)
        best = np.argsort(-total, kind="stable")[:VOCAB]
        best = best[total[best] > 0]
        parts = np.split(back, np.cumsum([len(x) for x in data])[:-1])
        rows = len(sl) + 1
        none = [None] * len(sl)
        return pa.table({
            "slice": pa.array([*sl, None], pa.int32()), "bucket": pa.array([key[0].as_py()] * rows, pa.int32()),
            "counts": pa.array([*[p.tobytes() for p in parts], None], pa.binary()),
            "kind_tokens": pa.array([*none, np.bincount(kind, total, KINDS).tolist()], pa.list_(pa.float64())),
            "kind_types": pa.array([*none, np.bincount(kind, seen, KINDS).tolist()], pa.list_(pa.float64())),
            "top": pa.array([*none, u[best].view(np.int64).tolist()], pa.list_(pa.int64())),
            "top_counts": pa.array([*none, total[best].tolist()], pa.list_(pa.int64()))})

    sent = cut.groupBy("_slice").applyInArrow(gather, "bucket int, slice int, words binary, counts binary")
    path = stage_path(spark, f"lm-{uuid.uuid4().hex}")
    sent.groupBy("bucket").applyInArrow(
        add_up, "slice int, bucket int, counts binary, kind_tokens array<double>, kind_types array<double>, top array<long>, top_counts array<long>"
    ).write.parquet(path)
    back = spark.read.parquet(path)
    sums = back.where("slice is null")
    by_kind = sums.select(F.posexplode(F.arrays_zip("kind_tokens", "kind_types"))).groupBy("pos").agg(
        F.sum("col.kind_tokens").alias("n"), F.sum("col.kind_types").alias("v")).collect()
    kind_n, kind_v = np.zeros(KINDS), np.zeros(KINDS)
    for r in by_kind:
        kind_n[r["pos"]], kind_v[r["pos"]] = r["n"], r["v"]
    top = sums.select(F.explode(F.arrays_zip("top", "top_counts")).alias("w")).select("w.*").orderBy(F.desc("top_counts"), "top").limit(VOCAB).collect()
    vocab = Vocabulary(np.array([r["top"] for r in top], np.int64).view(np.uint64), np.array([r["top_counts"] for r in top], np.int64),
                       int(kind_n.sum()), int(kind_v.sum()), kind_n, kind_v)
    model = _fit(marked.where("learn").select("text"), vocab, start_docs)
    shared = spark.sparkContext.broadcast((vocab, model.theta if model else None))

    def score(key, t, told):
        v, theta = shared.value
        k, first = keys(t.column("text"))
        n_docs = t.num_rows
        learn_of = W.column(t, "learn").to_numpy(zero_copy_only=False)
        u, _ = word_counts(first, k, learn_of)
        count = np.zeros(len(u), np.int64)
        got = dict(zip(told.column("bucket").to_pylist(), told.column("counts").to_pylist(), strict=True))
        for b, i in _split(u, buckets):
            count[i] = np.frombuffer(got[b], np.int64)
        table = W.Table(len(u))
        table.add(u, 0)
        stream, sizes = with_ends(k, first)
        c = count[table.find(stream)]
        doc = np.repeat(np.arange(n_docs), sizes)
        base = np.log10((c + 0.5) / (v.total + 0.5 * (v.types + 1)))
        tok = v.tokens(stream)
        other = tok >= v.n_words
        inner = np.log((c[other] + 0.5) / v.mass[tok[other] - v.n_words])
        gru = GRU(v, theta)
        ll = text_scores(gru, tok, sizes) + np.bincount(doc[other], inner, n_docs)
        return pa.table({"doc_id": t.column("doc_id"), "learned": t.column("learn"), "n_tokens": pa.array(sizes, pa.int64()),
                         "n_known": pa.array(np.bincount(doc, c > 0, n_docs).astype(np.int64)), "train_tokens": pa.array([v.total] * n_docs, pa.int64()),
                         "base_score": pa.array(np.bincount(doc, base, n_docs)), "score": pa.array(ll / np.log(10))})

    answers = back.where("slice is not null").select("slice", "bucket", "counts")
    return cut.groupBy("_slice").cogroup(answers.groupBy("slice")).applyInArrow(
        score, "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def with_ends(k: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words with an end after each text, and the texts' sizes with it."""
    return np.insert(k, first[1:], END), np.diff(first) + 1


def _streams(vocab: Vocabulary, batches):
    for b in batches:
        if b.num_rows:
            k, first = keys(b.column(b.schema.get_field_index("text")))
            stream, sizes = with_ends(k, first)
            yield vocab.tokens(stream), sizes


def _fit(texts: DataFrame, vocab: Vocabulary, start_docs: int) -> GRU | None:
    """The model started on a sample and then averaged over all partitions of ``texts``."""
    if not vocab.n_words:
        return None
    spark = texts.sparkSession
    many, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    part = min(1.0, start_docs / max(1, many), START_BYTES / max(1, size))
    u = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    # Copies of one text are drawn together, and are one text of the sample.
    sample = texts.where((u < part) | F.lit(part >= 1)).select("text").distinct().select(F.lit(0).alias("one"), "text")
    shared = spark.sparkContext.broadcast(vocab)

    def start(key, t):
        v = shared.value
        t = t.take(np.argsort(W.word_hashes(*_whole(t)), kind="stable"))
        k, first = keys(t.column("text"))
        stream, sizes = with_ends(k, first)
        tok = v.tokens(stream)
        limit = max(1, int(np.searchsorted(np.cumsum(sizes), START_BYTES // 6)))
        sizes = sizes[:limit]
        tok = tok[:int(sizes.sum())]
        model = GRU(v)
        model.learn([(tok, sizes)], epochs=int(np.clip(1_200_000 // max(1, len(tok)), 1, 8)))
        return pa.table({"theta": pa.array([model.theta.tobytes()], pa.binary())})

    got = sample.groupBy("one").applyInArrow(start, "theta binary").collect()
    theta = np.frombuffer(got[0]["theta"], np.float32) if got else GRU(vocab).theta
    begun = spark.sparkContext.broadcast(theta)
    chunk = 4096

    def go_on(batches):
        v = shared.value
        model, state = GRU(v, begun.value), {}
        seen = model.learn(_streams(v, batches), rate=RATE / 3, state=state)
        if seen:
            n = -(-len(model.theta) // chunk)
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array(range(n), pa.int32()), "tokens": pa.array([seen] * n, pa.int64()),
                "theta": pa.array([model.theta[i * chunk:(i + 1) * chunk].tobytes() for i in range(n)], pa.binary())})

    def average(key, t):
        w = t.column("tokens").to_numpy().astype(np.float64)
        x = np.stack([np.frombuffer(b, np.float32) for b in t.column("theta").to_pylist()])
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "theta": pa.array([((w / w.sum()) @ x).astype(np.float32).tobytes()], pa.binary())})

    parts = texts.mapInArrow(go_on, "chunk int, tokens long, theta binary")
    done = parts.groupBy("chunk").applyInArrow(average, "chunk int, theta binary").orderBy("chunk").collect()
    return GRU(vocab, np.concatenate([np.frombuffer(r["theta"], np.float32) for r in done])) if done else GRU(vocab, theta)


def _whole(t):
    """Each text as one span, for a hash of the whole text."""
    buf, offs = W.text_buffer(t.column("text"))
    return buf, offs[:-1], offs[1:]
