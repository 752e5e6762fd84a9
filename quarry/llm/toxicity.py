"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary windows; a common body of ordinary text
follows both, so that what both classes say compresses alike. A window's gain is how many bytes shorter the toxic dictionary
compresses it. Training starts from windows drawn from all texts and repeats: windows of toxic texts with the largest gains train
the next toxic dictionary; ordinary windows that gain train the next ordinary one and join the body. The sums of a text's one, two and
three largest gains are held against thresholds, which rise with the logarithm of its number of windows. Held-back labelled rows
calibrate them: the least weight of wrong rows, at the classes' true shares, a false alarm counted as COST misses.
A text is toxic if it passes a threshold; the score is a logistic curve over the bytes by which it does. A text without a gain is never toxic.

On Spark: a bounded number of labelled rows is drawn and written; executors read their whole texts in each
round and send a few windows a text, and six numbers a calibration row. The first dictionaries are made of windows drawn by hash from
whole texts. Dictionaries (a few 100 KB) are made on the driver and broadcast; scoring is one map over the documents, whole texts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .graph import written

TOXIC_ROWS = 2400  # sampled labelled rows, about; one third of each class calibrates
ORDINARY_ROWS = 4500
FIRST_TOXIC, FIRST_ORDINARY = 100_000, 6_000  # windows, about, that the first dictionaries are made of
WINDOW = 12  # words
ORDINARY_BYTES = 150_000
HARD_BYTES = 100_000
TOXIC_BYTES = 12_000
ROUNDS = 7
DEPTH = 3  # sums of a text's largest gains that have a threshold each
GROW = (0.0, 0.5, 1.0, 1.5, 2.0)  # bytes that the thresholds may rise by
COST = 3.0  # a false alarm counts as so many misses
TOP = 4  # windows of a toxic text that train the next dictionary, and of an ordinary one that join the body
#: Opens each window and ends both dictionaries, so that every window compresses to some degree.
_HEAD = bytes(range(1, 25)) + b" "
_FOLD = bytes((c + 32 if 65 <= c < 91 else c) if (65 <= c < 91 or 97 <= c < 123 or c >= 128) else 32 for c in range(256))


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Consecutive runs of ``size`` words, lower-cased, without digits and signs."""
    words = text.translate(_FOLD).split()
    return [_HEAD + b" ".join(words[i:i + size]) + b" " for i in range(0, len(words), size)]


def compressor(body: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(
        3, min_match=4, strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)


def trained(samples: list[bytes], size: int) -> bytes:
    """``size`` bytes: content of a dictionary trained on samples, or the samples where they are too few."""
    samples = [s[len(_HEAD) - 1:] for s in samples]
    try:
        body = zstandard.train_dictionary(size + 1500, samples, k=16, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        body = b"".join(samples)[:size]
    return body.rjust(size, b"\0")


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: np.ndarray = field(default_factory=lambda: np.full(DEPTH, np.inf))  # of the largest gain, the sum of the two largest, ...
    grow: float = 0.0  # bytes a threshold rises with the logarithm of a text's number of windows
    slope: float = 1.0

    def open(self) -> None:
        self.by_ordinary, self.by_toxic = compressor(self.ordinary).compress, compressor(self.toxic).compress

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("by_")}

    def gains(self, wins: list[bytes]) -> np.ndarray:
        if "by_toxic" not in self.__dict__:
            self.open()
        a, b = self.by_ordinary, self.by_toxic
        return np.array([len(a(w)) - len(b(w)) for w in wins], dtype=np.int64)

    def features(self, text: bytes) -> list[float]:
        """Sums of the 1 to DEPTH largest window gains, and the logarithm of the number of windows."""
        g = np.sort(self.gains(windows(text)))[::-1]
        return [*np.cumsum(np.pad(g[:DEPTH], (0, max(0, DEPTH - len(g)))).astype(float)), float(np.log1p(len(g)))]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """By how many bytes some threshold is passed; -1 at most without any gain."""
        m = (x[:, :DEPTH] - self.grow * x[:, DEPTH:] - self.threshold).max(axis=1)
        return np.where(x[:, 0] > 0, m, np.minimum(m, -1.0))

    def score(self, text: bytes) -> float:
        m = self.margin(np.array([self.features(text)]))[0]
        return float(1 / (1 + np.exp(-np.clip(self.slope * m, -30, 30))))

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Thresholds with the least weight of wrong rows, then the slope of the score."""
        best = None
        for grow in GROW:
            found, at = np.zeros(len(y), bool), np.full(DEPTH, np.inf)
            for k in range(DEPTH):
                v = np.where(x[:, 0] > 0, x[:, k] - grow * x[:, DEPTH], -np.inf)
                values = np.unique(v[~found & np.isfinite(v)])
                loss = np.where(found, 0, np.where(y > 0, -weight, weight))
                order = np.argsort(-v, kind="stable")
                total = np.append(0, np.cumsum(loss[order]))
                cut = np.searchsorted(-v[order], -values, side="right")
                if len(values) and total[cut].min() < 0:
                    i = int(total[cut].argmin())
                    below = v[(v < values[i]) & np.isfinite(v)]
                    at[k] = (values[i] + below.max()) / 2 if len(below) else values[i] - 0.5
                    found |= v >= at[k]
            wrong = float(weight[found != (y > 0)].sum())
            if best is None or wrong < best[0] - 1e-9:
                best = wrong, grow, at
        self.grow, self.threshold = best[1], best[2]
        if np.isinf(self.threshold).all():
            self.threshold = np.where(np.arange(DEPTH) == 0, (x[:, 0] - self.grow * x[:, DEPTH]).max() + 1, np.inf)
        m, a = self.margin(x), 0.1
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * m, -30, 30)))
            a = max(1e-3, a - (weight @ ((p - y) * m) + 0.5 * a) / (weight @ (p * (1 - p) * m * m) + 0.5))
        self.slope = a


def _each(rows: DataFrame, use: dict, schema: str, run) -> list:
    """Rows that ``run(key, text)`` gives, a tuple or None, with _toxic and key before, of rows (_toxic, key, text) whose
    key is among ``use`` of their class; by class and key."""
    shared = rows.sparkSession.sparkContext.broadcast(use)
    fields = T._parse_datatype_string("_toxic int, key string, " + schema)

    def go(batches):
        use = shared.value
        for b in batches:
            kinds, keys = W.column(b, "_toxic").to_pylist(), W.column(b, "key").to_pylist()
            buf, offs = W.text_buffer(W.column(b, "text"))
            raw, out = memoryview(buf), []
            for i, (t, k) in enumerate(zip(kinds, keys, strict=True)):
                got = run(k, bytes(raw[offs[i]:offs[i + 1]])) if use is None or k in use[t] else None
                if got is not None:
                    out.append((t, k, *got))
            yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in out], schema=arrow)

    kind = {"int": pa.int32(), "string": pa.string(), "array<binary>": pa.list_(pa.binary()), "array<double>": pa.list_(pa.float64())}
    arrow = pa.schema([(f.name, kind[f.dataType.simpleString()]) for f in fields])
    return sorted(rows.mapInArrow(go, fields).collect(), key=lambda r: tuple(r))


def _drawn(key: str, wins: list[bytes], share: float) -> list[bytes]:
    """Windows drawn by a hash of the text's key and their number."""
    u = W.mix(np.uint64(int(key[:15], 16)) + np.arange(len(wins), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) / 2.0**64
    return [wins[i] for i in np.flatnonzero(u < share)]


def fit(rows: DataFrame, prior: float | None = None) -> Model | None:
    """A model from rows (_toxic 1 or 0, key: md5 of the text, text); None if a class has none. ``prior`` is the share of
    toxic rows. A third of each class's different texts calibrates, whole."""
    count = _each(rows, None, "n int", lambda k, text: (-(-len(text.translate(_FOLD).split()) // WINDOW),))
    keys = {t: sorted({r["key"] for r in count if r["_toxic"] == t}) for t in (0, 1)}
    if not keys[0] or not keys[1]:
        return None
    cal = {t: set(k[::3]) for t, k in keys.items()}
    use = {t: set(k) - cal[t] or cal[t] for t, k in keys.items()}
    total = Counter()
    for r in count:
        total[r["_toxic"]] += r["n"] * (r["key"] in use[r["_toxic"]])
    first = {}
    for t, many in ((1, FIRST_TOXIC), (0, FIRST_ORDINARY)):
        share = min(1.0, many / max(1, total[t]))
        got = _each(rows.where(F.col("_toxic") == t), use, "wins array<binary>", lambda k, text, share=share: (_drawn(k, windows(text), share),))
        first[t] = [bytes(w) for r in got for w in r["wins"]]
    order = np.argsort(W.mix(np.arange(len(first[0]), dtype=np.uint64)), kind="stable")
    body = b"".join(first[0][i][len(_HEAD):] for i in order)[:ORDINARY_BYTES]
    new, hard = trained(first[1], TOXIC_BYTES), {}

    def ordinary(hard: dict) -> bytes:
        return trained([_HEAD + w for w in hard] + first[0], TOXIC_BYTES)

    for _ in range(ROUNDS):
        model = _model(new, hard, body, ordinary(hard))
        shared = rows.sparkSession.sparkContext.broadcast(model)
        got = _each(rows, use, "wins array<binary>", lambda k, text, shared=shared: (_best(shared.value, windows(text)) or None,))
        chosen = [bytes(w) for r in got if r["_toxic"] == 1 for w in r["wins"] or ()]
        hard |= dict.fromkeys(bytes(w)[len(_HEAD):] for r in got if r["_toxic"] == 0 for w in r["wins"] or ())
        if len(chosen) < 2:
            break
        new = trained(chosen, TOXIC_BYTES)
    model = _model(new, hard, body, ordinary(hard))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    got = _each(rows, cal, "x array<double>", lambda k, text: (shared.value.features(text),))
    x, y = np.array([r["x"] for r in got]), np.array([float(r["_toxic"]) for r in got])
    share = y.mean()
    weight = np.ones(len(y))
    if prior is not None and 0 < prior < 1:
        weight = np.where(y > 0, prior / share, (1 - prior) / (1 - share))
    model.calibrate(x, y, np.where(y > 0, weight, COST * weight))
    return model


def _model(new: bytes, hard: dict, body: bytes, old: bytes) -> Model:
    shared = b"".join(reversed(hard))[:HARD_BYTES] + body
    return Model(old + shared + _HEAD, new + shared + _HEAD)


def _best(model: Model, wins: list[bytes]) -> list[bytes]:
    """The windows of a text with the largest gains above 0, TOP at most."""
    g = model.gains(wins)
    return [wins[i] for i in np.argsort(-g, kind="stable")[:TOP] if g[i] > 0]


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model | None:
    """A model from documents (doc_id, text) and labels (doc_id, toxic 0 or 1). About so many rows of each class
    are drawn by a hash of doc_id; their ids are the only thing broadcast. Null labels are left out; a
    document labelled both ways counts as toxic."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    count = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    if not count.get(1) or not count.get(0):
        return None
    u = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("_toxic") == 1, min(1.0, toxic_rows / count[1])).otherwise(min(1.0, ordinary_rows / count[0]))
    drawn = known.where(u < share)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = written(rows.select(F.when(F.col("_toxic") == 1, 1).otherwise(0).alias("_toxic"), F.md5("text").alias("key"), "text"), "toxicity")
    return fit(rows, count[1] / (count[0] + count[1]))


def score(docs: DataFrame, model: Model | None, name: str = "toxicity") -> DataFrame:
    """All rows and columns of ``docs`` and a double column ``name`` from 0 to 1, replacing any of that name. A null
    text counts as empty; without a model (a class had no labelled row) every score is 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c.lower() != name.lower()]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])

    def run(batches):
        m = shared.value
        for b in batches:
            buf, offs = W.text_buffer(b.column(b.schema.get_field_index("text")))
            raw = memoryview(buf)
            out = [m.score(bytes(raw[x:y])) if m else 0.0 for x, y in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, name])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
