"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built, from a bounded sample of
labelled rows: whole texts, but for one that alone is longer than the automaton. Every letter of the sample is a symbol. A text is parsed by each automaton into phrases, each the longest match from
where the last one ended; the language whose parse has the least cost, phrases times
log2 of the automaton's text length (Ziv-Merhav), wins. Texts are lower-cased, runs of other
characters than letters become one blank, and parsing restarts every SEGMENT characters
so that all segments of a batch step through the automata together in numpy.

On Spark: one aggregate and one filtered scan gather the sample; the automata (bounded by the
sample) go to the tasks as a broadcast; predicting is a map over the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

SAMPLE_CHARS = 120_000  # characters of labelled rows drawn for a language, about
LANG_CHARS = 40_000  # characters in a language's automaton, and of one text in the sample
DENSE = 250  # symbols with a column in the table of steps; rarer letters are looked up
SEGMENT = 256
SHARPNESS = 0.15  # of the score: weight of a bit of cost
UNDETERMINED = "und"
_PAD, _BLANK, _OTHER, _FIRST = 0, 1, 2, 3


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


def step_table(nxt: list[dict[int, int]], symbols: int, base: int) -> np.ndarray:
    """Rows of ``4 * next state + phrases that end here``, states numbered from ``base``, for the first ``symbols``. A symbol
    without a transition ends the phrase and starts one; where the language lacks it, it is one."""
    root = np.full(symbols, 4 * base + 2, np.int64)
    for c, s in nxt[0].items():
        if c < symbols:
            root[c] = 4 * (base + s) + 1
    table = np.tile(root, (len(nxt), 1))
    for s, row in enumerate(nxt):
        for c, to in row.items():
            if c < symbols:
                table[s, c] = 4 * (base + to)
    table[0] = np.where(root & 3 == 2, root - 1, table[0])
    table[:, _PAD] = 4 * (base + np.arange(len(nxt)))
    return table.astype(np.int32)


class Model:
    """Languages, the automata in one table, and the symbol of each code point."""

    def __init__(self, texts: dict[str, str], lang_chars: int = LANG_CHARS):
        self.langs = sorted(texts)
        chars: dict[str, int] = {}
        for t in texts.values():
            for c in t:
                chars[c] = chars.get(c, 0) + 1
        letters = sorted((c for c in chars if c.isalpha()), key=lambda c: (-chars[c], c))
        letters = list(dict.fromkeys(c.lower() for c in letters if len(c.lower()) == 1))
        self.symbol = symbol_table(letters)
        self.symbols = _FIRST + len(letters)
        tables, self.root, self.bits = [], [], []
        width = min(DENSE, self.symbols)
        rare: list[tuple[int, int]] = []
        self.rare_root = np.zeros((len(self.langs), self.symbols - width), np.int64)
        base = 0
        for lang in self.langs:
            codes = normal(self.symbol, texts[lang])[:lang_chars]
            nxt = suffix_automaton(codes.tolist())
            t = step_table(nxt, width, base)
            rare += [((base + s) * self.symbols + c, 4 * (base + to)) for s, row in enumerate(nxt) for c, to in row.items() if c >= width]
            self.rare_root[len(self.root)] = [4 * (base + nxt[0][c]) + 1 if c in nxt[0] else 4 * base + 2 for c in range(width, self.symbols)]
            self.root.append(base)
            self.bits.append(float(np.log2(len(codes) + 2)))
            base += len(t)
            tables.append(t)
        self.table = np.concatenate(tables) if tables else np.zeros((0, _FIRST), np.int32)
        self.rare = np.array(sorted(rare), np.int64).reshape(-1, 2)

    def rare_steps(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """What ``step_table`` would hold at ``state`` (a column a language) for symbols that have no column there."""
        key = state.astype(np.int64) * self.symbols + symbol[:, None]
        at = np.searchsorted(self.rare[:, 0], key)
        at = np.minimum(at, max(0, len(self.rare) - 1))
        again = self.rare_root[:, symbol - self.table.shape[1]].T
        again = again - ((again & 3 == 2) & (state == np.array(self.root)))
        return np.where(self.rare[at, 0] == key, self.rare[at, 1], again) if len(self.rare) else again

    def costs(self, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Cost in bits, one row per text (codes[edges[i]:edges[i+1]]) and one column per language."""
        size = np.diff(edges)
        parts = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(size)), parts)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = edges[:-1][doc] + k * SEGMENT
        n = np.minimum(SEGMENT, edges[1:][doc] - at)
        order = np.argsort(-n, kind="stable")
        at, n, doc = at[order], n[order], doc[order]
        padded = np.concatenate([codes, np.zeros(SEGMENT, codes.dtype)])
        width, flat = self.table.shape[1], self.table.reshape(-1)
        roots = np.array(self.root, np.int32)
        state = np.tile(roots, (len(at), 1))
        count = np.zeros((len(at), len(roots)), np.int32)
        wide = len(codes) > 0 and int(codes.max()) >= width
        live = np.searchsorted(-n, -np.arange(SEGMENT), side="left")  # segments longer than each step
        for step in range(SEGMENT):
            m = int(live[step])
            if m == 0:
                break
            sym = padded[at[:m] + step].astype(np.int32)
            if wide:
                odd = np.flatnonzero(sym >= width)
                v = flat[state[:m] * width + np.where(sym < width, sym, _OTHER)[:, None]]
                v[odd] = self.rare_steps(state[odd], sym[odd])
            else:
                v = flat[state[:m] * width + sym[:, None]]
            count[:m] += v & 3
            state[:m] = v >> 2
        count += state != roots
        out = np.zeros((len(size), len(roots)))
        np.add.at(out, doc, count)
        return out * np.array(self.bits)


def symbol_table(letters: list[str]) -> np.ndarray:
    """The symbol of each code point: letters by their lower case, known ones apart."""
    table = np.full(0x110000, _BLANK, np.min_scalar_type(_FIRST + len(letters)))
    known = {c: _FIRST + i for i, c in enumerate(letters)}
    for cp in range(len(table)):
        c = chr(cp)
        if c.isalpha():
            table[cp] = known.get(c.lower()[:1], _OTHER)
    return table


def normal(symbol: np.ndarray, text: str) -> np.ndarray:
    codes = symbol[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    return codes[_single(codes)]


def _single(codes: np.ndarray) -> np.ndarray:
    """All but blanks after a blank."""
    keep = codes != _BLANK
    keep[1:] |= codes[:-1] != _BLANK
    return keep


def train(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS, lang_chars: int = LANG_CHARS) -> Model:
    """A model from rows (text, lang) with both. Texts are drawn by their hash, about ``sample_chars`` characters a
    language (copies are drawn together, and come once). A language's automaton takes, in the order of their hashes, the whole
    texts that fit into ``lang_chars`` characters; of a text longer than that, a stretch of that length."""
    known = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    chars = F.least(F.length("text"), F.lit(lang_chars))
    total = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum(chars).alias("n")).collect()}
    if not any(total.values()):
        return Model({})
    part = F.create_map(*[x for k, n in total.items() for x in (F.lit(k), F.lit(min(1.0, sample_chars / max(1, n))))])
    u = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    at = F.pmod(F.xxhash64("text", F.lit(8)), F.greatest(F.length("text") - lang_chars, F.lit(0)) + 1).cast("int") + 1
    drawn = known.where(u < part[F.col("lang")]).select("lang", F.substr("text", at, F.lit(lang_chars)).alias("t"), F.xxhash64("text").alias("h")).distinct()
    texts: dict[str, list] = {}
    for r in drawn.collect():
        texts.setdefault(r["lang"], []).append((r["h"], r["t"]))
    joined = {k: " ".join(_fitting([t for _, t in sorted(v)], lang_chars)) for k, v in texts.items()}
    return Model({k: v for k, v in joined.items() if any(c.isalpha() for c in v)}, lang_chars)


def _fitting(texts: list[str], chars: int) -> list[str]:
    """The texts, in their order, that still fit; of them all, the blanks between included."""
    out, left = [], chars
    for t in texts:
        if len(t) + bool(out) <= left:
            left -= len(t) + bool(out)
            out.append(t)
    return out


def predict_batch(model: Model, col) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, phrases' bits a character) of each text of an Arrow column."""
    buf, offs = W.text_buffer(col)
    langs, scores, rates = [], [], []
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + (2 << 20), side="right")) - 1))
        part, cut = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        lead = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[cut]
        raw = model.symbol[np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)]
        keep = _single(raw)
        keep[lead[:-1][np.diff(lead) > 0]] = True
        edges = np.concatenate([[0], np.cumsum(keep)])[lead]
        spoken = np.concatenate([[0], np.cumsum(raw >= _OTHER)])[lead]
        spoken = np.diff(spoken) > 0
        cost = model.costs(raw[keep], edges)
        if cost.shape[1]:
            best = cost.argmin(axis=1)
            least = cost[np.arange(len(best)), best]
            weight = np.exp(-SHARPNESS * (cost - least[:, None])).sum(axis=1)
            langs += [model.langs[b] if s else UNDETERMINED for b, s in zip(best, spoken, strict=True)]
            scores.append(np.where(spoken, 1 / weight, 0.0))
            rates.append(np.where(spoken, least / np.maximum(1, np.diff(edges)), 0.0))
        else:
            langs += [UNDETERMINED] * (j - i)
            scores.append(np.zeros(j - i))
            rates.append(np.zeros(j - i))
        i = j
    return langs, np.concatenate(scores or [np.zeros(0)]), np.concatenate(rates or [np.zeros(0)])


def identify(docs: DataFrame, model: Model, name: str = "language") -> DataFrame:
    """All rows and columns of ``docs`` and a struct column ``name``: lang_pred, score (0 to 1), bits
    (the winning parse's cost a character). A null text or one without a letter, and any text when
    the model has no language, is ``und`` with score 0; ties go to the first language by name.
    A column of docs with that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c.lower() != name.lower()]
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, kind)])

    def run(batches):
        for b in batches:
            langs, scores, rates = predict_batch(shared.value, b.column(b.schema.get_field_index("text")))
            s = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores), pa.array(rates)], ["lang_pred", "score", "bits"])
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, name])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
