"""Sum-of-squares online packing of tokenised documents into training sequences.

Each document's full windows become sequences of their own, and its tail is placed, in doc_id
order, into an open sequence: the one whose filling leaves the least sum of squares of the
numbers of open sequences at each fill level (an array over levels; ties: the fuller
level; a new sequence is one of the choices). What is open at the end is topped up
with pieces cut from the emptiest open ones, and the last few tokens go into sequences
of a power of two, so nothing is padded.

On Spark: map tasks tokenise and keep only checksums of full windows; the tails (under one
sequence each) are shuffled once, to shards chosen by a hash of doc_id. Each shard packs
its own tails, so packing runs in parallel and the level array stays one per shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K

LENGTH = 4096
END = 2
SHARD_BYTES = 32 << 20


class Levels:
    """Open sequences by fill level, and the sum-of-squares choice."""

    def __init__(self, length: int):
        self.length = length
        self.count = np.zeros(length + 1, np.int64)  # the last entry stays 0: full ones do not count
        self.open: list[list[list]] = [[] for _ in range(length)]

    def place(self, size: int, item) -> list | None:
        """Put an item of under ``length`` tokens; returns the sequence if that fills it."""
        c, top = self.count, self.length - size
        here, there = c[1:top + 1], c[1 + size:]
        change = np.where(here > 0, 2 * (there - here) + 2, np.iinfo(np.int64).max)
        change[top - 1] -= (1 if here[top - 1] > 0 else 0)  # a filled one leaves the levels
        best = top - 1 - int(np.argmin(change[::-1])) if top else -1
        if best < 0 or change[best] > 2 * c[size] + 1:
            c[size] += 1
            self.open[size].append([item])
            return None
        level = best + 1
        seq = self.open[level].pop()
        c[level] -= 1
        seq.append(item)
        if level + size == self.length:
            return seq
        c[level + size] += 1
        self.open[level + size].append(seq)
        return None

    def rest(self) -> list[list]:
        """What is open, the fullest first."""
        return [seq for level in reversed(self.open) for seq in level]


def close(left: list[list], length: int) -> list[list]:
    """Sequences of items (key, start, size) cut from open ones: full ones and, at the end, powers of two."""
    done, lo, hi = [], 0, len(left) - 1
    spare: list = []
    while lo <= hi:
        seq, lo = list(left[lo]), lo + 1
        room = length - sum(x[2] for x in seq)
        while room and (spare or lo <= hi):
            if not spare:
                spare, hi = list(left[hi]), hi - 1
            key, start, size = spare.pop()
            take = min(size, room)
            seq.append((key, start, take))
            if take < size:
                spare.append((key, start + take, size - take))
            room -= take
        if room == 0:
            done.append(seq)
        else:
            spare = seq
            break
    spare = spare[::-1]
    while spare:
        total = sum(x[2] for x in spare)
        room = length if total >= length else 1 << (total.bit_length() - 1)
        seq = []
        while room:
            key, start, size = spare.pop()
            take = min(size, room)
            seq.append((key, start, take))
            if take < size:
                spare.append((key, start + take, size - take))
            room -= take
        done.append(seq)
    return done


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END,
         shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    ``tokenizer`` is the path of a tokenizer file. A null or empty text is the end id alone.
    Rows of equal doc_id are documents of their own; a null doc_id is kept. Other columns are
    not read. An empty table gives no pieces.
    """
    total = docs.agg(F.sum(F.octet_length("text") + 8).alias("b")).first()["b"] or 0
    shards = max(1, -(-total // shard_bytes))

    def tokenise(batches):
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("text"))
            for i, texts in K.encode_column(tokenizer, col):
                wide = [np.append(x, x.dtype.type(end_id)) for x in texts]
                full = [len(x) // length for x in wide]
                yield pa.RecordBatch.from_pydict({
                    "shard": batch.column(batch.schema.get_field_index("shard")).slice(i, len(wide)),
                    "doc_id": batch.column(batch.schema.get_field_index("doc_id")).slice(i, len(wide)),
                    "tokens": pa.array([len(x) for x in wide], pa.int64()),
                    "sums": pa.array([[_crc(x[k * length:(k + 1) * length]) for k in range(n)] for x, n in zip(wide, full, strict=True)], pa.list_(pa.int64())),
                    "tail": pa.array([x[n * length:].astype("<u4" if x.dtype.itemsize > 2 else "<u2").tobytes() for x, n in zip(wide, full, strict=True)], pa.binary()),
                    "width": pa.array([x.dtype.itemsize for x in wide], pa.int32())})

    def shard(key, t):
        ids = t.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, t_tokens[i])) if (t_tokens := t.column("tokens").to_pylist()) else []
        sums, tails, width = t.column("sums").to_pylist(), t.column("tail").to_pylist(), t.column("width").to_pylist()
        out: list[tuple] = []
        base, seqs = key[0].as_py() << 36, 0
        levels, done = Levels(length), []
        for i in order:
            for k, crc in enumerate(sums[i]):
                out.append((ids[i], k * length, length, crc, t_tokens[i], base + seqs, 0))
                seqs += 1
            size = len(tails[i]) // width[i]
            if size:
                full = levels.place(size, (i, t_tokens[i] - size, size))
                if full:
                    done.append(full)
        for seq in [*done, *close(levels.rest(), length)]:
            offset = 0
            for i, start, size in seq:
                tail = np.frombuffer(tails[i], "<u2" if width[i] == 2 else "<u4")
                skip = start - (t_tokens[i] - len(tail))
                out.append((ids[i], start, size, _crc(tail[skip:skip + size]), t_tokens[i], base + seqs, offset))
                offset += size
            seqs += 1
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        return pa.table({n: pa.array([r[k] for r in out], pa.int64()) for k, n in enumerate(names)})

    tails = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(shards)).cast("int").alias("shard"),
                        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tails = tails.mapInArrow(tokenise, "shard int, doc_id long, tokens long, sums array<long>, tail binary, width int")
    return tails.groupBy("shard").applyInArrow(
        shard, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
