"""WARC archives: exact round trips, revisits, oversized payloads in chunks, damaged and foreign archives."""

import base64
import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from quarry.llm import warc

PAGES = "page_id long, url string, html string, record long, digest string, first string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page(i, html, url="http://a/"):
    return (i, url, html, 1, "x", "y")


BIG = "<p>é€\U0001f600 \r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\n</p>" * 3000


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by the smallest page_id of equal payloads."""
    known = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    first = {}
    for at, (i, data) in enumerate(known):
        if len(data) >= least:
            first[data] = min(first.get(data, (True, 1, 0)), (i is None, i or 0, at))
    out = []
    for at, (i, data) in enumerate(known):
        again = len(data) >= least and first[data][2] != at
        of = first.get(data)
        out.append((i, len(data), digest(data), "revisit" if again else "response", None if not again or of[0] else of[1]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "CHUNK", 1000)
    rows = [page(i, f"page {i % 7}" * (i % 7)) for i in range(60, 20, -1)]
    rows += [page(1, BIG), page(2, BIG), page(3, None), page(4, ""), page(5, "x" * 1000), page(6, "y" * 1001), page(7, "z", None),
             page(8, "u", "http://b/\r\nWARC-Type: x é"), page(None, "w"), page(None, "only"), page(None, "only"), page(9, "w"), page(9, "w"), page(70, "page 3" * 3)]
    out = warc.round_trip(spark.createDataFrame(rows, PAGES), least)
    assert got(out) == expected(rows, least)


def test_hot_payload(spark):
    rows = [page(i, "same" if i % 3 else f"own {i}") for i in range(2000)]
    out = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(7))
    assert got(out) == expected(rows)


def test_chunks_hold_the_payload(spark, tmp_path, monkeypatch):
    rows = [page(1, BIG), page(2, "short"), page(3, ""), page(4, BIG + "x")]
    made = warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "a b"), file_bytes=100_000)
    assert made.agg(F.sum("records"), F.sum("n_bytes")).first()[:] == (4, 2 * len(BIG.encode()) + 1 + 5)
    assert made.count() > 1 and not [f for f in os.listdir(tmp_path / "a b") if f.startswith("_")]
    chunks = warc.read_chunks(made)
    for i, _, html, *_ in rows:
        mine = chunks.where(F.col("page_id") == i).orderBy("chunk").collect()
        data, want = b"", html.encode()
        for k, r in enumerate(mine):
            data += r.data
            assert (r.chunk, r.n_bytes, r.digest, r.last) == (k, len(data), digest(data), k == len(mine) - 1)
            assert len(r.data) <= warc.CHUNK
        assert data == want


def test_one_chunk_in_memory():
    """A payload far above the bytes held: parts come one by one."""
    size = 300 << 20

    class Zeros(io.RawIOBase):
        def __init__(self):
            self.head, self.left = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % size, size + 4

        def read(self, n):
            if self.head:
                out, self.head = self.head, b""
                return out
            if not self.left:
                return b""
            n = min(n, self.left)
            self.left -= n
            return (b"\0" * n) if self.left else b"\0" * (n - 4) + b"\r\n\r\n"

    source = warc.Source(Zeros())
    total, most = 0, 0
    for _, parts in warc.records(source):
        for data in parts:
            total += len(data)
            most = max(most, len(source.held) + len(source.raw))
    assert total == size and most <= 3 * warc.BATCH


def test_foreign_archive(spark, tmp_path):
    body = b"GET"
    text = (b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <a>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
            b"WARC/1.1\r\nwarc-type: request\r\nWARC-Record-ID: <b>\r\nContent-Type: application/http;msgtype=request\r\nContent-Length: 19\r\n\r\nGET / HTTP/1.1\r\n\r\n"
            + body[:1] + b"\r\n\r\n")
    plain, packed = tmp_path / "p.warc", tmp_path / "p.warc.gz"
    plain.write_bytes(text)
    packed.write_bytes(gzip.compress(text[:75]) + gzip.compress(text[75:]))
    files = spark.createDataFrame([(str(plain),), (str(packed),)], "archive string")
    rows = warc.read_chunks(files).collect()
    assert sorted((r.record_id, r.record_type, bytes(r.data)) for r in rows) == [("<a>", "warcinfo", b"")] * 2 + [("<b>", "request", b"G")] * 2


def test_damaged_archives(spark, tmp_path):
    made = warc.write_archives(spark.createDataFrame([page(1, "some payload " * 50), page(2, "more")], PAGES), str(tmp_path / "w"))
    whole = gzip.decompress(open(made.first()["archive"], "rb").read())
    for name, data in {"cut": whole[:-60], "changed": whole.replace(b"some payload", b"some_payload", 1), "lost": b"\r\nx" + whole}.items():
        path = tmp_path / f"{name}.warc"
        path.write_bytes(data)
        with pytest.raises(Exception, match="ends inside|has not the digest|no record starts"):
            warc.read_records(spark.createDataFrame([(str(path),)], "archive string")).collect()
    pair = warc.write_archives(spark.createDataFrame([page(1, "a"), page(2, "a")], PAGES), str(tmp_path / "r"))
    text = b"".join(gzip.decompress(open(r["archive"], "rb").read()) for r in pair.collect())
    alone = tmp_path / "alone.warc"
    alone.write_bytes(b"".join(b"WARC/1.0" + part for part in text.split(b"WARC/1.0") if b"WARC-Type: revisit" in part))
    with pytest.raises(Exception, match="no response"):
        warc.read_records(spark.createDataFrame([(str(alone),)], "archive string")).collect()
