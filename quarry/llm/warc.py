"""WARC archives written from and read back as tables of chunks.

A payload never needs to be in memory whole. It is a run of rows (record, chunk number, bytes), each of at
most CHUNK bytes, and each row carries the SHA-1 and the count of all bytes up to its end, so the
last row of a record holds the digest of the payload. The writer streams such rows, sorted, into archive
files; the reader streams archive files into such rows again.

On Spark: digests come with the chunks in one pass over the pages. Which record is the response of
equal payloads follows from narrow rows: (digest, length) -> smallest id, combined before the shuffle; payloads that many
pages share are joined by broadcast (at most HOT of them can be that frequent), the others by shuffle. Chunk
rows are exchanged once by record number, so pages of one host or payload do not land together, and each
task writes one archive under a name of its own by rename, so a task that runs again replaces its file. A
written manifest lists the archives; one task reads one archive, in chunks.

The archive folder lies under the shared folder of ``spark.checkpoint.dir``, which executors open as a file system.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import stage_path

from . import graph as G
from . import words as W

CHUNK = 256 << 10
BATCH = 4 << 20  # bytes of chunks handed on at one time
FILE_BYTES = 32 << 20  # of payload in one archive, about
HOT = 256  # keys with more than 1/HOT of all rows, so fewer than HOT of them
VERSION = b"WARC/1.0"
DATE = "2000-01-01T00:00:00Z"  # written when no other is given, so that archives are reproducible
PROFILE = "http://netpreservefoundation.org/warc/1.0/revisit/identical-payload-digest"
PAGE = "X-Page-ID"  # header of our own: the id of the page
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the registered name space of URLs

CHUNKS = "record long, chunk long, data binary, n_bytes long, digest string, last boolean"
READ = "archive string, record_id string, record_type string, page_id long, refers_id string, chunk long, data binary, n_bytes long, digest string, last boolean"


def base32_sha1(h) -> str:
    return base64.b32encode(h.digest()).decode()


# ---------------------------------------------------------------- pages to chunks
def _cut(batches):
    """Rows (record, url, page_id, text) as chunk rows; the last of a record has its url and page_id."""
    for b in batches:
        record, page, url = (W.column(b, c) for c in ("record", "page_id", "url"))
        buf, offs = W.text_buffer(W.column(b, "html"))
        rows, held = [], 0
        for i in range(b.num_rows):
            lo, hi, sha, k = int(offs[i]), int(offs[i + 1]), hashlib.sha1(), 0
            while True:
                at = lo + k * CHUNK
                data = buf[at:min(at + CHUNK, hi)].tobytes()
                sha.update(data)
                last = at + CHUNK >= hi
                rows.append((record[i].as_py(), k, data, at + len(data) - lo, base32_sha1(sha), last,
                             page[i].as_py() if last else None, url[i].as_py() if last else None))
                held += len(data) + 200
                if held >= BATCH:
                    yield _rows(rows)
                    rows, held = [], 0
                if last:
                    break
                k += 1
        if rows:
            yield _rows(rows)


def _rows(rows) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                      names=["record", "chunk", "data", "n_bytes", "digest", "last", "page_id", "url"])


def chunk_table(pages: DataFrame) -> DataFrame:
    """CHUNKS rows, page_id and url of ``pages`` (page_id, url, html): one row or more a page, numbered from 0."""
    numbered = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"),
                            F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return numbered.mapInArrow(_cut, CHUNKS + ", page_id long, url string")


# ---------------------------------------------------------------- responses and revisits
def lookup(rows: DataFrame, table: DataFrame, keys: list[str], per_key: DataFrame) -> DataFrame:
    """``rows`` left-joined to ``table`` on ``keys`` (unique there). ``per_key`` (keys, n) counts rows of a key; the few keys of more
    than 1/HOT of all rows are joined by broadcast, so no task gets the rows of a hot key."""
    total = per_key.agg(F.sum("n")).first()[0] or 0
    frequent = F.broadcast(per_key.where(F.col("n") * HOT > total).select(*keys))
    few = F.broadcast(table.join(frequent, keys, "left_semi"))
    hot = rows.join(frequent, keys, "left_semi").join(few, keys, "left")
    rest = rows.join(frequent, keys, "left_anti").join(table, keys, "left")
    return hot.unionByName(rest)


def referred(ends: DataFrame, least: int = 0) -> DataFrame:
    """``ends`` (record, page_id, n_bytes, digest, ...) with ``first`` and ``first_page``: among rows of
    equal payloads of at least ``least`` bytes, the record of the smallest page_id (no id: last; ties: smallest record). Null for that
    row itself and for smaller payloads."""
    big = ends.where(F.col("n_bytes") >= least)
    order = F.struct(F.col("page_id").isNull().alias("z"), F.col("page_id").alias("p"), F.col("record").alias("r"))
    groups = G.written(big.groupBy("digest", "n_bytes").agg(F.min(order).alias("m"), F.count("*").alias("n")).select(
        "digest", "n_bytes", "n", F.col("m.r").alias("first"), F.col("m.p").alias("first_page")), "payloads")
    out = lookup(big, groups.where("n > 1").drop("n"), ["digest", "n_bytes"], groups)
    own = F.col("first") == F.col("record")
    out = out.withColumn("first_page", F.when(~own, F.col("first_page"))).withColumn("first", F.when(~own, F.col("first")))
    small = ends.where(~(F.col("n_bytes") >= least))
    return out.unionByName(small, allowMissingColumns=True)


# ---------------------------------------------------------------- writing
def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder or file name, and the name in it."""
    if urlparse(path).scheme in ("", "file"):
        return pa.fs.LocalFileSystem(), unquote(urlparse(path).path) if "://" in path or path.startswith("file:") else path
    return pa.fs.FileSystem.from_uri(path)


def record_id(run: str, record: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{run}/{record}')}>"


def _safe(value: str) -> str:
    """A header value in one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def _head(run: str, date: str, r: dict) -> bytes:
    """The header block of a record, and for a response the HTTP header before its payload."""
    revisit = r["first"] is not None
    http = b"" if revisit else (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % r["n_bytes"])
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(run, r["record"])), ("WARC-Date", date)]
    if r["url"] is not None:
        fields.append(("WARC-Target-URI", _safe(r["url"])))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(run, r["first"]))]
    else:
        fields.append(("Content-Type", "application/http; msgtype=response"))
    fields.append(("WARC-Payload-Digest", "sha1:" + r["digest"]))
    if r["page_id"] is not None:
        fields.append((PAGE, str(r["page_id"])))
    fields.append(("Content-Length", str(0 if revisit else len(http) + r["n_bytes"])))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + http


def _write(folder: str, run: str, date: str):
    """Sorted rows of one partition into one archive, each record a gzip member; yields the manifest row."""
    def write(batches):
        fs, path = file_system(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.warc.gz"
        made = f"{path}/_{name}.{context.taskAttemptId()}"
        out, records, n_bytes, zipped, head, left = None, 0, 0, None, None, 0
        try:
            for b in batches:
                for r in b.to_pylist():
                    if out is None:
                        out = fs.open_output_stream(made)
                    if r["chunk"] < 0:
                        head, left = r, 0 if r["first"] is not None else r["n_bytes"]
                        zipped = zlib.compressobj(4, zlib.DEFLATED, 31)
                        out.write(zipped.compress(_head(run, date, r)))
                    elif head["first"] is None:
                        out.write(zipped.compress(r["data"]))
                        left -= len(r["data"])
                    if r["last"]:
                        if left:
                            raise ValueError(f"record {r['record']} lacks {left} bytes")
                        out.write(zipped.compress(b"\r\n\r\n") + zipped.flush())
                        records, n_bytes = records + 1, n_bytes + head["n_bytes"]
        finally:
            if out is not None:
                out.close()
        if out is not None:
            fs.move(made, f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [records], "n_bytes": [n_bytes]})
    return write


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a WARC record per row of ``pages`` (page_id, url, html) into new archives in ``folder``; returns the written
    manifest (archive, records, n_bytes).

    The payload is the html in UTF-8 (null: empty) behind an HTTP header. Of records with equal payloads of at least
    ``least`` bytes the one with the smallest page_id is a response, the others are revisits that refer to it; all
    others are responses. A null url or page_id has no header line; a null page_id orders last. Rows of equal page_id
    are records of their own. Other columns are not read.
    """
    chunks = G.written(chunk_table(pages), "chunks", "zstd")  # payloads: the size on disk is theirs
    ends = chunks.where("last").select("record", "page_id", "url", "n_bytes", "digest")
    heads = referred(ends, least).select("record", F.lit(-1).cast("long").alias("chunk"), "page_id", "url", "n_bytes", "digest", "first",
                                         F.lit(False).alias("last"), F.lit(None).cast("binary").alias("data"))
    total = ends.agg(F.sum("n_bytes")).first()[0] or 0
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    rows = heads.unionByName(chunks.select("record", "chunk", "data", "last"), allowMissingColumns=True)
    rows = rows.repartition(int(-(-total // file_bytes)) + 1, "record").sortWithinPartitions("record", "chunk")
    return G.written(rows.mapInArrow(_write(folder, uuid.uuid4().hex, date), "archive string, records long, n_bytes long"), "manifest")


# ---------------------------------------------------------------- reading
class Source:
    """Bytes of an archive, gzip members one after another or plain, read by parts."""

    def __init__(self, stream):
        self.stream, self.held, self.raw, self.zip = stream, bytearray(), b"", None
        self.raw = stream.read(BATCH)
        self.gzip = self.raw[:2] == b"\x1f\x8b"

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(BATCH)
            if not self.raw:
                if self.zip is not None:
                    raise ValueError("archive ends inside a gzip member")
                return False
        if not self.gzip:
            self.held += self.raw
            self.raw = b""
            return True
        if self.zip is None:
            self.zip = zlib.decompressobj(31)
        self.held += self.zip.decompress(self.raw, BATCH)  # a part at a time, however well it is packed
        self.raw = self.zip.unconsumed_tail
        if self.zip.eof:
            self.raw, self.zip = self.zip.unused_data, None
        return True

    def line(self) -> bytes | None:
        """One line without its end; None at the end of the archive."""
        at = 0
        while (end := self.held.find(b"\n", at)) < 0:
            at = len(self.held)
            if not self._more():
                if self.held:
                    raise ValueError("archive ends inside a line")
                return None
        out = bytes(self.held[:end])
        del self.held[:end + 1]
        return out.rstrip(b"\r")

    def some(self, n: int) -> bytes:
        """n bytes, at most CHUNK."""
        n = min(n, CHUNK)
        while len(self.held) < n:
            if not self._more():
                raise ValueError("archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(source: Source) -> dict[str, str]:
    """Header lines up to the empty one, names in lower case."""
    out: dict[str, str] = {}
    while line := source.line():
        key, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        out[key.strip().lower()] = value.strip()
    return out


def records(source: Source) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """(header, payload parts) of each record; the parts must be taken before the next record."""
    while True:
        line = source.line()
        while line == b"":
            line = source.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head = _fields(source)
        left = int(head["content-length"])

        def parts(left=left, head=head):
            if head.get("content-type", "").startswith("application/http") and left:
                http = source.line()
                left -= len(http) + 2
                while http:
                    http = source.line()
                    left -= len(http) + 2
            while left > 0:
                data = source.some(left)
                left -= len(data)
                yield data

        yield head, parts()


def _read(with_data: bool):
    def run(batches):
        for b in batches:
            for archive in W.column(b, "archive").to_pylist():
                fs, path = file_system(archive)
                with fs.open_input_stream(path) as stream:
                    rows, held = [], 0
                    for head, parts in records(Source(stream)):
                        sha, n, k, page = hashlib.sha1(), 0, 0, head.get(PAGE.lower())
                        fixed = (archive, head.get("warc-record-id"), head.get("warc-type"), int(page) if page else None, head.get("warc-refers-to"))
                        now = next(parts, b"")
                        while True:
                            sha.update(now)
                            n += len(now)
                            after = next(parts, None)
                            if with_data or after is None:
                                rows.append((*fixed, k, now if with_data else None, n, base32_sha1(sha), after is None))
                                held += len(now) * with_data + 300
                            if held >= BATCH:
                                yield _found(rows)
                                rows, held = [], 0
                            if after is None:
                                break
                            now, k = after, k + 1
                        told = head.get("warc-payload-digest")
                        if head.get("warc-type") != "revisit" and told is not None and told != "sha1:" + base32_sha1(sha):
                            raise ValueError(f"{archive}: payload of {fixed[1]} has not the digest {told}")
                    if rows:
                        yield _found(rows)
    return run


def _found(rows) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                      names=[c.split()[0] for c in READ.split(", ")])


def read_chunks(archives: DataFrame, with_data: bool = True) -> DataFrame:
    """READ rows of the ``archives`` (archive: a path): the payload of each record in chunks, with the digest and count of the bytes so
    far. Without data, only the last row of each record. Archives may be plain or gzip. A damaged archive raises
    ValueError: a payload that is not of its digest, an archive that ends inside a record."""
    files = archives.select("archive")
    n = files.count()
    return files.repartition(max(1, n)).mapInArrow(_read(with_data), READ)


def read_records(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id) of each record. A revisit has the bytes and digest of the
    response it refers to, and that one's page_id in refers_to; ValueError where there is none."""
    all_ = G.written(read_chunks(archives, with_data=False).drop("data", "chunk", "last"), "records")
    out = ["page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type"]
    plain = all_.where(~F.col("record_type").eqNullSafe("revisit")).select(*out, F.lit(None).cast("long").alias("refers_to"), "record_id")
    again = all_.where(F.col("record_type") == "revisit").select("page_id", "record_id", "record_type", "refers_id")
    told = all_.where(F.col("record_type") == "response").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "n_bytes", "digest")
    per = again.groupBy("refers_id").agg(F.count("*").alias("n"))
    again = lookup(again, told, ["refers_id"], per)
    lost = F.raise_error(F.concat(F.lit("no response "), F.coalesce("refers_id", F.lit("")))).cast("long")
    again = again.withColumn("n_bytes", F.when(F.col("n_bytes").isNotNull(), F.col("n_bytes")).otherwise(lost))
    return plain.unionByName(again.select(*out, "refers_to", "record_id"))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """The records (see :func:`read_records`) of archives written from ``pages`` into a new folder and read back."""
    folder = os.path.join(stage_path(pages.sparkSession, f"warc-{uuid.uuid4().hex}"))
    return read_records(write_archives(pages, folder, least))
