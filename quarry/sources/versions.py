"""Tables that are rewritten beside their old version (S5, S8): a job never writes the files it reads.

A table is a folder of versions (Parquet) and of pointers. A rewrite reads the newest version, writes a new one and
only then its pointer, whose folder is named by the version number and may not exist yet: of two
rewrites of one version the later fails and leaves the table as it is. Readers follow the highest
pointer; versions that no pointer of the last ``keep`` names are removed on request, when their readers are done.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "version long, path string"


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def pointers(self) -> list:
        """(version, path), newest first."""
        try:
            rows = self.spark.read.schema(POINTER).json(f"{self.folder}/pointers/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return rows.orderBy(F.desc("version")).collect()  # a row a version

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """A new version; returns its number. ``after``: the version that ``df`` was read from."""
        known = self.pointers()
        version = (known[0]["version"] if known else 0) + 1 if after is None else after + 1
        path = f"{self.folder}/versions/{uuid.uuid4().hex}"
        df.write.parquet(path)
        row = self.spark.createDataFrame([(version, path)], POINTER)
        row.coalesce(1).write.mode("error").json(f"{self.folder}/pointers/{version}")
        return version

    def read(self) -> DataFrame:
        known = self.pointers()
        if not known:
            raise FileNotFoundError(self.folder)
        return self.spark.read.parquet(known[0]["path"])

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> int:
        known = self.pointers()
        if not known:
            raise FileNotFoundError(self.folder)
        return self.write(change(self.spark.read.parquet(known[0]["path"])), after=known[0]["version"])

    def remove_old(self, keep: int = 1) -> int:
        """Removes versions that none of the ``keep`` newest pointers names; returns how many."""
        url = urlparse(self.folder)
        fs, base = (pafs.LocalFileSystem(), unquote(url.path) if url.scheme else self.folder) if url.scheme in ("", "file") else pafs.FileSystem.from_uri(self.folder)
        kept = {p["path"].rsplit("/", 1)[1] for p in self.pointers()[:keep]}
        old = [f for f in fs.get_file_info(pafs.FileSelector(base + "/versions")) if f.base_name not in kept]
        for f in old:
            fs.delete_dir(f.path)
        return len(old)
