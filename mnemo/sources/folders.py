"""A source of files whose partitions are folders: excluded folders are pruned by name before anything below them is listed."""

from __future__ import annotations

import fnmatch
import hashlib
import os
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mnemo.functions.expressions import domain_of

SCHEMA = "path string, folder string, name string, length long, status string, content_hash string, content binary"
MAX_BYTES, BATCH_BYTES = 100 << 20, 16 << 20


class Folder(InputPartition):
    def __init__(self, path: str):
        self.path = path


def kept_folders(root: str, excluded: set[str]) -> tuple[list[str], list[str]]:
    """(folders to list, folders that cannot be read) below ``root``; one whose upper-case name is excluded is not entered."""
    found, failed = [], []

    def walk(folder: str) -> None:
        try:
            with os.scandir(folder) as entries:
                below = sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and e.name.upper() not in excluded)
        except OSError:
            failed.append(folder)
            return
        found.append(folder)
        for path in below:
            walk(path)

    walk(root)
    return found, failed


class FolderReader(DataSourceReader):
    """Folders are listed once on the driver, names only; files are listed and read in the tasks of their folders."""

    def __init__(self, options: dict):
        self.root = unquote(urlparse(options["path"]).path) if options["path"].startswith("file:") else options["path"]
        self.pattern = options.get("pattern", "*").lower()
        self.excluded = {x.strip().upper() for x in options.get("excluded", "").split(",") if x.strip()}
        self.most = int(options.get("maxbytes", MAX_BYTES))
        self.contents = options.get("contents", "true").lower() == "true"

    def partitions(self):
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        return [Folder(x) for x in kept_folders(self.root, self.excluded)[0]] or [Folder(self.root)]

    def read(self, partition: Folder):
        rows, held = [], 0
        for row in self._files(partition.path):
            rows.append(row)
            held += len(row[6] or b"")
            if held > BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        yield self._batch(rows)

    def _files(self, folder: str):
        try:
            names = sorted(os.listdir(folder))
        except OSError:
            return
        for name in names:
            path = os.path.join(folder, name)
            if not fnmatch.fnmatchcase(name.lower(), self.pattern) or not os.path.isfile(path):
                continue
            size = data = digest = None
            status = "ok"
            try:
                size = os.path.getsize(path)
                if size > self.most:
                    status = "skipped_oversize"
                elif size == 0:
                    status = "skipped_empty"
                else:
                    with open(path, "rb") as f:
                        data = f.read()
                    digest = hashlib.sha256(data).hexdigest()
            except OSError:
                status = "skipped_unreadable"
            yield path, folder, name, size, status, digest, data if self.contents else None

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


class FolderSource(DataSource):
    """Options: path, pattern (of names, whatever their case), excluded (names by commas), maxbytes, contents (false: names, sizes and hashes only).

    The folder is one that driver and executors share, such as a mounted file system.
    """

    @classmethod
    def name(cls) -> str:
        return "mnemo_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader({k.lower(): v for k, v in self.options.items()})


def read_folders(spark: SparkSession, root: str, pattern: str = "*", excluded: list[str] | None = None, max_bytes: int = MAX_BYTES, contents: bool = True) -> DataFrame:
    spark.dataSource.register(FolderSource)
    return (spark.read.format("mnemo_folders").option("path", root).option("pattern", pattern).option("excluded", ",".join(excluded or [])).option("maxbytes", str(max_bytes)).option("contents", str(contents).lower()).load())


def ingest_folder(files: DataFrame, store, batch: str, dry_run: bool = False) -> DataFrame:
    """Store the text files of ``read_folders`` and give (path, status, content_hash, domain), one row a file.

    Statuses: those of the source; skipped_unreadable also for contents that are no UTF-8; skipped for contents stored already and for all copies but the first of a run;
    skipped_empty for blank texts; ingested; in a dry run dry_run instead of ingested, and nothing is stored.
    """
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = files.select("path", "name", "status", "content_hash", text.alias("text"), domain_of(F.col("path")).alias("domain"))
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("text").isNull(), "skipped_unreadable").when(F.trim("text") == "", "skipped_empty").otherwise("ok")
    rows = rows.withColumn("status", status)
    good = rows.where("status = 'ok'")
    known = store.documents().select("content_hash", F.lit(True).alias("known"))
    first = good.groupBy("content_hash").agg(F.min(F.struct("name", "path")).alias("first"))
    told = rows.join(first, "content_hash", "left").join(known, "content_hash", "left")
    copy = F.col("known").isNotNull() | (F.col("path") != F.col("first.path"))
    told = told.select("path", F.when(F.col("status") != "ok", F.col("status")).when(copy, "skipped").otherwise(F.lit("dry_run" if dry_run else "ingested")).alias("status"), "content_hash", "domain")
    if dry_run:
        return told
    from mnemo.sources.shared import cut_lineage

    told = cut_lineage(told, "run")  # as it was before this run stored anything
    store.ingest(good.select(F.col("name").alias("title"), F.col("path").alias("source_uri"), "text", F.create_map(F.lit("domain"), "domain").alias("metadata")), batch)
    return told


def run_summary(told: DataFrame) -> DataFrame:
    """(status, files) of a run."""
    return told.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
