"""Stored tables with merge: rows bucketed by key hash, of which a merge rewrites only those it touches.

A merge folds the stored rows of the touched buckets and the new rows in one grouped pass and writes those buckets back by dynamic partition
overwrite: files of other buckets are neither read nor written.  Merging the same rows again gives the same table, so a merge that was
broken off is simply run again; a batch that is complete is marked and skipped.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemo.functions.expressions import uuid5
from mnemo.operators.ingest import chunk_text
from mnemo.sources.shared import cut_lineage, exists

BUCKETS = 64
#: How a column of an existing row takes a new value.
SET, KEEP_FIRST, MERGE = "set", "first", "merge"
#: Name space of stored documents.
DOCUMENTS = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@dataclass
class StoredTable:
    """A table at ``path`` with a unique ``key``.

    ``policies`` names columns that are not ``SET``.  ``SET``: the latest row that sets the column decides; a row
    sets what its ``sets`` (array of column names) holds, or else every column in which it is not null.  ``KEEP_FIRST``: the value of the first row of
    the key stays.  ``MERGE``: maps are merged, later entries win.  Nulls in a key are values like others.  The number of buckets is fixed when the table is made;
    it bounds what a merge lists on the driver, and ``slices`` spreads each bucket over so many tasks and files.
    """

    spark: SparkSession
    path: str
    key: list[str]
    schema: str
    policies: dict[str, str] = field(default_factory=dict)
    buckets: int = BUCKETS
    slices: int = 1

    def __post_init__(self):
        self.fields = T.StructType.fromDDL(self.schema)
        layout = f"{self.path}/layout"
        if exists(self.spark, layout):
            self.buckets = self.spark.read.schema("buckets int").parquet(layout).first()["buckets"]
        else:
            self.spark.range(1).select(F.lit(self.buckets).cast("int").alias("buckets")).write.parquet(layout)

    @property
    def columns(self) -> list[str]:
        return self.fields.names

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _stored(self) -> DataFrame:
        full = T.StructType([*self.fields, T.StructField("batch", T.StringType()), T.StructField("bucket", T.IntegerType())])
        if not exists(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        return self._stored().select(*self.columns)

    def read_with_batch(self) -> DataFrame:
        """The rows, and the batch that changed each last."""
        return self._stored().drop("bucket")

    def applied(self, batch: str) -> bool:
        return exists(self.spark, f"{self.path}/batches/{batch}")

    def merge(self, rows: DataFrame, batch: str, order: str | None = None) -> bool:
        """Fold ``rows`` in, in the order of the column ``order``; false if the batch had been merged before.

        ``rows`` has the key columns and any of the others, and perhaps ``sets``.  Rows of one key and order go by their hash.  Columns that the table lacks are left out.
        """
        if self.applied(batch):
            return False
        new = cut_lineage(self._normal(rows, order), "merge")
        touched = [r["bucket"] for r in new.select(self._bucket()).distinct().collect()]
        if touched:
            old = self._stored().where(F.col("bucket").isin(touched))
            every = old.select(*self.columns, F.lit(0).alias("_new"), F.lit(None).cast("decimal(38,6)").alias("_number"), F.lit(None).cast("string").alias("_text"), F.array(*map(F.lit, self.columns)).alias("_sets"), F.lit(0).cast("long").alias("_tie"), "batch")
            changed = new.withColumn("batch", F.lit(batch))
            part = F.pmod(F.xxhash64(*self.key, F.lit(1)), F.lit(self.slices)).alias("_slice")
            merged = self._folded(every.unionByName(changed).select("*", self._bucket(), part).repartition("bucket", "_slice"))
            if any(p == MERGE for p in self.policies.values()):
                merged = merged.repartition("bucket", "_slice")  # the join of the maps has dealt the rows anew
            merged.drop("_slice").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def _normal(self, rows: DataFrame, order: str | None) -> DataFrame:
        value = lambda f: (F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        own = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in self.columns if c in rows.columns)))
        sets = F.coalesce(F.col("sets"), own) if "sets" in rows.columns else own
        kind = rows.schema[order].dataType if order else None
        text = F.col(order) if isinstance(kind, T.StringType) else F.lit(None)
        number = F.unix_micros(order) if isinstance(kind, T.TimestampType) else F.lit(None) if order is None or isinstance(kind, T.StringType) else F.col(order)
        flat = [F.to_json(F.col(f.name)) if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)) else F.col(f.name).cast("string") for f in self.fields if f.name in rows.columns]
        return rows.select(*map(value, self.fields), F.lit(1).alias("_new"), number.cast("decimal(38,6)").alias("_number"), text.cast("string").alias("_text"), sets.alias("_sets"), F.xxhash64(*flat).alias("_tie"))

    def _folded(self, events: DataFrame) -> DataFrame:
        """One row a key of ``events``, which lie by bucket and slice and are not sent again to be grouped."""
        place = F.struct("_new", "_number", "_text", "_tie")
        maps = [c for c in self.columns if self.policies.get(c) == MERGE]
        first = [c for c in self.columns if self.policies.get(c) == KEEP_FIRST]
        plain = [c for c in self.columns if c not in self.key and c not in maps and c not in first]
        latest = lambda c: F.max_by(F.col(c), F.when(F.array_contains("_sets", c), place)).alias(c)
        firsts = [F.min_by(F.struct(*first), place).alias("_first")] if first else []
        out = events.groupBy("bucket", "_slice", *self.key).agg(*map(latest, plain), *firsts, F.max_by("batch", place).alias("batch"))
        for c in maps:
            keys = [F.col(k).alias(f"_key_{k}") for k in self.key]
            entries = events.select(*keys, place.alias("_place"), F.explode(c).alias("_k", "_v")).groupBy(*(f"_key_{k}" for k in self.key), "_k").agg(F.max_by("_v", "_place").alias("_v"))
            entries = entries.groupBy(*(f"_key_{k}" for k in self.key)).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(c))
            same = F.lit(True)
            for k in self.key:
                same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
            out = out.join(entries, same, "left").drop(*(f"_key_{k}" for k in self.key))
        if first:
            out = out.select("*", *(F.col("_first")[c].alias(c) for c in first))
        return out.select(*self.columns, "batch", "bucket", "_slice")


DOCUMENT = "document_id string, title string, source_uri string, content_hash string, metadata map<string,string>, n_chunks long"
CHUNK = "document_id string, ordinal long, char_start long, content string, embedding array<float>"


@dataclass
class DocumentStore:
    """Documents and their chunks, which land together or not at all.

    Chunks are written before their documents, and a chunk is seen only where its document is: a batch that was broken
    off between the two shows neither, and running it again completes both.
    """

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def __post_init__(self):
        self.documents_ = StoredTable(self.spark, f"{self.path}/documents", ["document_id"], DOCUMENT, dict.fromkeys(("title", "source_uri", "content_hash", "metadata", "n_chunks"), KEEP_FIRST), self.buckets)
        self.chunks_ = StoredTable(self.spark, f"{self.path}/chunks", ["document_id", "ordinal"], CHUNK, dict.fromkeys(("char_start", "content"), KEEP_FIRST), self.buckets)

    def ingest(self, docs: DataFrame, batch: str) -> DataFrame:
        """Store (title, source_uri, text, and perhaps metadata) and give (content_hash, status, n) of the contents: ingested, skipped or skipped_empty.

        A content has one document, whose id follows from its hash: the copy of the least title and uri stands for it.  Contents that are stored already are skipped.  Null and blank
        texts are not stored.
        """
        meta = F.col("metadata") if "metadata" in docs.columns else F.lit(None).cast("map<string,string>")
        rows = docs.select("title", "source_uri", "text", meta.alias("metadata"), F.sha2("text", 256).alias("content_hash"))
        blank = F.col("text").isNull() | (F.trim("text") == "")
        one = F.min_by(F.struct("title", "source_uri", "metadata"), F.struct(F.col("title"), F.col("source_uri"))).alias("d")
        contents = rows.groupBy("content_hash", blank.alias("blank")).agg(F.count(F.lit(1)).alias("n"), one)
        stored = self.documents_.read().select("content_hash", F.lit(True).alias("stored"))
        told = contents.join(stored, "content_hash", "left")
        status = F.when(F.col("blank"), "skipped_empty").when(F.col("stored"), "skipped").otherwise("ingested")
        told = cut_lineage(told.select("content_hash", status.alias("status"), "n", "d.*"), "contents")  # without the texts
        fresh = told.where("status = 'ingested'").withColumn("document_id", uuid5(DOCUMENTS, F.col("content_hash")))
        report = told.select("content_hash", "status", "n")
        out = f"{self.path}/reports/{batch}"
        if not exists(self.spark, out):
            report.write.mode("overwrite").parquet(out)  # before anything is stored
        if not self.chunks_.applied(batch):
            kept = fresh.select("content_hash", "document_id", F.col("title").alias("_title"), F.col("source_uri").alias("_uri"))
            texts = rows.where(~blank).join(kept, "content_hash").where(F.col("title").eqNullSafe(F.col("_title")) & F.col("source_uri").eqNullSafe(F.col("_uri")))  # rows alike in all give the same chunks
            self.chunks_.merge(chunk_text(texts.select(F.col("document_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "document_id"), batch)
        if not self.documents_.applied(batch):
            n = self.chunks_.read().groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
            self.documents_.merge(fresh.join(n, "document_id", "left").select("document_id", "title", "source_uri", "content_hash", "metadata", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")), batch)
        return self.spark.read.schema(report.schema).parquet(out)

    def documents(self) -> DataFrame:
        return self.documents_.read()

    def chunks(self, *columns) -> DataFrame:
        """All chunks, or columns of them that ``document_id`` is among."""
        return self.chunks_.read().select(*columns or self.chunks_.columns).join(self.documents().select("document_id"), "document_id", "left_semi")

    def embed(self, vectors: DataFrame, batch: str) -> bool:
        """Give chunks their vectors (document_id, ordinal, embedding); other fields stay."""
        known = self.chunks_.read().select("document_id", "ordinal")
        return self.chunks_.merge(vectors.select("document_id", "ordinal", "embedding").join(known, ["document_id", "ordinal"], "left_semi"), batch)


ENTITY = "name string, entity_type string, metadata map<string,string>, embedding array<float>, balance double"


def entity_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> StoredTable:
    """Entities by name and type: metadata is merged, a vector and a balance stay until a new one comes."""
    return StoredTable(spark, path, ["name", "entity_type"], ENTITY, {"metadata": MERGE}, buckets)


JOB = "job string, status string, last_started_at timestamp, last_completed_at timestamp, last_duration_s double, items_processed long, items_failed long, last_error string"
#: Fixed values of a job's life: event, status.
JOB_EVENTS = {"registered": "idle", "started": "running", "completed": "success", "error": "error"}


def job_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> StoredTable:
    return StoredTable(spark, path, ["job"], JOB, buckets=buckets)


def job_changes(events: DataFrame, jobs: StoredTable) -> DataFrame:
    """What events (job, at, seq, kind, items, failed, message) set in the job table, one row an event.

    A start sets status and time; an end also the duration since the last start, be it stored or in this batch, counters where the job succeeded, and the
    error (at most 500 characters), which a success clears.  A registration sets the status of new jobs only.  Events without a job or of other kinds change nothing.
    """
    from pyspark.sql import Window as W

    known = jobs.read().select("job", F.col("last_started_at").alias("stored_start"))
    some = events.where(F.col("job").isNotNull() & F.col("kind").isin(*JOB_EVENTS)).join(known.withColumn("known", F.lit(True)), "job", "left")
    order = W.partitionBy("job").orderBy("at", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.coalesce(F.last(F.when(F.col("kind") == "started", F.col("at")), ignorenulls=True).over(order), F.col("stored_start"))
    first = F.row_number().over(W.partitionBy("job").orderBy("at", "seq")) == 1
    kinds = F.create_map(*(F.lit(x) for pair in JOB_EVENTS.items() for x in pair))
    kind = F.col("kind")
    ended = kind.isin("completed", "error")
    seconds = (F.unix_micros("at") - F.unix_micros("start")) / F.lit(1e6)
    rows = some.select("*", start.alias("start"), first.alias("first"))
    sets = F.when(kind == "registered", F.when(F.col("first") & F.col("known").isNull(), F.array(F.lit("status"))).otherwise(F.array().cast("array<string>"))).when(
        kind == "started", F.array(F.lit("status"), F.lit("last_started_at"))).when(
        kind == "completed", F.array(*map(F.lit, ("status", "last_completed_at", "last_duration_s", "items_processed", "items_failed", "last_error")))).otherwise(
        F.array(*map(F.lit, ("status", "last_completed_at", "last_duration_s", "last_error"))))
    return rows.select("job", F.concat(F.date_format("at", "yyyyMMddHHmmssSSSSSS"), F.format_string("%020d", F.col("seq").cast("long"))).alias("place"), kinds[kind].alias("status"), F.col("at").alias("last_started_at"), F.col("at").alias("last_completed_at"),
                       F.when(ended, seconds).alias("last_duration_s"), F.coalesce("items", F.lit(0)).cast("long").alias("items_processed"), F.coalesce("failed", F.lit(0)).cast("long").alias("items_failed"),
                       F.when(kind == "error", F.substring("message", 1, 500)).alias("last_error"), sets.alias("sets"))


COUNTERS = ("files_detected", "files_validated", "files_ingested", "files_failed", "chunks_created", "embeddings_generated", "facts_extracted", "db_records")


def counter_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> StoredTable:
    """Ingestion counters by domain; an update changes only the counters it names."""
    return StoredTable(spark, path, ["domain"], "domain string, " + ", ".join(f"{c} long" for c in COUNTERS), buckets=buckets)


def merge_all(table: StoredTable, batches: Iterable[tuple[str, DataFrame, str | None]]) -> StoredTable:
    for name, rows, order in batches:
        table.merge(rows, name, order)
    return table
