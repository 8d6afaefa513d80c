"""Resumable loads by key ranges: each range is merged into a stored table by stable ids and marked, and a later run goes on behind the last one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions.expressions import uuid5
from mnemo.operators.store import StoredTable
from mnemo.sources.shared import exists

AUDIT = "job string, page long, last_key long, source_rows long, loaded_rows long, status string"


def key_ranges(source: DataFrame, key: str, pages: int) -> list[tuple[int | None, int]]:
    """(after, up to) of about equal ranges of a long ``key``, ``pages`` at most; the bounds are quantiles, so their number does not grow with the table."""
    shares = [k / pages for k in range(1, pages + 1)]
    row = source.agg(F.percentile_approx(key, shares, 10_000).alias("q"), F.max(key).alias("most")).first()
    if row["most"] is None:
        return []
    ends = sorted({*row["q"], row["most"]})
    return list(zip([None, *ends[:-1]], ends, strict=True))


@dataclass
class KeysetLoad:
    """A load of ``source`` into ``target``, whose ``id`` is the version 5 UUID of ``prefix`` and the key.

    The ranges are fixed by the first run and kept beside the audit rows, so that an interrupted load meets the same pages again.  Rows without a key cannot be ordered; they are
    counted by the audit row of page -1 and not loaded.
    """

    source: DataFrame
    key: str
    target: StoredTable
    path: str
    namespace: str
    prefix: str
    pages: int = 100

    def __post_init__(self):
        self.spark = self.source.sparkSession
        self.audit_ = StoredTable(self.spark, f"{self.path}/audit", ["job", "page"], AUDIT, buckets=1)

    def ranges(self) -> list[tuple[int | None, int]]:
        kept = f"{self.path}/ranges"
        if not exists(self.spark, kept):
            found = key_ranges(self.source, self.key, self.pages)
            self.spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(found)], "page long, after long, upto long").coalesce(1).write.mode("overwrite").parquet(kept)
        return [(r["after"], r["upto"]) for r in self.spark.read.parquet(kept).orderBy("page").collect()]

    def run(self, transform: Callable[[DataFrame], DataFrame] = lambda df: df, most: int | None = None) -> int:
        """Load the pages that are not loaded yet, ``most`` at most; how many were."""
        done = 0
        for page, (after, upto) in enumerate(self.ranges()):
            if self.audit_.applied(f"page-{page}"):
                continue
            if most is not None and done == most:
                return done
            k = F.col(self.key)
            rows = self.source.where((k <= upto) if after is None else (k > after) & (k <= upto))
            made = transform(rows).withColumn("id", uuid5(self.namespace, F.concat(F.lit(self.prefix), k.cast("string"))))
            self.target.merge(made, f"page-{page}", self.key)
            n = rows.agg(F.count(F.lit(1)).alias("source_rows"), F.count_distinct(self.key).alias("loaded_rows"))
            self._log(n.withColumn("last_key", F.lit(upto)), page)
            done += 1
        if not self.audit_.applied("page--1"):
            lost = self.source.where(F.col(self.key).isNull()).agg(F.count(F.lit(1)).alias("source_rows"))
            self._log(lost.select("source_rows", F.lit(0).cast("long").alias("loaded_rows"), F.lit(None).cast("long").alias("last_key")), -1)
        return done

    def _log(self, n: DataFrame, page: int) -> None:
        self.audit_.merge(n.withColumns({"job": F.lit(self.prefix), "page": F.lit(page).cast("long"), "status": F.lit("rejected" if page < 0 else "loaded")}), f"page-{page}")

    def audit(self) -> DataFrame:
        return self.audit_.read()

    def last_key(self) -> int | None:
        return self.audit().agg(F.max("last_key")).first()[0]
