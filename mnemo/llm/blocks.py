"""Comparing the members of buckets in bounded blocks, however large a bucket is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal first ``keys`` columns, as tables, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True))
        start = 0
        for k, key in enumerate(rows):
            if key != last:
                if k > start:
                    held.append(batch.slice(start, k - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], k, key
        if start < len(rows):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def block_units(members: DataFrame, block: int, size: Column | None = None, block_bytes: int = 16_000_000) -> DataFrame:
    """Deal the members of each bucket so that every two of them meet in exactly one unit (bucket, i, j).

    ``members`` has ``bucket``, ``id`` and more columns.  A bucket of n members is dealt into
    ceil(n / block) blocks, or more where its ``size`` (bytes of a member) asks for blocks of ``block_bytes``; each pair of blocks (and each block with itself) is one unit of work of about
    2 * block rows, so no task holds a whole bucket.  Column ``side`` is 0 or 1; within a block all rows have side 0.
    """
    total = F.sum(F.lit(0) if size is None else size)
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_members"), total.alias("bytes")).where("n_members > 1")
    parts = F.greatest(F.ceil(F.col("n_members") / F.lit(block)), F.ceil(F.col("bytes") / F.lit(block_bytes))).cast("int")
    dealt = members.join(sizes.select("bucket", parts.alias("parts")), "bucket").withColumn("own", F.expr("cast(pmod(xxhash64(id, 7), parts) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return dealt.withColumn("other", other).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"),
        *[c for c in members.columns if c != "bucket"])


def by_unit(units: DataFrame, compare: Callable, schema: str) -> DataFrame:
    """``compare(table, same)`` gets the rows of each unit and yields record batches."""

    def run(batches):
        for table in runs(batches, 3):
            if table.num_rows > 1:
                yield from compare(table, table.column("i")[0].as_py() == table.column("j")[0].as_py())

    return units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, schema)


def block_pairs(members: DataFrame, block: int, compare: Callable, schema: str, size: Column | None = None, block_bytes: int = 16_000_000) -> DataFrame:
    """Give ``compare`` every two members of a bucket together exactly once, in units of bounded size."""
    return by_unit(block_units(members, block, size, block_bytes), compare, schema)
