"""Substring search by trigram postings: a table of which texts hold which three characters in a row.

A literal part of a pattern can only be in a text that holds all its trigrams, so postings are intersected first and only the texts that are left are
read and tested with ``ilike``.  Rows form blocks; a block stores one list of positions for each of its trigrams, made from whole arrays of code points.
Names in texts are found through their rarest trigram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of postings after which a run is sorted and written, rows of a block (a position fits a short), bytes of text after which a block is full.
RUN, ROWS, BYTES = 32_000_000, 1 << 15, 2_000_000
#: The trigram of a block's keys, before all others; rows of a page, so that a search skips most of a run.
KEYS, PAGE = -1, 1000


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the lower-case text; in time proportional to its length.  Null and shorter texts have none."""
    of = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 2), lambda k: F.concat(F.get(c, k - 1), F.get(c, k), F.get(c, k + 1)))
    grams = F.flatten(F.transform(F.array(F.split(F.lower(text), "")), lambda c: F.when(F.size(c) > 2, of(c))))  # the signs are split once, as the only element
    return F.coalesce(F.array_distinct(F.filter(grams, lambda g: F.length(g) == 3)), F.array().cast("array<string>"))


def code(gram: str) -> int:
    """A trigram as a number, 21 bits for each of its code points."""
    x, y, z = map(ord, gram)
    return x << 42 | y << 21 | z


def grams_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, position): the distinct trigrams of each of at most ``ROWS`` texts as numbers, grouped by trigram, then in order of position."""
    plain = ["" if t is None else t for t in texts.to_pylist()]
    signs = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    at = np.repeat(np.arange(len(plain)), np.fromiter(map(len, plain), np.int64, len(plain)))
    inside = at[:-2] == at[2:]
    grams = pa.array((signs[:-2] << 42 | signs[1:-1] << 21 | signs[2:])[inside]).dictionary_encode()
    pairs = np.sort(grams.indices.to_numpy().astype(np.int64) * ROWS + at[:-2][inside])
    pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
    return grams.dictionary.to_numpy()[pairs // ROWS], pairs % ROWS


def bounded(batches: Iterator[pa.RecordBatch], columns: list[int]) -> Iterator[pa.Table]:
    """The rows as blocks of at most ``ROWS`` that are full once the texts of ``columns`` have ``BYTES``."""
    held: list[pa.RecordBatch] = []
    rows = used = 0
    for batch in batches:
        start = 0
        for k, size in enumerate(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy() for c in columns).tolist()):
            rows, used = rows + 1, used + size
            if rows == ROWS or used >= BYTES:
                yield pa.Table.from_batches([*held, batch.slice(start, k + 1 - start)])
                held, rows, used, start = [], 0, 0, k + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def grams_by_row(rows: DataFrame) -> DataFrame:
    """(id, gram): the distinct trigrams of each lower-case text of ``rows`` (id, text), as numbers."""
    def run(batches):
        for table in bounded(batches, [1]):
            gram, at = grams_of(table.column(1))
            yield from pa.table({"id": table.column(0).take(pa.array(at)), "gram": pa.array(gram)}).to_batches()

    return rows.select("id", "text").mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("gram", T.LongType())]))


def literals(pattern: str) -> list[str]:
    """The parts of an ``ilike`` pattern between its wildcards; a backslash makes the next sign plain."""
    parts, now, k = [], "", 0
    while k < len(pattern):
        if pattern[k] == "\\" and k + 1 < len(pattern):
            now, k = now + pattern[k + 1], k + 1
        elif pattern[k] in "%_":
            parts, now = [*parts, now], ""
        else:
            now += pattern[k]
        k += 1
    return [p for p in [*parts, now] if p]


def stored(block: int, column: str | None, gram: np.ndarray, positions: pa.Array, keys: pa.Array) -> pa.RecordBatch:
    n = len(gram)
    columns = [pa.array([block] * n, pa.int64()), pa.array([column] * n, pa.string()), pa.array(gram), positions, keys]
    return pa.RecordBatch.from_arrays(columns, ["block", "column", "gram", "positions", "keys"])


def in_runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows as runs sorted by trigram; a run is full once it has ``size`` bytes, so no more than that and one batch is held."""
    held: list[pa.RecordBatch] = []
    used = 0

    def run() -> pa.Table:
        table = pa.Table.from_batches(held)
        return table.take(pa.array(np.argsort(table.column("gram").to_numpy(), kind="stable")))

    for batch in batches:
        held, used = [*held, batch], used + batch.nbytes
        if used >= size:
            yield run()
            held, used = [], 0
    if held:
        yield run()


@dataclass
class TrigramIndex:
    """Postings of some columns of a table with a unique ``key``, sorted by trigram in runs of ``run`` bytes, so that a search skips the pages of other trigrams.

    Each task writes the blocks of its rows itself, keys and postings together; nothing is shuffled, and a task holds one run, however many rows it reads.
    """

    spark: SparkSession
    path: str
    key: list[str]
    columns: list[str]
    run: int = RUN
    schema: T.StructType | None = None

    def build(self, rows: DataFrame) -> TrigramIndex:
        """Rows of a block: the positions (two bytes each) for each column and trigram, and under ``KEYS`` the keys in order of position."""
        n, columns, size = len(self.key), self.columns, self.run
        keys = T.StructType([rows.schema[k] for k in self.key])
        kinds = {"block": T.LongType(), "column": T.StringType(), "gram": T.LongType(), "positions": T.BinaryType(), "keys": T.ArrayType(keys)}
        self.schema = T.StructType([T.StructField(*kind) for kind in kinds.items()])

        def postings(batches):
            base = TaskContext.get().partitionId() << 32
            for block, table in enumerate(bounded(batches, range(n, n + len(columns)))):
                struct = pa.StructArray.from_arrays([table.column(k).combine_chunks() for k in range(n)], table.column_names[:n])
                listed = pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct)
                yield stored(base + block, None, np.array([KEYS]), pa.nulls(1, pa.binary()), listed)
                for k, column in enumerate(columns):
                    gram, at = grams_of(table.column(n + k))
                    first = np.flatnonzero(np.diff(gram, prepend=-1))
                    ends = np.array([*first, len(at)], np.int32) * 2
                    positions = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(at.astype(np.uint16))])
                    yield stored(base + block, column, gram[first], positions, pa.nulls(len(first), listed.type))

        def run(batches):
            for table in in_runs(postings(batches), size):
                yield from table.to_batches(PAGE)

        lower = rows.select(*self.key, *(F.lower(c) for c in columns))
        lower.mapInArrow(run, self.schema).write.mode("overwrite").option("parquet.page.row.count.limit", PAGE).parquet(self.path)
        return self

    def candidates(self, pattern: str) -> DataFrame | None:
        """Keys of the rows of which one column holds all trigrams of the pattern; None where it has none, so that every row is one."""
        lower = self.spark.range(1).select(F.lower(F.lit(pattern)).alias("p")).first()["p"]
        parts = F.array(*map(F.lit, literals(lower))) if literals(lower) else F.array().cast("array<string>")
        grams = [code(g) for g in self.spark.range(1).select(F.array_distinct(F.flatten(F.transform(parts, trigrams))).alias("g")).first()["g"]]
        if not grams:
            return None
        table = (self.spark.read.schema(self.schema) if self.schema else self.spark.read).parquet(self.path)
        read = table.where(F.col("gram").isin(grams))
        several = F.collect_list("positions").alias("lists")
        lists = read.groupBy("block", "column").agg(several).where(F.size("lists") == len(grams))
        both = table.where(F.col("gram") == KEYS).select("block", "keys").join(lists.groupBy("block").agg(F.collect_list("lists").alias("columns")), "block")

        def run(batches):
            for batch in batches:
                for keys, columns in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    found = [reduce(lambda x, y: np.intersect1d(x, y, True), (np.frombuffer(x, np.uint16) for x in lists)) for lists in columns]
                    yield pa.RecordBatch.from_struct_array(keys.values.take(pa.array(reduce(np.union1d, found))))

        return both.select("keys", "columns").mapInArrow(run, table.schema["keys"].dataType.elementType)

    def search(self, rows: DataFrame, *patterns: str) -> DataFrame:
        """The rows of which a column is like one of ``patterns`` whatever the case; wildcards stay live."""
        hit = F.lit(False)
        for pattern in patterns:
            for c in self.columns:
                hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
        some = [self.candidates(pattern) for pattern in patterns]
        return (rows if None in some else rows.join(reduce(DataFrame.unionByName, some), self.key, "left_semi")).where(hit)


def contained(names: DataFrame, texts: DataFrame, least: int = 3) -> DataFrame:
    """(name, id): which distinct lower-case names of at least ``least`` (3 or more) characters are in which texts.

    ``names`` has name, ``texts`` id and text.  A name meets only the texts that hold its rarest trigram, in an equi-join, and is then looked for.  Null names and texts match
    nothing; white space around a name does not count.
    """
    wanted = names.select(F.trim(F.lower("name")).alias("name")).where(F.length("name") >= max(3, least)).distinct()
    lower = texts.select("id", F.lower("text").alias("text"))
    of_names = grams_by_row(wanted.select(F.col("name").alias("id"), F.col("name").alias("text"))).withColumnRenamed("id", "name")
    held = grams_by_row(lower).join(of_names.select("gram").distinct(), "gram", "left_semi")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = of_names.join(counts, "gram", "left").groupBy("name").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    pairs = rarest.join(held, "gram").select("name", "id")
    return pairs.join(lower, "id").where(F.contains("text", F.col("name"))).select("name", "id")
