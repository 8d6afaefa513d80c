"""Helpers that several operators share: shared tables, word hashing, connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemo.sources.shared import session_folder

#: Edges that one task holds when it contracts a part of a graph, or ends a small one: 16 bytes each.
LOCAL_EDGES = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """This session's folder below ``spark.checkpoint.dir``, which every executor and the driver can read.

    Only where the session names none and runs on one machine a temporary folder is used; a cluster without one is an error.
    """
    return session_folder(spark)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    Unlike ``checkpoint()`` this computes ``df`` once; unlike a cache it survives lost executors.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents_of(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, smallest vertex of each one's component) of the edges (u, v), by hooking and pointer jumping."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return ids, ids[label]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up


def contract(edges: DataFrame) -> DataFrame:
    """The edges (u, v) of each partition as stars (vertex, smallest vertex reachable inside the partition).

    Components stay the same and a partition gives fewer edges than it has vertices.  At most
    ``LOCAL_EDGES`` edges are held at once; stars are kept back to meet the next edges while they are few.
    """

    def run(batches):
        held, size = [], 0

        def close():
            ids, least = least_labels(*(np.concatenate(side) for side in zip(*held, strict=True)))
            return ids[ids != least], least[ids != least]

        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            size += batch.num_rows
            if size >= LOCAL_EDGES:
                star = close()
                held, size = [star], len(star[0])
                if size > LOCAL_EDGES // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in star], ["u", "v"])
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in close()], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by local contraction and alternating star steps.

    ``links`` has long columns ``a`` and ``b``; the result has one row ``(id, component)`` per
    linked vertex, where ``component`` is the smallest id reachable.  Every partition first contracts its own
    edges.  Once at most ``LOCAL_EDGES`` are left in all, one more contraction ends the work; a larger graph takes
    large-star and small-star steps: each is a map-side combined ``min`` and an equi-join, so a hub vertex is
    split by the skew join.  Nothing is gathered on the driver but one checksum per round.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = materialize(contract(edges), "cc")
    before = None
    for _ in range(max_rounds):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"),
                        F.expr("sum(pmod(xxhash64(v, u), 1000000007))").alias("s")).first()
        if now == before or not now["n"]:
            break
        if now["n"] <= LOCAL_EDGES:
            edges = materialize(contract(edges.repartition(1)), "cc")
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialize(small.where("u <> v").distinct(), "cc")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


class WordHashes(dict):
    """word -> row number in growing tables; ``make`` computes the row of an unseen word."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit, self.rows = make, limit, []

    def __missing__(self, word):
        self.rows.append(self.make(word))
        self[word] = n = len(self.rows) - 1
        return n

    def trim(self) -> None:
        """Called between documents: bounds the memory of a long-running Python worker."""
        if len(self.rows) > self.limit:
            self.clear()
            self.rows = []


LONG, TEXT = T.LongType(), T.StringType()
