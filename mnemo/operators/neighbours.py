"""Nearest vectors of many queries, with cells that are ruled out by exact bounds.

Vectors go to the nearest of some sampled centres; a cell knows its largest angle to the centre.  By the triangle inequality on the sphere no vector of a cell
is nearer to a query than the query's angle to the centre less that radius.  A query first meets its nearest cells, until they hold ``k`` vectors, and
then the other cells that may still hold one as near as its k-th.  Vectors and queries are compared in blocks: a task gets some neighbouring cells and a share
of the queries, leaves out what the bounds rule out, and sends only the best ``k`` of a query, valued exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemo.sources.shared import cut_lineage

#: Centres at most, and vectors a cell is planned for.
CENTRES, CELL = 1024, 32
#: Vectors and queries that a task compares at once, about, queries multiplied at a time, and pairs valued at a time.
BLOCK, ASKED, SLICE, PAIRS = 8192, 2048, 256, 1 << 16
#: More than a similarity or an angle can be off by rounding.
SLACK = 1e-9
FOUND = "query_id long, vec_id long, similarity double"


def usable(vector: str = "embedding"):
    """Not null or empty, finite throughout and not all zero: a vector with a direction."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def to_units(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def raw_rows(column) -> np.ndarray:
    """The vectors of a column, which are of one length, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten(), np.float64).reshape(len(column), -1)


def rows_of(column: pa.Array):
    """(positions, vectors) of each length."""
    lengths = np.array(pc.list_value_length(column), np.int64)
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        yield dim, at, raw_rows(column.take(pa.array(at)))


def angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1, 1))


def cosines(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosine of each pair (a[i], b[j]), summed in the order of the components, so that it is the same wherever the rows lie."""
    def norms(x):
        out = np.zeros(len(x))
        for d in range(x.shape[1]):
            out += x[:, d] * x[:, d]
        return np.sqrt(out)

    ta, tb, out = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), np.zeros(len(i))
    for lo in range(0, len(i), PAIRS):
        x, y = i[lo:lo + PAIRS], j[lo:lo + PAIRS]
        for d in range(len(ta)):
            out[lo:lo + PAIRS] += ta[d][x] * tb[d][y]
    return out / (norms(a)[i] * norms(b)[j])


def first_of_each(group: np.ndarray, k: int) -> np.ndarray:
    """Which places of a sorted array are among the first ``k`` of their value."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    return np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)])) < k


def best(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, worst: np.ndarray | None = None, meets=None) -> pa.RecordBatch:
    """``FOUND``: of ``rows`` the ``k`` most similar of each query, of equal ones those of lowest ids, left out what is less similar than its ``worst`` or its own id.

    ``meets`` gives [(rows, queries)] to compare of a slice of queries, else all are.  Products of matrices choose the pairs that are valued.
    """
    order = np.argsort(ids, kind="stable")
    _, same = np.unique(np.ascontiguousarray(rows[order]).view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True)
    copies = np.argsort(same, kind="stable")
    keep = np.sort(order[copies[first_of_each(same[copies], k + 1)]])  # of copies no query needs more
    ids, rows, back = ids[keep], rows[keep], np.full(len(ids), -1)
    back[keep] = np.arange(len(keep))
    units, asked = to_units(rows), to_units(queries)
    by_id = np.argsort(ids)
    found: list[list[np.ndarray]] = [[], [], []]
    for lo in range(0, len(query_ids), SLICE):
        now = np.arange(lo, min(lo + SLICE, len(query_ids)))
        if meets is None:
            similar = asked[now] @ units.T
        else:
            similar = np.full((len(now), len(ids)), -np.inf)
            for some, which in meets(now, asked[now]):
                some = back[some]
                some = some[some >= 0]
                similar[np.ix_(which, some)] = asked[now[which]] @ units[some].T
        at = by_id[np.minimum(np.searchsorted(ids[by_id], query_ids[now]), len(ids) - 1)]
        own = np.flatnonzero(ids[at] == query_ids[now])
        similar[own, at[own]] = -np.inf
        least = np.partition(similar, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(now), -np.inf)
        if worst is not None:
            least = np.fmax(least, worst[now])
        i, j = np.nonzero((similar >= least[:, None] - SLACK) & (similar > -np.inf))
        value = cosines(queries[now], i, rows, j)
        order = np.lexsort((ids[j], -value, i))
        order = order[first_of_each(i[order], k)]
        for x, part in zip(found, (query_ids[now[i[order]]], ids[j[order]], value[order]), strict=True):
            x.append(part)
    names = [c.split()[0] for c in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names)


class Cells:
    """Sampled centres of each vector length; a length without one is a single cell, -1."""

    def __init__(self, centres: dict[int, np.ndarray]):
        self.centres = centres
        self.directory: dict[int, tuple[np.ndarray, ...]] = {}  # length -> cells, vectors in them, radii, first block of each and number of blocks

    def place(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` (id, embedding) with ``dim``, ``cell`` and ``angle``."""
        centres = self.centres
        kind = vectors.schema["embedding"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                for dim, at, rows in rows_of(batch.column(1)):
                    apart = angles(to_units(rows), centres[dim]) if dim in centres else np.full((len(at), 1), math.pi)
                    cell = apart.argmin(axis=1)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([dim] * len(at), pa.int32()), pa.array((cell if dim in centres else cell - 1).astype(np.int32)), pa.array(apart[np.arange(len(at)), cell])], ["id", "embedding", "dim", "cell", "angle"])

        return vectors.select("id", "embedding").mapInArrow(run, f"id long, embedding {kind}, dim int, cell int, angle double")

    def count(self, placed: DataFrame) -> Cells:
        """Counts the cells; small ones share a block, large ones are dealt to several."""
        found = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).toPandas()
        last, room = -1, 0
        for dim, x in found.sort_values(["dim", "cell"]).groupby("dim"):
            first, parts, room = [], [], 0
            for n in x["n"]:
                if n > room:
                    last, room = last + 1, BLOCK
                first.append(last)
                parts.append(math.ceil(n / BLOCK))
                last, room = last + parts[-1] - 1, room - n
            self.directory[int(dim)] = (x["cell"].to_numpy(), x["n"].to_numpy(), x["radius"].to_numpy(), np.array(first), np.array(parts))
        return self

    def dealt(self, placed: DataFrame) -> DataFrame:
        """(block, cell, id, embedding) of ``placed``."""
        layout = [(dim, int(c), int(f), int(p)) for dim, (cell, _, _, first, parts) in self.directory.items() for c, f, p in zip(cell, first, parts, strict=True)]
        where = placed.sparkSession.createDataFrame(layout, "dim int, cell int, first int, parts int")
        block = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        return placed.join(F.broadcast(where), ["dim", "cell"]).select(block.alias("block"), "cell", "id", "embedding")  # a row for each cell

    def least(self, units: np.ndarray) -> np.ndarray:
        """The least angle to each query that a vector of each cell can have."""
        dim = units.shape[1]
        cell, _, radius, *_ = self.directory[dim]
        return angles(units, self.centres[dim])[:, cell] - radius if dim in self.centres else np.zeros((len(units), 1))

    def requests(self, queries: DataFrame, k: int, first: bool) -> DataFrame:
        """(query_id, q, worst, reach, block, met): the blocks a query (query_id, q, worst) meets, the least angle of the cells it meets in them, and how many vectors those hold.

        ``first``: the nearest, until they hold more than ``k`` vectors; else all that may hold a vector of a similarity of at least ``worst``, or all where it is null.
        """
        directory, least_of = self.directory, self.least
        kind = queries.schema["q"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                for dim, at, rows in rows_of(batch.column(1)):
                    if dim not in directory:
                        continue
                    cell, n, _, start, parts = directory[dim]
                    least = least_of(to_units(rows))
                    if first:
                        order = np.argsort(least, axis=1, kind="stable")
                        before = np.cumsum(n[order], axis=1) - n[order]
                        wanted = np.zeros(least.shape, bool)
                        np.put_along_axis(wanted, order, before <= k, axis=1)
                    else:
                        worst = batch.column(2).take(pa.array(at)).to_numpy(zero_copy_only=False).astype(float)
                        wanted = ~(np.cos(np.maximum(0, least)) + 1e-7 < worst[:, None])  # not a number: no k-th yet
                    reach = np.where(wanted, least, -np.inf).max(axis=1)
                    of_cell = np.repeat(np.arange(len(cell)), parts)
                    block = np.repeat(start, parts) + np.arange(len(of_cell)) - np.repeat(np.cumsum(parts) - parts, parts)
                    size = np.where(block == start[of_cell], n[of_cell], 0)  # of a cell in several blocks all in the first
                    begin = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                    for lo in range(0, len(at), SLICE):
                        some = wanted[lo:lo + SLICE][:, of_cell]
                        met = np.add.reduceat(some * size, begin, axis=1)
                        i, j = np.nonzero(np.logical_or.reduceat(some, begin, axis=1))
                        take = pa.array(at[i + lo])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(reach[i + lo]), pa.array(block[begin][j].astype(np.int32)), pa.array(met[i, j].astype(np.int64))],
                                                         ["query_id", "q", "worst", "reach", "block", "met"])

        return queries.select("query_id", "q", "worst").mapInArrow(run, f"query_id long, q {kind}, worst double, reach double, block int, met long")

    def compared(self, requests: DataFrame, dealt: DataFrame, k: int, shares: int) -> DataFrame:
        """``FOUND`` of each block and share of the queries."""
        directory, least_of = self.directory, self.least

        def run(key, some: pa.Table, asked: pa.Table) -> pa.Table:
            if not len(some) or not len(asked):
                return pa.Table.from_batches([], pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64())]))
            rows, cells, reach = raw_rows(some["embedding"]), some["cell"].to_numpy(), asked["reach"].to_numpy()
            members = [(at, np.flatnonzero(cells == c)) for at, c in enumerate(directory[rows.shape[1]][0]) if c in set(cells.tolist())]

            def meets(now, units):
                near = least_of(units) <= reach[now][:, None] + SLACK
                return [(rows_, np.flatnonzero(near[:, at])) for at, rows_ in members if near[:, at].any()]

            worst = asked["worst"].to_numpy().astype(float)
            return pa.Table.from_batches([best(some["id"].to_numpy(), rows, asked["query_id"].to_numpy(), raw_rows(asked["q"]), k, worst, meets)])

        shared = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        own = requests.withColumn("share", F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(shares)).cast("int"))
        return shared.groupBy("block", "share").cogroup(own.groupBy("block", "share")).applyInArrow(run, FOUND)


def fit_cells(vectors: DataFrame, n: int, most: int = CENTRES) -> Cells:
    """Centres are the vectors of least hash, about one for ``CELL`` of the ``n`` vectors and ``most`` at most."""
    number = min(most, max(1, n // CELL))
    centres: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(number).select("embedding").collect():
        centres.setdefault(len(r["embedding"]), []).append(r["embedding"])
    return Cells({dim: to_units(np.array(rows, np.float64)) for dim, rows in centres.items()})


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def named(top: DataFrame) -> DataFrame:
    return top.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 4).alias("similarity"))


def nearest(corpus: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, vec_id, rank, similarity) of the ``k`` nearest of every query, one row (compared, pairs) of how many pairs were compared).

    ``corpus`` is (vec_id, embedding), ``queries`` (query_id, embedding), ids unique longs.  A query does not meet the vector of its own id.  Similarity is the cosine;
    ties go to the smaller vec_id.  Null, zero and non-finite vectors, and vectors of another length, are near to none.
    """
    vectors = corpus.where(usable()).select(F.col("vec_id").cast("long").alias("id"), "embedding")
    n = vectors.count()
    cells = fit_cells(vectors, n)
    placed = cut_lineage(cells.place(vectors), "cells")
    dealt = cells.count(placed).dealt(placed)
    asked = cut_lineage(queries.where(usable()).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("q")), "queries")
    shares = max(1, math.ceil(asked.count() / ASKED))
    first = ranked(cells.compared(cells.requests(asked.withColumn("worst", F.lit(None).cast("double")), k, True), dealt, k, shares), k)
    kth = cut_lineage(first.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("worst")), "kth")
    rest = cut_lineage(cells.requests(asked.join(kth, "query_id", "left"), k, False), "requests")
    told = rest.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("compared")).crossJoin(asked.agg((F.count(F.lit(1)) * F.lit(n)).alias("pairs")))  # one row each
    return named(ranked(cells.compared(rest, dealt, k, shares), k)), told


def nearest_of_few(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The result of ``nearest`` for queries that fit in one broadcast; the corpus is read once."""
    asked: dict[int, list] = {}
    for r in queries.where(usable()).select(F.col("query_id").cast("long").alias("query_id"), "embedding").collect():
        asked.setdefault(len(r["embedding"]), []).append(r)
    sent = corpus.sparkSession.sparkContext.broadcast({dim: (np.array([r["query_id"] for r in rows], np.int64), np.array([r["embedding"] for r in rows], np.float64)) for dim, rows in asked.items()})

    def run(batches):
        for batch in batches:
            for dim, at, rows in rows_of(batch.column(1)):
                if dim in sent.value:
                    yield best(batch.column(0).take(pa.array(at)).to_numpy(), rows, *sent.value[dim], k)

    vectors = corpus.where(usable()).select(F.col("vec_id").cast("long").alias("id"), "embedding")
    return named(ranked(vectors.mapInArrow(run, FOUND), k))
