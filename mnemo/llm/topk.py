"""Exact top-k inner products with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; the vectors of a pivot are cut by distance into
annuli.  A directory holds the least and largest distance and the largest norm of each annulus.  For a query q, an
annulus around pivot p and a vector x in it the triangle inequality gives |q - x| >= gap, where gap is what lies between |q - p| and the
distances of the annulus, so <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2 is at most (|q|^2 + norm^2 - gap^2) / 2, and at most |q| norm.

A query first searches its best annuli, in the order of that bound, until they hold enough vectors; its k-th score then closes all annuli
whose bound is lower, and the open ones are searched.  Inside a task the score only rises, so later annuli close too.
Pivots are fitted on a bounded sample; every vector is indexed, and the result does not depend on the pivots.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import runs
from .common import materialize

#: Rows the pivots are fitted on, vectors an annulus is planned for, annuli a length at most, annuli of a pivot.
SAMPLE, ANNULUS, MAX_ANNULI, RINGS = 20_000, 512, 4_096, 4
#: Vectors and queries that meet in one unit of work; queries whose best scores a task holds before it writes them.
BLOCK, CHUNK, HELD = 512, 1_024, 50_000
#: Below this product of norms sums of integer products are exact in double precision.
EXACT = float(1 << 52)
#: Vectors of a larger norm have no usable distances: they form annulus -1, which every query searches.
HUGE = 1e100
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def pack(vectors: np.ndarray) -> list[bytes]:
    """Rows of whole numbers, two bytes a component where all of a row fit, else doubles."""
    small = (np.abs(vectors) < 1 << 15).all(axis=1)
    return [(v.astype("<i2") if s else v.astype("<f8")).tobytes() for v, s in zip(vectors, small, strict=True)]


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    if all(len(b) == 2 * dim for b in packed):
        return np.frombuffer(b"".join(packed), "<i2").reshape(len(packed), dim).astype(np.float64)
    return np.stack([np.frombuffer(b, "<i2" if len(b) == 2 * dim else "<f8").astype(np.float64) for b in packed])


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; those beyond 64 bits become the largest or least long."""
    most = norms(queries).max(initial=0) * norms(vectors).max(initial=0)
    if most < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(queries) @ whole(vectors).T, LEAST, MOST).astype(np.int64)


def fit_pivots(sample: np.ndarray, number: int, seed: int = 17, rounds: int = 6) -> np.ndarray:
    """``number`` centres of the sample, or as many as it has different rows."""
    sample = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    pivots = sample[rng.choice(len(sample), min(number, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = distances(sample, pivots).argmin(axis=1)
        for p in np.unique(nearest):
            pivots[p] = sample[nearest == p].mean(axis=0)
    return pivots


def norms(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((rows**2).sum(axis=1))


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(0, squares))


def bounds(queries: np.ndarray, pivots: np.ndarray, around: np.ndarray, near: np.ndarray, far: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Largest possible score of each query in each annulus (its pivot's number ``around``), with room for rounding."""
    length = norms(queries)
    usable = length <= HUGE
    out = np.full((len(queries), len(around)), np.inf)
    at = np.flatnonzero(around >= 0)
    apart = distances(queries[usable], pivots)[:, around[at]]
    gap = np.maximum(0, np.maximum(apart - far[at], near[at] - apart))
    squares = length[usable, None] ** 2 + norm[at] ** 2
    best = np.minimum((squares - gap**2) / 2, length[usable, None] * norm[at])
    out[np.ix_(usable, at)] = best + 1e-6 * (squares + (pivots**2).sum(axis=1)[around[at]]) + 1
    return out


class Index:
    """Pivots and annuli of each vector length; at most ``MAX_ANNULI`` annuli a length."""

    def __init__(self, pivots: dict[int, np.ndarray], cuts: dict[int, np.ndarray]):
        self.pivots, self.cuts = pivots, cuts

    def of(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """A length that the sample lacks has one pivot, the origin, and one annulus."""
        return self.pivots.get(dim, np.zeros((1, dim))), self.cuts.get(dim, np.zeros((1, 0)))

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(annulus, distance to its pivot) of each row."""
        pivots, cuts = self.of(rows.shape[1])
        usable = norms(rows) <= HUGE
        apart = distances(np.where(usable[:, None], rows, 0), pivots)
        nearest = apart.argmin(axis=1)
        apart = apart[np.arange(len(rows)), nearest]
        ring = (apart[:, None] > cuts[nearest]).sum(axis=1)
        return np.where(usable, nearest * (cuts.shape[1] + 1) + ring, -1), np.where(usable, apart, 0)


def fit_index(coded: DataFrame, n: int) -> Index:
    """Pivots and cuts from the ``SAMPLE`` rows of least hash; their number follows from the ``n`` rows of the table."""
    rows = coded.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("dim", "vector").collect()
    by_dim: dict[int, list[bytes]] = {}
    for r in rows:
        by_dim.setdefault(r["dim"], []).append(bytes(r["vector"]))
    pivots, cuts = {}, {}
    for dim, packed in by_dim.items():
        if not dim:
            continue
        sample = unpack(packed, dim)
        sample = sample[norms(sample) <= HUGE]
        if not len(sample):
            continue
        wanted = min(MAX_ANNULI, max(1, n * len(packed) // (len(rows) * ANNULUS)))
        centres = fit_pivots(sample, max(1, wanted // RINGS))
        apart = distances(sample, centres)
        nearest = apart.argmin(axis=1)
        own = [apart[nearest == p, p] for p in range(len(centres))]
        shares = np.arange(1, RINGS) / RINGS
        pivots[dim], cuts[dim] = centres, np.stack([np.quantile(d, shares) if len(d) else np.zeros(RINGS - 1) for d in own])
    return Index(pivots, cuts)


def quantized(vectors: DataFrame, scale: int, query: Column) -> DataFrame:
    """(uid, vec_id, dim, vector, asks) of the rows that take part: components floor(scale * x), all finite."""
    x = F.transform("embedding", lambda v: v.cast("double") * scale)
    whole = F.forall("scaled", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("scaled"), F.coalesce(query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))

    def code(batches):
        for batch in batches:
            lists = batch.column(2)
            lengths = np.array([len(v) for v in lists], np.int64)
            flat = np.floor(np.array(lists.flatten(), np.float64))
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                packed = pack(np.stack([flat[s:s + dim] for s in starts[at]]).reshape(len(at), dim))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([dim] * len(at), pa.int32()), pa.array(packed, pa.binary()), batch.column(3).take(take)], ["uid", "vec_id", "dim", "vector", "asks"])

    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "scaled", "asks").mapInArrow(code, "uid long, vec_id long, dim int, vector binary, asks boolean")


def by_length(batch: pa.RecordBatch, column: str = "vector"):
    """(positions, rows) of each vector length in a batch."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, unpack(batch.column(column).take(pa.array(at)).to_pylist(), dim)


def placed(coded: DataFrame, index: Index) -> DataFrame:
    """``coded`` with ``annulus``, ``distance``, ``norm`` and the score of a vector with itself, ``own``."""
    def run(batches):
        for batch in batches:
            for _, at, rows in by_length(batch):
                annulus, apart = index.place(rows)
                norm = norms(rows)
                own = np.array([scores(v[None], v[None])[0, 0] for v in rows], np.int64)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(annulus.astype(np.int32)), pa.array(apart), pa.array(norm), pa.array(own)], [*batch.schema.names, "annulus", "distance", "norm", "own"])

    return coded.mapInArrow(run, "uid long, vec_id long, dim int, vector binary, asks boolean, annulus int, distance double, norm double, own long")


def directory_of(rows: DataFrame) -> dict[int, dict[str, np.ndarray]]:
    """Each length's annuli: their number, count, distances and largest norm."""
    found = rows.groupBy("dim", "annulus").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("near"), F.max("distance").alias("far"), F.max("norm").alias("norm")).toPandas()
    return {int(dim): {c: part[c].to_numpy() for c in ("annulus", "n", "near", "far", "norm")} for dim, part in found.sort_values("annulus").groupby("dim")}


def requests(queries: DataFrame, index: Index, directory: dict, enough: int | None = None) -> DataFrame:
    """(uid, dim, vector, annulus, bound): the annuli a query asks for.

    With ``enough`` its best ones, in the order of their bounds, until they hold so many vectors; else all whose bound reaches the query's
    ``score`` so far, or all where it has none.
    """
    def run(batches):
        for batch in batches:
            for dim, at, rows in by_length(batch):
                d = directory[dim]
                pivots, cuts = index.of(dim)
                limit = batch.column("score").take(pa.array(at)).to_numpy(zero_copy_only=False).astype(float)
                best = bounds(rows, pivots, d["annulus"] // (cuts.shape[1] + 1), d["near"], d["far"], d["norm"])
                if enough is None:
                    wanted = ~(best < limit[:, None])  # not a number: no score yet
                else:
                    order = np.argsort(-best, axis=1, kind="stable")
                    before = np.cumsum(d["n"][order], axis=1) - d["n"][order]
                    wanted = np.zeros(best.shape, bool)
                    np.put_along_axis(wanted, order, before < enough, axis=1)
                for k in range(0, len(at), 64):
                    i, j = np.nonzero(wanted[k:k + 64])
                    take = pa.array(at[i + k])
                    yield pa.RecordBatch.from_arrays([batch.column("uid").take(take), pa.array([dim] * len(i), pa.int32()), batch.column("vector").take(take), pa.array(d["annulus"][j].astype(np.int32)), pa.array(best[i + k, j])], ["uid", "dim", "vector", "annulus", "bound"])

    return queries.select("uid", "dim", "vector", "score").mapInArrow(run, "uid long, dim int, vector binary, annulus int, bound double")


class Best:
    """The best ``k`` (score, -vec_id) of many queries."""

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def floor(self, uid: int) -> float:
        heap = self.heaps.get(uid)
        return heap[0][0] if heap and len(heap) == self.k else -math.inf

    def add(self, uid: int, score: np.ndarray, ids: np.ndarray) -> None:
        heap = self.heaps.setdefault(uid, [])
        for pair in zip(score.tolist(), (-ids).tolist(), strict=True):
            if len(heap) < self.k:
                heapq.heappush(heap, pair)
            elif pair > heap[0]:
                heapq.heapreplace(heap, pair)

    def drain(self) -> pa.RecordBatch:
        rows = [(u, s, -i) for u, heap in self.heaps.items() for s, i in heap]
        self.heaps = {}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["uid", "score", "vec_id"])


def top_rows(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def search(asked: DataFrame, index_rows: DataFrame, directory: dict, k: int, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(uid, score, vec_id): the best ``k`` of each query in the annuli it asks for, a few times ``k`` rows a query.

    An annulus is dealt to blocks of vectors and chunks of queries that meet once each; the sizes come from the directory and a count
    of requests an annulus, both bounded by the number of annuli.
    """
    spark = asked.sparkSession
    wanted = {(r["dim"], r["annulus"]): r["count"] for r in asked.groupBy("dim", "annulus").count().collect()}
    sizes = [(int(dim), int(a), max(1, -(-int(n) // block)), -(-wanted[dim, a] // chunk)) for dim, d in directory.items() for a, n in zip(d["annulus"].tolist(), d["n"].tolist(), strict=True) if (dim, a) in wanted]
    plan = F.broadcast(spark.createDataFrame(sizes, "dim int, annulus int, blocks int, chunks int"))
    deal = lambda c, n: F.pmod(F.xxhash64(c, F.lit(5)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vectors = index_rows.join(plan, ["dim", "annulus"]).select("dim", "annulus", deal("uid", F.col("blocks")).alias("block"), each("chunks").alias("chunk"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("uid"), "vec_id", "vector", F.lit(0.0).alias("bound"))
    queries = asked.join(plan, ["dim", "annulus"]).select("dim", "annulus", each("blocks").alias("block"), deal("uid", F.col("chunks")).alias("chunk"), F.lit(0).alias("side"), "uid", F.lit(0).cast("long").alias("vec_id"), "vector", "bound")

    def run(batches):
        best = Best(k)
        for unit in runs(batches, 4):
            side = unit.column("side").to_numpy()
            ask, have = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            uids, bound = unit.column("uid").to_numpy()[ask], unit.column("bound").to_numpy()[ask]
            still = np.array([b >= best.floor(u) for u, b in zip(uids.tolist(), bound.tolist(), strict=True)], bool)
            ask, uids = ask[still], uids[still]
            if len(ask) and len(have):
                dim, packed = unit.column("dim")[0].as_py(), unit.column("vector")
                ids = unit.column("vec_id").to_numpy()[have]
                found = scores(unpack(packed.take(pa.array(ask)).to_pylist(), dim), unpack(packed.take(pa.array(have)).to_pylist(), dim))
                for row, uid in enumerate(uids.tolist()):
                    at = top_rows(found[row], ids, k)
                    best.add(uid, found[row][at], ids[at])
            if len(best.heaps) > HELD:
                yield best.drain()
        yield best.drain()

    keys = ["dim", "annulus", "block", "chunk"]
    units = vectors.unionByName(queries).repartition(*keys).sortWithinPartitions(*keys)
    return units.mapInArrow(run, "uid long, score long, vec_id long")


def merged(found: DataFrame, k: int) -> DataFrame:
    """(uid, best): the best ``k`` of each query as array<struct<lost, vec_id, score>>, in order; a task gives at most a few times k rows a query."""
    entry = F.struct((-F.col("score").cast("decimal(20,0)")).alias("lost"), "vec_id", "score")
    return found.groupBy("uid").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best"))


def top_k(vectors: DataFrame, k: int, query: Column, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of ``vectors`` (vec_id, embedding) where ``query`` holds.

    Components become floor(scale * x); the score is their exact inner product, ties go to the smaller vec_id.  Candidates
    are all rows of the query's length but the query's own row; other rows of its id count.  Rows without vec_id, null vectors and vectors with null or
    non-finite components take no part; empty vectors score 0 with each other.  Repeated rows are candidates and queries of their own.  Scores beyond 64 bits stop at
    the largest long.  Other columns are ignored; an empty table gives no rows.
    """
    coded = materialize(quantized(vectors, scale, query), "quantized")
    index = fit_index(coded, coded.count())
    rows = materialize(placed(coded, index), "annuli")
    directory = directory_of(rows)
    asking = rows.where("asks")
    start = requests(asking.withColumn("score", F.lit(None).cast("double")), index, directory, 4 * (k + 1))
    first = merged(search(start, rows, directory, k + 1), k + 1)
    so_far = materialize(first.select("uid", F.try_element_at("best", F.lit(k + 1))["score"].cast("double").alias("score")), "first")
    rest = requests(asking.join(so_far, "uid", "left"), index, directory)
    found = merged(search(rest, rows, directory, k + 1), k + 1)
    own = F.array_position(F.transform("best", lambda b: (b["vec_id"] == F.col("query_id")) & (b["score"] == F.col("own"))), F.lit(True))
    best = asking.select("uid", F.col("vec_id").alias("query_id"), "own").join(found, "uid").withColumn("own", own)
    others = F.slice(F.filter("best", lambda b, i: i + 1 != F.col("own")), 1, k)  # the query's own row is among its best k + 1, or none of them is
    return best.select("query_id", F.posexplode(others).alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", "b.score")
