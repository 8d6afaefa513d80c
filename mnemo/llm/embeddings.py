"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A vector is normalised and rotated by fixed random rotations; the signs are its code and the inner product of
the vector with its own code direction is the stored correction factor.  From another rotated vector and a
code one gets an unbiased estimate of the cosine and a confidence bound; only pairs whose bound reaches the
threshold are computed again exactly, in double precision.

Candidates share one of several bands of code bits.  Band width grows with the logarithm of the table and
the number of bands follows from the wanted recall, so buckets stay small as the table grows.  Equal vectors
are one node; larger buckets are compared in blocks, and a pair counts in its first shared band only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .blocks import block_units, by_unit
from .common import connected_components, materialize

#: Share of pairs at the threshold that may share no band, error bound in standard deviations, block rows.
MISS, SIGMAS, BLOCK = 0.004, 4.0, 512
_rotations: dict[tuple, np.ndarray] = {}


def rotations(dim: int, number: int, seed: int = 29) -> np.ndarray:
    """(number * dim, dim): random orthogonal matrices, one under the other."""
    if (dim, number) not in _rotations:
        rng = np.random.default_rng([seed, dim])
        _rotations[dim, number] = np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(number)])
    return _rotations[dim, number]


def band_plan(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a band, bands) for ``n`` vectors: a pair at ``threshold`` shares a band with probability 1 - MISS."""
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    bits = int(min(30, max(8, math.log2(max(n, 2)) - 3)))
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - same**bits))) if same < 1 else 1


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def band_keys(signs: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bands): each band's ``bits`` signs as one number."""
    return signs.reshape(len(signs), -1, bits) @ (1 << np.arange(bits, dtype=np.int64))


def encode(units: np.ndarray, bits: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed codes, correction factors, band keys) of unit vectors."""
    dim = units.shape[1]
    number = -(-bits * bands // dim)
    turned = units @ rotations(dim, number).T
    signs = turned > 0
    factor = np.abs(turned).sum(axis=1) / (number * math.sqrt(dim))  # mean over rotations of <o, code direction>
    return np.packbits(signs, axis=1), factor, band_keys(signs[:, :bits * bands], bits)


def estimates(units: np.ndarray, codes: np.ndarray, factors: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of every unit vector with every code, and the half-width of each code's bound."""
    dim = units.shape[1]
    signs = np.unpackbits(codes, axis=1, count=number * dim).astype(np.float32) * 2 - 1
    turned = (units @ rotations(dim, number).T).astype(np.float32)
    estimate = (turned @ signs.T) / (number * math.sqrt(dim) * np.maximum(factors, 1e-9)).astype(np.float32)
    width = SIGMAS * np.sqrt(np.maximum(0, 1 - factors**2)) / (np.maximum(factors, 1e-9) * math.sqrt(max(dim - 1, 1)))
    return estimate, width


def links_between(a: np.ndarray, b: np.ndarray, codes: np.ndarray, factors: np.ndarray, number: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into a, into b) of the pairs whose exact cosine reaches ``threshold``."""
    estimate, width = estimates(a, codes, factors, number)
    i, j = np.nonzero(estimate + width >= threshold)  # below: ruled out by the bound
    keep = []
    for k in range(0, len(i), 50_000):
        exact = np.einsum("ij,ij->i", a[i[k:k + 50_000]], b[j[k:k + 50_000]])
        keep.append(exact >= threshold)
    sure = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[sure], j[sure]


def spread_least(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest id reachable by the links (i, j)."""
    label = ids.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, label[i])
        if np.array_equal(label, before):
            return label


def usable(vector: str = "embedding"):
    """Not null, not empty, finite throughout and not all zero."""
    x = F.col(vector)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & good & F.exists(x, lambda v: v != 0), F.lit(False))


def link_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Links join vectors of one length whose cosine is at least ``threshold``.  Null, empty, zero and
    non-finite vectors link with nothing.  Repeated rows count as further vectors; other columns are ignored;
    an empty table gives no rows.  A row without vec_id counts as a link of others, but has neither
    component nor links of its own.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", usable().alias("good"))
    nodes = rows.where("good").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")).where("id is not null")
    nodes = materialize(nodes, "vectors")
    n = nodes.count()
    bits, bands = band_plan(n, threshold)
    shipped = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"

    def code(batches):
        for batch in batches:
            lists = batch.column(0)
            lengths = np.array([len(x) for x in lists], np.int64)
            flat = np.array(lists.flatten(), np.float64)
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                raw = np.stack([flat[s:s + dim] for s in starts[at]])
                codes, factors, keys = encode(unit(raw), bits, bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array([dim] * len(at), pa.int32()),
                     pa.array([v.tobytes() for v in raw.astype(shipped)], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factors), pa.array(list(keys), pa.list_(pa.int64()))],
                    ["id", "copies", "dim", "vector", "code", "factor", "keys"])

    coded = materialize(nodes.select("embedding", "id", "copies").mapInArrow(code, "id long, copies long, dim int, vector binary, code binary, factor double, keys array<long>"), "codes")
    members = coded.select("id", "dim", F.posexplode("keys").alias("band", "part")).select("id", F.struct("dim", "band", "part").alias("bucket"))

    def compare(table: pa.Table, same: bool):
        first = table.column("bucket")[0].as_py()
        dim, band = first["dim"], first["band"]
        ids, copies, side, factors = (table.column(c).to_numpy() for c in ("id", "copies", "side", "factor"))
        vectors = unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), shipped).reshape(-1, dim).astype(np.float64))
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        keys = band_keys(np.unpackbits(codes, axis=1, count=bits * bands), bits)
        left = np.arange(len(ids)) if same else np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return
        i, j = links_between(vectors[left], vectors[right], codes[right], factors[right], -(-bits * bands // dim), threshold)
        i, j = left[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        new = np.concatenate([~(keys[i[k:k + 20_000], :band] == keys[j[k:k + 20_000], :band]).any(axis=1) for k in range(0, len(i), 20_000)]) if len(i) else np.zeros(0, bool)
        i, j = i[new], j[new]
        if len(i):
            n_links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
            least = spread_least(len(ids), i, j, ids)
            at = np.flatnonzero(n_links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n_links[at].astype(np.int64)), pa.array(least[at])], ["id", "n_links", "least"])

    # buckets are dealt by id alone; a vector goes out once for each unit that compares it
    units = block_units(members, BLOCK)
    units = units.join(coded.select("id", "copies", "vector", "code", "factor"), "id").select(*units.columns, "copies", "vector", "code", "factor")
    found = materialize(by_unit(units, compare, "id long, n_links long, least long"), "vector-links")
    counts = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    components = connected_components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    known = nodes.join(counts, "id", "left").join(components, "id", "left").select(
        "embedding", F.coalesce("component", "id").alias("component"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = rows.withColumn("key", F.when(F.col("good") & F.col("vec_id").isNotNull(), F.col("embedding"))).join(known.withColumnRenamed("embedding", "key"), "key", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
