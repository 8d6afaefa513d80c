"""Weighted five-word shingles and improved consistent weighted sampling (ICWS)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .lexer import mix, words_of

SHINGLE = 5
#: Counters of the document-frequency sketch: rows x width, sent in chunks.
ROWS, WIDTH, CHUNK = 2, 1 << 18, 1024
#: Shingles in fewer than one of RARE documents all weigh the same, ``1 + DAMPING``; one of every document weighs 1.
RARE, DAMPING = 128, 0.25
U = np.uint64
_P = U(0x9E3779B97F4A7C15)


def shingle_hashes(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """32-bit hashes of all runs of ``n`` words; a shorter text is one shingle of all its words."""
    if not len(words):
        return np.zeros(0, np.uint32)
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, U)
    for k in range(n):
        total = total * _P + words[k:len(words) - n + 1 + k]
    return (mix(total) >> U(32)).astype(np.uint32)


def cells(hashes: np.ndarray) -> list[np.ndarray]:
    """The counter of each shingle in each row of the sketch."""
    return [(hashes.astype(U) * f >> U(46)).astype(np.int64) for f in (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """A count-min sketch of how many documents hold each shingle, and the number of documents with words.

    All rows are counted.  Weights tell apart only shingles that at least one of ``RARE`` documents holds, and the
    mean over-count is taken off, so how well they are told apart does not depend on the number of documents.
    """
    from pyspark.sql import functions as F

    def count(batches):
        table, n = np.zeros((ROWS, WIDTH), np.int64), 0
        for batch in batches:
            for words in words_of(batch.column(0).to_pylist()):
                found = np.unique(shingle_hashes(words))
                n += len(found) > 0
                for row, at in zip(table, cells(found), strict=True):
                    np.add.at(row, at, 1)
        parts = table.reshape(-1, CHUNK)
        full = [k for k in range(len(parts)) if parts[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *full], pa.int32()), pa.array([np.array([n], "<i8").tobytes(), *(parts[k].astype("<i4").tobytes() for k in full)], pa.binary())], ["chunk", "counts"])

    def add(key, table):
        kind = "<i8" if key[0].as_py() < 0 else "<i4"
        total = sum(np.frombuffer(x.as_buffer(), kind).astype("<i8") for x in table.column("counts"))
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    rows = docs.select(F.col("text")).mapInArrow(count, schema).groupBy("chunk").applyInArrow(add, schema).collect()  # ROWS * WIDTH counters
    table, n = np.zeros((ROWS * WIDTH // CHUNK, CHUNK), np.int64), 0
    for r in rows:
        if r["chunk"] < 0:
            n = int(np.frombuffer(r["counts"], "<i8")[0])
        else:
            table[r["chunk"]] = np.frombuffer(r["counts"], "<i8")
    table = table.reshape(ROWS, WIDTH)
    return np.maximum(table - table.sum(axis=1, keepdims=True) // WIDTH, 0), n


def idf_table(counts: np.ndarray, n: int) -> np.ndarray:
    """1 + DAMPING * ln(N / df) / ln(RARE) per counter, df at least N / RARE: from 1 for a shingle of every document."""
    df = np.clip(counts, max(n, 1) / RARE, max(n, 1))
    return (1 + DAMPING * np.log(max(n, 1) / df) / np.log(RARE)).astype(np.float32)


def weights_of(hashes: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return tf.astype(np.float32) * np.max([row[at] for row, at in zip(idf, cells(hashes), strict=True)], axis=0) if len(hashes) else tf.astype(np.float32)


def weighted(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order and their TF-IDF weights."""
    return unpacked(shingle_hashes(words), idf)


def unpacked(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from all shingles of a text, repeated ones included."""
    found, tf = np.unique(hashes, return_counts=True)
    return found, weights_of(found, tf, idf)


class Icws:
    """``k`` consistent weighted samples: equal in two sets with the probability of their weighted Jaccard.

    The gamma and uniform variables of a (shingle, sample) pair come from tables indexed by bits of
    the shingle's hash under that sample's multiplier.
    """

    def __init__(self, k: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, 4096).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, 4096)).astype(np.float32)
        self.beta = rng.random(4096).astype(np.float32)
        self.factors = rng.integers(1, 1 << 63, k, dtype=np.uint64) * U(2) + U(1)

    def samples(self, hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(sets, k) 32-bit samples of sets laid end to end, none of them empty."""
        out = np.zeros((len(sizes), len(self.factors)), np.uint32)
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ln_w = np.log(weights)
        low, wide = U(4095), hashes.astype(U)
        for k, factor in enumerate(self.factors):
            x = wide * factor
            r = self.r[(x >> U(52)).astype(np.int64)]
            beta = self.beta[((x >> U(40)) & low).astype(np.int64)]
            t = np.floor(ln_w / r + beta)
            ln_a = self.ln_c[((x >> U(28)) & low).astype(np.int64)] - r * (t + 1 - beta)
            best = np.minimum.reduceat(ln_a, starts)
            at = np.flatnonzero(ln_a == best[owner])
            made = mix(wide[at] + t[at].astype(np.int64).astype(U) * _P)
            out[owner[at], k] = (made >> U(32)).astype(np.uint32)
        return out


def similarity(a: tuple, b: tuple) -> float:
    """The weighted Jaccard similarity of two sets given as sorted hashes and weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=float))
    return both / (float(a[1].sum(dtype=float)) + float(b[1].sum(dtype=float)) - both)


def similarities(a: tuple, sets: list[tuple]) -> np.ndarray:
    """The weighted Jaccard similarity of ``a`` with each of several sets."""
    sizes = np.array([len(h) for h, _ in sets])
    owner, found, weight = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([h for h, _ in sets]), np.concatenate([w for _, w in sets]).astype(float)
    at = np.minimum(np.searchsorted(a[0], found), len(a[0]) - 1)
    hit = a[0][at] == found
    shared = np.bincount(owner[hit], np.minimum(a[1][at[hit]], weight[hit]), len(sizes))
    return shared / (float(a[1].sum(dtype=float)) + np.bincount(owner, weight, len(sizes)) - shared)
