"""Near-duplicate classes: banded consistent weighted samples, verified by weighted Jaccard similarity.

Texts are sets of five-word shingles with TF-IDF weights.  Texts of equal words form one node.  Nodes that
agree in all samples of a band are candidates; a pair is linked if its weighted Jaccard similarity
reaches the threshold.  Classes are the connected components.

Inside a bucket members are first compared with one centre each, the smallest node, so that groups of copies join in
linear work; what is then still apart in a bucket is compared in blocks, by its samples first.  Only nodes
that have a candidate there send their shingles to be verified, and no row is made for a pair that is not a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_units, by_unit
from .common import connected_components, materialize
from .lexer import words_of
from .shingles import Icws, document_frequencies, idf_table, shingle_hashes, similarities, unpacked, weighted

#: 20 bands of 5 samples: a pair at 0.8 shares a band with probability 0.9996.
BANDS, WIDTH = 20, 5
#: Shingles sampled at once, members of a block and bytes of their shingles, pairs of a centre verified in one place, and how
#: many standard deviations below the threshold the share of equal samples may lie before a pair is not verified.
SLICE, BLOCK, BLOCK_BYTES, SLOT, SLACK = 60_000, 512, 4_000_000, 512, 4.0


def word_key(words: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(words.tobytes())


def node_of(key: bytes) -> int:
    """A node's number: 64 bits of the hash of its words."""
    return int.from_bytes(key[:8], "little", signed=True)


def signatures(docs: DataFrame, idf: np.ndarray, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """(doc_id, h, key, node, size, sig): ``h`` tells texts apart, ``key`` is a hash of the words, null where there are none."""

    def run(batches):
        icws = Icws(bands * width)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32())

        def close():
            sets = [s for s in held if len(s[5])]
            sig = icws.samples(np.concatenate([s[5] for s in sets]), np.concatenate([s[6] for s in sets]), np.array([len(s[5]) for s in sets])) if sets else []
            rows = iter(sig)
            sigs = [next(rows).astype("<u4").tobytes() if len(s[5]) else None for s in held]
            return pa.RecordBatch.from_arrays([*(pa.array([s[k] for s in held], t) for k, t in enumerate(kinds)), pa.array(sigs, pa.binary())], ["doc_id", "h", "key", "node", "size", "sig"])

        held, size = [], 0
        for batch in batches:
            for doc, h, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), words_of(batch.column(2).to_pylist()), strict=True):
                hashes, weights = weighted(found, idf)
                key = word_key(found) if len(found) else None
                held.append((doc, h, key, node_of(key) if key else None, len(found), hashes, weights))
                size += len(hashes)
                if size >= SLICE or len(held) >= 2000:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(run, "doc_id long, h long, key binary, node long, size int, sig binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, hashes): all shingles of a text as 32-bit hashes in ascending order, repeated ones included."""

    def run(batches):
        def close():
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.binary())], ["node", "hashes"])

        rows, size = [], 0
        for batch in batches:
            for words in words_of(batch.column(0).to_pylist()):
                if len(words):
                    rows.append((node_of(word_key(words)), np.sort(shingle_hashes(words)).astype("<u4").tobytes()))
                    size += len(rows[-1][1])
                if size >= BLOCK_BYTES:
                    yield close()
                    rows, size = [], 0
        if rows:
            yield close()

    return docs.select("text").mapInArrow(run, "node long, hashes binary")


def likely(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) that share at least ``least`` samples."""
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sides = [np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(batch.num_rows, -1) for k in (2, 3)]
                yield batch.filter(pa.array((sides[0] == sides[1]).sum(axis=1) >= least)).select(["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches ``threshold``, with it; ``pairs`` and ``sets`` are written tables.

    Pairs meet at their first node, ``SLOT`` of them in one place, so the shingles of a node with many
    pairs are sent once for every ``SLOT`` of them.
    """
    slots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLOT).alias("slots"))
    dealt = pairs.join(slots, "a").select("a", F.expr("cast(pmod(xxhash64(b, 5), slots) as int)").alias("slot"), "b")
    centres = dealt.select("a", "slot").distinct().select("a", "slot", F.lit(0).alias("side"), F.col("a").alias("node"))
    rows = centres.unionByName(dealt.select("a", "slot", F.lit(1).alias("side"), F.col("b").alias("node"))).join(sets, "node")

    def run(batches):
        centre = None
        for batch in batches:
            start = 0
            while start < batch.num_rows:  # some rows at a time, so that few sets are unpacked at once
                part, used = [], 0
                for a, side, node, data in zip(*(batch.column(k).slice(start, 256).to_pylist() for k in range(4)), strict=True):
                    part.append((a, side, node, unpacked(np.frombuffer(data, "<u4"), idf)))
                    used += len(data)
                    if used >= BLOCK_BYTES:
                        break
                start += len(part)
                made, k = [], 0
                while k < len(part):
                    if part[k][1] == 0:
                        centre = part[k]
                        k += 1
                        continue
                    last = k
                    while last < len(part) and part[last][1]:
                        last += 1
                    if centre is None or centre[0] != part[k][0]:
                        raise RuntimeError(f"no shingles of node {part[k][0]}")
                    found = similarities(centre[3], [p[3] for p in part[k:last]])
                    made += [(centre[0], part[k + i][2], float(found[i])) for i in np.flatnonzero(found >= threshold)]
                    k = last
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "weighted"])

    ordered = rows.repartition("a", "slot").sortWithinPartitions("a", "slot", "side")
    return ordered.select("a", "side", "node", "hashes").mapInArrow(run, "a long, b long, weighted double")


def joined_blocks(member: DataFrame, nodes: DataFrame, sets: DataFrame, idf: np.ndarray, threshold: float, least: int, bands: int, width: int) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components so far.

    ``member`` has (bucket, band, id, component).  The first pass compares samples only and keeps, of each unit, the members that have a
    candidate; the second brings these members' shingles together and verifies.
    """
    known = nodes.select(F.col("node").alias("id"), "sig", "size")
    units = materialize(block_units(member.join(known, "id").select("bucket", "id", "band", "component", "sig", "size"), BLOCK, F.col("size") * 4, BLOCK_BYTES), "units")

    def candidates(table: pa.Table, same: bool):
        """For every row of the left block, the rows of the right one to verify; a pair meets in each band it shares, and its first is the one that counts."""
        band = table.column("band")[0].as_py()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u4").reshape(table.num_rows, bands, width)
        ids, label, side = (table.column(c).to_numpy().copy() for c in ("id", "component", "side"))
        left = np.arange(len(ids)) if same else np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        for i in left.tolist():
            js = right[(label[right] != label[i]) & ((ids[right] > ids[i]) if same else True)]
            if len(js):
                equal = sig[js] == sig[i]
                js = js[(equal.all(axis=2).argmax(axis=1) == band) & (equal.sum(axis=(1, 2)) >= least)]
                if len(js):
                    yield i, js, ids, label

    def pick(table: pa.Table, same: bool):
        keep = np.zeros(table.num_rows, bool)
        for i, js, _, _ in candidates(table, same):
            keep[i] = keep[js] = True
        yield from table.filter(pa.array(keep)).to_batches()

    picked = materialize(by_unit(units, pick, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema)), "picked")
    if picked.isEmpty():
        return picked.select(F.col("id").alias("a"), F.col("id").alias("b"))

    def compare(table: pa.Table, same: bool):
        sets_ = [unpacked(np.frombuffer(x, "<u4"), idf) for x in table.column("hashes").to_pylist()]
        made = []
        for i, js, ids, label in candidates(table, same):
            for j in js[similarities(sets_[i], [sets_[j] for j in js]) >= threshold].tolist():
                if label[j] != label[i]:  # one link joins two components, further ones add nothing
                    made.append((int(ids[i]), int(ids[j])))
                    label[label == label[j]] = label[i]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], ["a", "b"])

    return by_unit(picked.join(sets.withColumnRenamed("node", "id"), "id").select(*picked.columns, "hashes"), compare, "a long, b long")


def classified(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """(doc_id, h, component, class_id) of every row: ``h`` is xxhash64 of the text, ``component`` is null where there are no words."""
    k = bands * width
    least = int(k * threshold - SLACK * (k * threshold * (1 - threshold)) ** 0.5)
    counts, n = document_frequencies(docs)
    idf = idf_table(counts, n)
    sigs = materialize(signatures(docs, idf, bands, width), "signatures")
    keyed = sigs.where("key is not null and doc_id is not null")
    nodes = materialize(keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("node", "size", "sig"))), "nodes")

    parts = F.array(*(F.xxhash64(F.lit(b), F.substring("sig", 4 * width * b + 1, 4 * width)) for b in range(bands)))
    rows = nodes.select("node", F.posexplode(parts).alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre")).where("n > 1")
    held = materialize(rows.join(shared.select("bucket", "centre"), "bucket"), "buckets")
    stars = materialize(likely(held.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), nodes, least), "pairs")

    ids = nodes.join(held.select("node").distinct(), "node", "left_semi").select("doc_id")
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = materialize(shingle_sets(texts), "sets")
    links = materialize(verified(stars, sets, idf, threshold).select("a", "b"), "links")
    found = connected_components(links)

    # buckets that still hold several components: every two members of different components
    member = held.select("bucket", "band", "node").join(found.withColumnRenamed("id", "node"), "node", "left").select("bucket", "band", F.col("node").alias("id"), F.coalesce("component", "node").alias("component"))
    open_ = member.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y and n > 2").select("bucket")
    member = materialize(member.join(open_, "bucket"), "open")
    merged = found
    if not member.isEmpty():
        more = materialize(joined_blocks(member, nodes, sets, idf, threshold, least, bands, width), "links")
        if not more.isEmpty():
            merged = connected_components(links.unionByName(more))
    merged = materialize(merged.withColumnRenamed("id", "node").join(nodes.select("node", "doc_id"), "node").select("node", "component", "doc_id"), "classes")
    least_id = merged.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    linked = merged.join(least_id, "component").select("node", "component", "class_id")
    named = nodes.select("key", "node", "doc_id").join(linked, "node", "left").select("key", F.coalesce("component", "node").alias("component"), F.coalesce("class_id", "doc_id").alias("class_id"))
    return sigs.select("doc_id", "h", "key").join(named, "key", "left").select("doc_id", "h", "component", F.coalesce("class_id", "doc_id").alias("class_id"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id of each document's class of near copies; one row per input row.

    Reads ``doc_id`` and ``text`` only.  A null text, or one without words, is a class of its own; a text of under
    five words is one shingle.  Rows that repeat a doc_id are judged by their own texts.  Rows without doc_id have a
    null class, and no other row is linked through them.  An empty table gives no rows.
    """
    return classified(docs, threshold, bands, width).select("doc_id", "class_id")


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each class: the smallest doc_id, and of equal ids the smallest hash of the text.

    Rows without doc_id and texts without words stay.  Of rows that repeat both doc_id and text one stays.
    """
    rows = materialize(classified(docs, threshold).where("doc_id is not null and component is not null"), "classified")
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component", "first")
    gone = rows.join(first, "component").where(F.struct("doc_id", "h") != F.col("first")).select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    kept = docs.join(gone, (F.col("doc_id").cast("long") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_h")), "left_anti")
    repeated = rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again_id"), F.col("h").alias("again_h"))
    if repeated.isEmpty():
        return kept
    same = (F.col("doc_id").cast("long") == F.col("again_id")) & (F.xxhash64("text") == F.col("again_h"))
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
