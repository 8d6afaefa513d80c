"""Conflicts between facts of one subject and predicate, as joins instead of per-fact look-ups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemo.functions.expressions import contradicts, cosine, evidence
from mnemo.operators import neighbours
from mnemo.operators.replay import replay  # noqa: F401
from mnemo.sources.shared import cut_lineage

NEEDED = ("fact_id", "object_value", "provenance_text", "embedding")
#: Facts of a subject and predicate that one task compares with as many others.
BLOCK = 1024
#: Facts that are compared in one product of matrices, about.
TILE = 256


def _rows(facts: DataFrame) -> DataFrame:
    when = F.coalesce("valid_from", "observed_at")
    return facts.select(F.lower("subject").alias("ls"), F.lower("predicate").alias("lp"), F.struct(*NEEDED, when.alias("t")).alias("x"), F.col("superseded_by").isNull().alias("open")).where("ls is not null and lp is not null")


def _different() -> Column:
    return (F.col("p.fact_id") != F.col("o.fact_id")) & (F.lower("p.object_value") != F.lower("o.object_value"))


def candidates(facts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (probe p, other o) of one subject and predicate with different objects; an equi-join of the columns the tests need.

    Both sides of a group are dealt to blocks of about ``block`` facts, and each pair of blocks is a key of the join, so a subject
    and predicate that hold much of the table spread over many tasks.
    """
    rows = _rows(facts)
    sizes = rows.groupBy("ls", "lp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = rows.join(sizes, ["ls", "lp"]).withColumn("own", F.pmod(F.xxhash64("x.fact_id"), "blocks").cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    p = dealt.select("ls", "lp", F.col("own").alias("pb"), F.col("met").alias("ob"), F.col("x").alias("p"))
    o = dealt.where("open").select("ls", "lp", F.col("met").alias("pb"), F.col("own").alias("ob"), F.col("x").alias("o"))
    return p.join(o, ["ls", "lp", "pb", "ob"]).where(_different()).select("p", "o")


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar others of each probe, with ``similarity``.

    Each task keeps its own ``k`` best of a probe before the shuffle, so the pairs themselves are not sent.
    """
    scored = pairs.withColumn("similarity", cosine(F.col("p.embedding"), F.col("o.embedding")))
    rank = F.row_number().over(W.partitionBy("p.fact_id").orderBy(F.desc("similarity"), "o.fact_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def similar(facts: DataFrame, k: int, least: float, block: int = BLOCK) -> DataFrame:
    """(p, o, similarity): what ``nearest(candidates(facts), k)`` gives of similarities that, rounded to 4 digits, are at least ``least``.

    Facts are sent once, and a group is compared in its task by products of matrices, so no pairs are sent.  Only groups of more than ``block`` facts
    are dealt to pairs of blocks, and the best of their probes ranked once more.  Facts without an object or a usable vector are left out first.  ``t`` is in microseconds.
    """
    when = F.unix_micros(F.coalesce("valid_from", "observed_at")).alias("t")
    rows = facts.where(F.col("object_value").isNotNull() & neighbours.usable()).select(
        F.lower("subject").alias("ls"), F.lower("predicate").alias("lp"), F.lower("object_value").alias("lo"), "fact_id", "object_value", "provenance_text", when, "embedding", F.col("superseded_by").isNull().alias("other")).where("ls is not null and lp is not null")
    side = f"struct<fact_id:{dict(rows.dtypes)['fact_id']},object_value:string,provenance_text:string,t:bigint>"
    keys = ["ls", "lp", "pb", "ob"]

    def compare(dealt: DataFrame) -> DataFrame:
        def run(batches):
            return _best_of_groups(batches, k, least)

        ordered = dealt.select(*keys, "lo", "fact_id", "object_value", "provenance_text", "t", "embedding", "probe", "other").repartition(*keys).sortWithinPartitions(*keys)
        return ordered.mapInArrow(run, f"p {side}, o {side}, similarity double").where(F.round("similarity", 4) >= least)

    number = F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")
    large = cut_lineage(rows.groupBy("ls", "lp").agg(number).where(F.col("blocks") > 1), "large")  # at most one row for ``block`` facts
    if large.isEmpty():
        return compare(rows.withColumns({"pb": F.lit(0), "ob": F.lit(0), "probe": F.lit(True)}))
    small = compare(rows.join(F.broadcast(large), ["ls", "lp"], "left_anti").withColumns({"pb": F.lit(0), "ob": F.lit(0), "probe": F.lit(True)}))
    dealt = rows.join(F.broadcast(large), ["ls", "lp"]).withColumn("own", F.pmod(F.xxhash64("fact_id"), "blocks").cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    probes = dealt.withColumns({"pb": F.col("own"), "ob": F.col("met"), "probe": F.lit(True), "other": F.lit(False)})
    others = dealt.where("other").withColumns({"pb": F.col("met"), "ob": F.col("own"), "probe": F.lit(False)})
    rank = F.row_number().over(W.partitionBy("p.fact_id").orderBy(F.desc("similarity"), "o.fact_id"))
    return small.unionByName(compare(probes.unionByName(others)).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))


def _best_of_groups(batches, k: int, least: float):
    """Batches (p, o, similarity) from rows in order of their four key columns; whole groups are compared together while they have ``TILE`` rows."""
    def found(rows: pa.Table, starts: np.ndarray):
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
        lo = 0
        while lo < len(rows):
            hi = int(starts[max(np.searchsorted(starts, lo + TILE, "right") - 1, 0)]) if len(rows) - lo > TILE else len(rows)
            if hi <= lo:
                after = np.searchsorted(starts, lo, "right")
                hi = int(starts[after]) if after < len(starts) else len(rows)
            yield _best_of_tile(rows.slice(lo, hi - lo).combine_chunks(), group[lo:hi], k, least)
            lo = hi

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and _starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])).size == 1:
            first = _starts(pa.Table.from_batches([batch]))
            if len(first) == 1:
                held.append(batch)
                continue
        rows = pa.Table.from_batches([*held, batch])
        starts = _starts(rows)
        last = int(starts[-1])
        if last:
            yield from found(rows.slice(0, last), starts[:-1])
        held = rows.slice(last).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield from found(rows, _starts(rows))


def _starts(rows: pa.Table) -> np.ndarray:
    """Where groups begin."""
    new = np.ones(len(rows), bool)
    new[1:] = False
    for c in rows.columns[:4]:
        c = c.combine_chunks()
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _best_of_tile(rows: pa.Table, group: np.ndarray, k: int, least: float) -> pa.RecordBatch:
    column = lambda c: rows[c].combine_chunks()
    codes = lambda c: pc.rank(column(c), tiebreaker="dense").to_numpy().astype(np.int64)
    ids, objects = codes("fact_id"), codes("lo")
    probe, other = (column(c).to_numpy(zero_copy_only=False) for c in ("probe", "other"))
    out: list[tuple[np.ndarray, ...]] = []
    for _, at, vectors in neighbours.rows_of(column("embedding")):
        units, o = neighbours.to_units(vectors), np.flatnonzero(other[at])
        for p in np.split(np.flatnonzero(probe[at]), range(TILE, int(probe[at].sum()), TILE)):
            if not len(p) or not len(o):
                continue
            like = units[p] @ units[o].T
            a, b = at[p], at[o]
            like[(group[a][:, None] != group[b]) | (objects[a][:, None] == objects[b]) | (ids[a][:, None] == ids[b])] = -np.inf
            enough = np.full(len(p), least - 6e-5)  # what may still round up to it
            if len(o) > k:
                enough = np.maximum(enough, np.partition(like, -k, axis=1)[:, -k] - neighbours.SLACK)
            i, j = np.nonzero(like >= enough[:, None])
            value = neighbours.cosines(vectors[p], i, vectors[o], j) if len(i) else np.zeros(0)
            order = np.lexsort((ids[b[j]], -value, i))
            order = order[neighbours.first_of_each(i[order], k)]
            out.append((a[i[order]], b[j[order]], value[order]))
    p, o, value = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    names = ("fact_id", "object_value", "provenance_text", "t")
    side = lambda at: pa.StructArray.from_arrays([column(c).take(pa.array(at)) for c in names], names)
    return pa.RecordBatch.from_arrays([side(p), side(o), pa.array(value)], ["p", "o", "similarity"])


def lowest(facts: DataFrame, k: int) -> DataFrame:
    """Pairs (p, o) of each probe and the ``k`` others of different objects with the lowest ids.

    At most ``k`` of a group's facts of lowest ids share the probe's object once each object keeps its first ``k``, so the
    first ``2 k`` of those hold all that any probe needs: they go to the group's probes as one array, and the pairs are not sent.
    """
    rows = facts.select(F.lower("subject").alias("ls"), F.lower("predicate").alias("lp"), F.struct("fact_id", "object_value", "provenance_text").alias("x"), F.col("superseded_by").isNull().alias("open")).where("ls is not null and lp is not null and x.object_value is not null")
    of_object = F.row_number().over(W.partitionBy("ls", "lp", F.lower("x.object_value")).orderBy("x.fact_id"))
    first = rows.where("open").withColumn("n", of_object).where(F.col("n") <= k)
    of_group = F.row_number().over(W.partitionBy("ls", "lp").orderBy("x.fact_id"))
    first = first.withColumn("n", of_group).where(F.col("n") <= 2 * k).groupBy("ls", "lp").agg(F.array_sort(F.collect_list("x")).alias("first"))
    meets = lambda o: (o["fact_id"] != F.col("x.fact_id")) & (F.lower(o["object_value"]) != F.lower("x.object_value"))
    return rows.join(first, ["ls", "lp"]).select(F.col("x").alias("p"), F.explode(F.slice(F.filter("first", meets), 1, k)).alias("o"))


def _named(df: DataFrame, kind: str) -> DataFrame:
    winner, confidence = evidence(F.col("p.provenance_text"), F.col("o.provenance_text"))
    return df.select(F.col("p.fact_id").alias("fact_id"), F.col("o.fact_id").alias("conflicting_fact_id"), F.lit(kind).alias("conflict_type"),
                     F.round("similarity", 4).alias("similarity"), winner.alias("stronger"), F.round(confidence, 4).alias("evidence_confidence"))


def temporal(facts: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    return _named(similar(facts, k, threshold), "temporal")


def exclusive(facts: DataFrame, k: int = 10) -> DataFrame:
    """Contradicting objects; of more than ``k`` candidates those with the lowest ids, as the order is free."""
    some = lowest(facts, k).withColumn("similarity", F.lit(None).cast("double"))
    return _named(some.where(contradicts(F.col("p.object_value"), F.col("o.object_value"))), "mutually_exclusive")


def granularity(facts: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    a, b = F.lower("p.object_value"), F.lower("o.object_value")
    near = similar(facts, k, threshold)
    return _named(near.where(F.contains(a, b) | F.contains(b, a)), "granularity")


def detect(facts: DataFrame, threshold: float = 0.8, k: int = 5, k_exclusive: int = 10) -> DataFrame:
    """Conflicts of all three types; temporal and granularity conflicts come from one join by similarity."""
    a, b = F.lower("p.object_value"), F.lower("o.object_value")
    near = similar(facts, k, threshold)
    kinds = F.array_compact(F.array(F.lit("temporal"), F.when(F.contains(a, b) | F.contains(b, a), F.lit("granularity"))))
    winner, confidence = evidence(F.col("p.provenance_text"), F.col("o.provenance_text"))
    close = near.select("p", "o", "similarity", F.explode(kinds).alias("conflict_type")).select(
        F.col("p.fact_id").alias("fact_id"), F.col("o.fact_id").alias("conflicting_fact_id"), "conflict_type", F.round("similarity", 4).alias("similarity"), winner.alias("stronger"), F.round(confidence, 4).alias("evidence_confidence"))
    return close.unionByName(exclusive(facts, k_exclusive))


def resolve(conflicts: DataFrame) -> DataFrame:
    """Supersede the other fact where the probe's evidence is the stronger."""
    return conflicts.withColumn("action", F.when(F.col("stronger") == "first", "supersede").otherwise("log"))


def supersede(facts: DataFrame, threshold: float | None = None, k: int = 10) -> DataFrame:
    """(fact_id, superseded_by): facts that a newer one of the same subject and predicate replaces.

    Newer is by coalesce(valid_from, observed_at); at equal times the larger id.  With a threshold only the ``k`` most similar
    candidates at least that similar count; without one each fact is replaced by its next newer one.
    """
    when = lambda x: F.struct(F.col(f"{x}.t").alias("t"), F.col(f"{x}.fact_id").alias("id"))
    if threshold is None:
        order = W.partitionBy(F.lower("subject"), F.lower("predicate")).orderBy(F.coalesce("valid_from", "observed_at"), "fact_id")
        return facts.select("fact_id", F.lead("fact_id").over(order).alias("superseded_by")).where("superseded_by is not null")
    near = similar(facts, k, threshold).where(when("p") < when("o"))
    return near.groupBy(F.col("p.fact_id").alias("fact_id")).agg(F.min_by(F.col("o.fact_id"), when("o")).alias("superseded_by"))


def resolutions(conflicts: DataFrame) -> DataFrame:
    """The log of resolved conflicts: (fact_id, conflicting_fact_id, conflict_type, evidence_comparison, status, resolution_text)."""
    action = resolve(conflicts)
    text = F.when(F.col("action") == "supersede", "supersede=True").otherwise("keep_both")
    return action.select("fact_id", "conflicting_fact_id", "conflict_type", F.col("stronger").alias("evidence_comparison"), F.lit("resolved").alias("status"), text.alias("resolution_text"))


def applied(facts: DataFrame, log: DataFrame) -> DataFrame:
    """``facts`` after the log's resolutions: a superseded fact names the fact that replaces it; of several the one of the largest id, which is resolved last."""
    by = log.where("resolution_text = 'supersede=True'").groupBy(F.col("conflicting_fact_id").alias("_id")).agg(F.max("fact_id").alias("_by"))
    joined = facts.join(by, F.col("fact_id") == F.col("_id"), "left")
    return joined.withColumn("superseded_by", F.coalesce("_by", "superseded_by")).select(*facts.columns)
