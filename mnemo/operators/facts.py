"""Bi-temporal facts: active view, decay, feedback, gating, ranking."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemo.functions.expressions import DEFAULT_DECAY, cosine, salience_now

FREQUENCY = 3
MULTIPLIERS = {"approval": 1.3, "rebuttal": 0.5}


def as_time(as_of: str) -> Column:
    return F.to_timestamp(F.lit(as_of))


def is_active(as_of: str) -> Column:
    return F.col("superseded_by").isNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > as_time(as_of))) & (F.col("status") != "inactive")


def active_facts(facts: DataFrame, as_of: str) -> DataFrame:
    """The active facts with ``salience_now``; one conditional pass, no self join."""
    since = F.coalesce("last_accessed_at", "observed_at")
    return facts.where(is_active(as_of)).withColumn("salience_now", salience_now(F.col("salience"), F.col("decay_rate"), since, as_time(as_of)))


def facts_at(facts: DataFrame, t: str) -> DataFrame:
    """Facts valid at ``t``: valid_from <= t < valid_to."""
    at = as_time(t)
    return facts.where((F.coalesce("valid_from", "observed_at") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def rank_facts(facts: DataFrame, query: list[float] | None, as_of: str, k: int, text: str = "") -> DataFrame:
    """Top-k active facts by decayed salience times similarity; by text where there is no query vector."""
    live = active_facts(facts, as_of)
    if query is None:
        return live.where(matches(text)).orderBy(F.desc("salience_now"), F.desc("observed_at"), "fact_id").limit(k)
    sim = cosine(F.col("embedding"), F.array(*map(F.lit, query)))
    scored = live.where(F.col("embedding").isNotNull()).withColumn("similarity", sim)
    return scored.withColumn("score", F.col("salience_now") * F.col("similarity")).orderBy(F.desc("score"), "fact_id").limit(k)


def matches(text: str, columns: tuple[str, ...] = ("subject", "predicate", "object_value", "provenance_text")) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return out


def schema_gate(facts: DataFrame, least: int = FREQUENCY) -> DataFrame:
    """Each use of a predicate with its running frequency; linked from the ``least``-th on.

    Uses are numbered inside each hour and shifted by the counts of the hours before, so a frequent predicate is
    spread over as many tasks as it has hours.  Facts without a time come first.
    """
    hour = F.coalesce(F.date_trunc("hour", "observed_at"), F.to_timestamp(F.lit("0001-01-01 00:00:00")))
    timed = facts.withColumn("__hour", hour)
    own = F.row_number().over(W.partitionBy("predicate", "__hour").orderBy("observed_at", "fact_id"))
    before = W.partitionBy("p").orderBy("h").rowsBetween(W.unboundedPreceding, -1)
    shift = timed.groupBy(F.col("predicate").alias("p"), F.col("__hour").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    shift = shift.select("p", "h", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shift"))
    out = timed.withColumn("__own", own).join(shift, F.col("predicate").eqNullSafe(F.col("p")) & (F.col("__hour") == F.col("h")))
    n = F.col("__own") + F.col("__shift")
    return out.select(*facts.columns, n.cast("long").alias("frequency"), (n >= least).alias("linked"))


def schema_status(facts: DataFrame, least: int = FREQUENCY) -> DataFrame:
    n = F.count(F.lit(1))
    return facts.groupBy("predicate").agg(n.alias("frequency")).withColumn("status", F.when(F.col("frequency") >= least, "stable").otherwise("candidate"))


def fold_feedback(facts: DataFrame, feedback: DataFrame) -> DataFrame:
    """(fact_id, salience, reinforced): signals in order of time, each decaying first, rounded to 4 at each write.

    Neutral and unknown signals change nothing; a null rate or salience has its default.  Each fact with feedback gives a row.
    The rounding makes the fold sequential, so a fact's signals stream through one task in order of time; only the state of one fact is held.
    """
    base = facts.select("fact_id", F.coalesce(F.col("salience").cast("double"), F.lit(1.0)).alias("salience"), F.coalesce(F.col("decay_rate").cast("double"), F.lit(DEFAULT_DECAY)).alias("decay"), F.unix_micros("observed_at").alias("observed"))
    log = feedback.select("fact_id", F.unix_micros("ts").alias("ts"), "signal")
    rows = base.join(log, "fact_id").repartition("fact_id").sortWithinPartitions("fact_id", "ts", "signal")

    def fold(batches):
        state = None
        for batch in batches:
            done = []
            for fact, salience, decay, observed, ts, signal in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != fact:
                    if state is not None:
                        done.append(state)
                    state = [fact, salience, 0, observed if observed is not None else ts]
                if signal in MULTIPLIERS:
                    age = 0 if ts is None or state[3] is None else ts - state[3]
                    decayed = max(0.0, min(1.0, state[1] * math.exp(-decay * age / 86400e6)))
                    state[1] = math.floor(max(0.0, min(1.0, decayed * MULTIPLIERS[signal])) * 1e4 + 0.5) / 1e4
                    state[2] += signal == "approval"
                    state[3] = ts
            yield _folded(done)
        if state is not None:
            yield _folded([state])

    return rows.mapInArrow(fold, "fact_id long, salience double, reinforced long")


def _folded(states: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s[k] for s in states], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], ["fact_id", "salience", "reinforced"])


def created(rows: DataFrame, as_of: str, *more: str) -> DataFrame:
    """New facts from (fact_id, subject, predicate, object_value, provenance_text, observed_at): pending, without a vector, observed now where no time is given.

    ``more`` names further columns of ``rows`` to keep.
    """
    at = F.coalesce(F.col("observed_at").cast("timestamp"), as_time(as_of))
    return rows.select("fact_id", "subject", "predicate", "object_value", F.substring("provenance_text", 1, 1000).alias("provenance_text"), at.alias("observed_at"), at.alias("valid_from"), F.lit("pending").alias("status"),
                       F.concat_ws(" ", "subject", "predicate", "object_value").alias("to_embed"), F.lit(None).cast("array<float>").alias("embedding"), *more)


def passages(rows: DataFrame) -> DataFrame:
    """New passages from (passage_id, text): active, their provenance being the beginning of the text."""
    return rows.select("passage_id", F.col("text").alias("passage_text"), F.substring("text", 1, 500).alias("provenance_text"), F.lit("active").alias("status"))


def bridges(facts: DataFrame, least: int = FREQUENCY) -> DataFrame:
    """(fact_id, passage, kind, weight): a link of each fact whose predicate is stable to its evidence; repeated ones stay."""
    return schema_gate(facts, least).where("linked").select("fact_id", F.col("provenance_text").alias("passage"), F.lit("supported_by").alias("kind"), F.lit(1.0).alias("weight"))


def touched(facts: DataFrame, accesses: DataFrame) -> DataFrame:
    """(fact_id, access_count) from a log of accessed fact_ids; the decay clock is left alone."""
    n = accesses.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n"))
    return facts.select("fact_id").join(n, "fact_id", "left").select("fact_id", F.coalesce("n", F.lit(0)).cast("long").alias("access_count"))
