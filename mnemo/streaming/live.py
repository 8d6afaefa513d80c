"""Streaming twins: windowed event counts, folds in order of event time, and the incremental folder and memory syncs."""

from __future__ import annotations

import heapq
import math
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.functions.expressions import DEFAULT_DECAY
from mnemo.operators.facts import MULTIPLIERS


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "48 hours") -> DataFrame:
    """Events per type and window; rows later than ``late`` are left out explicitly by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def watch_folder(spark: SparkSession, root: str, pattern: str = "*", within: str = "7 days") -> DataFrame:
    """A stream of new files below ``root``; the checkpoint remembers which were seen.

    Copies are found by their content among the files changed within ``within`` of each other, so the state stays bounded; ``sync`` by
    ``content_hash`` finds older ones.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.withColumn("content_hash", F.sha2("content", 256)).withWatermark("modificationTime", within).dropDuplicatesWithinWatermark(["content_hash"])


def sync(source: DataFrame, target_path: str, key: list[str], checkpoint: str):
    """Append rows whose key is not in the target yet, once for all that is available."""
    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(target_path).select(*key)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = batch.select(*key).limit(0)
        batch.dropDuplicates(key).join(known, key, "left_anti").write.mode("append").parquet(target_path)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Rows of a key that are sorted in memory at once, and rows that are read, written and folded at once.
SORTED, ROWS = 100_000, 10_000


def spooled(rows: Iterable[tuple]) -> Callable[[], Iterator[list[tuple]]]:
    """Writes ``rows`` to a file of the task, from which they are read in lists."""
    file, rows = tempfile.TemporaryFile(), iter(rows)
    while some := list(islice(rows, ROWS)):
        pickle.dump(some, file, pickle.HIGHEST_PROTOCOL)
    end = file.tell()

    def read():
        file.seek(0)
        while file.tell() < end:
            yield pickle.load(file)
        file.close()

    return read


def sorted_by(rows: Iterable[tuple], key: Callable) -> Iterator[tuple]:
    """``rows`` in order of ``key``; more than ``SORTED`` of them are sorted in runs, which lie in files of the task until they are merged."""
    rows, runs = iter(rows), []
    while run := list(islice(rows, SORTED)):
        run.sort(key=key)
        if not runs and len(run) < SORTED:
            return iter(run)
        runs.append(spooled(run))
    return heapq.merge(*(chain.from_iterable(read()) for read in runs), key=key)


def in_order(rows: DataFrame, by: str, time: str, order: str, start: tuple, state: str, step: Callable, output: str, late: str) -> DataFrame:
    """Fold the rows of each key in order of ``time``, then of the column ``order``, whatever order they come in.

    Rows wait in keyed state until the watermark, ``late`` behind the newest time seen, has passed their time; a timer then folds those that are due:
    ``step(state, row)`` gives the new state and an output row.  ``state`` and ``output`` are schemas, ``start`` the first state.  Rows later than ``late`` are left out by the
    watermark; a row without a time is folded as if it had the watermark's.  Rows whose ``order`` is null only move the watermark.  Rows pass in batches, and those of a
    frequent key are sorted in runs on disk, so a task holds no more than ``SORTED`` rows, whatever their number.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    columns = rows.columns
    kinds = dict(rows.dtypes)
    waiting_schema = ", ".join(f"{c} {'long' if c == time else kinds[c]}" for c in columns if c != by)
    names = [c for c in columns if c != by]
    at, place = names.index(time), names.index(order)
    made_names = [c.split()[0] for c in output.split(", ")]

    class Fold(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.now = handle.getValueState("now", state)
            self.waiting = handle.getListState("waiting", waiting_schema)

        def handleInputRows(self, key, rows, timerValues):
            mark, first = timerValues.getCurrentWatermarkInMs(), None
            for pdf in rows:
                pdf = pdf[pdf[order].notna().to_numpy()]
                if not len(pdf):
                    continue
                times = pdf[time]
                micros = np.where(times.isna().to_numpy(), mark * 1000, times.to_numpy("datetime64[us]").astype(np.int64))
                new = list(zip(*((micros if c == time else pdf[c]).tolist() for c in names), strict=True))
                for lo in range(0, len(new), ROWS):
                    self.waiting.appendList(new[lo:lo + ROWS])
                first = int(micros.min()) if first is None else min(first, int(micros.min()))
            if first is not None:
                self.handle.registerTimer(max(mark + 1, first // 1000 + 1))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            mark, later, rest = timerValues.getCurrentWatermarkInMs(), [], []

            def due():
                for r in self.waiting.get():
                    if r[at] // 1000 < mark:
                        yield tuple(r)
                    else:
                        later.append(tuple(r))
                        if len(later) == SORTED:
                            rest.append(spooled(later))
                            later.clear()

            ordered = sorted_by(due(), lambda r: (r[at], r[place]))
            self.waiting.clear()
            first = None
            for some in chain(*(read() for read in rest), [later]):
                for lo in range(0, len(some), ROWS):
                    self.waiting.appendList(some[lo:lo + ROWS])
                first = min(([] if first is None else [first]) + [r[at] for r in some], default=None)
            if first is not None:
                self.handle.registerTimer(first // 1000 + 1)
            now, changed = (tuple(self.now.get()) if self.now.exists() else start), False
            while some := list(islice(ordered, ROWS)):
                made = []
                for row in some:
                    now, out = step(now, dict(zip(names, row, strict=True)))
                    made.append((key[0], *out))
                changed = True
                yield pd.DataFrame(made, columns=made_names)
            if changed:
                self.now.update(now)

        def close(self):
            pass

    timed = rows.withWatermark(time, late)
    return timed.groupBy(by).transformWithStateInPandas(statefulProcessor=Fold(), outputStructType=output, outputMode="Append", timeMode="EventTime")


def schema_gate(facts: DataFrame, least: int = 3, late: str = "2 days") -> DataFrame:
    """(predicate, fact_id, frequency, linked) of a stream of facts (predicate, fact_id, observed_at): uses of a predicate numbered in order of time, linked from the ``least``-th on."""
    def step(now, row):
        n = now[0] + 1
        return (n,), (row["fact_id"], n, n >= least)

    return in_order(facts.select("predicate", "fact_id", "observed_at"), "predicate", "observed_at", "fact_id", (0,), "n long", step, "predicate string, fact_id long, frequency long, linked boolean", late)


def salience(feedback: DataFrame, late: str = "2 days", decay: float = DEFAULT_DECAY) -> DataFrame:
    """(fact_id, feedback_id, ts, salience, reinforced) after each signal of a stream (fact_id, feedback_id, ts, signal), folded in order of time.

    A fact starts with salience 1 at its first signal; a signal decays what there is, approval and rebuttal multiply it, and the result is rounded to 4 digits; other signals change nothing.
    """
    def step(now, row):
        value, reinforced, since = now
        ts, signal = row["ts"], row["signal"]
        since = since or ts
        if signal in MULTIPLIERS:
            decayed = max(0.0, min(1.0, value * math.exp(-decay * (ts - since) / 86400e6)))
            value = math.floor(max(0.0, min(1.0, decayed * MULTIPLIERS[signal])) * 1e4 + 0.5) / 1e4
            reinforced, since = reinforced + (signal == "approval"), ts
        return (value, reinforced, since), (row["feedback_id"], ts, value, reinforced)

    out = in_order(feedback.select("fact_id", "feedback_id", "ts", "signal"), "fact_id", "ts", "feedback_id", (1.0, 0, 0), "value double, reinforced long, since long", step, "fact_id long, feedback_id long, micros long, salience double, reinforced long", late)
    return out.select("fact_id", "feedback_id", F.timestamp_micros("micros").alias("ts"), "salience", "reinforced")


STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which keyed state with timers needs."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def closing(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` and what ``close_stream`` writes to ``folder``: rows of nulls, but for the time that moves the watermark on."""
    spark = rows.sparkSession
    (spark._jvm.org.apache.hadoop.fs.Path(folder)).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(folder))


def close_stream(rows: DataFrame, time: str, folder: str, end: str = "2262-01-01 00:00:00") -> None:
    """Lets the watermark pass everything that waits; rows that come later are late."""
    kinds = {f.name: f.dataType for f in rows.schema}
    one = rows.sparkSession.range(1).select(*(F.to_timestamp(F.lit(end)).alias(c) if c == time else F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
    one.write.mode("append").parquet(folder)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is available, write it to ``path`` and read it back."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_closed(rows: DataFrame, time: str, fold: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Fold all of a stream that is available, close it and read what it wrote."""
    stream = fold(closing(rows, f"{path}/end"))
    with rocksdb(rows.sparkSession):
        run_once(stream, f"{path}/out", f"{path}/state")
        close_stream(rows, time, f"{path}/end")
        return run_once(stream, f"{path}/out", f"{path}/state")
