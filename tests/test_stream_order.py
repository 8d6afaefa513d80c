import datetime as dt
import random

import pytest
from mnemo.operators import facts as batch
from mnemo.sources.shared import new_path
from mnemo.streaming import live
from pyspark.sql import functions as F

AT = dt.datetime(2024, 1, 1)
SCHEMA = "predicate string, fact_id long, observed_at timestamp"


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def write(spark, folder, rows, files=1):
    spark.createDataFrame(rows, SCHEMA).coalesce(files).write.mode("append").parquet(folder)


def expected(spark, rows):
    return sorted(map(tuple, batch.schema_gate(spark.createDataFrame(rows, SCHEMA)).select("predicate", "fact_id", "frequency", "linked").collect()))


def test_newest_first_in_one_file(spark):
    rows = [("p", k, AT + dt.timedelta(seconds=30_000 - k)) for k in range(30_000)]
    folder = new_path(spark, "facts")
    write(spark, folder, rows)
    got = {r["fact_id"]: (r["frequency"], r["linked"]) for r in live.run_closed(stream_of(spark, folder), "observed_at", live.schema_gate, new_path(spark, "s")).collect()}
    assert got == {k: (30_000 - k, k <= 29_997) for k in range(30_000)}


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 95])
def test_rows_are_sorted_in_runs(monkeypatch, n):
    monkeypatch.setattr(live, "SORTED", 10)
    monkeypatch.setattr(live, "ROWS", 3)
    rows = [(k * 7 % 19, k) for k in range(n)]
    held = []
    spool = live.spooled
    monkeypatch.setattr(live, "spooled", lambda x: held.append(len(x)) or spool(x))
    assert list(live.sorted_by(iter(rows), lambda r: r)) == sorted(rows)
    assert all(x <= 10 for x in held) and sum(held) == (n if n >= 10 else 0)


def test_a_task_holds_few_rows_of_a_frequent_key(spark):
    """More rows of one key than are sorted at once, the latest of which stay for later."""
    n = 250_000
    folder = new_path(spark, "facts")
    rows = spark.range(n).select(F.lit("p").alias("predicate"), F.col("id").alias("fact_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 7919 % n).alias("observed_at"))
    rows.coalesce(1).write.parquet(folder)
    out = live.run_closed(stream_of(spark, folder), "observed_at", lambda r: live.schema_gate(r, late="1 day"), new_path(spark, "s"))
    assert out.where(F.col("frequency") == F.col("fact_id") * 7919 % n + 1).count() == n


def test_files_in_any_order_and_a_restart(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), k, AT + dt.timedelta(minutes=rng.randrange(600))) for k in range(900)]
    first, second = rows[:500], rows[500:]
    folder, path = new_path(spark, "facts"), new_path(spark, "s")
    for k in range(0, 500, 100):
        write(spark, folder, first[k:k + 100])
    stream = live.schema_gate(live.closing(stream_of(spark, folder), f"{path}/end"), late="1 day")
    with live.rocksdb(spark):
        assert live.run_once(stream, f"{path}/out", f"{path}/state").count() == 0  # all wait for the watermark
        write(spark, folder, second, 2)
        late = ("a", 5000, AT + dt.timedelta(days=3))
        write(spark, folder, [late])
        early = live.run_once(stream, f"{path}/out", f"{path}/state")  # from the checkpoint; the watermark has passed the first day
        assert sorted(map(tuple, early.collect())) == expected(spark, rows)
        write(spark, folder, [("b", 6000, AT)])  # later than the watermark
        live.close_stream(stream_of(spark, folder), "observed_at", f"{path}/end")
        out = live.run_once(stream, f"{path}/out", f"{path}/state")
    assert sorted(map(tuple, out.collect())) == expected(spark, [*rows, late])


def test_salience_in_order(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(5), k, AT + dt.timedelta(minutes=at), rng.choice(["approval", "rebuttal", "neutral", None])) for k, at in enumerate(rng.sample(range(2400), 200))]
    schema = "fact_id long, feedback_id long, ts timestamp, signal string"
    folder = new_path(spark, "feedback")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(folder)
    out = live.run_closed(spark.readStream.schema(schema).parquet(folder), "ts", live.salience, new_path(spark, "s"))
    last = {r["fact_id"]: (r["v"]["salience"], r["v"]["reinforced"]) for r in out.groupBy("fact_id").agg(F.max_by(F.struct("salience", "reinforced"), F.struct("ts", "feedback_id")).alias("v")).collect()}
    base = spark.createDataFrame([(k, 1.0, None, min(r[2] for r in rows if r[0] == k)) for k in range(5)], "fact_id long, salience double, decay_rate double, observed_at timestamp")
    want = {r["fact_id"]: (r["salience"], r["reinforced"]) for r in batch.fold_feedback(base, spark.createDataFrame(rows, schema)).collect()}
    assert out.count() == 200 and last == want
