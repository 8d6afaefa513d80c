"""Job, event and ingestion monitoring over event logs, always at a stated time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recent(events: DataFrame, as_of: str, hours: int) -> DataFrame:
    now = F.to_timestamp(F.lit(as_of))
    return events.where((F.col("ts").cast("timestamp") > now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts").cast("timestamp") <= now))


def jobs_summary(events: DataFrame, as_of: str) -> DataFrame:
    """Per job: events, errors, events of the last 24 hours, status by the newest event."""
    now = F.to_timestamp(F.lit(as_of))
    inside = (F.col("ts").cast("timestamp") > now - F.expr("INTERVAL 24 HOURS")) & (F.col("ts").cast("timestamp") <= now)
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return events.groupBy(F.col("user_id").alias("job")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"),
                                                             F.count_if(inside).alias("events_24h"), F.when(last == "error", "error").otherwise("success").alias("status"))


def dashboard(jobs: DataFrame, total: int) -> DataFrame:
    """One row: jobs by status, progress of ``total``, what remains."""
    n = F.count(F.lit(1))
    return jobs.agg(n.alias("jobs"), F.count_if(F.col("status") == "error").alias("failed"), F.count_if(F.col("status") == "success").alias("done"),
                    F.round(100.0 * n / total, 2).alias("progress_pct"), F.greatest(F.lit(0), F.lit(total) - n).alias("remaining"))


def pending(source: DataFrame, synced: DataFrame, key: list[str], min_chars: int = 25) -> DataFrame:
    """Source rows long enough and not synchronised yet."""
    return source.where(F.length(F.trim("text")) >= min_chars).join(synced.select(*key).distinct(), key, "left_anti")


def job_runs(events: DataFrame, end: str = "purchase", failed: str = "error") -> DataFrame:
    """(event_id, job, status, duration_s, message): each event of a job with the time since the one before; 'running' until it ends or fails.

    Messages are cut at 500 characters where the run failed, else at 200.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    status = F.when(F.col("event_type") == failed, "error").when(F.col("event_type") == end, "success").otherwise("running")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))) / F.lit(1e6)
    return events.select("event_id", F.col("user_id").alias("job"), status.alias("status"), seconds.alias("duration_s"), F.when(status == "error", F.substring("props", 1, 500)).otherwise(F.substring("props", 1, 200)).alias("message"))


def events_with_jobs(events: DataFrame, jobs: DataFrame, k: int) -> DataFrame:
    """The newest ``k`` events with the status of their job, null where it has none."""
    return events.withColumnRenamed("user_id", "job").join(jobs.select("job", "status"), "job", "left").orderBy(F.desc("ts"), F.desc("event_id")).limit(k)


def progress(events: DataFrame, as_of: str, initial: int, total: int) -> DataFrame:
    """One row: done, added since ``initial``, rate an hour, what remains of ``total`` and the hours it takes."""
    done = F.count(F.lit(1))
    hours = (F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(3600e6)
    out = events.agg(done.alias("done"), (done - initial).alias("added"), F.greatest(F.lit(0), F.lit(total) - done).alias("remaining"), hours.alias("hours"))
    rate = F.when(F.col("added") > 0, F.try_divide(F.col("added").cast("double"), F.col("hours"))).otherwise(F.lit(0.0))
    return out.select("done", "added", "remaining", F.round(rate, 4).alias("per_hour"), F.round(F.when(rate > 0, F.col("remaining") / rate).otherwise(F.lit(0.0)), 4).alias("eta_hours"))


def reconcile(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """(name, source_rows, target_rows, matches) of the tables named in either."""
    out = None
    for name in sorted(source.keys() | target.keys()):
        for side, tables in (("source_rows", source), ("target_rows", target)):
            if name in tables:
                n = tables[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(side).alias("side"), "n")
                out = n if out is None else out.unionByName(n)
    count = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0))
    return out.groupBy("name").agg(count("source_rows").alias("source_rows"), count("target_rows").alias("target_rows")).withColumn("matches", F.col("source_rows") == F.col("target_rows"))


def to_embed(chunks: DataFrame) -> DataFrame:
    """Chunks without a vector whose content is not blank."""
    return chunks.where(F.col("embedding").isNull() & (F.length(F.trim("content")) > 0))
