"""Job states from an append-only event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Allowed transitions of a job.
ALLOWED = {
    "PENDING": ("RUNNING", "SKIPPED"),
    "RUNNING": ("SUCCEEDED", "FAILED", "REVIEW", "STALE"),
    "FAILED": ("RUNNING",),
    "REVIEW": ("RUNNING",),
    "STALE": ("RUNNING",),
    "SUCCEEDED": (),
    "SKIPPED": (),
}
RESUMABLE = ("FAILED", "STALE", "REVIEW")


def checked_transitions(events: DataFrame) -> DataFrame:
    """``events`` (job_id, seq, status) with the previous status, whether the step is allowed, and the attempt."""
    w = Window.partitionBy("job_id").orderBy("seq")
    pairs = [f"{a}>{b}" for a, bs in ALLOWED.items() for b in bs]
    d = events.withColumn("old_status", F.lag("status").over(w))
    legal = F.coalesce(F.concat_ws(">", "old_status", "status").isin(*pairs), F.lit(False))
    d = d.withColumn("legal", F.when(F.col("old_status").isNull(), F.col("status") == "PENDING").otherwise(legal))
    retry = (F.col("status") == "RUNNING") & F.col("old_status").isin(*RESUMABLE)
    return d.withColumn("attempt", F.sum(F.coalesce(retry.cast("long"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def current_state(events: DataFrame) -> DataFrame:
    """The last status of each job."""
    return events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.count("*").alias("n_events"))


def stale(events: DataFrame, now, minutes: int) -> DataFrame:
    """Running jobs without an event for more than ``minutes``."""
    last = events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("ts").alias("ts"))
    return last.where((F.col("status") == "RUNNING") & (F.col("ts") < now - F.expr(f"interval {int(minutes)} minutes"))).select("job_id", "ts")
