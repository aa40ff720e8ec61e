"""Structured Streaming over event files; each query ends when all files are read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import jobs
from millrace.storage import new_path


BATCH = "__batch"  # column of a batch's number


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files below ``path``, oldest first; the schema is that of the files now there."""
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    return (source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source).parquet(path)


STEP = "job_id long, seq long, status string, old_status string, legal boolean, attempt long"


def checked_transitions(events: DataFrame) -> DataFrame:
    """The steps of jobs (job_id, seq, status) as they arrive, each with the status before it, whether it is legal, and the attempt.

    The state of a job is its last status and its number of attempts; rows of one batch are taken
    in order of seq, and batches have to arrive in that order.
    """
    allowed, resumable = {k: set(v) for k, v in jobs.ALLOWED.items()}, set(jobs.RESUMABLE)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old, attempt = state.get if state.exists else (None, 0)
        rows = pd.concat(batches).sort_values("seq", kind="stable")
        out = []
        for seq, status in zip(rows["seq"].tolist(), rows["status"].tolist(), strict=True):
            legal = status == "PENDING" if old is None else status in allowed[old]
            attempt += status == "RUNNING" and old in resumable
            out.append((key[0], seq, status, old, legal, attempt))
            old = status
        state.update((old, attempt))
        yield pd.DataFrame(out, columns=["job_id", "seq", "status", "old_status", "legal", "attempt"])

    steps = events.select("job_id", "seq", "status").groupBy("job_id")
    return steps.applyInPandasWithState(step, STEP, "status string, attempt long", "append", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each event once, however often it arrives within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, width: str = "1 day", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Events and summed value of each window and type."""
    w = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over what is there now and read the result; the checkpoint is in the shared folder.

    Each batch has its own folder, so one that runs again after a restart replaces itself.  In
    mode ``complete`` only the last batch counts.
    """
    spark = df.sparkSession
    out, state = new_path(spark, "stream"), new_path(spark, "stream-state")

    spark.createDataFrame([], df.schema).write.parquet(f"{out}/{BATCH}=-1")  # a stream without files has a result, too

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{BATCH}={number}")

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return read_batches(spark, out, df.schema, mode)


def read_batches(spark: SparkSession, out: str, schema: T.StructType, mode: str = "append") -> DataFrame:
    """The result of the batches below ``out``: all rows, or those of the last batch in mode ``complete``."""
    found = spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(out)
    if mode == "complete":
        found = found.where(F.col(BATCH) == found.agg(F.max(BATCH)).first()[0])
    return found.drop(BATCH)
