"""Memory of executors: Python workers, which Spark keeps for later stages, and the batches that go to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BATCH_BYTES = 2 << 20  # of an Arrow batch; it is held in the JVM and in the worker, both grow buffers by doubling
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def trim() -> None:
    """Give freed memory back to the system: that of Arrow's own allocator, and that of the C library where it can."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def small_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of the session exceed ``BATCH_BYTES`` by more than a row; a smaller limit stays."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over small batches; a task gives its memory back once ``run`` has ended and holds nothing."""
    small_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return df.mapInArrow(task, schema)
