"""Explicit-schema readers and writers that never overwrite."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON Lines; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_number (from 1 in each file) and value of every line of text files.

    Rows of a scan are counted within each block of a file; the lines of the blocks before it,
    one number for each block, are added.
    """
    at = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), at.alias("block"), F.monotonically_increasing_id().alias("row"))
    blocks = lines.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return lines.join(base, ["file", "block"]).select("file", (F.col("row") - F.col("first") + F.col("base") + 1).alias("line_number"), "value")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line_number, value, record and error (``invalid_json`` or null) of each line that is not blank.

    A value of a wrong type is no JSON error: its field is null.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    record = F.from_json("value", schema)
    broken = F.try_parse_json(F.col("value")).isNull()
    return lines.select("file", "line_number", "value", F.when(~broken, record).alias("record"), F.when(broken, "invalid_json").alias("error"))


def first_rows(df: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` rows of a Parquet scan in order of file and position."""
    placed = df.select(F.struct(*df.columns).alias("r"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return placed.orderBy("file", "at").limit(n).select("r.*")


def limited(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first ``n`` rows by ``order``, all if it is null, with ``complete``: whether no limit was set."""
    out = df if n is None else df.orderBy(*order).limit(n)
    return out.withColumn("complete", F.lit(n is None))


def footers(spark: SparkSession, path: str) -> DataFrame:
    """file, row_group, n_rows, n_bytes and columns of every row group of the Parquet files below ``path``, from their footers."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(file)
                with store.open_input_file(at) as f:
                    facts = pq.read_metadata(f)
                groups = [facts.row_group(k) for k in range(facts.num_row_groups)]
                n = len(groups)
                cols = [[file] * n, list(range(n)), [g.num_rows for g in groups], [g.total_byte_size for g in groups], [facts.schema.names] * n]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["file", "row_group", "n_rows", "n_bytes", "columns"])

    files = list_files(spark, path, "*.parquet").select("path")
    return files.mapInArrow(look, "file string, row_group int, n_rows long, n_bytes long, columns array<string>")


def with_blobs(df: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """``df`` with ``blob``, the content of the file that the column ``name`` names; ``files`` is a :func:`list_files`."""
    held = files.select(F.element_at(F.split("path", "/"), -1).alias("_file"), F.col("content").alias("blob"))
    return df.join(held, F.col(name) == F.col("_file"), "left").drop("_file")


def put_files(root: str, files: dict[str, bytes]) -> None:
    """Write small files below a folder, from the driver."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    for name, data in files.items():
        path = f"{base}/{name}"
        store.create_dir(path.rpartition("/")[0])
        with store.open_output_stream(path) as f:
            f.write(data)


def export_blobs(df: DataFrame, blob: str, suffix: str, path: str) -> DataFrame:
    """Write each different content once, as ``<SHA-256><suffix>`` below ``path``; gives ``df`` with its file ``name``.

    The folder must be new.  Copies meet by hash, their content is written by the executor that holds the first.
    """
    named = df.withColumn("name", F.concat(F.sha2(blob, 256), F.col(suffix)))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                put_files(path, {name: data})
            yield batch.select([0])

    once = named.where(F.col("name").isNotNull()).groupBy("name").agg(F.first(blob).alias("data"))
    once.mapInArrow(put, "name string").write.format("noop").mode("overwrite").save()
    return named


def read_documents(spark: SparkSession, path: str, schema: str | T.StructType, items: str) -> DataFrame:
    """One row for each item of a list in whole-file JSON documents."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode(items).alias("item")).select("item.*")


def with_provenance(df: DataFrame) -> DataFrame:
    """File name and row position of each row of a Parquet scan."""
    return df.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and content of files below a folder, by name pattern."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, rows_per_file: int = 0) -> None:
    """zstd Parquet with bounded files, committed at once or not at all."""
    w = df.write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_when_executed(df: DataFrame, path: str, execute: bool = False) -> dict:
    """Rows, columns and target of a write; only ``execute`` writes, and never over anything."""
    facts = {"rows": df.count(), "columns": df.columns, "path": path, "executed": execute}
    if execute:
        write_parquet(df, path)
    return facts


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))
