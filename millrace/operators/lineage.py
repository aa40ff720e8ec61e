"""Artifact registry and run contract over an append-only table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.storage import materialise


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces: equal content gives equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def content_hash(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def run_hash(manifest: dict) -> str:
    """Identity of a run: its time and notes do not count."""
    return content_hash({k: v for k, v in manifest.items() if k not in ("created_at", "notes")})


def job_key(value: object) -> str:
    """Short key of a job's inputs and settings."""
    return content_hash(value)[:16]


def directory_hash(files: DataFrame, root: str, ignored: tuple[str, ...] = ("_SUCCESS", "manifest.json", "stats.json")) -> DataFrame:
    """One hash of a folder from a ``binaryFile`` listing: of relative paths and content hashes in order of path."""
    name = F.element_at(F.split("path", "/"), -1)
    rel = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/") + "/", "")
    own = files.where(~name.isin(*ignored)).select(F.concat(rel, F.lit("\0"), F.sha2("content", 256)).alias("line"))
    return own.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\0"), 256).alias("directory_hash"), F.count("*").alias("n_files"))


def latest(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The last record of each key; one partial aggregation, no window."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(whole, order).alias("_r")).select("_r.*")


def register(existing: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, action) of each new artifact: insert, noop for the same content, collision for another."""
    have = existing.select(F.col(key), F.col(content).alias("_have")).distinct()
    action = F.when(F.col("_have").isNull(), "insert").when(F.col("_have") == F.col(content), "noop").otherwise("collision")
    return new.join(have, key, "left").select(key, action.alias("action"))


def ancestors(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, ancestor, depth): all ancestors of ``roots`` (id) over ``edges`` (child, parent), the least depth for each.

    Each step goes one edge up from what the step before has found and keeps what is new, so it
    ends at any depth, and in a cycle, where an id is its own ancestor.
    """
    up = edges.select(F.col("child").alias("_child"), F.col("parent").alias("_parent")).where("_parent is not null").distinct()
    depth = 1
    new = roots.select("id").distinct().join(up, F.col("id") == F.col("_child")).select("id", F.col("_parent").alias("ancestor"), F.lit(depth).cast("long").alias("depth"))
    found = new = materialise(new, "ancestors")
    while not new.isEmpty():
        depth += 1
        step = new.join(up, F.col("ancestor") == F.col("_child")).select("id", F.col("_parent").alias("ancestor")).distinct()
        new = materialise(step.join(found, ["id", "ancestor"], "left_anti").withColumn("depth", F.lit(depth).cast("long")), "ancestors")
        found = found.unionByName(new)
    return found


#: Fields that an artifact's manifest must fill, and the states it may have.
REQUIRED = ("artifact_id", "logical_name", "artifact_type", "uri", "dataset_version", "schema_version", "schema_hash", "content_hash", "producer_job_id", "config_hash", "code_commit", "environment_hash", "created_at")
COUNTS = ("row_count", "token_count", "byte_count")
STATES = ("PENDING", "RUNNING", "SUCCEEDED", "FAILED", "REVIEW")


def manifest_errors() -> Column:
    """All errors of a manifest row: fields that are null or empty, negative counts, an unknown state."""
    blank = [F.when(F.coalesce(F.col(c), F.lit("")) == "", f"empty:{c}") for c in REQUIRED]
    below = [F.when(F.col(c) < 0, f"negative:{c}") for c in COUNTS]
    state = F.when(~F.coalesce(F.col("status").isin(*STATES), F.lit(False)), "unsupported_status")
    return F.array_compact(F.array(*blank, *below, state))


def with_files(artifacts: DataFrame, uri: str = "uri") -> DataFrame:
    """``artifacts`` with ``on_disk``: its path exists, and if it is a folder, with a ``_SUCCESS`` marker.

    Paths are looked up on the executors; a null path does not exist.
    """
    names = artifacts.columns

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            there = []
            for path in batch.column(names.index(uri)).to_pylist():
                if path is None:
                    there.append(False)
                    continue
                store, at = fs.FileSystem.from_uri(path)
                kind = store.get_file_info(at).type
                there.append(kind == fs.FileType.File or (kind == fs.FileType.Directory and store.get_file_info(f"{at}/_SUCCESS").type == fs.FileType.File))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(there, pa.bool_())], [*names, "on_disk"])

    return artifacts.mapInArrow(look, T.StructType([*artifacts.schema.fields, T.StructField("on_disk", T.BooleanType())]))


def is_complete(artifacts: DataFrame, uri: str = "uri") -> DataFrame:
    """``artifacts`` (with status and complete) with ``is_complete``: succeeded, marked complete, and on disk."""
    done = (F.col("status") == "SUCCEEDED") & F.col("complete") & F.col("on_disk")
    return with_files(artifacts, uri).withColumn("is_complete", F.coalesce(done, F.lit(False))).drop("on_disk")
