"""Apportionment: exact quotas, budgets, recipes and sparse buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.sampling import hash_rank, repeat_to


def largest_remainder(weights: DataFrame, key: str, total: Column, within: list[str] | None = None) -> DataFrame:
    """``weights`` (key, weight) with quota: floors of total * weight / sum, and one more for the largest remainders.

    Ties go to the smaller key; the table has one row for each key.
    """
    w = Window.partitionBy(*(within or []))
    d = weights.withColumn("_exact", total * F.col("weight") / F.sum("weight").over(w)).withColumn("_floor", F.floor("_exact"))
    rank = F.row_number().over(w.orderBy((F.col("_floor") - F.col("_exact")), F.col(key)))
    extra = total - F.sum("_floor").over(w)
    return d.withColumn("_rank", rank).withColumn("_extra", extra).withColumn("quota", (F.col("_floor") + (F.col("_rank") <= F.col("_extra")).cast("long")).cast("long")).drop("_exact", "_floor", "_rank", "_extra")


def fixed_order(weights: DataFrame, key: str, total: int, order: list[str]) -> DataFrame:
    """Floors of total * weight; what is left goes to the first keys of a fixed order, one each."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(key))
    d = weights.withColumn("_floor", F.floor(total * F.col("weight"))).withColumn("_left", total - F.sum("_floor").over(Window.partitionBy()))
    return d.withColumn("quota", (F.col("_floor") + (place <= F.col("_left")).cast("long")).cast("long")).drop("_floor", "_left")


def plan_budget(rows: Column, ratio: float, batch: int) -> tuple[Column, Column]:
    """Exposures that let a source of ``rows`` at ``ratio`` be seen once, in whole batches, and the steps."""
    steps = F.ceil(rows / F.lit(ratio) / F.lit(batch))
    return (steps * batch).cast("long"), steps.cast("long")


def batch_plan(workers: list[int], micro: int, total: int, steps: int) -> list[tuple[int, int, int]]:
    """(workers, accumulation, exposures); a global batch that does not divide is an error."""
    out = []
    for n in workers:
        if total % (micro * n):
            raise ValueError(f"{total} is no multiple of {micro} * {n}")
        out.append((n, total // (micro * n), total * steps))
    return out


def merge_sparse(df: DataFrame, task: str, bucket: str, least: int, counted: Column | None = None) -> DataFrame:
    """``df`` with merged_bucket: a task with any raw bucket under ``least`` rows becomes ``task:T``, under that in all ``other``.

    Only rows where ``counted`` holds (all by default) are counted; buckets never counted become ``other``.
    """
    rows = df.where(counted) if counted is not None else df
    sizes = rows.groupBy(task, bucket).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(task)
    rule = F.when(F.min("_n").over(w) >= least, F.col(bucket)).when(F.sum("_n").over(w) >= least, F.concat(F.lit("task:"), F.col(task))).otherwise("other")
    named = sizes.select(task, bucket, rule.alias("merged_bucket"))
    return df.join(named, [task, bucket], "left").withColumn("merged_bucket", F.coalesce("merged_bucket", F.lit("other")))


def materialise_recipe(pool: DataFrame, key: str, sources: DataFrame, total: int, cap: int, seed: int) -> DataFrame:
    """Exposures of a recipe: source quotas, bucket quotas in each source by pool frequency, repeats under a cap.

    ``pool`` has source, bucket and ``key``; ``sources`` has source and weight.  The result has
    source, bucket, key, copy_no and exposure, a dense index in shuffled order.
    """
    quotas = largest_remainder(sources, "source", F.lit(total)).select("source", F.col("quota").alias("source_quota"))
    weights = pool.groupBy("source", "bucket").agg(F.count("*").alias("weight")).join(quotas, "source")
    buckets = largest_remainder(weights, "bucket", F.col("source_quota"), ["source"]).select("source", "bucket", "quota")
    rows = repeat_to(pool.select("source", "bucket", key), key, buckets, ["source", "bucket"], seed, cap)
    named = rows.withColumn("_copy", F.concat_ws("#", F.col(key).cast("string"), F.col("copy_no").cast("string")))
    return hash_rank(named, "_copy", seed, name="exposure").drop("_copy")
