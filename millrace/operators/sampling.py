"""Sampling, shuffles and splits by hash rank: reproducible, and without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import seeded, unit_interval


def hash_rank(df: DataFrame, key: str, seed: int | str, groups: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Rank (from 1) of each row in hash order within its group.

    Rows are ranked within 4,096 ranges of the hash and the sizes of lower ranges are added, so
    a single group, or a group with most rows, is spread over tasks.
    """
    groups = groups or []
    d = df.withColumn("_hash", seeded(seed, F.col(key))).withColumn("_range", F.substring("_hash", 1, 3))
    keys = [*groups, "_range"]
    sizes = d.groupBy(*keys).agg(F.count("*").alias("_n"))
    lower = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*keys, F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_base"))
    ranked = d.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy("_hash", key)))
    return ranked.join(bases, keys).withColumn(name, (F.col("_base") + F.col("_row")).cast("long")).select(*df.columns, name)


def sample_per_group(df: DataFrame, key: str, limit: int, seed: int | str, groups: list[str] | None = None) -> DataFrame:
    """At most ``limit`` rows of each group, uniformly."""
    return hash_rank(df, key, seed, groups).where(F.col("rank") <= limit).drop("rank")


def repeat_to(df: DataFrame, key: str, quotas: DataFrame, on: list[str], seed: int | str, cap: int | None = None) -> DataFrame:
    """Rows of each group repeated up to its quota: whole passes, then part of one; copy_no counts from 1.

    ``quotas`` has the columns ``on`` and ``quota``.  Repeats of two rows differ by one at most.
    A quota beyond ``cap`` times the group's size raises an error.
    """
    sizes = df.groupBy(*on).agg(F.count("*").alias("_size"))
    planned = quotas.join(sizes, on)
    if cap is not None:
        fits = F.when(F.col("quota") <= F.col("_size") * cap, F.col("quota")).otherwise(F.raise_error(F.lit("quota exceeds the cap on repeats")).cast("long"))
        planned = planned.withColumn("quota", fits)
    ranked = hash_rank(df, key, seed, on).join(planned, on)
    copies = F.floor(F.col("quota") / F.col("_size")) + (F.col("rank") <= F.col("quota") % F.col("_size")).cast("long")
    out = ranked.withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return out.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_size", "quota", "rank")


def cut_split(df: DataFrame, key: str, seed: int | str, fractions: list[tuple[str, float]], rest: str) -> DataFrame:
    """Groups named by ``key`` dealt to splits of round(n * fraction) each, in the order given, the others to ``rest``."""
    groups = hash_rank(df.select(key).distinct(), key, seed)
    total = groups.agg(F.count("*").alias("_n"))
    cut, split = F.lit(0.0), None
    for name, fraction in fractions:
        cut = cut + F.bround(F.col("_n") * F.lit(fraction), 0)
        split = F.when(F.col("rank") <= cut, name) if split is None else split.when(F.col("rank") <= cut, name)
    assigned = groups.join(F.broadcast(total)).select(key, split.otherwise(rest).alias("split"))  # one row
    return df.join(assigned, key)


def hash_split(key: Column, seed: int, fraction: float) -> Column:
    """``val`` for a fixed share of keys, stable when data grows."""
    return F.when(unit_interval(seeded(seed, key)) < fraction, "val").otherwise("train")


def even_strata(df: DataFrame, key: str, strata: int, rows: int, seed: int | str) -> DataFrame:
    """The first ``rows`` of each of ``strata`` equal parts of the order by hash."""
    ranked = hash_rank(df, key, seed)
    total = ranked.agg(F.count("*").alias("_n"))
    at = F.floor((F.col("rank") - 1) * strata / F.col("_n"))
    placed = ranked.join(F.broadcast(total)).withColumn("stratum", at.cast("long"))  # one row
    first = F.ceil(F.col("stratum") * F.col("_n") / strata)
    return placed.withColumn("offset", (F.col("rank") - 1 - first).cast("long")).where(F.col("offset") < rows).drop("_n", "rank")
