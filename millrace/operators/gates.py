"""Quality gates: PASS, REVIEW or FAIL from a table of metrics, and contracts on row sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses in order of severity.
STATUSES = ("PASS", "REVIEW", "FAIL")


def check_status(rule: Column, observed: Column, threshold: Column, review: Column) -> Column:
    """Status of one check.  ``review_if_below`` passes from ``review`` up, and reviews from ``threshold`` up."""
    two = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")
    return (
        F.when(rule == "max", two(observed <= threshold))
        .when(rule == "min", two(observed >= threshold))
        .when(rule == "equal", two(observed.eqNullSafe(threshold)))
        .when(rule == "review_if_below", F.when(observed >= review, "PASS").when(observed >= threshold, "REVIEW").otherwise("FAIL"))
    )


def worst(status: str = "status") -> Column:
    """The most severe status of a group; a group without checks is in review."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col(status))
    return F.coalesce(F.get(F.array(*map(F.lit, STATUSES)), (F.max(rank) - 1).cast("int")), F.lit("REVIEW"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def leakage(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that stand in several splits; one partial aggregation, no self-join."""
    return df.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


#: Levels of acceptance in their order.
LEVELS = ("G0", "G1", "G2", "G3", "G4", "G5", "G6", "G7")


def release(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What the checks (level, status) allow: ``status``, the first level that fails, and a decision.

    Any failure blocks, a level without checks or in review allows an experiment only, and eight
    passing levels allow to publish.
    """
    out = checks.groupBy(*(by or [])).agg(
        worst().alias("worst"),
        F.count_distinct(F.when(F.col("level").isin(*LEVELS), F.col("level"))).alias("n_levels"),
        F.min(F.when(F.col("status") == "FAIL", F.col("level"))).alias("blocked_by"),
    )
    status = F.when((F.col("worst") == "PASS") & (F.col("n_levels") < len(LEVELS)), "REVIEW").otherwise(F.col("worst"))
    decision = F.when(F.col("status") == "FAIL", "blocked").when(F.col("status") == "REVIEW", "experiment").otherwise("publish")
    return out.withColumn("status", status).withColumn("decision", decision).drop("worst")


def require_empty(df: DataFrame, message: str) -> None:
    """Raise if a gate found any row."""
    if rows := df.limit(5).collect():
        raise ValueError(f"{message}: {rows}")
