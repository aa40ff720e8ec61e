"""Learning dynamics over ordered observations: transitions, deltas, gains, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transition(before: Column, now: Column) -> Column:
    """Label of a step between two observations; null is not scored, never false."""
    return (
        F.when(now.isNull(), "not_scored")
        .when(before.isNull(), "first_observation")
        .when(before & ~now, "forgotten")
        .when(~before & now, "learned")
        .when(now, "stable_correct")
        .otherwise("stable_wrong")
    )


def loss_change(before: Column, now: Column, steps: Column) -> dict[str, Column]:
    """Delta, gain, relative gain and delta per step; null without a predecessor, the relative gain also for one of 0."""
    delta = now - before
    return {
        "delta": F.round(delta, 6),
        "gain": F.round(-delta, 6),
        "relative_gain": F.when(before > 0, F.round(F.try_divide(-delta, before), 6)),
        "delta_per_step": F.round(F.try_divide(delta, steps.cast("double")), 9),
    }


def with_transitions(history: DataFrame) -> DataFrame:
    """``history`` (sample_id, round, correct) with the label of each step."""
    w = Window.partitionBy("sample_id").orderBy("round")
    return history.withColumn("transition", transition(F.lag("correct").over(w), F.col("correct")))


def event_counts(history: DataFrame) -> DataFrame:
    """Forgetting and learning events of each sample; null where it was never scored."""
    scored = F.count("correct") > 0
    return with_transitions(history).groupBy("sample_id").agg(
        F.when(scored, F.count_if(F.col("transition") == "forgotten")).alias("forgetting_count"),
        F.when(scored, F.count_if(F.col("transition") == "learned")).alias("learning_count"),
        F.max_by("transition", "round").alias("latest_transition"),
    )


def alignment_errors(history: DataFrame, invariants: list[str], rounds: int | None = None) -> DataFrame:
    """(check, n): samples that are missing in a round, change an invariant, repeat a round, or rounds whose step does not rise.

    ``history`` has sample_id, round, step and the invariant columns.
    """
    total = F.lit(rounds) if rounds is not None else None
    per = history.groupBy("sample_id").agg(F.count("*").alias("n"), F.count_distinct("round").alias("rounds"), *[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"_{c}") for c in invariants])
    if total is None:
        all_rounds = history.agg(F.count_distinct("round").alias("_total"))
        per = per.join(F.broadcast(all_rounds))  # one row
        total = F.col("_total")
    checks = [("missing_round", F.col("rounds") < total), ("repeated_round", F.col("n") > F.col("rounds"))] + [(f"changed_{c}", F.col(f"_{c}") > 1) for c in invariants]
    counted = per.agg(*[F.count_if(c).alias(name) for name, c in checks])
    steps = history.groupBy("round").agg(F.min("step").alias("low"), F.max("step").alias("high"))
    w = Window.partitionBy(F.lit(0)).orderBy("round")  # one row for each round
    rising = steps.withColumn("before", F.lag("high").over(w)).agg(F.count_if((F.col("low") <= F.col("before")) | (F.col("low") != F.col("high"))).alias("step_not_rising"))
    both = counted.join(F.broadcast(rising))  # one row
    names = [name for name, _ in checks] + ["step_not_rising"]
    return both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.check", "x.n")


def learning_status(history: DataFrame, last: int = 5) -> DataFrame:
    """First correct round, slope of the last losses, stability and a status of each sample."""
    w = Window.partitionBy("sample_id").orderBy("round")
    back = Window.partitionBy("sample_id").orderBy(F.desc("round"))
    d = history.withColumn("_turned", (F.lag("correct").over(w) != F.col("correct")).cast("int")).withColumn("_back", F.row_number().over(back))
    recent = F.col("_back") <= last
    out = d.groupBy("sample_id").agg(
        F.min(F.when(F.col("correct"), F.col("round"))).alias("first_correct_round"),
        F.round(F.regr_slope(F.when(recent, F.col("loss")), F.when(recent, F.col("round").cast("double"))), 6).alias("loss_slope"),
        F.round(1 - F.coalesce(F.avg("_turned"), F.lit(0.0)), 6).alias("stability"),
        F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"),
    )
    status = (
        F.when((F.col("first_correct_round") == 0) & (F.col("stability") >= 0.8), "easy_mastered")
        .when(F.col("stability") < 0.6, "unstable")
        .when(F.col("accuracy") >= 0.5, "learnable_hard")
        .otherwise("noisy")
    )
    return out.withColumn("status", status)
