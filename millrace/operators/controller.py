"""Feedback controller: deficits, weights, bounds, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ema(values: Column, beta: float) -> Column:
    """Exponential moving average of an ordered array, started at its first value."""
    first = F.get(values, F.lit(0))
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), first, lambda old, x: beta * old + (1 - beta) * x)


def deficit(target: Column, accuracy: Column) -> Column:
    return F.greatest(F.lit(0.0), target - accuracy)


def clipped(new: Column, old: Column, low: float = 0.5, high: float = 2.0) -> Column:
    return F.least(F.greatest(new, low * old), high * old)


def multiplicative(weight: Column, gap: Column, alpha: float) -> Column:
    """w * (1 + alpha * deficit) within half and twice w."""
    return clipped(weight * (1 + alpha * gap), weight)


def normalised(df: DataFrame, weight: str, by: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(by or []))
    return df.withColumn(weight, F.col(weight) / F.sum(weight).over(w))


def exponential(df: DataFrame, share: str, gap: str, rate: float, round_no: int, decay: float = 0.7) -> DataFrame:
    """q * exp(rate * decay^(r-1) * deficit), normalised."""
    return normalised(df.withColumn(share, F.col(share) * F.exp(F.lit(rate * decay ** (round_no - 1)) * F.col(gap))), share)


def outer_step(share: Column, proposal: Column, low: Column, high: Column, step: float) -> Column:
    """A proposal moved by ``step`` at most, then into its bounds."""
    return F.least(F.greatest(F.least(F.greatest(proposal, share - step), share + step), low), high)


def inner_mix(df: DataFrame, share: str, prior: str, multiplier: str, frozen: str, mix: float = 0.2, low: float = 0.8, high: float = 1.5) -> DataFrame:
    """Shares times clamped multipliers, mixed with the prior; frozen rows keep theirs, the others share the rest."""
    w = Window.partitionBy()
    moved = F.col(share) * F.least(F.greatest(F.col(multiplier), F.lit(low)), F.lit(high))
    d = df.withColumn("_m", F.when(~F.col(frozen), moved)).withColumn("_p", F.when(~F.col(frozen), F.col(prior)))
    mixed = (1 - mix) * F.col("_m") / F.sum("_m").over(w) + mix * F.col("_p") / F.sum("_p").over(w)
    free = 1 - F.coalesce(F.sum(F.when(F.col(frozen), F.col(share))).over(w), F.lit(0.0))
    return d.withColumn("new_share", F.when(F.col(frozen), F.col(share)).otherwise(mixed * free)).drop("_m", "_p")


def oscillating(history: DataFrame, key: str, order: str, weight: str) -> DataFrame:
    """``history`` with whether the weight turned in both of the last two steps."""
    w = Window.partitionBy(key).orderBy(order)
    d = history.withColumn("_s", F.signum(F.col(weight) - F.lag(weight).over(w)))
    d = d.withColumn("_t", F.col("_s") * F.lag("_s").over(w) < 0)
    return d.withColumn("oscillating", F.coalesce(F.col("_t") & F.lag("_t").over(w), F.lit(False))).drop("_s", "_t")


def gain_gate(history: DataFrame, key: str, order: str, gain: str, least: float, patience: int = 2) -> DataFrame:
    """``history`` with the streak of low gains that ends at each row, and PAUSED from ``patience`` on."""
    w = Window.partitionBy(key).orderBy(order)
    low = F.col(gain) < least
    d = history.withColumn("_run", F.sum((~low).cast("int")).over(w))
    streak = F.sum(low.cast("int")).over(Window.partitionBy(key, "_run").orderBy(order))
    return d.withColumn("streak", streak.cast("long")).withColumn("state", F.when(F.col("streak") >= patience, "PAUSED").otherwise("ACTIVE")).drop("_run")


def within_k_sigma(df: DataFrame, value: str, k: float, by: list[str] | None = None) -> DataFrame:
    """``df`` with low, high (mean and population deviation of ``value`` times ``k``, within groups) and ``kept``: whether a row lies between them.

    The bounds are one aggregation; a group of any size meets them in a join.
    """
    keys = by or []
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    stats = stats.select(*keys, F.round(F.col("_mean") - k * F.col("_sd"), 6).alias("low"), F.round(F.col("_mean") + k * F.col("_sd"), 6).alias("high"))
    joined = df.join(stats, keys) if keys else df.join(F.broadcast(stats))  # one row
    return joined.withColumn("kept", F.col(value).between(F.col("low"), F.col("high")))
