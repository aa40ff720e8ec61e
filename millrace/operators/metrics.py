"""Aggregated metrics: accuracy, token-weighted loss, paired changes, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import answer_group


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, rounded to 9 digits, null for a zero denominator."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 9)


def accuracy(df: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    """Rows, scored rows, correct rows and accuracy; rows without a score count in neither."""
    out = df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count(correct).alias("n_scored"), F.count_if(F.col(correct)).alias("n_correct"))
    return out.withColumn("accuracy", ratio(F.col("n_correct"), F.col("n_scored")))


def grouping_sets(df: DataFrame, sets: list[list[str]], aggs: list[Column]) -> DataFrame:
    """One aggregation over several groupings in one pass; ``level`` names the grouping, absent keys are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    columns = [tuple(F.col(k) for k in s) for s in sets]
    grouped = df.groupingSets(columns, *[F.col(k) for k in keys]).agg(*[F.grouping(k).alias(f"_g_{k}") for k in keys], *aggs)
    level = F.concat_ws("+", *[F.when(F.col(f"_g_{k}") == 0, F.lit(k)) for k in keys])
    return grouped.withColumn("level", F.when(level == "", "overall").otherwise(level)).drop(*[f"_g_{k}" for k in keys])


def weighted_loss(total: str = "sum_nll", tokens: str = "tokens") -> Column:
    """Sum of losses over sum of tokens, never a mean of means; the sum is exact."""
    return F.round(F.try_divide(F.sum(F.col(total).cast("decimal(30,4)")).cast("double"), F.sum(tokens).cast("double")), 6)


def paired_change(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Accuracy before and after, change in points, rows that turned either way, and answers that could not be parsed.

    ``df`` has base and after, and base_valid and after_valid; what cannot be parsed is wrong, but counts.
    """
    aggs = [
        F.count("*").alias("n"),
        F.count_if("base").alias("base_correct"),
        F.count_if("after").alias("after_correct"),
        F.count_if(F.col("base") & ~F.col("after")).alias("correct_to_wrong"),
        F.count_if(~F.col("base") & F.col("after")).alias("wrong_to_correct"),
        F.count_if(~F.col("base_valid")).alias("base_invalid"),
        F.count_if(~F.col("after_valid")).alias("after_invalid"),
    ]
    d = grouping_sets(df, sets, aggs)
    d = d.withColumns({f"{c}_accuracy": ratio(F.col(f"{c}_correct"), F.col("n")) for c in ("base", "after")})
    delta = F.round(100 * (F.col("after_correct") - F.col("base_correct")) / F.col("n"), 6)
    direction = F.when(delta > 0, "observed_increase").when(delta < 0, "observed_decrease").otherwise("unchanged")
    return d.withColumn("delta_pp", delta).withColumn("direction", direction)


def error_mode(prediction: Column, answer: Column) -> Column:
    """How a prediction fails: outside all answer spaces, within the right one, or in another."""
    found, wanted = answer_group(prediction), answer_group(answer)
    return F.when(prediction == answer, "correct").when(found == "other", "invalid_or_extra_text").when(found == wanted, "wrong_within_answer_space").otherwise("wrong_answer_space")


def wilson(correct: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper Wilson bound of a share, null for no rows."""
    p = F.try_divide(correct.cast("double"), n.cast("double"))
    centre = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.round((centre - spread) / (1 + z * z / n), 6)), F.when(n > 0, F.round((centre + spread) / (1 + z * z / n), 6))


def with_share(df: DataFrame, value: str, name: str = "share", by: list[str] | None = None) -> DataFrame:
    """``df`` with the share of ``value`` in its sum (within groups)."""
    return df.withColumn(name, ratio(F.col(value), F.sum(value).over(Window.partitionBy(*(by or [])))))


def majority(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, the smallest among ties."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("majority"))
