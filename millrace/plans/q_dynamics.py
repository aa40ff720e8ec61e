"""Queries: learning dynamics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import dynamics as D
from millrace.plans import views as V
from millrace.plans.catalog import register

_LAG = f"{V.HISTORY}, h AS (SELECT *, lag(correct) OVER w AS prev, lag(loss) OVER w AS prev_loss FROM history WINDOW w AS (PARTITION BY sample_id ORDER BY round))"
_LABEL = "CASE WHEN correct IS NULL THEN 'not_scored' WHEN prev IS NULL THEN 'first_observation' WHEN prev AND NOT correct THEN 'forgotten' WHEN NOT prev AND correct THEN 'learned' WHEN correct THEN 'stable_correct' ELSE 'stable_wrong' END"


@register("dyn_transitions", f"WITH {_LAG} SELECT sample_id, count(*) FILTER (prev AND NOT correct)::BIGINT AS forgetting_count, count(*) FILTER (NOT prev AND correct)::BIGINT AS learning_count, arg_max({_LABEL}, round) AS latest_transition FROM h GROUP BY sample_id")
def dyn_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return D.event_counts(V.history(spark, sf))


@register(
    "dyn_nll_delta",
    f"""WITH {_LAG} SELECT sample_id, round, round(loss - prev_loss, 6) AS delta, round(prev_loss - loss, 6) AS gain, CASE WHEN prev_loss > 0 THEN round((prev_loss - loss) / prev_loss, 6) END AS relative_gain,
    round((loss - prev_loss) / 10::DOUBLE, 9) AS delta_per_step FROM h QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY round DESC) = 1""",
)
def dyn_nll_delta(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("sample_id").orderBy("round")
    h = V.history(spark, sf).withColumn("before", F.lag("loss").over(w))
    last = h.groupBy("sample_id").agg(F.max_by(F.struct("before", "loss"), "round").alias("x"), F.max("round").alias("round"))
    changes = D.loss_change(F.col("x.before"), F.col("x.loss"), F.lit(10))
    return last.select("sample_id", "round", *[c.alias(name) for name, c in changes.items()])


@register("dyn_baseline_gain", f"WITH {V.HISTORY} SELECT sample_id, round(arg_min(loss, round) - arg_max(loss, round), 6) AS gain, count(*)::BIGINT AS n_rounds FROM history GROUP BY sample_id")
def dyn_baseline_gain(spark: SparkSession, sf: str) -> DataFrame:
    return V.history(spark, sf).groupBy("sample_id").agg(F.round(F.min_by("loss", "round") - F.max_by("loss", "round"), 6).alias("gain"), F.count("*").alias("n_rounds"))


@register(
    "dyn_group_history",
    f"""WITH {_LAG}, g AS (SELECT sample_id % 4 AS grp, round, count(*) AS n, round(avg(correct::INTEGER), 9) AS accuracy, round((sum(loss::DECIMAL(30,6)))::DOUBLE / count(*), 6) AS mean_loss,
    count(*) FILTER (prev AND NOT correct) AS forgetting FROM h GROUP BY ALL)
    SELECT grp, round, n::BIGINT AS n, accuracy, mean_loss, forgetting::BIGINT AS forgetting, round(mean_loss - lag(mean_loss) OVER (PARTITION BY grp ORDER BY round), 6) AS delta FROM g""",
)
def dyn_group_history(spark: SparkSession, sf: str) -> DataFrame:
    h = D.with_transitions(V.history(spark, sf))
    g = h.groupBy((F.col("sample_id") % 4).alias("grp"), "round").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 9).alias("accuracy"), F.round(F.sum(F.col("loss").cast("decimal(30,6)")).cast("double") / F.count("*"), 6).alias("mean_loss"), F.count_if(F.col("transition") == "forgotten").alias("forgetting")
    )
    w = Window.partitionBy("grp").orderBy("round")
    return g.withColumn("delta", F.round(F.col("mean_loss") - F.lag("mean_loss").over(w), 6))


@register(
    "dyn_alignment",
    f"""WITH {V.HISTORY}, h AS (SELECT sample_id, round, round * 10 + CASE WHEN sample_id % 50 = 0 AND round = 2 THEN 1 ELSE 0 END AS step, sample_id % 3 + CASE WHEN sample_id % 40 = 0 AND round = 1 THEN 1 ELSE 0 END AS bucket FROM history WHERE NOT (sample_id % 30 = 0 AND round = 3)),
    p AS (SELECT sample_id, count(*) AS n, count(DISTINCT round) AS r, count(DISTINCT bucket) AS b FROM h GROUP BY sample_id),
    s AS (SELECT round, min(step) AS low, max(step) AS high FROM h GROUP BY round), l AS (SELECT *, lag(high) OVER (ORDER BY round) AS before FROM s)
    SELECT 'missing_round' AS "check", count(*) FILTER (r < (SELECT count(DISTINCT round) FROM h))::BIGINT AS n FROM p UNION ALL SELECT 'repeated_round', count(*) FILTER (n > r)::BIGINT FROM p
    UNION ALL SELECT 'changed_bucket', count(*) FILTER (b > 1)::BIGINT FROM p UNION ALL SELECT 'step_not_rising', count(*) FILTER (low <= before OR low <> high)::BIGINT FROM l""",
)
def dyn_alignment(spark: SparkSession, sf: str) -> DataFrame:
    h = V.history(spark, sf).where("not (sample_id % 30 = 0 and round = 3)")
    step = F.col("round") * 10 + ((F.col("sample_id") % 50 == 0) & (F.col("round") == 2)).cast("int")
    bucket = F.col("sample_id") % 3 + ((F.col("sample_id") % 40 == 0) & (F.col("round") == 1)).cast("int")
    return D.alignment_errors(h.select("sample_id", "round", step.alias("step"), bucket.alias("bucket")), ["bucket"])


@register(
    "dyn_learning_status",
    f"""WITH {V.HISTORY}, h AS (SELECT *, (lag(correct) OVER w <> correct)::INTEGER AS turned, row_number() OVER (PARTITION BY sample_id ORDER BY round DESC) AS back FROM history WINDOW w AS (PARTITION BY sample_id ORDER BY round)),
    a AS (SELECT sample_id, min(round) FILTER (correct) AS first_correct_round, round(regr_slope(loss, round) FILTER (back <= 5), 6) AS loss_slope, round(1 - coalesce(avg(turned), 0), 6) AS stability, round(avg(correct::INTEGER), 6) AS accuracy FROM h GROUP BY sample_id)
    SELECT *, CASE WHEN first_correct_round = 0 AND stability >= 0.8 THEN 'easy_mastered' WHEN stability < 0.6 THEN 'unstable' WHEN accuracy >= 0.5 THEN 'learnable_hard' ELSE 'noisy' END AS status FROM a""",
)
def dyn_learning_status(spark: SparkSession, sf: str) -> DataFrame:
    return D.learning_status(V.history(spark, sf))
