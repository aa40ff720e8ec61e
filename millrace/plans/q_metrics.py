"""Queries: aggregations and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import metrics as M
from millrace.plans import views as V
from millrace.plans.catalog import register


@register("agg_counts", "SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def agg_counts(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@register("agg_explode_count", f"WITH {V.PROGRAMS}, e AS (SELECT unnest(program) AS s FROM programs) SELECT s.\"function\" AS function, s.value_inputs[1] AS input, count(*)::BIGINT AS n FROM e GROUP BY ALL")
def agg_explode_count(spark: SparkSession, sf: str) -> DataFrame:
    steps = V.programs(spark, sf).select(F.explode("program").alias("s"))
    return steps.groupBy(F.col("s.function").alias("function"), F.get("s.value_inputs", F.lit(0)).alias("input")).agg(F.count("*").alias("n"))


@register("agg_distinct", "SELECT lang, count(DISTINCT source)::BIGINT AS n_sources, count(DISTINCT text)::BIGINT AS n_texts FROM documents GROUP BY lang")
def agg_distinct(spark: SparkSession, sf: str) -> DataFrame:
    d = V.table(spark, sf, "documents").select("lang", "source", F.sha2("text", 256).alias("h"))
    return d.groupBy("lang").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("h").alias("n_texts"))


@register("agg_top_share", "SELECT max(n)::BIGINT AS top_rows, sum(n)::BIGINT AS n_rows, round(max(n)::DOUBLE / sum(n), 9) AS top_share FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def agg_top_share(spark: SparkSession, sf: str) -> DataFrame:
    n = V.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.agg(F.max("n").alias("top_rows"), F.sum("n").alias("n_rows"), M.ratio(F.max("n"), F.sum("n")).alias("top_share"))


@register("agg_examples", "SELECT p_type, count(*)::BIGINT AS n, array_to_string(list_slice(list_sort(list(DISTINCT p_brand)), 1, 10), ',') AS examples FROM part GROUP BY p_type")
def agg_examples(spark: SparkSession, sf: str) -> DataFrame:
    p = V.table(spark, sf, "part")
    return p.groupBy("p_type").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("p_brand")), 1, 10), ",").alias("examples"))


@register(
    "agg_accuracy_bucket",
    f"""WITH {V.SCORED} SELECT lang, count(*)::BIGINT AS n_rows, count(correct)::BIGINT AS n_scored, count(*) FILTER (correct)::BIGINT AS n_correct,
    round(count(*) FILTER (correct)::DOUBLE / nullif(count(correct), 0), 9) AS accuracy, count(correct) >= 100 AS feedback_eligible FROM scored GROUP BY lang""",
)
def agg_accuracy_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return M.accuracy(V.scored(spark, sf), ["lang"]).withColumn("feedback_eligible", F.col("n_scored") >= 100)


_LEVEL = "CASE WHEN grouping(lang) = 1 THEN 'overall' WHEN grouping(source) = 1 THEN 'lang' ELSE 'lang+source' END AS level"


@register(
    "agg_rollup_accuracy",
    f"""WITH {V.SCORED} SELECT {_LEVEL}, lang, source, count(*)::BIGINT AS n, count(*) FILTER (correct)::BIGINT AS n_correct, count(*) FILTER (invalid)::BIGINT AS n_invalid,
    round(count(*) FILTER (correct)::DOUBLE / count(*), 9) AS accuracy FROM scored WHERE correct IS NOT NULL GROUP BY GROUPING SETS ((), (lang), (lang, source))""",
)
def agg_rollup_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    aggs = [F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.count_if("invalid").alias("n_invalid")]
    return M.grouping_sets(V.scored(spark, sf).where("correct is not null"), [[], ["lang"], ["lang", "source"]], aggs).withColumn("accuracy", M.ratio(F.col("n_correct"), F.col("n")))


@register("agg_weighted_mean", f"WITH {V.NLL} SELECT source, sum(tokens)::BIGINT AS tokens, round(sum(sum_nll)::DOUBLE / sum(tokens)::DOUBLE, 6) AS mean_nll FROM nll GROUP BY source")
def agg_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    return V.nll(spark, sf).groupBy("source").agg(F.sum("tokens").alias("tokens"), M.weighted_loss().alias("mean_nll"))


@register(
    "agg_nll_grouping_sets",
    f"""WITH {V.NLL} SELECT CASE WHEN grouping(source) = 1 THEN 'overall' WHEN grouping(lang) = 1 THEN 'source' ELSE 'source+lang' END AS level, source, lang, count(*)::BIGINT AS n, sum(tokens)::BIGINT AS tokens,
    round(sum(sum_nll)::DOUBLE / sum(tokens)::DOUBLE, 6) AS mean_nll FROM nll GROUP BY GROUPING SETS ((), (source), (source, lang))""",
)
def agg_nll_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return M.grouping_sets(V.nll(spark, sf), [[], ["source"], ["source", "lang"]], [F.count("*").alias("n"), F.sum("tokens").alias("tokens"), M.weighted_loss().alias("mean_nll")])


@register(
    "agg_paired_change",
    f"""WITH {V.PAIRED}, a AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'overall' ELSE 'lang' END AS level, lang, count(*)::BIGINT AS n, count(*) FILTER (base)::BIGINT AS base_correct, count(*) FILTER (after)::BIGINT AS after_correct,
    count(*) FILTER (base AND NOT after)::BIGINT AS correct_to_wrong, count(*) FILTER (NOT base AND after)::BIGINT AS wrong_to_correct, count(*) FILTER (NOT base AND doc_id % 13 = 0)::BIGINT AS base_invalid, count(*) FILTER (NOT after AND doc_id % 6 = 0)::BIGINT AS after_invalid FROM paired GROUP BY GROUPING SETS ((), (lang)))
    SELECT *, round(base_correct::DOUBLE / n, 9) AS base_accuracy, round(after_correct::DOUBLE / n, 9) AS after_accuracy, round(100 * (after_correct - base_correct)::DOUBLE / n, 6) AS delta_pp,
    CASE WHEN after_correct > base_correct THEN 'observed_increase' WHEN after_correct < base_correct THEN 'observed_decrease' ELSE 'unchanged' END AS direction FROM a""",
)
def agg_paired_change(spark: SparkSession, sf: str) -> DataFrame:
    p = V.paired(spark, sf)
    unread = {"base_valid": F.col("base") | (F.col("doc_id") % 13 != 0), "after_valid": F.col("after") | (F.col("doc_id") % 6 != 0)}
    return M.paired_change(p.withColumns(unread), [[], ["lang"]])


@register(
    "agg_multi_dim",
    f"""WITH {V.SCORED}, s AS (SELECT *, CASE WHEN n_chars <= 2000 THEN 'short' ELSE 'long' END AS tier FROM scored WHERE correct IS NOT NULL)
    SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'tier' END AS level, lang, source, tier, count(*)::BIGINT AS n,
    round(count(*) FILTER (correct)::DOUBLE / count(*), 9) AS accuracy FROM s GROUP BY GROUPING SETS ((lang), (source), (tier))""",
)
def agg_multi_dim(spark: SparkSession, sf: str) -> DataFrame:
    d = V.scored(spark, sf).where("correct is not null").withColumn("tier", F.when(F.col("n_chars") <= 2000, "short").otherwise("long"))
    return M.grouping_sets(d, [["lang"], ["source"], ["tier"]], [F.count("*").alias("n"), M.ratio(F.count_if("correct"), F.count("*")).alias("accuracy")])


_ORDERS = "o AS (SELECT o_orderpriority AS task, o_orderstatus AS answer, CASE WHEN o_orderkey % 5 = 0 THEN 'F' WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus END AS prediction FROM orders)"


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers and predictions: orders, where every fifth prediction is F and some are empty."""
    o = V.table(spark, sf, "orders")
    prediction = F.when(F.col("o_orderkey") % 5 == 0, "F").when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderstatus"))
    return o.select(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("answer"), prediction.alias("prediction"))


@register(
    "agg_majority_baseline",
    f"""WITH {_ORDERS}, c AS (SELECT task, answer, count(*) AS n FROM o GROUP BY ALL), m AS (SELECT task, answer AS majority FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, answer) AS r FROM c) WHERE r = 1)
    SELECT task, majority, count(*)::BIGINT AS n, round(count(*) FILTER (prediction = answer)::DOUBLE / count(*), 9) AS accuracy, round(count(*) FILTER (majority = answer)::DOUBLE / count(*), 9) AS baseline FROM o JOIN m USING (task) GROUP BY ALL""",
)
def agg_majority_baseline(spark: SparkSession, sf: str) -> DataFrame:
    d = _answers(spark, sf)
    joined = d.join(M.majority(d, "task", "answer"), "task")
    hits = lambda c: M.ratio(F.count_if(F.col(c) == F.col("answer")), F.count("*"))
    return joined.groupBy("task", "majority").agg(F.count("*").alias("n"), hits("prediction").alias("accuracy"), hits("majority").alias("baseline"))


_GROUP = "CASE WHEN regexp_full_match({0}, '[0-9]+') THEN 'integer' WHEN {0} IN ('gray','red','blue','green','brown','purple','cyan','yellow') THEN 'color' WHEN {0} IN ('rubber','metal') THEN 'material' ELSE 'other' END"
_TYPED = f"t AS (SELECT task, answer, prediction, {_GROUP.format('answer')} AS ag, {_GROUP.format('prediction')} AS pg FROM (SELECT p_brand AS task, (['red','blue','metal','7'])[(p_partkey % 4 + 1)::INTEGER] AS answer, (['red','cyan','rubber','12','a long text'])[(p_partkey % 5 + 1)::INTEGER] AS prediction FROM part))"


@register(
    "agg_error_modes",
    f"WITH {_TYPED} SELECT task, CASE WHEN prediction = answer THEN 'correct' WHEN pg = 'other' THEN 'invalid_or_extra_text' WHEN pg = ag THEN 'wrong_within_answer_space' ELSE 'wrong_answer_space' END AS mode, count(*)::BIGINT AS n FROM t GROUP BY ALL",
)
def agg_error_modes(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    d = V.table(spark, sf, "part").select(F.col("p_brand").alias("task"), pick(["red", "blue", "metal", "7"]).alias("answer"), pick(["red", "cyan", "rubber", "12", "a long text"]).alias("prediction"))
    mode = M.error_mode(F.col("prediction"), F.col("answer"))
    return d.groupBy("task", mode.alias("mode")).agg(F.count("*").alias("n"))


@register("agg_confusion", f"WITH {_ORDERS} SELECT answer, prediction, count(*)::BIGINT AS n FROM o WHERE answer <> prediction GROUP BY ALL")
def agg_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).where("answer <> prediction").groupBy("answer", "prediction").agg(F.count("*").alias("n"))


@register("top_k_counts", "SELECT p_brand, count(*)::BIGINT AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 12")
def top_k_counts(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(12)


@register(
    "prof_columns",
    """SELECT lang, count(*)::BIGINT AS n, round(1 - count(quality)::DOUBLE / count(*), 9) AS null_rate, min(n_chars) AS low, max(n_chars) AS high,
    round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
)
def prof_columns(spark: SparkSession, sf: str) -> DataFrame:
    d = V.table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(V.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    p = lambda q: F.round(F.percentile("n_chars", F.lit(q)), 6)
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.round(1 - F.count("quality") / F.count("*"), 9).alias("null_rate"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@register(
    "agg_wilson",
    f"""WITH {V.SCORED}, a AS (SELECT source, count(correct) AS n, count(*) FILTER (correct) AS k FROM scored GROUP BY source), p AS (SELECT *, k::DOUBLE / nullif(n, 0) AS p FROM a)
    SELECT source, n::BIGINT AS n, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low,
    round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM p""",
)
def agg_wilson(spark: SparkSession, sf: str) -> DataFrame:
    a = V.scored(spark, sf).groupBy("source").agg(F.count("correct").alias("n"), F.count_if("correct").alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return a.select("source", "n", low.alias("low"), high.alias("high"))


@register(
    "agg_exposure_share",
    """WITH f AS (SELECT l_returnflag || l_linestatus AS bucket, c_mktsegment AS segment, sum(l_quantity::DECIMAL(18,2)) AS weight, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT bucket, segment, n::BIGINT AS n, round(n::DOUBLE / sum(n) OVER (), 9) AS row_share, round(weight::DOUBLE / (sum(weight) OVER ())::DOUBLE, 9) AS weight_share FROM f""",
)
def agg_exposure_share(spark: SparkSession, sf: str) -> DataFrame:
    li = V.table(spark, sf, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("bucket"), F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = V.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    f = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("bucket", "segment").agg(F.sum("q").alias("weight"), F.count("*").alias("n"))
    return M.with_share(M.with_share(f, "n", "row_share"), "weight", "weight_share").drop("weight")


@register(
    "agg_retention",
    f"""WITH {V.PAIRED} SELECT lang, count(*) FILTER (base)::BIGINT AS mastered, count(*) FILTER (base AND NOT after)::BIGINT AS forgotten,
    round(count(*) FILTER (base AND NOT after)::DOUBLE / nullif(count(*) FILTER (base), 0), 9) AS forgetting_rate,
    round((count(*) FILTER (after) - count(*) FILTER (base))::DOUBLE / count(*), 9) AS retention_delta FROM paired GROUP BY lang""",
)
def agg_retention(spark: SparkSession, sf: str) -> DataFrame:
    lost = F.count_if(F.col("base") & ~F.col("after"))
    return V.paired(spark, sf).groupBy("lang").agg(
        F.count_if("base").alias("mastered"), lost.alias("forgotten"), M.ratio(lost, F.count_if("base")).alias("forgetting_rate"), M.ratio(F.count_if("after") - F.count_if("base"), F.count("*")).alias("retention_delta")
    )


@register("win_cumulative", f"WITH {V.HISTORY} SELECT sample_id, round, sum(round + 1) OVER (PARTITION BY sample_id ORDER BY round)::BIGINT AS steps FROM history")
def win_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("sample_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return V.history(spark, sf).select("sample_id", "round", F.sum(F.col("round") + 1).over(w).alias("steps"))


@register("win_running_accuracy", f"WITH {V.HISTORY} SELECT sample_id, round, round(avg(correct::INTEGER) OVER (PARTITION BY sample_id ORDER BY round), 9) AS running FROM history")
def win_running_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("sample_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return V.history(spark, sf).select("sample_id", "round", F.round(F.avg(F.col("correct").cast("int")).over(w), 9).alias("running"))
