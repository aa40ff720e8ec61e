"""Logical views over the driver's tables: for Spark as DataFrames, for DuckDB as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pool: doc_id, src, lang, tier, raw bucket, group_id, n_chars."""
    n = F.substring("source", 4, 10).cast("int")
    tier = F.when(F.col("n_chars") <= 2000, "short").when(F.col("n_chars") <= 10000, "medium").otherwise("long")
    d = table(spark, sf_dir, "documents")
    src = F.when(n < 12, "main").when(n < 17, "replay_vl").otherwise("replay_text")
    return d.select("doc_id", src.alias("src"), "lang", tier.alias("tier"), F.concat_ws("|", "lang", tier).alias("raw_bucket"), F.col("source").alias("group_id"), "n_chars")


POOL = """pool AS (SELECT doc_id, CASE WHEN n < 12 THEN 'main' WHEN n < 17 THEN 'replay_vl' ELSE 'replay_text' END AS src, lang, tier,
    lang || '|' || tier AS raw_bucket, source AS group_id, n_chars
    FROM (SELECT *, CAST(substr(source, 4) AS INTEGER) AS n, CASE WHEN n_chars <= 2000 THEN 'short' WHEN n_chars <= 10000 THEN 'medium' ELSE 'long' END AS tier FROM documents))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: documents with correct = (quality = 1), null where not labelled."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("invalid"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")


SCORED = "scored AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality = 1 AS correct, l.toxic = 1 AS invalid FROM documents d LEFT JOIN labels l USING (doc_id))"


def nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token losses: tokens = n_chars, sum_nll = n_chars * (doc_id % 7 + 1) / 10 as decimal."""
    loss = (F.col("n_chars") * (F.col("doc_id") % 7 + 1)).cast("decimal(28,4)") * F.lit("0.1").cast("decimal(2,1)")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("tokens"), loss.cast("decimal(30,4)").alias("sum_nll"))


NLL = "nll AS (SELECT doc_id, lang, source, n_chars AS tokens, CAST(n_chars * (doc_id % 7 + 1) AS DECIMAL(28,4)) * CAST('0.1' AS DECIMAL(2,1)) AS sum_nll FROM documents)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered observations: sample, round, step, correct and loss."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("correct"), F.col("value").alias("loss"))
    return e.select(F.col("user_id").alias("sample_id"), (F.row_number().over(w) - 1).cast("long").alias("round"), "event_id", "correct", "loss")


HISTORY = "history AS (SELECT user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS round, event_id, event_type <> 'error' AS correct, value AS loss FROM events)"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after: base = label quality, after = doc_id % 3 <> 0."""
    return scored(spark, sf_dir).where("correct is not null").select("doc_id", "lang", F.col("correct").alias("base"), (F.col("doc_id") % 3 != 0).alias("after"), "invalid")


PAIRED = SCORED + ", paired AS (SELECT doc_id, lang, correct AS base, doc_id % 3 <> 0 AS after, invalid FROM scored WHERE correct IS NOT NULL)"


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question records with nested steps, made of parts: relations come from p_type, the last function from p_size."""
    p = table(spark, sf_dir, "part")
    last = F.expr("element_at(array('count', 'exist', 'query_color', 'query_size', 'equal_shape', 'less_than', 'unique'), cast(p_size % 7 + 1 as int))")
    step = lambda f, v: F.struct(f.alias("function"), F.array(v).alias("value_inputs"))
    relate = F.transform(F.sequence(F.lit(1), (F.col("p_size") % 4 + 1).cast("int")), lambda i: step(F.lit("relate"), F.get(F.array(*map(F.lit, ("left", "right", "front", "behind", "none"))), ((F.col("p_partkey") + i) % 5).cast("int"))))
    return p.select(F.col("p_partkey").alias("question_id"), "p_name", "p_brand", F.col("p_size").cast("int").alias("p_size"), F.concat(relate, F.array(step(last, F.col("p_brand")))).alias("program"))


PROGRAMS = """programs AS (SELECT p_partkey AS question_id, p_name, p_brand, p_size::INTEGER AS p_size,
    list_concat(list_transform(range(1, (p_size % 4 + 2)::BIGINT), lambda i: {'function': 'relate', 'value_inputs': [(['left','right','front','behind','none'])[((p_partkey + i) % 5 + 1)::INTEGER]]}),
        [{'function': (['count','exist','query_color','query_size','equal_shape','less_than','unique'])[(p_size % 7 + 1)::INTEGER], 'value_inputs': [p_brand]}]) AS program FROM part)"""
