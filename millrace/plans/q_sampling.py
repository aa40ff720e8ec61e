"""Queries: sampling, quotas, splits, recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import partition_of, seeded, unit_interval
from millrace.operators import quotas as Q
from millrace.operators import sampling as S
from millrace.plans import views as V
from millrace.plans.catalog import register

SEED = 42
HASH = "sha256('42:' || CAST(doc_id AS VARCHAR))"


@register("smp_reservoir", f"WITH {V.POOL} SELECT src, doc_id FROM pool QUALIFY row_number() OVER (PARTITION BY src ORDER BY {HASH}, doc_id) <= 50")
def smp_reservoir(spark: SparkSession, sf: str) -> DataFrame:
    return S.sample_per_group(V.pool(spark, sf).select("src", "doc_id"), "doc_id", 50, SEED, ["src"])


@register("smp_seeded_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {HASH}, doc_id)::BIGINT AS rank FROM documents")
def smp_seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return S.hash_rank(V.table(spark, sf, "documents").select("doc_id"), "doc_id", SEED)


@register("smp_scan_budget", f"SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY {HASH}, doc_id) <= 100")
def smp_scan_budget(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").orderBy(seeded(SEED, F.col("doc_id")), "doc_id").limit(100).select("doc_id")


@register("smp_probe", f"WITH {V.POOL} SELECT src, doc_id FROM pool QUALIFY row_number() OVER (PARTITION BY src ORDER BY sha256('probe:' || CAST(doc_id AS VARCHAR)), doc_id) <= CASE src WHEN 'main' THEN 48 WHEN 'replay_vl' THEN 12 ELSE 4 END")
def smp_probe(spark: SparkSession, sf: str) -> DataFrame:
    ranked = S.hash_rank(V.pool(spark, sf).select("src", "doc_id"), "doc_id", "probe", ["src"])
    limit = F.when(F.col("src") == "main", 48).when(F.col("src") == "replay_vl", 12).otherwise(4)
    return ranked.where(F.col("rank") <= limit).drop("rank")


@register(
    "smp_even_strata",
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {HASH}, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents),
    s AS (SELECT *, floor(r * 8 / n)::BIGINT AS stratum FROM r)
    SELECT doc_id, stratum, (r - ceil(stratum * n / 8))::BIGINT AS "offset" FROM s WHERE r - ceil(stratum * n / 8) < 32""",
)
def smp_even_strata(spark: SparkSession, sf: str) -> DataFrame:
    return S.even_strata(V.table(spark, sf, "documents").select("doc_id"), "doc_id", 8, 32, SEED)


def _repeat_sql(quota: str, group: str, cte: str) -> str:
    return f"""{cte}, r AS (SELECT p.*, row_number() OVER (PARTITION BY {group} ORDER BY {HASH}, doc_id) AS rk, count(*) OVER (PARTITION BY {group}) AS n FROM pool p),
    q AS (SELECT *, {quota} AS quota FROM r), c AS (SELECT *, (quota // n + CASE WHEN rk <= quota % n THEN 1 ELSE 0 END) AS copies FROM q)
    SELECT {group}, doc_id, unnest(range(1, copies + 1))::INTEGER AS copy_no FROM c WHERE copies > 0"""


@register("smp_cap_repeat", _repeat_sql("(n * 5) // 2", "src", f"WITH {V.POOL}"))
def smp_cap_repeat(spark: SparkSession, sf: str) -> DataFrame:
    pool = V.pool(spark, sf).select("src", "doc_id")
    plan = pool.groupBy("src").agg(F.floor(F.count("*") * 5 / 2).alias("quota"))
    return S.repeat_to(pool, "doc_id", plan, ["src"], SEED, cap=4)


@register("smp_quota_oversample", _repeat_sql("CASE lang WHEN 'en' THEN n + 7 WHEN 'de' THEN 3 ELSE 2 * n + 1 END", "lang", f"WITH {V.POOL}"))
def smp_quota_oversample(spark: SparkSession, sf: str) -> DataFrame:
    pool = V.pool(spark, sf).select("lang", "doc_id")
    n = F.count("*")
    plan = pool.groupBy("lang").agg(F.when(F.col("lang") == "en", n + 7).when(F.col("lang") == "de", 3).otherwise(2 * n + 1).alias("quota"))
    return S.repeat_to(pool, "doc_id", plan, ["lang"], SEED)


@register("split_hash", f"SELECT doc_id, CASE WHEN ('0x' || substr({HASH}, 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents")
def split_hash(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id", S.hash_split(F.col("doc_id"), SEED, 0.1).alias("split"))


@register("split_threshold", f"SELECT doc_id, floor(('0x' || substr({HASH}, 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 * 10000)::BIGINT AS slot FROM documents")
def split_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id", F.floor(unit_interval(seeded(SEED, F.col("doc_id"))) * 10000).cast("long").alias("slot"))


@register("part_hash", "SELECT doc_id, (('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % 64)::BIGINT AS part FROM documents")
def part_hash(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id", partition_of(F.col("doc_id"), 64).alias("part"))


_GROUPS = "g AS (SELECT source, row_number() OVER (ORDER BY sha256('42:' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))"


@register("split_shuffle", f"WITH {_GROUPS} SELECT doc_id, source, CASE WHEN r <= round_even(n * 0.9, 0) THEN 'train' ELSE 'val' END AS split FROM documents JOIN g USING (source)")
def split_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return S.cut_split(V.table(spark, sf, "documents").select("doc_id", "source"), "source", SEED, [("train", 0.9)], "val")


@register("split_three_way", f"WITH {_GROUPS} SELECT doc_id, source, CASE WHEN r <= round_even(n * 0.1, 0) THEN 'test' WHEN r <= round_even(n * 0.1, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'train' END AS split FROM documents JOIN g USING (source)")
def split_three_way(spark: SparkSession, sf: str) -> DataFrame:
    return S.cut_split(V.table(spark, sf, "documents").select("doc_id", "source"), "source", SEED, [("test", 0.1), ("val", 0.15)], "train")


_LR = """e AS (SELECT src, lang, weight, total * weight / sum(weight) OVER (PARTITION BY src) AS exact, total FROM w),
    f AS (SELECT *, floor(exact) AS fl FROM e),
    l AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY fl - exact, lang) AS rk, total - sum(fl) OVER (PARTITION BY src) AS extra FROM f)
    SELECT src, lang, weight::BIGINT AS weight, (fl + CASE WHEN rk <= extra THEN 1 ELSE 0 END)::BIGINT AS quota FROM l"""


@register("qta_largest_remainder", f"WITH {V.POOL}, w AS (SELECT src, lang, count(*)::DOUBLE AS weight, 1001.0::DOUBLE AS total FROM pool GROUP BY ALL), {_LR}")
def qta_largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    weights = V.pool(spark, sf).groupBy("src", "lang").agg(F.count("*").alias("weight"))
    return Q.largest_remainder(weights, "lang", F.lit(1001), ["src"])


@register(
    "qta_fixed_order",
    """WITH w AS (SELECT * FROM (VALUES ('count', 0.25::DOUBLE, 1), ('comparison', 0.3::DOUBLE, 2), ('color', 0.15::DOUBLE, 3), ('other', 0.3::DOUBLE, 4)) t(task, weight, place)),
    f AS (SELECT *, floor(1003 * weight) AS fl FROM w)
    SELECT task, weight, (fl + CASE WHEN place <= 1003 - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f""",
)
def qta_fixed_order(spark: SparkSession, sf: str) -> DataFrame:
    weights = spark.createDataFrame([("count", 0.25), ("comparison", 0.3), ("color", 0.15), ("other", 0.3)], "task string, weight double")
    return Q.fixed_order(weights, "task", 1003, ["count", "comparison", "color", "other"])


@register("qta_plan_budget", f"WITH {V.POOL} SELECT src, n_rows, (ceil(n_rows / 0.8::DOUBLE / 32) * 32)::BIGINT AS exposures, ceil(n_rows / 0.8::DOUBLE / 32)::BIGINT AS steps FROM (SELECT src, count(*) AS n_rows FROM pool GROUP BY src)")
def qta_plan_budget(spark: SparkSession, sf: str) -> DataFrame:
    n = V.pool(spark, sf).groupBy("src").agg(F.count("*").alias("n_rows"))
    exposures, steps = Q.plan_budget(F.col("n_rows"), 0.8, 32)
    return n.select("src", "n_rows", exposures.alias("exposures"), steps.alias("steps"))


@register("qta_batch_plan", "SELECT workers::BIGINT AS workers, (32 // (2 * workers))::BIGINT AS accumulation, 9600::BIGINT AS exposures FROM (VALUES (1), (2), (4), (8)) t(workers)")
def qta_batch_plan(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(Q.batch_plan([1, 2, 4, 8], 2, 32, 300), "workers long, accumulation long, exposures long")


#: min rows of a bucket
SPARSE = 20
_MERGE = f"""sz AS (SELECT lang, raw_bucket, count(*) AS n FROM pool WHERE src = 'main' GROUP BY ALL),
    m AS (SELECT lang, raw_bucket, CASE WHEN min(n) OVER (PARTITION BY lang) >= {SPARSE} THEN raw_bucket WHEN sum(n) OVER (PARTITION BY lang) >= {SPARSE} THEN 'task:' || lang ELSE 'other' END AS bucket FROM sz)"""


@register("bkt_sparse_merge", f"WITH {V.POOL}, {_MERGE} SELECT doc_id, lang, raw_bucket, coalesce(bucket, 'other') AS merged_bucket FROM pool LEFT JOIN m USING (lang, raw_bucket)")
def bkt_sparse_merge(spark: SparkSession, sf: str) -> DataFrame:
    pool = V.pool(spark, sf).select("doc_id", "src", "lang", "raw_bucket")
    return Q.merge_sparse(pool, "lang", "raw_bucket", SPARSE, F.col("src") == "main").select("doc_id", "lang", "raw_bucket", "merged_bucket")


@register("bkt_sparse_merge_low", f"WITH {V.POOL}, {_MERGE.replace(f'>= {SPARSE}', '>= 3')} SELECT doc_id, lang, raw_bucket, coalesce(bucket, 'other') AS merged_bucket FROM pool LEFT JOIN m USING (lang, raw_bucket)")
def bkt_sparse_merge_low(spark: SparkSession, sf: str) -> DataFrame:
    pool = V.pool(spark, sf).select("doc_id", "src", "lang", "raw_bucket")
    return Q.merge_sparse(pool, "lang", "raw_bucket", 3, F.col("src") == "main").select("doc_id", "lang", "raw_bucket", "merged_bucket")


def _recipe_pool(spark: SparkSession, sf: str) -> DataFrame:
    pool = Q.merge_sparse(V.pool(spark, sf), "lang", "raw_bucket", SPARSE, F.col("src") == "main")
    bucket = F.when(F.col("src") == "main", F.col("merged_bucket")).otherwise(F.col("src"))
    return pool.select(F.col("src").alias("source"), bucket.alias("bucket"), "doc_id")


SHARES = [("main", 0.8), ("replay_vl", 0.15), ("replay_text", 0.05)]
_RECIPE = f"""WITH {V.POOL}, {_MERGE},
    p AS (SELECT src AS source, CASE WHEN src = 'main' THEN coalesce(bucket, 'other') ELSE src END AS bucket, doc_id FROM pool LEFT JOIN m USING (lang, raw_bucket)),
    t AS (SELECT 2 * count(*) AS total FROM pool),
    s AS (SELECT source, total, total * weight / sum(weight) OVER () AS exact FROM (VALUES ('main', 0.8::DOUBLE), ('replay_vl', 0.15::DOUBLE), ('replay_text', 0.05::DOUBLE)) v(source, weight), t),
    sq AS (SELECT source, (floor(exact) + CASE WHEN row_number() OVER (ORDER BY floor(exact) - exact, source) <= total - sum(floor(exact)) OVER () THEN 1 ELSE 0 END)::BIGINT AS sq FROM s),
    b AS (SELECT source, bucket, sq, sq * n::DOUBLE / sum(n) OVER (PARTITION BY source) AS exact FROM (SELECT source, bucket, count(*)::DOUBLE AS n FROM p GROUP BY ALL) JOIN sq USING (source)),
    bq AS (SELECT source, bucket, (floor(exact) + CASE WHEN row_number() OVER (PARTITION BY source ORDER BY floor(exact) - exact, bucket) <= sq - sum(floor(exact)) OVER (PARTITION BY source) THEN 1 ELSE 0 END)::BIGINT AS quota FROM b)"""


@register("recipe_quotas", f"{_RECIPE} SELECT source, bucket, quota FROM bq")
def recipe_quotas(spark: SparkSession, sf: str) -> DataFrame:
    pool = _recipe_pool(spark, sf)
    total = 2 * pool.count()
    sources = spark.createDataFrame(SHARES, "source string, weight double")
    quotas = Q.largest_remainder(sources, "source", F.lit(total)).select("source", F.col("quota").alias("source_quota"))
    weights = pool.groupBy("source", "bucket").agg(F.count("*").alias("weight")).join(quotas, "source")
    return Q.largest_remainder(weights, "bucket", F.col("source_quota"), ["source"]).select("source", "bucket", "quota")


@register(
    "recipe_materialise",
    f"""{_RECIPE}, r AS (SELECT source, bucket, doc_id, quota, count(*) OVER w0 AS n, row_number() OVER (PARTITION BY source, bucket ORDER BY {HASH}, doc_id) AS rk FROM p JOIN bq USING (source, bucket) WINDOW w0 AS (PARTITION BY source, bucket)),
    c AS (SELECT *, quota // n + CASE WHEN rk <= quota % n THEN 1 ELSE 0 END AS copies FROM r),
    x AS (SELECT source, bucket, doc_id, unnest(range(1, copies + 1))::INTEGER AS copy_no FROM c WHERE copies > 0)
    SELECT *, row_number() OVER (ORDER BY sha256('42:' || doc_id || '#' || copy_no), doc_id || '#' || copy_no)::BIGINT AS exposure FROM x""",
)
def recipe_materialise(spark: SparkSession, sf: str) -> DataFrame:
    pool = _recipe_pool(spark, sf)
    sources = spark.createDataFrame(SHARES, "source string, weight double")
    return Q.materialise_recipe(pool, "doc_id", sources, 2 * pool.count(), 4, SEED)


@register(
    "recipe_fallback",
    f"""WITH {V.POOL}, n AS (SELECT count(*) FILTER (src = 'replay_text') AS text_rows FROM pool)
    SELECT source, CASE WHEN text_rows >= 7000 THEN share WHEN source = 'replay_vl' THEN 0.2::DOUBLE WHEN source = 'replay_text' THEN 0.0::DOUBLE ELSE share END AS share FROM n,
    (VALUES ('main', 0.8::DOUBLE), ('replay_vl', 0.15::DOUBLE), ('replay_text', 0.05::DOUBLE)) v(source, share)""",
)
def recipe_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Where the text pool is not full, its share goes to the image-text pool."""
    full = V.pool(spark, sf).agg((F.count_if(F.col("src") == "replay_text") >= 7000).alias("full"))
    moved = F.when(F.col("source") == "replay_vl", F.round(F.lit(0.15) + F.lit(0.05), 6)).when(F.col("source") == "replay_text", 0.0).otherwise(F.col("share"))
    shares = spark.createDataFrame(SHARES, "source string, share double")
    return shares.join(F.broadcast(full)).select("source", F.when(F.col("full"), F.col("share")).otherwise(moved).alias("share"))  # one row


@register(
    "mix_interleave",
    f"""WITH {V.POOL}, k AS (SELECT src, doc_id FROM pool WHERE n_chars > 200 QUALIFY row_number() OVER (PARTITION BY src ORDER BY {HASH}, doc_id) <= 80)
    SELECT src, doc_id, row_number() OVER (ORDER BY sha256('mix:' || doc_id), doc_id)::BIGINT AS position FROM k""",
)
def mix_interleave(spark: SparkSession, sf: str) -> DataFrame:
    kept = S.sample_per_group(V.pool(spark, sf).where("n_chars > 200").select("src", "doc_id"), "doc_id", 80, SEED, ["src"])
    return S.hash_rank(kept, "doc_id", "mix", name="position")


@register(
    "mix_round_robin",
    f"""WITH {V.POOL}, r AS (SELECT src, doc_id, row_number() OVER (PARTITION BY src ORDER BY {HASH}, doc_id) AS rk FROM pool)
    SELECT src, doc_id, ((rk - 1) // CASE src WHEN 'main' THEN 16 WHEN 'replay_vl' THEN 3 ELSE 1 END)::BIGINT AS turn FROM r""",
)
def mix_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a round robin that takes 16, 3 and 1 rows of the pools."""
    ranked = S.hash_rank(V.pool(spark, sf).select("src", "doc_id"), "doc_id", SEED, ["src"])
    take = F.when(F.col("src") == "main", 16).when(F.col("src") == "replay_vl", 3).otherwise(1)
    return ranked.select("src", "doc_id", F.floor((F.col("rank") - 1) / take).alias("turn"))


@register("agg_repeat_hist", f"WITH x AS ({_repeat_sql('(n * 5) // 2', 'src', f'WITH {V.POOL}')}), c AS (SELECT src, doc_id, count(*) AS repeats FROM x GROUP BY ALL) SELECT src, repeats, count(*) AS n_samples FROM c GROUP BY ALL")
def agg_repeat_hist(spark: SparkSession, sf: str) -> DataFrame:
    repeats = smp_cap_repeat(spark, sf).groupBy("src", "doc_id").agg(F.count("*").alias("repeats"))
    return repeats.groupBy("src", "repeats").agg(F.count("*").alias("n_samples"))


@register(
    "gate_capacity",
    f"WITH {V.POOL} SELECT src, n_rows, quota, quota <= n_rows * 4 AS fits FROM (SELECT src, count(*) AS n_rows, CASE src WHEN 'main' THEN 1600 WHEN 'replay_vl' THEN 300 ELSE 100 END::BIGINT AS quota FROM pool GROUP BY src)",
)
def gate_capacity(spark: SparkSession, sf: str) -> DataFrame:
    quota = F.when(F.col("src") == "main", 1600).when(F.col("src") == "replay_vl", 300).otherwise(100).cast("long")
    n = V.pool(spark, sf).groupBy("src").agg(F.count("*").alias("n_rows"))
    return n.select("src", "n_rows", quota.alias("quota"), (quota <= F.col("n_rows") * 4).alias("fits"))
