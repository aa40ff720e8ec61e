"""Queries: gates, joins, set operations, deduplication, quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import dedup as DD
from millrace.operators import gates as G
from millrace.operators import metrics as M
from millrace.operators import sampling as S
from millrace.plans import views as V
from millrace.plans.catalog import register

_CHECKS = [
    ("data", "rows", "min", 100.0, 10.0, None),
    ("data", "decode_failures", "max", 0.0005, 0.001, None),
    ("split", "overlap", "equal", 2.0, 0.0, None),
    ("quality", "parse_rate", "review_if_below", 0.998, 0.995, 0.999),
    ("quality", "valid_rate", "review_if_below", 0.9995, 0.995, 0.999),
    ("empty", None, None, None, None, None),
]
_CHECK_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in row) + ")" for row in _CHECKS) + ") t(gate, name, rule, observed, threshold, review)"
_STATUS = """CASE rule WHEN 'max' THEN CASE WHEN observed <= threshold THEN 'PASS' ELSE 'FAIL' END WHEN 'min' THEN CASE WHEN observed >= threshold THEN 'PASS' ELSE 'FAIL' END
    WHEN 'equal' THEN CASE WHEN observed = threshold THEN 'PASS' ELSE 'FAIL' END WHEN 'review_if_below' THEN CASE WHEN observed >= review THEN 'PASS' WHEN observed >= threshold THEN 'REVIEW' ELSE 'FAIL' END END"""


def _checks(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(_CHECKS, "gate string, name string, rule string, observed double, threshold double, review double")
    return df.withColumn("status", G.check_status(F.col("rule"), F.col("observed"), F.col("threshold"), F.col("review")))


@register("gate_status", f"WITH s AS (SELECT *, {_STATUS} AS status FROM {_CHECK_SQL}) SELECT gate, CASE max(CASE status WHEN 'FAIL' THEN 3 WHEN 'REVIEW' THEN 2 WHEN 'PASS' THEN 1 END) WHEN 3 THEN 'FAIL' WHEN 1 THEN 'PASS' ELSE 'REVIEW' END AS status, count(name)::BIGINT AS n_checks FROM s GROUP BY gate")
def gate_status(spark: SparkSession, sf: str) -> DataFrame:
    return _checks(spark).groupBy("gate").agg(G.worst().alias("status"), F.count("name").alias("n_checks"))


@register("gate_violations", f"WITH s AS (SELECT *, {_STATUS} AS status FROM {_CHECK_SQL}) SELECT gate || ': ' || name || ' is ' || status AS violation FROM s WHERE status <> 'PASS'")
def gate_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _checks(spark).where("status <> 'PASS'").select(F.concat("gate", F.lit(": "), "name", F.lit(" is "), "status").alias("violation"))


@register("gate_leakage", f"WITH {V.POOL}, s AS (SELECT group_id, CASE WHEN doc_id % 97 = 0 OR group_id = 'src3' THEN 'val' ELSE 'train' END AS split FROM pool) SELECT group_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split)::BIGINT AS n_splits FROM s GROUP BY group_id HAVING count(DISTINCT split) > 1")
def gate_leakage(spark: SparkSession, sf: str) -> DataFrame:
    split = F.when((F.col("doc_id") % 97 == 0) | (F.col("group_id") == "src3"), "val").otherwise("train")
    return G.leakage(V.pool(spark, sf).select("group_id", split.alias("split")), "group_id")


@register("gate_pool_contract", "SELECT (count(*) - count(DISTINCT doc_id))::BIGINT AS duplicate_ids, count(*) FILTER (text IS NULL OR text = '')::BIGINT AS empty_texts, count(*) FILTER (lang IS NULL OR lang = '')::BIGINT AS missing_buckets, count(*)::BIGINT AS n_rows FROM documents")
def gate_pool_contract(spark: SparkSession, sf: str) -> DataFrame:
    d = V.table(spark, sf, "documents")
    blank = lambda c: F.count_if(F.col(c).isNull() | (F.col(c) == ""))
    return d.agg((F.count("*") - F.count_distinct("doc_id")).alias("duplicate_ids"), blank("text").alias("empty_texts"), blank("lang").alias("missing_buckets"), F.count("*").alias("n_rows"))


@register("gate_balance", "SELECT count(*)::BIGINT AS n_groups, min(n)::BIGINT AS low, max(n)::BIGINT AS high, min(n) = max(n) AS balanced FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def gate_balance(spark: SparkSession, sf: str) -> DataFrame:
    n = V.table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_groups"), F.min("n").alias("low"), F.max("n").alias("high"), (F.min("n") == F.max("n")).alias("balanced"))


@register("gate_conservation", "SELECT count(*)::BIGINT AS n_in, count(*) FILTER (n_chars BETWEEN 200 AND 10000)::BIGINT AS accepted, count(*) FILTER (n_chars > 10000)::BIGINT AS review, count(*) FILTER (n_chars < 200)::BIGINT AS rejected, TRUE AS conserved FROM documents")
def gate_conservation(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("n_chars") < 200, "rejected").when(F.col("n_chars") <= 10000, "accepted").otherwise("review")
    d = V.table(spark, sf, "documents").select(state.alias("state"))
    n = d.agg(F.count("*").alias("n_in"), *[F.count_if(F.col("state") == s).alias(s) for s in ("accepted", "review", "rejected")])
    return n.withColumn("conserved", F.col("n_in") == F.col("accepted") + F.col("review") + F.col("rejected"))


@register("gate_skew", "WITH s AS (SELECT source, sum(n_chars) AS tokens FROM documents GROUP BY source) SELECT max(tokens)::BIGINT AS largest, round(median(tokens), 6) AS middle, max(tokens) > 2 * median(tokens) AS skewed FROM s")
def gate_skew(spark: SparkSession, sf: str) -> DataFrame:
    s = V.table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("tokens"))
    return s.agg(F.max("tokens").alias("largest"), F.round(F.median("tokens"), 6).alias("middle"), (F.max("tokens") > 2 * F.median("tokens")).alias("skewed"))


@register(
    "gate_recompute_metrics",
    f"""WITH {V.NLL}, r AS (SELECT source, sum(sum_nll)::DOUBLE / sum(tokens)::DOUBLE AS mean_nll FROM nll GROUP BY source), s AS (SELECT source, CASE WHEN source = 'src5' THEN mean_nll * 1.001 ELSE mean_nll * 1.0000001 END AS stored, mean_nll FROM r)
    SELECT source, abs(stored - mean_nll) <= greatest(1e-6 * greatest(abs(stored), abs(mean_nll)), 1e-8) AS matches FROM s""",
)
def gate_recompute_metrics(spark: SparkSession, sf: str) -> DataFrame:
    r = V.nll(spark, sf).groupBy("source").agg((F.sum("sum_nll").cast("double") / F.sum("tokens").cast("double")).alias("mean_nll"))
    stored = F.when(F.col("source") == "src5", F.col("mean_nll") * 1.001).otherwise(F.col("mean_nll") * 1.0000001)
    slack = F.greatest(F.lit(1e-6) * F.greatest(F.abs(stored), F.abs("mean_nll")), F.lit(1e-8))
    return r.select("source", (F.abs(stored - F.col("mean_nll")) <= slack).alias("matches"))


@register(
    "gate_contamination",
    r"""WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents), b AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM benchmark)
    SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items FROM d JOIN b ON contains(d.t, b.t) GROUP BY doc_id""",
)
def gate_contamination(spark: SparkSession, sf: str) -> DataFrame:
    return DD.contamination(V.table(spark, sf, "documents"), V.table(spark, sf, "benchmark"), "doc_id", "item_id")


@register(
    "gate_contamination_ngram",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
    i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM b), n AS (SELECT item_id, count(*) AS own FROM i GROUP BY item_id),
    h AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM d)
    SELECT doc_id, item_id, round(count(*)::DOUBLE / any_value(own), 6) AS share FROM h JOIN i USING (g) JOIN n USING (item_id) GROUP BY ALL HAVING count(*) >= 0.5 * any_value(own)""",
)
def gate_contamination_ngram(spark: SparkSession, sf: str) -> DataFrame:
    return DD.ngram_overlap(V.table(spark, sf, "documents"), V.table(spark, sf, "benchmark"), "doc_id", "item_id", 5, 0.5)


@register(
    "gate_levels",
    """WITH c AS (SELECT * FROM (SELECT source, unnest(['G0', 'G1', 'G2', 'G3', 'G4', 'G5', 'G6', 'G7']) AS level, unnest([CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN count(*) FILTER (text IS NULL OR text = '') = 0 THEN 'PASS' ELSE 'FAIL' END,
        CASE WHEN count(*) = count(DISTINCT text) THEN 'PASS' ELSE 'REVIEW' END, CASE WHEN count(DISTINCT lang) >= 2 THEN 'PASS' ELSE 'REVIEW' END, CASE WHEN max(n_chars) <= 50 * avg(n_chars) THEN 'PASS' ELSE 'FAIL' END, 'PASS', 'PASS', CASE WHEN source = 'src3' THEN NULL ELSE 'PASS' END]) AS status FROM documents GROUP BY source) WHERE status IS NOT NULL),
    a AS (SELECT source, CASE max(CASE status WHEN 'FAIL' THEN 3 WHEN 'REVIEW' THEN 2 ELSE 1 END) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'REVIEW' ELSE CASE WHEN count(DISTINCT level) < 8 THEN 'REVIEW' ELSE 'PASS' END END AS status, count(DISTINCT level)::BIGINT AS n_levels, min(CASE WHEN status = 'FAIL' THEN level END) AS blocked_by FROM c GROUP BY source)
    SELECT source, n_levels, blocked_by, status, CASE status WHEN 'FAIL' THEN 'blocked' WHEN 'REVIEW' THEN 'experiment' ELSE 'publish' END AS decision FROM a""",
)
def gate_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each source may be published, from a check for each level; one source lacks its last level."""
    facts = V.table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("blank"), F.count_distinct("text").alias("texts"), F.count_distinct("lang").alias("langs"), F.max("n_chars").alias("most"), F.avg("n_chars").alias("mean")
    )
    ok = lambda c, other="FAIL": F.when(c, "PASS").otherwise(other)
    status = [ok(F.col("n") > 0), ok(F.col("blank") == 0), ok(F.col("n") == F.col("texts"), "REVIEW"), ok(F.col("langs") >= 2, "REVIEW"), ok(F.col("most") <= 50 * F.col("mean")), F.lit("PASS"), F.lit("PASS"), F.when(F.col("source") != "src3", "PASS")]
    checks = F.array(*[F.struct(F.lit(level).alias("level"), s.alias("status")) for level, s in zip(G.LEVELS, status, strict=True)])
    return G.release(facts.select("source", F.inline(checks)).where("status is not null"), ["source"])


@register("join_lookup", "SELECT o_orderkey, c_name, length(c_name)::BIGINT AS name_length FROM orders JOIN customer ON o_custkey = c_custkey")
def join_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Strict many-to-one lookup: a key without a partner would be an error, so the join may be inner."""
    c = V.table(spark, sf, "customer").select("c_custkey", "c_name")
    return V.table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", F.length("c_name").cast("long").alias("name_length"))


@register(
    "join_paired",
    f"""WITH {V.PAIRED}, b AS (SELECT doc_id, lang, base FROM paired WHERE doc_id % 41 <> 0), a AS (SELECT doc_id, CASE WHEN doc_id % 43 = 0 THEN 'xx' ELSE lang END AS lang, after FROM paired WHERE doc_id % 37 <> 0)
    SELECT CASE WHEN b.doc_id IS NULL THEN 'only_after' WHEN a.doc_id IS NULL THEN 'only_base' WHEN a.lang <> b.lang THEN 'changed_attribute' WHEN base AND NOT after THEN 'correct_to_wrong' WHEN NOT base AND after THEN 'wrong_to_correct' ELSE 'same' END AS outcome, count(*)::BIGINT AS n
    FROM b FULL JOIN a USING (doc_id) GROUP BY 1""",
)
def join_paired(spark: SparkSession, sf: str) -> DataFrame:
    p = V.paired(spark, sf)
    b = p.where("doc_id % 41 <> 0").select("doc_id", F.col("lang").alias("b_lang"), "base")
    a = p.where("doc_id % 37 <> 0").select(F.col("doc_id").alias("a_id"), F.when(F.col("doc_id") % 43 == 0, "xx").otherwise(F.col("lang")).alias("a_lang"), "after")
    outcome = (
        F.when(F.col("doc_id").isNull(), "only_after").when(F.col("a_id").isNull(), "only_base").when(~F.col("a_lang").eqNullSafe(F.col("b_lang")), "changed_attribute")
        .when(F.col("base") & ~F.col("after"), "correct_to_wrong").when(~F.col("base") & F.col("after"), "wrong_to_correct").otherwise("same")
    )
    return b.join(a, F.col("doc_id") == F.col("a_id"), "full_outer").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@register("join_optional_score", f"WITH {V.NLL} SELECT n.doc_id, tokens, quality = 1 AS correct, quality IS NOT NULL AS scored FROM nll n LEFT JOIN labels USING (doc_id)")
def join_optional_score(spark: SparkSession, sf: str) -> DataFrame:
    labels = V.table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("correct"))
    return V.nll(spark, sf).select("doc_id", "tokens").join(labels, "doc_id", "left").withColumn("scored", F.col("correct").isNotNull())


@register(
    "join_multiway",
    f"""WITH {V.POOL} SELECT p.src, p.lang, CASE WHEN r <= round_even(n * 0.9, 0) THEN 'train' ELSE 'val' END AS split, count(*)::BIGINT AS n_rows, count(quality)::BIGINT AS n_labelled
    FROM pool p JOIN (SELECT source, row_number() OVER (ORDER BY sha256('42:' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) g ON p.group_id = g.source LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
)
def join_multiway(spark: SparkSession, sf: str) -> DataFrame:
    split = S.cut_split(V.pool(spark, sf), "group_id", 42, [("train", 0.9)], "val")
    labelled = split.join(V.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return labelled.groupBy("src", "lang", "split").agg(F.count("*").alias("n_rows"), F.count("quality").alias("n_labelled"))


@register("cov_prediction", "SELECT lang, count(*)::BIGINT AS expected, count(l.doc_id)::BIGINT AS got, round(count(l.doc_id)::DOUBLE / count(*), 9) AS coverage FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def cov_prediction(spark: SparkSession, sf: str) -> DataFrame:
    got = V.table(spark, sf, "labels").select("doc_id", F.lit(1).alias("got"))
    d = V.table(spark, sf, "documents").select("doc_id", "lang").join(got, "doc_id", "left").groupBy("lang")
    return d.agg(F.count("*").alias("expected"), F.count("got").alias("got"), M.ratio(F.count("got"), F.count("*")).alias("coverage"))


@register("cov_missing", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def cov_missing(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id").join(V.table(spark, sf, "labels"), "doc_id", "left_anti")


@register("set_intersect", "SELECT doc_id FROM documents WHERE n_chars > 1000 INTERSECT SELECT doc_id FROM labels")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").where("n_chars > 1000").select("doc_id").intersect(V.table(spark, sf, "labels").select("doc_id"))


@register("set_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "customer").select("c_custkey").subtract(V.table(spark, sf, "orders").select("o_custkey"))


@register("set_union_all", "SELECT 'document' AS kind, doc_id AS id, n_chars FROM documents UNION ALL SELECT 'benchmark', item_id, length(text)::BIGINT FROM benchmark")
def set_union_all(spark: SparkSession, sf: str) -> DataFrame:
    a = V.table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "n_chars")
    return a.unionByName(V.table(spark, sf, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("n_chars")))


@register("dedup_first_wins", "SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS n_copies FROM documents GROUP BY sha256(text)")
def dedup_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return DD.first_of_content(V.table(spark, sf, "documents"), "doc_id", F.sha2("text", 256))


@register("dedup_content_hash", "SELECT 'image:' || sha256(html) AS image_id, max(page_id) AS page_id FROM pages GROUP BY 1")
def dedup_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Blobs by content hash, the last one wins."""
    return V.table(spark, sf, "pages").groupBy(F.concat(F.lit("image:"), F.sha2("html", 256)).alias("image_id")).agg(F.max("page_id").alias("page_id"))


@register(
    "dedup_conflict",
    """SELECT o_custkey, o_orderpriority, count(*)::BIGINT AS n, count(DISTINCT o_orderstatus)::BIGINT AS n_answers, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'review' WHEN count(*) > 1 THEN 'merge' ELSE 'keep' END AS decision FROM orders GROUP BY ALL""",
)
def dedup_conflict(spark: SparkSession, sf: str) -> DataFrame:
    g = V.table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_orderstatus").alias("n_answers"))
    return g.withColumn("decision", F.when(F.col("n_answers") > 1, "review").when(F.col("n") > 1, "merge").otherwise("keep"))


@register(
    "dedup_ngram_jaccard",
    r"""WITH RECURSIVE u AS (SELECT p_name AS text, min(p_partkey) AS node FROM part GROUP BY p_name), t AS (SELECT node, list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS g FROM u WHERE length(text) >= 3),
    e AS (SELECT node, len(g) AS n, unnest(g) AS gram FROM t),
    p AS (SELECT a.node AS a, b.node AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.gram = b.gram AND a.node <> b.node GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM p WHERE shared::DOUBLE / (na + nb - shared) >= 0.85),
    r(node, other) AS (SELECT node, node FROM u UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a)
    SELECT p_partkey AS id, class_id, n_links FROM part JOIN u ON p_name = text JOIN (SELECT node, min(other) AS class_id FROM r GROUP BY node) USING (node) JOIN (SELECT u.node, count(l.b)::BIGINT AS n_links FROM u LEFT JOIN l ON u.node = l.a GROUP BY u.node) USING (node)""",
)
def dedup_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return DD.ngram_classes(p, 3, 0.85)


@register(
    "qual_rule_chain",
    """WITH r AS (SELECT doc_id, list_filter([CASE WHEN n_chars < 50 THEN 'reject:too_short' END, CASE WHEN n_chars > 10000 THEN 'review:too_long' END, CASE WHEN quality = 0 THEN 'review:low_quality' END, CASE WHEN toxic = 1 THEN 'reject:toxic' END], lambda x: x IS NOT NULL) AS rules, quality FROM documents LEFT JOIN labels USING (doc_id))
    SELECT CASE WHEN len(list_filter(rules, lambda x: x LIKE 'reject%')) > 0 THEN 'quarantine' WHEN len(rules) > 0 THEN 'review' WHEN quality = 1 THEN 'gold' ELSE 'silver' END AS tier, array_to_string(rules, ',') AS rules, count(*)::BIGINT AS n FROM r GROUP BY ALL""",
)
def qual_rule_chain(spark: SparkSession, sf: str) -> DataFrame:
    d = V.table(spark, sf, "documents").select("doc_id", "n_chars").join(V.table(spark, sf, "labels"), "doc_id", "left")
    rules = F.array_compact(F.array(F.when(F.col("n_chars") < 50, "reject:too_short"), F.when(F.col("n_chars") > 10000, "review:too_long"), F.when(F.col("quality") == 0, "review:low_quality"), F.when(F.col("toxic") == 1, "reject:toxic")))
    d = d.withColumn("rules", rules)
    tier = F.when(F.exists("rules", lambda x: x.startswith("reject")), "quarantine").when(F.size("rules") > 0, "review").when(F.col("quality") == 1, "gold").otherwise("silver")
    return d.groupBy(tier.alias("tier"), F.array_join("rules", ",").alias("rules")).agg(F.count("*").alias("n"))
