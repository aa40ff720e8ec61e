"""Queries: sources, sinks, lineage, jobs, streaming, vectors, controller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import controller as C
from millrace.operators import jobs as J
from millrace.operators import lineage as L
from millrace.operators import vectors as X
from millrace.plans import views as V
from millrace.plans.catalog import register
from millrace.sources import io
from millrace.storage import new_path
from millrace.streaming import events as E


@register("src_jsonl_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def src_jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "jsonl")
    io.write_jsonl(V.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), path)
    return io.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@register("val_jsonl_errors", "SELECT CASE WHEN p_partkey % 9 = 0 THEN 'invalid_json' ELSE 'ok' END AS error, count(*)::BIGINT AS n, count(*)::BIGINT AS n_lines, sum(CASE WHEN p_partkey % 9 <> 0 AND p_partkey % 4 <> 0 THEN p_size ELSE 0 END)::BIGINT AS total FROM part GROUP BY 1")
def val_jsonl_errors(spark: SparkSession, sf: str) -> DataFrame:
    p = V.table(spark, sf, "part")
    size = F.when(F.col("p_partkey") % 4 == 0, F.lit('"x"')).otherwise(F.col("p_size").cast("string"))
    line = F.when(F.col("p_partkey") % 9 == 0, '{"size": ').otherwise(F.concat(F.lit('{"size": '), size, F.lit("}")))
    path = new_path(spark, "lines")
    p.select(line.alias("value")).write.text(path)
    read = io.read_jsonl_tolerant(spark, path, "size long")
    return read.groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"), F.count_distinct("file", "line_number").alias("n_lines"), F.coalesce(F.sum("record.size"), F.lit(0)).alias("total"))


@register("src_json_doc_explode", "SELECT p_partkey AS question_index, p_name AS question FROM part")
def src_json_doc_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that each list the questions of a hash range, written a file each and exploded."""
    path = new_path(spark, "document")
    p = V.table(spark, sf, "part")
    ranges = max(1, -(-p.count() // 2_000))
    rows = p.select(F.pmod(F.xxhash64("p_partkey"), F.lit(ranges)).alias("range"), F.struct(F.col("p_partkey").alias("question_index"), F.col("p_name").alias("question")).alias("q"))
    documents = rows.groupBy("range").agg(F.to_json(F.struct(F.collect_list("q").alias("questions"))).alias("value"))
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return io.read_documents(spark, path, "questions array<struct<question_index:long,question:string>>", "questions")


@register("src_first_rows", "SELECT o_orderkey, o_totalprice FROM orders LIMIT 100")
def src_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What an inspection shows: the first hundred rows as they stand in the file."""
    return io.first_rows(V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "_metadata"), 100).drop("_metadata")


@register("src_footers", "SELECT count(*)::BIGINT AS n_rows, 'o_orderkey,o_totalprice' AS columns, TRUE AS all_bounded FROM orders")
def src_footers(spark: SparkSession, sf: str) -> DataFrame:
    """Facts from the footers of a written table, without a scan."""
    path = new_path(spark, "footers")
    io.write_parquet(V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, rows_per_file=5_000)
    f = io.footers(spark, path)
    return f.agg(F.sum("n_rows").alias("n_rows"), F.array_join(F.min("columns"), ",").alias("columns"), (F.max("n_rows") <= 5_000).alias("all_bounded"))


@register("flt_limit_smoke", "SELECT p_partkey, FALSE AS complete FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def flt_limit_smoke(spark: SparkSession, sf: str) -> DataFrame:
    """A result with an explicit limit is marked as not complete."""
    p = V.table(spark, sf, "part").withColumn("down", -F.col("p_retailprice"))
    return io.limited(p, ["down", "p_partkey"], 20).select("p_partkey", "complete")


@register("join_blob", "SELECT n_nationkey, 'flag of ' || n_name AS content FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey % 5 = 0")
def join_blob(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with the content of the file that they name; some files are not there."""
    n = V.table(spark, sf, "nation").select("n_nationkey", "n_name")
    root = new_path(spark, "blobs")
    io.put_files(root, {f"{r.n_nationkey}.txt": f"flag of {r.n_name}".encode() for r in n.where("n_nationkey % 5 <> 0").collect()})  # a table of 25 rows
    named = n.withColumn("file", F.concat("n_nationkey", F.lit(".txt")))
    return io.with_blobs(named, io.list_files(spark, root), "file").select("n_nationkey", F.col("blob").cast("string").alias("content"))


@register("snk_blob_export", "SELECT c_mktsegment AS content, sha256(c_mktsegment) || '.txt' AS name, count(*)::BIGINT AS n FROM customer GROUP BY ALL")
def snk_blob_export(spark: SparkSession, sf: str) -> DataFrame:
    """Different contents as files named by their hash; the files are read back and met by name."""
    root = new_path(spark, "export")
    c = V.table(spark, sf, "customer").select(F.encode("c_mktsegment", "utf-8").alias("data"), F.lit(".txt").alias("suffix"))
    named = io.export_blobs(c, "data", "suffix", root).groupBy("name").agg(F.count("*").alias("n"))
    return io.with_blobs(named, io.list_files(spark, root), "name").select(F.col("blob").cast("string").alias("content"), "name", "n")


@register("src_parquet_project", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000")
def src_parquet_project(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_orderstatus")


@register("src_provenance", "SELECT count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_positions, 0::BIGINT AS first_position FROM orders")
def src_provenance(spark: SparkSession, sf: str) -> DataFrame:
    p = io.with_provenance(V.table(spark, sf, "orders").select("o_orderkey", "_metadata"))
    return p.agg(F.count("*").alias("n_rows"), F.count_distinct("file_name", "row_index").alias("n_positions"), F.min("row_index").alias("first_position"))


@register("snk_parquet_zstd", "SELECT doc_id, lang, n_chars FROM documents")
def snk_parquet_zstd(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "zstd")
    io.write_parquet(V.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), path, rows_per_file=256)
    return spark.read.parquet(path)


@register("snk_partitioned", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'de'")
def snk_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "by-lang")
    io.write_parquet(V.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), path, ["lang"])
    return spark.read.parquet(path).where("lang = 'de'").select("doc_id", "lang", "n_chars")


@register("st_event_append", "SELECT event_id, event_type FROM events")
def st_event_append(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "log")
    e = V.table(spark, sf, "events").select("event_id", "event_type")
    for part in (0, 1):
        io.append_jsonl(e.where(F.col("event_id") % 2 == part), path)
    return io.read_jsonl(spark, path, "event_id long, event_type string")


_REG = "(VALUES ('a', 1, 'SUCCEEDED', TRUE, 'h1'), ('b', 2, 'SUCCEEDED', TRUE, 'h2'), ('a', 3, 'FAILED', TRUE, 'h1'), ('c', 4, 'SUCCEEDED', NULL, 'h3'), ('b', 5, 'SUCCEEDED', TRUE, 'h4')) t(artifact_id, pos, status, complete, content)"


def _registry(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_REG}")


@register("lin_registry_latest", f"SELECT artifact_id, pos, status, coalesce(complete, FALSE) AS complete, content FROM {_REG} QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY pos DESC) = 1")
def lin_registry_latest(spark: SparkSession, sf: str) -> DataFrame:
    return L.latest(_registry(spark), "artifact_id", F.col("pos")).withColumn("complete", F.coalesce("complete", F.lit(False)))


@register("lin_resolve", f"WITH l AS (SELECT * FROM {_REG} QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY pos DESC) = 1) SELECT artifact_id, pos FROM l WHERE status = 'SUCCEEDED' AND coalesce(complete, FALSE) ORDER BY pos DESC LIMIT 1")
def lin_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """The latest artifact that is complete and succeeded."""
    return lin_registry_latest(spark, sf).where("status = 'SUCCEEDED' and complete").orderBy(F.desc("pos")).limit(1).select("artifact_id", "pos")


@register("lin_register", f"WITH l AS (SELECT artifact_id, content FROM {_REG} QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY pos DESC) = 1), n AS (SELECT * FROM (VALUES ('a', 'h1'), ('c', 'other'), ('d', 'h9')) t(artifact_id, content)) SELECT n.artifact_id, CASE WHEN l.content IS NULL THEN 'insert' WHEN l.content = n.content THEN 'noop' ELSE 'collision' END AS action FROM n LEFT JOIN l USING (artifact_id)")
def lin_register(spark: SparkSession, sf: str) -> DataFrame:
    new = spark.createDataFrame([("a", "h1"), ("c", "other"), ("d", "h9")], "artifact_id string, content string")
    return L.register(lin_registry_latest(spark, sf), new, "artifact_id", "content")


@register("lin_is_complete", "SELECT n_nationkey, n_nationkey % 7 <> 0 AND n_nationkey % 11 <> 4 AND n_nationkey % 5 NOT IN (1, 2) AS is_complete FROM nation")
def lin_is_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts that succeeded, are marked complete and are on disk: a file, or a folder with its marker."""
    k = F.col("n_nationkey")
    root = new_path(spark, "artifacts")
    registry = V.table(spark, sf, "nation").select(k, F.concat(F.lit(root + "/n"), k).alias("uri"), F.when(k % 7 == 0, "FAILED").otherwise("SUCCEEDED").alias("status"), (k % 11 != 4).alias("complete"))
    files = {}
    for r in registry.collect():  # a table of 25 rows
        kind = r.n_nationkey % 5  # 1: not there, 2: a folder without a marker, 3: a file, else a folder with its marker
        if kind != 1:
            files["n%d" % r.n_nationkey + {2: "/part", 3: ""}.get(kind, "/_SUCCESS")] = b""
    io.put_files(root, files)
    return L.is_complete(registry).select("n_nationkey", "is_complete")


@register(
    "lin_manifest_errors",
    """SELECT error, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter([CASE WHEN p_size % 7 = 0 THEN 'empty:uri' END, CASE WHEN p_size % 5 = 0 THEN 'empty:code_commit' END, CASE WHEN p_partkey % 11 = 0 THEN 'negative:row_count' END, CASE WHEN p_partkey % 13 < 2 THEN 'unsupported_status' END], lambda x: x IS NOT NULL)) AS error FROM part) GROUP BY error""",
)
def lin_manifest_errors(spark: SparkSession, sf: str) -> DataFrame:
    planted = {"uri": F.when(F.col("p_size") % 7 != 0, F.col("p_name")), "code_commit": F.when(F.col("p_size") % 5 == 0, "").otherwise("c0ffee")}
    p = V.table(spark, sf, "part").select(
        *[planted.get(c, F.lit("x")).alias(c) for c in L.REQUIRED],
        F.when(F.col("p_partkey") % 11 == 0, -1).otherwise(5).alias("row_count"),
        F.lit(0).alias("token_count"),
        F.lit(None).cast("long").alias("byte_count"),
        F.when(F.col("p_partkey") % 13 == 0, "LOST").when(F.col("p_partkey") % 13 != 1, "SUCCEEDED").alias("status"),
    )
    return p.select(F.explode(L.manifest_errors()).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@register("lin_ancestors", "WITH RECURSIVE up(id, ancestor, depth) AS (SELECT p_partkey, p_partkey // 3, 1 FROM part WHERE p_partkey > 0 UNION ALL SELECT id, ancestor // 3, depth + 1 FROM up WHERE ancestor > 0) SELECT id, ancestor, min(depth)::BIGINT AS depth FROM up GROUP BY ALL")
def lin_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    p = V.table(spark, sf, "part").where("p_partkey > 0")
    edges = p.select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent"))
    return L.ancestors(edges, p.select(F.col("p_partkey").alias("id")))


@register("lin_config_hash", """SELECT n_nationkey, sha256('{"name":"' || n_name || '","region":' || n_regionkey || '}') AS config_hash FROM nation""")
def lin_config_hash(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "nation").select("n_nationkey", F.sha2(F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))), 256).alias("config_hash"))


@register("lin_dir_hash", """SELECT sha256(string_agg(line, chr(0) ORDER BY line)) AS directory_hash, count(*)::BIGINT AS n_files FROM (SELECT 'sub/n' || n_nationkey || '.txt' || chr(0) || sha256(n_name) AS line FROM nation)""")
def lin_dir_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Hash of a folder from its files' relative paths and contents; markers and manifests do not count."""
    root = new_path(spark, "folder")
    files = {f"sub/n{r.n_nationkey}.txt": r.n_name.encode() for r in V.table(spark, sf, "nation").collect()}  # a table of 25 rows
    io.put_files(root, files | {"manifest.json": b"{}", "sub/stats.json": b"{}"})
    return L.directory_hash(io.list_files(spark, root), root.split("/")[-1])


_STATE = "CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'REVIEW' ELSE 'PENDING' END"
_JOBS = f"j AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts, {_STATE} AS status FROM events)"
_PAIRS = ", ".join(f"'{a}>{b}'" for a, bs in J.ALLOWED.items() for b in bs)


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return V.table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.row_number().over(w).cast("long").alias("seq"), "ts", F.expr(_STATE).alias("status"))


_TRANSITIONS = f"""WITH {_JOBS}, l AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS old_status FROM j)
    SELECT job_id, seq, status, old_status, CASE WHEN old_status IS NULL THEN status = 'PENDING' ELSE (old_status || '>' || status) IN ({_PAIRS}) END AS legal,
    count(*) FILTER (status = 'RUNNING' AND old_status IN ('FAILED', 'STALE', 'REVIEW')) OVER (PARTITION BY job_id ORDER BY seq)::BIGINT AS attempt FROM l"""


@register("st_transitions", _TRANSITIONS)
def st_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return J.checked_transitions(_jobs(spark, sf)).drop("ts")


@register("st_transitions_stream", _TRANSITIONS)
def st_transitions_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same steps as a stream with a state for each job."""
    path = new_path(spark, "steps")
    _jobs(spark, sf).select("job_id", "seq", "status").write.parquet(path)
    return E.run_available(E.checked_transitions(E.read_events(spark, path)))


@register("st_current_state", f"WITH {_JOBS} SELECT job_id, arg_max(status, seq) AS status, count(*)::BIGINT AS n_events FROM j GROUP BY job_id")
def st_current_state(spark: SparkSession, sf: str) -> DataFrame:
    return J.current_state(_jobs(spark, sf))


@register("st_resumable", f"WITH {_JOBS}, c AS (SELECT job_id, arg_max(status, seq) AS status FROM j GROUP BY job_id) SELECT job_id, status FROM c WHERE status IN ('FAILED', 'STALE', 'REVIEW')")
def st_resumable(spark: SparkSession, sf: str) -> DataFrame:
    return J.current_state(_jobs(spark, sf)).where(F.col("status").isin(*J.RESUMABLE)).select("job_id", "status")


@register("st_stale", f"WITH {_JOBS}, c AS (SELECT job_id, arg_max(status, seq) AS status, max(ts) AS ts FROM j GROUP BY job_id) SELECT job_id, ts FROM c WHERE status = 'RUNNING' AND ts < (SELECT max(ts) FROM events) - INTERVAL 600 MINUTES")
def st_stale(spark: SparkSession, sf: str) -> DataFrame:
    now = V.table(spark, sf, "events").agg(F.max("ts")).first()[0]
    return J.stale(_jobs(spark, sf), F.lit(now), 600)


def _event_files(spark: SparkSession, sf: str) -> str:
    """The events as a folder of files, with some written twice."""
    path = new_path(spark, "events")
    e = V.table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    e.unionByName(e.where("event_id % 10 = 0")).repartition(4).write.parquet(path)
    return path


@register("st_event_dedup", "SELECT event_id, event_type FROM events")
def st_event_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return E.run_available(E.deduplicated(E.read_events(spark, _event_files(spark, sf)), late="1 day").select("event_id", "event_type"))


@register("st_tumbling", "SELECT date_trunc('day', ts) AS day, event_type, count(*)::BIGINT AS n, round(sum(value::DECIMAL(18,6))::DOUBLE, 4) AS total FROM events GROUP BY ALL")
def st_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "events")
    V.table(spark, sf, "events").select("ts", "event_type", "value").repartition(4).write.parquet(path)
    out = E.run_available(E.tumbling(E.read_events(spark, path)), "complete")
    return out.withColumn("total", F.round(F.col("total").cast("double"), 4))


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@register("vec_normalise", f"SELECT vec_id, round(sqrt(list_dot_product({_UNIT}, {_UNIT})), 5) AS length, round(list_sum(list_transform({_UNIT}, lambda x: x * x)) / list_dot_product({_UNIT}, {_UNIT}), 6) AS unit FROM embeddings")
def vec_normalise(spark: SparkSession, sf: str) -> DataFrame:
    d = _vectors(spark, sf).withColumn("u", X.normalised(F.col("v")))
    return d.select(F.col("id").alias("vec_id"), F.round(F.sqrt(X.dot(F.col("v"), F.col("v"))), 5).alias("length"), F.round(X.dot(F.col("u"), F.col("u")), 6).alias("unit"))


_SIM = f"""u AS (SELECT vec_id, label, {_UNIT} AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS cand_id, a.label = b.label AS hit, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS similarity FROM u a JOIN u b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, cand_id) AS rank FROM s)"""


@register("vec_cosine_topk", f"WITH {_SIM} SELECT query_id, cand_id, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def vec_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf).select("id", "v")
    return X.top_k(v, v, 5).select("query_id", "cand_id", "rank")


@register("vec_recall_at_k", f"WITH {_SIM}, f AS (SELECT query_id, min(rank) FILTER (hit) AS first FROM r WHERE rank <= 10 GROUP BY query_id) SELECT round(avg(coalesce(first <= 1, FALSE)::INTEGER), 6) AS recall_at_1, round(avg(coalesce(first <= 5, FALSE)::INTEGER), 6) AS recall_at_5, round(avg(coalesce(first <= 10, FALSE)::INTEGER), 6) AS recall_at_10 FROM f")
def vec_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    labels = v.select("id", "label")
    ranked = X.top_k(v.select("id", "v"), v.select("id", "v"), 10)
    named = ranked.join(labels.withColumnsRenamed({"id": "query_id", "label": "ql"}), "query_id").join(labels.withColumnsRenamed({"id": "cand_id", "label": "cl"}), "cand_id")
    return X.recall_at(named.withColumn("hit", F.col("ql") == F.col("cl")), [1, 5, 10])


@register(
    "vec_contrastive_loss",
    f"""WITH u AS (SELECT vec_id AS id, vec_id // 64 AS batch, {_UNIT} AS e FROM embeddings), z AS (SELECT a.batch, a.id AS i, b.id AS j, 10 * list_dot_product(a.e, list_concat(b.e[2:], b.e[1:1])) AS z FROM u a JOIN u b USING (batch)),
    l AS (SELECT *, max(z) OVER (PARTITION BY batch, i) AS mi, max(z) OVER (PARTITION BY batch, j) AS mj FROM z), r AS (SELECT batch, i, any_value(mi) + ln(sum(exp(z - mi))) AS lse, max(z) FILTER (i = j) AS d, arg_max(j, z) AS best FROM l GROUP BY batch, i), c AS (SELECT batch, j, any_value(mj) + ln(sum(exp(z - mj))) AS lse FROM l GROUP BY batch, j)
    SELECT r.batch::BIGINT AS batch, count(*)::BIGINT AS n, round((avg(r.lse - d) + avg(c.lse - d)) / 2, 6) AS loss, round(avg((best = i)::INTEGER), 6) AS accuracy FROM r JOIN c ON r.batch = c.batch AND r.i = c.j GROUP BY r.batch""",
)
def vec_contrastive_loss(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    turned = F.concat(F.slice("v", F.lit(2), F.size("v") - 1), F.slice("v", 1, 1))
    return X.contrastive_loss(v.select("id", F.col("v").alias("image"), turned.alias("text")), 10.0, 64)


_BUCKETS = f"{V.SCORED}, b AS (SELECT source AS bucket, count(correct) AS n, count(*) FILTER (correct) AS k, count(*)::DOUBLE AS size FROM scored GROUP BY source), a AS (SELECT bucket, n, k, k::DOUBLE / n AS acc, size / sum(size) OVER () AS share FROM b)"


def _buckets(spark: SparkSession, sf: str) -> DataFrame:
    d = V.scored(spark, sf).groupBy(F.col("source").alias("bucket")).agg(F.count("correct").alias("n"), F.count_if("correct").alias("k"), F.count("*").cast("double").alias("size"))
    return d.withColumn("acc", F.try_divide(F.col("k").cast("double"), F.col("n"))).withColumn("share", F.col("size") / F.sum("size").over(Window.partitionBy())).drop("size")


@register("ctl_deficit", f"WITH {_BUCKETS} SELECT bucket, round(greatest(0, 0.9 - acc), 9) AS deficit FROM a")
def ctl_deficit(spark: SparkSession, sf: str) -> DataFrame:
    return _buckets(spark, sf).select("bucket", F.round(C.deficit(F.lit(0.9), F.col("acc")), 9).alias("deficit"))


@register("ctl_weight_update", f"WITH {_BUCKETS} SELECT bucket, round(least(greatest(share * (1 + 3 * greatest(0, 0.9 - acc)), 0.5 * share), 2 * share), 9) AS weight FROM a")
def ctl_weight_update(spark: SparkSession, sf: str) -> DataFrame:
    return _buckets(spark, sf).select("bucket", F.round(C.multiplicative(F.col("share"), C.deficit(F.lit(0.9), F.col("acc")), 3.0), 9).alias("weight"))


@register(
    "ctl_wilson_score",
    f"""WITH {_BUCKETS} SELECT bucket, CASE WHEN n < 10 THEN 'explore_only' ELSE 'score' END AS mode,
    CASE WHEN n >= 10 THEN round(greatest(0, 0.9 - (acc + 3.8416 / (2 * n) + 1.96 * sqrt(acc * (1 - acc) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) END AS score FROM a""",
)
def ctl_wilson_score(spark: SparkSession, sf: str) -> DataFrame:
    """Deficit against the upper bound of accuracy; buckets with few rows are only explored."""
    from millrace.operators.metrics import wilson

    _, high = wilson(F.col("k"), F.col("n"))
    enough = F.col("n") >= 10
    return _buckets(spark, sf).select("bucket", F.when(enough, "score").otherwise("explore_only").alias("mode"), F.when(enough, F.round(F.greatest(F.lit(0.0), 0.9 - high), 6)).alias("score"))


@register("ctl_exp_update", f"WITH {_BUCKETS}, e AS (SELECT bucket, share * exp(0.5 * 0.7::DOUBLE * 0.7::DOUBLE * greatest(0, 0.9 - acc)) AS q FROM a) SELECT bucket, round(q / sum(q) OVER (), 9) AS share FROM e")
def ctl_exp_update(spark: SparkSession, sf: str) -> DataFrame:
    d = _buckets(spark, sf).withColumn("gap", C.deficit(F.lit(0.9), F.col("acc")))
    return C.exponential(d, "share", "gap", 0.5, 3).select("bucket", F.round("share", 9).alias("share"))


@register("ctl_outer_bounds", f"WITH {_BUCKETS} SELECT bucket, round(least(greatest(least(greatest(acc / 10, share - 0.01), share + 0.01), 0.02), 0.2), 9) AS share FROM a")
def ctl_outer_bounds(spark: SparkSession, sf: str) -> DataFrame:
    step = C.outer_step(F.col("share"), F.col("acc") / 10, F.lit(0.02), F.lit(0.2), 0.01)
    return _buckets(spark, sf).select("bucket", F.round(step, 9).alias("share"))


@register(
    "ctl_inner_mix",
    f"""WITH {_BUCKETS}, m AS (SELECT bucket, share, n < 12 OR bucket = 'src7' AS frozen, share * least(greatest(2 - acc, 0.8), 1.5) AS moved FROM a), f AS (SELECT *, 1 - coalesce(sum(share) FILTER (frozen) OVER (), 0) AS free FROM m)
    SELECT bucket, round(CASE WHEN frozen THEN share ELSE (0.8 * moved / sum(moved) FILTER (NOT frozen) OVER () + 0.2 * share / sum(share) FILTER (NOT frozen) OVER ()) * free END, 9) AS new_share FROM f""",
)
def ctl_inner_mix(spark: SparkSession, sf: str) -> DataFrame:
    d = _buckets(spark, sf).withColumn("frozen", (F.col("n") < 12) | (F.col("bucket") == "src7")).withColumn("multiplier", 2 - F.col("acc"))
    return C.inner_mix(d, "share", "share", "multiplier", "frozen").select("bucket", F.round("new_share", 9).alias("new_share"))


_GAINS = f"{V.HISTORY}, g AS (SELECT sample_id, round, loss - lag(loss, 1, 0) OVER (PARTITION BY sample_id ORDER BY round) AS gain, loss FROM history)"


@register(
    "ctl_gate",
    f"""WITH {_GAINS}, r AS (SELECT *, sum((gain >= 1)::INTEGER) OVER (PARTITION BY sample_id ORDER BY round) AS run FROM g), s AS (SELECT *, sum((gain < 1)::INTEGER) OVER (PARTITION BY sample_id, run ORDER BY round) AS streak FROM r)
    SELECT sample_id, round, streak::BIGINT AS streak, CASE WHEN streak >= 2 THEN 'PAUSED' ELSE 'ACTIVE' END AS state FROM s""",
)
def ctl_gate(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("sample_id").orderBy("round")
    g = V.history(spark, sf).withColumn("gain", F.col("loss") - F.lag("loss", 1, 0.0).over(w))
    return C.gain_gate(g, "sample_id", "round", "gain", 1.0).select("sample_id", "round", "streak", "state")


@register(
    "ctl_oscillation",
    f"""WITH {V.HISTORY}, s AS (SELECT sample_id, round, sign(loss - lag(loss) OVER (PARTITION BY sample_id ORDER BY round)) AS s FROM history), t AS (SELECT *, s * lag(s) OVER (PARTITION BY sample_id ORDER BY round) < 0 AS t FROM s)
    SELECT sample_id, round, coalesce(t AND lag(t) OVER (PARTITION BY sample_id ORDER BY round), FALSE) AS oscillating FROM t""",
)
def ctl_oscillation(spark: SparkSession, sf: str) -> DataFrame:
    return C.oscillating(V.history(spark, sf).select("sample_id", "round", "loss"), "sample_id", "round", "loss").drop("loss")


@register("ctl_ema", f"WITH {V.HISTORY}, l AS (SELECT sample_id, list(loss ORDER BY round) AS v FROM history GROUP BY sample_id) SELECT sample_id, round(list_reduce(v, lambda a, x: 0.7 * a + 0.3 * x), 6) AS ema FROM l")
def ctl_ema(spark: SparkSession, sf: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("round", "loss"))), lambda x: x["loss"])
    return V.history(spark, sf).groupBy("sample_id").agg(ordered.alias("v")).select("sample_id", F.round(C.ema(F.col("v"), 0.7), 6).alias("ema"))


@register("ctl_priority", f"WITH {_BUCKETS} SELECT bucket, round(0.5 * (1 - acc) + 0.3 * share + 0.2 / n - 0.1 * CASE WHEN n < 20 THEN 1 ELSE 0 END, 9) AS priority FROM a")
def ctl_priority(spark: SparkSession, sf: str) -> DataFrame:
    noise = (F.col("n") < 20).cast("int")
    return _buckets(spark, sf).select("bucket", F.round(0.5 * (1 - F.col("acc")) + 0.3 * F.col("share") + 0.2 / F.col("n") - 0.1 * noise, 9).alias("priority"))


@register("ctl_stage", f"WITH {_BUCKETS} SELECT bucket, CASE WHEN n = 0 THEN 'stop' WHEN acc >= 0.9 THEN 'advance' WHEN acc < 0.7 THEN 'rollback' ELSE 'stay' END AS decision FROM a")
def ctl_stage(spark: SparkSession, sf: str) -> DataFrame:
    decision = F.when(F.col("n") == 0, "stop").when(F.col("acc") >= 0.9, "advance").when(F.col("acc") < 0.7, "rollback").otherwise("stay")
    return _buckets(spark, sf).select("bucket", decision.alias("decision"))


@register(
    "ctl_k_sigma",
    """WITH s AS (SELECT lang, round(avg(n_chars) - 2 * stddev_pop(n_chars), 6) AS low, round(avg(n_chars) + 2 * stddev_pop(n_chars), 6) AS high FROM documents GROUP BY lang)
    SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (n_chars BETWEEN low AND high)::BIGINT AS n_kept FROM documents JOIN s USING (lang) GROUP BY lang""",
)
def ctl_k_sigma(spark: SparkSession, sf: str) -> DataFrame:
    d = C.within_k_sigma(V.table(spark, sf, "documents").select("lang", "n_chars"), "n_chars", 2.0, ["lang"])
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"))
