"""Operators on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import controller, dynamics, gates, jobs, lineage, metrics, quotas, sampling
from millrace.storage import materialise


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_parse_letter(spark):
    values = ["A", " b. ", "(C)", "[D]。", "", "A or B", "AB", "E", "The answer is A.", "A\ntext", None]
    assert col(spark, values, T.parse_letter) == ["A", "B", "C", "D", None, None, None, None, None, None, None]


def test_normalisers(spark):
    assert col(spark, ["  Yes. ", "a\t b。.", "", " . "], T.normalise_v1) == ["yes", "a b", "", ""]
    assert col(spark, [" Two Words!\nx", "", "²_a"], T.normalise_v2) == ["twowords", "", "²_a"]


HISTORY = [
    ("a", 0, 2.0, True), ("a", 1, 1.0, False), ("a", 2, 0.5, True),
    ("b", 0, 4.0, False), ("b", 1, 3.0, True), ("b", 2, 2.0, True),
    ("t", 0, 5.0, None), ("t", 1, 6.0, None), ("t", 2, 4.0, None),
]


def history(spark, rows=HISTORY):
    return spark.createDataFrame(rows, "sample_id string, round long, loss double, correct boolean")


def test_event_counts(spark):
    got = {r.sample_id: (r.forgetting_count, r.learning_count, r.latest_transition) for r in dynamics.event_counts(history(spark)).collect()}
    assert got == {"a": (1, 1, "learned"), "b": (0, 1, "stable_correct"), "t": (None, None, "not_scored")}


def test_loss_change(spark):
    df = spark.createDataFrame([(1.0, 0.5), (0.0, 1.0), (None, 1.0)], "before double, now double")
    c = dynamics.loss_change(F.col("before"), F.col("now"), F.lit(20))
    rows = df.select(*[v.alias(k) for k, v in c.items()]).collect()
    assert [tuple(r) for r in rows] == [(-0.5, 0.5, 0.5, -0.025), (1.0, -1.0, None, 0.05), (None, None, None, None)]


@pytest.mark.parametrize(
    ("mutate", "check"),
    [
        (lambda r: r[:-1], "missing_round"),
        (lambda r: [*r, r[0]], "repeated_round"),
        (lambda r: [(*r[0][:3], "other"), *r[1:]], "changed_bucket"),
        (lambda r: [(x[0], x[1], 0, x[3]) for x in r], "step_not_rising"),
    ],
)
def test_alignment(spark, mutate, check):
    rows = [(s, k, 10 * k, "x") for s in "ab" for k in range(3)]
    schema = "sample_id string, round long, step long, bucket string"
    errors = lambda r: {x.check: x.n for x in dynamics.alignment_errors(spark.createDataFrame(r, schema), ["bucket"]).collect()}
    assert set(errors(rows).values()) == {0}
    assert errors(mutate(rows))[check] > 0


def test_largest_remainder_and_repeat(spark):
    df = spark.range(10).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "x").otherwise("y").alias("g"))
    w = df.groupBy("g").agg(F.count("*").alias("weight"))
    q = quotas.largest_remainder(w, "g", F.lit(17)).select("g", "quota")
    assert {r.g: r.quota for r in q.collect()} == {"x": 5, "y": 12}
    out = sampling.repeat_to(df, "doc_id", q, ["g"], 1, cap=4).groupBy("g", "doc_id").count().collect()
    for g, total in (("x", 5), ("y", 12)):
        n = [r["count"] for r in out if r.g == g]
        assert sum(n) == total and max(n) - min(n) <= 1
    with pytest.raises(Exception, match="cap"):
        sampling.repeat_to(df, "doc_id", q.withColumn("quota", F.lit(100)), ["g"], 1, cap=4).collect()


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    ranks = sorted(r["rank"] for r in sampling.hash_rank(df, "doc_id", 3).collect())
    assert ranks == list(range(1, 501))
    assert sampling.hash_rank(df.limit(0), "doc_id", 3).count() == 0


def test_fixed_order_and_batches(spark):
    w = spark.createDataFrame([("a", 1 / 3), ("b", 1 / 3), ("c", 1 / 3)], "k string, weight double")
    assert {r.k: r.quota for r in quotas.fixed_order(w, "k", 11, ["b", "a", "c"]).collect()} == {"a": 4, "b": 4, "c": 3}
    assert quotas.batch_plan([1, 2, 4, 8], 2, 32, 300) == [(1, 16, 9600), (2, 8, 9600), (4, 4, 9600), (8, 2, 9600)]
    with pytest.raises(ValueError):
        quotas.batch_plan([3], 2, 32, 300)


def test_weighted_loss(spark):
    df = spark.createDataFrame([(6.0, 3), (4.0, 1)], "sum_nll double, tokens long")
    assert df.agg(metrics.weighted_loss()).first()[0] == 2.5


def test_gates(spark):
    df = spark.createDataFrame([("a", "PASS"), ("a", "REVIEW"), ("b", "PASS"), ("c", None), ("d", "FAIL"), ("d", "PASS")], "g string, status string")
    assert {r.g: r.s for r in df.groupBy("g").agg(gates.worst().alias("s")).collect()} == {"a": "REVIEW", "b": "PASS", "c": "REVIEW", "d": "FAIL"}
    gates.require_empty(df.limit(0), "none")
    with pytest.raises(ValueError):
        gates.require_empty(df, "some")


def test_jobs(spark):
    events = [("j", 1, "PENDING"), ("j", 2, "RUNNING"), ("j", 3, "FAILED"), ("j", 4, "RUNNING"), ("j", 5, "SUCCEEDED"), ("j", 6, "RUNNING"), ("k", 1, "PENDING"), ("k", 2, "RUNNING")]
    df = spark.createDataFrame(events, "job_id string, seq long, status string")
    got = [(r.legal, r.attempt) for r in jobs.checked_transitions(df).where("job_id = 'j'").orderBy("seq").collect()]
    assert got == [(True, 0), (True, 0), (True, 0), (True, 1), (True, 1), (False, 1)]
    assert len(events) == 8


def test_lineage(spark):
    assert lineage.run_hash({"a": 1, "notes": "x", "created_at": "y"}) == lineage.run_hash({"notes": "z", "a": 1})
    assert lineage.run_hash({"a": 1}) != lineage.run_hash({"a": 2})
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "a")], "child string, parent string")
    got = {(r.id, r.ancestor, r.depth) for r in lineage.ancestors(edges, spark.createDataFrame([("c",)], "id string")).collect()}
    assert got == {("c", "b", 1), ("c", "a", 1)}


def test_controller(spark):
    df = spark.createDataFrame([("a", 0.5, True, 1.0), ("b", 0.3, False, 9.0), ("c", 0.2, False, 1.0)], "k string, share double, frozen boolean, m double")
    got = {r.k: r.new_share for r in controller.inner_mix(df, "share", "share", "m", "frozen").collect()}
    assert got["a"] == 0.5 and abs(sum(got.values()) - 1) < 1e-12 and got["b"] > 0.3


def test_materialise_keeps_schema_and_empty_tables(spark):
    df = spark.createDataFrame([], "a long, b string")
    assert materialise(df, "t").schema == df.schema
    assert materialise(df, "t").count() == 0


def test_causal_loss(spark):
    from math import log

    from millrace.operators.vectors import causal_loss

    flat = [[0.0] * 5] * 4
    df = spark.createDataFrame([(flat, [9, 1, 2, 3]), (flat, [-100, -100, -100, 4]), (flat[:1], [1])], "logits array<array<double>>, labels array<int>")
    df = df.withColumn("labels", F.transform("labels", lambda x: F.when(x == 9, 0).otherwise(x)))
    got = [r.x for r in df.select(causal_loss(F.col("logits"), F.col("labels")).alias("x")).collect()]
    assert [x.tokens for x in got] == [3, 1, 0]
    assert got[0].sum_nll == pytest.approx(3 * log(5)) and got[1].sum_nll == pytest.approx(log(5)) and got[2].sum_nll == 0


def test_artifact_registry(spark, tmp_path):
    from millrace.operators.stores import ArtifactRegistry

    r = ArtifactRegistry(spark, str(tmp_path / "artifacts"))
    assert r.register(artifact_id="a", artifact_type="pool", version="1", path="p") and not r.register(artifact_id="a", artifact_type="pool", version="1", path="p")
    with pytest.raises(ValueError):
        r.register(artifact_id="a", artifact_type="pool", version="2", path="p")
    r.register(artifact_id="b", artifact_type="pool", version="2", path="q", parent_artifact_ids=["a"])
    r.register(artifact_id="c", artifact_type="pool", version="3", path="q", complete=False)
    assert r.resolve("pool").artifact_id == "b" and r.resolve("none") is None and r.list_artifacts().count() == 3
    (tmp_path / "done").mkdir()
    (tmp_path / "done" / "_SUCCESS").touch()
    (tmp_path / "half").mkdir()
    for name, path, status in (("d", "done", "SUCCEEDED"), ("e", "half", "SUCCEEDED"), ("f", "none", "SUCCEEDED"), ("g", "done", "FAILED")):
        r.register(artifact_id=name, artifact_type="run", version="1", path=f"file://{tmp_path}/{path}", status=status)
    assert [r.is_complete(name) for name in "defg"] == [True, False, False, False]
    with pytest.raises(KeyError):
        r.is_complete("nobody")
    assert [x.ancestor for x in r.ancestors("b").collect()] == ["a"]


def test_state_store(spark, tmp_path):
    from millrace.operators.stores import StateStore

    s = StateStore(spark, str(tmp_path / "jobs"), "run")
    for job, steps in {"a": ["PENDING", "RUNNING", "FAILED", "RUNNING", "SUCCEEDED"], "b": ["PENDING", "RUNNING", "REVIEW"]}.items():
        for status in steps:
            s.transition(job, status)
    s.resume("b")
    s.transition("b", "REVIEW", "RUNNING")
    with pytest.raises(ValueError):
        s.resume("a")
    assert s.rows().count() == 10 and s.get("a") == "SUCCEEDED" and [r.job_id for r in s.resumable().collect()] == ["b"]
    for job, status, expected in (("a", "RUNNING", None), ("b", "RUNNING", "FAILED"), ("new", "RUNNING", None)):
        with pytest.raises(ValueError):
            s.transition(job, status, expected)


def test_config(tmp_path, monkeypatch):
    from millrace.operators.lineage import job_key, run_hash
    from millrace.sources.config import deep_merge, resolve_path, write_json, write_once

    monkeypatch.setenv("HERE", str(tmp_path))
    assert resolve_path("$HERE/x", "root") == tmp_path / "x"
    assert str(resolve_path("a$/b", "root")) == "a$/b"
    for bad in ("${NOT_SET_ANYWHERE}/x", "$NOT_SET_ANYWHERE", " "):
        with pytest.raises(ValueError):
            resolve_path(bad, "root")
    assert deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}, {"d": [1]}) == {"a": {"b": 3, "c": 2}, "d": [1]}
    write_json({"a": 1}, tmp_path / "r.json")
    with pytest.raises(FileExistsError):
        write_json({"a": 2}, tmp_path / "r.json")
    with pytest.raises(ValueError):
        write_json({"a": float("nan")}, tmp_path / "n.json")
    assert write_once({"steps": 1, "notes": "x"}, tmp_path / "m.json", run_hash) and not write_once({"steps": 1, "notes": "y"}, tmp_path / "m.json", run_hash)
    with pytest.raises(FileExistsError):
        write_once({"steps": 2}, tmp_path / "m.json", run_hash)
    assert len(job_key({"a": 1})) == 16


def test_jsonl_and_parquet_never_overwrite(spark, tmp_path):
    from millrace.sources import io

    df = spark.createDataFrame([(1, "x")], "a long, b string")
    io.write_jsonl(df, str(tmp_path / "j"))
    io.write_parquet(df, str(tmp_path / "p"))
    for again in (lambda: io.write_jsonl(df, str(tmp_path / "j")), lambda: io.write_parquet(df, str(tmp_path / "p"))):
        with pytest.raises(Exception, match="(?i)exist"):
            again()
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n   \n{"a": \n')
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a long").collect()
    assert [(r.line_number, r.error) for r in io.read_jsonl_tolerant(spark, str(tmp_path / "bad.jsonl"), "a long").orderBy("line_number").collect()] == [(1, None), (4, "invalid_json")]
    assert io.missing_columns(df, ["a", "z"]) == ["z"]


def test_image_formats(spark):
    heads = [bytes.fromhex("FFD8FFE0"), b"\x89PNG\r\n\x1a\n", b"RIFF\0\0\0\0WEBPVP8 ", b"GIF89a"]
    assert col(spark, heads, T.image_format, "binary") == ["JPEG", "PNG", "WEBP", None]


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["source", "bucket", "doc_id", "copy_no", "exposure"] and df.count() == 400
    counts = {(r.source): r["count"] for r in df.groupBy("source").count().collect()}
    assert counts == {"main": 320, "replay_vl": 60, "replay_text": 20}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    from millrace.sources import io

    lines = [f"line {k} " + "x" * (k % 50) if k % 7 else "" for k in range(1, 3001)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("only\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {(r.file.rsplit("/", 1)[1], r.line_number): r.value for r in io.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {("a.txt", k + 1): v for k, v in enumerate(lines)} | {("b.txt", 1): "only"}


def test_bad_registry_line_is_named(spark, tmp_path):
    from millrace.operators.stores import ArtifactRegistry

    r = ArtifactRegistry(spark, str(tmp_path / "artifacts"))
    (tmp_path / "artifacts" / "part-bad.json").write_text('{"artifact_id": "x"}\n{"artifact_id": \n')
    with pytest.raises(ValueError, match="part-bad.json: line 2"):
        r.latest()


def test_ancestors_of_any_depth_and_in_cycles(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, None)]
    edges = spark.createDataFrame(chain, "child long, parent long")
    got = {(r.id, r.ancestor): r.depth for r in lineage.ancestors(edges, spark.createDataFrame([(0,), (100,), (999,)], "id long")).collect()}
    assert got == {(0, k): k for k in range(1, 61)} | {(100, 101): 1, (100, 100): 2}


def test_suffix_rewrite_rejects_what_it_does_not_know(spark):
    from millrace.operators import dialogue

    def run(rows):
        df = spark.createDataFrame(rows, "text string, applies boolean, role string, name string")
        text, changed = dialogue.rewrite_suffix(F.col("text"), F.col("applies"), F.col("role"), F.col("name"))
        return [tuple(r) for r in df.select(text, changed).collect()]

    old, new = dialogue.OLD_SUFFIX, dialogue.NEW_SUFFIX
    assert run([("q " + old, True, "user", "a"), ("q " + new, True, "user", "b"), ("q", False, "robot", "c")]) == [("q " + new, True), ("q " + new, False), ("q", False)]
    for bad in ((("q", True, "user", "d")), ("q " + old, True, "assistant", "e")):
        with pytest.raises(Exception, match=f": {bad[3]}"):
            run([bad])


def test_metrics_wait_for_all_predictions(spark, tmp_path):
    from millrace.operators.stores import write_metrics

    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "id long")
    metrics = spark.createDataFrame([(0.5,)], "accuracy double")
    for wrong in ((1, 2), (1, 2, 3, 3), (1, 2, 3, 4)):
        with pytest.raises(ValueError):
            write_metrics(ids(1, 2, 3), ids(*wrong), "id", metrics, str(tmp_path / "m"))
    write_metrics(ids(1, 2, 3), ids(3, 1, 2), "id", metrics, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().accuracy == 0.5


def test_nothing_is_written_before_it_is_executed(spark, tmp_path):
    from millrace.sources import io
    from millrace.sources.config import write_snapshot

    df = spark.range(5)
    assert io.write_when_executed(df, str(tmp_path / "out")) == {"rows": 5, "columns": ["id"], "path": str(tmp_path / "out"), "executed": False}
    assert not (tmp_path / "out").exists()
    assert io.write_when_executed(df, str(tmp_path / "out"), execute=True)["executed"] and spark.read.parquet(str(tmp_path / "out")).count() == 5
    write_snapshot({"a": [1]}, tmp_path / "s.yaml")
    with pytest.raises(FileExistsError):
        write_snapshot({"a": [2]}, tmp_path / "s.yaml")


def test_contamination_by_join_equals_that_in_rows(spark):
    from millrace.operators.dedup import contamination

    items = spark.createDataFrame([(1, "the quick brown fox"), (2, "brown fox jumps over it"), (3, "")], "item long, text string")
    docs = spark.createDataFrame([(1, "See the QUICK, brown fox jumps over it!"), (2, "the quick brown"), (3, None), (4, "the quick brown fox the quick brown fox")], "doc long, text string")
    for few in (10, 0):
        assert {(r.doc, r.n_items) for r in contamination(docs, items, "doc", "item", few).collect()} == {(1, 2), (4, 1)}


def test_ngram_overlap_by_join_equals_that_in_rows(spark):
    from millrace.operators.dedup import ngram_overlap

    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "too short")], "item long, text string")
    docs = spark.createDataFrame([(1, "ONE two three, four five six!"), (2, "one two three four five"), (3, None), (4, "six seven one two three four five six seven")], "doc long, text string")
    for few in (100, 0):
        assert {(r.doc, r.item, r.share) for r in ngram_overlap(docs, items, "doc", "item", 5, 0.5, few).collect()} == {(1, 1, 0.666667), (4, 1, 1.0)}


def test_ngram_overlap_splits_each_text_once(spark):
    from millrace.operators.dedup import ngram_overlap

    items = spark.createDataFrame([(1, "one two three four five six seven")], "item long, text string")
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc long, text string")
    for few in (100, 0):
        plan = ngram_overlap(docs, items, "doc", "item", 5, 0.5, few)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1


def test_ngram_overlap_unites_rows_of_an_id(spark):
    from millrace.operators.dedup import ngram_overlap

    items = spark.createDataFrame([(1, "a b c d e f"), (1, "b c d e f g"), (1, "p q r s t u v w"), (None, "a b c d e")], "item long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f g"), (2, "P Q R S T"), (None, "p q r s t u v w")], "doc long, text string")
    for few in (100, 0):
        got = {(r.doc, r.item, r.share) for r in ngram_overlap(docs, items, "doc", "item", 5, 0.5, few).collect()}
        assert got == {(2, 1, 0.571429), (None, 1, 0.571429)}


def test_cosine_ignores_length(spark):
    from millrace.operators.vectors import top_k

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [10.0, 1.0]), (3, [0.0, 100.0]), (4, [0.0, 0.0])], "id long, v array<double>")
    got = [(r.cand_id, r.similarity) for r in top_k(v, v, 3).where("query_id = 1").orderBy("rank").collect()]
    assert got == [(2, 0.995037), (3, 0.0), (4, 0.0)]


def test_streams_without_files_and_restarts(spark, tmp_path):
    from millrace.streaming import events

    spark.createDataFrame([], "event_id long, ts timestamp").write.parquet(str(tmp_path / "none"))
    assert events.run_available(events.deduplicated(events.read_events(spark, str(tmp_path / "none")))).count() == 0
    out = str(tmp_path / "out")
    for number, rows in ((0, [(1,)]), (1, [(2,)]), (1, [(2,)])):  # the last batch ran twice
        spark.createDataFrame(rows, "id long").write.mode("overwrite").parquet(f"{out}/{events.BATCH}={number}")
    schema = spark.range(1).schema
    assert sorted(r.id for r in events.read_batches(spark, out, schema).collect()) == [1, 2]
    assert [r.id for r in events.read_batches(spark, out, schema, "complete").collect()] == [2]


def test_images_are_whole(spark):
    data = ["89504E470D0A1A0A0000000049454E44AE426082", "FFD8FFE0FFD9", "FFD8FFE0", "524946460400000057454250", "524946460500000057454250", "00", None]
    assert col(spark, [bytes.fromhex(x) if x else None for x in data], T.image_whole, "binary") == [True, True, False, True, False, False, False]


def test_job_state_carries_over_batches(spark, tmp_path):
    import os

    from millrace.streaming import events

    steps = ["PENDING", "RUNNING", "FAILED", "RUNNING", "SUCCEEDED", "PENDING"]
    seen: set = set()
    for k, status in enumerate(steps):
        spark.createDataFrame([(1, k, status), (2, k, "PENDING")], "job_id long, seq long, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in set((tmp_path / "in").glob("part-*")) - seen:  # the order of files is that of their times
            os.utime(f, (1_000_000 + 10 * k, 1_000_000 + 10 * k))
            seen.add(f)
    got = events.run_available(events.checked_transitions(events.read_events(spark, str(tmp_path / "in"), files_per_batch=1)))
    one = [(r.old_status, r.legal, r.attempt) for r in got.where("job_id = 1").orderBy("seq").collect()]
    assert one == [(None, True, 0), ("PENDING", True, 0), ("RUNNING", True, 0), ("FAILED", True, 1), ("RUNNING", True, 1), ("SUCCEEDED", False, 1)]
    assert [r.legal for r in got.where("job_id = 2").orderBy("seq").collect()] == [True] + [False] * 5
