"""The queries opN_<name> over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.pieces import encode_texts

    coded = encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.licenses import BASE, TEMPLATES, find_licenses, labels_of

    found = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.transform(F.filter("hits", lambda h: h["template"] < len(BASE)), lambda h: h["start"])
    return found.withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base").alias("first_word"),
        F.array_max("base").alias("last_word"),
        labels_of("hits", len(BASE)).alias("base_labels"),
        labels_of("hits", len(TEMPLATES)).alias("labels"),
        "score",
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality import feature_table, fit_features, held_out, score_features
    from millrace.storage import materialise

    features = materialise(feature_table(table(spark, sf_dir, "documents")), "features")
    scored = score_features(features, fit_features(features, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.neardup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.chat import canonical_turns, loss_text, parse, render

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = render(canonical_turns(rows.unionByName(more)))
    read = chats.select("conv_id", "formatted", parse(F.col("formatted")).alias("read"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    flat = F.concat_ws("", F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.pii import KINDS, all_spans, joined_spans

    found = all_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = KINDS[:4]
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in base]
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(joined_spans("spans", base), 256).alias("base_sha256"), joined_spans("spans").alias("spans"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.ann import nearest

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, factor=1.0)


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.warc import round_trip

    read = round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def chat_mixed_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as JSON records of three layouts, with fields that no mapping names, read by their fingerprints."""
    from millrace.llm.chat import canonical_records, canonical_turns

    said = canonical_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    first, second = (F.get("turns", F.lit(k)) for k in (0, 1))
    two = (F.size("turns") == 2) & (first["role"] == "user") & (second["role"] == "assistant")
    messages = F.to_json(F.struct(F.col("conv_id").alias("id"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"), t["turn"].alias("weight"))).alias("messages")))
    values = F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("from"), t["text"].alias("value"), F.lit("x").alias("name"))).alias("conversations")))
    plain = F.to_json(F.struct(first["text"].alias("prompt"), second["text"].alias("completion"), F.struct(F.lit(1).alias("prompt")).alias("meta")))
    kind = F.pmod("conv_id", F.lit(3))
    records = said.select("conv_id", F.when(kind == 1, values).when((kind == 2) & two, plain).otherwise(messages).alias("record"))
    flat = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return canonical_records(records).select("conv_id", "layout", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"))


def queries() -> dict[str, Query]:
    own = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return own | {"chat_mixed_layouts": chat_mixed_layouts}


def oracle_sql() -> dict[str, str]:
    from millrace.llm import sql

    return {name[4:]: text for name, text in vars(sql).items() if name.startswith("SQL_")}
