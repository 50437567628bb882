"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import bpe, conversations, decontamination, jaccard_join, mixing, paragraphs, quality, secrets, source_audit, suffixes, toxicity, url_filters, warc
from claimloom.session import small_batches

URL_RULES = (
    url_filters.Rule("net", "/", "block"),
    url_filters.Rule("example.net", "/en/", "allow"),
    url_filters.Rule("example.com", "/de/", "block"),
    url_filters.Rule("org", "/fr/", "allow"),
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_distribution_divergence(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(_table(spark, folder, "documents").select("doc_id", "lang", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    made = bpe.checked(_table(spark, folder, "documents").select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN)
    return made.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "decoded_sha256",
    )


def op3_randomness_tests(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(_table(spark, folder, "documents").select("doc_id", "text"))
    counts = {f"n_{kind}": F.size(F.filter("base", lambda s: s["rank"] == secrets.KINDS.index(kind))).cast("bigint") for kind in secrets.KINDS[:3]}
    return found.withColumns(counts).select("doc_id", *counts, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op4_paragraph_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = paragraphs.repeated(_table(spark, folder, "documents"))
    return found.select("doc_id", "place", "begin", "end", "words", "component_id", "first_place", "removed")


def op5_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    cut = suffixes.dedup(_table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join(_table(spark, folder, "documents"))


def op7_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.round_trip(_table(spark, folder, "pages")).where("kind = 'record'")
    return records.select(
        F.col("record_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to")
    )


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(docs, _table(spark, folder, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.scan(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "scan.n_words",
        "scan.n_hit",
        F.size("scan.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("scan.items"), ","), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def op10_url_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judge(_table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_splitting_tree(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.mix(_table(spark, folder, "documents"))
    return mixing.taken(mix).select("doc_id", "size", "source_size", "target", "taken")


def op12_branch_and_bound(spark: SparkSession, folder: str) -> DataFrame:
    table = _table(spark, folder, "conversations")
    rows = conversations.damage(table)
    facts, chosen = conversations.repair(rows)
    same = lambda other: F.col("conv_id").eqNullSafe(other["conv"])
    digest = conversations.digests(rows, chosen)
    out = table.select("conv_id").distinct().join(facts, same(facts), "left").drop("conv").join(digest, same(digest), "left")
    zero = F.lit(0).cast("bigint")
    numbers = [F.coalesce(c, zero).alias(c) for c in ("gaps", *conversations.FAULTS, "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_iceberg_refinement(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.audit(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_distribution_divergence, op2_byte_bpe, op3_randomness_tests, op4_paragraph_minhash, op5_suffix_array, op6_jaccard_join, op7_warc_salvage, op8_toxicity, op9_decontamination, op10_url_equivalence, op11_splitting_tree, op12_branch_and_bound, op13_iceberg_refinement)}
