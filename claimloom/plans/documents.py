"""Queries over documents, vectors, audit events, ingest and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import rules
from claimloom.functions.numbers import half_up
from claimloom.functions.text import chunk_documents, sparse_weights
from claimloom.operators import audit, ingest, registry, retrieval
from claimloom.operators.recovery import open_denials
from claimloom.plans.registry import query
from claimloom.sources.fixtures import Tables
from claimloom.storage import materialize


def stored_chunks(t: Tables) -> DataFrame:
    """Chunks with their token slots, staged once like a stored chunk table."""
    return t._staged("chunks", lambda: retrieval.with_slots(chunk_documents(t.documents)))


@query
def chunk_corpus(t: Tables) -> DataFrame:
    return chunk_documents(t.documents).select(
        "document_id",
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.length("chunk_text").cast("bigint").alias("n_chars"),
        F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"),
    )


@query
def document_ingest(t: Tables) -> DataFrame:
    """Chunks of documents that are not stored yet; labelled documents count as stored."""
    stored = t.documents.join(t.raw("labels").select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    fresh = retrieval.ingest_documents(t.documents, stored)
    return fresh.groupBy("document_id", "title").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.size("slots")).alias("tokens")
    )


@query
def token_embedding_sparse(t: Tables) -> DataFrame:
    weights = sparse_weights(stored_chunks(t), ["document_id", "chunk_index"], "chunk_text")
    return weights.select(
        "document_id",
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("idx").cast("bigint").alias("idx"),
        "count",
        half_up(F.col("weight"), 8).alias("weight"),
    )


def benchmark_queries(t: Tables) -> DataFrame:
    return t.raw("benchmark").select(
        F.col("item_id").alias("query_id"), "text", (F.col("item_id") % 25).alias("payer_id")
    )


@query
def topk_retrieval(t: Tables) -> DataFrame:
    found = retrieval.retrieve(stored_chunks(t), benchmark_queries(t), k=5)
    return found.select(
        "query_id",
        "document_id",
        "chunk_index",
        F.col("rank").cast("bigint").alias("rank"),
        half_up(F.col("score"), 4).alias("similarity_score"),
    )


@query
def vector_topk(t: Tables) -> DataFrame:
    vectors = t.raw("embeddings")
    centroids = retrieval.group_centroids(vectors, "label", "embedding")
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.vector_topk(rows, centroids, k=5).select(
        F.col("query_id").cast("bigint").alias("label"),
        "id",
        F.col("rank").cast("bigint").alias("rank"),
        half_up(F.col("score"), 4).alias("similarity"),
    )


def _recall_ranks(t: Tables) -> DataFrame:
    expected = retrieval.first_document_with(t.documents, benchmark_queries(t), "text")
    found = retrieval.retrieve(stored_chunks(t), benchmark_queries(t).select("query_id", "text"), k=5, scoped=False)
    return retrieval.hit_ranks(found, expected)


@query
def retrieval_recall(t: Tables) -> DataFrame:
    return _recall_ranks(t)


@query
def retrieval_recall_summary(t: Tables) -> DataFrame:
    return retrieval.recall_at_k(_recall_ranks(t))


def _open(t: Tables) -> DataFrame:
    return t.claims.filter(F.col("status") == "DENIED").join(t.denials, "claim_id")


def _policy_results(t: Tables) -> DataFrame:
    return retrieval.retrieve(stored_chunks(t), retrieval.policy_queries(_open(t)), k=5)


def _packets(t: Tables) -> DataFrame:
    bundles = retrieval.policy_bundles(_policy_results(t), stored_chunks(t))
    return retrieval.appeal_packets(_open(t), t.lines, bundles)


@query
def evidence_gate(t: Tables) -> DataFrame:
    """Gate over every claim, denied or not, with no policy retrieved."""
    has_lines = t.lines.select("claim_id", F.lit(True).alias("has_lines")).distinct()
    rows = t.claims.join(t.denials.select("claim_id", "denial_reason_code"), "claim_id", "left").join(
        has_lines, "claim_id", "left"
    )
    gate = rules.evidence(F.col("denial_reason_code").isNotNull(), F.col("has_lines"), F.lit(0))
    return rows.select("claim_id", gate.alias("e")).select(
        "claim_id",
        F.col("e.readiness_percent").cast("bigint").alias("readiness_percent"),
        F.array_join("e.missing_evidence", ",").alias("missing_evidence"),
        F.col("e.generation_allowed").alias("generation_allowed"),
    )


@query
def appeal_packets(t: Tables) -> DataFrame:
    return _packets(t).select(
        "claim_id",
        "blocked",
        F.col("evidence.readiness_percent").cast("bigint").alias("readiness_percent"),
        F.array_join("evidence.missing_evidence", ",").alias("missing_evidence"),
        F.coalesce(F.size("citations"), F.lit(0)).cast("bigint").alias("citations"),
        F.length("draft_text").cast("bigint").alias("draft_chars"),
        F.md5(F.col("draft_text").cast("binary")).alias("draft_md5"),
        "status",
    )


def _tampered_citations(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Citations of all packets, some with an invented excerpt and some with a chunk that does not exist."""
    results = materialize(_policy_results(t), "policy_results")
    bundles = retrieval.policy_bundles(results, stored_chunks(t))
    cited = retrieval.explode_citations(retrieval.appeal_packets(_open(t), t.lines, bundles))
    invented = F.when(F.col("claim_id") % 10 == 0, "An invented sentence.").otherwise(F.col("excerpt"))
    moved = F.when(F.col("claim_id") % 15 == 0, F.col("chunk_index") + 1_000_000).otherwise(F.col("chunk_index"))
    return cited.withColumn("excerpt", invented).withColumn("chunk_index", moved.cast("bigint")), results


@query
def citation_check(t: Tables) -> DataFrame:
    cited, results = _tampered_citations(t)
    return retrieval.check_citations(cited, stored_chunks(t), results).select(
        "claim_id", "document_id", "chunk_index", "chunk_exists", "faithful", "was_retrieved"
    )


@query
def citation_summary(t: Tables) -> DataFrame:
    cited, results = _tampered_citations(t)
    return retrieval.citation_summary(retrieval.check_citations(cited, stored_chunks(t), results))


# Audit ----------------------------------------------------------------------


@query
def audit_chain_build(t: Tables) -> DataFrame:
    return audit.build_chain(t.audit_events).select("event_id", "entity_id", "seq", "prev_hash", "hash")


@query
def audit_chain_segments(t: Tables) -> DataFrame:
    """The same log with short segments, so that seals link them."""
    return audit.build_chain(t.audit_events, segment_rows=25).select(
        "event_id", "entity_id", "segment", "seq", "prev_hash", "hash"
    )


@query
def audit_chain_verify(t: Tables) -> DataFrame:
    """Verification of a stored log after some payloads were edited."""
    log = t._staged("audit_log", lambda: audit.build_chain(t.audit_events))
    edited = log.withColumn(
        "payload", F.when(F.col("event_id") % 997 == 5, '{"k": -1}').otherwise(F.col("payload"))
    )
    return audit.chain_status(edited)


# The action each event type stands for in the compliance queries.
EVENT_ACTIONS = {
    "view": "get_claim",
    "click": "recommend_action",
    "signup": "create_appeal_draft",
    "error": "submit_appeal",
    "purchase": "purchase",
}


def _actions(t: Tables) -> DataFrame:
    pairs = [F.lit(x) for pair in EVENT_ACTIONS.items() for x in pair]
    return t.raw("events").select("event_id", "user_id", F.element_at(F.create_map(*pairs), F.col("event_type")).alias("action"))


@query
def policy_compliance(t: Tables) -> DataFrame:
    return audit.policy_violations(_actions(t))


@query
def policy_compliance_summary(t: Tables) -> DataFrame:
    return audit.policy_summary(_actions(t)).withColumn("violation_rate", half_up(F.col("violation_rate"), 6))


@query
def workflow_decisions(t: Tables) -> DataFrame:
    """Decisions applied to workflow actions, one action per open denial."""
    actions = open_denials(t.claims, t.denials).select(
        F.col("claim_id").alias("action_id"),
        F.col("recommended_action").alias("action_type"),
        F.when(F.col("claim_id") % 10 == 0, "EXECUTED").otherwise("PENDING_APPROVAL").alias("status"),
    )
    decision = F.when(F.col("event_type") == "view", "APPROVED").when(F.col("event_type") == "click", "REJECTED")
    decisions = t.raw("events").select(
        (F.floor(F.col("event_id") / 2) * 3).alias("action_id"),
        F.col("event_id").alias("decision_id"),
        F.coalesce(decision, F.lit("HOLD")).alias("decision"),
        F.col("user_id").alias("reviewer_id"),
        F.col("props").alias("notes"),
        F.col("ts").cast("timestamp").alias("decided_at"),
    )
    updated, _, reviews = audit.apply_decisions(actions, decisions)
    return updated.join(reviews.select("action_id", "decision_id", "reviewer_id"), "action_id", "left")


@query
def audit_listing(t: Tables) -> DataFrame:
    """Newest 100 events of one entity."""
    own = t.audit_events.filter(F.col("entity_id") == 8)
    return own.orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(100).select("event_id", "event_type", "payload")


# Ingest and registry ----------------------------------------------------------


def claim_messages(t: Tables) -> DataFrame:
    """One incoming message per line item; an order's items share a claim number."""
    key = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax"]
    line = F.struct(
        F.col("l_partkey").cast("string").alias("procedure_code"),
        F.col("l_suppkey").cast("string").alias("diagnosis_code"),
        F.col("l_returnflag").alias("modifiers"),
        F.col("l_extendedprice").alias("line_amount"),
        F.col("l_quantity").cast("int").alias("units"),
    )
    return t.raw("lineitem").select(
        F.concat(F.lit("CLM-"), F.col("l_orderkey").cast("string")).alias("claim_number"),
        F.col("l_extendedprice").alias("claim_amount"),
        F.lit(None).cast("string").alias("claim_type"),
        F.array(line).alias("lines"),
        F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in key]), 256).alias("message_id"),
        F.col("l_linenumber").alias("arrival"),
    )


@query
def claim_ingest_dedupe(t: Tables) -> DataFrame:
    """Claim numbers accepted from the messages; claims that are denied already count as stored."""
    stored = t.claims.filter(F.col("status") == "DENIED")
    claims, lines, _ = ingest.ingest_claims(claim_messages(t), stored, ["arrival", "message_id"], copies=True)
    counted = lines.groupBy("claim_number").agg(F.count(F.lit(1)).alias("lines"))
    return claims.join(counted, "claim_number").select(
        "claim_number", "claim_amount", "claim_type", "message_id", "lines", "is_synthetic", "data_source"
    )


@query
def claim_ingest_rejects(t: Tables) -> DataFrame:
    stored = t.claims.filter(F.col("status") == "DENIED")
    _, _, rejected = ingest.ingest_claims(claim_messages(t), stored, ["arrival", "message_id"], copies=True)
    return rejected.groupBy("claim_number", "reason").agg(F.count(F.lit(1)).alias("messages"))


def model_versions(t: Tables) -> DataFrame:
    """A registry log taken from the events; some versions have no numeric metric."""
    value = F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return t.raw("events").select(
        F.col("event_id").cast("string").alias("version_id"),
        F.col("event_type").alias("model_type"),
        F.concat(F.lit("model-"), (F.col("user_id") % 4).cast("string")).alias("model_name"),
        value.alias("pr_auc"),
        F.create_map(F.lit("pr_auc"), value).alias("metrics"),
        F.col("ts").cast("timestamp").alias("trained_at"),
    )


@query
def model_registry_champion(t: Tables) -> DataFrame:
    """Promotion gate replayed over the registry log."""
    return registry.gate_history(model_versions(t))
