"""Hash-chained audit logs, chain verification and action policy checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimloom.operators.ordered import ordered_prefix

# Each record of a chain hashes the hash before it, whatever the chain's length. A caller may ask for
# segments of `segment_rows` records, which bound how long one sequence can get: within a segment each
# record hashes the hash before it, and the first record of a later segment hashes the seal of all
# segments before. Either rule is the same for batches, streams and verification.

# Actions an agent may run by itself.
ALLOWED_ACTIONS = [
    "analyze_claim",
    "get_claim",
    "get_claim_history",
    "get_denial",
    "retrieve_history",
    "predict_denial",
    "predict_denial_reason",
    "generate_explanation",
    "get_shap_explanation",
    "calculate_anomaly",
    "recommend_action",
    "retrieve_policy",
    "search_documents",
    "get_payer_policy",
    "calculate_recovery",
    "validate_claim",
    "predict_appeal_success",
    "draft_appeal",
    "create_appeal_draft",
    "create_workflow_action",
]
# Actions that always need a human decision.
BLOCKED_ACTIONS = [
    "modify_claim",
    "submit_claim",
    "submit_appeal",
    "delete_claim",
    "approve_financial_action",
    "approve_workflow_action",
    "reject_workflow_action",
    "execute_workflow_action",
]


def _json_text(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


RECORD_END = '"}'


def record_start() -> Column:
    """Canonical JSON of a record up to the value of its last key, `prev_hash`.

    Keys are in order; `payload` is stored canonical JSON text.
    """
    return F.concat(
        F.lit('{"actor_type": '),
        _json_text(F.col("actor_type")),
        F.lit(', "event_type": '),
        _json_text(F.col("event_type")),
        F.lit(', "payload": '),
        F.coalesce("payload", F.lit("{}")),
        F.lit(', "prev_hash": "'),
    )


def record_hash(prev_hash: Column) -> Column:
    return F.sha2(F.concat(record_start(), prev_hash, F.lit(RECORD_END)), 256)


def content_digest() -> Column:
    """Digest of every stored field of a record, without the chain."""
    fields = ["event_id", "entity_id", "actor_type", "event_type", "payload"]
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    return F.sha2(F.concat_ws("|", *parts, F.unix_micros("created_at").cast("string")), 256)


def numbered(events: DataFrame, entity: str, segment_rows: int) -> DataFrame:
    """Add `seq` (1-based per entity by time and event id) and `segment`."""
    placed = ordered_prefix(events, ["created_at", "event_id"], (), [entity])
    return placed.withColumnRenamed("pos", "seq").withColumn("segment", segment_of(F.col("seq"), segment_rows))


def rolled(before: str, digest: str) -> str:
    """Digest of a segment's contents up to a record, and likewise the seal of segments up to one."""
    return hashlib.sha256((before + digest).encode()).hexdigest()


def segment_of(seq: Column, segment_rows: int) -> Column:
    return F.floor((seq - 1) / segment_rows)


def segment_anchors(rows: DataFrame, entity: str = "entity_id") -> DataFrame:
    """`anchor` per (entity, segment): empty for the first segment, else the seal of those before.

    A segment's digest rolls over the content digests of its records, which are at most
    `segment_rows`, so the collected array is bounded. Seals roll over the segment digests: one
    pass over one row a segment, in order, which holds a single seal per task.
    """
    digests = F.transform(F.array_sort(F.collect_list(F.struct("seq", "digest"))), lambda s: s["digest"])
    roll = F.aggregate(digests, F.lit(""), lambda done, d: F.sha2(F.concat(done, d), 256))
    segments = rows.withColumn("digest", content_digest()).groupBy(entity, "segment").agg(roll.alias("rolled"))
    kind = dict(rows.dtypes)[entity]

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), ""
        for batch in batches:
            anchors = []
            for key, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                now, last = key, last if key == now else ""
                anchors.append(last)
                last = rolled(last, digest)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(anchors, pa.string())], names=[entity, "segment", "anchor"])

    ordered = segments.repartition(entity).sortWithinPartitions(entity, "segment")
    return ordered.mapInArrow(seal, f"{entity} {kind}, segment bigint, anchor string")


def build_chain(events: DataFrame, entity: str = "entity_id", segment_rows: int | None = None) -> DataFrame:
    """Chain the records of each entity: adds seq, prev_hash and hash, and `segment` if segments are asked for.

    Without segments an entity's records are one sequence, so one task's work; other entities are other tasks'.
    Segments are independent tasks' work of bounded size.
    """
    if segment_rows is None:
        return _sequence(events, entity)
    rows = numbered(events, entity, segment_rows)
    records = rows.select(entity, "segment", "seq", record_start().alias("record"))
    return rows.join(_fold(records.join(segment_anchors(rows, entity), [entity, "segment"]), entity), [entity, "segment", "seq"])


def _sequence(events: DataFrame, entity: str) -> DataFrame:
    """Number and hash the records of each entity in order: one shuffle and one pass, which holds one hash per task.

    Records without an entity belong to no chain. A record that lacks its actor's or its own type has no hash, and none after it has.
    """
    at = events.columns.index(entity)
    added = "seq bigint, prev_hash string, hash string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, last = object(), 0, ""
        for batch in batches:
            numbers, before, hashes = [], [], []
            for key, start in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if key != now:
                    now, seq, last = key, 0, ""
                seq += 1
                numbers.append(seq)
                before.append(last)
                last = None if start is None or last is None else hashlib.sha256((start + last + RECORD_END).encode()).hexdigest()
                hashes.append(last)
            made = [pa.array(numbers, pa.int64()), pa.array(before, pa.string()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "seq", "prev_hash", "hash"])

    rows = events.where(F.col(entity).isNotNull()).select("*", record_start().alias("_record"))
    # dealt by a hash: a repartition by the columns of a join before it would be dropped, and that join's tasks may share an entity
    ordered = rows.repartition(F.xxhash64(entity)).sortWithinPartitions(entity, "created_at", "event_id")
    return ordered.mapInArrow(run, StructType([*events.schema.fields, *StructType.fromDDL(added).fields]))


def _fold(records: DataFrame, entity: str) -> DataFrame:
    """Hash the records of each segment in order: one pass over rows, a record each, which holds one hash per task."""
    kind = dict(records.dtypes)[entity]
    names = [entity, "segment", "seq", "prev_hash", "hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), ""
        for batch in batches:
            before, hashes = [], []
            for key, segment, start, anchor in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4))):
                if (key, segment) != now:
                    now, last = (key, segment), anchor
                before.append(last)
                last = hashlib.sha256((start + last + RECORD_END).encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(before, pa.string()), pa.array(hashes, pa.string())], names=names)

    # dealt by a hash: a repartition by the columns of the join before it would be dropped, and that join's tasks may share a segment
    dealt = records.select(entity, "segment", "seq", "record", "anchor").repartition(F.xxhash64(entity, "segment"))
    ordered = dealt.sortWithinPartitions(entity, "segment", "seq")
    return ordered.mapInArrow(run, f"{entity} {kind}, segment bigint, seq bigint, prev_hash string, hash string")


def verify_chain(log: DataFrame, entity: str = "entity_id", segment_rows: int | None = None) -> DataFrame:
    """First bad record per entity (no row when the chain holds).

    `log` has the records with seq, prev_hash and hash, from a batch or a stream, and was built with
    the same `segment_rows`; without a column `segment` the segments follow from seq. Every record is
    checked against its predecessor's stored hash. All records before the first failure match, so this
    finds the same record as a walk from the start, but in parallel: the predecessor is found by a join
    on (entity, seq), not by a window over the entity.
    """
    if "segment" not in log.columns and segment_rows is not None:
        log = log.withColumn("segment", segment_of(F.col("seq"), segment_rows))
    before = log.select(entity, (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"))
    linked = log.join(before, [entity, "seq"], "left")
    expected_prev = F.coalesce("_before", F.lit(""))
    if "segment" in log.columns:
        starts = log.groupBy(entity, "segment").agg(F.min("seq").alias("_first"))
        linked = linked.join(segment_anchors(log, entity).join(starts, [entity, "segment"]), [entity, "segment"], "left")
        expected_prev = F.when(F.col("seq") == F.col("_first"), F.col("anchor")).otherwise(expected_prev)
    bad = ~F.col("prev_hash").eqNullSafe(expected_prev) | ~F.col("hash").eqNullSafe(record_hash(expected_prev))
    return (
        linked.withColumn("_bad", bad)
        .filter("_bad")
        .groupBy(entity)
        .agg(F.min_by(F.struct("seq", "event_id"), "seq").alias("f"))
        .select(entity, F.col("f.seq").alias("first_bad_seq"), F.col("f.event_id").alias("first_bad_event"))
    )


def chain_status(log: DataFrame, entity: str = "entity_id", segment_rows: int | None = None) -> DataFrame:
    """Per entity: number of records and whether the chain is intact."""
    counts = log.groupBy(entity).agg(F.count(F.lit(1)).alias("records"))
    return counts.join(verify_chain(log, entity, segment_rows), entity, "left").select(
        entity, "records", F.col("first_bad_seq").isNull().alias("valid"), "first_bad_seq", "first_bad_event"
    )


def policy_violations(actions: DataFrame, column: str = "action") -> DataFrame:
    """Actions that are not allow-listed: blocked ones and unknown ones alike."""
    verdict = F.when(F.col(column).isin(BLOCKED_ACTIONS), "blocked").otherwise("unknown")
    outside = ~F.coalesce(F.col(column).isin(ALLOWED_ACTIONS), F.lit(False))
    return actions.filter(outside).withColumn("violation", verdict)


def policy_summary(actions: DataFrame, column: str = "action") -> DataFrame:
    allowed = F.coalesce(F.col(column).isin(ALLOWED_ACTIONS), F.lit(False))
    total = F.count(F.lit(1))
    bad = F.count_if(~allowed)
    return actions.agg(
        total.alias("actions"),
        bad.alias("violations"),
        (F.when(total > 0, bad / total).otherwise(0.0)).alias("violation_rate"),
    )


def apply_decisions(
    actions: DataFrame, decisions: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(updated actions, rejected decisions, review rows).

    Only actions in PENDING_APPROVAL change, to APPROVED or REJECTED. The earliest
    decision on an action counts; decisions on missing or closed actions are rejected.
    """
    first = decisions.groupBy("action_id").agg(
        F.min(F.struct("decided_at", "decision_id", "decision", "reviewer_id", "notes")).alias("d")
    )
    joined = actions.join(first, "action_id", "left")
    valid = (F.col("status") == "PENDING_APPROVAL") & F.col("d.decision").isin("APPROVED", "REJECTED")
    applies = F.coalesce(valid, F.lit(False))
    updated = joined.withColumn("status", F.when(applies, F.col("d.decision")).otherwise(F.col("status"))).drop("d")
    reviews = joined.filter(applies).select("action_id", "d.*")
    rejected = decisions.join(reviews.select("action_id", "decision_id"), ["action_id", "decision_id"], "left_anti")
    return updated, rejected, reviews
