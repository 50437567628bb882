"""Streaming jobs run to the end of their input and read back from their sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.drift import feature_profiles, histogram, numeric_prefix
from claimloom.operators.features import claim_line_features
from claimloom.plans.registry import query
from claimloom.sources.fixtures import CLAIM_COLUMNS, Tables
from claimloom.storage import new_path
from claimloom.streaming import jobs


def source(t: Tables, name: str) -> DataFrame:
    schema = t.scan(name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def drained(t: Tables, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all available input into a Parquet sink and return it as a table."""
    path, checkpoint = new_path(t.spark, name), new_path(t.spark, f"{name}-checkpoint")
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


def with_rocksdb(t: Tables) -> None:
    for key, value in jobs.ROCKSDB_CONF.items():
        t.spark.conf.set(key, value)


def event_stream(t: Tables) -> DataFrame:
    return source(t, "events").selectExpr(
        "event_id", "cast(ts AS timestamp) AS created_at", "user_id AS entity_id", "'user' AS actor_type", "event_type",
        "props AS payload", "value",
    )


@query
def stream_claim_dedupe(t: Tables) -> DataFrame:
    messages = source(t, "lineitem").select(
        F.concat(F.lit("CLM-"), F.col("l_orderkey").cast("string")).alias("claim_number"),
        F.col("l_shipdate").cast("timestamp").alias("sent_at"),
    )
    # lines of an order are shipped within four months of it
    unique = jobs.stream_claim_dedupe(messages, "claim_number", "sent_at", "180 days")
    return drained(t, unique.select("claim_number"), "dedupe")


@query
def stream_validation(t: Tables) -> DataFrame:
    stored = t.base
    claims = t.spark.readStream.schema(stored.schema).parquet(stored.inputFiles()[0].rsplit("/", 1)[0]).select(*CLAIM_COLUMNS)
    checked = jobs.stream_validation(claims, claim_line_features(t.lines).select("claim_id", "lines_coded"))
    flat = checked.select(
        "claim_id",
        F.col("validation.readiness_score").cast("bigint").alias("readiness_score"),
        F.col("reason.predicted_reason").alias("predicted_reason"),
        F.col("reason.confidence").alias("confidence"),
    )
    return drained(t, flat, "validation")


@query
def stream_audit_chain(t: Tables) -> DataFrame:
    with_rocksdb(t)
    return drained(t, jobs.stream_audit_chain(event_stream(t)), "audit-chain")


@query
def velocity_flags(t: Tables) -> DataFrame:
    """At most 2 accepted events of a user in any 24 hours."""
    with_rocksdb(t)
    flags = jobs.stream_velocity(event_stream(t), "entity_id", "created_at", window_seconds=86_400, limit=2)
    return drained(t, flags, "velocity")


@query
def stream_daily_drift(t: Tables) -> DataFrame:
    """Daily PSI of event values against the distribution of all events; days still open at the end are reported as well."""
    reference = t.raw("events").select("value", F.lit(True).alias("is_ref"))
    prefix = numeric_prefix(reference, ["value"])
    profiles = feature_profiles(prefix)
    bounds = profiles["value"].edges
    found = {r["bin"]: r["ref_count"] for r in histogram(prefix, profiles).collect()}
    path, checkpoint = new_path(t.spark, "daily"), new_path(t.spark, "daily-checkpoint")
    stream = jobs.stream_daily_counts(event_stream(t), "created_at", "value", list(bounds))
    writer = stream.writeStream.outputMode("update").foreachBatch(jobs.latest_counts(path))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    counts = jobs.read_counts(t.spark, path, "day timestamp, bin int, n bigint")
    daily = jobs.daily_psi(counts, [found.get(i, 0) for i in range(1, len(bounds))])
    return daily.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
