"""Claim ingest: defaults, provenance, duplicate rejection, parent/child split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.sources.schemas import CLAIM_DEFAULTS

# Provenance of ingested claims.
DATA_SOURCE = "api_manual_entry"


def with_defaults(messages: DataFrame) -> DataFrame:
    for name, value in CLAIM_DEFAULTS.items():
        if name in messages.columns:
            messages = messages.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return messages


def _first_messages(messages: DataFrame, arrival: list[str]) -> DataFrame:
    """The first message of each claim_number; of its copies the least value of each column that is not null.

    One aggregate, so only the first message of a number in each task is shuffled.
    """
    values = [c for c in messages.columns if c not in ("claim_number", *arrival)]
    least = [F.min(F.struct(*arrival, F.col(c).isNull().alias("_none"), F.col(c).alias("_value"))).alias(c) for c in values]
    first = messages.filter(F.col("claim_number").isNotNull()).groupBy("claim_number").agg(F.min(F.struct(*arrival)).alias("_first"), *least)
    return first.select("claim_number", "_first.*", *[F.col(f"{c}._value").alias(c) for c in values])


def ingest_claims(
    messages: DataFrame, existing: DataFrame, arrival: list[str], copies: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted claims, their lines, rejected messages with a reason).

    Of several messages with one claim_number the first by `arrival` counts. Choosing it is
    an aggregate, so a number sent very often is combined before the shuffle. With `copies`,
    messages that repeat claim_number and arrival are one message sent several times, with the
    least value of each column.
    """
    order = F.struct(*arrival)
    first = messages.groupBy("claim_number").agg(F.min(order).alias("_first"))
    known = existing.select("claim_number").distinct().withColumn("_known", F.lit(True))
    verdicts = first.join(known, "claim_number", "left")
    is_first = order == F.col("_first")
    fresh = F.col("_known").isNull()
    if copies:
        accepted = _first_messages(messages, arrival).join(known, "claim_number", "left").filter(fresh).drop("_known")
        marked = messages.select("claim_number", *arrival).distinct().join(verdicts, "claim_number")
    else:
        marked = messages.join(verdicts, "claim_number")
        accepted = marked.filter(is_first & fresh).drop("_first", "_known")
    accepted = with_defaults(accepted)
    accepted = accepted.withColumn("is_synthetic", F.lit(False)).withColumn("data_source", F.lit(DATA_SOURCE))
    claims = accepted.drop("lines")
    lines = accepted.select("claim_number", F.posexplode("lines").alias("line_index", "_l")).select(
        "claim_number", "line_index", "_l.*"
    )
    reason = F.when(~fresh, "claim_number already exists").otherwise("duplicate in batch")
    rejected = marked.filter(~(is_first & fresh)).select("claim_number", *arrival, reason.alias("reason"))
    return claims, lines, rejected
