"""Scans: tables, point lookups, the policy corpus and incoming claims."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.sources.schemas import CLAIM_INPUT, DOCUMENT_DEFAULTS, POLICY_DOCUMENT


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Relational scan split by key range, so no single task reads the table."""
    return spark.read.jdbc(
        url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=dict(properties or {})
    )


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose key is asked for."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def missing_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Asked-for keys that do not exist, as error rows."""
    absent = keys.select(key).distinct().join(df.select(key), key, "left_anti")
    return absent.select(key, F.lit("not found").alias("error"))


def filtered(df: DataFrame, **equals: object) -> DataFrame:
    """Optional equality filters; arguments that are None do not filter."""
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def metrics_with_prefix(df: DataFrame, prefix: str, column: str = "metric_name") -> DataFrame:
    return df.filter(F.col(column).startswith(prefix))


def page(df: DataFrame, sort: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One result page; `sort` must end in a unique key for a stable order."""
    return df.orderBy(*sort).offset(offset).limit(limit)


def read_policy_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Policy documents from JSON arrays of {title, source_type, version, text}."""
    raw = spark.read.option("multiLine", True).schema(POLICY_DOCUMENT).json(path)
    return raw.select(
        "title",
        *[F.coalesce(F.col(name), F.lit(value)).alias(name) for name, value in DOCUMENT_DEFAULTS.items()],
        "text",
    )


def read_claim_messages(spark: SparkSession, path: str) -> DataFrame:
    """Incoming claims, one JSON object per line."""
    return spark.read.schema(CLAIM_INPUT).json(path)


def parse_claim_messages(df: DataFrame, column: str = "value") -> DataFrame:
    """Incoming claims held as JSON text in a column, for example from a stream."""
    return df.select(F.from_json(F.col(column), CLAIM_INPUT).alias("m")).select("m.*")
