"""Appending sinks. Every sink takes a base path and writes Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Period labels written with drift metrics.
REFERENCE_PERIOD = "training split (first ~80% of claims chronologically)"
CURRENT_PERIOD = "most recent claims"


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


#: Partition column of tables that a stream writes batch by batch.
BATCH = "batch_id"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One micro-batch as a folder of its own; a batch that is run again replaces it."""
    df.drop(BATCH).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def write_claims_by_month(claims: DataFrame, path: str) -> None:
    """Claims laid out by submission month, so date filters prune folders."""
    dated = claims.withColumn("submission_month", F.date_format("submission_date", "yyyy-MM"))
    append(dated, path, ["submission_month"])


def with_drift_labels(metrics: DataFrame, version_id: str | None, recorded_at) -> DataFrame:
    return metrics.select(
        F.lit(version_id).cast("string").alias("model_version_id"),
        "*",
        F.lit(REFERENCE_PERIOD).alias("reference_period"),
        F.lit(CURRENT_PERIOD).alias("current_period"),
        F.lit(recorded_at).cast("timestamp").alias("recorded_at"),
    )


def metric_rows(wide: DataFrame, ids: Sequence[str], names: Sequence[str], prefix: str = "") -> DataFrame:
    """One row per metric from a wide row; null metrics are left out."""
    doubled = wide.select(*ids, *[F.col(n).cast("double").alias(f"{prefix}{n}") for n in names])
    long = doubled.unpivot(list(ids), [f"{prefix}{n}" for n in names], "metric_name", "metric_value")
    return long.filter(F.col("metric_value").isNotNull())


def ranking_metric_rows(metrics: DataFrame, version_id: str, strategy: str = "model_expected_value") -> DataFrame:
    """`ranking_<metric>` rows of the model strategy only."""
    names = [c for c in metrics.columns if c not in ("strategy", "n_items")]
    chosen = metrics.filter(F.col("strategy") == strategy).withColumn("model_version_id", F.lit(version_id))
    return metric_rows(chosen, ["model_version_id"], names, "ranking_")


def write_summary(summary: DataFrame, path: str, computed_at) -> None:
    """Append a one-row summary; readers take the latest."""
    append(summary.withColumn("computed_at", F.lit(computed_at).cast("timestamp")), path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Latest summary row."""
    return spark.read.parquet(path).orderBy(F.col("computed_at").desc()).limit(1)


def summary_state(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """One row: `state` and the named values of the latest summary, or "not computed" and nulls if none was ever written."""
    try:
        return read_summary(spark, path).select(F.lit("computed").alias("state"), *names)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    nothing = spark.range(1)
    return nothing.select(F.lit("not computed").alias("state"), *[F.lit(None).cast("bigint").alias(n) for n in names])
