"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # texts are long: a batch of so many bytes, not of 10,000 rows, is what a Python worker holds
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes in a session that somebody else built."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, RUNTIME_CONF[name])


def build_session(app: str = "claimloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark
