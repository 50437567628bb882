"""Written intermediate tables.

A few operators must read one shuffled result twice and see the same rows in the
same slices both times. They write it once to the cluster's shared checkpoint
folder and read it back, so a lost executor costs a re-read, never a different
answer.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Spark's setting by which a query's shuffle files go with its end, not with some later garbage collection of the driver.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="claimloom-")
    spark.conf.set(CHECKPOINT_CONF, local)
    return local


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/claimloom/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and return a scan of the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_end(spark):
        df.write.mode("errorifexists").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` returned. What is still to be read must not depend on them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(_written.pop(table))
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Tables of at most so many bytes and tasks are dealt out again; larger ones have splits of their own.
SPREAD_BYTES, SPREAD_TASKS = 64 << 20, 64


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a small scan with fewer splits than cores to more cores.

    A small file is one split, and everything up to the first shuffle would run in one
    task. What is shuffled here is bounded, whatever the number of cores.
    """
    tasks = min(scan.sparkSession.sparkContext.defaultParallelism, SPREAD_TASKS)
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(tasks) if size <= SPREAD_BYTES and scan.rdd.getNumPartitions() < tasks else scan


#: Rows of a written table up to which it is broadcast to a join by a key that few rows differ in; a longer one is shuffled.
BROADCAST_ROWS = 200_000


def small_side(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`table`, marked for broadcast if its measured length allows it.

    A join by payer, provider or day would send all rows of the other side, a large one, to as many tasks as there are keys.
    """
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
