"""Training-data pipeline over `documents`: five stages, each written as Parquet and read again as the next one's input.

1. toxicity: documents that the model rejects go.
2. jaccard_join: of each group of near duplicates the document with the smallest id stays.
3. decontamination: documents contaminated by benchmark items go.
4. secrets: found secrets are masked in the texts, `n_chars` follows; no document goes.
5. bpe: token ids of what is left, with the digests of the ids and of the decoded bytes.

Stages 1 to 4 return the columns of `documents`. Rows with a null id or text stay unless a stage's rule rejects them; rows
that repeat an id are one document, of which stage 2 keeps one row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm import bpe, decontamination, jaccard_join, secrets, toxicity
from claimloom.llm.linking import narrowed
from claimloom.storage import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Rows and bytes of an Arrow batch: texts are long, and a batch is held by the JVM and by its Python worker.
BATCH_ROWS, BATCH_BYTES = 500, "4m"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    found = jaccard_join.join(docs)
    # a table of ids, far smaller than the texts, which stay where they are unless the list is too large to broadcast
    others = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    left = docs.join(narrowed(others), "doc_id", "left_anti")
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice = materialize(twice, "repeated_ids")
    if twice.limit(1).count():
        order = Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars")
        one = left.join(narrowed(twice), "doc_id", "left_semi").withColumn("_row", F.row_number().over(order)).where("_row = 1")
        left = left.join(narrowed(twice), "doc_id", "left_anti").unionByName(one.drop("_row"))
    return left.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs, keep_text=True)
    masked = found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    return masked.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    vocabulary = bpe.load(public_tokenizers.path(TOKENIZER))
    made = bpe.checked(docs.select("doc_id", "lang", "source", "text"), vocabulary, public_tokenizers.PATTERN)
    n_tokens = (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens")
    return made.select("doc_id", "lang", "source", n_tokens, "ids", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", tokenize),
]

#: The toxicity model is trained, and the linking is iterative: SQL cannot express them. tests/llm/test_pipeline.py has a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
