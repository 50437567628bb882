import hashlib
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.llm import suffixes
from claimloom.llm.queries import op5_suffix_array


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha256 of the kept bytes) by looking at every string."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, length):
    rng = random.Random(seed)
    letters = "abcdefgh éü\n"
    text = lambda n: "".join(rng.choices(letters, k=n))
    shared = [text(length + d) for d in (-40, -4, -1, 0, 1, 3, 60, 300)]
    rows = [text(rng.randrange(0, 4 * length)) + rng.choice(shared) + text(rng.randrange(0, 2 * length)) for _ in range(60)]
    base = text(6 * length)
    for _ in range(25):
        near = list(base)
        for _ in range(rng.randrange(0, 5)):
            near[rng.randrange(len(near))] = rng.choice("XYZ")
        rows.append("".join(near))
    rows += [rows[3]] * 4 + ["a" * (3 * length), "ab" * (2 * length), "", None, text(length), "x" + base[: length - 1], base[1 : length + 1]]
    twice = text(length + 20)
    rows.append(twice + text(50) + twice)
    return rows


def run(spark, rows, length, gram, **options):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = suffixes.dedup(docs, length=length, gram=gram, **options)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).orderBy("doc_id").collect()
    return [tuple(r)[1:] for r in got]


@pytest.mark.parametrize(("length", "gram", "bucket_kinds"), [(60, 20, 4096), (60, 20, 3), (400, 128, 4096)])
def test_equals_every_string(spark, length, gram, bucket_kinds):
    rows = corpus(length + bucket_kinds, length)
    assert run(spark, rows, length, gram, bucket_kinds=bucket_kinds) == brute(rows, length)


def test_edge_tables(spark):
    docs = spark.createDataFrame([(None, None, "k"), (1, "short", "k"), (1, "x" * 500, "m"), (2, "x" * 500, None)], "doc_id long, text string, key string").withColumn("kept", F.lit(1))
    got = {(r["doc_id"], r["key"]): (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup(docs).collect()}
    assert got == {(None, "k"): (0, 0, 0, b""), (1, "k"): (5, 0, 0, b"short"), (1, "m"): (500, 500, 1, b""), (2, None): (500, 500, 1, b"")}
    assert suffixes.dedup(docs.limit(0)).count() == 0


def test_grams_with_many_strings_and_clashing_names(spark):
    rows = corpus(11, 60)
    assert run(spark, rows, 60, 20, bucket_strings=25) == brute(rows, 60)
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in enumerate(rows)], "doc_id long, text string, key int, starts int, _starts int, of int")
    got = suffixes.dedup(docs, length=60, gram=20)
    assert {(r["key"], r["starts"], r["_starts"], r["of"]) for r in got.collect()} == {(1, 2, 3, 4)} and got.count() == len(rows)


class Captured:
    """In place of a table: gives the function that would run in its tasks."""

    def mapInArrow(self, work, schema):
        return work


def test_runs_hold_little_beside_their_batch():
    rng = random.Random(8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000)), pa.array(["".join(rng.choices("abcdefgh ", k=3_000)) for _ in range(1_000)])], names=["key", "text"])
    work = suffixes.runs(Captured(), 400, 128)
    sum(b.num_rows for b in work([batch.slice(0, 10)]))
    tracemalloc.start()
    rows = sum(b.num_rows for b in work([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 1_000 and peak < 24 << 20


def test_query_reads_small_batches(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "64m")
    try:
        spark.createDataFrame([(1, "x" * 500), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        found = op5_suffix_array(spark, str(tmp_path))
        assert spark.conf.get(name) == "4m"
        assert {(r["doc_id"], r["n_removed"]) for r in found.collect()} == {(1, 500), (2, 0)}
    finally:
        spark.conf.set(name, before)


def test_no_broadcast_grows_with_the_texts(spark):
    """Runs meet their texts by a shuffle: lists of all wanted runs do not pass the driver. A text that comes often is read once or more often, with one result."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        rng = random.Random(6)
        rows = ["".join(rng.choices("abcdefgh ", k=90)) for _ in range(20)]
        texts = spark.createDataFrame([(i % 20, rows[i % 20]) for i in range(45)], "key long, text string")
        wanted = suffixes.runs(texts, 60, 20).select("h", "c", "key", "first", "last").distinct()
        pieces = suffixes._pieces(texts, wanted, 60, 20)
        plan = pieces._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
        got = {(r["h"], r["c"]): bytes(r["piece"]).decode() for r in pieces.collect()}
        assert got == {(r["h"], r["c"]): rows[r["key"]][r["first"] : r["last"] + 60] for r in wanted.collect()}
    finally:
        spark.conf.set(name, before)
