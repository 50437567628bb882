"""What a task, a shuffle or the driver holds, on rows made here."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.functions.text import sparse_weights
from claimloom.models import explain, forest
from claimloom.operators import audit, features, ingest, retrieval
from claimloom.operators.history import with_asof_rates
from claimloom.session import prepare


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_guesses(spark):
    """Without the optimizer's own broadcasts, as with large tables."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_weights_of_leaves_are_made_once(monkeypatch):
    tree = [
        {"cover": 10.0, "value": 0.0, "left": 1, "right": 2, "feature": 0, "cut": [0.0], "codes": -1},
        {"cover": 4.0, "value": 1.0, "left": -1, "right": -1, "feature": -1, "cut": [], "codes": -1},
        {"cover": 6.0, "value": 0.0, "left": 3, "right": 4, "feature": 1, "cut": [0.0], "codes": -1},
        {"cover": 3.0, "value": 2.0, "left": -1, "right": -1, "feature": -1, "cut": [], "codes": -1},
        {"cover": 3.0, "value": 5.0, "left": -1, "right": -1, "feature": -1, "cut": [], "codes": -1},
    ]
    x = np.random.default_rng(1).normal(size=(50, 2))
    prepared = explain.with_weights([tree])
    monkeypatch.setattr(explain, "path_contributions", None)  # none is made for rows any more
    values, base = explain.shapley_values([tree], x, prepared)
    whole = np.where(x[:, 0] <= 0, 1.0, np.where(x[:, 1] <= 0, 2.0, 5.0))
    assert np.allclose(values.sum(axis=1) + base, whole)


def test_rows_walk_the_trees_in_blocks(monkeypatch):
    monkeypatch.setattr(forest, "WALK_ROWS", 7)
    rng = np.random.default_rng(2)
    trees = [{k: np.array(v) for k, v in forest.grow_tree(rng.normal(size=(40, 3)), rng, 6).items()} for _ in range(5)]
    x = rng.normal(size=(30, 3))
    x[4, 1] = np.nan

    def walk(tree, row) -> float:
        node = 0
        while tree["feature"][node] >= 0:
            node = tree["left" if row[tree["feature"][node]] <= tree["threshold"][node] else "right"][node]
        return tree["path"][node]

    found = forest.path_totals([forest._walkable(t) for t in trees], x)
    assert np.allclose(found, [sum(walk(t, row) for t in trees) for row in x])


def test_baselines_of_few_keys_send_no_rows(spark, no_guesses):
    rows = spark.createDataFrame([(i, i % 3 or None, float(i)) for i in range(30)], "claim_id long, payer_id long, claim_amount double")
    found = features.with_group_baselines(rows, {"payer": "payer_id"}, "claim_amount")
    assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
    got = {r["claim_id"]: (r["payer_frequency"], r["payer_average"]) for r in found.collect()}
    assert len(got) == 30 and got[1] == (10 / 30, sum(range(1, 30, 3)) / 10) and got[3] == (None, None)


def test_rates_of_few_instants_send_no_rows(spark, no_guesses):
    start = datetime(2020, 1, 1)
    rows = spark.createDataFrame([(i, i % 2, start + timedelta(days=i), i % 3 % 2) for i in range(40)], "id long, k long, ts timestamp, won int")
    rated = with_asof_rates(rows, {"rate": "k"}, "ts", "won")
    assert "SortMergeJoin" not in plan(rated)
    assert rated.count() == 40


def test_chain_takes_records_not_segments(spark):
    start = datetime(2020, 1, 1)
    rows = [(i, i % 2, start + timedelta(seconds=i), "user", "view", "{}") for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, entity_id long, created_at timestamp, actor_type string, event_type string, payload string")
    chain = audit.build_chain(events, segment_rows=7)
    assert "MapInPandas" not in plan(chain)  # it took whole segments, 10,000 to a batch
    assert "REPARTITION_BY_COL" in plan(chain).split("MapInArrow", 1)[1].split("SortMergeJoin", 1)[0]
    log = {(r["entity_id"], r["seq"]): r for r in chain.collect()}
    assert len(log) == 60
    for (entity, seq), r in log.items():
        text = '{"actor_type": "user", "event_type": "view", "payload": {}, "prev_hash": "' + r["prev_hash"] + '"}'
        assert r["hash"] == hashlib.sha256(text.encode()).hexdigest()
        if (seq - 1) % 7:
            assert r["prev_hash"] == log[entity, seq - 1]["hash"]
    assert log[0, 1]["prev_hash"] == "" and len(log[0, 8]["prev_hash"]) == 64
    assert {r["valid"] for r in audit.chain_status(chain, segment_rows=7).collect()} == {True}


def test_sparse_weights_shuffle_a_row_a_text(spark):
    rng = random.Random(4)
    texts = [(i // 2, None if i == 5 else i % 3, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(60)))) for i in range(200)]
    rows = spark.createDataFrame([*texts, (7, 1, None)], "document_id long, chunk_index int, chunk_text string").repartition(3)
    found = sparse_weights(rows, ["document_id", "chunk_index"], "chunk_text")
    assert plan(found).count("Exchange hashpartitioning") == 1
    want: dict = {}
    for d, c, text in texts:
        for word in text.split() if c is not None else ():
            slot = int.from_bytes(hashlib.md5(word.encode()).digest(), "big") % 768
            cells = want.setdefault((d, c), {})
            cells[slot % 384] = cells.get(slot % 384, 0) + (1 if slot < 384 else -1)
    want = {k: {i: n for i, n in cells.items() if n} for k, cells in want.items()}
    got: dict = {}
    for r in found.collect():
        cells = got.setdefault((r["document_id"], r["chunk_index"]), {})
        assert r["idx"] not in cells
        cells[r["idx"]] = r["count"]
        assert r["weight"] == r["count"] / math.sqrt(sum(n * n for n in want[r["document_id"], r["chunk_index"]].values()))
    assert got == {k: v for k, v in want.items() if v}


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    prepare(spark)
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    found = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
    assert max(found) < 8 << 20 and sum(found) > 3000 * 10_000


def test_packets_of_few_bundles_send_no_claims(spark, no_guesses):
    chunks = spark.createDataFrame([(1, 0, "t", "alpha beta")], "document_id long, chunk_index int, title string, chunk_text string")
    results = spark.createDataFrame([("q", 1, 0, 0.5, 1)], "query_id string, document_id long, chunk_index long, score double, rank int")
    found = retrieval.policy_bundles(results, chunks)
    assert "SortMergeJoin" not in plan(found)
    assert found.first()["cited"][0]["excerpt"] == "alpha beta"


def test_copies_of_messages_are_combined_before_the_shuffle(spark, no_guesses):
    """claim_ingest_dedupe: only the first message of a number in each task is shuffled, once; copies are one message."""
    line = "array<struct<code: string, units: int>>"
    rows = [
        ("a", 2, "m2", 5.0, [("x", 1)]),
        ("a", 1, "m1", None, [("z", 2), ("y", 1)]),
        ("a", 1, "m1", 7.0, [("y", 3)]),  # a copy: least values, column by column
        ("a", 1, "m1", 8.0, None),
        ("b", None, "m4", 3.0, [("x", 1)]),
        ("b", 1, "m3", 1.0, [("x", 1)]),
        ("c", 1, "m5", 1.0, [("x", 1)]),
        ("c", 2, "m6", 1.0, [("x", 1)]),
        ("c", 2, "m6", 1.0, [("x", 1)]),
        (None, 1, "m7", 1.0, [("x", 1)]),
    ]
    messages = spark.createDataFrame(rows, f"claim_number string, arrival int, message_id string, claim_amount double, lines {line}").repartition(3)
    known = spark.createDataFrame([("c",), (None,)], "claim_number string")
    claims, lines, rejected = ingest.ingest_claims(messages, known, ["arrival", "message_id"], copies=True)
    assert sorted((r["claim_number"], r["message_id"], r["claim_amount"]) for r in claims.collect()) == [("a", "m1", 7.0), ("b", "m4", 3.0)]
    assert sorted((r["claim_number"], r["line_index"], r["code"], r["units"]) for r in lines.collect()) == [("a", 0, "y", 3), ("b", 0, "x", 1)]
    assert sorted((r["claim_number"], r["message_id"], r["reason"]) for r in rejected.collect()) == [
        ("a", "m2", "duplicate in batch"), ("b", "m3", "duplicate in batch"), ("c", "m5", "claim_number already exists"), ("c", "m6", "claim_number already exists"),
    ]
    assert "hashpartitioning(claim_number" in plan(claims) and "message_id" not in "".join(x for x in plan(claims).splitlines() if "hashpartitioning" in x)
