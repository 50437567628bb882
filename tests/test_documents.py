import hashlib
import json
import math
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from claimloom.functions.text import (
    VECTOR_DIM,
    chunk_documents,
    dense_embedding,
    sparse_weights,
    split_chunks,
    token_slot,
    token_slots,
)
from claimloom.operators import audit, retrieval
from claimloom.sources.readers import read_policy_corpus


def digest_slot(token):
    return int(hashlib.md5(token.encode()).hexdigest(), 16) % (2 * VECTOR_DIM)


def test_token_slot_equals_the_whole_digest(spark):
    words = [f"w{i}" for i in range(500)] + ["appeal", "policy"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", token_slot(F.col("w")).alias("s"))
    got = {r["w"]: r["s"] for r in df.collect()}
    assert got == {w: digest_slot(w) for w in words}
    assert got["appeal"] == 291 + VECTOR_DIM and got["policy"] == 214


def test_dense_and_sparse_vectors_agree(spark):
    df = spark.createDataFrame([(1, "Prior Authorization prior policy"), (2, "")], "id int, t string")
    dense = {r["id"]: r["v"] for r in df.select("id", dense_embedding(token_slots(F.col("t"))).alias("v")).collect()}
    assert sum(x * x for x in dense[1]) == pytest.approx(1.0, abs=1e-6) and not any(dense[2])
    for r in sparse_weights(df, ["id"], "t").collect():
        assert dense[r["id"]][r["idx"]] == pytest.approx(r["weight"], abs=1e-6)


def test_chunks_cover_the_text():
    text = "  ".join(f"Sentence number {i} says something." for i in range(200))
    chunks = split_chunks(text)
    clean = re.sub(r"\s+", " ", text).strip()
    assert all(len(c) <= 700 for c in chunks) and chunks[0].endswith(".")
    position = 0
    for c in chunks:
        found = clean.find(c, max(0, position - 101))
        assert 0 <= found <= position
        position = found + len(c)
    assert position == len(clean)
    assert split_chunks(" \n ") == [] and split_chunks("x" * 1500, 700, 100)[1] == "x" * 700


def corpus(spark, tmp_path):
    titles = ["Prior Authorization Rules", "Timely Filing Limits", "Coding and Modifier Guide"]
    docs = [{"title": t, "text": f"{t}. " + "appeal policy " * 20} for t in titles]
    docs[1]["source_type"] = "manual"
    (tmp_path / "p.json").write_text(json.dumps(docs))
    return read_policy_corpus(spark, str(tmp_path / "p.json"))


def test_policy_corpus_defaults_and_reasons(spark, tmp_path):
    docs = corpus(spark, tmp_path)
    assert {(r["source_type"], r["version"]) for r in docs.collect()} == {("payer_policy", "1.0"), ("manual", "1.0")}
    numbered = docs.withColumn("document_id", F.xxhash64("title"))
    expected = retrieval.reason_documents(numbered)
    assert {r["query_id"] for r in expected.collect()} == {"MISSING_AUTHORIZATION", "TIMELY_FILING", "CODING_MISMATCH"}


def cosine(a, b):
    va, vb = [0] * VECTOR_DIM, [0] * VECTOR_DIM
    for text, v in ((a, va), (b, vb)):
        for tok in re.findall("[a-z0-9]+", text.lower()):
            s = digest_slot(tok)
            v[s % VECTOR_DIM] += 1 if s < VECTOR_DIM else -1
    dot = sum(x * y for x, y in zip(va, vb))
    return dot / ((math.sqrt(sum(x * x for x in va)) or 1) * (math.sqrt(sum(x * x for x in vb)) or 1))


def test_retrieval_equals_brute_force_with_scope_copies_and_blocks(spark, monkeypatch):
    words = ["claim", "appeal", "policy", "denial", "code", "filing", "auth"]
    docs = [(i, " ".join(words[(i * k) % 7] for k in range(1, 6)), None if i % 3 == 0 else i % 4) for i in range(60)]
    docs += [(100 + i, "appeal policy", None) for i in range(30)]
    queries = [(i, f"{words[i % 7]} appeal policy", i % 4 if i % 2 else None) for i in range(9)]
    chunks = spark.createDataFrame(docs, "document_id bigint, chunk_text string, payer_id bigint").withColumn("chunk_index", F.lit(0))
    q = spark.createDataFrame(queries, "query_id bigint, text string, payer_id bigint")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    found = retrieval.retrieve(retrieval.with_slots(chunks).repartition(5), q, k=4).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["document_id"])
    for qid, text, payer in queries:
        visible = [(d, t) for d, t, p in docs if payer is None or p is None or p == payer]
        best = sorted(visible, key=lambda d: (-round(cosine(text, d[1]), 12), d[0]))[:4]
        assert got[qid] == [d for d, _ in best]


def test_excerpt_fidelity(spark):
    chunks = spark.createDataFrame([(1, 0, "A genuine sentence about policy. More.")], "document_id bigint, chunk_index bigint, chunk_text string")
    cites = spark.createDataFrame(
        [(1, 1, 0, "A genuine sentence..."), (2, 1, 0, "An invented sentence"), (3, 9, 0, "A genuine"), (4, 1, 0, "...")],
        "claim_id int, document_id bigint, chunk_index bigint, excerpt string",
    )
    checked = retrieval.check_citations(cites, chunks)
    assert {r["claim_id"]: (r["chunk_exists"], r["faithful"]) for r in checked.collect()} == {
        1: (True, True), 2: (True, False), 3: (False, False), 4: (True, False)
    }
    assert retrieval.citation_summary(checked.filter("claim_id > 9")).first()["referential_integrity_rate"] is None


def test_ingest_skips_known_titles(spark):
    docs = spark.createDataFrame([(1, "a", "some text"), (2, "b", "other text")], "document_id bigint, title string, text string")
    known = spark.createDataFrame([("a",)], "title string")
    assert {r["title"] for r in retrieval.ingest_documents(docs, known).collect()} == {"b"}
    assert chunk_documents(docs).count() == 2


EVENTS = "event_id bigint, entity_id bigint, created_at timestamp, actor_type string, event_type string, payload string"


def log(spark, n=40):
    rows = [(i, 1 if i % 3 else 2, __import__("datetime").datetime(2020, 1, 1, 0, i), "user", "edit", json.dumps({"k": i})) for i in range(n)]
    return rows, spark.createDataFrame(rows, EVENTS)


def test_chain_hashes_canonical_json(spark):
    rows, events = log(spark)
    got = {r["event_id"]: r for r in audit.build_chain(events).collect()}
    last = {}
    for i, entity, _, actor, kind, payload in rows:
        prev = last.get(entity, "")
        material = json.dumps({"prev_hash": prev, "actor_type": actor, "event_type": kind, "payload": json.loads(payload)}, sort_keys=True)
        digest = hashlib.sha256(material.encode()).hexdigest()
        assert (got[i]["prev_hash"], got[i]["hash"]) == (prev, digest)
        last[entity] = digest


def test_a_long_chain_is_one_chain(spark):
    """Over 1,000 records of one entity link to each other like the first ones; records without an entity have no chain."""
    t0 = __import__("datetime").datetime(2020, 1, 1)
    rows = [(i, None if i == 3 else i % 50 // 49, t0 + __import__("datetime").timedelta(seconds=i % 700), "user", "edit", json.dumps({"k": i})) for i in range(1_300)]
    chain = audit.build_chain(spark.createDataFrame(rows, EVENTS).repartition(5))
    got = {r["event_id"]: r for r in chain.collect()}
    last, seq = {}, {}
    for i, entity, _, actor, kind, payload in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[2], r[0])):
        prev, seq[entity] = last.get(entity, ""), seq.get(entity, 0) + 1
        material = json.dumps({"prev_hash": prev, "actor_type": actor, "event_type": kind, "payload": json.loads(payload)}, sort_keys=True)
        last[entity] = hashlib.sha256(material.encode()).hexdigest()
        assert (got[i]["seq"], got[i]["prev_hash"], got[i]["hash"]) == (seq[entity], prev, last[entity])
    assert len(got) == 1_299 and max(seq.values()) > 1_000
    edited = chain.withColumn("payload", F.when(F.col("event_id") == 501, "{}").otherwise(F.col("payload")))
    assert audit.verify_chain(chain).count() == 0
    assert [r["first_bad_event"] for r in audit.verify_chain(edited).collect()] == [501]


@pytest.mark.parametrize("segment_rows", [10_000, 7])
def test_verification_finds_the_edited_row(spark, segment_rows):
    _, events = log(spark)
    chained = audit.build_chain(events, segment_rows=segment_rows)
    assert audit.verify_chain(chained).count() == 0
    edited = chained.withColumn("payload", F.when(F.col("event_id") == 20, "{}").otherwise(F.col("payload")))
    bad = audit.verify_chain(edited).collect()
    assert [(r["entity_id"], r["first_bad_event"]) for r in bad] == [(1, 20)]
    removed = audit.verify_chain(chained.filter("event_id <> 20")).collect()
    assert len(removed) == 1 and removed[0]["entity_id"] == 1


def test_action_policy(spark):
    names = ["draft_appeal", *audit.BLOCKED_ACTIONS, "drop_table", "draft_appeal; submit_appeal"]
    df = spark.createDataFrame([(n,) for n in names], "action string")
    kinds = {r["action"]: r["violation"] for r in audit.policy_violations(df).collect()}
    assert "draft_appeal" not in kinds and len(kinds) == len(names) - 1
    assert all(kinds[a] == "blocked" for a in audit.BLOCKED_ACTIONS) and kinds["drop_table"] == "unknown"


def test_repeated_and_text_ids_over_block_edges(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    chunks = retrieval.with_slots(
        spark.createDataFrame([("d1", 0, "alpha beta", "p1"), ("d2", 0, "gamma delta", None), ("d3", 0, "alpha gamma", "p2")], "document_id string, chunk_index bigint, chunk_text string, payer_id string")
    )
    queries = spark.createDataFrame([("q1", "alpha", "p1"), ("q2", "gamma", "p1"), ("q2", "alpha", "p2"), ("q3", "delta", None)], "query_id string, text string, payer_id string")
    got = sorted((r["query_id"], r["document_id"]) for r in retrieval.retrieve(chunks, queries, k=1).collect())
    assert got == [("q1", "d1"), ("q2", "d2"), ("q2", "d3"), ("q3", "d2")]
    first = retrieval.first_document_with(chunks.withColumnRenamed("chunk_text", "t"), queries.select("query_id", "text"), "t")
    assert sorted(map(tuple, first.collect())) == [("q1", "d1"), ("q2", "d1"), ("q2", "d2"), ("q3", "d2")]
    assert retrieval.retrieve(chunks, queries.limit(0)).count() == 0


def test_null_hash_breaks_the_chain(spark):
    events = spark.createDataFrame([(i, 1, "u", "e", '{"a": 1}', i) for i in range(1, 6)], "event_id bigint, entity_id bigint, actor_type string, event_type string, payload string, t bigint")
    log = audit.build_chain(events.withColumn("created_at", F.timestamp_seconds("t")).drop("t"))
    assert audit.verify_chain(log).count() == 0
    last = F.col("event_id") == 5
    edited = log.withColumn("hash", F.when(~last, F.col("hash"))).withColumn("payload", F.when(last, F.lit("{}")).otherwise(F.col("payload")))
    assert [r["first_bad_event"] for r in audit.verify_chain(edited).collect()] == [5]


def test_pages_are_not_capped(spark):
    from claimloom.operators.recovery import queue_page

    queue = spark.range(900).select(F.col("id").alias("claim_id"), F.lit(1.0).alias("priority_score"))
    assert queue_page(queue, limit=500).count() == 500


def test_many_queries_meet_the_chunks_in_blocks(spark):
    """100,000 queries, many of them equal: no query passes the driver, each text is scored once."""
    rng = random.Random(1)
    words = [f"word{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=12))) for i in range(300)]
    chunks = retrieval.with_slots(spark.createDataFrame(docs, "document_id bigint, chunk_text string").withColumn("chunk_index", F.lit(0)))
    texts = [" ".join(rng.choices(words, k=3)) for _ in range(4_000)]
    queries = spark.range(100_000).select(
        F.col("id").alias("query_id"), F.get(F.array(*[F.lit(t) for t in texts[:500]]), (F.col("id") % 500).cast("int")).alias("text")
    ).unionByName(spark.createDataFrame([(200_000 + i, t) for i, t in enumerate(texts)], "query_id bigint, text string"))
    found = retrieval.retrieve(chunks, queries, k=3, scoped=False).persist()
    assert found.count() == 3 * 104_000
    for i in rng.sample(range(4_000), 25):
        got = [r["document_id"] for r in found.filter(F.col("query_id") == 200_000 + i).orderBy("rank").collect()]
        assert got == [d for d, t in sorted(docs, key=lambda d: (-round(cosine(texts[i], d[1]), 12), d[0]))[:3]]
    pairs = found.filter("query_id < 100000").groupBy(F.col("query_id") % 500, "rank").agg(F.count_distinct("document_id").alias("n"))
    assert pairs.filter("n > 1").count() == 0
    found.unpersist()


@pytest.mark.parametrize("sample", [8, 2])
def test_first_document_with_equals_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(retrieval, "GRAM_SAMPLE", sample)
    rng = random.Random(sample)
    letters = "abÄé漢😀 "
    bodies = ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(80)] + [None, "", "x" * 5_000 + "END"]
    docs = [(1_000 - i, t) for i, t in enumerate(bodies)]
    words = ["", None, "zzz", "xEND", "x" * 40, "ä"] + ["".join(rng.choices(letters, k=n)) for n in (1, 1, 2, 3, 5, 8, 9)]
    words += [t[a : a + n] for t in rng.sample(bodies[:60], 30) for a, n in [(rng.randrange(0, 20), rng.choice([2, 7, 8, 12, 30]))]]
    got = retrieval.first_document_with(
        spark.createDataFrame(docs, "document_id bigint, body string").withColumn("word", F.lit("clash")),
        spark.createDataFrame(list(enumerate(words)), "query_id bigint, text string"), "body",
    )
    want = {}
    for i, w in enumerate(words):
        held = [d for d, t in docs if w is not None and t is not None and w.lower() in t.lower()]
        want |= {i: min(held)} if held else {}
    assert {r["query_id"]: r["expected_document_id"] for r in got.collect()} == want


def test_nothing_is_collected():
    source = Path(retrieval.__file__).read_text()
    assert ".collect(" not in source and "toPandas" not in source
