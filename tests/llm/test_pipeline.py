"""The pipeline against a brute-force version of its five stages; the toxicity decisions are the operator's own."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from claimloom.llm import bpe, toxicity
from tests.llm.test_scans_and_rules import brute_hits, brute_spans, toxic_case
from tests.llm.test_jaccard_join import brute as brute_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    docs, labels = toxic_case(5, 260)
    texts = [t for _, t, _ in docs]
    for k in range(20):  # copies, near copies, contaminated texts, secrets
        texts[60 + k] = texts[k]
        words = texts[20].split()
        words[rng.randrange(len(words))] = f"new{k}"
        texts[90 + k] = " ".join(words)
    items = [" ".join(f"bench{i}w{j}" for j in range(15)) for i in range(3)]
    for k in range(6):
        texts[120 + k] = "start " + items[k % 3] + " end"
        texts[130 + k] += f"\npassword: hunter2{k}xyz and {'0a1b' * 8}"
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, "w " * 40_000, "en", "s", 80_000), (5, texts[5], "en", "src2", 1), (None, "no id here at all", "en", "s", 17)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, list(enumerate(items))


def masked(text):
    out, at = [], 0
    for a, _, b in brute_spans(text):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_pipeline_equals_brute_force(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    scores = {(r["doc_id"], r["text"]): r["score"] for r in toxicity.score(docs, model).collect()}
    kept = [r for r in rows if scores[r[0], r[1]] < 0.5]
    assert len(kept) < len(rows) - 40
    one = {r[0]: r for r in kept if r[0] is not None}
    component = {i: c for i, _, c in brute_components([(r[0], r[1]) for r in one.values()])}
    kept = [r for r in one.values() if component[r[0]] == r[0]] + [r for r in kept if r[0] is None]
    hits = brute_hits([(r[0], r[1]) for r in kept], items)
    kept = [(r[0], masked(r[1] or "")) for r in kept if not hits[r[0]][3]]
    ranks = bpe.load(public_tokenizers.path(corpus_pipeline.TOKENIZER)).tokens
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: r for r, t in ranks.items()}, special_tokens={})
    want = {}
    for i, text in kept:
        ids = np.array(enc.encode_ordinary(text), "<u4").tobytes()
        want[i] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want)


def test_stages_keep_the_columns(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, path).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), path).count() == 0
