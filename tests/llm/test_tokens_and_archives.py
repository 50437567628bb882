import base64
import gzip
import hashlib
import random
import time
import weakref

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from claimloom.llm import bpe, warc
from claimloom.storage import new_path


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def texts(seed):
    rng = random.Random(seed)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = ["", None, " ", "a" * 20_000, "ab" * 9_000, "it's <|endoftext|> we'll", "".join(rng.choices("abcdefgh", k=30_000))]
    rows += ["".join(rng.choices(points, k=800)) for _ in range(10)] + ["".join(rng.choices("ab \n\t\x1c\x85\xa0'srem12", k=500)) for _ in range(40)]
    return rows


@pytest.mark.parametrize("array_bytes", [0, 10**9])
def test_bpe_equals_tiktoken(spark, vocabulary, monkeypatch, array_bytes):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: r for r, t in vocabulary.tokens.items()}, special_tokens={})
    monkeypatch.setattr(bpe, "ARRAY_BYTES", array_bytes)
    rows = texts(array_bytes % 7)
    worker = bpe._Worker(vocabulary, public_tokenizers.PATTERN)
    want = [np.array(enc.encode_ordinary(t or ""), "<u4").tobytes() for t in rows]
    assert worker.encode([t or "" for t in rows]) == want
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, ids string").repartition(2)
    got = {r["doc_id"]: (bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.round_trip(docs, vocabulary, public_tokenizers.PATTERN).collect()}
    assert got == {i: (w, (t or "").encode()) for i, (w, t) in enumerate(zip(want, rows, strict=True))}


def test_bpe_ranks_out_of_order():
    """Where a longer token has a lower rank than its parts, the order of merges matters."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 290, b"cd": 310, b"abcd": 260, b"aa": 400, b"aaa": 270, b"bb": 305, b"bbb": 299}
    v = bpe.Vocabulary(ranks)
    enc = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=ranks | {b"\xff\xff\xff" + bytes([i]): 10_000 + i for i in range(3)}, special_tokens={})
    rng = random.Random(4)
    words = ["".join(rng.choices("abcd", k=rng.randrange(1, 40))) for _ in range(4_000)]
    want = [np.array(enc.encode_ordinary(w), "<u4").tobytes() for w in words]
    assert [np.array(bpe.merge_one(w.encode(), v), "<u4").tobytes() for w in words] == want
    bpe_bytes, bpe.ARRAY_BYTES = bpe.ARRAY_BYTES, 0
    try:
        assert bpe.merge_many([w.encode() for w in words], v) == want
    finally:
        bpe.ARRAY_BYTES = bpe_bytes


def test_decode_rejects_unknown_ids(vocabulary):
    with pytest.raises(ValueError, match="unknown id"):
        bpe._Worker(vocabulary, "").decode(np.array([999_999], "<u4").tobytes())


PAGES = [(3, "http://a/x", "<p>é</p>", 1), (1, "http://a/y", "<p>é</p>", 1), (2, None, None, 1), (5, "http://a/\r\nz", "", 2), (4, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\n" * 3, 2), (9, "v", "x" * 200_000, 3), (9, "v", "x" * 200_000, 3)]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, start long")


def test_warc_round_trip(spark):
    got = sorted((int(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["kind"]) for r in warc.round_trip(pages(spark)).collect())
    smallest = {}
    for i, _, html, _ in PAGES:
        smallest[html or ""] = min(i, smallest.get(html or "", i))
    want = []
    for i, _, html, _ in PAGES:
        body = (html or "").encode()
        first = smallest[html or ""]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == first else "revisit", None if i == first else str(first), "record"))
    assert got == sorted(want)
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_warc_files_are_plain_gzip(spark):
    path = new_path(spark, "warc")
    warc.write(warc.plan(pages(spark)).coalesce(1), path)
    blob = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect())
    assert gzip.decompress(blob).count(b"WARC-Type: re") == len(PAGES)


def damaged(seed):
    rng = random.Random(seed)
    records = [warc.render(str(i), f"http://h/{i}", rng.randbytes(rng.randrange(0, 400)), None) for i in range(30)]
    plain = [gzip.decompress(r) for r in records]
    return records, plain


@pytest.mark.parametrize("seed", range(6))
def test_salvage_recovers_later_records(seed):
    records, plain = damaged(seed)
    rng = random.Random(seed)
    for members in (records, plain):
        broken = set(rng.sample(range(30), 5))
        parts = []
        for k, m in enumerate(members):
            if k in broken:
                m = bytearray(m)
                at = len(m) // 2 if members is records else m.index(b"\r\n\r\n") - 3
                m[at] ^= 0x55
                m = bytes(m[: len(m) - rng.randrange(0, 3)])
            parts.append(m)
        data = b"junk" + b"".join(parts) + b"tail"
        found = list(warc.salvage(data))
        whole = {int(x["record_id"]) for _, _, x in found if isinstance(x, dict)}
        assert whole >= set(range(30)) - broken
        gaps = [(a, b) for a, b, x in found if isinstance(x, str)]
        assert gaps and gaps[0][0] == 0 and gaps[-1][1] == len(data)
        covered = sorted({(a, b) for a, b, _ in found})
        assert covered[0][0] == 0 and all(x[1] == y[0] for x, y in zip(covered, covered[1:], strict=False))


def test_salvage_inside_a_member():
    _, plain = damaged(9)
    bad = plain[1].replace(b"WARC-Type", b"WARC Type", 1).replace(b"Content-Length:", b"Content-Length ", 1)
    data = gzip.compress(plain[0] + bad + plain[2])
    found = [x if isinstance(x, str) else x["record_id"] for _, _, x in warc.salvage(data)]
    assert found[0] == "0" and found[-1] == "2" and "of the content" in found[1]


def test_salvage_is_linear():
    rng = random.Random(5)
    one = [warc.render(str(i), "http://h/", rng.randbytes(600), None) for i in range(4_000)]

    def seconds(records, damage):
        data = bytearray(warc.EMPTY_MEMBER.join(records))
        for at in range(700, len(data), damage):
            data[at] ^= 0x55
        began = time.process_time()
        found = sum(isinstance(x, dict) for _, _, x in warc.salvage(bytes(data)))
        assert found >= len(records) - len(data) // damage - 1
        return (time.process_time() - began) / len(records)

    for damage in (10**9, 5_000):
        assert seconds(one, damage) < 4 * seconds(one[:500], damage) + 1e-4


def test_checked_digests(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    docs = spark.createDataFrame(list(enumerate(texts(3))), "doc_id long, text string").repartition(1)
    whole = {r["doc_id"]: (bytes(r["ids"]), hashlib.sha256(r["decoded"]).hexdigest()) for r in bpe.round_trip(docs, vocabulary, public_tokenizers.PATTERN).collect()}
    assert whole == {r["doc_id"]: (bytes(r["ids"]), r["decoded_sha256"]) for r in bpe.checked(docs, vocabulary, public_tokenizers.PATTERN).collect()}


def test_cache_goes_with_its_vocabulary():
    """A worker whose next tasks are of another step must not hold the tokenizer any longer."""

    class Shared:
        value = bpe.Vocabulary({bytes([b]): b for b in range(256)} | {b"ab": 256})

    shared = Shared()
    held = bpe._worker(shared, "[a-z]+")
    assert held.encode(["abc"]) == [np.array([256, 99], "<u4").tobytes()] and bpe._worker(shared, "[a-z]+") is held
    gone = weakref.ref(Shared.value)
    del Shared.value, held
    assert gone() is None and not len(bpe._workers)
