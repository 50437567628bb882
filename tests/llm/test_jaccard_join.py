import random
import re

import pytest
from pyspark.sql import Row

from claimloom.llm import jaccard_join

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, k=5):
    """(id, n, component) by comparing all pairs."""

    def shingles(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**9)}"
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for size in (3, 5, 6, 9, 20, 60, 150):
        base = rng.choices(vocabulary, k=size)
        for _ in range(45):
            rows.append(" ".join(edited(rng, base, rng.randrange(0, max(2, size // 25)))))
        for _ in range(6):  # at the limit of similarity
            rows.append(" ".join(edited(rng, base, max(1, size // 40)) + rng.choices(vocabulary, k=size // 12)))
    for _ in range(50):  # one passage shared by otherwise different texts
        rows.append(" ".join(rng.choices(vocabulary, k=rng.randrange(5, 90)) + passage + rng.choices(vocabulary, k=rng.randrange(5, 90))))
    rows += [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 120))) for _ in range(60)]
    rows += ["", None, "  \n", "One", "ONE", rows[0].upper()]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("rare", [4, 32])
def test_equals_all_pairs(spark, rare):
    rows = corpus(rare)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.join(docs, rare=rare).collect())
    assert got == brute(rows)


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [Row(doc_id=2, text="a b c d e f", n=1, node="x"), Row(doc_id=2, text="a b c d e f", n=1, node="x"), Row(doc_id=1, text="A b c d e f", n=1, node=None), Row(doc_id=None, text="a b c d e f", n=1, node="y"), Row(doc_id=7, text=None, n=1, node="y")],
        "doc_id long, text string, n long, node string",
    )
    got = sorted((tuple(r) for r in jaccard_join.join(docs).collect()), key=str)
    assert got == sorted([(2, 2, 1), (2, 2, 1), (1, 2, 1), (None, 2, None), (7, 0, 7)], key=str)
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(rng, words, 900))), (3, " ".join(rng.sample(words, len(words)))), (4, "q " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
