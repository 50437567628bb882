import math
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from claimloom.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Each source's target by resharing what is above the caps until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, open_, left = dict.fromkeys(order, Fraction(0)), set(order), share * sum(sizes.values())
    while open_ and left > 0:
        whole = sum(weight[s] for s in open_)
        give = {s: left * weight[s] / whole for s in open_}
        left = Fraction(0)
        for s in list(open_):
            out[s] += give[s]
            if out[s] >= most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = Fraction(most * sizes[s])
                open_.discard(s)
    return out


def corpus(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = " ".join(f"w{rng.randrange(999)}" for _ in range(rng.choice([0, 1, 5, 30, 200])))
        rows.append((i, rng.choice(["", " ", "\n"]) + words, rng.choice(["a", "a", "a", "b", "é", "tiny", None])))
    rows = [r if r[2] != "tiny" or r[0] % 9 == 0 else (*r[:2], "b") for r in rows]
    rows += [(900, None, "a"), (901, "", "none"), (902, "\x0b \x1c", "a"), (903, "x " * 9_000, "b"), (None, "no id", "a")] + [rows[3]] * 4
    return rows


def run(spark, rows, parts=3, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).repartition(parts)
    return docs, mixing.mix(docs, **options)


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"block": 16, "shard_words": 900}), (3, {"block": 5, "shard_words": 77, "weights": (1, 9)})])
def test_quotas_are_exact(spark, monkeypatch, seed, options):
    monkeypatch.setattr(mixing, "PAGE", 2)
    rows = corpus(seed)
    docs, mixed = run(spark, rows, **options)
    got = [r.asDict() for r in mixing.taken(mixed).collect()]
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want, taken = targets(sizes, options.get("weights", (3, 1, 2))), Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12, abs=1e-9)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    pieces = [r.asDict() for r in mixed.pieces.collect()]
    spots = Counter((p["no"], p["pos"], p["pass"], w) for p in pieces for w in range(p["begin"], p["end"]))
    assert max(spots.values()) == 1
    draws = Counter(shard for shard, _, _ in {(p["shard"], p["no"], p["draw"]) for p in pieces})
    assert max(draws.values()) - min(draws.values()) <= 1 and len(draws) == max(1, math.ceil(sum(taken.values()) / options.get("shard_words", mixing.SHARD_WORDS)))
    places = {(p["shard"], p["place"]): (p["no"], p["draw"]) for p in pieces}
    assert len(places) == sum(draws.values()) and {k for _, k in places} == set(range(1, max(draws.values()) + 1))
    again = mixing.taken(run(spark, rows[::-1], 7, **options)[1]).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["source"] or "", r["taken"])
    assert sorted(map(tuple, again), key=str) == sorted((tuple(r.values()) for r in got), key=str) and sorted(again, key=key)
    made = mixing.texts(mixed, docs).agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert made == sum(taken.values())


def chances(good, bad, draws):
    whole = math.comb(good + bad, draws)
    return [Fraction(math.comb(good, k) * math.comb(bad, draws - k), whole) if k <= good and draws - k <= bad else Fraction(0) for k in range(draws + 1)]


@pytest.mark.parametrize(("good", "bad", "draws"), [(7, 9, 6), (1, 40, 20), (300, 200, 251), (0, 5, 3), (5, 0, 4), (3, 3, 6)])
def test_draws_follow_the_distribution(spark, good, bad, draws):
    """Inversion: the share of u that gives k is the chance of k."""
    n = 4_000
    long_ = lambda x: F.lit(x).cast("bigint")
    table = spark.range(n).select(mixing.hypergeometric((F.col("id") + 0.5) / n, long_(good), long_(bad), long_(draws)).alias("k"))
    got = Counter(r["k"] for r in table.collect())
    want = chances(good, bad, draws)
    assert sum(got.values()) == n and all(abs(got[k] / n - float(p)) < 1.5 / n for k, p in enumerate(want)) and not set(got) - set(range(draws + 1))


def test_tree_counts(spark):
    """Every split keeps the quotas; the counts of a shard have the mean and spread of draws without replacement."""
    quotas = [500, 0, 37, 120, 3]
    facts = spark.createDataFrame(list(enumerate(quotas)), "no long, quota long")
    first = []
    for seed in range(30):
        rows = mixing.split(facts, 5, sum(quotas), seed).collect()
        for no, quota in enumerate(quotas):
            own = sorted((r["start"], r["count"], r["shard"]) for r in rows if r["no"] == no)
            assert sum(r[1] for r in own) == quota and all(a[0] + a[1] == b[0] and a[2] < b[2] for a, b in zip(own, own[1:], strict=False))
        sizes = Counter()
        for r in rows:
            sizes[r["shard"]] += r["count"]
        assert sorted(sizes.values()) == [132] * 5
        first.append(sum(r["count"] for r in rows if r["shard"] == 0 and r["no"] == 0))
    assert abs(sum(first) / 30 - 100) < 4 and 2 < math.sqrt(sum((x - 100) ** 2 for x in first) / 30) < 8


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation_is_a_bijection(spark, n):
    made = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), 24, F.lit(5)).alias("x")).collect()
    assert sorted(r["x"] for r in made) == list(range(n))
    if n == 1000:
        assert sum(abs(r["x"] - k) < 50 for k, r in enumerate(made)) < 200


def test_empty_tables(spark):
    docs, mixed = run(spark, corpus(1))
    assert mixing.taken(mixing.mix(docs.limit(0))).count() == 0
    blank = mixing.taken(mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "s")], "doc_id long, text string, source string")))
    assert [(r["size"], r["target"], r["taken"]) for r in blank.collect()] == [(0, 0.0, 0)] * 2
