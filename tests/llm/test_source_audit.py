import random
import re
from collections import Counter

import numpy as np
import pytest

from claimloom.llm import source_audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=10, top=10):
    docs = [(lang or "", source or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        found = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in found.items() if n >= least]
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in own}}

        def shares(counter, kept=kept):
            below = sum(counter.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (counter[t] + 2) // below for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abÄö漢zQ", k=rng.choice([1, 2, 3, 5, 9, 17, 40]))) for _ in range(90)]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = []
    for i in range(160):
        text = rng.choice([" ", "1", ", "]).join(rng.choices(words, weights, k=rng.randrange(0, 40)))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "é", "s2", None, "s10"])))
    long_ = "ü" * 3_000
    rows += [(200 + k, long_ + f" {long_}x" + " tail" * k, "en", "s1") for k in range(12)]
    rows += [(300, None, "xx", "s1"), (301, "", "xx", "s2"), (302, "one", "yy", None)] + [rows[5]] * 12
    return rows


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    return sorted(tuple(r) for r in source_audit.audit(docs, **options).collect())


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"least": 3, "first": 1}), (3, {"least": 2, "bits": 1 << 16, "tile": 2, "top": 4}), (4, {"least": 3, "bits": 1, "first": 2})])
def test_equals_brute_force(spark, monkeypatch, seed, options):
    monkeypatch.setattr(source_audit, "ELEMENTS", 64)
    rows = corpus(seed)
    want = brute(rows, options.get("least", 10), options.get("top", 10))
    assert found(spark, rows, **options) == want and any(r[2] == "term" and len(r[3]) >= 3_000 for r in want)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    """One word of bits for all prefixes: everything passes the bitmap, the counts alone decide."""
    monkeypatch.setattr(source_audit, "_inside", lambda bitmap, keys: np.ones(len(keys), bool))
    docs = spark.createDataFrame(corpus(5), "doc_id long, text string, lang string, source string")
    assert source_audit.kept_terms(docs).count() > 0
    bitmap = np.array([0b10, 0, 0, 0b10000000], np.uint8)
    monkeypatch.undo()
    keys = np.array([1 << 59, 2 << 59, 31 << 59, (1 << 59) + 5], np.uint64)
    assert source_audit._inside(bitmap, keys).tolist() == [True, False, True, True]


def test_prefixes_are_discarded(spark):
    """Terms that share a frequent prefix but are rare themselves reach no later level than the one that tells them apart."""
    rows = [(i, f"common prefixed{'abcdefghijklmnopqrst'[i]}", "en", "s") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert [tuple(r) for r in source_audit.kept_terms(docs).collect()] == [("en", "s", "common", 20, 20)]


def test_empty_and_other_columns(spark):
    docs = spark.createDataFrame(corpus(4), "doc_id long, text string, lang string, source string")
    assert source_audit.audit(docs.limit(0)).count() == 0
    wide = docs.selectExpr("*", "1 AS key", "'x' AS term", "2 AS `count`", "3 AS place", "lang AS seed")
    assert sorted(map(tuple, source_audit.audit(wide).collect())) == brute(corpus(4))
