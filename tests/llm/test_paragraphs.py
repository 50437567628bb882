import random
import re

import numpy as np
import pytest

from claimloom.llm import arrays, paragraphs

WORD = re.compile("[^\x20\x09-\x0d]+")


def pieces(text):
    """(words, first character, end, first word) of each paragraph, piece by piece."""
    found = [(m[0], m.start(), m.end()) for m in WORD.finditer(text or "")]
    if not found:
        return []
    lower = [re.sub("[A-Z]", lambda x: x[0].lower(), w) for w, _, _ in found]
    joined = "".join(lower).encode()
    ends = np.cumsum([len(w.encode()) for w in lower])
    h = arrays.span_hashes(np.frombuffer(joined, np.uint8), np.append(0, ends[:-1]), ends).tolist()
    n = len(found)

    def stops(k):
        return bool(re.search("[.!?;:][\"')\\]}\u201d\u2019\u00bb\u203a]{0,3}$", found[k][0])) or k == n - 1 or "\n" in text[found[k][2] : found[k + 1][1]]

    cut, first = [], 0
    for k in range(n):
        if stops(k):
            cut.append((first, k))
            first = k + 1
    out = set()
    for i, (a, b) in enumerate(cut):
        if b - a + 1 >= paragraphs.MIN_WORDS:
            out.add((a, b))
            continue
        j = i
        while j + 1 < len(cut) and cut[j][1] - a + 1 < paragraphs.JOIN and cut[j + 1][1] - cut[j + 1][0] + 1 < paragraphs.MIN_WORDS:
            j += 1
        opens = i == 0 or cut[i - 1][1] - cut[i - 1][0] + 1 >= paragraphs.MIN_WORDS
        if cut[j][1] - a + 1 >= (paragraphs.MIN_WORDS if opens else paragraphs.JOIN):
            out.add((a, cut[j][1]))
    for a, b in cut:
        if b - a + 1 <= paragraphs.LONG:
            continue
        reach = paragraphs.AROUND
        inner = [k for k in range(a, b) if all(h[k] < x for x in h[max(0, k - reach) : k]) and all(h[k] <= x for x in h[k + 1 : k + 1 + reach])]
        for x, y in zip([a, *[k + 1 for k in inner]], [*inner, b], strict=True):
            if y - x + 1 >= paragraphs.MIN_WORDS:
                out.add((x, y))
    return [(lower[a : b + 1], found[a][1], found[b][2], a) for a, b in sorted(out, key=lambda p: (p[0], -p[1]))]


def brute(rows):
    """The reported paragraphs by comparing all pairs of paragraphs; rows with one id and text are numbered in order."""
    items = [(r, i, k, w, a, b, f, {tuple(w[j : j + 5]) for j in range(len(w) - 4)}) for r, (i, t) in enumerate(rows) for k, (w, a, b, f) in enumerate(pieces(t))]
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(items)):
        for y in range(x):
            a, b = items[x][7], items[y][7]
            if 5 * len(a & b) >= 4 * len(a | b):
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
    groups = {}
    for x in range(len(items)):
        groups.setdefault(find(x), []).append(x)
    origin = {x: min((items[y][1], items[y][2], items[y][0]) for y in g) for g in groups.values() if len(g) > 1 for x in g}
    out = []
    for r in range(len(rows)):
        run, covered, upto = [], set(), None
        for x in [*[x for x in range(len(items)) if items[x][0] == r and x in origin], None]:
            if x is None or upto is None or items[x][6] > upto + paragraphs.MIN_WORDS:
                if len(covered) >= paragraphs.PASSAGE_WORDS:
                    out += [(items[y][1], items[y][2], items[y][4], items[y][5], len(items[y][3]), *origin[y][:2], (r, items[y][2]) != (origin[y][2], origin[y][1])) for y in run]
                run, covered, upto = [], set(), None
            if x is not None:
                run.append(x)
                covered |= set(range(items[x][6], items[x][6] + len(items[x][3])))
                upto = max(covered)
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"wé{i}" for i in range(300)]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n)).capitalize() + rng.choice([".", "!", ".\n", ".\u201d", ";", '?")', " "])
    shared = [" ".join(sentence(rng.randrange(5, 30)) for _ in range(4)) for _ in range(5)]
    base = sentence(60)
    rows = []
    for k in range(90):
        parts = [sentence(rng.randrange(2, 25)) for _ in range(rng.randrange(1, 8))]
        if k % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), "it " + rng.choice(shared) + " and")
        if k % 4 == 0:
            words = base.split()
            words[rng.randrange(len(words) - 1)] = f"x{rng.randrange(2)}"
            parts.append(" ".join(words) + "\n")
        rows.append((k, " ".join(parts)))
    return [*rows, (200, None), (201, ""), (202, rows[5][1]), (203, "a" * 3000)]


def test_equals_all_pairs(spark):
    rows = corpus(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in paragraphs.repeated(docs).collect())
    assert got == brute(rows)


def test_dedup_and_edges(spark):
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen."
    docs = spark.createDataFrame([(1, f"Start here. {line}\nEnd", "k"), (2, f"Other text: begin.\n{line} Tail", None), (3, None, "x"), (None, "short", "y")], "doc_id long, text string, key string")
    got = {r["doc_id"]: r["text"] for r in paragraphs.dedup(docs).collect()}
    assert got == {1: f"Start here. {line}\nEnd", 2: "Other text: begin.\n Tail", 3: None, None: "short"}
    assert paragraphs.repeated(docs.limit(0)).count() == 0


def test_tune():
    assert paragraphs.tune(0.8, 0.99) == (3, 1)
    for rows in (1, 2, 3):
        bands, r = paragraphs.tune(0.5, 0.95, rows)
        assert 1 - (1 - 0.5**r) ** bands >= 0.95
    assert paragraphs.tune(0.8, 0.99, apart=0.3, chance=0.2) == (7, 3) and paragraphs.tune(0.8, 0.99, apart=0.3, chance=0.0) == (9, 4)


def planted(kind, seed):
    """A passage of 60 words: lines of five words, clauses, quoted sentences, or no stops at all."""
    rng = random.Random(seed)
    words = [f"{kind}{seed}w{rng.randrange(10**6)}" for _ in range(60)]
    step, end = {"verse": (5, "\n"), "clauses": (10, "; "), "quotes": (12, '." '), "running": (60, " "), "list": (3, ":\n")}[kind]
    return "".join(" ".join(words[k : k + step]) + end for k in range(0, 60, step))


@pytest.mark.parametrize("kind", ["verse", "clauses", "quotes", "running", "list"])
def test_planted_passages(spark, kind):
    """Passages of 60 words are found whatever stands around them, but for words next to their ends."""
    rng = random.Random(3)
    noise = lambda n: " ".join(f"n{rng.randrange(10**7)}" for _ in range(n))
    rows, spots = [], {}
    for k in range(12):
        passage = planted(kind, k)
        for copy in range(2):
            before = noise(rng.randrange(1, 30)) + (rng.choice([" ", "\n", ". "]))
            text = before + passage + noise(rng.randrange(1, 30))
            rows.append((2 * k + copy, text))
            spots[2 * k + copy] = (len(before), len(before) + len(passage.rstrip()))
    rows += [(100 + k, noise(80)) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in paragraphs.repeated(docs).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["begin"], r["end"]))
    assert set(found) == set(spots)
    for i, (a, b) in spots.items():
        # a paragraph at an end may be similar to its counterpart with some words of its surroundings
        slack = 0.25 * (b - a)
        assert min(found[i]) > a - slack and max(found[i]) < b + slack and len(found[i] & set(range(a, b))) > 0.5 * (b - a)


def test_repeated_rows_and_clashing_names(spark):
    ten = "alpha beta gamma delta epsilon zeta eta theta iota kappa."
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen."
    docs = spark.createDataFrame([(1, ten), (1, ten), (2, ten)], "doc_id long, text string")
    assert paragraphs.repeated(docs).count() == 0  # ten words are no passage, however often they occur
    rows = [(1, line), (1, line), (2, line), (2, f"{line} {line}")]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], "doc_id long, text string, same string, `key` string, copy string, cuts string")
    assert sorted(tuple(r) for r in paragraphs.repeated(docs).collect()) == brute(rows)
    got = paragraphs.dedup(docs)
    assert got.columns == docs.columns and sorted(r["text"] for r in got.collect()) == ["", "", " ", line]
    assert {tuple(r)[2:] for r in got.collect()} == {("a", "b", "c", "d")}
