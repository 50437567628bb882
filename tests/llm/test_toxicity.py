import random

from claimloom.llm import toxicity


def made(rng, n, letters="etaoinshrdlu"):
    out = set()
    while len(out) < n:
        out.add("".join(rng.choices(letters, k=rng.randrange(6, 10))))
    return sorted(out)


def test_lexicon_of_many_rare_terms(spark):
    """150 terms, each in 15 of 600 toxic texts (2.5 %), and one toxic text in 60 copies and 60 near copies."""
    rng = random.Random(8)
    plain, rude = made(rng, 300), made(rng, 150, "bcfgjkmpqvwxyz")
    texts = [rng.choices(plain, k=rng.randrange(20, 60)) for _ in range(3_000)]
    for term in rude:
        for k in rng.sample(range(600), 15):
            texts[k].insert(rng.randrange(len(texts[k]) + 1), term)
    rows = [(" ".join(words), int(k < 600)) for k, words in enumerate(texts)]
    copied = made(rng, 20, "äöüßéèêç")
    for k in range(60):
        rows += [(" ".join(copied), 1), (" ".join([*copied, "the", f"tail{k}"]), 1)]
    terms = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    learned = {t.text for t in terms if not t.stem}
    assert len(learned & set(rude)) == 150 and not any(w.startswith(t.text) for t in terms for w in copied)


def test_automata_of_a_large_lexicon():
    rng = random.Random(9)
    terms = [toxicity.Term(w) for w in made(rng, 230)]
    lexicon = toxicity.Lexicon(terms)
    assert len(lexicon.parts) == 3
    words = [w[:3] + "q" + w[3:] if k % 2 else w for k, w in enumerate(t.text for t in terms)]
    codes, offsets = toxicity._codes(words)
    hits, found, edits = lexicon.match(codes, offsets[:-1], offsets[1:])
    assert hits.tolist() == found.tolist() == list(range(230)) and edits.tolist() == [k % 2 for k in range(230)]


def distance(a, b):
    """Edits from a to b, two swapped neighbours being one."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_swapped_letters_are_one_edit():
    rng = random.Random(3)
    terms = [toxicity.Term(w) for w in ("idiot", "idiots", "trash", "ärsche", "ugly")]
    lexicon = toxicity.Lexicon(terms)
    words = ["idoit", "diiot", "idito", "idiost", "trahs"]
    for _ in range(3_000):
        word = list(rng.choice(terms).text)
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(word))
            if rng.random() < 0.5:
                word[at : at + 2] = word[at : at + 2][::-1]
            else:
                word[at : at + 1] = rng.choice(["", "x", "i", "xt"])
        words.append("".join(word) or "q")
    codes, offsets = toxicity._codes(words)
    hits, _, edits = lexicon.match(codes, offsets[:-1], offsets[1:])
    got = dict(zip(hits.tolist(), edits.tolist(), strict=True))
    for k, word in enumerate(words):
        assert got.get(k) == min((e for t in terms if (e := distance(word, t.text)) <= t.edits), default=None), word


def test_quotation_on_long_lines():
    lexicon = toxicity.Lexicon([toxicity.Term("idiot")])
    far = "plain " * 500
    texts = [f'"{far}idiot" x', f'"a" {far}idiot', f'"\n{far}idiot', f'"open', f'{far}"x" idiot "y idiot']
    quoted = toxicity._features(texts, lexicon)[:, toxicity.FEATURES.index("quoted")]
    assert quoted.tolist() == [1, 0, 0, 0, 0.5]


def test_misspelled_texts_score_high(spark):
    """Inflections share a stem; misspelled words of it and swapped letters still count."""
    rng = random.Random(6)
    plain = made(rng, 300)
    docs, labels = [], []
    for k in range(600):
        words = rng.choices(plain, k=rng.randrange(10, 200))
        for _ in range(4 * (k % 3 == 0)):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "idiots", "idiotic", "moron", "scumbag"]))
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 3 == 0)))
    docs += [(1_000, "you ldiot and id1ots and ldiotic"), (1_001, "you diiot and mroon and scubmag"), (1_002, "you are plain and good")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(t.stem and "idiot".startswith(t.text) for t in model.terms)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table.where("doc_id >= 1000"), model).collect()}
    assert got[1_000] >= 0.5 and got[1_001] >= 0.5 and got[1_002] < 0.5
