"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows around each hit.

Lexicon. Learned from labelled texts: whole words, and stems (word beginnings of 4 to 6 characters) that stand for all their
endings, kept when a likelihood-ratio test ties them to toxic texts. Copies of a text count once, and a term counts in as
many texts as have it beside different words, so the words of one group of copies or near copies are not learned. The lexicon has as many
terms as pass; the sampled texts are its only bound. Whole words of at least FUZZY_LENGTH characters match
within one edit (a letter more, less or other, or two neighbours swapped), so misspelled forms are caught; other terms match
exactly. The learned words of a stem stay in the lexicon for their misspelled forms.

Matching. The trie of all terms is walked together with the Levenshtein automaton of each term; the sets of (trie node, edits)
reached are the states of one deterministic automaton, built once on the driver and broadcast. An automaton holds GROUP_TERMS
terms at most; a larger lexicon has several of them, each of bounded size, and a word's best match counts. Tasks run all words of
a block through a table at once; most words leave it after a few characters.

Context. For each hit the words around it decide its part: inside quotation marks or beside a verb of reporting it counts as
quoted, beside a second person as directed. A logistic model over counts of exact, misspelled, stem, quoted and directed hits,
their density and their densest window gives the score.

The lexicon and the model are fitted on at most SAMPLE_ROWS labelled rows, those with the smallest hash of their id; scoring
covers all rows and whole texts. Neither language, source nor id enters a score.

Defined results: null and empty texts have no hits and get the model's score for that; rows with a null label are not
learned from; of several labels for an id the largest counts; without labelled texts of both kinds every score is 0; other
columns of the texts are kept.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm import arrays
from claimloom.storage import materialize

#: Bound of the labelled rows that are learned from.
SAMPLE_ROWS = 20_000
#: Terms of one automaton.
GROUP_TERMS = 96
STEM_LENGTHS = (4, 5, 6)
#: Least likelihood-ratio statistic and least odds ratio of a term.
EVIDENCE, ODDS = 30.0, 10.0
#: Least number of toxic texts that have a term in different surroundings.
SUPPORT = 5
FUZZY_LENGTH = 5
#: Words on either side of a hit that make its context, and words in which the densest hits are counted.
CONTEXT, DENSE = 8, 50
FEATURES = ("any", "exact", "misspelled", "stem", "quoted", "directed", "kinds", "per_100", "dense", "long")
QUOTES = "\"“”„«»"
#: Verbs of reporting and second persons of the languages served: English, German, French, Spanish.
REPORTING = frozenset("said says called calls quoted quote wrote term word reported sagte nannte zitiert wort dit disait appelle mot dijo llama palabra cita".split())
SECOND_PERSON = frozenset("you your yours youre yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())
_TOP = 1 << 16
_WORD = np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(_TOP)])
_WORD[_TOP - 1] = True  # stands for all characters beyond the first plane


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool = False

    @property
    def edits(self) -> int:
        return int(not self.stem and len(self.text) >= FUZZY_LENGTH)


class Automaton:
    """The deterministic automaton of all words within the terms' edit distances.

    `table[state, character class]` is the next state, 0 the dead one. `word_term`, `word_edits` tell what a word that ends in
    a state matches (-1: nothing); `stem_term` tells which stem has been read when a state is reached. With `swaps`, two swapped
    neighbours are one edit.
    """

    def __init__(self, terms: Sequence[Term], swaps: bool = False):
        self.terms = list(terms)
        children: list[dict[str, int]] = [{}]
        ends: list[list[int]] = [[]]
        for number, term in enumerate(self.terms):
            node = 0
            for letter in term.text:
                if letter not in children[node]:
                    children[node][letter] = len(children)
                    children.append({})
                    ends.append([])
                node = children[node][letter]
            ends[node].append(number)
        allowed = [max((self.terms[k].edits for k in own), default=-1) for own in ends]
        for node in range(len(children) - 1, -1, -1):  # children come after their parents
            allowed[node] = max([allowed[node], *(allowed[c] for c in children[node].values())])
        letters = sorted({letter for term in self.terms for letter in term.text})
        self.classes = np.zeros(_TOP, np.int16)  # class 0: any other character
        for number, letter in enumerate(letters, 1):
            if ord(letter) < _TOP:
                self.classes[ord(letter)] = number

        # a place is a node of the trie, or (node, letter) when the letters before the node are swapped and one is to come
        Place = int | tuple[int, str]

        def closed(reached: dict[Place, int]) -> frozenset[tuple[Place, int]]:
            todo = [(place, edits) for place, edits in reached.items() if isinstance(place, int)]
            while todo:
                node, edits = todo.pop()
                for child in children[node].values():  # a letter of the term is missing in the word
                    if edits + 1 <= allowed[child] and edits + 1 < reached.get(child, 9):
                        reached[child] = edits + 1
                        todo.append((child, edits + 1))
            return frozenset(reached.items())

        def step(state: frozenset[tuple[Place, int]], letter: str | None) -> frozenset[tuple[Place, int]]:
            reached: dict[Place, int] = {}

            def offer(node: int, edits: int, due: str | None = None) -> None:
                place = node if due is None else (node, due)
                if edits <= allowed[node] and edits < reached.get(place, 9):
                    reached[place] = edits

            for node, edits in state:
                if not isinstance(node, int):
                    if node[1] == letter:
                        offer(node[0], edits)
                    continue
                for own, child in children[node].items():
                    if swaps and own != letter and letter in children[child]:
                        offer(children[child][letter], edits + 1, own)
                offer(node, edits + 1)  # a letter too many in the word
                for own, child in children[node].items():
                    offer(child, edits + (own != letter))
            return closed(reached)

        begin = closed({0: 0} if self.terms else {})
        numbers = {frozenset(): 0, begin: 1}
        order, rows = [frozenset(), begin], []
        for state in order:
            row = []
            for letter in [None, *letters]:
                following = step(state, letter)
                if following not in numbers:
                    numbers[following] = len(order)
                    order.append(following)
                row.append(numbers[following])
            rows.append(row)
        self.table = np.array(rows, np.int32).reshape(len(order), len(letters) + 1)
        self.word_term, self.word_edits, self.stem_term = (np.full(len(order), -1, np.int32) for _ in range(3))
        for number, state in enumerate(order):
            whole = [(edits, k) for node, edits in state if isinstance(node, int) for k in ends[node] if not self.terms[k].stem and edits <= self.terms[k].edits]
            if whole:
                self.word_edits[number], self.word_term[number] = min(whole)
            stems = [k for node, edits in state if isinstance(node, int) for k in ends[node] if self.terms[k].stem and edits == 0]
            if stems:
                self.stem_term[number] = min(stems)

    def match(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, terms, edits) of the words, given by positions in `codes`, that the automaton accepts."""
        if not self.terms:
            none = np.zeros(0, np.int64)
            return none, none, none
        kinds = self.classes[codes]
        words, at, state = np.arange(len(starts)), starts.copy(), np.ones(len(starts), np.int32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(words):
            state = self.table[state, kinds[at]]
            at = at + 1
            stem = self.stem_term[state] >= 0
            if stem.any():
                found.append((words[stem], self.stem_term[state[stem]], np.zeros(int(stem.sum()), np.int32)))
            over = (at == ends[words]) & ~stem
            whole = over & (self.word_term[state] >= 0)
            if whole.any():
                found.append((words[whole], self.word_term[state[whole]], self.word_edits[state[whole]]))
            on = ~stem & ~over & (state > 0)
            words, at, state = words[on], at[on], state[on]
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        hits, terms, edits = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(hits)
        return hits[order], terms[order], edits[order]


class Lexicon:
    """Automata of at most GROUP_TERMS terms each; of a word's matches a stem goes first, then the fewest edits."""

    def __init__(self, terms: Sequence[Term]):
        self.terms = list(terms)
        self.stems = np.array([t.stem for t in self.terms], bool)
        order = sorted(range(len(self.terms)), key=lambda k: self.terms[k].text)  # terms with a common beginning share states
        groups = [order[k : k + GROUP_TERMS] for k in range(0, len(order), GROUP_TERMS)]
        self.parts = [(np.array(g), Automaton([self.terms[k] for k in g], swaps=True)) for g in groups]

    def match(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As Automaton.match, over all terms."""
        none = np.zeros(0, np.int64)
        found = [(none, none, none)]
        for numbers, automaton in self.parts:
            hits, terms, edits = automaton.match(codes, starts, ends)
            found.append((hits, numbers[terms], edits))
        hits, terms, edits = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((terms, edits, ~self.stems[terms], hits))
        hits, terms, edits = hits[order], terms[order], edits[order]
        best = np.append(True, hits[1:] != hits[:-1])[: len(hits)]
        return hits[best], terms[best], edits[best]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts one after another, offsets); those beyond the first plane as its last code."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(joined, _TOP - 1), np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))


def _features(texts: list[str], automaton: Lexicon) -> np.ndarray:
    """A row of FEATURES for each lower-cased text."""
    out = np.zeros((len(texts), len(FEATURES)))
    codes, offsets = _codes(texts)
    starts, ends, owner = arrays.cut_words(codes, offsets, _WORD)
    n_words = np.bincount(owner, minlength=len(texts))
    out[:, FEATURES.index("long")] = np.log1p(n_words)
    hits, terms, edits = automaton.match(codes, starts, ends)
    rows = owner[hits]
    # quotation marks before each place; an odd number between the line's begin and a hit leaves it quoted
    marks = np.concatenate(([0], np.cumsum(np.isin(codes, [ord(mark) for mark in QUOTES]))))
    line_ends = np.flatnonzero(codes == 10) + 1
    lines = np.append(line_ends, 0)[np.searchsorted(line_ends, starts[hits], "right") - 1]
    opened = (marks[starts[hits]] - marks[np.maximum(lines, offsets[rows])]) % 2 == 1
    for row in np.unique(rows).tolist():
        own = np.flatnonzero(rows == row)
        text, shift = texts[row], int(offsets[row])
        first, last = np.searchsorted(owner, [row, row + 1])
        quoted = directed = exact = misspelled = stems = 0
        for k in own.tolist():
            hit = int(hits[k])
            low, high = max(first, hit - CONTEXT), min(last, hit + CONTEXT + 1)
            around = {text[starts[j] - shift : ends[j] - shift] for j in range(low, high) if j != hit}
            if opened[k] or around & REPORTING:
                quoted += 1
            if around & SECOND_PERSON:
                directed += 1
            if automaton.terms[terms[k]].stem:
                stems += 1
            elif edits[k]:
                misspelled += 1
            else:
                exact += 1
        places = hits[own]
        dense = int((np.searchsorted(places, places + DENSE) - np.arange(len(places))).max())
        per = min(100.0 * len(own) / max(1, n_words[row]), 25.0)
        out[row] = [1, math.log1p(exact), math.log1p(misspelled), math.log1p(stems), quoted / len(own), directed / len(own), math.log1p(len(set(terms[own].tolist()))), per, math.log1p(dense), out[row, -1]]
    return out


def _blocks(column: pa.Array, limit: int = 1 << 20):
    """The texts of a column in lists of about `limit` bytes; the column is not unpacked as a whole."""
    cuts, _ = arrays.column_bytes(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + limit, "right")) - 1)
        yield column.slice(at, end - at).to_pylist()
        at = end


def is_held_out(id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's text divides by 5."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of at most `rows` labelled documents outside the held-out fold, stored."""
    usable = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col(id))).groupBy(id).agg(F.max(label).alias("_label"))
    chosen = usable.orderBy(F.xxhash64(id), id).limit(rows)  # bounded by `rows`, so it may be broadcast
    found = docs.join(F.broadcast(chosen), id).select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"), F.col("_label").cast("int").alias("label"))
    return materialize(found, "toxicity_rows")


def _forms(word: str) -> list[str]:
    """The terms that a word counts for: itself and its stems, marked by a star."""
    return [word, *(word[:n] + "*" for n in STEM_LENGTHS if len(word) > n)] if 3 <= len(word) <= 24 else []


def _words(texts: list[str]):
    """The words of each text."""
    codes, offsets = _codes(texts)
    starts, ends, owner = arrays.cut_words(codes, offsets, _WORD)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    for row, text in enumerate(texts):
        own = slice(first[row], first[row + 1])
        yield [text[x:y] for x, y in zip((starts[own] - offsets[row]).tolist(), (ends[own] - offsets[row]).tolist(), strict=True)]


def _surroundings(texts: DataFrame, terms: Sequence[str]) -> dict[str, int]:
    """Of each term: in how many different surroundings the texts hold it. A text stands for the one pair of words beside the
    term that has the least hash, which near copies share."""
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches):
        for batch in batches:
            seen = set()
            for words in (words for block in _blocks(batch.column(0)) for words in _words(block)):
                least: dict[str, int] = {}
                for before, word, after in zip(["", *words[:-1]], words, [*words[1:], ""], strict=True):
                    held = [form for form in _forms(word) if form in shared.value]
                    pair = int.from_bytes(blake2b(f"{before} {after}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) if held else 0
                    least.update({form: min(pair, least.get(form, pair)) for form in held})
                seen |= set(least.items())
            names, pairs = [x for x, _ in seen], [x for _, x in seen]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pairs, pa.int64())], names=["term", "pair"])

    found = texts.select("text").mapInArrow(run, "term string, pair bigint")
    return dict(found.distinct().groupBy("term").count().collect())


def learn_lexicon(rows: DataFrame) -> list[Term]:
    """Words and stems tied to label 1, most frequent first."""
    rows = materialize(rows.groupBy("text").agg((F.max("label") == 1).cast("int").alias("label")), "toxicity_texts")
    totals = dict(rows.groupBy("label").count().collect())
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []

    def count(batches):
        for batch in batches:
            labels = iter(batch.column(1).to_pylist())
            for texts in _blocks(batch.column(0)):  # a tally a block: Spark adds them up
                tally: dict[int, Counter] = {0: Counter(), 1: Counter()}
                for words in _words(texts):
                    tally[next(labels)].update({form for word in set(words) for form in _forms(word)})
                names = list(tally[0].keys() | tally[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([tally[1][x] for x in names], pa.int64()), pa.array([tally[0][x] for x in names], pa.int64())], names=["term", "toxic", "clean"])

    counted = rows.mapInArrow(count, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    share = toxic / (toxic + clean)

    def tied(a: int, b: int) -> bool:
        if a < SUPPORT:
            return False
        evidence = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0.0))
        return evidence >= EVIDENCE and (a + 0.5) * (clean + 1) >= ODDS * (b + 0.5) * (toxic + 1)

    # the odds alone leave few terms; a sample of SAMPLE_ROWS texts bounds them
    a, b = F.col("a"), F.col("b")
    usual = counted.where((a >= SUPPORT) & ((a + 0.5) * (clean + 1) >= ODDS * (b + 0.5) * (toxic + 1))).collect()
    seen = {r["term"]: (r["a"], r["b"]) for r in usual if tied(r["a"], r["b"])}
    varied = _surroundings(rows.where("label = 1"), list(seen)) if seen else {}
    support = {x: min(a, varied.get(x, 0)) for x, (a, b) in seen.items() if tied(min(a, varied.get(x, 0)), b)}
    words = {x for x in support if not x.endswith("*")}
    stems = {x[:-1] for x in support if x.endswith("*")}
    # a stem that is little more than one of its words gives way to the word; a longer stem or word to a shorter stem
    stems = {x for x in stems if all(support[w] < 0.9 * support[x + "*"] for w in words if w.startswith(x))}
    shortest = {x for x in stems if not any(x[:n] in stems for n in STEM_LENGTHS if n < len(x))}
    # a stem's words that are too short for misspelled forms have nothing to add to it
    words = {w for w in words if len(w) >= FUZZY_LENGTH or not any(w[:n] in shortest for n in STEM_LENGTHS)}
    ranked = sorted([(-support[w], w, False) for w in words] + [(-support[s + "*"], s, True) for s in shortest])
    return [Term(text, stem) for _, text, stem in ranked]


@dataclass(frozen=True)
class Model:
    terms: tuple[Term, ...]
    weights: tuple[float, ...]
    intercept: float


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE_ROWS) -> Model:
    """Lexicon and weights from the labelled rows outside the held-out fold."""
    rows = training_rows(docs, labels, id, text, label, sample)
    terms = learn_lexicon(rows)
    if not terms:
        return Model((), (0.0,) * len(FEATURES), -math.inf)
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon(terms))

    def run(batches):
        for batch in batches:
            labels_ = batch.column(1).to_pylist()
            made = [row for texts in _blocks(batch.column(0)) for row in _features(texts, shared.value).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(labels_, pa.float64()), pa.array(made, pa.list_(pa.float64()))], names=["label", "values"])

    table = materialize(rows.mapInArrow(run, "label double, values array<double>"), "toxicity_features")
    # hits never speak for a text; only their context and the text's length may
    free = {"quoted", "directed", "long"}
    least = DenseMatrix(1, len(FEATURES), [-1e6 if name in free else 0.0 for name in FEATURES])
    model = LogisticRegression(maxIter=60, regParam=1e-3, tol=1e-5, lowerBoundsOnCoefficients=least).fit(table.select((F.col("label") == 1).cast("double").alias("label"), array_to_vector("values").alias("features")))
    return Model(tuple(terms), tuple(model.coefficients.toArray().tolist()), float(model.intercept))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a column `out`: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast((Lexicon(model.terms), np.array(model.weights), model.intercept))

    def run(batches):
        automaton, weights, intercept = shared.value
        for batch in batches:
            scores = []
            for texts in _blocks(batch.column(batch.num_columns - 1)):
                z = _features(texts, automaton) @ weights + intercept
                scores += (1 / (1 + np.exp(-np.clip(z, -700, 700)))).tolist() if intercept > -math.inf else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], out])

    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out])
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [f"`{out}` double"])
    return docs.select(*[F.col(f"`{c}`") for c in kept.columns], F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_lowered")).mapInArrow(arrays.trimmed(run), fields)
