"""Quality rules by distribution divergence.

Every document gets two histograms: characters by class, and words by its language's list of common words (all other words
are one class). They are compared with the language's reference by Jensen-Shannon distance. The references are the summed
histograms of all documents of the language that pass the base rules and the length guard. A document diverges when one of its
distances is over the limit; the limit allows for the sampling noise of short texts, and below the minimum length there is no
verdict.

Base rules: a document fails with fewer than MIN_WORDS words, or when over a fifth of its words lie in 5-word windows that
occur twice or more in it.

DataFrame functions only. The per-document counts are made in one pass over the texts and stored; the references are a few
rows, one per language list.

Defined results: a null text has no words and fails; null or unlisted languages have no reference and are judged by the base
rules alone, as is a language none of whose documents passes; repeated rows are judged alike and all count in the reference;
other columns are kept. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.columns import let, total, unused
from claimloom.storage import materialize

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Length guards: no verdict on the character histogram below GUARD_CHARS, on the word histogram below GUARD_WORDS.
GUARD_CHARS, GUARD_WORDS = 200, 60
#: Limits of the Jensen-Shannon distances (base 2, from 0 to 1), and the weight of the allowance for short texts: 1 allows what
#: sampling adds on average.
CHAR_LIMIT, WORD_LIMIT, NOISE = 0.25, 0.31, 1.0
#: Character classes; what is left are other ASCII characters, then all beyond ASCII.
CLASSES = ("a-z", "A-Z", "0-9", r"\x20\x09-\x0D", r".,;:!?'\"()\-")
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are as with be this by from at or an which not have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más o pero".split(),
}


def _count(text: Column, outside: str) -> Column:
    """Characters of `text` that are left when runs of `outside` are removed."""
    return F.length(F.regexp_replace(text, outside, "")).cast("bigint")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of `size` words found twice or more in `words`."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(places, k + 1) - p, F.lit(size))))
        return total(steps, F.lit(0)).cast("bigint")

    def several(pairs: Column) -> Column:
        """Sorted places of the hashes that are next to an equal one in the sorted pairs."""
        same = lambda e, k: F.coalesce(F.get(pairs, k)["h"] == e["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(pairs, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["at"]))

    def of_windows(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(let(pairs, several), covered)).otherwise(F.lit(0).cast("bigint"))

    def of_hashes(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - size)
        windows = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
        return F.when(F.size(hashes) >= size, let(windows, of_windows)).otherwise(F.lit(0).cast("bigint"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def _word_counts(words: Column, language: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """Counts of the language's common words in list order, then of all other words; null for an unlisted language."""

    def own(common: Sequence[str]) -> Column:
        found = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(*common))
        each = F.array(*[F.lit(x) for x in common])
        counts = lambda f: F.transform(each, lambda v: F.size(F.filter(f, lambda x: x == v)).cast("bigint"))
        return let(found, lambda f: F.concat(counts(f), F.array((F.size(words) - F.size(f)).cast("bigint"))))

    out = F.lit(None).cast("array<bigint>")
    for name, common in lists.items():
        out = F.when(language == name, own(common)).otherwise(out)
    return out


def measures(docs: DataFrame, text: str = "text", lang: str = "lang", lists: Mapping[str, Sequence[str]] = COMMON_WORDS) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and both histograms."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    facts = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words"), _word_counts(w, F.col(lang), lists).alias("word_counts")))
    inner_facts, inner_classes = unused(docs, "facts", "classes")
    classes = [_count(body, f"[^{c}]+") for c in CLASSES]
    ascii_ = _count(body, r"[^\x00-\x7F]+")
    made = docs.withColumns(
        {
            inner_facts: facts,
            "word_chars": _count(body, BLANKS),
            "n_symbols": _count(body, r"[^#*$%&|<>]+"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
            inner_classes: F.array(*classes, ascii_, F.length(body).cast("bigint")),
        }
    )
    inner = F.slice(inner_classes, 1, len(CLASSES))
    parts = F.concat(inner, F.array(F.get(inner_classes, F.lit(len(CLASSES))) - total(inner, F.lit(0).cast("bigint")), F.get(inner_classes, F.lit(len(CLASSES) + 1)) - F.get(inner_classes, F.lit(len(CLASSES)))))
    made = made.withColumns({"n_words": F.col(f"{inner_facts}.n_words"), "n_repeat_words": F.col(f"{inner_facts}.n_repeat_words"), "word_counts": F.col(f"{inner_facts}.word_counts"), "char_counts": parts})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return made.withColumn("base_failed", failed).drop(inner_facts, inner_classes)


def references(measured: DataFrame, lang: str = "lang", lists: Mapping[str, Sequence[str]] = COMMON_WORDS) -> DataFrame:
    """One row per listed language: the summed histograms of its documents that pass the base rules and the guards."""
    longest = max(map(len, lists.values())) + 1
    n_classes = len(CLASSES) + 2
    sound = measured.where(F.col(lang).isin(*lists) & ~F.col("base_failed") & (F.col("n_words") >= GUARD_WORDS))
    sums = sound.groupBy(F.col(lang).alias("_lang")).agg(
        F.array(*[F.sum(F.get("char_counts", F.lit(k))) for k in range(n_classes)]).alias("char_reference"),
        F.array_compact(F.array(*[F.sum(F.get("word_counts", F.lit(k))) for k in range(longest)])).alias("word_reference"),
    )
    return sums


def divergence(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two count arrays; null when one is null or empty."""

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def of(a: Column, b: Column) -> Column:
        shares = F.zip_with(F.transform(counts, lambda x: x / a), F.transform(reference, lambda x: x / b), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
        return F.sqrt(F.greatest(total(shares, F.lit(0.0)) / 2, F.lit(0.0)))

    sums = F.struct(total(counts, F.lit(0).cast("bigint")).alias("a"), total(reference, F.lit(0).cast("bigint")).alias("b"))
    return let(sums, lambda s: F.when((s["a"] > 0) & (s["b"] > 0), of(s["a"], s["b"])))


def _over(distance: Column, limit: float, classes: int, n: Column) -> Column:
    """Whether the distance is over the limit widened by what sampling `n` items of so many classes adds."""
    return F.coalesce(distance > F.sqrt(F.lit(limit * limit) + NOISE * classes / (8 * F.log(F.lit(2.0)) * n)), F.lit(False))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", lists: Mapping[str, Sequence[str]] = COMMON_WORDS, name: str = "quality") -> DataFrame:
    """`docs` without its text, with the measures, both distances (`char_distance`, `word_distance`) and `kept`."""
    measured = materialize(measures(docs, text, lang, lists).drop(text), name)
    of, char_reference, word_reference = unused(measured, "of", "char_reference", "word_reference")
    known = references(measured, lang, lists).select(F.col("_lang").alias(of), F.col("char_reference").alias(char_reference), F.col("word_reference").alias(word_reference))
    joined = measured.join(F.broadcast(known), F.col(lang) == F.col(of), "left").drop(of)  # a row per listed language
    chars = F.col("word_chars")
    out = joined.withColumns({"char_distance": divergence(F.col("char_counts"), F.col(char_reference)), "word_distance": divergence(F.col("word_counts"), F.col(word_reference))})
    odd_chars = (chars >= GUARD_CHARS) & _over(F.col("char_distance"), CHAR_LIMIT, len(CLASSES) + 2, chars)
    odd_words = (F.col("n_words") >= GUARD_WORDS) & _over(F.col("word_distance"), WORD_LIMIT, 26, F.col("n_words"))
    diverges = F.coalesce(odd_chars, F.lit(False)) | F.coalesce(odd_words, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~diverges).drop(char_reference, word_reference)
