"""Secret scans: fixed formats, and a battery of randomness tests with length-aware control of false discoveries.

Fixed formats (kinds `assign`, `access`, `hex`) are found by pattern and always kept. The method adds `random` spans:

1. Candidates are maximal runs of 20 or more characters of the base-64 alphabets that no fixed format overlaps.
2. The encoding is inferred from the characters used: hex, base 32, letters of one case, letters and digits of one case, base 64.
3. Three tests ask whether the run could be random in that alphabet: chi-squared uniformity of the characters, runs above and
   below the alphabet's middle, and lag-one serial correlation. A run stays when the least p-value, times three, is at least
   ALPHA.
4. Its chi-squared statistic is then set against ordinary text of the same length and alphabet (a non-central chi-squared law,
   whose centre grows with the length), which gives the p-value of a discovery. The Benjamini-Hochberg rule is applied within
   each class of encoding and length (powers of two), over the candidates of all documents, at rate FALSE_DISCOVERIES.

DataFrame functions only; candidates stay inside their document's row. For step 4 the p-values are counted on a fixed
logarithmic grid, at most GRID rows for each class, and the thresholds (one per class) become a literal map.

Defined results: null and empty texts have no spans; repeated rows are judged alike and each counts as a candidate; other
columns are kept. Places are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.columns import let, total, unused
from claimloom.storage import materialize

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LENGTH = 6
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
ALPHA, FALSE_DISCOVERIES = 0.01, 0.01
#: Steps of the p-value grid and their number to a power of ten.
GRID, GRID_STEPS = 400, 10
_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings: name, what all characters must match, the alphabet, and the chance that two characters of ordinary text agree
#: (letters: of a written language; digits: of numbers).
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef", 0.1),
    ("base32", r"^(?=.*[2-7])[A-Z2-7]+=*$", _UP + "234567", 0.0667),
    ("letters", r"^([a-z]+|[A-Z]+)$", _LOW, 0.0667),
    ("alnum", r"^([a-z0-9]+|[A-Z0-9]+)$", _LOW + _DIGITS, 0.0667),
    ("base64", r"^", _UP + _LOW + _DIGITS + "+/", 0.0667),
)
SPAN = "array<struct<start: int, rank: int, end: int>>"


def places(text: Column, pattern: str) -> Column:
    """Start and end of each leftmost match of `pattern`, from the lengths of the matches and of what lies between them."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("out"))
    walked = F.aggregate(
        steps,
        start,
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["hit"]).alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["hit"]).alias("end"))).alias("out"),
        ),
    )
    return walked["out"]


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Sorted spans of the fixed formats."""
    none = F.expr(f"cast(array() as {SPAN})")
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LENGTH)
    assigned = F.zip_with(places(text, ASSIGN), long_enough, lambda s, ok: F.struct(s["start"].alias("start"), F.lit(0).alias("rank"), s["end"].alias("end"), ok.alias("ok")))
    assigned = F.transform(F.filter(assigned, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return F.array_sort(
        F.concat(
            F.when(text.rlike(r"(?i)password|passwd|secret|token|api_?key"), assigned).otherwise(none),
            F.when(text.contains("AKIA"), _ranked(places(text, ACCESS), 1)).otherwise(none),
            F.when(text.rlike("[0-9a-f]{24}"), _ranked(places(text, HEX), 2)).otherwise(none),
        )
    )


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of the standard normal law, within about one per cent in either tail."""
    x = F.abs(z)
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) / ((1 - 1 / math.pi) * x + F.sqrt(x * x + 2 * math.pi) / math.pi)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _battery(token: Column, name: str, alphabet: str, coincidence: float) -> Column:
    """p_random, the least p-value of the three tests, and p_text, the p-value against ordinary text."""
    k = len(alphabet)
    one_case = F.translate(token, "=", "")
    one_case = F.translate(one_case, "-_", "+/") if name == "base64" else F.upper(one_case) if name == "base32" else F.lower(one_case)

    def of(t: Column) -> Column:
        n = F.length(t).cast("double")
        squares = total(F.transform(F.split(F.lit(alphabet), ""), lambda c: F.when(c != "", F.pow((n - F.length(F.replace(t, c, F.lit("")))).cast("double"), 2)).otherwise(0.0)), F.lit(0.0))
        chi = let(squares, lambda s: s * k / n - n)
        # uniformity: the cube root of chi-squared over its degrees is nearly normal
        f = 2 / (9 * (k - 1))
        uniform = lambda x: upper_tail((F.pow(F.greatest(x, F.lit(1e-9)) / (k - 1), 1 / 3) - (1 - f)) / math.sqrt(f))
        halves = F.regexp_replace(t, f"[{_escaped(alphabet[: k // 2])}]", "\u0001")
        low = n - F.length(F.replace(halves, F.lit("\u0001"), F.lit("")))
        n_runs = F.length(F.regexp_replace(halves, "\u0001+|[^\u0001]+", ".")).cast("double")
        both = 2 * low * (n - low)
        spread = both * (both - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, 2 * upper_tail(F.abs((n_runs - both / n - 1) / F.sqrt(spread)))).otherwise(0.0)
        index = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))

        def serial(x: Column) -> Column:
            mean = total(x, F.lit(0.0)) / n
            centred = let(mean, lambda m: F.transform(x, lambda v: v - m))

            def r(c: Column) -> Column:
                squared = total(F.transform(c, lambda v: v * v), F.lit(0.0))
                crossed = total(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: a * b), F.lit(0.0))
                return F.when(squared > 0, 2 * upper_tail(F.abs((crossed / squared + 1 / n) * F.sqrt(n)))).otherwise(0.0)

            return let(centred, r)

        # ordinary text: a non-central law, nearly normal
        shift = n * (k * coincidence - 1)
        ordinary = lambda x: upper_tail(-(x - (k - 1) - shift) / F.sqrt(2 * ((k - 1) + 2 * shift)))
        return let(chi, lambda x: F.struct(F.least(uniform(x), runs, let(index, serial)).alias("p_random"), ordinary(x).alias("p_text")))

    return let(one_case, of)


def _escaped(characters: str) -> str:
    return "".join("\\" + c if c in "+/-\\]^[" else c for c in characters)


def _tested(text: Column, base: Column) -> Column:
    """Candidates outside the base spans with their class and grid step; those that fail as random have step -1 and count
    among the trials."""

    def judge(token: Column) -> Column:
        out = F.lit(None)
        for number, (name, form, alphabet, coincidence) in reversed(list(enumerate(ENCODINGS))):
            made = _with_class(_battery(token, name, alphabet, coincidence), number, token)
            out = made if name == ENCODINGS[-1][0] else F.when(token.rlike(form), made).otherwise(out)
        return out

    tokens = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    both = F.arrays_zip(places(text, CANDIDATE).alias("place"), tokens.alias("token"))
    free = F.filter(both, lambda c: ~F.exists(base, lambda b: (b["start"] < c["place"]["end"]) & (c["place"]["start"] < b["end"])))
    judged = F.transform(free, lambda c: F.struct(c["place"]["start"].alias("start"), c["place"]["end"].alias("end"), judge(c["token"]).alias("test")))
    return judged


def _with_class(battery: Column, number: int, token: Column) -> Column:
    """class: encoding and length class; step: the p-value against ordinary text on the grid, rounded up, -1 if not random."""
    size = F.floor(F.log2(F.length(token).cast("double"))).cast("int")

    def of(p: Column) -> Column:
        step = F.least(F.floor(-F.log10(F.greatest(p["p_text"], F.lit(1e-300))) * GRID_STEPS), F.lit(GRID - 1)).cast("int")
        return F.struct((F.lit(number * 100) + size).alias("class"), F.when(p["p_random"] * 3 >= ALPHA, F.greatest(step, F.lit(0))).otherwise(-1).alias("step"))

    return let(battery, of)


def _thresholds(found: DataFrame, tested: str, rate: float) -> dict[int, int]:
    """For each class the least grid step whose discoveries keep the false-discovery rate; at most one entry a class."""
    counts = found.select(F.explode(F.col(tested)["test"]).alias("t")).groupBy("t.class", "t.step").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("class").orderBy(F.desc("step"))
    everything = Window.partitionBy("class")
    ranked = counts.withColumns({"upto": F.sum("n").over(down), "m": F.sum("n").over(everything)})
    fit = ranked.where((F.col("step") >= 0) & (F.pow(F.lit(10.0), -F.col("step") / GRID_STEPS) * F.col("m") <= rate * F.col("upto")))
    return {r["class"]: r["step"] for r in fit.groupBy("class").agg(F.min("step").alias("step")).collect()}


def scan(docs: DataFrame, text: str = "text", rate: float = FALSE_DISCOVERIES, keep_text: bool = False, name: str = "secrets") -> DataFrame:
    """`docs`, without its text unless asked for, with `base` and `spans`: sorted arrays of (start, rank in KINDS, end)."""
    body = F.coalesce(F.col(text), F.lit(""))
    first = docs.withColumn("base", base_spans(body))
    none = F.expr("cast(array() as array<struct<start: int, end: int, test: struct<class: int, step: int>>>)")
    tested = F.when(body.rlike("[A-Za-z0-9+/_-]{20}"), _tested(body, F.col("base"))).otherwise(none)
    (name_of_tested,) = unused(docs, "tested")
    first = first.withColumn(name_of_tested, tested)
    found = materialize(first if keep_text else first.drop(text), name)
    limits = _thresholds(found, name_of_tested, rate)
    limit = lambda c: F.lit(GRID)
    if limits:
        table = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
        limit = lambda c: F.coalesce(F.try_element_at(table, c), F.lit(GRID))
    added = F.filter(name_of_tested, lambda c: c["test"]["step"] >= limit(c["test"]["class"]))
    return found.withColumn("spans", F.array_sort(F.concat("base", _ranked(added, 3)))).drop(name_of_tested)


def joined(spans: Column) -> Column:
    """`kind:start:end` of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """`text` with each run of overlapping spans replaced by `mask`; spans are sorted by start."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(before, F.lit(mask)))).otherwise(acc["out"]).alias("out"))

    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, done)).otherwise(text)
