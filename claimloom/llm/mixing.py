"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Documents of a source stand in a random order on a line of words, cut into blocks of `block` words. Positions come from range
   slices (operators.ordered), so a hot source is many tasks' work; texts are not moved.
2. A source's target is its weight's share of `share` times all words, but at most `most` times its own; what is cut off goes to
   the others by weight. That is the level L with sum(min(cap, L * weight)) = all: the largest of (all - caps of the k sources
   with the least cap / weight) / (weights of the others), found from running totals. A target makes an exact quota of block
   draws: whole passes over the source's blocks, then draws of different blocks, the last one cut to the word.
3. The splitting tree: a node holds the quotas of a range of output shards. It draws how many blocks of each source the left half
   gets, from the multivariate hypergeometric distribution (one conditional draw a source, by inversion outwards from the mode),
   and leaves the rest to the right half, down to single shards. Counts are exact at every node, shards differ by one draw at
   most, and nodes of a level are independent. Sources are drawn in pages of PAGE, page totals first.
4. A shard's draws of a source are consecutive places in the source's permutation of blocks (swap-or-not, a bijection without a
   table), so shards are disjoint within a pass. Draws meet the documents by (source, block), a fine key that no source
   makes hot. In its shard each draw gets a random place by a hash, which a window over the bounded shard numbers.

Everything random is a hash of the seed and of ids, so reruns agree however the rows are dealt. All steps are DataFrame functions.

Defined results: null texts have size 0 and are taken 0 times; a null source is a source of its own, the last in order; rows that
repeat another in id, source and text are documents of their own on the line; null ids take part; a source without words has
target 0; very long texts count and are cut at words; equal places are broken by id and digest; an empty table gives no rows;
other columns are ignored, whatever their names. Draws leave out what lies more than REACH standard deviations and 30 blocks from
the mode (a chance below 1e-15).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.columns import let, total
from claimloom.llm.linking import narrowed
from claimloom.operators.ordered import ordered_prefix
from claimloom.storage import materialize

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Words of a block and of an output shard.
BLOCK, SHARD_WORDS = 256, 1 << 20
SEED, ROUNDS, REACH, PAGE = 20_240_811, 24, 9, 256
#: Levels of the tree after which nodes are dealt to other tasks.
LEVELS = 3
BLANKS = " \t\n\x0b\x0c\r"
_WORD, _GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class Mix:
    """documents: no, pos, id, mark, source, size, source_size, target, one row a document. pieces: shard, place, draw, no, pos,
    id, mark, pass, block, begin, end, one row for each run of words of a document in a shard; words are numbered from 0, end is
    exclusive; pieces of one draw share its place and come in order of `begin_in_source`."""

    documents: DataFrame
    pieces: DataFrame


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII blanks."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    each = F.length(F.regexp_replace(text, f"{_GAP}*+{_WORD}++{_GAP}*+", "x"))
    return F.when(F.length(F.ltrim(text, F.lit(BLANKS))) == 0, 0).otherwise(each).cast("bigint")


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _unit(*key: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(1 << 53))


def hypergeometric(u: Column, good: Column, bad: Column, draws: Column) -> Column:
    """The number of good ones among `draws` without replacement, from u in [0, 1)."""
    as_double = lambda c: c.cast("double")

    def bounds(p: Column) -> Column:
        low = F.greatest(_long(0), p["m"] - p["bad"])
        high = F.least(p["m"], p["good"])
        n = as_double(p["good"] + p["bad"])
        middle = F.floor(as_double(p["m"] + 1) * as_double(p["good"] + 1) / (n + 2))
        some = F.greatest(n, F.lit(1.0))
        spread = F.sqrt(as_double(p["m"]) * as_double(p["good"]) / some * as_double(p["bad"]) / some * (n - p["m"]) / F.greatest(n - 1, F.lit(1.0)))
        return F.struct(p["u"].alias("u"), p["good"].alias("good"), p["bad"].alias("bad"), p["m"].alias("m"), low.alias("low"), high.alias("high"),
                        F.greatest(low, F.least(high, middle)).alias("mode"), (F.ceil(spread * REACH) + 30).alias("reach"))

    def weight(p: Column, x: Column, i: Column, up: bool) -> Column:
        """The chance of x as a multiple of that of its neighbour towards the mode."""
        here = F.when(i == 0, 1.0)
        if up:
            return here.otherwise(as_double(p["good"] - x + 1) * as_double(p["m"] - x + 1) / (as_double(x) * as_double(p["bad"] - p["m"] + x)))
        return here.otherwise(as_double(x + 1) * as_double(p["bad"] - p["m"] + x + 1) / (as_double(p["good"] - x) * as_double(p["m"] - x)))

    def walk(p: Column, start: Column, up: bool, step) -> Column:
        steps = F.sequence(_long(0), F.least(p["reach"], p["high"] - p["mode"] if up else p["mode"] - p["low"]))
        return F.aggregate(steps, start, lambda s, i: step(s, p["mode"] + i if up else p["mode"] - i, i, up))

    def answer(p: Column) -> Column:
        def add(s, x, i, up):
            return let(s["w"] * weight(p, x, i, up), lambda w: F.struct(w.alias("w"), (s["sum"] + F.when(i == 0, 0.0).otherwise(w)).alias("sum")))

        def find(s, x, i, up):
            own = lambda w: F.when(F.lit(False) if up else i == 0, 0.0).otherwise(w)
            hit = lambda w: F.when(s["x"].isNull() & (s["left"] < own(w)), x).otherwise(s["x"])
            return let(s["w"] * weight(p, x, i, up), lambda w: F.struct(w.alias("w"), (s["left"] - F.when(s["x"].isNull(), own(w)).otherwise(0.0)).alias("left"), hit(w).alias("x")))

        start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"))
        sums = let(walk(p, start, True, add), lambda s: walk(p, F.struct(F.lit(1.0).alias("w"), s["sum"].alias("sum")), False, add)["sum"])
        first = F.struct(F.lit(1.0).alias("w"), (p["u"] * sums).alias("left"), F.lit(None).cast("bigint").alias("x"))
        found = let(walk(p, first, True, find), lambda s: walk(p, F.struct(F.lit(1.0).alias("w"), s["left"].alias("left"), s["x"].alias("x")), False, find)["x"])
        return F.coalesce(found, p["mode"])

    given = F.struct(u.alias("u"), good.alias("good"), bad.alias("bad"), draws.alias("m"))
    return let(given, lambda g: let(bounds(g), lambda p: F.when(p["low"] >= p["high"], p["low"]).otherwise(answer(p))))


def _draws(counts: Column, draws: Column, *key: Column) -> Column:
    """How many of each kind are among `draws` from `counts` of each, without replacement."""

    def step(s: Column, i: Column) -> Column:
        own = F.get(counts, i)
        x = hypergeometric(_unit(*key, i), own, s["rest"] - own, s["left"])
        return let(x, lambda n: F.struct((s["left"] - n).alias("left"), (s["rest"] - own).alias("rest"), F.concat(s["out"], F.array(n)).alias("out")))

    start = F.struct(draws.alias("left"), total(counts, _long(0)).alias("rest"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(counts) - 1), start, step, lambda s: s["out"])


def _paged_draws(pages: Column, draws: Column, *key: Column) -> Column:
    sums = F.transform(pages, lambda page: total(page, _long(0)))
    return let(_draws(sums, draws, *key, F.lit(-1)), lambda n: F.transform(pages, lambda page, k: _draws(page, F.get(n, k), *key, k)))


def permuted(x: Column, n: Column, rounds: int, *key: Column) -> Column:
    """A bijection of 0 .. n - 1 by the swap-or-not shuffle."""

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        return let(other, lambda o: F.when(F.pmod(F.xxhash64(*key, r, F.greatest(at, o)), _long(2)) == 1, o).otherwise(at))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, step)


def sources(placed: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(no, source, source_size, target, full, blocks, draws, partial, tail, quota) of each source: `full` whole blocks and a
    shorter one make `blocks`; `draws` of them are made in whole passes, `partial` after that, the last cut to `tail` words."""
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    ranked = ordered_prefix(sizes, ["none", "source"]).withColumn("no", F.col("pos") - 1)
    weight = F.get(F.array(*[_long(w) for w in weights]), F.pmod("no", F.lit(len(weights))).cast("int"))
    ranked = ranked.select("no", "source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    ranked = materialize(ranked.withColumn("ratio", F.col("cap") / F.col("weight")), "ranked")
    sums = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, all_weights = share * (sums["words"] or 0), sums["weight"] or 1
    running = ordered_prefix(ranked, ["ratio", "no"], ["cap", "weight"])
    others = F.lit(all_weights) - F.col("cum_weight")
    level = running.where(others > 0).agg(F.max((F.lit(words) - F.col("cum_cap")) / others)).first()[0]
    level = max(words / all_weights, level or 0.0)
    facts = ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")))
    size, taken = F.col("source_size"), F.least(F.col("cap"), F.floor(F.col("target") + 0.5))
    some = F.greatest(size, _long(1))
    facts = facts.withColumns({"full": _div(size, _long(block)), "blocks": _div(size + (block - 1), _long(block)), "taken": taken, "rest": taken % some, "passes": _div(taken, some)})
    partial = _div(F.col("rest") + (block - 1), _long(block))
    facts = facts.withColumns({"draws": F.col("passes") * F.col("blocks"), "partial": partial, "tail": F.col("rest") - (partial - 1) * block})
    names = ["no", "source", "source_size", "target", "full", "blocks", "draws", "partial", "tail", "taken"]
    return materialize(facts.select(*names, (F.col("draws") + F.col("partial")).alias("quota")), "sources")


def split(facts: DataFrame, shards: int, draws: int, seed: int = SEED) -> DataFrame:
    """(shard, no, start, count): each shard's range of each source's draws, from the splitting tree over (no, quota)."""
    base, extra = divmod(draws, shards)
    held = F.transform(F.array_sort(F.collect_list(F.struct("no", "quota"))), lambda s: s["quota"])
    pages = F.transform(F.sequence(F.lit(0), _div(F.size("all") - 1, F.lit(PAGE)).cast("int")), lambda k: F.slice("all", k * PAGE + 1, PAGE))
    root = facts.agg(held.alias("all")).where(F.size("all") > 0).select(_long(0).alias("a"), _long(shards).alias("b"), pages.alias("quotas"))
    nodes = root.withColumn("starts", F.transform("quotas", lambda page: F.transform(page, lambda _: _long(0))))
    a, b, middle = F.col("a"), F.col("b"), F.floor((F.col("a") + F.col("b")) / 2)
    both = lambda x, y, f: F.zip_with(x, y, lambda p, q: F.zip_with(p, q, f))
    node = lambda a, b, quotas, starts: F.struct(a.alias("a"), b.alias("b"), quotas.alias("quotas"), starts.alias("starts"))
    room = (middle - a) * base + F.least(middle, _long(extra)) - F.least(a, _long(extra))
    left = _paged_draws(F.col("quotas"), room, F.lit(seed), a, b)
    quotas, starts = F.col("quotas"), F.col("starts")
    halves = let(left, lambda x: F.array(node(a, middle, x, starts), node(middle, b, both(quotas, x, lambda p, q: p - q), both(starts, x, lambda p, q: p + q))))
    most = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for depth in range((shards - 1).bit_length()):
        if depth and depth % LEVELS == 0:
            nodes = nodes.repartition(min(1 << depth, most), "a")
        nodes = nodes.select(F.explode(F.when(b - a > 1, halves).otherwise(F.array(node(a, b, quotas, starts)))).alias("n")).select("n.*")
    # shards make their draws in tasks of their own
    nodes = nodes.repartition(min(shards, most), "a")
    flat = nodes.select(a.alias("shard"), F.posexplode(F.arrays_zip(F.flatten(quotas).alias("count"), F.flatten(starts).alias("start"))).alias("no", "x"))
    return flat.select("shard", F.col("no").cast("bigint").alias("no"), "x.start", "x.count").where("count > 0")


def drawn_blocks(ranges: DataFrame, facts: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(shard, no, draw, pass, block, words): the blocks of each shard."""
    one = ranges.join(narrowed(facts.select("no", "full", "blocks", "draws", "partial", "tail", "source_size")), "no").select("*", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("draw"))
    one = one.withColumns({"pass": _div(F.col("draw"), F.col("blocks")), "nth": F.col("draw") % F.col("blocks")})
    at = F.when(F.col("nth") >= F.col("full"), F.col("nth")).otherwise(permuted(F.col("nth"), F.greatest("full", _long(1)), ROUNDS, F.lit(seed), F.col("no"), F.col("pass")))
    one = one.withColumn("block", at)
    cut = (F.col("draw") == F.col("draws") + F.col("partial") - 1) & (F.col("partial") > 0)
    words = F.when(cut, F.col("tail")).otherwise(F.least(_long(block), F.col("source_size") - F.col("block") * block))
    return one.select("shard", "no", "draw", "pass", "block", words.alias("words"))


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST,
    block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED,
) -> Mix:
    """Take `share` times all words, of each source in proportion to its weight; `weights` repeat over the sources in order of
    code points."""
    named = docs.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("mark"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    # stored, as range slices look at their input twice
    slim = materialize(named.withColumn("order", F.xxhash64(F.lit(seed), F.col("id").cast("string"), "mark")), "sizes")
    placed = materialize(ordered_prefix(slim, ["order", "id", "mark"], ["size"], ["source"]).drop("order"), "placed")
    facts = sources(placed, weights, share, most, block)
    sums = facts.agg(F.sum("quota"), F.sum("taken")).first()
    shards = max(1, -(-(sums[1] or 0) // shard_words))
    blocks = drawn_blocks(split(facts, shards, sums[0] or 0, seed), facts, block, seed)

    same = facts.select("no", F.col("source").alias("_s"), "source_size", "target")
    documents = placed.join(same, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    documents = documents.select("no", "pos", "id", "mark", "source", "size", F.col("cum_size").alias("stop"), "source_size", "target")
    start = F.col("stop") - F.col("size")
    over = documents.where("size > 0").select("no", "pos", "id", "mark", start.alias("start"), "stop", F.explode(F.sequence(_div(start, _long(block)), _div(F.col("stop") - 1, _long(block)))).alias("block"))
    # both sides grow with the data, and a generated side looks small: no broadcast
    met = over.hint("merge").join(blocks.hint("merge"), ["no", "block"])
    first = F.greatest("start", F.col("block") * block)
    last = F.least(F.col("stop"), F.col("block") * block + F.col("words"))
    pieces = met.select("shard", "draw", "no", "pos", "id", "mark", "pass", "block", (first - F.col("start")).alias("begin"), (last - F.col("start")).alias("end"), first.alias("begin_in_source")).where("begin < end")
    place = F.xxhash64(F.lit(seed), "shard", "no", "draw")
    pieces = pieces.withColumn("place", F.dense_rank().over(Window.partitionBy("shard").orderBy(place, "no", "draw")))
    return Mix(documents.drop("stop"), pieces)


def taken(mixed: Mix, id: str = "doc_id") -> DataFrame:
    """(id, size, source, source_size, target, taken): the words that the mix takes of each document, repeats counted."""
    sums = mixed.pieces.groupBy("no", "pos").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    joined = mixed.documents.join(sums, ["no", "pos"], "left")
    return joined.select(F.col("id").alias(id), "size", "source", "source_size", "target", F.coalesce("taken", _long(0)).alias("taken"))


def texts(mixed: Mix, docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(shard, place, doc_id, text): the mix itself, words joined by one space; sort a shard by place and `begin_in_source`."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    held = docs.select(F.col(id).alias("_id"), F.xxhash64(body).alias("_mark"), body.alias("_text")).dropDuplicates(["_id", "_mark"])
    words = F.filter(F.split("_text", f"{_GAP}+"), lambda w: w != "")
    joined = mixed.pieces.join(held, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    cut = F.array_join(F.slice(words, (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int")), " ")
    return joined.select("shard", "place", "begin_in_source", F.col("id").alias(id), cut.alias("text"))
