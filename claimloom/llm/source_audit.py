"""Source divergence audit: how far the sources of a language differ in their use of terms, and which terms they overuse.

Terms are maximal runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms that occur in at
least `least` of its documents. They are found by iceberg prefix refinement over the terms' UTF-8 bytes:

1. Level by level, prefixes of FIRST, 2 * FIRST, 4 * FIRST ... bytes are counted by distinct documents of the language. A text is
   in one task as a whole, so its prefixes are made distinct there, and counts add up with map-side combine. A level looks at the
   terms whose prefix passed the level before; no other term is read further, and rare terms are never shuffled in full length.
2. A prefix that is found in too few documents is discarded. A term that ends within a level's length is complete; the longer
   ones go on. When no prefix is left, one pass counts the complete terms that passed, by language, source and text.
3. Levels count 64-bit hashes of (language, prefix). A collision can only keep a prefix too many: the last pass counts texts.

Survivors of a level reach the next scan as a bitmap of their hashes' leading bits, 32 bits for each but at most BITS in all, so
its size is bounded whatever the data. Where it is full, prefixes that it keeps by chance cost a count and are discarded then: a
longer prefix is in no more documents than a shorter one. The divergences come from one dense row of shares per kept term: sums
over terms are made in the tasks, in tiles of TILE x TILE sources, so no pair of sources is emitted for a term.

All arithmetic is on integers: a share is p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)) with N the group's occurrences of kept
terms and V the number of kept terms, a divergence is floor((p - q)^2 / (p + q)).

Defined results: null text, language and source count as empty strings, which are a language and a source like others; empty
texts have no terms, but their groups occur; repeated rows are documents of their own; a language without kept terms has
divergence 0 between all its sources and no overused terms; equal values are ranked by the item's UTF-8 bytes; very long texts
and terms are read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm import arrays
from claimloom.storage import materialize

LEAST, TOP = 10, 10
#: Bytes of the first level's prefixes.
FIRST = 8
#: Bits of the bitmap of survivors that travels to every task, at most (16 MB), and at least.
BITS, LEAST_BITS = 1 << 27, 1 << 16
#: Bits in a row of the bitmap while Spark makes it.
ROW_BITS = 1 << 15
#: Documents whose names are broadcast to the last scan; beyond that they are joined by shuffle.
BROADCAST_LISTS = 200_000
#: Sources of a tile, and elements of a block of (terms x sources x sources).
TILE, ELEMENTS = 256, 1 << 20
TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True
_COMPLETE = np.uint64(0x9E3779B97F4A7C15)


def _inputs(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    clean = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))]
    keys = [F.xxhash64("lang").alias("seed"), F.xxhash64("lang", "source").alias("group"), F.xxhash64("text", "lang").alias("at")]
    return docs.select(*clean).select("text", *keys, "lang", "source")


def _hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray, complete) -> np.ndarray:
    return arrays.mix((arrays.span_hashes(lowered, starts, ends) ^ seeds) + np.where(complete, _COMPLETE, np.uint64(0)))


def _inside(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - (8 * len(bitmap)).bit_length() + 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bitmap(keys: DataFrame, most: int):
    """A broadcast bitmap of the leading bits of the keys (one column, key), made in rows of ROW_BITS bits."""
    bits = LEAST_BITS
    n = keys.count()
    while bits < min(most, 32 * n):
        bits *= 2
    at = F.shiftrightunsigned("key", 64 - bits.bit_length() + 1)
    rows = keys.select(F.floor(at / ROW_BITS).alias("row"), (at % ROW_BITS).alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((bits // ROW_BITS, ROW_BITS // 8), np.uint8)
    made = rows.toArrow()
    for row, held in zip(made.column("row").to_pylist(), made.column("bits"), strict=True):
        out[row] = np.frombuffer(held.as_py(), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out.ravel())


def _cut(batch: pa.RecordBatch):
    """(lowered bytes, starts, ends, rows, seeds) of the terms of each block of a batch (text, seed, ...)."""
    seeds = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
    for first, offsets, data in arrays.blocks(batch.column(0)):
        lowered = arrays.LOWER[data]
        starts, ends, texts = arrays.cut_words(lowered, offsets, TERM)
        yield lowered, starts, ends, texts + first, seeds[texts + first]


def _distinct(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of one entry for each (row, key), ordered by key."""
    order = np.lexsort((rows, keys))
    r, k = rows[order], keys[order]
    return order[np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]))[: len(order)]]


def _extend(texts: DataFrame, before: int, length: int, held) -> DataFrame:
    """(key, complete, n): prefixes of `length` bytes of the terms longer than `before` bytes, with the number of documents they
    are in, added up in batches. `held` is a broadcast bitmap of the parents, None on the first level."""

    def run(batches):
        for batch in batches:
            found = []
            for lowered, starts, ends, rows, seeds in _cut(batch):
                if held is not None:
                    on = np.flatnonzero(ends - starts > before)
                    starts, ends, rows, seeds = starts[on], ends[on], rows[on], seeds[on]
                    on = np.flatnonzero(_inside(held.value, _hashes(lowered, starts, starts + before, seeds, False)))
                    starts, ends, rows, seeds = starts[on], ends[on], rows[on], seeds[on]
                complete = ends - starts <= length
                key = _hashes(lowered, starts, np.minimum(ends, starts + length), seeds, complete)
                once = _distinct(rows, key)
                first = np.flatnonzero(np.append(True, key[once][1:] != key[once][:-1])[: len(once)])
                found.append((key[once[first]], complete[once[first]], np.diff(np.append(first, len(once)))))
            if not found:
                continue
            key, complete, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])[: len(order)])
            n = np.add.reduceat(n[order], first) if len(first) else n
            some = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(complete[some]), pa.array(n)], names=["key", "complete", "n"])

    return texts.select("text", "seed").mapInArrow(run, "key bigint, complete boolean, n bigint")


def _occurrences(texts: DataFrame, held) -> DataFrame:
    """(group, key, docs, count, at) of the complete terms in the bitmap `held`, added up in blocks; `at` is one of the documents."""

    def run(batches):
        for batch in batches:
            groups, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            for lowered, starts, ends, rows, seeds in _cut(batch):
                key = _hashes(lowered, starts, ends, seeds, True)
                on = np.flatnonzero(_inside(held.value, key))
                key, rows = key[on], rows[on]
                if not len(key):
                    continue
                order = np.lexsort((rows, key, groups[rows]))
                r, k = rows[order], key[order]
                g = groups[r]
                fresh = np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]))
                first = np.flatnonzero(fresh)
                docs = np.add.reduceat((fresh | np.append(True, r[1:] != r[:-1])).astype(np.int64), first)
                made = [g[first], k[first].view(np.int64), docs, np.diff(np.append(first, len(order))), at[r[first]]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["group", "key", "docs", "count", "at"])

    return texts.select("text", "seed", "group", "at").mapInArrow(run, "group bigint, key bigint, docs bigint, count bigint, at bigint")


def _named(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, term) of the wanted terms (key, at), read from the documents that they name."""
    lists = materialize(wanted.groupBy("at").agg(F.collect_set("key").alias("keys")), "wanted")
    few = lists.limit(BROADCAST_LISTS + 1).count() <= BROADCAST_LISTS
    chosen = texts.join(F.broadcast(lists.select("at")) if few else lists.select("at"), "at", "left_semi")
    once = chosen.groupBy("at").agg(F.first("text").alias("text"), F.first("seed").alias("seed")).join(lists, "at")

    def run(batches):
        for batch in batches:
            keys, terms = [], []
            lists = batch.column(2)
            for lowered, starts, ends, rows, seeds in _cut(batch):
                raw, found = lowered.tobytes(), _hashes(lowered, starts, ends, seeds, True).view(np.int64)
                first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])[: len(rows)])
                for a, b in zip(first.tolist(), np.append(first[1:], len(rows)).tolist(), strict=True):
                    own = np.array(lists[int(rows[a])].as_py(), np.int64)
                    value, spot = np.unique(found[a:b], return_index=True)
                    spot = spot[np.isin(value, own)] + a
                    keys += found[spot].tolist()
                    terms += [raw[starts[k] : ends[k]].decode() for k in spot.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(terms, pa.string())], names=["key", "term"])

    return once.select("text", "seed", "keys").mapInArrow(run, "key bigint, term string").groupBy("key").agg(F.first("term").alias("term"))


def _kept(texts: DataFrame, least: int, first: int, bits: int) -> DataFrame:
    """(key, group, docs, count, at, all) of every kept term in every group that has it; `all` counts the whole language."""
    before, length, held, complete = 0, first, None, None
    while True:
        counts = _extend(texts, before, length, held).groupBy("key", "complete").agg(F.sum("n").alias("n"))
        counts = materialize(counts.where(F.col("n") >= least).select("key", "complete"), "prefixes")
        ended = counts.where("complete").select("key")
        complete = ended if complete is None else complete.union(ended)
        parents = counts.where("not complete").select("key")
        if not parents.limit(1).count():
            break
        held = _bitmap(parents, bits)
        before, length = length, 2 * length
    counts = _occurrences(texts, _bitmap(complete, bits)).groupBy("key", "group").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"), F.min("at").alias("at"))
    counts = materialize(counts, "terms")
    totals = counts.groupBy("key").agg(F.sum("docs").alias("n"), F.sum("count").alias("all")).where(F.col("n") >= least).drop("n")
    return materialize(counts.join(totals, "key"), "kept")


def kept_terms(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, first: int = FIRST, bits: int = BITS
) -> DataFrame:
    """(lang, source, term, docs, count) of every kept term in every group that has it: its documents and occurrences there."""
    texts = _inputs(docs, text, lang, source)
    kept = _kept(texts, least, first, bits)
    names = _named(texts, kept.groupBy("key").agg(F.min("at").alias("at")))
    groups = texts.select("group", "lang", "source").distinct()
    return kept.join(names, "key").join(groups, "group").select("lang", "source", "term", "docs", "count")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """p of a term with `count` occurrences; null without kept terms."""
    scaled = (count + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    below = F.nullif(total + 2 * kept, F.lit(0).cast("bigint")).cast("decimal(20,0)")
    return F.call_function("div", scaled, below) + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(rows: DataFrame, tile: int) -> DataFrame:
    """(lang, g, h, value) summed over terms, from rows (lang, zero, places, shares): `zero` has each source's share of a term that
    it lacks, `shares` those of the sources at `places`."""
    tiles = F.sequence(F.lit(0), F.ceil(F.size("zero") / tile).cast("int") - 1)
    dealt = rows.select("*", F.explode(tiles).alias("i")).select("*", F.explode(tiles).alias("j"))

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}

        def flush():
            for (lang, i, j), total in sums.items():
                g, h = np.indices(total.shape)
                made = [pa.array([lang] * total.size, pa.string()), pa.array((g + i * tile).ravel().astype(np.int32)), pa.array((h + j * tile).ravel().astype(np.int32)), pa.array(total.ravel())]
                yield pa.RecordBatch.from_arrays(made, names=["lang", "g", "h", "value"])
            sums.clear()

        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 4, 5)), strict=True)):
                groups.setdefault(key, []).append(row)
            for (lang, i, j), members in groups.items():
                zero = np.array(batch.column(1)[members[0]].as_py())
                step = max(1, ELEMENTS // (tile * tile if len(zero) > tile else len(zero) ** 2))
                for at in range(0, len(members), step):
                    part = members[at : at + step]
                    p = np.tile(zero, (len(part), 1))
                    for k, row in enumerate(part):
                        p[k, batch.column(2)[row].as_py()] = batch.column(3)[row].as_py()
                    a, b = p[:, i * tile : (i + 1) * tile, None], p[:, None, j * tile : (j + 1) * tile]
                    value = ((a - b) ** 2 // (a + b)).sum(axis=0)
                    sums[lang, i, j] = sums[lang, i, j] + value if (lang, i, j) in sums else value
            if sum(x.size for x in sums.values()) > 4 * ELEMENTS:
                yield from flush()
        yield from flush()

    made = dealt.select("lang", "zero", "places", "shares", "i", "j").mapInArrow(run, "lang string, g int, h int, value bigint")
    return made.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP, tile: int = TILE,
    first: int = FIRST, bits: int = BITS,
) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: the divergence from each other source of the language, all of them;
    part `term`: the terms of the source with the largest divergence from the language's share among those above it, `top` at
    most."""
    texts = _inputs(docs, text, lang, source)
    kept = _kept(texts, least, first, bits)
    none = F.lit(0).cast("bigint")
    sizes = kept.groupBy("group").agg(F.sum("count").alias("n"))
    groups = materialize(texts.select("group", "lang", "source").distinct().join(sizes, "group", "left").fillna(0, ["n"]), "groups")
    # a term counts once for its language: in the row of its first group
    terms = kept.groupBy("key").agg(F.min("group").alias("group")).join(groups, "group").groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    # one row a language, with one entry for each of its sources: the result has the square of that many rows
    members = F.array_sort(F.collect_list(F.struct("source", "n", "group")))
    langs = groups.groupBy("lang").agg(members.alias("members"), F.sum("n").alias("n_lang")).join(terms, "lang", "left")
    langs = materialize(langs.fillna(0, ["kept"]), "langs")
    facts = langs.select("lang", "kept", "n_lang", F.posexplode("members").alias("place", "m")).select("lang", "kept", "n_lang", "place", "m.group", F.col("m.n").alias("n"))
    shares = kept.join(facts, "group").withColumn("p", _share(F.col("count"), F.col("n"), F.col("kept")))

    over = shares.withColumn("q", _share(F.col("all"), F.col("n_lang"), F.col("kept"))).where("p > q")
    over = over.select("lang", "group", "key", "at", _divergence(F.col("p"), F.col("q")).alias("value"))
    over = over.withColumn("place", F.rank().over(Window.partitionBy("group").orderBy(F.desc("value")))).where(F.col("place") <= top)
    over = materialize(over, "over")
    over = over.join(_named(texts, over.select("key", "at")), "key").join(groups.select("group", "source"), "group")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    held = shares.groupBy("lang", "key").agg(F.collect_list("place").alias("places"), F.collect_list("p").alias("shares"))
    zero = F.transform("members", lambda m: _share(none, m["n"], F.col("kept"))).alias("zero")
    sums = _pair_sums(held.join(langs.select("lang", zero), "lang").select("lang", "zero", "places", "shares"), tile)
    pairs = langs.select("lang", "members", F.posexplode("members").alias("g", "a")).select("lang", "g", F.col("a.source").alias("source"), F.posexplode("members").alias("h", "b"))
    pairs = pairs.where("g <> h").join(sums, ["lang", "g", "h"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("b.source").alias("item"), F.coalesce("value", none).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(over)
