"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the distinct 64-bit hashes of its word 5-grams (of its whole word sequence if it has fewer words).
Documents with equal sets form a class; classes are joined, and every document gets its class's component.

Candidates, complete for any pair of classes with Jaccard similarity of at least part / whole:

1. Tokens are in hash order. A set of n tokens indexes its first p + k - 1 tokens, where p = n - ceil(n * part / whole) + 1 and
   k grows with p. Two similar sets share at least k tokens of these extended prefixes (k of the smaller one).
   A set that shares fewer with all others together has no link and leaves.
2. Tokens with at most RARE entries in the index are rare and index single: a bucket each. A set with fewer than k frequent
   tokens in its extended prefix shares a rare one with any similar set, so it is done.
3. The other sets are few: they consist of frequent tokens to a good part. Among them tokens are counted over their whole
   sets, and prefixes are taken anew with the frequent tokens last. A set whose new prefix is all rare indexes its tokens
   singly and is done.
4. What is left, sets of almost only frequent tokens, indexes token combinations: tokens fall into hash classes, more classes
   than two similar sets of that size have differing tokens; so in some class both hold the same combination, which is the key.
   Sizes are cut into levels, and a set indexes for its own level and the next one up.

Then linking.linked verifies exactly; it compares no two members of a bucket that a common star already joins.

Defined results: null, empty and wordless texts have an empty set and stand alone; null ids get a null component and link with
nothing; rows with one id are one document with several texts; repeated rows fall in one class; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import arrays
from claimloom.llm.linking import linked, narrowed
from claimloom.storage import discard, materialize

SHINGLE = 5
#: Similarity of a link, as a fraction.
PART, WHOLE = 4, 5
#: Index entries up to which a token is rare.
RARE = 32
#: Tokens of a set per combination class, beyond the guaranteed number of classes.
CLASS_SLACK = 1.2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, hashes): the distinct shingles of each text, ordered by text and hash."""
    lowered = arrays.LOWER[data]
    starts, ends, texts = arrays.cut_words(lowered, offsets, arrays.NOT_BLANK)
    words = arrays.span_hashes(lowered, starts, ends)
    counts = np.bincount(texts, minlength=len(offsets) - 1)
    keep = arrays.same_text(texts, size)
    owners, hashes = [texts[: len(keep)][keep]], [arrays.window_hashes(words, size)[keep]]
    for short in range(1, size):
        at = np.searchsorted(texts, np.flatnonzero(counts == short))
        owners.append(texts[at])
        hashes.append(arrays.window_hashes(words, short)[at] if len(at) else np.zeros(0, np.uint64))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]))[: len(h)]
    return owner[fresh], h[fresh]


def needed(n: int, part: int, whole: int) -> int:
    """Tokens that a set of n shares at least with a similar one."""
    return -(-n * part // whole)


def prefix_length(n: int, part: int, whole: int) -> int:
    return n - needed(n, part, whole) + 1 if n else 0


def extension(n: int, part: int, whole: int) -> int:
    """k: shared tokens asked of extended prefixes; grows with the set, so that a shared passage alone does not reach it."""
    return 1 + prefix_length(n, part, whole) // 4


def _lists(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, id: str, text: str, part: int, whole: int, size: int) -> DataFrame:
    """(id, n, set_key, prefix) of each row: the size of its set, a 128-bit digest of it, its extended prefix."""

    def run(batches):
        for batch in batches:
            for first, offsets, data in arrays.blocks(batch.column(1), arrays.SMALL_BLOCK_BYTES):
                rows = len(offsets) - 1
                owner, h = shingle_sets(data, offsets, size)
                cuts = np.searchsorted(owner, np.arange(rows + 1))
                n = np.diff(cuts)
                keys = [xxhash.xxh3_128_digest(h[a:b].tobytes()) if b > a else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                take = np.array([min(x, prefix_length(x, part, whole) + extension(x, part, whole) - 1) for x in n.tolist()], np.int64)
                bounds = np.concatenate(([0], np.cumsum(take)))
                at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - cuts[:-1], take)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(n), pa.array(keys, pa.binary()), _lists(bounds, h[at])], names=["id", "n", "set_key", "prefix"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(arrays.trimmed(run), f"id {kind}, n bigint, set_key binary, prefix array<bigint>")


def token_sets(docs: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """(id, tokens) of each row with words."""

    def run(batches):
        for batch in batches:
            for first, offsets, data in arrays.blocks(batch.column(1), arrays.SMALL_BLOCK_BYTES):
                owner, h = shingle_sets(data, offsets, size)
                cuts = np.searchsorted(owner, np.arange(len(offsets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(offsets) - 1), _lists(cuts, h)], names=["id", "tokens"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(arrays.trimmed(run), f"id {kind}, tokens array<bigint>").where("size(tokens) > 0")


def _level(n: int, part: int, whole: int) -> int:
    return int(math.log(n) / math.log(whole / part) + 1e-9)


def combination_keys(tokens: np.ndarray, part: int, whole: int) -> list[int]:
    """Keys of a set of almost only frequent tokens: one per hash class and size level; empty combinations count only where
    too few others are guaranteed."""
    n, keys = len(tokens), []
    own = _level(n, part, whole)
    for level in (own, own + 1):
        top = math.ceil((whole / part) ** (level + 1))  # sizes of this level are below
        differing = 2 * top * (whole - part) // (whole + part)
        classes = max(differing + 1, int(CLASS_SLACK * differing))
        lane = (arrays.mix(tokens) % np.uint64(classes)).astype(np.int64)
        order = np.lexsort((tokens, lane))
        lane, ordered = lane[order], tokens[order]
        cuts = np.flatnonzero(np.append(True, lane[1:] != lane[:-1]))
        sums = np.add.reduceat(arrays.mix(ordered), cuts)
        keys.append(arrays.mix(sums + arrays.mix(lane[cuts].astype(np.uint64) + np.uint64(level << 40))))
        empty = classes - len(cuts)
        if classes - differing - empty < 1:  # the guaranteed common classes may all be empty
            gaps = np.setdiff1d(np.arange(classes), lane[cuts])
            keys.append(arrays.mix(arrays.mix(gaps.astype(np.uint64) + np.uint64(level << 40))))
    return np.concatenate(keys).view(np.int64).tolist()


def _second_index(sets: DataFrame, frequent: DataFrame, part: int, whole: int) -> DataFrame:
    """(key, node, n) for sets (node, tokens) with many frequent tokens: rare tokens of the new prefix, or combinations."""
    common = sets.select("node", F.explode("tokens").alias("h")).join(frequent, "h").groupBy("node").agg(F.collect_list("h").alias("often"))

    def run(batches):
        for batch in batches:
            nodes, keys, sizes = [], [], []
            for row, (tokens, often) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                tokens = np.array(tokens, np.int64).view(np.uint64)
                rare = tokens[~np.isin(tokens, np.array(often or [], np.int64).view(np.uint64))]
                prefix = prefix_length(len(tokens), part, whole)
                own = np.sort(rare)[:prefix].view(np.int64).tolist()
                if len(own) < prefix:
                    own += combination_keys(tokens, part, whole)
                nodes += [row] * len(own)
                keys += own
                sizes += [len(tokens)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0).take(pa.array(nodes, pa.int32())), pa.array(sizes, pa.int64())], names=["key", "node", "n"])

    kind = sets.schema["node"].dataType.simpleString()
    return sets.join(common, "node", "left").select("node", "tokens", "often").mapInArrow(arrays.trimmed(run), f"key bigint, node {kind}, n bigint")


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", part: int = PART, whole: int = WHOLE, size: int = SHINGLE, rare: int = RARE) -> DataFrame:
    """(id, n_shingles, component_id) of each row; component_id is the smallest id reachable by links, its own included."""
    signed = materialize(signatures(docs, id, text, part, whole, size), "signatures")
    usable = signed.where("set_key is not null and id is not null")
    classes = usable.groupBy("set_key").agg(F.min("id").alias("node"))
    # set size and prefix are the same in all rows of a class
    indexed = usable.groupBy("set_key").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    entries = indexed.select("node", "n", F.explode("prefix").alias("key"))
    counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    met = entries.join(counts, "key").select("key", "node", "n", (F.col("held") > rare).alias("often"))
    met = materialize(met, "index")
    # smallest k that a similar set may ask for, that of the smallest partner; who shares fewer tokens with anyone has no link
    lowest = F.ceil(F.col("n") * part / whole)
    k = 1 + F.floor((lowest - F.ceil(lowest * part / whole) + 1) / 4)
    able = met.groupBy("node").agg(F.count(F.lit(1)).alias("met"), F.sum(F.col("often").cast("int")).alias("often"), F.first("n").alias("n"))
    # unshared tokens of the prefix, in parts of a thousand: low in the middle of a group of near copies
    p = F.col("n") - F.ceil(F.col("n") * part / whole) + 1
    rank = F.floor(1000 - 1000 * F.col("met") / F.least(F.col("n"), p + F.floor(p / 4)))
    able = materialize(able.where(F.col("met") >= k).select("node", (F.col("often") >= k).alias("heavy"), rank.alias("rank")), "able")
    heavy = able.where("heavy").select("node")
    single = met.where("not often").select("key", "node", "n").join(able.select("node", "rank"), "node").select("key", "node", "n", "rank")

    def sets_of(nodes: DataFrame) -> DataFrame:
        chosen = docs.join(narrowed(nodes.withColumnRenamed("node", id)), id, "left_semi")
        return token_sets(chosen, id, text, size).withColumnRenamed("id", "node").dropDuplicates(["node", "tokens"])

    dense = materialize(sets_of(heavy), "sets")
    counted = dense.select(F.explode("tokens").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > rare).select("h")
    second = _second_index(dense, counted, part, whole).join(able.select("node", "rank"), "node").select("key", "node", "n", "rank")
    found = linked(single.union(second), sets_of, part, whole)
    discard(met, able, dense)

    named = classes.join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    out = signed.select("id", "n", "set_key").join(named, "set_key", "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
