"""Substring dedup by paragraph MinHash banding.

A piece is a run of words between line ends and stops (. ! ? ; :, also before closing quotes and brackets): passages are pasted
into running lines too, so a line alone would tie a passage to its neighbours. Paragraphs are:

- pieces of at least MIN_WORDS words;
- in runs of shorter pieces (lists, verse), from each piece on as many as make JOIN words: overlapping, so that the same pieces
  give the same paragraphs whatever stands before them; a run of fewer words is one paragraph, of under MIN_WORDS none;
- in pieces of over LONG words, also the parts between words whose hash is least among AROUND words on each side: their ends
  depend on nothing further away, so a passage without stops inside a long line is cut as it is elsewhere.

A paragraph's set holds its word 5-grams, A-Z lower-cased; equal lists of them are one node.

1. Nodes index one key per band of MinHash values. `tune` picks the fewest values that reach the wanted recall at the wanted
   similarity and a small chance at an unwanted one; whatever meets in a band is verified.
2. Colliding nodes are verified by exact Jaccard similarity and clustered by connected components (linking.linked, which
   compares members of a band with its star first, the node in most shared bands, and the others in blocks by their differences
   to it, and never emits all pairs of a band).
3. A cluster with two or more occurrences is repeated. In each row's text, repeated paragraphs less than MIN_WORDS words apart
   form a passage; passages of at least PASSAGE_WORDS different places of words are reported, and all but the cluster's first
   occurrence (by id, then place, then a digest of the text) are removed.

Defined results: null, empty and short texts have no paragraphs; paragraphs that repeat within one text count; rows with null
ids take part and sort first; each of repeated rows has its own passages, and one of them the first occurrence; other columns are
ignored, and kept by `dedup`, whatever their names; very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm import arrays
from claimloom.llm.columns import unused
from claimloom.llm.linking import linked, narrowed
from claimloom.storage import discard, materialize

SHINGLE, MIN_WORDS, PASSAGE_WORDS = 5, 6, 16
#: Words of joined short pieces, words above which a piece is also cut inside, and the reach of such a cut.
JOIN, LONG, AROUND = 10, 24, 6
PART, WHOLE = 4, 5
RECALL = 0.99
#: Sets of this similarity may meet in a band with this chance.
APART, CHANCE = 0.3, 0.4
#: Sets of fewer shingles are similar enough only if they are equal.
LEAST_SHINGLES = 4
#: Texts with lists of wanted paragraphs that are broadcast; beyond that they are joined by shuffle.
BROADCAST_LISTS = 200_000
_STOPS, _CLOSERS = np.zeros(256, bool), np.zeros(256, bool)
_STOPS[list(b".!?;:")] = True
_CLOSERS[list(b"\"')]}")] = True
_LONG_CLOSERS = tuple(np.frombuffer(c.encode(), np.uint8) for c in "\u201d\u2019\u00bb\u203a")


def tune(similarity: float, recall: float, most_rows: int = 4, apart: float = 0.0, chance: float = 1.0) -> tuple[int, int]:
    """(bands, rows) with the fewest MinHash values whose collision chance is at least `recall` at `similarity` and, if any has
    that, at most `chance` at `apart`."""
    choices = [(math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows) - 1e-9), rows) for rows in range(1, most_rows + 1)]
    sharp = [c for c in choices if 1 - (1 - apart ** c[1]) ** c[0] <= chance]
    return min(sharp or choices[-1:], key=lambda c: (c[0] * c[1], c[1]))


def _ends_piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word whether it ends with a stop, closing quotes and brackets after it aside."""
    at = ends.copy()
    for _ in range(3):
        at -= (at - 1 > starts) & _CLOSERS[data[at - 1]]
        for closer in _LONG_CLOSERS:
            n = len(closer)
            some = np.flatnonzero(at - n > starts)
            same = np.ones(len(some), bool)
            for k in range(n):
                same &= data[at[some] - n + k] == closer[k]
            at[some[same]] -= n
    return _STOPS[data[at - 1]]


def _least_around(hashes: np.ndarray, texts: np.ndarray, reach: int) -> np.ndarray:
    """For each word whether its hash is the least of its text's words within `reach`; of equal ones the first."""
    least = np.ones(len(hashes), bool)
    for d in range(1, reach + 1):
        same = texts[d:] == texts[:-d]
        least[d:] &= ~same | (hashes[d:] < hashes[:-d])
        least[:-d] &= ~same | (hashes[:-d] <= hashes[d:])
    return least


def _pieces(final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last words of the pieces, given whether each word ends one."""
    last = np.flatnonzero(final)
    return np.append(0, last[:-1] + 1), last


def _ranges(texts: np.ndarray, final: np.ndarray, inner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last words of the paragraphs in order; `inner` marks words that may end a part of a long piece."""
    first, last = _pieces(final)
    words = last - first + 1
    short = words < least
    # runs of short pieces: from each one to the piece that completes JOIN words
    new = np.append(True, (short[1:] != short[:-1]) | (texts[first[1:]] != texts[first[:-1]]))
    run = np.cumsum(new) - 1
    run_first, run_last = first[new][run], last[np.append(new[1:], True)][run]
    joined = last[np.minimum(np.searchsorted(last, first + JOIN - 1), len(last) - 1)]
    whole = (joined > run_last) | (joined < first + JOIN - 1)
    joined = np.where(whole, run_last, joined)
    take = np.where(short, np.where(whole, (first == run_first) & (run_last - run_first + 1 >= least), True), True)
    firsts, lasts = [first[take]], [np.where(short, joined, last)[take]]
    # parts of long pieces
    long_ = np.repeat(words > LONG, words)
    part_first, part_last = _pieces(final | (inner & long_))
    some = long_[part_first] & (part_last - part_first + 1 >= least) & ~(final[part_last] & np.isin(part_first, first))
    firsts.append(part_first[some])
    lasts.append(part_last[some])
    first, last = np.concatenate(firsts), np.concatenate(lasts)
    order = np.lexsort((-last, first))
    return first[order], last[order]


class Cut:
    """The paragraphs of a block: `owner` text, `place` in it, `first` and `last` word in it, `begin` and `end` byte, and the
    shingles from `low` to `high` of the array `shingles`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int, least: int):
        lowered = arrays.LOWER[data]
        starts, ends, texts = arrays.cut_words(lowered, offsets, arrays.NOT_BLANK)
        if not len(starts):
            self.owner = self.place = self.first = self.last = self.begin = self.end = self.low = self.high = np.zeros(0, np.int64)
            self.shingles = np.zeros(0, np.uint64)
            return
        lines = np.concatenate(([0], np.cumsum(data == 10)))
        final = _ends_piece(data, starts, ends)
        final[:-1] |= (lines[starts[1:]] > lines[ends[:-1]]) | (texts[1:] != texts[:-1])
        final[-1] = True
        hashes = arrays.span_hashes(lowered, starts, ends)
        low, last = _ranges(texts, final, _least_around(hashes, texts, AROUND), least)
        self.owner = texts[low]
        self.place = np.arange(len(low)) - np.searchsorted(self.owner, self.owner)
        base = np.searchsorted(texts, self.owner)
        self.first, self.last = low - base, last - base
        self.begin, self.end = starts[low], ends[last]
        self.shingles = arrays.window_hashes(hashes, size)
        self.low, self.high = low, last - size + 2

    def keep(self, some: np.ndarray) -> None:
        """Forget the other paragraphs."""
        for name in ("owner", "place", "first", "last", "begin", "end", "low", "high"):
            setattr(self, name, getattr(self, name)[some])

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, size of the set) of each paragraph."""
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(arrays.mix(self.shingles), dtype=np.uint64)))
        n = self.high - self.low
        node = arrays.mix(sums[self.high] - sums[self.low] + n.astype(np.uint64))
        if not len(n):
            return node, n
        order = np.argsort(self.shingles, kind="stable")
        before = np.full(len(order), -1)
        same = np.flatnonzero(self.shingles[order[1:]] == self.shingles[order[:-1]]) + 1
        before[order[same]] = order[same - 1]
        for k in np.flatnonzero(self._reduced(np.maximum, before) >= self.low).tolist():
            n[k] = (before[self.low[k] : self.high[k]] < self.low[k]).sum()
        return node, n

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least of the shingles' values in each paragraph."""
        return self._reduced(np.minimum, values)

    def _reduced(self, operation, values: np.ndarray) -> np.ndarray:
        bounds = np.stack((self.low, self.high), axis=1).ravel()
        return operation.reduceat(np.append(values, values[:1]), bounds)[::2] if len(bounds) else values[:0]

    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        """(paragraph, shingle), ordered and distinct."""
        n = self.high - self.low
        held = np.repeat(np.arange(len(n)), n)
        h = self.shingles[np.arange(len(held)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.low, n)]
        order = np.lexsort((h, held))
        held, h = held[order], h[order]
        fresh = np.append(True, (held[1:] != held[:-1]) | (h[1:] != h[:-1]))[: len(h)]
        return held[fresh], h[fresh]


def paragraphs(docs: DataFrame, id: str, text: str, size: int, least: int) -> DataFrame:
    """(id, key, row, place, first, last, begin, end, node, n): key is a hash of the text, row tells rows apart, first and last
    count words, begin and end code points."""
    names = ["place", "first", "last", "begin", "end"]

    def run(batches):
        for batch in batches:
            for first_row, offsets, data in arrays.blocks(batch.column(3)):
                cut = Cut(data, offsets, size, least)
                node, n = cut.nodes()
                points = arrays.code_points(data)
                base = points[offsets[cut.owner]]
                rows = pa.array(cut.owner + first_row)
                numbers = [pa.array(x.astype(np.int32)) for x in (cut.place, cut.first, cut.last, points[cut.begin] - base, points[cut.end] - base)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(rows) for k in range(3)], *numbers, pa.array(node.view(np.int64)), pa.array(n)], names=["id", "key", "row", *names, "node", "n"])

    texts = _texts(docs, id, text).select("id", "key", F.monotonically_increasing_id().alias("row"), "text")
    return texts.mapInArrow(run, f"id {_kind(docs, id)}, key bigint, row bigint, {', '.join(f'{c} int' for c in names)}, node bigint, n bigint")


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).alias("id"), F.xxhash64(body).alias("key"), body.alias("text"))


def _kind(docs: DataFrame, id: str) -> str:
    return docs.schema[id].dataType.simpleString()


def bands(docs: DataFrame, id: str, text: str, size: int, least: int, shape: tuple[int, int]) -> DataFrame:
    """(key, node): the band keys of all paragraphs that may have similar but unequal ones."""
    count, rows = shape
    seeds = np.random.default_rng(97).integers(1, 1 << 62, count * rows, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            seen = np.zeros(0, np.uint64)
            for _, offsets, data in arrays.blocks(batch.column(2)):
                cut = Cut(data, offsets, size, least)
                node, n = cut.nodes()
                able = np.flatnonzero((n >= LEAST_SHINGLES) & ~np.isin(node, seen))
                able = able[np.unique(node[able], return_index=True)[1]]
                seen = np.concatenate((seen, node[able]))  # copies in a batch are indexed once
                keys = []
                for band in range(count):
                    key = np.full(len(n), band + 1, np.uint64)
                    for row in range(rows):
                        key = arrays.mix(key + cut.least(arrays.mix(cut.shingles ^ seeds[band * rows + row])))
                    keys.append(key[able])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(node[able], count).view(np.int64))], names=["key", "node"])

    return _texts(docs, id, text).mapInArrow(run, "key bigint, node bigint")


def _sets(chosen: DataFrame, size: int, least: int) -> DataFrame:
    """(node, tokens) of the wanted paragraphs of texts (text, nodes)."""

    def run(batches):
        for batch in batches:
            wanted = batch.column(1)
            for first_row, offsets, data in arrays.blocks(batch.column(0)):
                cut = Cut(data, offsets, size, least)
                node, n = cut.nodes()
                lists = wanted.slice(first_row, len(offsets) - 1)
                asked = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                of = lambda nodes, owners: arrays.mix(nodes + arrays.mix(owners.astype(np.uint64)))
                cut.keep(some := np.isin(of(node, cut.owner), of(asked, rows)))
                bounds = pa.array(np.append(0, np.cumsum(n[some])).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(node[some].view(np.int64)), pa.ListArray.from_arrays(bounds, pa.array(cut.sets()[1].view(np.int64)))], names=["node", "tokens"])

    return chosen.select("text", "nodes").mapInArrow(run, "node bigint, tokens array<bigint>")


def _shared(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, n, rank) of the keys that two nodes or more have; rank is least for the node with most such keys."""
    dealt = keyed.repartition("key")  # one shuffle for both sides
    shared = dealt.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    met = materialize(dealt.join(shared, "key").distinct(), "bands")
    held = met.groupBy("node").agg((-F.count(F.lit(1))).alias("rank"))
    sizes = found.select("node", "n").join(narrowed(materialize(held, "held").select("node")), "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"))
    buckets = materialize(met.join(held.join(sizes, "node"), "node").select("key", "node", "n", "rank"), "buckets")
    discard(met)
    return buckets


def repeated(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    part: int = PART,
    whole: int = WHOLE,
    recall: float = RECALL,
    size: int = SHINGLE,
    least: int = MIN_WORDS,
    passage: int = PASSAGE_WORDS,
) -> DataFrame:
    """(id, place, begin, end, words, component_id, first_place, removed) of each paragraph in a repeated passage.

    component_id and first_place name the first occurrence of the paragraph's cluster; `removed` is false for that one alone.
    """
    return _repeated(docs, id, text, part, whole, recall, size, least, passage).select(F.col("id").alias(id), "place", "begin", "end", "words", "component_id", "first_place", "removed")


def _repeated(docs: DataFrame, id: str, text: str, part: int, whole: int, recall: float, size: int, least: int, passage: int) -> DataFrame:
    found = materialize(paragraphs(docs, id, text, size, least), "paragraphs")
    buckets = _shared(bands(docs, id, text, size, least, tune(part / whole, recall, apart=APART, chance=CHANCE)), found)

    def sets_of(nodes: DataFrame) -> DataFrame:
        # one text for each node, and of each text the nodes that it stands for
        some = found.join(narrowed(nodes), "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))
        lists = materialize(some.groupBy("key").agg(F.collect_list("node").alias("nodes")), "wanted")
        few = lists.limit(BROADCAST_LISTS + 1).count() <= BROADCAST_LISTS
        chosen = _texts(docs, id, text).join(F.broadcast(lists) if few else lists, "key")
        return _sets(chosen, size, least).dropDuplicates(["node"])

    clusters = linked(buckets, sets_of, part, whole, blocks_only=True)
    discard(buckets)
    # what is repeated is settled by node, and the first occurrence of linked nodes by cluster, before whole rows are moved
    tallies = found.groupBy("node").agg(F.count(F.lit(1)).alias("of"), F.min(F.struct("id", "place", "key", "row")).alias("origin"))
    tallies = materialize(tallies.join(clusters, "node", "left").where("of > 1 or component is not null").drop("of"), "tallies")
    alone, joined = tallies.where("component is null"), tallies.where("component is not null")
    origins = joined.groupBy("component").agg(F.min("origin").alias("origin"))
    named = alone.select("node", "origin").union(joined.drop("origin").join(origins, "component").select("node", "origin"))
    removed = ~((F.col("row") == F.col("origin.row")) & (F.col("place") == F.col("origin.place")))
    again = found.join(named, "node").select(
        "id", "key", "row", "place", "first", "last", "begin", "end", F.col("origin.id").alias("component_id"), F.col("origin.place").alias("first_place"), removed.alias("removed")
    )
    in_text = Window.partitionBy("row").orderBy("place")  # the paragraphs of one row
    before = F.max("last").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    placed = again.withColumn("before", F.coalesce(before, F.lit(-1 - least)))
    placed = placed.withColumn("island", F.sum((F.col("first") > F.col("before") + least).cast("int")).over(in_text))
    fresh = F.greatest(F.col("last") - F.greatest("first", F.col("before") + 1) + 1, F.lit(0))
    passages = placed.withColumn("run", F.sum(fresh).over(Window.partitionBy("row", "island")))
    words = (F.col("last") - F.col("first") + 1).alias("words")
    return passages.where(F.col("run") >= passage).select("id", "key", "row", "place", "begin", "end", words, "component_id", "first_place", "removed")


def merged(spans: Column) -> Column:
    """Sorted spans (begin, end) with those that overlap or touch put together."""

    def step(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["begin"])
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, F.array().cast("array<struct<begin: int, end: int>>"), step)


def without(text: Column, spans: Column) -> Column:
    """`text` without the spans (begin, end), sorted and disjoint."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda k: F.substring(text, F.when(k == 0, 1).otherwise(F.get(spans, k - 1)["end"] + 1), F.coalesce(F.get(spans, k)["begin"], F.length(text)) - F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["end"])),
    )
    return F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(text)


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with the removed paragraphs cut out of their texts. Of rows that repeat id and text one keeps what is first there."""
    settings = {"part": PART, "whole": WHOLE, "recall": RECALL, "size": SHINGLE, "least": MIN_WORDS, "passage": PASSAGE_WORDS} | options
    found = _repeated(docs, id, text, **settings).where("removed")
    same, key, copy, cuts = unused(docs, "same", "key", "copy", "cuts")
    spans = found.groupBy("id", "key", "row").agg(merged(F.array_sort(F.collect_set(F.struct("begin", "end")))).alias(cuts))
    # rows that repeat id and text differ in what they keep; any of them may be the one that keeps it
    spans = spans.withColumn(copy, F.row_number().over(Window.partitionBy("id", "key").orderBy(F.size(cuts).desc(), F.col(cuts).desc())))
    spans = spans.withColumnsRenamed({"id": same, "key": f"{key}_of", copy: f"{copy}_of"}).drop("row")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    keyed = keyed.withColumn(copy, F.row_number().over(Window.partitionBy(id, key).orderBy(F.lit(0))))
    match = F.col(id).eqNullSafe(F.col(same)) & (F.col(key) == F.col(f"{key}_of")) & (F.col(copy) == F.col(f"{copy}_of"))
    joined = keyed.join(spans, match, "left")
    cut = F.when(F.col(cuts).isNotNull(), without(F.col(text), F.col(cuts))).otherwise(F.col(text))
    return joined.withColumn(text, cut).select(*[F.col(f"`{c}`") for c in docs.columns])
