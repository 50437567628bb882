"""Benchmark decontamination: training texts against a broadcast hash set of normalised benchmark word windows.

Words are maximal runs of letters, digits and non-ASCII characters after lower-casing A-Z. A benchmark item contributes each
run of `window` consecutive words; an item of fewer words, but not none, contributes its whole word sequence. A word of a
document is hit when it lies inside any occurrence of such a window.

The hash set is broadcast only while it has at most BROADCAST_WINDOWS entries; beyond that the windows of documents and
items meet in a shuffle join. A hit is looked up by one 64-bit hash and verified by a second, independent one.

Defined results: a null or empty text has no words and is clean; a null or wordless item has no windows; repeated rows and
repeated items are judged each on their own; an empty benchmark leaves every document clean; other columns of the inputs
are kept (documents, but for one named `scan`) or ignored (benchmark). Item ids may be of any type and are reported as strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm import arrays

WINDOW = 13
#: Largest number of benchmark windows that are broadcast (about 40 bytes each in a Python worker).
BROADCAST_WINDOWS = 2_000_000
#: A document is contaminated when at least one word in this many is hit.
RATIO = 20
WORD = arrays.byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_FILTER_BITS = 24
SCAN_SCHEMA = "scan struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<start: bigint, end: bigint>>>"
_SCAN_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def _words(data: np.ndarray, offsets: np.ndarray):
    lowered = arrays.LOWER[data]
    starts, ends, texts = arrays.cut_words(lowered, offsets, WORD)
    return starts, ends, texts, [arrays.span_hashes(lowered, starts, ends, stream) for stream in (0, 1)]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id") -> DataFrame:
    """One row (item, size, h, v) per distinct window of an item; v is the verifying hash."""

    def emit(batches):
        for batch in batches:
            for first, offsets, data in arrays.blocks(batch.column(1), arrays.SMALL_BLOCK_BYTES):
                _, _, texts, hashes = _words(data, offsets)
                counts = np.bincount(texts, minlength=len(offsets) - 1)
                for size in sorted({window, *counts[(counts > 0) & (counts < window)].tolist()}):
                    keep = arrays.same_text(texts, size)
                    if size < window:
                        keep &= counts[texts[: len(keep)]] == size
                    at = np.flatnonzero(keep)
                    h, v = (arrays.window_hashes(x, size)[at].view(np.int64) for x in hashes)
                    rows = pa.array(texts[at] + first)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), pa.array(np.full(len(at), size, np.int32)), pa.array(h), pa.array(v)],
                        names=["item", "size", "h", "v"],
                    )

    source = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(arrays.trimmed(emit), "item string, size int, h bigint, v bigint").distinct()


class _Lookup:
    """The broadcast side: for each window size its sorted hashes, a bit filter, and the items that have each window."""

    def __init__(self, rows: pa.Table):
        size, h, v = (rows.column(k).to_numpy() for k in ("size", "h", "v"))
        names = np.array(rows.column("item").to_pylist(), object)
        self.items, ids = np.unique(names.astype(str), return_inverse=True) if len(names) else (np.zeros(0, str), np.zeros(0, int))
        self.sizes = {}
        for s in np.unique(size):
            own = np.flatnonzero(size == s)
            own = own[np.lexsort((v[own].view(np.uint64), h[own].view(np.uint64)))]
            keys = h[own].view(np.uint64)
            bits = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
            np.bitwise_or.at(bits, (keys >> np.uint64(67 - _FILTER_BITS)).astype(np.int64), np.uint8(1) << ((keys >> np.uint64(64 - _FILTER_BITS)) & np.uint64(7)).astype(np.uint8))
            self.sizes[int(s)] = keys, v[own].view(np.uint64), ids[own], bits

    def hits(self, hashes: list[np.ndarray], texts: np.ndarray):
        """(first words, sizes, item numbers) of all verified occurrences."""
        found = []
        for size, (keys, checks, items, bits) in self.sizes.items():
            h = arrays.window_hashes(hashes[0], size)
            at = np.flatnonzero(bits[(h >> np.uint64(67 - _FILTER_BITS)).astype(np.int64)] >> ((h >> np.uint64(64 - _FILTER_BITS)) & np.uint64(7)).astype(np.uint8) & np.uint8(1))
            at = at[arrays.same_text(texts, size)[at]]
            low, high = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            if not len(at):
                continue
            several = np.repeat(np.arange(len(at)), high - low)
            entry = np.arange(len(several)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[several]
            second = arrays.window_hashes(hashes[1], size)[at]
            right = checks[entry] == second[several]
            found.append((at[several[right]], np.full(int(right.sum()), size), items[entry[right]]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _covered(n: int, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + sizes, -1)
    return np.cumsum(steps[:n]) > 0


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _summary(data, offsets, starts, ends, texts, at, sizes, items) -> list[dict]:
    """A dictionary per text of the block; spans are code points of maximal runs of hit words."""
    rows = len(offsets) - 1
    n_words = np.bincount(texts, minlength=rows).tolist()
    out = [{"n_words": n, "n_hit": 0, "items": [], "spans": []} for n in n_words]
    if not len(at):
        return out
    covered = _covered(len(starts), at, sizes)
    owner = texts[at]
    for row in np.unique(owner):
        first, last = np.searchsorted(texts, [row, row + 1])
        own = covered[first:last]
        points = arrays.code_points(data[offsets[row] : offsets[row + 1]])
        a, b = _runs(own)
        begin, end = points[starts[first + a] - offsets[row]], points[ends[first + b - 1] - offsets[row]]
        out[row] = {
            "n_words": n_words[row],
            "n_hit": int(own.sum()),
            "items": sorted(set(items[owner == row].tolist())),
            "spans": [{"start": int(x), "end": int(y)} for x, y in zip(begin, end, strict=True)],
        }
    return out


def _scan_broadcast(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_Lookup(windows.toArrow()))

    def scan(batches):
        lookup = shared.value
        for batch in batches:
            out = []
            for _, offsets, data in arrays.blocks(batch.column(batch.num_columns - 1), arrays.SMALL_BLOCK_BYTES):
                starts, ends, texts, hashes = _words(data, offsets)
                at, sizes, items = lookup.hits(hashes, texts)
                out += _summary(data, offsets, starts, ends, texts, at, sizes, lookup.items[items])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, _SCAN_TYPE)], names=[*batch.schema.names[:-1], "scan"])

    kept = docs.withColumn("scan", F.coalesce(F.col(text), F.lit("")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return kept.mapInArrow(arrays.trimmed(scan), f"{fields}, {SCAN_SCHEMA}" if fields else SCAN_SCHEMA)


def _scan_joined(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """The same result by a shuffle join of window hashes, for benchmarks beyond the broadcast bound."""
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # at most WINDOW values

    def emit(batches):
        for batch in batches:
            for first, offsets, data in arrays.blocks(batch.column(0), arrays.SMALL_BLOCK_BYTES):
                _, _, texts, hashes = _words(data, offsets)
                for size in sizes:
                    at = np.flatnonzero(arrays.same_text(texts, size))
                    h, v = (arrays.window_hashes(x, size)[at].view(np.int64) for x in hashes)
                    word = at - np.searchsorted(texts, texts[at])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).take(pa.array(texts[at] + first)), pa.array(word.astype(np.int64)), pa.array(np.full(len(at), size, np.int32)), pa.array(h), pa.array(v)],
                        names=["key", "word", "size", "h", "v"],
                    )

    def rebuild(batches):
        for batch in batches:
            hits, out = batch.column(batch.num_columns - 1).to_pylist(), []
            for first, offsets, data in arrays.blocks(batch.column(batch.num_columns - 2), arrays.SMALL_BLOCK_BYTES):
                starts, ends, texts, _ = _words(data, offsets)
                base = np.searchsorted(texts, np.arange(len(offsets)))
                rows = [(int(base[k]) + x["word"], x["size"], x["item"]) for k in range(len(offsets) - 1) for x in hits[first + k] or []]
                at, sizes, items = (np.array([r[j] for r in rows]) for j in range(3))
                out += _summary(data, offsets, starts, ends, texts, at.astype(np.int64), sizes.astype(np.int64), items)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, _SCAN_TYPE)], names=[*batch.schema.names[:-2], "scan"])

    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(body.alias("text"), F.sha2(body, 256).alias("key")).dropDuplicates(["key"])
    hits = texts.mapInArrow(arrays.trimmed(emit), "key string, word bigint, size int, h bigint, v bigint").join(windows, ["size", "h", "v"])
    hits = hits.groupBy("key").agg(F.collect_list(F.struct("word", "size", "item")).alias("hits"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    joined = docs.alias("d").join(hits.alias("x"), F.sha2(F.coalesce(F.col(f"d.`{text}`"), F.lit("")), 256) == F.col("x.key"), "left")
    return joined.select(*names, F.coalesce(F.col(f"d.`{text}`"), F.lit("")).alias("body"), "x.hits").mapInArrow(arrays.trimmed(rebuild), f"{fields}, {SCAN_SCHEMA}")


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """`docs` with a column `scan`: word and hit counts, the items found, and the hit spans in code points."""
    docs = docs.drop("scan")
    windows = benchmark_windows(benchmark, window, item_text, item)
    way = _scan_broadcast if windows.limit(broadcast_windows + 1).count() <= broadcast_windows else _scan_joined
    return way(docs, windows, text)


def contaminated(ratio: int = RATIO) -> Column:
    """Whether a scanned row has a hit and at least one hit word in `ratio`."""
    return (F.col("scan.n_hit") > 0) & (F.col("scan.n_hit") * ratio >= F.col("scan.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """`docs` without contaminated documents, or (remove="spans") with the hit spans cut out of their texts."""
    found = scan(docs, benchmark, text=text, **options)
    if remove == "documents":
        return found.where(~contaminated()).drop("scan")
    if remove != "spans":
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    body = F.col(text)
    spans = F.col("scan.spans")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.substring(
            body,
            F.when(i == 0, 1).otherwise(F.get(spans, i - 1)["end"] + 1).cast("int"),
            (F.coalesce(F.get(spans, i)["start"], F.length(body).cast("bigint")) - F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])).cast("int"),
        ),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(body)).drop("scan")
