"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere, in any text.

The suffix array is sparse. Every `length`-byte string picks one of its inner GRAM-byte grams, the one with the least hash (of
equal ones the last), as its anchor; equal strings pick the same gram at the same place, so only suffixes that start at the
same gram need comparing. Neighbouring strings share anchors: the strings of one anchor form a run, about one run per
(length - GRAM) / 2 bytes.

1. One pass over the texts writes the runs: text key, first and last start, hash of the gram, hash of the run's bytes.
2. Runs are counted by gram and bytes with map-side combine, so copies collapse before they move. A run whose bytes occur
   twice is repeated as a whole. A gram with one kind of run needs no more work.
3. Of the other grams one run of each kind is fetched from its text, by a shuffle join. Their anchored suffixes are range-partitioned by leading
   bytes with sampled splitters, and sorted in each bucket by multikey quicksort over machine words; neighbours that agree on
   all bytes are repeats. Splitters are leading bytes of whole grams, so equal grams never lie on both sides of a bucket's
   boundary; `_sorted_groups` carries a group over the boundaries of Arrow batches. A gram with more than BUCKET_KINDS kinds
   or BUCKET_STRINGS strings does not fit a bucket: its strings are dealt by hash and counted instead, with map-side combine,
   and give the same answer.
4. Ranges of repeated starts go back to their texts, whose covered bytes are removed.

Defined results: null and empty texts and texts shorter than `length` keep all their bytes; repeated rows are copies of each
other and lose all bytes if they are long enough; rows with equal texts get equal results; other columns are kept, but for
those with the name of a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import arrays
from claimloom.llm.columns import unused
from claimloom.storage import materialize

LENGTH, GRAM = 400, 128
#: Kinds of runs of one gram, and their strings, that a bucket takes at once.
BUCKET_KINDS, BUCKET_STRINGS = 4_096, 100_000
#: Leading bytes by which suffixes are range-partitioned.
LEADING = 24
#: Strings that are sorted at a time in a task, before the rest of the last gram; neighbours compared at a time.
SORT_STRINGS, COMPARED = 50_000, 2_000
_LOW = np.uint64(0xFFFFFFFF)
RUNS = "key bigint, n_bytes bigint, first int, last int, h bigint, c bigint"


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` gram hashes the place of its least, of equal ones the last. Hashes compare by their upper
    half; places fill the lower half."""
    n = len(grams)
    ranked = (grams & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = ranked
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    least = np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])
    return (_LOW - (least & _LOW)).astype(np.int64)


def _prefix_sums(data: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = arrays._power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(arrays._BYTE_VALUES[stream][data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return sums, down


def text_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(text, first, last, gram hash, run hash) arrays for the texts of a block; starts count within their text."""
    sums, down = _prefix_sums(data, 0)
    others, _ = _prefix_sums(data, 1)
    out = []
    for row in np.flatnonzero(np.diff(offsets) >= length).tolist():
        a, b = int(offsets[row]), int(offsets[row + 1])
        grams = arrays.mix((sums[a + gram : b + 1] - sums[a : b + 1 - gram]) * down[a : b + 1 - gram])
        at = anchors(grams, length - gram + 1)
        firsts = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
        lasts = np.append(firsts[1:], len(at)) - 1
        place = at[firsts]
        begin, end = a + firsts, a + lasts + length
        shape = ((place - firsts).astype(np.uint64) << np.uint64(32)) | (lasts - firsts).astype(np.uint64)
        bytes_ = arrays.mix((others[end] - others[begin]) * down[begin] + arrays.mix(shape))
        out.append((np.full(len(firsts), row), firsts, lasts, grams[place], bytes_))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of a table (key, text)."""

    def work(batches):
        for batch in batches:
            for first_row, offsets, data in arrays.blocks(batch.column(1), arrays.SMALL_BLOCK_BYTES):
                row, first, last, h, c = text_runs(data, offsets, length, gram)
                sizes = np.diff(offsets)
                columns = [pa.array(sizes[row]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first_row)), *columns], names=["key", "n_bytes", "first", "last", "h", "c"])

    return texts.mapInArrow(arrays.trimmed(work), RUNS)


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows of `words`, and for each place whether its row equals the one before it.

    Multikey quicksort with the three-way split made for all groups of a level at once: rows of a group are ordered by their
    next word, equal ones form the groups of the next level, and rows that stand alone are done.
    """
    n, levels = words.shape
    order = np.arange(n)
    group = np.zeros(n, np.int64)
    equal = np.zeros(n, bool)
    places = np.arange(n)  # of the rows that are not done
    for level in range(levels):
        if not len(places):
            break
        rows = order[places]
        value = words[rows, level]
        inner = np.lexsort((value, group))
        rows, value, group = rows[inner], value[inner], group[inner]
        order[places] = rows
        same = np.concatenate(([False], (group[1:] == group[:-1]) & (value[1:] == value[:-1])))
        equal[places] = same
        group = np.cumsum(~same)
        keep = same | np.append(same[1:], False)
        places, group = places[keep], group[keep]
    return order, equal


def repeated_starts(pieces: list[bytes], groups: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each piece the ranges of its starts whose `length` bytes also occur in another piece of its group."""
    sizes = np.array([len(p) for p in pieces])
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    starts = sizes - length + 1
    owner = np.repeat(np.arange(len(pieces)), starts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = cuts[owner] + inner
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    word = lambda k: np.ascontiguousarray(eight[at + k]).view(">u8").ravel().astype(np.uint64)
    sums, down = _prefix_sums(data, 0)
    rest = arrays.mix((sums[at + length] - sums[at + 16]) * down[at + 16])
    order, equal = multikey_sort(np.stack([groups[owner].astype(np.uint64), word(0), word(8), rest], axis=1))
    # neighbours that agree on the last, hashed symbol are compared byte by byte
    pair = np.flatnonzero(equal)
    strings = np.lib.stride_tricks.sliding_window_view(data, length) if len(pair) else data
    for first in range(0, len(pair), COMPARED):
        part = pair[first : first + COMPARED]
        equal[part] = (strings[at[order[part - 1]]] == strings[at[order[part]]]).all(axis=1)
    found = np.zeros(len(owner), bool)
    found[order[equal]] = True
    found[order[np.flatnonzero(equal) - 1]] = True
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    step = np.diff(np.concatenate(([0], found.astype(np.int8), [0])))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a range of found starts may run on into the next piece: cut it there
    edges = np.cumsum(starts)
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        while a < b:
            stop = min(b, int(edges[owner[a]]))
            out[owner[a]].append((int(inner[a]), int(inner[a]) + stop - a))
            a = stop
    return out


def _sorted_groups(batches, limit: int, length: int):
    """Lists of (h, c, piece) rows of whole groups, about `limit` strings at a time, from batches sorted by group."""
    held, strings = [], 0
    for batch in batches:
        for h, c, piece in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if strings > limit and h != held[-1][0]:
                yield held
                held, strings = [], 0
            held.append((h, c, piece))
            strings += len(piece) - length + 1
    if held:
        yield held


_RANGES = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _sort_buckets(pieces: DataFrame, length: int) -> DataFrame:
    """(h, c, ranges) from pieces (h, c, piece, lead): range partitions, sorted, neighbours compared."""

    def work(batches):
        for rows in _sorted_groups(batches, SORT_STRINGS, length):
            h = np.array([r[0] for r in rows])
            found = repeated_starts([r[2] for r in rows], np.cumsum(np.append(0, h[1:] != h[:-1])), length)
            kept = [k for k, ranges in enumerate(found) if ranges]
            ranges = [[{"begin": a, "end": b} for a, b in found[k]] for k in kept]
            yield pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in kept], pa.int64()), pa.array([rows[k][1] for k in kept], pa.int64()), pa.array(ranges, _RANGES)], names=["h", "c", "ranges"])

    dealt = pieces.repartitionByRange("lead", "h").sortWithinPartitions("lead", "h").select("h", "c", "piece")
    return dealt.mapInArrow(arrays.trimmed(work), "h bigint, c bigint, ranges array<struct<begin: int, end: int>>")


def _count_strings(pieces: DataFrame, length: int) -> DataFrame:
    """The same for grams with too many kinds for a bucket: their strings are counted by hash."""

    def explode(batches):
        for batch in batches:
            for h, c, piece in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = np.frombuffer(piece, np.uint8)
                n = len(data) - length + 1
                made = []
                for stream in (0, 1):
                    sums, down = _prefix_sums(data, stream)
                    made.append(pa.array(arrays.mix((sums[length:] - sums[:n]) * down[:n]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, h)), pa.array(np.full(n, c)), pa.array(np.arange(n, dtype=np.int32)), *made], names=["h", "c", "begin", "s", "t"])

    strings = pieces.select("h", "c", "piece").mapInArrow(explode, "h bigint, c bigint, begin int, s bigint, t bigint")
    again = strings.groupBy("s", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s", "t")
    found = strings.join(again, ["s", "t"]).groupBy("h", "c").agg(F.array_sort(F.collect_list("begin")).alias("begins"))
    return found.select("h", "c", F.transform("begins", lambda b: F.struct(b.alias("begin"), (b + 1).alias("end"))).alias("ranges"))


def _pieces(texts: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, c, piece, lead): the bytes of the wanted runs, cut from their texts, and the leading bytes of their gram."""
    # the lists grow with the texts and are not broadcast; they are written, so that the join reads both sides
    # from a shuffle and a key of many copies can be split
    lists = materialize(wanted.groupBy("key").agg(F.collect_list(F.struct("first", "last", "h", "c")).alias("want")), "wanted")
    once = texts.join(lists, "key")

    def work(batches):
        for batch in batches:
            for text, want in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = text.as_py().encode()
                rows = []
                for x in want:
                    piece = raw[x["first"] : x["last"] + length]
                    data = np.frombuffer(piece, np.uint8)
                    sums, down = _prefix_sums(data, 0)
                    grams = arrays.mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
                    spot = np.flatnonzero(grams.view(np.int64) == x["h"])
                    lead = piece[int(spot[0]) : int(spot[0]) + LEADING] if len(spot) else b""
                    rows.append((x["h"], x["c"], piece, lead))
                yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["h", "c", "piece", "lead"])

    # copies of a text give the same pieces: one is enough
    return once.select("text", "want").mapInArrow(arrays.trimmed(work), "h bigint, c bigint, piece binary, lead binary").dropDuplicates(["h", "c"])


def _cut(docs: DataFrame, text: str, starts: str, length: int) -> DataFrame:
    """`docs` with n_bytes, n_removed, n_spans and kept (binary) from the column `starts`, sorted ranges of starts."""

    def work(batches):
        for batch in batches:
            made = []
            for body, ranges in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                raw = body.as_py().encode()
                parts, at, removed, spans, upto = [], 0, 0, 0, -1
                for r in ranges or []:
                    begin, end = max(r["begin"], upto), r["end"] + length - 1
                    if end <= upto:
                        continue
                    spans += begin > upto or upto < 0
                    parts.append(raw[at:begin] if begin > at else b"")
                    removed += end - begin
                    at = upto = end
                parts.append(raw[at:])
                made.append((len(raw), removed, spans, b"".join(parts)))
            columns = [pa.array([m[k] for m in made], pa.int64() if k < 3 else pa.binary()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=[*batch.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept"])

    kept = [f for f in docs.schema.fields if f.name not in (text, starts)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*[F.col(f"`{f.name}`") for f in kept], body.alias("_1"), F.col(starts).alias("_2")).mapInArrow(
        arrays.trimmed(work), ", ".join([*fields, "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"])
    )


def dedup(
    docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, bucket_kinds: int = BUCKET_KINDS, bucket_strings: int = BUCKET_STRINGS
) -> DataFrame:
    """`docs` without its text, with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes)."""
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    long_ = F.coalesce(F.octet_length(F.col(text)) >= length, F.lit(False))
    texts = docs.where(long_).select(F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))
    all_runs = materialize(runs(texts, length, gram), "runs")
    # all rows of a (h, c) hold the same bytes; key and first are those of one of them
    kinds = all_runs.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("key", "first", "last")).alias("at"))
    kinds = materialize(kinds, "kinds")
    mixed = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("at.last") - F.col("at.first") + 1).alias("strings")).where("kinds > 1")
    small = (F.col("kinds") <= bucket_kinds) & (F.col("strings") <= bucket_strings)
    wanted = kinds.join(mixed, "h").select("h", "c", "at.key", "at.first", "at.last")
    pieces = materialize(_pieces(texts, wanted, length, gram), "pieces")
    sizes = pieces.join(mixed, "h")
    partial = _sort_buckets(sizes.where(small), length).union(_count_strings(sizes.where(~small), length))
    whole = kinds.where("n > 1").select("h", "c", F.lit(None).cast("array<struct<begin: int, end: int>>").alias("ranges"))
    # a kind that occurs twice is repeated as a whole, whatever its pieces say
    status = materialize(whole.union(partial.join(kinds.where("n = 1").select("h", "c"), ["h", "c"], "left_semi")), "status")
    key, starts, of, of_bytes = unused(docs, "key", "starts", "of", "of_bytes")
    found = all_runs.join(status, ["h", "c"]).select(
        "key", "n_bytes",
        F.explode(F.when(F.col("ranges").isNull(), F.array(F.struct(F.col("first").alias("begin"), (F.col("last") + 1).alias("end")))).otherwise(F.transform("ranges", lambda r: F.struct((F.col("first") + r["begin"]).alias("begin"), (F.col("first") + r["end"]).alias("end"))))).alias("r"),
    )
    found = found.groupBy(F.col("key").alias(of), F.col("n_bytes").alias(of_bytes)).agg(F.array_sort(F.collect_set("r")).alias(starts))
    # shorter texts by-pass the join, in which all empty ones would be one key
    keyed = docs.where(long_).withColumn(key, F.xxhash64(F.col(text)))
    same = (F.col(key) == F.col(of)) & (F.octet_length(F.col(text)) == F.col(of_bytes))
    joined = keyed.join(found, same, "left").drop(key, of, of_bytes)
    rest = docs.where(~long_).withColumn(starts, F.lit(None).cast(joined.schema[starts].dataType))
    return _cut(joined.unionByName(rest), text, starts, length)
