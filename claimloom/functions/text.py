"""Chunking and hashed bag-of-words vectors."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_SIZE = 700
CHUNK_OVERLAP = 100
VECTOR_DIM = 384
# Words whose slot a task remembers.
KNOWN_TOKENS = 500_000
_FULL_STOP = re.compile(r"\.(?= )")
_TOKEN = re.compile("[a-z0-9]+")


def _cut_after(start: int, breaks: list[int], length: int, size: int) -> int:
    """End of the chunk that starts at `start`: the last sentence break in its later half, else its full size."""
    full = start + size
    if full >= length:
        return length
    last = bisect_left(breaks, full) - 1
    return breaks[last] if last >= 0 and 2 * (breaks[last] - 1 - start) > size else full


def split_chunks(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Chunks of at most `size` characters of the text with its white space collapsed.

    A chunk ends after a full stop that a blank follows, if there is one in its later half. The next one starts `overlap`
    characters earlier, or right there if the chunk is no longer than the overlap.
    """
    flat = " ".join(text.split())
    breaks = [m.end() for m in _FULL_STOP.finditer(flat)]
    starts, ends = [0], [_cut_after(0, breaks, len(flat), size)]
    while ends[-1] < len(flat):
        back = ends[-1] - overlap
        starts.append(back if back > starts[-1] else ends[-1])
        ends.append(_cut_after(starts[-1], breaks, len(flat), size))
    return [chunk for a, b in zip(starts, ends, strict=True) if (chunk := flat[a:b].strip())]


def chunk_column(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """array<string> of chunks; cuts depend on each other inside a text, texts are independent."""

    @F.pandas_udf("array<string>")
    def chunk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: split_chunks(t, size, overlap) if t is not None else [])

    return chunk(text)


def chunk_documents(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk: document columns without the text, `chunk_index`, `chunk_text`."""
    keep = [c for c in documents.columns if c != "text"]
    pieces = documents.select(*keep, F.posexplode(chunk_column(F.col("text"), size, overlap)))
    return pieces.select(*keep, F.col("pos").alias("chunk_index"), F.col("col").alias("chunk_text"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def token_slot(token: Column) -> Column:
    """md5(token) mod (2 * dim) for dim 384, from the hexadecimal digest.

    768 = 256 * 3, so the remainder follows from the last byte and the digest mod 3; the
    digest mod 3 is the sum of its four 32-bit words mod 3, as 2^32 = 1 (mod 3).
    """
    digest = F.md5(token.cast("binary"))

    def word(start: int, length: int) -> Column:
        return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")

    last = word(31, 2)
    mod3 = (word(1, 8) + word(9, 8) + word(17, 8) + word(25, 8)) % 3
    return (last + 256 * F.pmod(mod3 - last, F.lit(3))).cast("int")


def slot_index(slot: Column) -> Column:
    return slot % VECTOR_DIM


def slot_sign(slot: Column) -> Column:
    return F.when(slot < VECTOR_DIM, 1).otherwise(-1)


def token_slots(text: Column) -> Column:
    """array<int> with one slot per token: the input of the dense scorer, made without a shuffle.

    An Arrow batch function, because it can remember the slot of a word it has seen: most
    tokens cost one dictionary look-up, where `token_slot` would hash each of them.
    """

    @F.pandas_udf("array<int>")
    def slots(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}

        def slot(token: str) -> int:
            value = int.from_bytes(hashlib.md5(token.encode()).digest(), "big") % (2 * VECTOR_DIM)
            if len(known) < KNOWN_TOKENS:
                known[token] = value
            return value

        def of(t: str) -> list[int]:
            return [known[w] if w in known else slot(w) for w in _TOKEN.findall(t.lower())]

        for batch in batches:
            yield batch.map(lambda t: None if t is None else of(t))

    return slots(text)


def sparse_weights(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Non-zero signed counts per (keys, idx), with the L2-normalised weight.

    What is shuffled is a text's slots in one row; rows of equal keys lie side by side and are counted in one pass. Null keys
    have no weights.
    """
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    slots = df.select(*keys, token_slots(F.col(text)).alias("_s")).filter(F.size("_s") > 0).dropna(subset=keys)
    # dealt by a hash: a repartition by the columns themselves may be dropped after a join by them
    ordered = slots.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys)
    width = len(keys)

    def starts(table: pa.Table) -> np.ndarray:
        """Rows whose keys differ from the row before."""
        new = np.ones(table.num_rows, dtype=bool)
        if table.num_rows > 1:
            differs = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy() for c in table.columns[:width]]
            new[1:] = np.logical_or.reduce(differs)
        return np.flatnonzero(new)

    def counted(table: pa.Table) -> list[pa.RecordBatch]:
        first = starts(table)
        lengths = pc.list_value_length(table.column(width)).to_numpy()
        group = np.repeat(np.repeat(np.arange(len(first)), np.diff([*first, table.num_rows])), lengths)
        slot = pc.list_flatten(table.column(width)).to_numpy()
        cell, at = np.unique(group * VECTOR_DIM + slot % VECTOR_DIM, return_inverse=True)
        count = np.bincount(at, np.where(slot < VECTOR_DIM, 1.0, -1.0), len(cell)).astype(np.int64)
        cell, count = cell[count != 0], count[count != 0]
        owner = cell // VECTOR_DIM
        norm = np.sqrt(np.bincount(owner, count * count, len(first)))
        named = [c.take(pa.array(first[owner])) for c in table.columns[:width]]
        made = [pa.array((cell % VECTOR_DIM).astype(np.int32)), pa.array(count), pa.array(count / norm[owner])]
        return pa.Table.from_arrays([*named, *made], names=[*keys, "idx", "count", "weight"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last keys, which the next batch may go on with
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if table.num_rows:
                last = int(starts(table)[-1])
                yield from counted(table.slice(0, last)) if last else []
                held = table.slice(last)
        yield from counted(held) if held is not None else []

    return ordered.mapInArrow(run, ", ".join([*kinds, "idx int", "count bigint", "weight double"]))


def dense_embedding(slots: Column) -> Column:
    """array<float> unit vectors from token slots (zero vector for no tokens)."""
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            matrix = slot_matrix(list(batch))
            norms = np.sqrt((matrix * matrix).sum(axis=1))
            norms[norms == 0] = 1.0
            yield pd.Series(list((matrix / norms[:, None]).astype("float32")))

    return embed(slots)


def slot_matrix(rows: list):
    """Signed count matrix (rows x 384) of slot arrays; null rows stay zero."""
    lengths = np.array([0 if r is None else len(r) for r in rows], dtype=np.int64)
    matrix = np.zeros((len(rows), VECTOR_DIM))
    if lengths.sum():
        slots = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows if r is not None and len(r)])
        owner = np.repeat(np.arange(len(rows)), lengths)
        signs = np.where(slots < VECTOR_DIM, 1.0, -1.0)
        np.add.at(matrix, (owner, slots % VECTOR_DIM), signs)
    return matrix


def gram_hashes(text: str, chars: int, sample: int = 1):
    """Sorted 64-bit hashes of the different runs of `chars` characters of a text, one in `sample`."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes) - chars + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(chars):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n] + np.uint64(1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = np.unique(h ^ (h >> np.uint64(32)))
    return h[(h >> np.uint64(20)) % np.uint64(sample) == 0].view(np.int64)
