"""Vectorised text helpers for Arrow batches: whole-batch word cutting and rolling hashes.

Work goes in blocks of about BLOCK_BYTES of text, so the temporary arrays of a task stay small whatever the size of an
Arrow batch. A text is never cut: one that is longer than a block forms a block of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: Blocks of steps that hold several 64-bit arrays with an entry for each byte.
SMALL_BLOCK_BYTES = 1 << 18
_SEED = np.random.default_rng(20240611)
_BYTE_VALUES = {stream: _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for stream in (0, 1)}
_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`work` over a task's batches, with what it has freed given back at its end: Spark keeps Python workers, and what an idle one
    still holds adds to the memory of the steps that follow."""

    @wraps(work)
    def run(batches):
        yield from work(batches)
        trim()

    return run


def byte_table(excluded: bytes) -> np.ndarray:
    """Lookup table that is true for every byte outside `excluded`."""
    table = np.ones(256, bool)
    table[list(excluded)] = False
    return table


#: ASCII blanks: space and the controls 0x09-0x0D.
BLANKS = b" \t\n\x0b\x0c\r"
NOT_BLANK = byte_table(BLANKS)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, data) of a string or binary column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return cuts, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) for runs of rows with about `limit` bytes."""
    cuts, data = column_bytes(column)
    first, rows = 0, len(cuts) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + limit, "right")) - 1)
        yield first, cuts[first : last + 1] - cuts[first], data[cuts[first] : cuts[last]]
        first = last


def cut_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of maximal runs of word bytes; a run never crosses a text's end."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = inside[data]
    fresh = np.empty(len(data), bool)
    fresh[0] = True
    np.logical_not(word[:-1], out=fresh[1:])
    edges = offsets[:-1][offsets[:-1] < len(data)]
    fresh[edges] = True
    starts = np.flatnonzero(word & fresh)
    final = np.empty(len(data), bool)
    final[-1] = True
    np.logical_not(word[1:], out=final[:-1])
    tails = offsets[1:] - 1
    final[tails[tails >= 0]] = True
    ends = np.flatnonzero(word & final) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for k, base in enumerate((_FACTOR, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stream: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span; `stream` picks one of two independent hashes."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[stream][data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` consecutive word hashes, texts ignored."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total *= _STEP
        total += words[k : k + n]
    return mix(total)


def same_text(texts: np.ndarray, size: int) -> np.ndarray:
    """True for each window of `size` words that lies within one text."""
    n = len(texts) - size + 1
    return texts[:n] == texts[size - 1 :] if n > 0 else np.zeros(0, bool)


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte position, one entry more than there are bytes."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
