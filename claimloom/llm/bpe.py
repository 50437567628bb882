"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The text is cut by a pre-token pattern; each pre-token is merged by itself. The merge loop keeps, for every merge rank, a
bucket with the linked-list positions at which that pair may be merged. A bitmap of three levels of 64-bit words marks the
buckets in use; find-first-set names the lowest rank, whose bucket is emptied in order of position. Entries whose pair has
changed meanwhile are stale and skipped. The cost of a pre-token is linear in its length but for the bitmap's constant, so
very long pre-tokens do no harm.

The same loop runs over all pre-tokens of a block that are not in the worker's cache at once: their lists lie in one array
with breaks between them, and a bucket is emptied by array operations. Where a merge makes a pair of lower rank than its own,
which the rank order of a trained vocabulary hardly allows, the pre-token is merged again by itself, one position at a time.

Defined results: null and empty texts give no ids and decode to empty bytes; repeated rows are encoded alike; other columns
are kept. Special tokens are never produced: their strings are ordinary text. A byte that is not in the vocabulary, or an id
that is unknown to the decoder, raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import weakref
from array import array
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import arrays

NO_RANK = 1 << 30
#: Pre-tokens kept by a worker, and the length up to which they are kept.
CACHE_ENTRIES, CACHE_LENGTH = 100_000, 48
#: Bytes of text in a block of documents whose new pre-tokens are merged together. A block holds four bytes for each
#: pre-token and each different one once.
BLOCK_BYTES = 4_000_000
#: Pairs that are looked up at a time.
LOOKUP = 1 << 17
#: Below this many bytes of new pre-tokens, position by position is faster.
ARRAY_BYTES = 150_000


class Vocabulary:
    """Token bytes by rank, and a hash table from pairs of ids to the rank of the merged token."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= NO_RANK:
            raise ValueError("ranks are too large")
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK, np.int64)
        self.pairs = pairs
        todo, rank = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        slot = self._slot(todo)
        while len(todo):  # linear probing: of the keys that want a free slot the last one gets it
            free = self.keys[slot] < 0
            self.keys[slot[free]] = todo[free]
            won = self.keys[slot] == todo
            self.values[slot[won]] = rank[won]
            todo, rank, slot = todo[~won], rank[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, NO_RANK where they don't merge."""
        if len(left) > LOOKUP:
            cuts = range(0, len(left), LOOKUP)
            return np.concatenate([self.ranks_of(left[k : k + LOOKUP], right[k : k + LOOKUP]) for k in cuts])
        keys = left << 32 | right
        slot = self._slot(keys)
        out = np.full(len(keys), NO_RANK, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[slot]
            same = held == keys[open_]
            out[open_[same]] = self.values[slot[same]]
            on = ~same & (held >= 0)
            open_, slot = open_[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def __getstate__(self):
        return self.tokens

    def __setstate__(self, tokens):
        self.__init__({token: rank for rank, token in tokens.items()})


def load(path: str) -> Vocabulary:
    """A vocabulary from a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})


class RankQueue:
    """Buckets by rank under a bitmap of three levels; `first` finds the lowest rank in use."""

    def __init__(self):
        self.buckets: dict[int, list] = {}
        self.levels: list[dict[int, int]] = [{}, {}, {}]
        self.top = 0

    def add(self, rank: int, entry) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(entry)
            return
        self.buckets[rank] = [entry]
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            held = level.get(word, 0)
            level[word] = held | bit
            if held:
                return
            rank = word
        self.top |= 1 << rank

    def first(self) -> int | None:
        """The lowest rank with a bucket: one find-first-set per level."""
        if not self.top:
            return None
        rank = (self.top & -self.top).bit_length() - 1
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        return rank

    def take(self, rank: int) -> list:
        entries = self.buckets.pop(rank)
        for level in self.levels:
            word = rank >> 6
            level[word] &= ~(1 << (rank & 63))
            if level[word]:
                return entries
            del level[word]
            rank = word
        self.top &= ~(1 << rank)
        return entries


def merge_one(raw: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one pre-token, one merge at a time."""
    pairs = vocabulary.pairs
    ids = vocabulary.byte_ids[np.frombuffer(raw, np.uint8)].tolist()
    if -1 in ids:
        raise ValueError("the vocabulary lacks a byte")
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    now = [pairs.get(ids[k] << 32 | ids[k + 1], NO_RANK) for k in range(n - 1)] + [NO_RANK]
    queue = RankQueue()
    for k in range(n - 1):
        if now[k] < NO_RANK:
            queue.add(now[k], k)
    while (rank := queue.first()) is not None:
        bucket, at = sorted(set(queue.take(rank))), 0
        while at < len(bucket):
            k = bucket[at]
            at += 1
            if now[k] != rank:
                continue  # stale
            gone = after[k]
            ids[k], now[gone] = rank, NO_RANK
            after[k] = right = after[gone]
            if right < n:
                before[right] = k
            lower = False
            for left, other in ((before[k], k), (k, right)):
                if left < 0:
                    continue
                now[left] = pairs.get(ids[left] << 32 | ids[other], NO_RANK) if other < n else NO_RANK
                if now[left] < NO_RANK:
                    queue.add(now[left], left)
                    lower |= now[left] < rank
            if lower:  # a lower rank goes first; what is left of this bucket waits
                for k in bucket[at:]:
                    queue.add(rank, k)
                break
    out, k = [], 0
    while k < n:
        out.append(ids[k])
        k = after[k]
    return out


def merge_many(raws: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """For each pre-token, none empty, its ids as little-endian unsigned 32-bit integers."""
    if sum(map(len, raws)) < ARRAY_BYTES:
        return [np.array(merge_one(raw, vocabulary), "<u4").tobytes() for raw in raws]
    lengths = np.fromiter(map(len, raws), np.int64, len(raws))
    ends = np.cumsum(lengths)
    ids = vocabulary.byte_ids[np.frombuffer(b"".join(raws), np.uint8)]
    if (ids < 0).any():
        raise ValueError("the vocabulary lacks a byte")
    n = len(ids)
    # position n stands for "none": it never merges
    ids = np.append(ids, 0)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1], before[ends - lengths] = n, n
    after[n] = before[n] = n
    inner = np.flatnonzero(after[:n] != n)
    now = np.full(n + 1, NO_RANK, np.int64)
    now[inner] = vocabulary.ranks_of(ids[inner], ids[inner + 1])
    again, dead = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    queue = RankQueue()

    def enter(at: np.ndarray) -> None:
        at = at[now[at] < NO_RANK]
        if not len(at):
            return
        at = at[np.argsort(now[at], kind="stable")]
        ranks = now[at]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
            queue.add(rank, part)

    enter(inner)
    while (rank := queue.first()) is not None:
        parts = queue.take(rank)
        at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        at = at[now[at] == rank]  # the others are stale
        if not len(at):
            continue
        if len(at) > 1:
            chained = np.append(False, after[at[:-1]] == at[1:])
            if chained.any():  # of overlapping pairs every second one, from the left
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
        gone = after[at]
        right = after[gone]
        follows = vocabulary.ranks_of(np.full(len(at), rank), ids[right])
        again[at[(follows < rank) & (right < n)]] = True
        ids[at], now[gone], dead[gone], after[at] = rank, NO_RANK, True, right
        before[right] = at
        before[n] = n
        left = before[at]
        touched = np.unique(np.concatenate((at, left[left < n])))
        other = after[touched]
        fresh = np.where(other < n, vocabulary.ranks_of(ids[touched], ids[other]), NO_RANK)
        now[touched] = fresh
        again[touched[fresh < rank]] = True
        enter(touched)
    alive = ~dead[:n]
    stops = np.cumsum(alive)[ends - 1] * 4
    blob = ids[:n][alive].astype("<u4").tobytes()
    out = [blob[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
    for row in np.unique(np.searchsorted(ends, np.flatnonzero(again[:n]), "right")).tolist():
        out[row] = np.array(merge_one(raws[row], vocabulary), "<u4").tobytes()
    return out


class _Worker:
    """Encodes the blocks of one task with a bounded cache of pre-tokens. The vocabulary is the caller's to keep."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.cut, self.cache = weakref.proxy(vocabulary), regex.compile(pattern).findall, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        places = defaultdict(count().__next__)  # the block's different pre-tokens in order
        cut = [array("i", map(places.__getitem__, self.cut(text))) for text in texts]
        known = self.cache
        ids = list(map(known.get, places))
        fresh = [token for token, held in zip(places, ids, strict=True) if held is None]
        made = merge_many([token.encode() for token in fresh], self.vocabulary)
        for token, found in zip(fresh, made, strict=True):
            ids[places[token]] = found
            if len(token) <= CACHE_LENGTH:
                if len(known) >= CACHE_ENTRIES:
                    known.clear()
                known[token] = found
        return [b"".join(map(ids.__getitem__, tokens)) for tokens in cut]

    def decode(self, ids: bytes) -> bytes:
        try:
            return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except KeyError as unknown:
            raise ValueError(f"unknown id {unknown}") from None


def _gathered(batches):
    """Batches of about BLOCK_BYTES, from smaller ones, so that blocks are full whatever the session's batch size."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _mapped(df: DataFrame, source, added: dict[str, str], work) -> DataFrame:
    """`df` with the columns `added` (name, type), made by work(list) from the column `source`, in blocks."""
    names, kinds = list(added), [pa.string() if kind == "string" else pa.binary() for kind in added.values()]

    def run(batches):
        step = work()
        for batch in _gathered(batches):
            cuts, _ = arrays.column_bytes(batch.column(batch.num_columns - 1))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + BLOCK_BYTES, "right")) - 1)
                part = batch.slice(at, end - at)
                made = step(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(m, kind) for m, kind in zip(made, kinds, strict=True)]], names=[*part.schema.names[:-1], *names])
                at = end

    kept = [c for c in df.columns if c not in added]
    base = df.select(*[F.col(f"`{c}`") for c in kept])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields] + [f"`{c}` {kind}" for c, kind in added.items()]
    return df.select(*[F.col(f"`{c}`") for c in kept], source.alias("_source")).mapInArrow(arrays.trimmed(run), ", ".join(fields))


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with a binary column `ids`: the token ids as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work():
        worker = _worker(shared, pattern)
        return lambda texts: [worker.encode(texts)]

    return _mapped(docs, F.coalesce(F.col(text), F.lit("")), {ids: "binary"}, work)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`encoded` with a binary column `decoded`: the bytes that the ids stand for. Null ids decode to empty bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def work():
        worker = _worker(shared, "")
        return lambda values: [[worker.decode(x) for x in values]]

    return _mapped(encoded, F.coalesce(F.col(ids), F.lit(b"")), {decoded: "binary"}, work)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`docs` with both columns, encoded and decoded in one pass."""
    return _both(docs, vocabulary, pattern, text, {ids: "binary", decoded: "binary"}, lambda raw: raw)


def checked(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text", ids: str = "ids", digest: str = "decoded_sha256") -> DataFrame:
    """`docs` with the ids and the SHA-256 (lowercase hex) of the decoded bytes, which stay in the worker."""
    return _both(docs, vocabulary, pattern, text, {ids: "binary", digest: "string"}, lambda raw: hashlib.sha256(raw).hexdigest())


def _both(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text: str, added: dict[str, str], finish) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work():
        worker = _worker(shared, pattern)

        def both(texts):
            encoded = worker.encode(texts)
            return [encoded, [finish(worker.decode(x)) for x in encoded]]

        return both

    return _mapped(docs, F.coalesce(F.col(text), F.lit("")), added, work)


_workers: weakref.WeakKeyDictionary[Vocabulary, dict[str, _Worker]] = weakref.WeakKeyDictionary()


def _worker(shared, pattern: str) -> _Worker:
    """The Python worker's encoder for a broadcast vocabulary; kept over tasks, one at a time. It goes with the broadcast, which Spark
    takes from a worker whose next task doesn't use it."""
    vocabulary = shared.value
    held = _workers.get(vocabulary, {}).get(pattern)
    if held is None:
        _workers.clear()
        held = _Worker(vocabulary, pattern)
        _workers[vocabulary] = {pattern: held}
    return held
