"""Conversation structure repair by depth-first branch and bound.

A conversation's rows, in order of turn, are repaired to role initials of the form (s?(ua)+)?. Edits: Keep, free, for a row whose
role initial fits; Rerole to user or assistant, 3; Delete, 4, required for blank and repeated rows; Insert an empty user or
assistant row, 3. A truncated row that is not deleted adds 3. Of the cheapest repairs the one with the least audit, the string of
the edits' initials, is taken; it determines the repaired rows.

The search: a node is (rows read, place in the pattern). An explicit stack holds prefixes (cost, audit); the cheapest
continuation of a prefix is bounded from below by the cheapest repair of the rows that are left, for which the end need not
complete the pattern. The incumbent is the best whole repair so far as (cost, audit); a prefix that cannot beat it goes, as does
one that comes to a node which a better prefix reached before (dominance tables). When the stack is empty the incumbent is
optimal. At equal cost no audit at a node is a prefix of another one there, so the comparison survives every continuation.

A conversation may hold any share of all rows. Its rows get positions in range slices and form segments of SEGMENT rows, which
are searched in parallel tasks: one search for each place in the pattern at the segment's start and end. A pass over the
segments in order keeps the best (cost, audit) for each place. The repaired rows are made in a second pass that streams the
texts in order, each segment's rows after its part of the audit; a digest of a conversation is sequential by nature, and that
pass holds one Arrow batch, whatever the conversation's size. Texts are shuffled once.

Defined results: null roles and texts count as one space, so they are blank, or fit no place; an empty role fits no place; rows
without turn come first and count for nothing in `gaps`; equal turns are ordered by role, then by a digest of the text; repeated
rows are repeats of each other and all but the first are deleted; null ids are one conversation; a conversation without rows has
no result here (the query fills in zeros); very long texts are read whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.ordered import ordered_prefix
from claimloom.storage import materialize

#: Rows of a segment, and solved segments that a task remembers.
SEGMENT, REMEMBERED = 256, 20_000
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
#: Places in the pattern: nothing yet, after s, after u, after a. The conversation may end at ENDS.
PLACES, ENDS = (0, 1, 2, 3), (0, 3)
_AFTER = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
_FIT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_INITIALS = "sua"
_KEY = ["conv", "turn", "role", "mark", "copy"]


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copy) after damage by crc32 of `conv:turn` modulo 20: 0 drops a row, 1 empties its text, 2 removes
    the text's sentence ends, 3 repeats the row, 4 makes it a user's. Nulls count as one space."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(read(conv), F.lit(":"), read(turn)).cast("binary")) % 20
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), read(role).alias("role"), read(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return named.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(copies).alias("copy"))


def _marked(rows: DataFrame) -> DataFrame:
    """The rows with `mark`, a digest of the text by which equal texts of a conversation are known and equal turns ordered."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    copy = F.col("copy") if "copy" in rows.columns else F.lit(0).alias("copy")
    return rows.select("conv", "turn", role, text, copy).withColumn("mark", F.substring(F.sha2("text", 256), 1, 32))


def classified(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, mark, copy, pos, initial, fault) of each row; fault is the first that applies of FAULTS, or null."""
    solid = F.rtrim("text", F.lit(BLANKS))
    own = F.when(F.length(solid) == 0, "blank").when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "truncated")
    slim = _marked(rows).select(*_KEY, own.alias("own"))
    placed = ordered_prefix(slim, ["turn", "role", "mark", "copy"], segment=["conv"])
    first = placed.groupBy(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("mark").alias("_m")).agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    same = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("mark") == F.col("_m"))
    joined = placed.join(first.where("_n > 1").drop("_n"), same, "left")
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("pos") > F.col("_first"), "duplicate").otherwise(F.col("own"))
    return joined.select(*_KEY, "pos", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _code() -> Column:
    """A row as one letter: its initial, upper case where it must go, and a digit in place of the letter's case for truncated."""
    initial = F.when(F.col("initial").isin(*_INITIALS), F.col("initial")).otherwise("x")
    return F.when(F.col("fault").isin("blank", "duplicate"), F.upper(initial)).when(F.col("fault") == "truncated", F.translate(initial, "suax", "1234")).otherwise(initial)


_READ = {c: (c, False, 0) for c in "suax"} | {c.upper(): (c, True, 0) for c in "suax"} | {d: (c, False, TRUNCATED) for c, d in zip("suax", "1234", strict=True)}


def suffix_bounds(codes: str) -> list[tuple[int, int, int, int]]:
    """For each number of rows read and each place, a lower bound on the cost of the rest: its cheapest repair if the end need
    not complete the pattern."""
    low = [(0, 0, 0, 0)]
    for code in reversed(codes):
        initial, goes, extra = _READ[code]
        after = low[-1]
        now = []
        for place in PLACES:
            least = DELETE + after[place]
            if not goes:
                least = min(least, REROLE + extra + after[_AFTER[place][0]])
                if (place, initial) in _FIT:
                    least = min(least, extra + after[_FIT[place, initial]])
            now.append(least)
        low.append(tuple(min(now[p], INSERT + now[_AFTER[p][0]]) for p in PLACES))
    return low[::-1]


def search(codes: str, start: int, ends: tuple[int, ...]) -> tuple[int, str, int] | None:
    """(cost, audit, end) of the best repair of `codes` from the place `start` to one of the places `ends`, None if there is
    none."""
    n, bounds, furthest = len(codes), suffix_bounds(codes), max(ends)
    best: tuple[int, str, int] | None = None
    reached: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    stack = [(0, start, 0, "")]
    reached[0][start] = (0, "")
    while stack:
        row, place, cost, audit = stack.pop()
        if reached[row][place] != (cost, audit):
            continue  # dominated meanwhile
        if best is not None and (cost + bounds[row][place], audit) > (best[0], best[1][: len(audit)]):
            continue
        if row == n and place in ends and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, place)
        moves = [(row, _AFTER[place][0], INSERT, "I")]
        if row < n:
            initial, goes, extra = _READ[codes[row]]
            moves.append((row + 1, place, DELETE, "D"))
            if not goes:
                moves.append((row + 1, _AFTER[place][0], REROLE + extra, "R"))
                if (place, initial) in _FIT:
                    moves.append((row + 1, _FIT[place, initial], extra, "K"))
        open_ = []
        for to, then, price, letter in moves:
            if furthest < 2 <= then:
                continue  # there is no way back before the first u
            label = (cost + price, audit + letter)
            held = reached[to].get(then)
            if held is None or label < held:
                reached[to][then] = label
                open_.append((label[0] + bounds[to][then], letter, (to, then, *label)))
        stack += [x[2] for x in sorted(open_, reverse=True)]  # the most promising on top
    return best


def _segments(rows: DataFrame, size: int) -> DataFrame:
    """(conv, segment, at, codes, pairs): the key of a segment's first row, its rows as letters, and its neighbours in wrong
    order; `head` and `tail` are the initials at its ends."""
    row = F.struct("pos", F.struct(*_KEY[1:]).alias("at"), _code().alias("code"), F.col("initial").alias("initial"))
    held = rows.withColumn("segment", F.floor((F.col("pos") - 1) / size)).groupBy("conv", "segment").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    initials = F.transform("rows", lambda r: r["initial"])
    pairs = F.transform(F.sequence(F.lit(1), F.size("rows") - 1), lambda k: F.concat(F.get("initials", k - 1), F.get("initials", k)))
    wrong = F.when(F.size("rows") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    named = held.withColumn("initials", initials)
    ends = [F.get("initials", F.lit(0)).alias("head"), F.get("initials", F.size("rows") - 1).alias("tail")]
    return named.select("conv", "segment", F.get("rows", F.lit(0))["at"].alias("at"), F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes"), wrong.cast("bigint").alias("wrong"), *ends)


_WAYS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_WAYS_SQL = "array<struct<start: int, end: int, cost: bigint, audit: string>>"


def _solved(segments: DataFrame, size: int) -> DataFrame:
    """`segments` with `ways`: the best repair from each place to each place. A segment that is not full is the last one."""

    def ways(codes: str, first: bool) -> list[dict]:
        out = []
        for start in PLACES[:1] if first else PLACES:
            for ends in [(e,) for e in PLACES] if len(codes) == size else [ENDS]:
                if (found := search(codes, start, ends)) is not None:
                    out.append({"start": start, "end": found[2], "cost": found[0], "audit": found[1]})
        return out

    def run(batches):
        known: dict[tuple[str, bool], list[dict]] = {}
        for batch in batches:
            made = []
            for key in zip(batch.column(3).to_pylist(), [s == 0 for s in batch.column(1).to_pylist()], strict=True):
                if key not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[key] = ways(*key)
                made.append(known[key])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, _WAYS)], names=[*batch.schema.names, "ways"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema.fields)
    return segments.mapInArrow(run, f"{fields}, ways {_WAYS_SQL}")


def _chosen(solved: DataFrame) -> DataFrame:
    """(conv, at, start, part, cost, audit, illegal): the chosen part of each segment, and in the first one's row the whole
    conversation's cost, audit and neighbours in wrong order."""
    kind = solved.schema["conv"].dataType.simpleString()
    at_kind = solved.schema["at"].dataType.simpleString()

    class Conversation:
        def __init__(self):
            self.states, self.seen, self.wrong, self.tail = {0: (0, "", ())}, [], 0, None

        def add(self, conv, at, wrong, head, tail, ways):
            if self.tail is not None and self.tail + head not in ("su", "ua", "au"):
                self.wrong += 1
            self.wrong, self.tail = self.wrong + wrong, tail
            self.seen.append((conv, at))
            after = {}
            for way in ways:
                if way["start"] in self.states:
                    cost, audit, path = self.states[way["start"]]
                    label = (cost + way["cost"], audit + way["audit"], (path, way["start"], way["audit"]))
                    if way["end"] not in after or label[:2] < after[way["end"]][:2]:
                        after[way["end"]] = label
            self.states = after

        def rows(self):
            cost, audit, path = min((self.states[p] for p in ENDS if p in self.states), key=lambda s: s[:2])
            parts = []
            while path:
                path, start, part = path
                parts.append((start, part))
            for k, ((conv, at), (start, part)) in enumerate(zip(self.seen, reversed(parts), strict=True)):
                whole = (cost, audit, self.wrong) if k == 0 else (None, None, None)
                yield dict(zip(names, (conv, at, start, part, *whole), strict=True))

    names = ["conv", "at", "start", "part", "cost", "audit", "illegal"]

    def run(batches):
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] == 0:
                    held += now.rows() if now else ()
                    now = Conversation()
                now.add(row["conv"], row["at"], row["wrong"], row["head"], row["tail"], row["ways"])
            if held:
                yield pa.RecordBatch.from_pylist(held, schema(batch))
                held = []
            last = batch
        if now:
            yield pa.RecordBatch.from_pylist(list(now.rows()), schema(last))

    def schema(batch):
        kinds = [batch.schema.field("conv").type, batch.schema.field("at").type, pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.schema(list(zip(names, kinds, strict=True)))

    dealt = solved.repartition("conv").sortWithinPartitions("conv", "segment")
    return dealt.mapInArrow(run, f"conv {kind}, at {at_kind}, start int, part string, cost bigint, audit string, illegal bigint")


def _walk(batches) -> Iterator[tuple]:
    """(conv, role, text, edit) of the repaired rows, from batches of rows and, not after each segment's first row, its part of
    the audit; (conv, None, None, None) ends a conversation. Parts wait in a queue, as rows that repeat others may straddle two
    segments and then sort after the second one's part."""
    parts, part, used, place, conv = deque(), None, 0, 0, None

    def ready(last: bool):
        """Insertions up to the next edit of a row."""
        nonlocal part, used, place
        while True:
            while part is not None and used < len(part) and part[used] == "I":
                used += 1
                place, role = _AFTER[place]
                yield conv, role, "", "I"
            if part is not None and used < len(part) or not parts:
                break
            place, part = parts.popleft()
            used = 0
        if last and part is not None:
            yield conv, None, None, None
            part = None

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] is not None:
                if row["opens"]:
                    yield from ready(True)
                    conv = row["conv"]
                parts.append((row["start"], row["part"]))
                continue
            yield from ready(False)
            edit = part[used]
            used += 1
            if edit == "K":
                place = _FIT[place, row["role"][0]]
                yield conv, row["role"], row["text"], edit
            elif edit == "R":
                place, role = _AFTER[place]
                yield conv, role, row["text"], edit
    yield from ready(True)


def _streamed(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows with their texts and the parts of the audit, a conversation in one task in order."""
    none = F.lit(None)
    body = _marked(rows).select(*_KEY, F.lit(1).alias("kind"), "text", none.cast("string").alias("part"), none.cast("int").alias("start"), none.cast("boolean").alias("opens"))
    marks = chosen.select("conv", "at.*", F.lit(0).alias("kind"), none.cast("string").alias("text"), "part", "start", F.col("cost").isNotNull().alias("opens"))
    return body.unionByName(marks).repartition("conv").sortWithinPartitions("conv", *[F.col(c).asc_nulls_first() for c in _KEY[1:]], "kind")


def repaired_rows(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv, place, role, text, edit): the rows of the repaired conversations, place from 1."""
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches):
        held, place, last = [], 0, None

        def watched():
            nonlocal last
            for batch in batches:
                last = batch
                yield batch

        for conv, role, text, edit in _walk(watched()):
            place = place + 1 if role is not None else 0
            if place:
                held.append((conv, place, role, text, edit))
            if len(held) >= 1_000:
                yield packed(held, last)
                held = []
        if held:
            yield packed(held, last)

    def packed(held, batch):
        kinds = [batch.schema.field("conv").type, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["conv", "place", "role", "text", "edit"])

    return _streamed(rows, chosen).mapInArrow(run, f"conv {kind}, place bigint, role string, text string, edit string")


def digests(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv, digest): SHA-256 (lowercase hex) of each repaired conversation's `role:text` lines."""
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches):
        state, fresh, held, last = hashlib.sha256(), True, [], None

        def watched():
            nonlocal last
            for batch in batches:
                last = batch
                yield batch

        for conv, role, text, _ in _walk(watched()):
            if role is None:
                held.append((conv, state.hexdigest()))
                state, fresh = hashlib.sha256(), True
                continue
            state.update(f"{'' if fresh else chr(10)}{role}:{text}".encode())
            fresh = False
            if len(held) >= 10_000:
                yield packed(held, last)
                held = []
        if held:
            yield packed(held, last)

    def packed(held, batch):
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], batch.schema.field("conv").type), pa.array([h[1] for h in held])], names=["conv", "digest"])

    return _streamed(rows, chosen).mapInArrow(run, f"conv {kind}, digest string")


def repair(rows: DataFrame, size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(facts, chosen) of damaged or other rows (conv, turn, role, text, copy). Facts, one row a conversation: conv, gaps, the
    number of rows with each fault, illegal (neighbours whose initials are none of su, ua, au), cost, audit. `chosen` is for
    `repaired_rows` and `digests`."""
    found = materialize(classified(rows), "classified")
    chosen = materialize(_chosen(_solved(_segments(found, size), size)), "chosen")
    turns = found.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in FAULTS])
    gap = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps")
    counts = turns.groupBy(F.col("conv").alias("_c")).agg(gap, *[F.sum(f).alias(f) for f in FAULTS])
    whole = chosen.where("cost is not null").select("conv", "illegal", "cost", "audit")
    facts = whole.join(counts, F.col("conv").eqNullSafe(F.col("_c"))).select("conv", "gaps", *FAULTS, "illegal", "cost", "audit")
    return facts, chosen
