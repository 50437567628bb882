import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from claimloom.llm import conversations as cv


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        read = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{read[0]}:{read[1]}".encode()) % 20
        role, text = "user" if kind == 4 else read[2], "" if kind == 1 else re.sub("[.!?]", "", read[3]) if kind == 2 else read[3]
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(initials, fault):
    """(cost, audit, emitted) by a table over all rows and patterns: an own method, no search."""
    best = {"": (0, "", ())}  # by what was emitted last: nothing, s, u, a

    def put(table, key, label):
        if key not in table or label[:2] < table[key][:2]:
            table[key] = label

    following = {"": "us", "s": "u", "u": "a", "a": "u"}

    def inserted(table):
        for _ in range(3):
            for key, (cost, audit, made) in list(table.items()):
                to = following[key][0]
                put(table, to, (cost + 3, audit + "I", (*made, (None, to))))
        return table

    best = inserted(best)
    for k, (initial, f) in enumerate(zip(initials, fault, strict=True)):
        after = {}
        for key, (cost, audit, made) in best.items():
            put(after, key, (cost + 4, audit + "D", made))
            if f not in ("blank", "duplicate"):
                more = 3 if f == "truncated" else 0
                if initial and initial in following[key]:
                    put(after, initial, (cost + more, audit + "K", (*made, (k, None))))
                to = following[key][0]
                put(after, to, (cost + more + 3, audit + "R", (*made, (k, to))))
        best = inserted(after)
    return min((best[k] for k in ("", "a") if k in best), key=lambda s: s[:2])


def brute(rows):
    names = {"u": "user", "a": "assistant"}
    out = {}
    for conv in {r[0] for r in rows}:
        own = damaged([r for r in rows if r[0] == conv])
        mark = lambda r: hashlib.sha256(r[3].encode()).hexdigest()[:32]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], mark(r)))
        if not own:
            out[conv] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
            continue
        fault, initials = faults(own), [r[2][:1] for r in own]
        cost, audit, made = cheapest(initials, fault)
        lines = [f"{names[to] if to else own[k][2]}:{own[k][3] if k is not None else ''}" for k, to in made]
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv] = (gaps, *(fault.count(f) for f in cv.FAULTS), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    text = lambda: rng.choice(["Yes.", "No!", "well", "", " \n", "Ünd?\t", "a. b", "x" * rng.randrange(9), "Yes."])
    for conv in range(70):
        turn = 0
        for _ in range(rng.choice([1, 2, 3, 5, 8, 20])):
            turn += rng.choice([0, 1, 1, 1, 2])
            rows.append((conv, rng.choice([turn] * 15 + [None]), rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"]), rng.choice([text(), text(), None, f"fine {turn}."])))
    rows += [(500, k, "assistant" if k % 2 else "user", f"Turn {k}." if k % 7 else "cut") for k in range(400)]
    rows += [(501, k % 5, "system", "Same.") for k in range(60)] + [(None, 1, "user", "Null id."), (None, None, None, None)]
    return rows


def found(spark, rows, size):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("clash")).repartition(3)
    damaged_ = cv.damage(table)
    facts, chosen = cv.repair(damaged_, size)
    digest = {r["conv"]: r["digest"] for r in cv.digests(damaged_, chosen).collect()}
    got = {r["conv"]: (*tuple(r)[1:], digest[r["conv"]]) for r in facts.collect()}
    assert len(got) == facts.count() == len(digest)
    return got, cv.repaired_rows(damaged_, chosen)


@pytest.mark.parametrize(("seed", "size"), [(1, 256), (2, 3), (3, 1), (4, 7)])
def test_equals_a_table_of_all_repairs(spark, seed, size):
    rows = corpus(seed)
    got, repaired = found(spark, rows, size)
    want = {c: w for c, w in brute(rows).items() if w[5] or w[6] or any(w[:5])}
    assert got == want
    made = {}
    for r in sorted(repaired.collect(), key=lambda r: (str(r["conv"]), r["place"])):
        made.setdefault(r["conv"], []).append((r["role"], r["text"], r["edit"]))
    for conv, row in want.items():
        own = made.get(conv, [])
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b, _ in own).encode()).hexdigest() == row[7]
        assert "".join(e for *_, e in own) == row[6].replace("D", "") and re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, *_ in own))


def test_search_is_exhaustive():
    """Against all edit strings of short conversations, with no table in between."""
    rng = random.Random(8)
    for _ in range(60):
        codes = "".join(rng.choices("suaxSUAX1234", k=rng.randrange(0, 4)))
        best = None
        for n in range(len(codes) + 5):
            for audit in map("".join, itertools.product("DIKR", repeat=n)):
                if sum(c != "I" for c in audit) != len(codes):
                    continue
                place, cost, k = 0, 0, 0
                for letter in audit:
                    initial, goes, extra = cv._READ[codes[k]] if letter != "I" else ("", False, 0)
                    k += letter != "I"
                    if letter in "KR" and goes or letter == "K" and (place, initial) not in cv._FIT:
                        break
                    cost += {"I": 3, "D": 4, "R": 3 + extra, "K": extra}[letter]
                    place = place if letter == "D" else cv._FIT[place, initial] if letter == "K" else cv._AFTER[place][0]
                else:
                    if place in cv.ENDS and (best is None or (cost, audit) < best):
                        best = (cost, audit)
        assert cv.search(codes, 0, cv.ENDS)[:2] == best


def test_search_stays_small():
    """Long and hostile segments: the bounds and the dominance tables keep the search near the number of nodes."""
    rng = random.Random(9)
    for codes in ("s" * 256, "ua" * 128, "U" * 256, "1" * 256, "x" * 256, "uuaas" * 51, "".join(rng.choices("suaxSUAX1234", k=256))):
        for start in cv.PLACES:
            assert cv.search(codes, start, cv.ENDS) is not None
            for end in cv.PLACES:
                cv.search(codes, start, (end,))


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    facts, chosen = cv.repair(cv.damage(table))
    assert facts.count() == cv.digests(cv.damage(table), chosen).count() == cv.repaired_rows(cv.damage(table), chosen).count() == 0
