import os
import random
import time

import numpy as np
from pyspark.sql import functions as F

from claimloom import storage
from claimloom.llm import linking


def link(spark, sets, star, part=4, whole=5):
    """{node: component} of sets that share one bucket, with the given star."""
    rows = [(1, k, len(s), int(k != star)) for k, s in sets.items()]
    buckets = spark.createDataFrame(rows, "key long, node long, n long, rank int")
    table = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "node long, tokens array<bigint>")
    found = linking.linked(buckets, lambda nodes: table.join(F.broadcast(nodes), "node", "left_semi"), part, whole)
    return {r["node"]: r["component"] for r in found.collect()}


def brute(sets, part=4, whole=5):
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common * whole >= (len(sets[a]) + len(sets[b]) - common) * part:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    count = list(root.values())
    return {k: r for k, r in root.items() if count.count(r) > 1}


def test_partner_linked_with_the_star(spark):
    """The member of 36 has 19 differences to the star and a link with the member of 45 that is linked with the star."""
    star, edited = set(range(45)), set(range(5, 50))
    sets = {1: star, 2: edited, 3: set(range(14, 50))}
    assert len(star & edited) == 40 and len(sets[3] & star) == 31
    assert link(spark, sets, 1) == brute(sets) == {1: 1, 2: 1, 3: 1}


def test_truncated_copies_of_edited_copies(spark):
    rng = random.Random(5)
    for part, whole in ((4, 5), (1, 2)):
        sets = {0: set(range(90))}
        for k in range(1, 40):
            edited = set(range(90)) - set(rng.sample(range(90), rng.randrange(12))) | {1000 * k + j for j in range(rng.randrange(12))}
            sets[k] = edited
            sets[100 + k] = set(rng.sample(sorted(edited), max(46, len(edited) * part // whole + rng.randrange(3))))
        assert link(spark, sets, 0, part, whole) == brute(sets, part, whole)


def written(spark):
    folder = f"{storage.shared_dir(spark).removeprefix('file://')}/claimloom"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_tables_go_when_they_are_used(spark):
    """Sets, pairs, stars and facts are larger than the texts; of all of them only the components stay."""
    rng = random.Random(6)
    base = set(range(90))
    sets = {k: (base - set(rng.sample(range(90), 8 + k % 9))) | {1000 * k + j for j in range(k % 9)} for k in range(40)}
    before = written(spark)
    assert link(spark, sets, 0) == brute(sets)
    assert not {name[: name.index("-")] for name in written(spark) - before} & {"members", "pairs", "sets", "stars", "facts"}


def test_shuffle_files_go_with_a_written_table(spark):
    """They stayed until the driver collected its garbage."""
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {f for top in folder for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before, setting = shuffled(), spark.conf.get(storage.CLEANUP_CONF)
    table = storage.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "few")
    deadline = time.time() + 20
    while shuffled() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(storage.CLEANUP_CONF) == setting and table.count() == 7
    path = storage._written[table]
    storage.discard(table)
    assert not os.path.exists(path.removeprefix("file://"))


def test_blocks_of_few_tokens(spark, monkeypatch):
    """Long differences make more blocks: a block is bounded by its tokens, not by its members alone."""
    rng = random.Random(7)
    base = list(range(300))
    sets = {0: set(base)}
    for k in range(1, 30):
        sets[k] = set(rng.sample(base, 230 + k % 5)) | {1000 * (k // 3) + j for j in range(60)}
    whole = link(spark, sets, 0)
    for limit in (1, 400):
        monkeypatch.setattr(linking, "BLOCK_TOKENS", limit)
        assert link(spark, sets, 0) == whole == brute(sets)


def test_intersections_of_many_rows(monkeypatch):
    """Rows of a batch are counted together, tokens that many members have by a product; nothing is a Python list."""
    rng = np.random.default_rng(8)
    for cells, sparse, rows in ((1 << 20, 64, 1), (1 << 20, 64, 4), (40, 64, 3), (40, 1, 1)):
        monkeypatch.setattr(linking, "CELLS", cells)
        monkeypatch.setattr(linking, "SPARSE", sparse)
        sides, members = [], []
        for _ in range(2):
            counts = rng.integers(1, 20, rows)
            lists = [rng.choice(50, rng.integers(0, 15), replace=False).astype(np.int64) * (1 << 50) - 3 for _ in range(counts.sum())]
            sides.append((counts, np.array([len(x) for x in lists]), np.concatenate(lists)))
            members.append(lists)
        want, x0, y0 = [], 0, 0
        for n, m in zip(sides[0][0], sides[1][0], strict=True):
            want += [(i, j, len(np.intersect1d(members[0][i], members[1][j]))) for i in range(x0, x0 + n) for j in range(y0, y0 + m)]
            x0, y0 = x0 + n, y0 + m
        assert [*zip(*(v.tolist() for v in linking._intersections(*sides)), strict=True)] == want
