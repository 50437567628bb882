"""Components of a similarity graph from candidate buckets, without all pairs of a bucket.

Input: sets (node, tokens: distinct 64-bit hashes) and buckets (key, node), such that any two sets that are similar enough
meet in some bucket. Three steps give the exact components:

1. Star: every member of a bucket is compared with the bucket's star only, the node of least rank (the caller ranks texts with
   few unshared tokens first: the middle of a group of near copies). Members linked with their star need no comparison with
   each other.
2. Differences: for a member i that is not linked with its star s, let D(i) be the symmetric difference of i and s. The
   difference of i and another member j is that of D(i) and D(j), so whether they are linked follows from |D(i)|, |D(j)| and the
   size of their intersection. Differences are small, and only tokens that two members differ in matter for the intersection.
   The unlinked members of a star meet its members in blocks of about BLOCK rows; the intersections of two blocks are a matrix
   product. Rows are blocks, never pairs. Members with more differences than a member linked with both could have can only be
   linked with other unlinked members whose differences are about as many; they are few and are paired within their buckets.
3. Members whose size forbids a link with the star are paired with the members of the bucket whose size allows one.

A large group of near copies costs about one comparison a member and star. Stars are found by an aggregate with map-side
combine, and the joins on hot keys can be split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm import arrays
from claimloom.llm.graph import components
from claimloom.storage import discard, materialize

#: Rows of node ids up to which a list of nodes is broadcast to a scan; beyond that it is joined by shuffle.
BROADCAST_NODES = 1_000_000
#: Members and differing tokens of a block of step 2, tokens of a matrix product at a time, pairs of members counted at a time, and
#: how many pairs of a product cost one that is counted.
BLOCK, BLOCK_TOKENS, TOKENS, CELLS, SPARSE = 1_024, 1 << 18, 2_048, 1 << 20, 64
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def narrowed(nodes: DataFrame) -> DataFrame:
    """A one-column list of nodes, marked for broadcast when its measured size allows it."""
    return F.broadcast(nodes) if nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else nodes


def sizes_allow(a: Column, b: Column, part: int, whole: int) -> Column:
    return F.least(a, b) * whole >= F.greatest(a, b) * part


def with_overlap(pairs: DataFrame, sets: DataFrame, *more: Column) -> DataFrame:
    """`pairs` (a, b) with n_a, n_b, `common`, the size of the intersection, and `more` columns of tokens_a and tokens_b."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b"))
    sizes = [F.size("tokens_a").alias("n_a"), F.size("tokens_b").alias("n_b"), F.size(F.array_intersect("tokens_a", "tokens_b")).alias("common")]
    return pairs.join(left, "a").join(right, "b").select("a", "b", *sizes, *more)


def is_link(part: int, whole: int) -> Column:
    common = F.col("common").cast("bigint")
    return common * whole >= (F.col("n_a") + F.col("n_b") - common) * part


def linked(buckets: DataFrame, token_sets: Callable[[DataFrame], DataFrame], part: int, whole: int, blocks_only: bool = False) -> DataFrame:
    """(node, component) of all nodes with a link: sets whose Jaccard similarity is at least part / whole.

    `buckets` has key, node, n, the size of the node's set, and rank, the same in all rows of a node: the least rank makes the
    star. `token_sets` gives the sets (node, tokens) of a list of nodes. With `blocks_only`, for small sets, all members that are
    not linked with their star, whatever their size, keep their differences and are compared in blocks: nothing is paired by
    bucket.
    """
    stars = buckets.groupBy("key").agg(F.min(F.struct("rank", "node", "n")).alias("star"), F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    members = buckets.join(stars.select("key", F.col("star.node").alias("star"), F.col("star.n").alias("n_star")), "key").where("node <> star")
    members = materialize(members.select("key", "star", "n_star", "node", "n").distinct(), "members")
    fit = F.lit(True) if blocks_only else sizes_allow(F.col("n"), F.col("n_star"), part, whole)
    pairs = materialize(members.where(fit).select(F.col("star").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialize(token_sets(nodes), "sets")
    # a star's only member has nobody to be compared with, so its differences are not kept
    counted = pairs.join(pairs.groupBy("a").agg((F.count(F.lit(1)) > 1).alias("several")), "a")
    differences = F.concat(F.array_except("tokens_b", "tokens_a"), F.array_except("tokens_a", "tokens_b"))
    first = with_overlap(counted, sets, F.when(F.col("several"), differences).alias("d"), F.col("several"))
    # With n and m the sizes, a link allows (n + m) * share differences, and linked sizes are at most whole / part apart.
    # most: those of any link of the member; near: those of a member with a partner that is linked with the star;
    # wide: those of any partner of a near member. A member that is not near has unlinked partners only.
    share = lambda n: F.floor(n * (whole - part) / (whole + part)).cast("bigint")
    largest = lambda n: F.floor(n * whole / part)
    n, partner = F.col("n_b"), largest(F.col("n_b"))
    bounds = {"most": share(n + partner), "near": share(n + 2 * partner + F.col("n_a")), "wide": share(n + 2 * partner + 2 * largest(partner) + F.col("n_a"))}
    first = first.withColumns({"link": is_link(part, whole), "far": F.size("d").cast("bigint"), **bounds})
    if not blocks_only:
        first = first.withColumn("d", F.when(F.col("far") <= F.col("wide"), F.col("d")))
    first = materialize(first.drop("wide"), "stars")
    discard(sets, pairs)
    links = materialize(first.where("link").select("a", "b"), "links")
    used = [links]
    outside = first.where("several and not link").select("a").distinct()
    if outside.limit(1).count():
        before = materialize(components(links), "before").select(F.col("node").alias("b"), "component")
        facts = first.join(narrowed(outside), "a", "left_semi").join(before, "b", "left").select(
            F.col("a").alias("star"), F.col("b").alias("node"), F.col("n_b").cast("bigint").alias("n"), "far", "most", "near", "link", "d", F.coalesce("component", "b").alias("part_of")
        )
        facts = materialize(facts, "facts")
        used += [facts]
        loose = F.lit(True) if blocks_only else F.col("far") <= F.col("near")
        links = links.union(_by_differences(facts.where("d is not null"), loose, part, whole))
        if not blocks_only:
            links = links.union(_verified(_far_pairs(members, facts.where("not link").drop("d", "link"), part, whole), token_sets, part, whole))
    apart = members.where(~fit)
    if not blocks_only and apart.limit(1).count():
        links = links.union(_by_sizes(members, apart, token_sets, part, whole))
    out = components(links)
    discard(members, first, *used)
    return out


def _far_pairs(members: DataFrame, loose: DataFrame, part: int, whole: int) -> DataFrame:
    """Candidate pairs (a, b) of members far from their star with other unlinked members of a bucket."""
    placed = members.select("key", "star", "node").join(loose, ["star", "node"]).drop("star")
    x, y = placed.where("far > near").alias("x"), placed.alias("y")
    differ = (F.col("x.node") != F.col("y.node")) & (F.col("x.part_of") != F.col("y.part_of")) & sizes_allow(F.col("x.n"), F.col("y.n"), part, whole)
    bridged = F.abs(F.col("x.far") - F.col("y.far")) <= F.greatest("x.most", "y.most")
    met = x.join(y, F.col("x.key") == F.col("y.key")).where(differ & bridged)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _by_differences(facts: DataFrame, loose: Column, part: int, whole: int) -> DataFrame:
    """Links (a, b) of step 2 from the unlinked members that are `loose`. Sets of sizes n and m are linked exactly when their symmetric
    difference is at most (n + m) * (whole - part) / (whole + part)."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.size("d")) / BLOCK_TOKENS))
    counts = facts.groupBy("star").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("held")).where("held > 1").drop("held")
    row = F.struct("node", "n", "far", "part_of", "d")
    dealt = facts.join(counts, "star").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("mate", ~F.col("link") & loose)
    x = dealt.where("mate").groupBy("star", "block").agg(F.collect_list(row).alias("x"))
    y = dealt.groupBy("star", "block", "mate").agg(F.collect_list(row).alias("y")).withColumnRenamed("block", "other")
    # two blocks of unlinked members meet once
    met = x.join(y, "star").where(~F.col("mate") | (F.col("other") >= F.col("block")))
    met = met.repartition(F.col("star"), F.col("block"), F.col("other"), F.col("mate")).select("x", "y")
    kind = facts.schema["node"].dataType.simpleString()
    away, all_ = whole - part, whole + part

    def work(batches):
        for batch in batches:
            sides = [column.flatten() for column in batch.columns]
            cuts = [np.append(0, np.cumsum(column.value_lengths().to_numpy())) for column in batch.columns]
            nodes = [side.field("node") for side in sides]
            parts = pa.concat_arrays([side.field("part_of") for side in sides]).dictionary_encode().indices.to_numpy()
            parts = parts[: len(sides[0])], parts[len(sides[0]) :]
            (n_x, n_y), (far_x, far_y) = ([side.field(k).to_numpy().astype(np.int64) for side in sides] for k in ("n", "far"))
            for first, last in _cells(*cuts):
                (x0, x1), (y0, y1) = ((c[first], c[last]) for c in cuts)
                i, j, common = _intersections(*(_lists(side.field("d"), c, first, last) for side, c in zip(sides, cuts, strict=True)))
                i, j = i + x0, j + y0
                linked_ = (far_x[i] + far_y[j] - 2 * common) * all_ <= (n_x[i] + n_y[j]) * away
                linked_ &= parts[0][i] != parts[1][j]
                yield pa.RecordBatch.from_arrays([nodes[0].take(pa.array(i[linked_])), nodes[1].take(pa.array(j[linked_]))], schema=schema)

    schema = pa.schema([("a", _ARROW[kind]), ("b", _ARROW[kind])])
    return met.mapInArrow(arrays.trimmed(work), f"a {kind}, b {kind}").distinct()


def _cells(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows, given where the members of each row begin on both sides, with about CELLS pairs of members or one row."""
    ends = np.cumsum(np.diff(x) * np.diff(y))
    runs, first = [], 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CELLS, "right")))
        runs.append((first, last))
        first = last
    return runs


def _lists(lists: pa.Array, cuts: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(members of each row, tokens of each member, tokens) of the rows from `first` to `last`."""
    some = lists.slice(cuts[first], cuts[last] - cuts[first])
    return np.diff(cuts[first : last + 1]), some.value_lengths().to_numpy(), some.flatten().to_numpy()


def _intersections(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, size of the intersection) of each member of `left` with each one of `right` in the same row."""
    (rows_x, sizes_x, tokens_x), (rows_y, sizes_y, tokens_y) = left, right
    row_x, begin_y = np.repeat(np.arange(len(rows_x)), rows_x), np.cumsum(rows_y) - rows_y
    begin = np.cumsum(rows_y[row_x]) - rows_y[row_x]  # the first cell of each member of x
    i = np.repeat(np.arange(len(row_x)), rows_y[row_x])
    j = np.arange(len(i)) - begin[i] + begin_y[row_x[i]]
    owner_x, owner_y = np.repeat(np.arange(len(sizes_x)), sizes_x), np.repeat(np.arange(len(sizes_y)), sizes_y)
    row_y = np.repeat(np.arange(len(rows_y)), rows_y)
    # tokens as numbers, other ones in each row
    number = np.unique(np.concatenate((tokens_x, tokens_y)), return_inverse=True)[1]
    kinds = int(number.max(initial=0)) + 1
    key_x = row_x[owner_x] * kinds + number[: len(tokens_x)]
    key_y = row_y[owner_y] * kinds + number[len(tokens_x) :]
    order = np.argsort(key_y, kind="stable")
    key_y, owner_y = key_y[order], owner_y[order]
    low, high = np.searchsorted(key_y, key_x, "left"), np.searchsorted(key_y, key_x, "right")
    common = np.zeros(len(i), np.int64)
    if len(rows_x) == 1:  # two large blocks: tokens that many members have by products of 0/1 matrices
        held_x = np.bincount(number[: len(tokens_x)], minlength=kinds)
        held_y = np.bincount(number[len(tokens_x) :], minlength=kinds)
        often = np.flatnonzero(held_x * held_y > len(i) / SPARSE)
        common += _product(often, (number[: len(tokens_x)], owner_x, len(sizes_x)), (key_y, owner_y, len(sizes_y)))
        high = np.where(np.isin(number[: len(tokens_x)], often), low, high)
    meets = high - low
    ends = np.cumsum(meets)
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CELLS, "right")))
        n = meets[first:last]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[first:last], n)
        member = np.repeat(owner_x[first:last], n)
        np.add(common, np.bincount(begin[member] + owner_y[at] - begin_y[row_x[member]], minlength=len(i)), out=common)
        first = last
    return i, j, common


def _product(some: np.ndarray, *sides: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Sizes of the intersections, x by x, as far as they lie in the tokens `some`; a side has tokens, their members, members."""
    out = np.zeros((sides[0][2], sides[1][2]), np.float32)
    for first in range(0, len(some), TOKENS):
        few = some[first : first + TOKENS]
        grids = []
        for values, owner, rows in sides:
            at = np.minimum(np.searchsorted(few, values), len(few) - 1)
            held = few[at] == values
            grid = np.zeros((rows, len(few)), np.float32)
            grid[owner[held], at[held]] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out.astype(np.int64).ravel()


def _by_sizes(members: DataFrame, apart: DataFrame, token_sets: Callable[[DataFrame], DataFrame], part: int, whole: int) -> DataFrame:
    """Links (a, b) of step 3."""
    x, y = apart.select("key", "node", "n").alias("x"), members.select("key", "node", "n").alias("y")
    pairs = x.join(y, F.col("x.key") == F.col("y.key")).where((F.col("x.node") != F.col("y.node")) & sizes_allow(F.col("x.n"), F.col("y.n"), part, whole))
    return _verified(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), token_sets, part, whole)


def _verified(pairs: DataFrame, token_sets: Callable[[DataFrame], DataFrame], part: int, whole: int) -> DataFrame:
    """The links among candidate pairs (a, b)."""
    pairs = materialize(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialize(token_sets(nodes), "sets")
    links = materialize(with_overlap(pairs, sets).where(is_link(part, whole)).select("a", "b"), "links")
    discard(pairs, sets)
    return links
