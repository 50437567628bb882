"""Global order without a one-task window.

`ordered_prefix` gives each row its position and running totals in a global (or
per-segment) order. Rows are range-partitioned on segment and order columns, so a
hot segment spreads over many slices; each slice is windowed on its own and gets
the totals of the slices before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.storage import materialize

SLICE = "_slice"


def _sort_key(name: str) -> Column:
    return F.col(name[1:]).desc() if name.startswith("-") else F.col(name).asc()


def sliced(df: DataFrame, order: Sequence[str], segment: Sequence[str] = ()) -> DataFrame:
    """Write `df` in range slices of (segment, order) and read it back with its slice number.

    The slice number is stored because range boundaries are sampled and need not be
    the same in a second run of the same plan. There are at most
    `spark.sql.shuffle.partitions` slices; adaptive execution merges small neighbours.
    """
    keys = [F.col(c).asc() for c in segment] + [_sort_key(c) for c in order]
    ranged = df.repartitionByRange(*keys).withColumn(SLICE, F.spark_partition_id())
    return materialize(ranged, "ordered")


def ordered_prefix(
    df: DataFrame, order: Sequence[str], sums: Sequence[str] = (), segment: Sequence[str] = ()
) -> DataFrame:
    """Add `pos` (1-based) and `cum_<c>` (inclusive) per segment.

    `order` names columns, `-name` for descending, and must be unique per segment for
    a deterministic `pos`. At most one segment continues into a slice, so the carried
    totals have no more rows than there are slices, which bounds the broadcast.
    """
    table = sliced(df, order, segment)
    counted = table.withColumn("_one", F.lit(1).cast("bigint"))
    measures = ["_one", *sums]
    totals = counted.groupBy(*segment, SLICE).agg(*[F.sum(c).alias(c) for c in measures])
    group = [F.col(c) for c in segment] or [F.lit(0)]
    over_slices = Window.partitionBy(*group).orderBy(SLICE)
    before = over_slices.rowsBetween(Window.unboundedPreceding, -1)
    per_slice = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in segment],
        F.col(SLICE).alias("_k_slice"),
        *[F.sum(c).over(before).alias(f"_before_{c}") for c in measures],
    )
    carried = per_slice.filter(F.col("_before__one").isNotNull())
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in segment] + [F.col(SLICE) == F.col("_k_slice")]
    condition = same[0]
    for extra in same[1:]:
        condition = condition & extra

    local = Window.partitionBy(SLICE, *segment).orderBy(*[_sort_key(c) for c in order])
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    windowed = counted.select("*", *[F.sum(c).over(running).alias(f"_run_{c}") for c in measures])
    joined = windowed.join(F.broadcast(carried), condition, "left")

    def cumulative(c: str) -> Column:
        return F.col(f"_run_{c}") + F.coalesce(F.col(f"_before_{c}"), F.lit(0))

    return joined.select(
        *df.columns, cumulative("_one").alias("pos"), *[cumulative(c).alias(f"cum_{c}") for c in sums]
    )


def rows_at(df: DataFrame, order: Sequence[str], positions: Callable[[int], Sequence[int]]) -> list[Row | None]:
    """Order-column values of the rows at the 1-based positions that `positions(row count)` asks for.

    Positions are found in the range slices; only the row count and the wanted rows reach the driver.
    """
    names = [c.lstrip("-") for c in order]
    placed = ordered_prefix(df.select(*names), order)
    wanted = positions(placed.count())
    found = {r["pos"]: r for r in placed.filter(F.col("pos").isin(*set(wanted))).collect()}
    return [found.get(position) for position in wanted]


def row_at(df: DataFrame, order: Sequence[str], position: int) -> Row | None:
    return rows_at(df, order, lambda _: [position])[0]


def at_or_before(order: Sequence[str], bound: Row | None) -> Column:
    """Filter: row is not after `bound` in ascending `order` (literals only, so it reaches the scan)."""
    if bound is None:
        return F.lit(False)
    condition = F.lit(True)
    for name in reversed(order):
        condition = (F.col(name) < F.lit(bound[name])) | ((F.col(name) == F.lit(bound[name])) & condition)
    return condition


def chrono_split(df: DataFrame, ts: str, key: str, frac: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """First `frac` of rows by (ts, key) and the rest, as two filters over `df`."""
    cut = rows_at(df, [ts, key], lambda n: [int(n * frac)])[0]
    inside = at_or_before([ts, key], cut)
    return df.filter(inside), df.filter(~inside)


def reference_current_conditions(
    keys: DataFrame, ts: str, key: str, window: int | None = 500, frac: float = 0.8
) -> tuple[Column, Column]:
    """Filters for the reference and current slices of any frame that carries (ts, key).

    Reference = first `frac` of rows; current = last `window` rows of the rest. With no
    window the whole rest is current. If there is no rest, the last min(window, n) rows
    of all are current.
    """

    def cuts(n: int) -> list[int]:
        split = int(n * frac)
        if not window:
            return [split, split]
        return [split, max(split, n - window) if split < n else max(n - window, 0)]

    order = [ts, key]
    split_row, start_row = rows_at(keys, order, cuts)
    return at_or_before(order, split_row), ~at_or_before(order, start_row)


def reference_current_split(
    df: DataFrame, ts: str, key: str, window: int | None = 500, frac: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    reference, current = reference_current_conditions(df, ts, key, window, frac)
    return df.filter(reference), df.filter(current)


def value_counts(df: DataFrame, value: str, segment: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their row count (`n`): copies collapse before any ordering."""
    return df.groupBy(*segment, value).agg(F.count(F.lit(1)).alias("n"))


def average_pct_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Percentile rank with average ties over all rows."""
    present = df.filter(F.col(column).isNotNull())
    rows = present.count()
    ranked = ordered_prefix(value_counts(present, column), [column], ["n"])
    rank = (F.col("cum_n") - F.col("n")) + (F.col("n") + 1) / F.lit(2.0)
    table = ranked.select(F.col(column), (rank / F.lit(float(max(rows, 1)))).alias(out))
    return df.join(table, column, "left")


def exact_quantiles(
    prefix: DataFrame, value: str, weight: str, total: DataFrame, probs: Sequence[float], segment: Sequence[str]
) -> DataFrame:
    """Linear-interpolated quantiles from an `ordered_prefix` over distinct values.

    `total` holds `segment` and `n_total`. Returns segment and `quantiles` (array in
    the order of `probs`).
    """
    joined = prefix.join(total, list(segment))
    first, last = F.col(f"cum_{weight}") - F.col(weight), F.col(f"cum_{weight}") - 1
    hits = []
    for i, p in enumerate(probs):
        h = (F.col("n_total") - 1) * F.lit(float(p))
        low = F.floor(h)
        high = F.least(low + 1, F.col("n_total") - 1)
        for side, rank in (("lo", low), ("hi", high)):
            hits.append(F.when(rank.between(first, last), F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"))))
    found = joined.select(
        *segment, "n_total", F.col(value).alias("_v"), F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("h")
    )
    per_prob = found.groupBy(*segment, "n_total", F.col("h.i").alias("i")).agg(
        F.max(F.when(F.col("h.side") == "lo", F.col("_v"))).alias("lo"),
        F.max(F.when(F.col("h.side") == "hi", F.col("_v"))).alias("hi"),
    )
    grid = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1)
    h = (F.col("n_total") - 1) * grid
    point = F.col("lo") + (F.col("hi") - F.col("lo")) * (h - F.floor(h))
    ordered = F.array_sort(F.collect_list(F.struct("i", point.alias("q"))))
    return per_prob.groupBy(*segment).agg(F.transform(ordered, lambda s: s["q"]).alias("quantiles"))
