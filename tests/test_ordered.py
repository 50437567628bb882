import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators.ordered import (
    average_pct_rank,
    chrono_split,
    exact_quantiles,
    ordered_prefix,
    reference_current_split,
    row_at,
    value_counts,
)


def test_positions_and_sums_equal_a_plain_walk_with_a_hot_segment(spark, small_slices):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"s{i % 7}", rng.randint(0, 40), i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "s string, v int, id int, w bigint")
    got = {r["id"]: (r["pos"], r["cum_w"]) for r in ordered_prefix(df, ["-v", "id"], ["w"], ["s"]).collect()}
    want, state = {}, {}
    for s, v, i, w in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        n, total = state.get(s, (0, 0))
        state[s] = (n + 1, total + w)
        want[i] = state[s]
    assert got == want


def test_positions_without_segment(spark, small_slices):
    df = spark.range(1000).select((F.col("id") % 10).alias("v"), "id")
    got = {r["id"]: r["pos"] for r in ordered_prefix(df, ["v", "id"]).collect()}
    order = sorted(range(1000), key=lambda i: (i % 10, i))
    assert got == {i: n + 1 for n, i in enumerate(order)}


def test_row_at_finds_every_kind_of_position(spark, small_slices):
    df = spark.range(200).select((F.col("id") % 3).alias("v"), "id")
    order = sorted(range(200), key=lambda i: (i % 3, i))
    for position in (1, 67, 68, 200):
        assert row_at(df, ["v", "id"], position)["id"] == order[position - 1]
    assert row_at(df, ["v", "id"], 0) is None
    assert row_at(df, ["v", "id"], 201) is None


@pytest.mark.parametrize("window,expected", [(500, 20), (5, 5), (None, 20)])
def test_reference_current_split_sizes(spark, window, expected):
    start = datetime(2020, 1, 1)
    df = spark.createDataFrame([(start + timedelta(days=i // 4), i) for i in range(100)], "ts timestamp, id int")
    reference, current = reference_current_split(df, "ts", "id", window)
    assert reference.count() == 80
    assert sorted(r["id"] for r in current.collect()) == list(range(100 - expected, 100))


def test_split_keeps_ties_together_by_id(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1), i) for i in range(10)], "ts timestamp, id int")
    train, test = chrono_split(df, "ts", "id")
    assert sorted(r["id"] for r in train.collect()) == list(range(8))
    assert sorted(r["id"] for r in test.collect()) == [8, 9]


def test_empty_frame(spark):
    df = spark.createDataFrame([], "ts timestamp, id int")
    train, test = chrono_split(df, "ts", "id")
    assert train.count() == 0 and test.count() == 0
    assert ordered_prefix(df, ["ts", "id"]).count() == 0


def test_average_rank_with_ties(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, None)], "id int, v double")
    got = {r["id"]: r["p"] for r in average_pct_rank(df, "v", "p").collect()}
    assert got == {1: pytest.approx(1 / 3), 2: pytest.approx(2.5 / 3), 3: pytest.approx(2.5 / 3), 4: None}


def test_exact_quantiles_equal_numpy(spark, small_slices):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame([("a", float(v)) for v in values], "s string, v double")
    prefix = ordered_prefix(value_counts(df, "v", ["s"]), ["v"], ["n"], ["s"])
    total = prefix.groupBy("s").agg(F.sum("n").alias("n_total"))
    probs = [i / 10 for i in range(11)]
    got = exact_quantiles(prefix, "v", "n", total, probs, ["s"]).first()["quantiles"]
    assert got == pytest.approx(list(np.quantile(values, probs)))
