import random
from datetime import datetime, timedelta

import pytest

from claimloom.operators.history import with_asof_rates

T0 = datetime(2020, 1, 1)
SCHEMA = "id int, k string, ts timestamp, y int"


def rates(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["id"]: r["rate"] for r in with_asof_rates(df, {"rate": "k"}, "ts", "y", **options).collect()}


def test_first_rows_get_the_prior(spark):
    assert rates(spark, [(i, "p", T0 + timedelta(days=i), 1) for i in range(3)]) == {0: 0.15, 1: 0.15, 2: 0.15}


def test_six_wins_then_a_loss(spark):
    rows = [(i, "p", T0 + timedelta(days=i), int(i < 6)) for i in range(7)]
    got = rates(spark, rows, prior=0.40)
    assert got[6] == 1.0 and got[0] == 0.40


@pytest.mark.parametrize("wins,n,expected", [(8, 10, 0.8), (1, 10, 0.1), (6, 6, 1.0)])
def test_lookup_before_a_cutoff(spark, wins, n, expected):
    events = [(i, "p", T0 + timedelta(days=i), int(i < wins)) for i in range(n)]
    later = [(100 + i, "p", T0 + timedelta(days=50 + i), 0) for i in range(5)]
    probes = spark.createDataFrame([(1, "p", T0 + timedelta(days=40)), (2, "q", T0)], "id int, k string, ts timestamp")
    source = spark.createDataFrame(events + later, SCHEMA)
    got = with_asof_rates(probes, {"rate": "k"}, "ts", "y", events=source)
    assert {r["id"]: r["rate"] for r in got.collect()} == {1: pytest.approx(expected), 2: 0.15}


def test_equal_to_brute_force_with_ties_and_fine_times(spark):
    rng = random.Random(5)
    rows = [
        (i, rng.choice("ab"), T0 + timedelta(days=rng.randint(0, 3), seconds=rng.randint(0, 2), microseconds=rng.randint(0, 3)), rng.randint(0, 1))
        for i in range(400)
    ]
    got = rates(spark, rows)
    for i, k, ts, _ in rows:
        before = [y for _, k2, t2, y in rows if k2 == k and t2 < ts]
        want = sum(before) / len(before) if len(before) >= 5 else 0.15
        assert got[i] == pytest.approx(want)


def test_future_rows_do_not_change_past_rates(spark):
    rows = [(i, "p", T0 + timedelta(days=i), i % 2) for i in range(12)]
    changed = [(i, k, t, 1 - y if i >= 8 else y) for i, k, t, y in rows]
    a, b = rates(spark, rows), rates(spark, changed)
    assert all(a[i] == b[i] for i in range(9))


def test_label_counts_only_once_known(spark):
    rows = [(i, "p", T0 + timedelta(days=i), 1, T0 + timedelta(days=100)) for i in range(7)]
    df = spark.createDataFrame(rows, SCHEMA + ", known timestamp")
    got = with_asof_rates(df, {"rate": "k"}, "ts", "y", label_time="known")
    assert {r["id"]: r["rate"] for r in got.collect()}[6] == 0.0


def test_null_key_and_null_time_get_the_prior(spark):
    rows = [(i, "p", T0 + timedelta(days=i), 1) for i in range(6)] + [(7, None, T0, 1), (8, "p", None, 1)]
    got = rates(spark, rows)
    assert got[7] == 0.15 and got[8] == 0.15
