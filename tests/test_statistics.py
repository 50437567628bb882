import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import drift, metrics
from claimloom.operators.features import near_duplicates
from claimloom.operators.recovery import capacity_plan, worked_claims


def psi_of(spark, reference, current):
    r = spark.createDataFrame([(float(v),) for v in reference], "v double")
    c = spark.createDataFrame([(float(v),) for v in current], "v double")
    prefix = drift.numeric_prefix(drift.tagged(r, c, ["v"]), ["v"])
    return drift.psi_numeric(prefix, drift.feature_profiles(prefix)).first()["psi"]


def plain_psi(reference, current):
    edges = np.unique(np.quantile(reference, np.linspace(0, 1, 11)))
    r, _ = np.histogram(reference, bins=edges)
    c, _ = np.histogram(current, bins=edges)
    rp, cp = r / max(r.sum(), 1) + 1e-6, c / max(c.sum(), 1) + 1e-6
    return float(np.sum((cp - rp) * np.log(cp / rp)))


def test_psi_numeric(spark, small_slices):
    rng = np.random.default_rng(42)
    a, b, far = rng.normal(100, 10, 500), rng.normal(100, 10, 500), rng.normal(180, 10, 500)
    assert abs(psi_of(spark, a, b)) < 0.05
    assert psi_of(spark, a, far) > 0.25
    assert psi_of(spark, a, b) == pytest.approx(plain_psi(a, b), abs=1e-6)
    ties = rng.integers(0, 15, 400)
    assert psi_of(spark, ties, ties[:100] + 1) == pytest.approx(plain_psi(ties, ties[:100] + 1), abs=1e-6)
    assert psi_of(spark, [1.0, 2.0], [1.0, 2.0]) == 0.0
    assert psi_of(spark, [0, 1] * 20, [0, 1] * 20) == 0.0


def test_psi_categorical(spark):
    def of(reference, current):
        r = spark.createDataFrame([(v,) for v in reference], "v string")
        c = spark.createDataFrame([(v,) for v in current], "v string")
        return drift.psi_categorical(drift.category_counts(drift.tagged(r, c, ["v"]), ["v"])).first()["psi"]

    assert of("A" * 50 + "B" * 50, "A" * 50 + "B" * 50) == pytest.approx(0.0)
    assert of("A" * 90 + "B" * 10, "A" * 10 + "B" * 90) > 0.25
    assert of([None] * 5, [None] * 5) == 0.0


def test_ks_statistic(spark, small_slices):
    rng = np.random.default_rng(7)
    a, b = np.round(rng.normal(size=300), 2), np.round(rng.normal(0.3, 1, 200), 2)
    r = spark.createDataFrame([(float(v),) for v in a], "v double")
    c = spark.createDataFrame([(float(v),) for v in b], "v double")
    prefix = drift.numeric_prefix(drift.tagged(r, c, ["v"]), ["v"])
    row = drift.ks_two_sample(prefix, drift.feature_profiles(prefix)).first()
    points = np.unique(np.concatenate([a, b]))
    gap = max(abs((a <= p).mean() - (b <= p).mean()) for p in points)
    assert row["ks_statistic"] == pytest.approx(gap, abs=1e-6)
    assert 0 < row["ks_pvalue"] < 0.05


def ranking(spark, scores, binary, dollar, k):
    rows = [("s", i, float(s), b, float(d)) for i, (s, b, d) in enumerate(zip(scores, binary, dollar))]
    df = spark.createDataFrame(rows, "strategy string, id int, score double, b int, d double")
    return metrics.ranking_metrics(df, "score", "b", "d", "id", k).first()


def test_ranking_metrics(spark):
    down = [5, 4, 3, 2, 1]
    assert ranking(spark, down, [1, 1, 1, 0, 0], [1] * 5, [3])["precision_at_3"] == 1.0
    assert ranking(spark, down, [0, 0, 0, 1, 1], [1] * 5, [3])["precision_at_3"] == 0.0
    assert ranking(spark, [2, 1], [1, 0], [1, 0], [10])["precision_at_10"] == 0.5
    row = ranking(spark, [3, 2, 1], [1, 1, 1], [1000, 100, 50], [1, 3])
    assert row["recovery_captured_at_1"] == round(1000 / 1150, 4) and row["recovery_captured_at_3"] == 1.0
    assert row["ndcg_at_3"] == 1.0
    assert ranking(spark, down, [0] * 5, [0] * 5, [3])["ndcg_at_3"] == 0.0
    ndcg = ranking(spark, [2, 1], [1, 1], [2, 3], [2])["ndcg_at_2"]
    assert ndcg == pytest.approx((2 + 3 / math.log2(3)) / (3 + 2 / math.log2(3)), abs=1e-4)


def test_random_baseline_is_the_same_with_and_without_the_bound(spark):
    rows = [(i, i % 3 == 0, float(i % 50)) for i in range(2000)]
    df = spark.createDataFrame([(i, int(b), d) for i, b, d in rows], "id int, b int, d double")
    bounded = metrics.random_baseline(df, "b", "d", "id", (5,), shuffles=5).first()
    whole = metrics.random_baseline(df.limit(2000), "b", "d", "id", (5, 100), shuffles=5).first()
    assert bounded["precision_at_5"] == whole["precision_at_5"]
    assert bounded["ndcg_at_5"] == whole["ndcg_at_5"]


def test_binary_metrics_equal_definition(spark, small_slices):
    rng = np.random.default_rng(11)
    s = np.round(rng.random(400), 2)
    y = (rng.random(400) < s).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    row = metrics.binary_metrics(df, "y", "s").first()
    pairs = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    assert row["roc_auc"] == pytest.approx(np.mean(pairs), abs=1e-6)
    ap, seen = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp, n = y[s >= t].sum(), (s >= t).sum()
        ap += (tp / y.sum() - seen) * tp / n
        seen = tp / y.sum()
    assert row["pr_auc"] == pytest.approx(ap, abs=1e-6)
    assert row["brier_score"] == pytest.approx(np.mean((s - y) ** 2), abs=1e-6)
    one = metrics.binary_metrics(df.filter("y = 1"), "y", "s").first()
    assert one["roc_auc"] == 0.5 and one["pr_auc"] == 1.0


def test_multiclass_with_a_class_that_is_only_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c")], "y string, p string")
    summary, per_class, _ = metrics.multiclass_metrics(df, "y", "p")
    f1 = {r["label"]: r["f1"] for r in per_class.collect()}
    assert f1 == {"a": pytest.approx(2 / 3, abs=1e-6), "b": 0.0, "c": 1.0}
    assert summary.first()["macro_f1"] == pytest.approx((2 / 3 + 1) / 3, abs=1e-6)


PLAN = "claim_id string, claim_amount double, appeal_success_probability double, expected_recovery double, estimated_effort_minutes int"


def plan(spark, rows, minutes):
    df = spark.createDataFrame(rows, PLAN)
    return {r["strategy"]: r for r in capacity_plan(df, minutes / 60).collect()}


def test_capacity_amount_first(spark):
    got = plan(spark, [("a", 500.0, 0.9, 400.0, 20), ("b", 20000.0, 0.3, 5000.0, 20)], 20)
    row = got["highest_claim_amount"]
    assert row["claims_processed"] == 1 and row["worked_claim_ids"] == ["b"]


def test_capacity_limits(spark):
    got = plan(spark, [("a", 1.0, 0.5, 100.0, 45)], 10)["highest_expected_recovery"]
    assert got["claims_processed"] == 0 and got["expected_recovery_captured"] == 0.0
    got = plan(spark, [("a", 1.0, 0.5, 300.0, 45), ("b", 1.0, 0.5, 600.0, 45)], 1000)["highest_expected_recovery"]
    assert got["claims_processed"] == 2 and got["recovery_yield"] == 1.0
    assert plan(spark, [], 60) == {}
    with pytest.raises(ValueError):
        worked_claims(spark.createDataFrame([], PLAN), 0)


def test_both_capacity_paths_equal_a_walk(spark, small_slices):
    rng = random.Random(2)
    rows = [(f"c{i:04d}", float(rng.randint(1, 50)), rng.random(), float(rng.randint(-5, 90)), rng.choice([5, 20, 45])) for i in range(3000)]
    df = spark.createDataFrame(rows, PLAN)
    for hours in (40, 300):
        got = {}
        for r in worked_claims(df, hours).collect():
            got.setdefault(r["strategy"], set()).add(r["claim_id"])
        for strategy, key in (("highest_claim_amount", 1), ("highest_appeal_probability", 2), ("highest_expected_recovery", 3)):
            used, want = 0, set()
            for row in sorted(rows, key=lambda r: (-r[key], r[0])):
                if used + row[4] > hours * 60:
                    break
                used += row[4]
                want.add(row[0])
            assert got[strategy] == want


def test_near_duplicates_equal_all_pairs_with_a_hot_group(spark, small_slices):
    rng = random.Random(9)
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 40}", round(rng.choice([0.5, 1.0, 100.0, 104.99, 105.0, 105.27, 95.0]) + rng.randint(0, 2), 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, g string, amt double")
    got = {r["id"]: (r["group_size"], r["close_count"]) for r in near_duplicates(df, ["g"], "amt", "id").collect()}
    for i, g, amt in rows:
        same = [round(a * 100) for _, g2, a in rows if g2 == g]
        own = round(amt * 100)
        close = sum(abs(a - own) * 100 <= 5 * max(own, 100) for a in same)
        assert got[i] == (len(same), close)


@pytest.mark.parametrize("n", [0, 5, 19, 20])
def test_few_rows_give_no_metrics(spark, n):
    rows = spark.range(n).select(
        F.col("id").alias("appeal_id"), (F.col("id") % 2).cast("int").alias("appeal_success"), (F.col("id") * 1.5).alias("claim_amount"), (F.col("id") / 40.0).alias("p"),
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("kind"), (F.col("id") % 4 == 0).alias("is_ref"),
    )
    assert (metrics.evaluate_recovery_ranking(rows, F.col("p"), with_random=False).count() > 0) == (n >= 20)
    assert (drift.drift_report(rows, ["claim_amount"], ["kind"]).count() > 0) == (n >= 20)
