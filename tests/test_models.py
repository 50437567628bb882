import itertools
import math
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from claimloom.models import explain, training
from claimloom.models.forest import ForestModel, IsolationForest, anomaly_for_claims, anomaly_scores, average_path, version_row
from claimloom.operators import registry
from claimloom.storage import new_path


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        x, c = float(rng.normal()), "abc"[i % 3]
        y = int(rng.random() < 1 / (1 + math.exp(-(2 * x + (c == "a")))))
        rows.append((i, datetime(2020, 1, 1) + timedelta(hours=i), c, x, float(rng.normal()), y, "pos" if y else "neg"))
    return spark.createDataFrame(rows, "claim_id int, submission_date timestamp, c string, x double, noise double, is_denied int, kind string").persist()


SPEC = replace(
    training.DENIAL_RISK, categorical=["c"], numeric=["x", "noise"], forest_trees=5, forest_depth=4, boost_rounds=3, boost_depth=3
)


@pytest.fixture(scope="module")
def trained(labelled):
    return {t.name: t for t in training.train_candidates(labelled, SPEC, datetime(2020, 2, 1))}


def test_all_candidates_learn_and_the_gate_picks_the_best(spark, trained):
    assert set(trained) == {"logistic_regression", "random_forest", "boosted_trees_sampled", "boosted_trees_full"}
    assert all(t.metrics["roc_auc"] > 0.75 for t in trained.values())
    best = training.pick_champion(spark, list(trained.values()))
    assert best.metrics["pr_auc"] == max(t.metrics["pr_auc"] for t in trained.values())
    assert training.pick_champion(spark, list(trained.values()), {"pr_auc": 1.1}) is None
    rows = training.version_rows(list(trained.values()), datetime(2020, 2, 1), "d1", "/models")
    assert rows[0]["artifact_path"] == "/models/denial_risk/20200201-000000-logistic_regression"


def test_scores_are_probabilities_and_unseen_codes_are_accepted(spark, trained, labelled):
    row = labelled.limit(1).withColumn("c", F.lit("new"))
    for t in trained.values():
        p = t.score(row).first()["probability"]
        assert 0.0 <= p <= 1.0 and p == round(p, 4)


def test_saved_model_scores_the_same(spark, trained, labelled):
    path = new_path(spark, "model")
    trained["random_forest"].save(path)
    loaded = training.load_trained(spark, path, SPEC)
    a = [r["probability"] for r in trained["random_forest"].score(labelled).orderBy("claim_id").limit(20).collect()]
    b = [r["probability"] for r in loaded.score(labelled).orderBy("claim_id").limit(20).collect()]
    assert a == b and loaded.version == trained["random_forest"].version


def test_multiclass_model(labelled):
    spec = replace(training.DENIAL_REASON, categorical=["c"], numeric=["x", "noise"], label="kind", forest_trees=5, boost_rounds=2)
    models = training.train_candidates(labelled, spec, datetime(2020, 2, 1), ["random_forest", "boosted_trees_full"])
    for m in models:
        assert m.labels == ("neg", "pos") and m.metrics["macro_f1"] > 0.6
        row = m.predict_class(labelled).first()
        assert row["predicted"] in m.labels and len(row["class_scores"]) == 2


def test_too_few_rows_and_leaked_columns(labelled):
    assert training.train_candidates(labelled.limit(10), SPEC, datetime(2020, 2, 1)) == []
    with pytest.raises(ValueError):
        training.train_candidates(labelled, replace(SPEC, numeric=["x", "outcome"]), datetime(2020, 2, 1))


def test_tree_contributions_equal_the_subset_definition():
    leaf = {"left": -1, "right": -1, "feature": -1, "cut": [], "codes": -1}
    tree = [
        {"cover": 10.0, "value": 0, "left": 1, "right": 2, "feature": 0, "cut": [0.5], "codes": -1},
        {**leaf, "cover": 4.0, "value": 1.0},
        {"cover": 6.0, "value": 0, "left": 3, "right": 4, "feature": 1, "cut": [1.0], "codes": 2},
        {**leaf, "cover": 2.0, "value": 5.0},
        {"cover": 4.0, "value": 0, "left": 5, "right": 6, "feature": 0, "cut": [0.8], "codes": -1},
        {**leaf, "cover": 1.0, "value": -3.0},
        {**leaf, "cover": 3.0, "value": 2.0},
    ]

    def expected(i, x, known):
        n = tree[i]
        if n["left"] < 0:
            return n["value"]
        if n["feature"] in known:
            goes = x[n["feature"]] <= n["cut"][0] if n["codes"] == -1 else x[n["feature"]] in n["cut"]
            return expected(n["left"] if goes else n["right"], x, known)
        return sum(tree[k]["cover"] / n["cover"] * expected(k, x, known) for k in (n["left"], n["right"]))

    x = np.array([[0.2, 0.0, 9.0], [0.7, 0.0, 9.0], [0.9, 1.0, 9.0], [0.6, 1.0, 9.0]])
    got, base = explain.shapley_values([tree], x)
    for row, values in zip(x, got):
        assert base + values.sum() == pytest.approx(expected(0, row, {0, 1, 2}))
        for j in range(3):
            total = 0.0
            others = [k for k in range(3) if k != j]
            for size in range(3):
                for s in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(2 - size) / math.factorial(3)
                    total += weight * (expected(0, row, {*s, j}) - expected(0, row, set(s)))
            assert values[j] == pytest.approx(total)


@pytest.mark.parametrize("name", ["random_forest", "boosted_trees_full", "logistic_regression"])
def test_contributions_add_up_to_the_model_output(trained, labelled, name):
    t = trained[name]
    row = explain.explain(labelled.filter("claim_id = 3"), t, labelled, top_k=10).first()
    total = row["base_value"] + sum(f["contribution"] for part in (row[2], row[3]) for f in part)
    base = t.model.folds[0][0]
    ready = base.transform(t.prep.transform(training.filled(labelled.filter("claim_id = 3"), SPEC))).first()
    p = float(ready["probability"][1])
    want = p if name == "random_forest" else math.log(p / (1 - p))
    assert total == pytest.approx(want, abs=2e-3)


def test_forest_flags_the_outliers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(380)] + [(1000 + i, 12.0 + i, -12.0, 12.0) for i in range(20)]
    df = spark.createDataFrame(rows, "claim_id int, a double, b double, c double")
    model = IsolationForest(trees=60).fit(df, ["a", "b", "c"], "claim_id")
    scored = anomaly_scores(df, model).persist()
    flagged = {r["claim_id"] for r in scored.filter("is_anomaly").collect()}
    assert len(flagged & set(range(1000, 1020))) >= 17 and len(flagged) <= 40
    top = scored.filter("claim_id = 1019").first()
    assert top["contributing_features"][0]["feature"] == "a" and top["decision"] < 0
    asked = spark.createDataFrame([(1019,), (77777,)], "claim_id int")
    got = {r["claim_id"]: r for r in anomaly_for_claims(asked, scored).collect()}
    assert got[77777]["severity"] == "NORMAL" and got[77777]["anomaly_score"] == 0.0 and not got[77777]["is_anomaly"]
    again = IsolationForest(trees=60).fit(df, ["a", "b", "c"], "claim_id")
    assert again.offset == model.offset


def test_path_lengths():
    assert average_path(1) == 0.0 and average_path(2) == 1.0
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_promotion_gate(spark):
    def gate(candidates, incumbent, metric="pr_auc", higher=True):
        rows = [("old", "t", 0, incumbent or {})] + [(name, "t", 1, metrics) for name, metrics in candidates.items()]
        versions = spark.createDataFrame([(r[0], *r) for r in rows], "version_id string, model_name string, model_type string, trained_at int, metrics map<string,double>")
        held = registry.gate_history(versions, metric, higher).first()
        return held["champion_name"] if held else None

    assert gate({"a": {"pr_auc": 0.5}, "b": {"pr_auc": 0.6}}, None) == "b"
    assert gate({"a": {"pr_auc": 0.5}}, {"pr_auc": 0.6}) == "old"
    assert gate({"a": {"pr_auc": 0.6}}, {"pr_auc": 0.6}) == "a"
    assert gate({"a": {"pr_auc": float("nan")}}, None) is None
    assert gate({"a": {}}, {"pr_auc": 0.1}) == "old"
    assert gate({"a": {"pr_auc": 0.1}}, {}) == "a"
    assert gate({"a": {"loss": 0.1}, "b": {"loss": 0.2}}, {"loss": 0.3}, "loss", False) == "a"


def test_registry_has_one_champion_and_ranking_metrics(spark):
    t0 = datetime(2020, 1, 1)
    versions = spark.createDataFrame(
        [("v1", "m1", "t", {"pr_auc": 0.5}, t0), ("v2", "m2", "t", {"pr_auc": 0.7}, t0 + timedelta(1)), ("v3", "m3", "u", {}, t0)],
        "version_id string, model_name string, model_type string, metrics map<string,double>, trained_at timestamp",
    )
    promotions = spark.createDataFrame([("t", "v2", t0), ("t", "v1", t0 + timedelta(5)), ("u", "v3", t0)], "model_type string, version_id string, promoted_at timestamp")
    assert {r["version_id"] for r in registry.champions(versions, promotions).collect()} == {"v1", "v3"}
    assert [r["version_id"] for r in registry.comparison(versions, promotions).collect()] == ["v2", "v1", "v3"]
    metrics = spark.createDataFrame(
        [("v1", "ranking_ndcg_at_5", 0.4, t0), ("v1", "pr_auc", 0.5, t0)],
        "model_version_id string, metric_name string, metric_value double, recorded_at timestamp",
    )
    view = {r["version_id"]: r for r in registry.registry_view(versions, metrics, promotions).collect()}
    assert view["v1"]["ranking_metrics"] == {"ranking_ndcg_at_5": 0.4} and view["v2"]["ranking_metrics"] is None
    assert view["v1"]["is_champion"] and not view["v2"]["is_champion"]


def test_retraining_goes_on_after_a_failure(spark):
    def broken():
        raise RuntimeError("no data")

    ticks = itertools.count()
    runs = training.retrain_all(spark, {"a": broken, "b": lambda: "m"}, lambda: datetime(2020, 1, 1) + timedelta(seconds=next(ticks)))
    got = {r["model_type"]: (r["status"], r["error"], r["champion"]) for r in runs.collect()}
    assert got == {"a": ("FAILURE", "RuntimeError: no data", None), "b": ("SUCCESS", None, "m")}


def test_every_fold_has_its_share_of_a_rare_class(spark):
    rows = [(i, float(i % 40 == 0)) for i in range(480)]
    placed = training.with_folds(spark.createDataFrame(rows, "id bigint, label double"), "id")
    counts = {(r["_fold"], r["label"]): r["count"] for r in placed.groupBy("_fold", "label").count().collect()}
    assert counts == {(f, label): n for f in range(3) for label, n in ((0.0, 156), (1.0, 4))}


def test_calibration_on_exact_scores(spark):
    """The calibrated value of a held-out score is the isotonic fit over all different scores, not over rounded ones."""

    def pools(points):
        blocks = []
        for x, y in sorted(points):
            blocks.append([x, x, y, 1.0])
            while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
                _, b, y2, w2 = blocks.pop()
                a, _, y1, w1 = blocks.pop()
                blocks.append([a, b, (y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2])
        return blocks

    rng = np.random.default_rng(3)
    rows = [(i, float(rng.random() < 0.3 + 0.4 * (i % 97) / 97), 1.0, Vectors.dense((i % 97) / 1e5)) for i in range(600)]
    df = training.with_folds(spark.createDataFrame(rows, ["id", "label", "weight", "features"]), "id")
    model = training.fit_calibrated(LogisticRegression(maxIter=20, regParam=50.0), df, "id")
    for fold, (base, isotonic) in enumerate(model.folds):
        held = training.positive_probability(df.filter(F.col("_fold") == fold), base, "score").groupBy("score").agg(F.avg("label").alias("y"), F.count("label").alias("n")).collect()
        blocks = pools([(r["score"], r["y"]) for r in held for _ in range(r["n"])])
        scores = spark.createDataFrame([(r["score"],) for r in held], "score double")
        got = {r["score"]: r["p"] for r in isotonic.setFeaturesCol("score").setPredictionCol("p").transform(scores).collect()}
        assert len(got) > 50 and len({round(x, 4) for x in got}) < len(got)
        for a, b, y, _ in blocks:
            assert all(abs(p - y) < 1e-9 for x, p in got.items() if a <= x <= b)


def pattern_table(shares):
    """Weights of each of the 2^d patterns of met features, from the sums over all subsets."""
    d = len(shares)
    patterns = (np.arange(2**d)[:, None] >> np.arange(d)) & 1
    out = np.zeros((2**d, d))
    for row, pattern in enumerate(patterns):
        for j in range(d):
            others = [k for k in range(d) if k != j]
            for size in range(d):
                weight = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
                for chosen in itertools.combinations(others, size):
                    out[row, j] += weight * (pattern[j] - shares[j]) * math.prod(pattern[k] if k in chosen else shares[k] for k in others)
    return patterns.astype(bool), out


@pytest.mark.parametrize("d", [1, 2, 5, 8])
def test_path_algorithm_equals_the_pattern_table(d):
    rng = np.random.default_rng(d)
    for shares in (rng.random(d), np.append(rng.random(d - 1), 0.0), np.append(rng.random(d - 1), 1.0)):
        patterns, want = pattern_table(shares)
        assert np.allclose(explain.path_contributions(patterns, shares), want, atol=1e-10)


def test_deep_trees_add_up():
    """200 trees of depth 8, and paths of 24 features, whose pattern table would have 16 million rows."""
    rng = np.random.default_rng(0)

    def grown(depth, features, limit):
        nodes = []

        def grow(level, cover, used):
            i = len(nodes)
            nodes.append({"cover": cover, "value": float(rng.normal()), "left": -1, "right": -1, "feature": -1, "cut": [], "codes": -1})
            if level < depth and cover > limit:
                share = float(rng.uniform(0.2, 0.8))
                feature = int(rng.integers(features)) if depth <= 8 else level
                nodes[i] |= {"feature": feature, "cut": [float(rng.random())]}
                nodes[i]["left"] = grow(level + 1, cover * share, used)
                nodes[i]["right"] = grow(level + 1, cover * (1 - share), used)
            return i

        grow(0, 1.0, ())
        return nodes

    def output(tree, row):
        i = 0
        while tree[i]["left"] >= 0:
            i = tree[i]["left"] if row[tree[i]["feature"]] <= tree[i]["cut"][0] else tree[i]["right"]
        return tree[i]["value"]

    for trees, features in (([grown(8, 12, 0.0) for _ in range(200)], 12), ([grown(24, 24, 0.05)], 24)):
        x = rng.random((6, features))
        values, base = explain.shapley_values(trees, x)
        for row, own in zip(x, values):
            assert base + own.sum() == pytest.approx(sum(output(t, row) for t in trees), abs=1e-8)


def test_a_stored_forest_scores_alike_and_is_always_promoted(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, *map(float, rng.normal(size=2))) for i in range(120)], "claim_id int, a double, b double")
    model = IsolationForest(trees=12).fit(df, ["a", "b"], "claim_id")
    path = new_path(spark, "forest")
    model.save(spark, path)
    loaded = ForestModel.load(spark, path)
    assert sorted(map(tuple, loaded.with_scores(df).collect())) == sorted(map(tuple, model.with_scores(df).collect()))
    assert (loaded.offset, loaded.sample, loaded.features) == (model.offset, model.sample, model.features)
    rows = [version_row(model, datetime(2020, 1, d), 120, path) for d in (1, 3, 2)]
    rows += [{"version_id": v, "model_name": v, "model_type": "denial_risk", "metrics": {"pr_auc": m}, "trained_at": datetime(2020, 1, d)} for v, m, d in (("x", 0.7, 1), ("y", 0.6, 2))]
    names = ["version_id", "model_name", "model_type", "metrics", "trained_at"]
    versions = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], "version_id string, model_name string, model_type string, metrics map<string,double>, trained_at timestamp")
    held = {r["model_type"]: r["version_id"] for r in registry.champions(versions, registry.promotions_of(versions)).collect()}
    assert held == {"anomaly": "anomaly-20200103-000000-isolation_forest", "denial_risk": "x"}
