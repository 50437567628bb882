"""Per-row feature contributions of the first fold's uncalibrated estimator.

Linear models: coefficient times distance from the background mean, in SQL. Trees:
exact path-dependent Shapley values by the polynomial path algorithm, in Arrow batches; the node table is
what the model itself writes when saved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.numbers import half_up
from claimloom.models.training import CalibratedModel, Trained, feature_names, filled
from claimloom.storage import new_path

TOP_K = 6
# Features of a leaf's path up to which the weights of all 2^d patterns are kept.
TABLE_FEATURES = 6


def tree_nodes(model: Model, spark) -> list[list[dict]]:
    """Nodes of every tree in id order, read from the model's own saved table.

    Bounded by trees x 2^(depth + 1) rows.
    """
    path = new_path(spark, "trees")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    weights = {r[0]: r[2] for r in spark.read.parquet(f"{path}/treesMetadata").collect()}
    boosted = isinstance(model, GBTClassificationModel)
    trees: dict[int, list[dict]] = {}
    for r in rows:
        stats = r["impurityStats"]
        cover = stats[0] if boosted else sum(stats)
        # A boosted margin m means log-odds 2 m; a forest averages class shares.
        share = stats[1] / cover if cover else 0.0
        value = 2.0 * r["prediction"] * weights[r["treeID"]] if boosted else share / len(weights)
        split = r["split"]
        trees.setdefault(r["treeID"], []).append(
            {
                "cover": cover,
                "value": value,
                "left": r["leftChild"],
                "right": r["rightChild"],
                "feature": split["featureIndex"],
                "cut": list(split["leftCategoriesOrThreshold"] or []),
                "codes": split["numCategories"],
            }
        )
    return [trees[k] for k in sorted(trees)]


def leaf_paths(tree: list[dict]) -> Iterator[tuple[float, dict[int, tuple[float, list[tuple[int, bool]]]]]]:
    """(value, {feature: (cover share along the path, [(node, goes left)])}) of every leaf."""
    stack = [(0, {})]
    while stack:
        i, path = stack.pop()
        node = tree[i]
        if node["left"] < 0:
            yield node["value"], path
            continue
        for child, left in ((node["left"], True), (node["right"], False)):
            share, tests = path.get(node["feature"], (1.0, []))
            ratio = tree[child]["cover"] / node["cover"] if node["cover"] else 0.0
            stack.append((child, {**path, node["feature"]: (share * ratio, [*tests, (i, left)])}))


def path_contributions(holds: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley weights of one leaf's features for each row of `holds` (rows x d: whether the row meets the feature's tests).

    The polynomial path algorithm, for all rows at once: the path is extended by one feature after the other, which keeps the
    sums over subsets of each size, and each feature is unwound from it. d squared steps, where a table of patterns has 2^d rows.
    """
    rows, d = holds.shape
    one = holds.astype("float64")
    w = np.zeros((rows, d + 1))
    w[:, 0] = 1.0
    for m in range(1, d + 1):
        met, share = one[:, m - 1], shares[m - 1]
        for i in range(m - 1, -1, -1):
            w[:, i + 1] += met * w[:, i] * (i + 1) / (m + 1)
            w[:, i] *= share * (m - i) / (m + 1)
    out = np.zeros((rows, d))
    for j in range(d):
        met, share = holds[:, j], shares[j]
        # with the feature met, sums follow from the longest down; without it they are those of the path, scaled
        following, with_it, without = w[:, d].copy(), np.zeros(rows), np.zeros(rows)
        for i in range(d - 1, -1, -1):
            part = following * (d + 1) / (i + 1)
            with_it += part
            following = w[:, i] - part * share * (d - i) / (d + 1)
            if share:
                without += w[:, i] * (d + 1) / (share * (d - i))
        out[:, j] = np.where(met, with_it * (1.0 - share), -share * without)
    return out


def _patterns(codes: np.ndarray, d: int) -> np.ndarray:
    return (codes[:, None] >> np.arange(d)) & 1 > 0


def with_weights(trees: list[list[dict]]) -> list[tuple[list[dict], list[tuple]]]:
    """Each tree with its leaves: (value, path, shares, weights of each pattern as rows of a feature, None for too many)."""

    def weights(value: float, shares: np.ndarray) -> np.ndarray | None:
        d = len(shares)
        return (value * path_contributions(_patterns(np.arange(1 << d), d), shares)).T.copy() if d <= TABLE_FEATURES else None

    def leaves(tree: list[dict]) -> list[tuple]:
        found = [(value, path, np.array([share for share, _ in path.values()])) for value, path in leaf_paths(tree)]
        return [(value, path, shares, weights(value, shares) if path and value else None) for value, path, shares in found]

    return [(tree, leaves(tree)) for tree in trees]


def shapley_values(trees: list[list[dict]], x: np.ndarray, prepared: list | None = None) -> tuple[np.ndarray, float]:
    """(rows x features contributions, base value). A node's test is made once for all rows. A row's pattern of met features is a
    number, by which a leaf's weights are looked up; the weights of leaves with many features are made for the patterns that occur."""
    out, base = np.zeros(x.shape[::-1]), 0.0
    for tree, leaves in with_weights(trees) if prepared is None else prepared:
        inside = [
            None if node["left"] < 0 else x[:, node["feature"]] <= node["cut"][0] if node["codes"] == -1 else np.isin(x[:, node["feature"]], node["cut"])
            for node in tree
        ]
        outside = [None if test is None else ~test for test in inside]
        for value, path, shares, table in leaves:
            base += value * float(np.prod(shares))
            if not path or not value:
                continue
            code = np.zeros(len(x), dtype=np.uint8 if len(path) <= 8 else np.int64)
            for j, (_, tests) in enumerate(path.values()):
                met = np.logical_and.reduce([inside[i] if left else outside[i] for i, left in tests]) if len(tests) > 1 else (inside if tests[0][1] else outside)[tests[0][0]]
                code |= met.astype(code.dtype) << code.dtype.type(j)
            if table is None:
                seen, code = np.unique(code, return_inverse=True)
                table = (value * path_contributions(_patterns(seen.astype(np.int64), len(path)), shares)).T
            code = code.astype(np.intp)
            for feature, of_pattern in zip(path, table):
                out[feature] += of_pattern.take(code)
    return out.T, base


def _ranked(values: Column, names: Sequence[str], sign: int, k: int) -> Column:
    """Top k contributions of one sign by size, as array<struct(feature, contribution)>."""
    pairs = F.zip_with(
        F.array(*[F.lit(n) for n in names]), values, lambda n, v: F.struct((-F.abs(v)).alias("neg"), n.alias("feature"), v.alias("v"))
    )
    chosen = F.array_sort(F.filter(pairs, lambda p: (p["v"] * sign) > 0))
    return F.transform(
        F.slice(chosen, 1, k), lambda p: F.struct(p["feature"].alias("feature"), half_up(p["v"], 4).alias("contribution"))
    )


def explain(df: DataFrame, trained: Trained, background: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """`key`, base_value, top_positive_factors, top_negative_factors for every row of `df`.

    `background` gives the means a linear model is explained against (its training rows).
    """
    spec, spark = trained.spec, df.sparkSession
    estimator = trained.model.folds[0][0] if isinstance(trained.model, CalibratedModel) else trained.model
    ready = trained.prep.transform(filled(df, spec)).select(spec.key, "features")
    names = feature_names(spec, trained.prep)
    if isinstance(estimator, LogisticRegressionModel):
        prepared = trained.prep.transform(filled(background, spec))
        mean = prepared.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
        coefficients = estimator.coefficients.toArray()
        base = float(estimator.intercept + coefficients @ mean)
        weights = F.array(*[F.lit(float(c)) for c in coefficients])
        shift = F.array(*[F.lit(float(c * m)) for c, m in zip(coefficients, mean)])
        product = F.zip_with(vector_to_array("features"), weights, lambda x, c: x * c)
        valued = ready.select(spec.key, F.zip_with(product, shift, lambda a, b: a - b).alias("values"))
    else:
        trees = tree_nodes(estimator, spark)
        base = shapley_values(trees, np.zeros((1, len(names))))[1]
        shared = spark.sparkContext.broadcast(trees)

        @F.pandas_udf("array<double>")
        def contribute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            prepared = with_weights(shared.value)
            for batch in batches:
                if len(batch):
                    x = np.stack(batch.to_numpy()).astype("float64")
                    yield pd.Series(list(shapley_values(shared.value, x, prepared)[0]))
                else:
                    yield pd.Series([], dtype="object")

        valued = ready.select(spec.key, contribute(vector_to_array("features")).alias("values"))
    return valued.select(
        spec.key,
        half_up(F.lit(base), 4).alias("base_value"),
        _ranked(F.col("values"), names, 1, top_k).alias("top_positive_factors"),
        _ranked(F.col("values"), names, -1, top_k).alias("top_negative_factors"),
    )
