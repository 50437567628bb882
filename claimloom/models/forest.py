"""Isolation forest: trees built per tree id, scores computed in Arrow batches.

Splits are uniform in a feature's range, so standardising the features first would not
change a tree; raw features are used and the z-scores of a claim are reported apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.numbers import half_up
from claimloom.functions.rules import severity
from claimloom.operators.ordered import exact_quantiles, ordered_prefix, value_counts
from claimloom.operators.registry import version_tag

EULER_GAMMA = 0.5772156649015329
HASH_RANGE = 1 << 40
# Published forest settings and reporting thresholds.
TREES, SAMPLE_SIZE, CONTAMINATION, SEED = 200, 256, 0.05, 42
ANOMALY_SCORE, TOP_FEATURES, MIN_Z = 55.0, 4, 1.0
MIN_ROWS = 20
# Rows that walk through the trees together.
WALK_ROWS = 4096
NODE_FIELDS = ("feature", "threshold", "left", "right", "path")
TREE_SCHEMA = "feature array<int>, threshold array<double>, left array<int>, right array<int>, path array<double>"


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def grow_tree(points: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, list]:
    """One tree as parallel node lists; leaves hold the path length and feature -1."""
    tree: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "path": []}
    stack = [(points, 0, -1, "")]
    while stack:
        part, depth, parent, side = stack.pop()
        node = len(tree["feature"])
        if parent >= 0:
            tree[side][parent] = node
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        leaf = depth >= limit or len(part) <= 1 or not len(open_features)
        feature = -1 if leaf else int(rng.choice(open_features))
        cut = 0.0 if leaf else float(rng.uniform(low[feature], high[feature]))
        for name, value in zip(tree, (feature, cut, -1, -1, depth + average_path(len(part)) if leaf else 0.0)):
            tree[name].append(value)
        if not leaf:
            goes_left = part[:, feature] <= cut
            stack.append((part[~goes_left], depth + 1, node, "right"))
            stack.append((part[goes_left], depth + 1, node, "left"))
    return tree


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(HASH_RANGE)) / F.lit(float(HASH_RANGE))


def tree_samples(df: DataFrame, key: str, rows: int, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, rank, vector) rows, a few more than `sample` per tree.

    A row joins a tree by a hash of (key, tree), after a first cut to a pool of a few times
    trees x sample rows; both are filters, so no row is sent anywhere it is not used.
    """
    pool_share = min(1.0, 4.0 * trees * sample / rows)
    tree_share = min(1.0, 1.5 * sample / (rows * pool_share))
    pool = df if pool_share >= 1.0 else df.filter(_uniform(F.col(key), F.lit(seed)) < pool_share)
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.alias("tree"), _uniform(F.col(key), t, F.lit(seed + 1)).alias("rank")),
    )
    joined = F.filter(draws, lambda d: d["rank"] < tree_share)
    return pool.select("vector", F.explode(joined).alias("d")).select("d.tree", "d.rank", "vector")


@dataclass(frozen=True)
class ForestModel:
    features: tuple[str, ...]
    trees: list[dict[str, np.ndarray]]
    sample: int
    offset: float = 0.0

    def with_scores(self, df: DataFrame) -> DataFrame:
        """Add `decision`: above 0 normal, below 0 among the most isolated share."""
        shared = df.sparkSession.sparkContext.broadcast(self.trees)
        scale = average_path(self.sample) or 1.0
        offset = self.offset

        @F.pandas_udf("double")
        def decide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trees = [_walkable(tree) for tree in shared.value]
            for batch in batches:
                if not len(batch):
                    yield pd.Series([], dtype="float64")
                    continue
                x = np.stack(batch.to_numpy()).astype("float64")
                yield pd.Series(-np.power(2.0, -path_totals(trees, x) / len(trees) / scale) - offset)

        return df.withColumn("decision", decide(vector_of(self.features)))

    def to_rows(self) -> pd.DataFrame:
        return pd.DataFrame([{name: list(values) for name, values in tree.items()} for tree in self.trees])

    def save(self, spark: SparkSession, path: str) -> None:
        """Two tables: the trees, a row each, and one row of settings."""
        rows = [(k, *([v.item() for v in tree[name]] for name in NODE_FIELDS)) for k, tree in enumerate(self.trees)]
        spark.createDataFrame(rows, f"tree int, {TREE_SCHEMA}").write.parquet(f"{path}/trees")
        settings = spark.createDataFrame([(list(self.features), self.sample, self.offset)], "features array<string>, sample int, offset double")
        settings.write.parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        one = spark.read.parquet(f"{path}/settings").first()
        rows = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()  # as many as the forest has trees
        trees = [{name: np.array(row[name]) for name in NODE_FIELDS} for row in rows]
        return cls(tuple(one["features"]), trees, one["sample"], one["offset"])


def _walkable(tree: dict[str, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(steps, feature, threshold, children, path) of a tree whose leaves lead to themselves, so a walk needs no test for them."""
    own = np.arange(len(tree["feature"]))
    leaf = np.asarray(tree["feature"]) < 0
    children = np.stack([np.where(leaf, own, tree["left"]), np.where(leaf, own, tree["right"])], axis=1).astype(np.intp)
    steps, level = 0, np.zeros(1, dtype=np.intp)
    while len(level := level[~leaf[level]]):
        steps, level = steps + 1, np.unique(children[level])
    return steps, np.where(leaf, 0, tree["feature"]).astype(np.intp), np.asarray(tree["threshold"]), children.ravel(), np.asarray(tree["path"])


def path_totals(walkable: Sequence[tuple], x: np.ndarray) -> np.ndarray:
    """Sum of the path lengths of each row of `x` over the trees, in blocks of rows whose values stay near the processor."""
    total = np.zeros(len(x))
    for at in range(0, len(x), WALK_ROWS):
        block = x[at : at + WALK_ROWS]
        flat, first, out = np.ascontiguousarray(block).ravel(), np.arange(len(block)) * x.shape[1], total[at : at + WALK_ROWS]
        for steps, feature, threshold, children, path in walkable:
            node = np.zeros(len(block), dtype=np.intp)
            for _ in range(steps):
                left = flat.take(first + feature.take(node)) <= threshold.take(node)
                node = children.take(2 * node + ~left)
            out += path.take(node)
    return total


def vector_of(features: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])


@dataclass(frozen=True)
class IsolationForest:
    trees: int = TREES
    sample: int = SAMPLE_SIZE
    contamination: float = CONTAMINATION
    seed: int = SEED

    def fit(self, df: DataFrame, features: Sequence[str], key: str) -> ForestModel:
        """Trees and the decision offset, the `contamination` quantile of all raw scores."""
        rows = df.count()
        if rows < MIN_ROWS:
            raise ValueError(f"need at least {MIN_ROWS} rows, got {rows}")
        sample, seed = min(self.sample, rows), self.seed
        limit = max(1, math.ceil(math.log2(max(sample, 2))))
        vectors = df.select(key, vector_of(features).alias("vector"))
        samples = tree_samples(vectors, key, rows, self.trees, sample, seed)

        def build(group: pd.DataFrame) -> pd.DataFrame:
            number = int(group["tree"].iloc[0])
            chosen = group.sort_values("rank").head(sample)
            tree = grow_tree(np.stack(chosen["vector"].to_numpy()), np.random.default_rng([seed, number]), limit)
            return pd.DataFrame([{"tree": number, **tree}])

        # At most `trees` rows of at most 2 * sample nodes each.
        built = samples.groupBy("tree").applyInPandas(build, f"tree int, {TREE_SCHEMA}").orderBy("tree").collect()
        nodes = [{name: np.array(row[name]) for name in NODE_FIELDS} for row in built]
        raw = ForestModel(tuple(features), nodes, sample)
        counts = value_counts(raw.with_scores(df).select("decision"), "decision").withColumn("_all", F.lit(0))
        prefix = ordered_prefix(counts, ["decision"], ["n"], ["_all"])
        total = prefix.groupBy("_all").agg(F.sum("n").alias("n_total"))
        offset = exact_quantiles(prefix, "decision", "n", total, [self.contamination], ["_all"]).first()["quantiles"][0]
        return ForestModel(tuple(features), nodes, sample, float(offset))


def version_row(model: ForestModel, run_ts: datetime, rows: int, base_path: str, dataset_version: str | None = None, commit: str = "") -> dict:
    """Registry row of a fitted forest, as `training.version_rows` makes them. It has no metric to be gated by."""
    tag = version_tag(run_ts, "isolation_forest")
    return {
        "version_id": f"anomaly-{tag}",
        "model_name": "isolation_forest",
        "model_type": "anomaly",
        "version_tag": tag,
        "artifact_path": f"{base_path}/anomaly/{tag}",
        "metrics": {"training_rows": float(rows), "trees": float(len(model.trees)), "offset": model.offset},
        "feature_names": list(model.features),
        "params": {"git_commit": commit},
        "dataset_version": dataset_version,
        "calibration_status": "none",
        "trained_at": run_ts,
    }


def column_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation (0 counts as 1) of every column, from one aggregate row."""
    aggregates = []
    for c in columns:
        aggregates += [F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}")]
    row = df.agg(*aggregates).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def top_abs_features(moments: dict[str, tuple[float, float]], n: int = TOP_FEATURES, min_z: float = MIN_Z) -> Column:
    """array<struct(feature, z_score)>: the n largest |z| of a row that exceed `min_z`; row-local."""
    entries = [
        F.struct(
            (-F.abs((F.col(c).cast("double") - mean) / std)).alias("neg"), F.lit(i).alias("ord"), F.lit(c).alias("feature")
        )
        for i, (c, (mean, std)) in enumerate(moments.items())
    ]
    top = F.slice(F.array_sort(F.array(*entries)), 1, n)
    large = F.filter(top, lambda e: -e["neg"] > min_z)
    return F.transform(large, lambda e: F.struct(e["feature"].alias("feature"), half_up(-e["neg"], 2).alias("z_score")))


def anomaly_report(decided: DataFrame, moments: dict[str, tuple[float, float]]) -> DataFrame:
    """Score 0-100, anomaly flag, severity and contributing features from a `decision` column."""
    score = half_up(100.0 / (1.0 + F.exp(6.0 * F.col("decision"))), 1)
    return (
        decided.withColumn("anomaly_score", score)
        .withColumn("is_anomaly", (F.col("decision") < 0) | (F.col("anomaly_score") >= ANOMALY_SCORE))
        .withColumn("severity", severity(F.col("anomaly_score")))
        .withColumn("contributing_features", top_abs_features(moments))
    )


def anomaly_scores(features: DataFrame, model: ForestModel) -> DataFrame:
    """Report for every row; the z-scores refer to all rows of `features`."""
    return anomaly_report(model.with_scores(features), column_moments(features, model.features))


def anomaly_for_claims(claim_ids: DataFrame, scored: DataFrame) -> DataFrame:
    """Scores of the asked-for claims; a claim without features is normal with score 0."""
    joined = claim_ids.join(scored, "claim_id", "left")
    empty = F.array().cast("array<struct<feature:string,z_score:double>>")
    return joined.select(
        "claim_id",
        F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"),
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
        F.coalesce("severity", F.lit("NORMAL")).alias("severity"),
        F.coalesce("contributing_features", empty).alias("contributing_features"),
    )
