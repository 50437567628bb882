"""Supervised models on MLlib: specification, calibration, training, scoring."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import rules
from claimloom.functions.numbers import half_up
from claimloom.operators import features as fe
from claimloom.operators.metrics import binary_metrics, multiclass_metrics
from claimloom.operators.ordered import chrono_split, ordered_prefix
from claimloom.operators.registry import gate_history, is_number, version_label, version_tag
from claimloom.storage import materialize

FOLDS = 3
SEED = 42


@dataclass(frozen=True)
class ModelSpec:
    model_type: str
    categorical: Sequence[str]
    numeric: Sequence[str]
    label: str
    ts: str
    key: str
    min_rows: int
    metric: str = "pr_auc"
    calibrated: bool = True
    forest_trees: int = 200
    forest_depth: int = 8
    boost_rounds: int = 200
    boost_depth: int = 4
    learning_rate: float = 0.08


# Model settings per type.
DENIAL_RISK = ModelSpec(
    "denial_risk", fe.DENIAL_CATEGORICAL, fe.DENIAL_NUMERIC, "is_denied", "submission_date", "claim_id", 50
)
APPEAL_SUCCESS = ModelSpec(
    "appeal_success", fe.APPEAL_CATEGORICAL, fe.APPEAL_NUMERIC, "appeal_success", "appeal_date", "appeal_id", 80,
    forest_depth=6, boost_rounds=150, boost_depth=3,
)
DENIAL_REASON = ModelSpec(
    "denial_reason", fe.DENIAL_CATEGORICAL, fe.DENIAL_NUMERIC, "denial_reason_code", "submission_date", "claim_id", 100,
    metric="macro_f1", calibrated=False, boost_rounds=150, learning_rate=0.1,
)


def candidates(spec: ModelSpec, rows: int) -> dict[str, Estimator]:
    """Estimators by name. The two boosters are MLlib gradient boosting with two settings."""
    common = {"featuresCol": "features", "labelCol": "label"}
    weighted = {**common, "weightCol": "weight"}
    forest = RandomForestClassifier(
        numTrees=spec.forest_trees, maxDepth=spec.forest_depth, seed=SEED, **weighted
    )
    linear = LogisticRegression(maxIter=1000, regParam=1.0 / max(rows, 1), standardization=False, **weighted)

    def boosted(share: float) -> Estimator:
        gbt = GBTClassifier(
            maxIter=spec.boost_rounds, maxDepth=spec.boost_depth, stepSize=spec.learning_rate,
            subsamplingRate=share, seed=SEED, **common,
        )
        return gbt if spec.calibrated else OneVsRest(classifier=gbt, parallelism=4, **common)

    return {
        "logistic_regression": linear,
        "random_forest": forest,
        "boosted_trees_sampled": boosted(0.9),
        "boosted_trees_full": boosted(1.0),
    }


def preprocessor(spec: ModelSpec) -> Pipeline:
    """One-hot codes (an unseen code is all zeros) and standardised numbers."""
    indexed = [f"{c}__i" for c in spec.categorical]
    coded = [f"{c}__v" for c in spec.categorical]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=list(spec.categorical), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True),
            VectorAssembler(inputCols=list(spec.numeric), outputCol="numbers"),
            StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
            VectorAssembler(inputCols=[*coded, "scaled"], outputCol="features"),
        ]
    )


def feature_names(spec: ModelSpec, prep: PipelineModel) -> list[str]:
    """Name of every position of the feature vector."""
    indexer = prep.stages[0]
    names = [f"{c}={v}" for c, values in zip(spec.categorical, indexer.labelsArray) for v in values]
    return names + list(spec.numeric)


def filled(df: DataFrame, spec: ModelSpec) -> DataFrame:
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in spec.categorical]
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in spec.numeric]
    used = {*spec.categorical, *spec.numeric}
    return df.select(*[c for c in df.columns if c not in used], *texts, *numbers)


def balanced_weights(df: DataFrame) -> DataFrame:
    """weight = n / (classes * class size); one count per class reaches the driver."""
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    total = sum(counts.values())
    table = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, total / (len(counts) * n))])
    return df.withColumn("weight", F.element_at(table, F.col("label")))


def positive_probability(df: DataFrame, model: Model, out: str) -> DataFrame:
    scored = model.transform(df)
    extra = [c for c in ("rawPrediction", "probability", "prediction") if c not in df.columns]
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(*extra)


@dataclass(frozen=True)
class CalibratedModel:
    """Mean of one isotonic-calibrated model per fold."""

    folds: tuple[tuple[Model, IsotonicRegressionModel], ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add `probability` (unrounded)."""
        names = []
        for i, (base, isotonic) in enumerate(self.folds):
            df = positive_probability(df, base, f"_raw{i}")
            df = isotonic.setFeaturesCol(f"_raw{i}").setPredictionCol(f"_cal{i}").transform(df)
            names.append(f"_cal{i}")
        mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
        return df.withColumn("probability", mean).drop(*names, *[f"_raw{i}" for i in range(len(self.folds))])

    def save(self, path: str) -> None:
        for i, (base, isotonic) in enumerate(self.folds):
            base.write().save(f"{path}/fold{i}/base")
            isotonic.write().save(f"{path}/fold{i}/isotonic")


def with_folds(df: DataFrame, key: str, folds: int = FOLDS) -> DataFrame:
    """`df`, stored, with `_fold`: rows of each class are dealt in turn, in the order of a hash of their key, so that every fold
    has its share of every class."""
    hashed = df.withColumn("_order", F.xxhash64(F.col(key)))
    placed = ordered_prefix(hashed, ["_order", key], segment=["label"])
    return materialize(placed.withColumn("_fold", (F.col("pos") - 1) % folds).drop("_order", "pos"), "folds")


def fit_calibrated(base: Estimator, df: DataFrame, key: str, folds: int = FOLDS) -> CalibratedModel:
    """Fit on all folds but one, calibrate on the one left out, for each fold.

    The isotonic fit sees each different held-out score once, with its weight; it pools adjacent violators in slices of the
    scores and merges the slices' blocks.
    """
    placed = df if "_fold" in df.columns else with_folds(df, key, folds)
    fitted = []
    for fold in range(folds):
        model = base.fit(placed.filter(F.col("_fold") != fold))
        held = positive_probability(placed.filter(F.col("_fold") == fold), model, "score")
        points = held.groupBy("score").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
        isotonic = IsotonicRegression(featuresCol="score", labelCol="label", weightCol="weight").fit(points)
        fitted.append((model, isotonic))
    return CalibratedModel(tuple(fitted))


@dataclass(frozen=True)
class Trained:
    spec: ModelSpec
    name: str
    prep: PipelineModel
    model: CalibratedModel | Model
    labels: tuple[str, ...] = ()
    metrics: Mapping[str, float] = field(default_factory=dict)
    tag: str = ""

    @property
    def version(self) -> str:
        return version_label(self.name, self.tag)

    def score(self, df: DataFrame) -> DataFrame:
        """Binary: add `probability` (4 decimals) and `model_version`."""
        ready = self.prep.transform(filled(df, self.spec))
        scored = self.model.transform(ready)
        return _slim(scored, self.spec).withColumn("probability", half_up(F.col("probability"), 4)).withColumn(
            "model_version", F.lit(self.version)
        )

    def predict_class(self, df: DataFrame) -> DataFrame:
        """Multiclass: add `predicted` and, where the model has it, ranked `class_scores`."""
        scored = self.model.transform(self.prep.transform(filled(df, self.spec)))
        names = F.array(*[F.lit(v) for v in self.labels])
        scored = scored.withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1))
        raw = "probability" if "probability" in scored.columns else "rawPrediction"
        values = vector_to_array(raw)
        total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
        shares = values if raw == "probability" else F.transform(values, lambda v: v / F.when(total == 0, 1.0).otherwise(total))
        ranked = F.array_sort(F.zip_with(names, shares, lambda n, s: F.struct((-s).alias("neg"), n.alias("reason"))))
        scored = scored.withColumn(
            "class_scores",
            F.transform(ranked, lambda r: F.struct(r["reason"].alias("reason"), half_up(-r["neg"], 4).alias("confidence"))),
        )
        return _slim(scored, self.spec).drop("prediction", "probability", "rawPrediction").withColumn(
            "model_version", F.lit(self.version)
        )

    def reason_struct(self) -> Column:
        """Model part of the rule -> model -> heuristic precedence, from `class_scores`."""
        first = F.element_at("class_scores", 1)
        return F.struct(
            first["reason"].alias("predicted_reason"),
            first["confidence"].alias("confidence"),
            F.lit("ml").alias("source"),
            F.slice("class_scores", 2, 3).alias("alternatives"),
            F.lit(self.version).alias("model_version"),
        )

    def save(self, path: str) -> None:
        """Write under a path that carries the version, so no run overwrites another's files."""
        self.prep.write().save(f"{path}/prep")
        if isinstance(self.model, CalibratedModel):
            self.model.save(f"{path}/model")
        else:
            self.model.write().save(f"{path}/model")
        meta = {"name": self.name, "tag": self.tag, "labels": list(self.labels), "metrics": dict(self.metrics)}
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{path}/meta")


def _slim(df: DataFrame, spec: ModelSpec) -> DataFrame:
    made = [f"{c}__{s}" for c in spec.categorical for s in ("i", "v")]
    return df.drop(*made, "numbers", "scaled", "features")


_LOADERS = {
    "logistic_regression": LogisticRegressionModel,
    "random_forest": RandomForestClassificationModel,
    "boosted_trees_sampled": GBTClassificationModel,
    "boosted_trees_full": GBTClassificationModel,
}


def load_trained(spark: SparkSession, path: str, spec: ModelSpec) -> Trained:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    prep = PipelineModel.load(f"{path}/prep")
    if spec.calibrated:
        kind = _LOADERS[meta["name"]]
        folds = tuple(
            (kind.load(f"{path}/model/fold{i}/base"), IsotonicRegressionModel.load(f"{path}/model/fold{i}/isotonic"))
            for i in range(FOLDS)
        )
        model: CalibratedModel | Model = CalibratedModel(folds)
    else:
        kind = _LOADERS[meta["name"]] if not meta["name"].startswith("boosted") else OneVsRestModel
        model = kind.load(f"{path}/model")
    return Trained(spec, meta["name"], prep, model, tuple(meta["labels"]), meta["metrics"], meta["tag"])


def train_candidates(
    df: DataFrame, spec: ModelSpec, run_ts: datetime, names: Sequence[str] | None = None
) -> list[Trained]:
    """Train on the first 80 % by time, measure on the rest. Too few rows give no model."""
    fe.assert_no_leakage([*spec.categorical, *spec.numeric])
    rows_df = df.filter(F.col(spec.label).isNotNull())
    stored = materialize(
        filled(rows_df.select(spec.key, spec.ts, spec.label, *spec.categorical, *spec.numeric), spec), "training"
    )
    rows = stored.count()
    if rows < spec.min_rows:
        return []
    labels: tuple[str, ...] = ()
    if spec.calibrated:
        labelled = stored.withColumn("label", F.col(spec.label).cast("double"))
    else:
        indexer: StringIndexerModel = StringIndexer(
            inputCol=spec.label, outputCol="label", stringOrderType="alphabetAsc"
        ).fit(stored)
        labels = tuple(indexer.labels)
        labelled = indexer.transform(stored)
    train, test = chrono_split(labelled, spec.ts, spec.key)
    prep = preprocessor(spec).fit(train)
    train_rows = int(rows * 0.8)
    ready = balanced_weights(prep.transform(train)).select(spec.key, "label", "weight", "features")
    ready = with_folds(ready, spec.key) if spec.calibrated else materialize(ready, "features")

    def fit(item: tuple[str, Estimator]) -> Trained:
        name, estimator = item
        model = fit_calibrated(estimator, ready, spec.key) if spec.calibrated else estimator.fit(ready)
        one = Trained(spec, name, prep, model, labels, {}, version_tag(run_ts, name))
        return Trained(spec, name, prep, model, labels, evaluate(one, test), one.tag)

    # the candidates' jobs share the cluster
    wanted = [item for item in candidates(spec, train_rows).items() if names is None or item[0] in names]
    with ThreadPool(max(len(wanted), 1)) as pool:
        return pool.map(inheritable_thread_target(fit), wanted, chunksize=1)


def evaluate(trained: Trained, test: DataFrame) -> dict[str, float]:
    spec = trained.spec
    if spec.calibrated:
        row = binary_metrics(trained.score(test), spec.label, "probability").first()
    else:
        row = multiclass_metrics(trained.predict_class(test), spec.label, "predicted")[0].first()
    return {} if row is None else {k: float(v) for k, v in row.asDict().items() if v is not None}


def version_rows(trained: Sequence[Trained], run_ts: datetime, dataset_version: str | None, base_path: str, commit: str = "") -> list[dict]:
    """Registry rows of one run."""
    return [
        {
            "version_id": f"{t.spec.model_type}-{t.tag}",
            "model_name": t.name,
            "model_type": t.spec.model_type,
            "version_tag": t.tag,
            "artifact_path": f"{base_path}/{t.spec.model_type}/{t.tag}",
            "metrics": {k: float(v) for k, v in t.metrics.items() if is_number(v)},
            "feature_names": [*t.spec.categorical, *t.spec.numeric],
            "params": {"git_commit": commit},
            "dataset_version": dataset_version,
            "calibration_status": "isotonic" if t.spec.calibrated else "none",
            "trained_at": run_ts,
        }
        for t in trained
    ]


def pick_champion(spark: SparkSession, trained: Sequence[Trained], incumbent: Mapping[str, float] | None = None) -> Trained | None:
    """The candidate of this run that the gate promotes over the incumbent's metrics, or None."""
    if not trained:
        return None
    spec = trained[0].spec
    # the incumbent was trained first, so that a candidate as good as it wins
    rows = [("", "", spec.model_type, 0, {k: float(v) for k, v in (incumbent or {}).items() if is_number(v)})]
    rows += [(t.tag, t.name, spec.model_type, 1, {k: float(v) for k, v in t.metrics.items() if is_number(v)}) for t in trained]
    versions = spark.createDataFrame(rows, "version_id string, model_name string, model_type string, trained_at int, metrics map<string,double>")
    held = gate_history(versions, spec.metric).first()
    return next((t for t in trained if held and t.tag == held["champion_version"]), None)


def retrain_all(
    spark: SparkSession, jobs: Mapping[str, Callable[[], str | None]], clock: Callable[[], datetime]
) -> DataFrame:
    """Run every training job; one failure does not stop the others. Returns the run history."""
    from claimloom.sources.schemas import JOB_RUN

    history = []
    for model_type, job in jobs.items():
        started, status, error, champion = clock(), "SUCCESS", None, None
        try:
            champion = job()
        except Exception as failure:  # noqa: BLE001 - the error text is the job's result
            status, error = "FAILURE", f"{type(failure).__name__}: {failure}"
        history.append((model_type, status, error, champion, started, clock()))
    return spark.createDataFrame(history, JOB_RUN)


def denial_predictions(scored: DataFrame) -> DataFrame:
    """Prediction rows of the denial model: probability, risk band, version."""
    return scored.select(
        "claim_id",
        F.col("probability").alias("denial_probability"),
        rules.risk_band(F.col("probability")).alias("risk_category"),
        "model_version",
    )
