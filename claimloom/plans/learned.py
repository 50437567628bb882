"""Queries that train or apply models. They have no SQL counterpart.

The registered runs use fewer trees and rounds than the library defaults, to keep one
run short; every run trains on and scores whole tables.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import rules
from claimloom.functions.numbers import half_up
from claimloom.models import explain as explaining
from claimloom.models import training
from claimloom.models.forest import IsolationForest, ForestModel, anomaly_report, anomaly_scores, column_moments
from claimloom.operators import analytics, drift, features, metrics, recovery, retrieval
from claimloom.operators.ordered import chrono_split, reference_current_conditions
from claimloom.plans.claims import WHAT_IF, appeal_matrix, as_of, denial_matrix
from claimloom.plans.documents import _open, _policy_results, stored_chunks
from claimloom.plans.registry import query
from claimloom.sources.fixtures import Tables
from claimloom.storage import materialize

RUN_TS = datetime(2001, 10, 1)
DENIAL = replace(training.DENIAL_RISK, forest_trees=20, forest_depth=6, boost_rounds=10)
APPEAL = replace(training.APPEAL_SUCCESS, forest_trees=20, boost_rounds=10)
REASON = replace(training.DENIAL_REASON, forest_trees=20, forest_depth=6, boost_rounds=5)

_FITTED: dict[tuple[str, str, str], object] = {}


def _fitted(t: Tables, name: str, build):
    """Models are fitted once per application and folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _FITTED:
        _FITTED[key] = build()
    return _FITTED[key]


def denial_rows(t: Tables) -> DataFrame:
    return t._staged("denial_matrix", lambda: denial_matrix(t))


def appeal_rows(t: Tables) -> DataFrame:
    return t._staged("appeal_matrix", lambda: appeal_matrix(t))


def denial_serving_rows(t: Tables) -> DataFrame:
    return t._staged(
        "denial_serving",
        lambda: features.denial_features(t.claims, t.lines, t.denials, t.payers, t.providers, mode="serving"),
    )


def _one_candidate(rows: DataFrame, spec: training.ModelSpec, name: str) -> training.Trained:
    trained = training.train_candidates(rows, spec, RUN_TS, [name])
    if not trained:
        raise ValueError(f"{spec.model_type}: fewer than {spec.min_rows} labelled rows")
    return trained[0]


def denial_model(t: Tables) -> training.Trained:
    return _fitted(t, "denial", lambda: _one_candidate(denial_rows(t), DENIAL, "random_forest"))


def appeal_model(t: Tables) -> training.Trained:
    return _fitted(t, "appeal", lambda: _one_candidate(appeal_rows(t), APPEAL, "logistic_regression"))


def reason_model(t: Tables) -> training.Trained:
    denied = denial_rows(t).filter("is_denied = 1 AND denial_reason_code IS NOT NULL")
    return _fitted(t, "reason", lambda: _one_candidate(denied, REASON, "random_forest"))


def anomaly_rows(t: Tables) -> DataFrame:
    return t._staged("anomaly_matrix", lambda: features.anomaly_features(t.claims, t.lines))


def forest_model(t: Tables) -> ForestModel:
    return _fitted(t, "forest", lambda: IsolationForest().fit(anomaly_rows(t), features.ANOMALY_FEATURES, "claim_id"))


@query
def denial_model_scores(t: Tables) -> DataFrame:
    return training.denial_predictions(denial_model(t).score(denial_serving_rows(t)))


def appeal_probabilities(t: Tables) -> DataFrame:
    rows = features.appeal_serving_features(t.claims, t.denials, t.appeals, t.lines, t.payers, t.providers)
    model = appeal_model(t)
    return model.score(rows).select("claim_id", "probability", "model_version")


@query
def appeal_model_scores(t: Tables) -> DataFrame:
    scored = appeal_probabilities(t)
    return scored.withColumn("appeal_band", rules.appeal_band(F.col("probability")))


def reason_predictions(t: Tables) -> DataFrame:
    """Rule, then model, then heuristic, for every claim."""
    model = reason_model(t)
    scored = model.predict_class(denial_serving_rows(t).drop("denial_reason_code")).select("claim_id", "class_scores")
    joined = t.claims.join(scored, "claim_id", "left")
    by_model = F.when(F.col("class_scores").isNotNull(), model.reason_struct())
    return joined.select("claim_id", rules.denial_reason(by_model).alias("p"))


@query
def reason_model_scores(t: Tables) -> DataFrame:
    return reason_predictions(t).select("claim_id", "p.predicted_reason", "p.confidence", "p.source", "p.model_version")


@query
def appeal_model_comparison(t: Tables) -> DataFrame:
    """Registry metrics of every candidate of one training run."""
    trained = training.train_candidates(appeal_rows(t), APPEAL, RUN_TS)
    best = training.pick_champion(t.spark, trained)
    rows = [
        (m.name, m.tag, *[m.metrics.get(k) for k in ("pr_auc", "roc_auc", "f1", "brier_score")], best is not None and m.name == best.name)
        for m in trained
    ]
    schema = "model_name string, version_tag string, pr_auc double, roc_auc double, f1 double, brier_score double, is_champion boolean"
    return t.spark.createDataFrame(rows, schema)


@query
def isolation_forest_scores(t: Tables) -> DataFrame:
    scored = anomaly_scores(anomaly_rows(t), forest_model(t))
    top = F.transform("contributing_features", lambda c: F.concat(c["feature"], F.lit(":"), c["z_score"].cast("string")))
    return scored.select("claim_id", "anomaly_score", "is_anomaly", "severity", F.array_join(top, "|").alias("contributing"))


@query
def anomaly_summary(t: Tables) -> DataFrame:
    summary, _ = analytics.anomaly_summary(anomaly_scores(anomaly_rows(t), forest_model(t)))
    return summary


def proxy_decisions(t: Tables) -> DataFrame:
    """A decision column SQL can compute: amount and duplicate score against fixed bounds."""
    rows = anomaly_rows(t)
    value = 0.4 - F.col("claim_amount_percentile") * 0.5 - F.col("duplicate_similarity_score") * 0.3
    return rows.withColumn("decision", half_up(value, 6))


@query
def anomaly_report_proxy(t: Tables) -> DataFrame:
    """Scores, severity and contributing features from a given decision column."""
    rows = proxy_decisions(t)
    names = ["claim_amount", "days_to_submission", "modifier_count", "procedure_count"]
    scored = anomaly_report(rows, column_moments(rows, names))
    top = F.transform("contributing_features", lambda c: c["feature"])
    return scored.select("claim_id", "anomaly_score", "is_anomaly", "severity", F.array_join(top, "|").alias("contributing"))


@query
def explanations(t: Tables) -> DataFrame:
    rows = denial_serving_rows(t)
    explained = explaining.explain(rows, denial_model(t), denial_rows(t))

    def text(name: str):
        return F.array_join(
            F.transform(name, lambda c: F.concat(c["feature"], F.lit(":"), c["contribution"].cast("string"))), "|"
        ).alias(name)

    return explained.select("claim_id", "base_value", text("top_positive_factors"), text("top_negative_factors"))


@query
def explanations_linear(t: Tables) -> DataFrame:
    explained = explaining.explain(appeal_rows(t), appeal_model(t), appeal_rows(t))
    return explained.select(
        "appeal_id", "base_value", F.size("top_positive_factors").alias("n_positive"), F.size("top_negative_factors").alias("n_negative")
    )


def _prediction_drift(t: Tables) -> DataFrame:
    rows = denial_rows(t)
    reference, current = reference_current_conditions(
        rows.select("submission_date", "claim_id"), "submission_date", "claim_id"
    )
    scored = denial_model(t).score(rows).select("claim_id", "submission_date", "probability")
    return drift.prediction_drift(scored.filter(reference), scored.filter(current), "probability")


@query
def prediction_drift(t: Tables) -> DataFrame:
    return _prediction_drift(t)


@query
def full_drift_check(t: Tables) -> DataFrame:
    """Data and prediction drift together, tallied by status."""
    rows = denial_rows(t)
    reference, current = reference_current_conditions(
        rows.select("submission_date", "claim_id"), "submission_date", "claim_id"
    )
    both = drift.tagged_by(rows, reference, current, [*features.DENIAL_NUMERIC, *features.DENIAL_CATEGORICAL])
    report = drift.drift_report(both, features.DENIAL_NUMERIC, features.DENIAL_CATEGORICAL)
    predicted = _prediction_drift(t)
    names = ["metric_type", "metric_name", "feature_name", "drift_score", "status"]
    return drift.status_tally(report.select(*names).unionByName(predicted.select(*names)))


@query
def recovery_queue_model(t: Tables) -> DataFrame:
    """Queue with model probabilities where the model has one."""
    queue = recovery.recovery_queue(t.claims, t.denials, as_of(), appeal_scores=appeal_probabilities(t))
    return recovery.queue_page(queue, "priority_score", limit=50)


@query
def ranking_eval_model(t: Tables) -> DataFrame:
    rows = appeal_rows(t)
    _, test = chrono_split(rows.select("appeal_date", "appeal_id", "claim_amount", "appeal_success"), "appeal_date", "appeal_id")
    scores = appeal_model(t).score(rows).select("appeal_id", "probability")
    return metrics.evaluate_recovery_ranking(test.join(scores, "appeal_id"), F.col("probability"), with_random=False)


@query
def what_if_denial_risk(t: Tables) -> DataFrame:
    """Denial risk of every claim under each scenario."""
    fields = t.claims.select("claim_id", "authorization_status", "eligibility_status")
    rows = denial_serving_rows(t).join(fields, "claim_id")
    return recovery.what_if_denial(rows, denial_model(t).score, WHAT_IF)


@query
def investigation_bundle(t: Tables) -> DataFrame:
    """Everything known about each open denial in one row of structs."""
    bundles = retrieval.policy_bundles(_policy_results(t), stored_chunks(t))
    # Each part is written by itself, so that the plans and broadcasts of all of them never meet in the driver.
    packets = materialize(retrieval.appeal_packets(_open(t), t.lines, bundles).select("claim_id", "evidence", "citations"), "packets")
    risk = materialize(training.denial_predictions(denial_model(t).score(denial_serving_rows(t))), "risk")
    reasons = materialize(reason_predictions(t), "reasons")
    scores = anomaly_scores(anomaly_rows(t), forest_model(t)).select("claim_id", "anomaly_score", "is_anomaly", "severity")
    anomalies = materialize(scores, "anomalies")
    probabilities = materialize(appeal_probabilities(t), "probabilities")
    scored = materialize(recovery.open_denials(t.claims, t.denials, probabilities), "open-denials")
    return (
        scored.join(risk.hint("merge"), "claim_id")
        .join(reasons.hint("merge"), "claim_id")
        .join(packets.hint("merge"), "claim_id")
        .join(anomalies.hint("merge"), "claim_id", "left")
        .select(
            "claim_id",
            F.struct("denial_probability", "risk_category").alias("risk"),
            F.col("denial_reason_code").alias("denial_reason"),
            F.col("p.predicted_reason").alias("predicted_reason"),
            F.coalesce(F.size("citations"), F.lit(0)).alias("policy_chunks"),
            "evidence",
            "expected_recovery",
            "appeal_success_probability",
            F.struct("anomaly_score", "severity").alias("anomaly"),
            "recommended_action",
        )
    )
