"""Queries over claims: rules, recovery, analytics, features, drift and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import rules
from claimloom.functions.numbers import half_up
from claimloom.operators import analytics, drift, features, metrics, recovery
from claimloom.operators.history import with_asof_rates
from claimloom.operators.ordered import average_pct_rank, chrono_split, reference_current_conditions, reference_current_split
from claimloom.plans.registry import query
from claimloom.sources.fixtures import AS_OF, Tables

def as_of():
    return F.lit(AS_OF).cast("timestamp")


def joined_list(column, sep: str = "|"):
    return F.array_join(column, sep)


def denied(t: Tables) -> DataFrame:
    return t.claims.join(t.denials, "claim_id")


def denial_matrix(t: Tables) -> DataFrame:
    return features.denial_features(t.claims, t.lines, t.denials, t.payers, t.providers)


def appeal_matrix(t: Tables) -> DataFrame:
    return features.appeal_features(t.appeals, t.denials, t.claims, t.lines, t.payers, t.providers)


@query
def recovery_queue_topk(t: Tables) -> DataFrame:
    queue = recovery.recovery_queue(t.claims, t.denials, as_of())
    return recovery.queue_page(queue, "priority_score", limit=50)


@query
def recovery_queue_all(t: Tables) -> DataFrame:
    return recovery.recovery_queue(t.claims, t.denials, as_of())


@query
def recovery_queue_payer_tier(t: Tables) -> DataFrame:
    queue = recovery.recovery_queue(t.claims, t.denials, as_of(), tier="HIGH", payer_id=7)
    return recovery.queue_page(queue, "expected_recovery", limit=20, offset=2)


@query
def claim_validation(t: Tables) -> DataFrame:
    coded = features.claim_line_features(t.lines).select("claim_id", "lines_coded")
    checked = t.claims.join(coded, "claim_id", "left").select(
        "claim_id", rules.validation(F.col("lines_coded")).alias("v")
    )
    return checked.select(
        "claim_id",
        F.col("v.readiness_score").cast("bigint").alias("readiness_score"),
        F.col("v.passed_checks").cast("bigint").alias("passed_checks"),
        F.col("v.total_checks").cast("bigint").alias("total_checks"),
        F.size("v.errors").cast("bigint").alias("n_errors"),
        F.size("v.warnings").cast("bigint").alias("n_warnings"),
        joined_list(F.transform("v.checks", lambda c: F.concat(c["name"], F.lit("="), c["status"]))).alias("checks"),
        joined_list("v.recommended_corrections").alias("corrections"),
    )


@query
def denial_reason_rules(t: Tables) -> DataFrame:
    predicted = t.claims.select("claim_id", rules.denial_reason().alias("p"))
    alternatives = F.transform(
        "p.alternatives", lambda a: F.concat(a["reason"], F.lit(":"), F.format_number(a["confidence"], 4))
    )
    return predicted.select(
        "claim_id", "p.predicted_reason", "p.confidence", "p.source", joined_list(alternatives).alias("alternatives")
    )


@query
def appeal_probability_heuristic(t: Tables) -> DataFrame:
    p = rules.appeal_probability(F.col("denial_reason_code"))
    return denied(t).select(
        "claim_id", p.alias("appeal_success_probability"), rules.appeal_band(p).alias("appeal_band")
    )


@query
def expected_recovery(t: Tables) -> DataFrame:
    p = rules.appeal_probability(F.col("denial_reason_code"))
    value = rules.expected_recovery(F.col("claim_amount"), p)
    return denied(t).select(
        "claim_id", value.alias("expected_recovery"), rules.appeal_priority(value).alias("appeal_priority")
    )


@query
def next_best_action(t: Tables) -> DataFrame:
    return recovery.with_recovery_scores(denied(t)).select(
        "claim_id",
        "recommended_action",
        F.col("estimated_effort_minutes").cast("bigint").alias("estimated_effort_minutes"),
        rules.action_reason(F.col("recommended_action")).alias("action_reason"),
    )


@query
def dashboard_totals(t: Tables) -> DataFrame:
    status = F.when(F.col("claim_id") % 10 == 0, "EXECUTED").otherwise("PENDING_APPROVAL").alias("status")
    actions = t.denials.filter(F.col("denial_reason_code").isNotNull()).select("claim_id").distinct().select("claim_id", status)
    return analytics.dashboard_totals(t.claims, t.denials, workflow_actions=actions)


@query
def revenue_funnel(t: Tables) -> DataFrame:
    return analytics.revenue_funnel(t.claims, t.denials)


def _flat_reasons(df: DataFrame) -> DataFrame:
    pairs = F.transform("top_denial_reasons", lambda r: F.concat(r["reason"], F.lit(":"), r["count"].cast("string")))
    return df.withColumn("top_denial_reasons", joined_list(pairs))


@query
def payer_intelligence(t: Tables) -> DataFrame:
    return _flat_reasons(analytics.entity_intelligence(t.claims, t.denials, t.payers, "payer_id"))


@query
def provider_intelligence(t: Tables) -> DataFrame:
    return _flat_reasons(analytics.entity_intelligence(t.claims, t.denials, t.providers, "provider_id"))


@query
def denial_root_causes(t: Tables) -> DataFrame:
    return analytics.denial_root_causes(t.denials)


@query
def denial_rollup(t: Tables) -> DataFrame:
    return analytics.denial_rollup(t.claims, t.denials)


@query
def business_kpis(t: Tables) -> DataFrame:
    return analytics.business_kpis(t.appeals, t.denials, t.claims, staff_hours=2000.0)


@query
def claim_line_features(t: Tables) -> DataFrame:
    return features.claim_line_features(t.lines).withColumn(
        "line_amount_variance", half_up(F.col("line_amount_variance"), 4)
    )


def _labelled(t: Tables) -> DataFrame:
    """Submitted claims with their denial label."""
    labels = features.latest_denials(t.denials).select("claim_id", "denial_date", F.lit(1).alias("_d"))
    joined = t.claims.filter(F.col("submission_date").isNotNull()).join(labels, "claim_id", "left")
    return joined.withColumn("is_denied", F.coalesce("_d", F.lit(0)))


@query
def asof_denial_rate(t: Tables) -> DataFrame:
    rated = with_asof_rates(_labelled(t), features.DENIAL_RATE_KEYS, "submission_date", "is_denied")
    return rated.select("claim_id", *[half_up(F.col(c), 8).alias(c) for c in features.DENIAL_RATE_KEYS])


@query
def asof_denial_rate_known(t: Tables) -> DataFrame:
    """Strict knowledge time: a denial counts from its denial date on."""
    rated = with_asof_rates(
        _labelled(t), features.DENIAL_RATE_KEYS, "submission_date", "is_denied", label_time="denial_date"
    )
    return rated.select("claim_id", *[half_up(F.col(c), 8).alias(c) for c in features.DENIAL_RATE_KEYS])


@query
def asof_appeal_rate(t: Tables) -> DataFrame:
    rows = features.resolved_appeals(t.appeals, t.denials, t.claims).withColumn(
        "appeal_success", (F.col("outcome") == "WON").cast("int")
    )
    rated = with_asof_rates(
        rows, features.APPEAL_RATE_KEYS, "appeal_date", "appeal_success", prior=features.APPEAL_RATE_PRIOR
    )
    return rated.select("appeal_id", *[half_up(F.col(c), 8).alias(c) for c in features.APPEAL_RATE_KEYS])


@query
def asof_lookup(t: Tables) -> DataFrame:
    """Payer denial rate as of every claim's service date (probes differ from events)."""
    rated = with_asof_rates(
        t.claims, {"payer_rate": "payer_id"}, "service_date", "is_denied",
        events=_labelled(t), event_ts="submission_date",
    )
    return rated.select("claim_id", half_up(F.col("payer_rate"), 8).alias("payer_rate"))


def _rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[half_up(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query
def denial_features(t: Tables) -> DataFrame:
    matrix = denial_matrix(t).drop("submission_date", "service_date")
    rounded = _rounded(matrix, ["claim_amount", "documentation_completeness", *features.DENIAL_RATE_KEYS])
    return rounded.withColumn("days_to_submission", F.col("days_to_submission").cast("bigint"))


@query
def denial_features_serving(t: Tables) -> DataFrame:
    matrix = features.denial_features(t.claims, t.lines, t.denials, t.payers, t.providers, mode="serving")
    return matrix.select(
        "claim_id",
        F.col("days_to_submission").cast("bigint").alias("days_to_submission"),
        *[half_up(F.col(c), 8).alias(c) for c in features.DENIAL_RATE_KEYS],
    )


@query
def appeal_features(t: Tables) -> DataFrame:
    matrix = appeal_matrix(t).drop("appeal_date")
    return _rounded(matrix, ["claim_amount", "documentation_completeness", *features.APPEAL_RATE_KEYS])


@query
def appeal_features_serving(t: Tables) -> DataFrame:
    matrix = features.appeal_serving_features(t.claims, t.denials, t.appeals, t.lines, t.payers, t.providers)
    return matrix.select(
        "claim_id", "denial_reason", "appeal_timing_days", *[half_up(F.col(c), 8).alias(c) for c in features.APPEAL_RATE_KEYS]
    )


@query
def anomaly_features(t: Tables) -> DataFrame:
    matrix = features.anomaly_features(t.claims, t.lines)
    floats = [
        "claim_amount",
        "claim_amount_percentile",
        "provider_claim_frequency",
        "payer_claim_frequency",
        "procedure_frequency",
        "provider_average_claim_amount",
        "payer_average_claim_amount",
        "claim_line_amount_variance",
        "duplicate_similarity_score",
    ]
    return _rounded(matrix, floats, 4)


@query
def near_duplicate_claims(t: Tables) -> DataFrame:
    rows = features.with_lines(t.claims, t.lines).select(
        "claim_id", "provider_id", "procedure_code", "service_date", "claim_amount"
    )
    close = features.near_duplicates(rows, ["provider_id", "procedure_code", "service_date"], "claim_amount", "claim_id")
    return close.filter(F.col("group_size") > 1)


@query
def amount_percentile(t: Tables) -> DataFrame:
    ranked = average_pct_rank(t.claims.select("claim_id", "claim_amount"), "claim_amount", "percentile")
    return ranked.select("claim_id", half_up(F.col("percentile"), 8).alias("percentile"))


def _submitted(t: Tables) -> DataFrame:
    return t.claims.filter(F.col("submission_date").isNotNull())


@query
def chrono_split_sizes(t: Tables) -> DataFrame:
    train, test = chrono_split(_submitted(t).select("claim_id", "submission_date"), "submission_date", "claim_id")
    return train.select("claim_id", F.lit("train").alias("part")).unionByName(
        test.select("claim_id", F.lit("test").alias("part"))
    )


@query
def reference_current_rows(t: Tables) -> DataFrame:
    rows = _submitted(t).select("claim_id", "submission_date")
    reference, current = reference_current_split(rows, "submission_date", "claim_id", 500)
    return reference.select("claim_id", F.lit("reference").alias("part")).unionByName(
        current.select("claim_id", F.lit("current").alias("part"))
    )


def drift_frame(t: Tables, columns: list[str], window: int | None = 500) -> DataFrame:
    keys = _submitted(t).select("submission_date", "claim_id")
    reference, current = reference_current_conditions(keys, "submission_date", "claim_id", window)
    return drift.tagged_by(denial_matrix(t), reference, current, columns)


@query
def psi_numeric(t: Tables) -> DataFrame:
    both = drift_frame(t, features.DENIAL_NUMERIC)
    prefix = drift.numeric_prefix(both, features.DENIAL_NUMERIC)
    return drift.psi_numeric(prefix, drift.feature_profiles(prefix))


@query
def psi_categorical(t: Tables) -> DataFrame:
    both = drift_frame(t, features.DENIAL_CATEGORICAL)
    return drift.psi_categorical(drift.category_counts(both, features.DENIAL_CATEGORICAL))


@query
def category_frequencies(t: Tables) -> DataFrame:
    both = drift_frame(t, features.DENIAL_CATEGORICAL)
    return drift.category_shares(drift.category_counts(both, features.DENIAL_CATEGORICAL))


@query
def ks_statistic(t: Tables) -> DataFrame:
    both = drift_frame(t, features.DENIAL_NUMERIC)
    prefix = drift.numeric_prefix(both, features.DENIAL_NUMERIC)
    return drift.ks_two_sample(prefix, drift.feature_profiles(prefix)).drop("ks_pvalue")


@query
def missing_drift(t: Tables) -> DataFrame:
    """Null rates of raw claim dates, where nulls do occur."""
    rows = t.claims.select(
        "claim_id",
        "service_date",
        F.unix_micros("submission_date").alias("submission"),
        F.unix_micros("timely_filing_deadline").alias("deadline"),
    )
    reference, current = reference_current_split(rows, "service_date", "claim_id", None)
    both = drift.tagged(reference, current, ["submission", "deadline"])
    return drift.missing_drift(drift.slice_stats(both, ["submission", "deadline"]))


@query
def drift_report(t: Tables) -> DataFrame:
    both = drift_frame(t, [*features.DENIAL_NUMERIC, *features.DENIAL_CATEGORICAL])
    report = drift.drift_report(both, features.DENIAL_NUMERIC, features.DENIAL_CATEGORICAL)
    return report.drop("ks_pvalue", "reference_distribution", "current_distribution")


def heuristic_scores(t: Tables) -> DataFrame:
    """Decided appeals with the baseline probability as their score."""
    rows = features.resolved_appeals(t.appeals, t.denials, t.claims)
    return rows.select(
        "appeal_id",
        "claim_id",
        "payer_id",
        "appeal_date",
        "claim_amount",
        (F.col("outcome") == "WON").cast("int").alias("appeal_success"),
        half_up(
            rules.appeal_probability_heuristic(F.col("denial_reason")), 4
        ).alias("score"),
    )


@query
def segment_scores(t: Tables) -> DataFrame:
    return drift.segment_drift(heuristic_scores(t), "payer_id", "score")


@query
def ranking_metrics(t: Tables) -> DataFrame:
    _, test = chrono_split(heuristic_scores(t), "appeal_date", "appeal_id")
    return metrics.evaluate_recovery_ranking(test, F.col("score"), with_random=False)


@query
def ranking_eval_random(t: Tables) -> DataFrame:
    _, test = chrono_split(heuristic_scores(t), "appeal_date", "appeal_id")
    return metrics.evaluate_recovery_ranking(test, F.col("score"), with_random=True)


@query
def capacity_plan(t: Tables) -> DataFrame:
    plan = recovery.capacity_plan(recovery.open_denials(t.claims, t.denials), staff_hours=40.0)
    return plan.withColumn("worked_claim_ids", joined_list("worked_claim_ids", ","))


@query
def capacity_plan_large(t: Tables) -> DataFrame:
    """A budget beyond the top-n bound, so the global order is used."""
    plan = recovery.capacity_plan(recovery.open_denials(t.claims, t.denials), staff_hours=400.0)
    return plan.withColumn("worked_claim_ids", joined_list("worked_claim_ids", ","))


@query
def binary_metrics(t: Tables) -> DataFrame:
    return metrics.binary_metrics(heuristic_scores(t), "appeal_success", "score")


@query
def calibration_curve(t: Tables) -> DataFrame:
    return metrics.calibration_curve(heuristic_scores(t), "appeal_success", "score")


def _rule_vs_recorded(t: Tables) -> DataFrame:
    return denied(t).select(
        F.col("denial_reason_code").alias("recorded"), rules.denial_reason()["predicted_reason"].alias("predicted")
    )


@query
def confusion_metrics(t: Tables) -> DataFrame:
    _, per_class, _ = metrics.multiclass_metrics(_rule_vs_recorded(t), "recorded", "predicted")
    return per_class


@query
def confusion_summary(t: Tables) -> DataFrame:
    summary, _, _ = metrics.multiclass_metrics(_rule_vs_recorded(t), "recorded", "predicted")
    return summary


WHAT_IF = [
    {"scenario": "complete_documentation", "documentation_completeness": 100.0},
    {"scenario": "obtain_authorization", "authorization_status": "PRESENT"},
    {"scenario": "half_amount_fixed_eligibility", "claim_amount": 1000.0, "eligibility_status": "VERIFIED", "status": "PAID"},
]


@query
def what_if_heuristic(t: Tables) -> DataFrame:
    return recovery.what_if_appeal(denied(t), WHAT_IF)
