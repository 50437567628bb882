"""Recovery queue, capacity plan and what-if re-scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions import rules
from claimloom.functions.numbers import half_up, money, whole_days
from claimloom.operators.ordered import ordered_prefix

DESCENDING_SORTS = ("priority_score", "expected_recovery", "claim_amount")
ASCENDING_SORTS = ("days_since_denial", "appeal_success_probability", "claim_number", "payer_id", "denial_reason")

# Strategies in report order.
STRATEGIES = {
    "highest_claim_amount": "claim_amount",
    "highest_appeal_probability": "appeal_success_probability",
    "highest_expected_recovery": "expected_recovery",
}
MAX_STAFF_HOURS = 10_000


def with_recovery_scores(denied: DataFrame, model_probability: str | None = None) -> DataFrame:
    """Add probability, expected recovery, action and effort to claim x denial rows."""
    probability = rules.appeal_probability(
        F.col("denial_reason_code"), F.col(model_probability) if model_probability else None
    )
    return (
        denied.withColumn("appeal_success_probability", probability)
        .withColumn("expected_recovery", rules.expected_recovery(F.col("claim_amount"), F.col("appeal_success_probability")))
        .withColumn(
            "recommended_action",
            rules.next_action(F.col("denial_reason_code"), F.col("expected_recovery"), F.col("appeal_success_probability")),
        )
        .withColumn("estimated_effort_minutes", rules.action_minutes(F.col("recommended_action")))
    )


def open_denials(claims: DataFrame, denials: DataFrame, appeal_scores: DataFrame | None = None) -> DataFrame:
    """Claims in status DENIED with their denial rows and, if given, model probabilities per claim."""
    joined = claims.filter(F.col("status") == "DENIED").join(denials, "claim_id")
    if appeal_scores is None:
        return with_recovery_scores(joined)
    scores = appeal_scores.select("claim_id", F.col("probability").alias("_p"))
    return with_recovery_scores(joined.join(scores, "claim_id", "left"), "_p").drop("_p")


def recovery_queue(
    claims: DataFrame,
    denials: DataFrame,
    as_of: Column,
    appeal_scores: DataFrame | None = None,
    tier: str | None = None,
    payer_id: int | str | None = None,
    effort_minutes: float = rules.QUEUE_EFFORT_MINUTES,
) -> DataFrame:
    """All queue entries; sort and page with `queue_page`."""
    if payer_id is not None:
        claims = claims.filter(F.col("payer_id") == payer_id)
    scored = open_denials(claims, denials, appeal_scores)
    entries = (
        scored.withColumn("days_since_denial", whole_days(as_of, F.col("denial_date")))
        .withColumn("urgency_factor", rules.urgency(F.col("days_since_denial")))
        .withColumn(
            "priority_score",
            rules.priority_score(
                F.col("expected_recovery"), F.col("urgency_factor"), F.col("appeal_success_probability"), effort_minutes
            ),
        )
        .withColumn("priority_tier", rules.priority_tier(F.col("priority_score")))
    )
    if tier is not None:
        entries = entries.filter(F.col("priority_tier") == tier)
    return entries.select(
        "claim_id",
        "claim_number",
        "claim_amount",
        F.col("denial_reason_code").alias("denial_reason"),
        "payer_id",
        "days_since_denial",
        "appeal_success_probability",
        "expected_recovery",
        "priority_score",
        "priority_tier",
        "recommended_action",
    )


def queue_page(queue: DataFrame, sort_by: str = "priority_score", limit: int = 50, offset: int = 0) -> DataFrame:
    """Top of the whole queue: a distributed top-k, not a sort of an arbitrary subset."""
    if sort_by in DESCENDING_SORTS:
        key = F.col(sort_by).desc()
    elif sort_by in ASCENDING_SORTS:
        key = F.col(sort_by).asc()
    else:
        raise ValueError(f"unknown sort column: {sort_by}")
    return queue.orderBy(key, F.col("claim_id").asc()).offset(offset).limit(limit)


def worked_claims(scored: DataFrame, staff_hours: float) -> DataFrame:
    """(strategy, rank, claim) rows each strategy works within the staff budget.

    Work stops at the first claim that does not fit; the running effort comes from the
    sliced global order, so no task holds a strategy's rows.
    """
    if not 0 < staff_hours <= MAX_STAFF_HOURS:
        raise ValueError("staff_hours must be in (0, 10000]")
    budget = staff_hours * 60
    effort = F.greatest(F.col("estimated_effort_minutes"), F.lit(1)).cast("bigint")
    options = F.array(
        *[
            F.struct(F.lit(name).alias("strategy"), F.col(column).cast("double").alias("score"))
            for name, column in STRATEGIES.items()
        ]
    )
    long = scored.select("claim_id", "expected_recovery", effort.alias("effort"), F.explode(options).alias("o")).select(
        "o.strategy", "o.score", "claim_id", "expected_recovery", "effort"
    )
    ranked = ordered_prefix(long, ["-score", "claim_id"], ["effort"], ["strategy"])
    return ranked.filter(F.col("cum_effort") <= budget).select(
        "strategy", F.col("pos").cast("bigint").alias("pos"), "claim_id", "expected_recovery", "effort"
    )


def capacity_plan(scored: DataFrame, staff_hours: float = 40.0, sample_ids: int = 20) -> DataFrame:
    """One row per strategy with workload, captured recovery, yield and the best-strategy flag.

    No denied claims give no rows.
    """
    gain = F.when(F.col("expected_recovery") > 0, F.col("expected_recovery")).otherwise(0.0)
    totals = scored.agg(F.count(F.lit(1)).alias("claims_available"), F.sum(money(gain)).alias("total_gain"))
    per_strategy = (
        worked_claims(scored, staff_hours)
        .groupBy("strategy")
        .agg(
            F.count(F.lit(1)).alias("claims_processed"),
            F.sum("effort").alias("minutes"),
            F.sum(money(gain)).alias("captured"),
            F.array_sort(
                F.collect_list(F.when(F.col("pos") <= sample_ids, F.struct("pos", "claim_id")))
            ).alias("_ids"),
        )
    )
    names = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("strategy")) for i, n in enumerate(STRATEGIES)])
    frame = totals.filter(F.col("claims_available") > 0).select("*", F.explode(names).alias("s")).select(
        "claims_available", "total_gain", "s.*"
    )
    joined = frame.join(per_strategy, "strategy", "left")
    captured = F.coalesce(F.col("captured").cast("double"), F.lit(0.0))
    total = F.col("total_gain").cast("double")
    plan = joined.select(
        "strategy",
        "ord",
        F.coalesce("claims_processed", F.lit(0).cast("bigint")).alias("claims_processed"),
        "claims_available",
        half_up(F.coalesce("minutes", F.lit(0)) / F.lit(60.0), 2).alias("staff_hours_used"),
        F.lit(float(staff_hours)).alias("staff_hours_budget"),
        half_up(captured, 2).alias("expected_recovery_captured"),
        half_up(total, 2).alias("total_expected_recovery"),
        F.when(total > 0, half_up(captured / total, 4)).otherwise(0.0).alias("recovery_yield"),
        F.coalesce(F.transform("_ids", lambda s: s["claim_id"].cast("string")), F.array().cast("array<string>")).alias(
            "worked_claim_ids"
        ),
    )
    # Three rows: one small window picks the best, the first strategy winning ties.
    best = Window.partitionBy(F.lit(1)).orderBy(F.col("expected_recovery_captured").desc(), F.col("ord").asc())
    return plan.withColumn("is_best", F.row_number().over(best) == 1).drop("ord")


# Fields a scenario may override.
OVERRIDABLE = {
    "authorization_status": "string",
    "eligibility_status": "string",
    "documentation_completeness": "double",
    "claim_amount": "double",
}


def apply_scenarios(claims: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Every claim under every scenario, with original values kept as `original_<field>`.

    A scenario is {"scenario": name, "<field>": value, ...}; fields that may not be
    overridden are ignored. Scenarios are call arguments, so they enter as literals.
    """
    shaped = []
    for s in scenarios:
        fields = [F.lit(s["scenario"]).alias("scenario")]
        fields += [F.lit(s.get(name)).cast(kind).alias(name) for name, kind in OVERRIDABLE.items()]
        applied = [name for name in OVERRIDABLE if s.get(name) is not None]
        fields.append(F.lit(",".join(applied)).alias("applied_overrides"))
        shaped.append(F.struct(*fields))
    crossed = claims.withColumn("_s", F.explode(F.array(*shaped)))
    for name in OVERRIDABLE:
        crossed = crossed.withColumn(f"original_{name}", F.col(name)).withColumn(
            name, F.coalesce(F.col(f"_s.{name}"), F.col(name))
        )
    return crossed.select(
        "*", F.col("_s.scenario").alias("scenario"), F.col("_s.applied_overrides").alias("applied_overrides")
    ).drop("_s")


def what_if_appeal(denied: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Appeal side of a scenario: probability and expected recovery before and after."""
    before = with_recovery_scores(denied).select(
        "*",
        F.col("appeal_success_probability").alias("original_probability"),
        F.col("expected_recovery").alias("original_expected"),
    )
    after = with_recovery_scores(apply_scenarios(before, scenarios))
    return after.select(
        "claim_id",
        "scenario",
        "applied_overrides",
        "original_probability",
        F.col("appeal_success_probability").alias("simulated_probability"),
        half_up(F.col("appeal_success_probability") - F.col("original_probability"), 4).alias("probability_difference"),
        "original_expected",
        F.col("expected_recovery").alias("simulated_expected"),
        F.col("recommended_action").alias("simulated_action"),
    )


def what_if_denial(features: DataFrame, score, scenarios: list[dict]) -> DataFrame:
    """Denial-risk side: `score` maps a feature frame to one with `probability`.

    `features` must hold the overridable source fields and the derived flags
    `auth_missing` and `eligibility_fail`, which are rebuilt after the override.
    """
    original = score(features).select("claim_id", F.col("probability").alias("original_risk"))
    changed = apply_scenarios(features, scenarios)
    changed = changed.withColumn("auth_missing", (F.col("authorization_status") == "MISSING").cast("int")).withColumn(
        "eligibility_fail", (F.col("eligibility_status") == "FAIL").cast("int")
    )
    simulated = score(changed).select(
        "claim_id", "scenario", "applied_overrides", F.col("probability").alias("simulated_risk")
    )
    joined = simulated.join(original, "claim_id")
    return joined.withColumn("risk_difference", half_up(F.col("original_risk") - F.col("simulated_risk"), 4))

