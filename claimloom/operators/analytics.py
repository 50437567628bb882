"""Dashboard, payer and provider intelligence, root causes, rollup and revenue funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions.numbers import half_up, money, money_sum
from claimloom.functions.rules import PREVENTABLE_REASONS
from claimloom.operators.features import latest_denials
from claimloom.operators.recovery import with_recovery_scores

HIGH_AMOUNT = 5000.0


def claims_with_denial(claims: DataFrame, denials: DataFrame) -> DataFrame:
    """Every claim once, with its latest denial or nulls."""
    return claims.join(latest_denials(denials), "claim_id", "left")


def _scored(claims: DataFrame, denials: DataFrame, appeal_scores: DataFrame | None) -> DataFrame:
    joined = claims_with_denial(claims, denials)
    if appeal_scores is not None:
        scores = appeal_scores.select("claim_id", F.col("probability").alias("_p"))
        return with_recovery_scores(joined.join(scores, "claim_id", "left"), "_p")
    return with_recovery_scores(joined)


def dashboard_totals(
    claims: DataFrame,
    denials: DataFrame,
    appeal_scores: DataFrame | None = None,
    workflow_actions: DataFrame | None = None,
) -> DataFrame:
    """One row of portfolio totals; pending review is a real count of open actions."""
    denied = F.col("denial_reason_code").isNotNull()
    at_risk = F.when(denied, F.col("claim_amount"))
    preventable = F.when(F.col("denial_reason_code").isin(PREVENTABLE_REASONS), F.col("claim_amount"))
    totals = _scored(claims, denials, appeal_scores).agg(
        F.count(F.lit(1)).alias("total_claims"),
        money_sum(F.col("claim_amount")).alias("total_billed"),
        F.count_if(denied).alias("claims_at_risk"),
        money_sum(at_risk).alias("revenue_at_risk"),
        money_sum(preventable).alias("preventable_revenue"),
        half_up(
            F.coalesce(F.sum(money(at_risk)), F.lit(0)) - F.coalesce(F.sum(money(preventable)), F.lit(0)), 2
        ).alias("recoverable_revenue"),
        money_sum(F.when(denied, F.col("expected_recovery"))).alias("expected_recovery"),
        F.count_if(denied & (F.col("claim_amount") > HIGH_AMOUNT)).alias("high_priority_claims"),
    )
    rate = F.when(F.col("total_claims") > 0, F.col("claims_at_risk") / F.col("total_claims")).otherwise(0.0)
    totals = totals.withColumn("denial_rate", half_up(rate, 4)).withColumn("clean_claim_rate", half_up(1 - rate, 4))
    if workflow_actions is None:
        return totals.withColumn("pending_human_review", F.lit(0).cast("bigint"))
    pending = workflow_actions.agg(F.count_if(F.col("status") == "PENDING_APPROVAL").alias("pending_human_review"))
    # Two one-row aggregates side by side.
    return totals.withColumn("_one", F.lit(1)).join(pending.withColumn("_one", F.lit(1)), "_one").drop("_one")


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First `n` rows per group; Spark prunes each map task to `n` per group before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def entity_intelligence(
    claims: DataFrame, denials: DataFrame, dim: DataFrame, key: str, top_n: int = 3
) -> DataFrame:
    """Per payer or provider: volume, denial rate, top reasons and amount at risk."""
    joined = claims_with_denial(claims, denials)
    denied = F.col("denial_reason_code").isNotNull()
    # One aggregate per (entity, reason) feeds everything, so a hot entity is combined map-side.
    per_reason = joined.groupBy(key, "denial_reason_code").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money(F.col("claim_amount"))).alias("amount")
    )
    volume = per_reason.groupBy(key).agg(
        F.sum("n").alias("claim_volume"),
        F.sum(F.when(denied, F.col("n")).otherwise(0)).alias("denied_claims"),
        half_up(F.coalesce(F.sum(F.when(denied, F.col("amount"))), F.lit(0)), 2).alias("revenue_at_risk"),
    )
    ranked = top_n_per_group(per_reason.filter(denied), [key], [F.col("n").desc(), F.col("denial_reason_code")], top_n)
    reasons = ranked.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "denial_reason_code", "n"))).alias("_r")
    ).select(key, F.transform("_r", lambda r: F.struct(r["denial_reason_code"].alias("reason"), r["n"].alias("count"))).alias("top_denial_reasons"))
    return (
        volume.join(reasons, key, "left")
        .join(dim.select(key, "name"), key, "left")
        .select(
            key,
            F.coalesce("name", F.lit("Unknown")).alias("name"),
            "claim_volume",
            half_up(F.col("denied_claims") / F.col("claim_volume"), 4).alias("denial_rate"),
            F.coalesce(
                "top_denial_reasons", F.array().cast("array<struct<reason:string,count:bigint>>")
            ).alias("top_denial_reasons"),
            "revenue_at_risk",
        )
        .orderBy(F.col("denial_rate").desc(), key)
    )


def denial_root_causes(denials: DataFrame) -> DataFrame:
    counts = denials.groupBy("denial_reason_code").agg(F.count(F.lit(1)).alias("count"))
    # One row per reason code from here on.
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return counts.select(
        F.col("denial_reason_code").alias("reason"), "count", half_up(100.0 * F.col("count") / total, 1).alias("percent")
    ).orderBy(F.col("count").desc(), "reason")


def denial_rollup(claims: DataFrame, denials: DataFrame) -> DataFrame:
    """Payer, provider and reason subtotals in one pass; `level` is the grouping id."""
    joined = claims_with_denial(claims, denials).filter(F.col("denial_reason_code").isNotNull())
    rolled = joined.rollup("payer_id", "provider_id", "denial_reason_code").agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count(F.lit(1)).alias("denials"),
        money_sum(F.col("claim_amount")).alias("amount"),
    )
    return rolled


def revenue_funnel(claims: DataFrame, denials: DataFrame, appeal_scores: DataFrame | None = None) -> DataFrame:
    """Billed, preventable, non-preventable, recoverable, expected and write-off amounts.

    Recoverable counts denied claims that can be appealed and have a positive expected
    value; what is neither expected back nor preventable is written off.
    """
    denied = F.col("denial_reason_code").isNotNull()
    preventable = denied & F.col("denial_reason_code").isin(PREVENTABLE_REASONS)
    recoverable = denied & (F.col("expected_recovery") > 0)

    def amount(condition: Column, column: str = "claim_amount") -> Column:
        return money_sum(F.when(condition, F.col(column)))

    sums = _scored(claims, denials, appeal_scores).agg(
        money_sum(F.col("claim_amount")).alias("billed"),
        amount(denied).alias("denied"),
        amount(preventable).alias("preventable"),
        amount(denied & ~F.col("denial_reason_code").isin(PREVENTABLE_REASONS)).alias("non_preventable"),
        amount(recoverable).alias("recoverable"),
        amount(recoverable, "expected_recovery").alias("expected"),
    )
    return sums.withColumn("write_off", half_up(F.col("denied") - F.col("expected"), 2))


def anomaly_summary(
    scored: DataFrame,
    severity: str | None = None,
    payer_id: int | str | None = None,
    provider_id: int | str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(one summary row with severity counts, matching items by score).

    `scored` must already carry scores computed against the whole data set; the filters
    only choose what is reported.
    """
    for column, value in (("payer_id", payer_id), ("provider_id", provider_id), ("severity", severity)):
        if value is not None:
            scored = scored.filter(F.col(column) == value)
    total = F.count(F.lit(1))
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("HIGH", "MEDIUM", "LOW", "NORMAL")]
    summary = scored.agg(
        total.alias("total_claims_scored"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        half_up(
            F.when(total > 0, 100.0 * F.count_if("is_anomaly") / total).otherwise(0.0), 2
        ).alias("anomaly_percentage"),
        *counts,
    )
    return summary, scored.orderBy(F.col("anomaly_score").desc(), "claim_id")


def business_kpis(appeals: DataFrame, denials: DataFrame, claims: DataFrame, staff_hours: float) -> DataFrame:
    """Recovery yield, recovery per staff hour, appeal success rate and mean days to a decision."""
    joined = appeals.join(denials.withColumnRenamed("denial_id", "denial_event_id"), "denial_event_id").join(
        claims.select("claim_id", "claim_amount"), "claim_id"
    )
    resolved = F.col("outcome").isin("WON", "LOST", "PARTIAL")
    days = (F.unix_micros("decision_date") - F.unix_micros("denial_date")) / F.lit(86_400_000_000.0)
    recovered = F.sum(money(F.col("recovered_amount"))).cast("double")
    return joined.filter(resolved).agg(
        F.count(F.lit(1)).alias("resolved_appeals"),
        half_up(F.count_if(F.col("outcome") == "WON") / F.count(F.lit(1)), 4).alias("appeal_success_rate"),
        half_up(recovered, 2).alias("recovered"),
        half_up(recovered / F.sum(money(F.col("claim_amount"))).cast("double"), 4).alias("recovery_yield"),
        half_up(recovered / F.lit(float(staff_hours)), 2).alias("recovery_per_staff_hour"),
        half_up(F.avg(days), 4).alias("average_resolution_days"),
    )
