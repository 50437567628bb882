"""Feature matrices for denial risk, appeal success and anomaly scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.numbers import flag, money, whole_days
from claimloom.functions.rules import filing_breach
from claimloom.operators.history import with_asof_rates
from claimloom.operators.ordered import average_pct_rank, ordered_prefix
from claimloom.storage import materialize, small_side

# Feature lists in model order.
DENIAL_CATEGORICAL = ["claim_type", "place_of_service", "payer_type", "provider_specialty", "procedure_code"]
DENIAL_NUMERIC = [
    "claim_amount",
    "documentation_completeness",
    "days_to_submission",
    "modifier_count",
    "procedure_count",
    "line_count",
    "payer_historical_denial_rate",
    "provider_historical_denial_rate",
    "auth_missing",
    "eligibility_fail",
]
APPEAL_CATEGORICAL = ["denial_reason", "payer_type", "provider_specialty", "procedure_code"]
APPEAL_NUMERIC = [
    "claim_amount",
    "documentation_completeness",
    "authorization_missing",
    "eligibility_fail",
    "timely_filing_breach",
    "appeal_timing_days",
    "historical_payer_appeal_rate",
    "historical_reason_appeal_rate",
]
ANOMALY_FEATURES = [
    "claim_amount",
    "claim_amount_percentile",
    "procedure_count",
    "diagnosis_count",
    "modifier_count",
    "days_to_submission",
    "provider_claim_frequency",
    "payer_claim_frequency",
    "procedure_frequency",
    "provider_average_claim_amount",
    "payer_average_claim_amount",
    "claim_line_amount_variance",
    "duplicate_similarity_score",
]
# Columns known only once an appeal is decided.
POST_RESOLUTION_FIELDS = {"outcome", "recovered_amount", "decision_date", "appeal_success"}

# Neutral rates used until enough history exists.
DENIAL_RATE_PRIOR = 0.15
APPEAL_RATE_PRIOR = 0.40
MIN_OBSERVATIONS = 5

DENIAL_RATE_KEYS = {"payer_historical_denial_rate": "payer_id", "provider_historical_denial_rate": "provider_id"}
APPEAL_RATE_KEYS = {"historical_payer_appeal_rate": "payer_id", "historical_reason_appeal_rate": "denial_reason"}


def assert_no_leakage(features: list[str]) -> None:
    leaked = POST_RESOLUTION_FIELDS.intersection(features)
    if leaked:
        raise ValueError(f"post-resolution fields used as features: {sorted(leaked)}")


def claim_line_features(lines: DataFrame) -> DataFrame:
    """Per-claim line aggregates; `line_key` orders the lines of a claim.

    Distinct codes are counted as sets: a set is at most the code list, and two exact
    distinct counts would triple the rows instead.
    """

    def distinct(column: str) -> Column:
        return F.size(F.collect_set(column)).cast("bigint")

    amount = money(F.col("line_amount"))
    n = F.col("line_count").cast("double")
    s1, s2 = F.col("_s1").cast("double"), F.col("_s2").cast("double")
    coded = (F.coalesce(F.col("procedure_code"), F.lit("")) != "") & (
        F.coalesce(F.col("diagnosis_code"), F.lit("")) != ""
    )
    grouped = lines.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        distinct("procedure_code").alias("procedure_count"),
        distinct("diagnosis_code").alias("diagnosis_count"),
        F.count_if(F.coalesce(F.col("modifiers"), F.lit("")) != "").alias("modifier_count"),
        F.min_by("procedure_code", "line_key").alias("first_procedure"),
        F.bool_and(coded).alias("lines_coded"),
        F.sum(amount).alias("_s1"),
        F.sum(amount * amount).alias("_s2"),
    )
    variance = F.when(n > 1, F.greatest((n * s2 - s1 * s1) / (n * n), F.lit(0.0))).otherwise(0.0)
    return grouped.withColumn("line_amount_variance", variance).drop("_s1", "_s2")


def latest_denials(denials: DataFrame) -> DataFrame:
    """One denial per claim: the latest by (denial_date, denial_id)."""
    newest = F.max(F.struct("denial_date", "denial_id", "denial_reason_code"))
    return denials.groupBy("claim_id").agg(newest.alias("d")).select("claim_id", "d.*")


def with_dimensions(claims: DataFrame, payers: DataFrame, providers: DataFrame) -> DataFrame:
    """Payer type and provider specialty; unknown keys get `unknown`."""
    return (
        claims.join(payers.select("payer_id", "payer_type"), "payer_id", "left")
        .join(providers.select("provider_id", F.col("specialty").alias("provider_specialty")), "provider_id", "left")
        .withColumn("payer_type", F.coalesce("payer_type", F.lit("unknown")))
        .withColumn("provider_specialty", F.coalesce("provider_specialty", F.lit("unknown")))
    )


def with_lines(claims: DataFrame, lines: DataFrame) -> DataFrame:
    joined = claims.join(claim_line_features(lines), "claim_id", "left")
    counts = ["line_count", "procedure_count", "diagnosis_count", "modifier_count"]
    return joined.select(
        *[c for c in joined.columns if c not in [*counts, "first_procedure"]],
        *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("first_procedure", F.lit("unknown")).alias("procedure_code"),
    )


def denial_features(
    claims: DataFrame,
    lines: DataFrame,
    denials: DataFrame,
    payers: DataFrame,
    providers: DataFrame,
    mode: str = "training",
    label_time: str | None = None,
) -> DataFrame:
    """Denial-risk matrix.

    `training` keeps submitted claims and takes rates as of submission. `serving` keeps
    every claim, takes rates as of submission or else service date, and counts 0 days
    to submission where there is none. Pass `label_time="denial_date"` to use a denial
    only from the day it was known.
    """
    labels = latest_denials(denials).select("claim_id", "denial_reason_code", "denial_date")
    # Rates come first, on claims and labels alone, so the line aggregate runs once.
    base = (
        claims.join(labels, "claim_id", "left")
        .withColumn("is_denied", F.col("denial_reason_code").isNotNull().cast("int"))
        .withColumn("auth_missing", flag(F.col("authorization_status") == "MISSING"))
        .withColumn("eligibility_fail", flag(F.col("eligibility_status") == "FAIL"))
    )
    days = whole_days(F.col("submission_date"), F.col("service_date"))
    submitted = F.col("submission_date").isNotNull()
    if mode == "training":
        rows = base.filter(submitted).withColumn("days_to_submission", days)
        rated = with_asof_rates(
            rows, DENIAL_RATE_KEYS, "submission_date", "is_denied", MIN_OBSERVATIONS, DENIAL_RATE_PRIOR,
            label_time=label_time,
        )
    elif mode == "serving":
        cutoff = F.coalesce("submission_date", "service_date")
        rows = base.withColumn("days_to_submission", F.coalesce(days, F.lit(0))).withColumn("_cutoff", cutoff)
        events = (
            claims.filter(submitted)
            .join(labels, "claim_id", "left")
            .withColumn("is_denied", F.col("denial_reason_code").isNotNull().cast("int"))
        )
        rated = with_asof_rates(
            rows, DENIAL_RATE_KEYS, "_cutoff", "is_denied", MIN_OBSERVATIONS, DENIAL_RATE_PRIOR,
            events=events, event_ts="submission_date", label_time=label_time,
        )
    else:
        raise ValueError(f"unknown mode: {mode}")
    full = with_lines(with_dimensions(rated, payers, providers), lines)
    keep = ["claim_id", "payer_id", "provider_id", "submission_date", "service_date"]
    return full.select(*keep, *DENIAL_CATEGORICAL, *DENIAL_NUMERIC, "is_denied", "denial_reason_code")


def resolved_appeals(appeals: DataFrame, denials: DataFrame, claims: DataFrame) -> DataFrame:
    """Decided appeals with their denial and claim; rows with a missing parent drop out."""
    decided = appeals.filter(F.col("outcome").isin("WON", "LOST"))
    parents = denials.withColumnRenamed("denial_id", "denial_event_id").withColumnRenamed(
        "denial_reason_code", "denial_reason"
    )
    return decided.join(parents, "denial_event_id").join(claims, "claim_id")


def appeal_features(
    appeals: DataFrame,
    denials: DataFrame,
    claims: DataFrame,
    lines: DataFrame,
    payers: DataFrame,
    providers: DataFrame,
    label_time: str | None = None,
) -> DataFrame:
    """Appeal-success matrix with rates as of the appeal date."""
    rows = resolved_appeals(appeals, denials, claims)
    timing = F.greatest(whole_days(F.col("appeal_date"), F.col("denial_date")), F.lit(0).cast("bigint"))
    rows = (
        rows.withColumn("authorization_missing", flag(F.col("authorization_status") == "MISSING"))
        .withColumn("eligibility_fail", flag(F.col("eligibility_status") == "FAIL"))
        .withColumn("timely_filing_breach", filing_breach().cast("int"))
        .withColumn("appeal_timing_days", timing)
        .withColumn("appeal_success", (F.col("outcome") == "WON").cast("int"))
    )
    rated = with_asof_rates(
        rows, APPEAL_RATE_KEYS, "appeal_date", "appeal_success", MIN_OBSERVATIONS, APPEAL_RATE_PRIOR,
        label_time=label_time,
    )
    full = with_lines(with_dimensions(rated, payers, providers), lines)
    keep = ["appeal_id", "claim_id", "payer_id", "appeal_date"]
    return full.select(*keep, *APPEAL_CATEGORICAL, *APPEAL_NUMERIC, "appeal_success")


def appeal_serving_features(
    claims: DataFrame,
    denials: DataFrame,
    appeals: DataFrame,
    lines: DataFrame,
    payers: DataFrame,
    providers: DataFrame,
) -> DataFrame:
    """Appeal features of denied claims before an appeal is filed: rates as of the denial, timing 0."""
    named = denials.withColumnRenamed("denial_reason_code", "denial_reason")
    rows = named.join(claims, "claim_id")
    rows = (
        rows.withColumn("authorization_missing", flag(F.col("authorization_status") == "MISSING"))
        .withColumn("eligibility_fail", flag(F.col("eligibility_status") == "FAIL"))
        .withColumn("timely_filing_breach", filing_breach().cast("int"))
        .withColumn("appeal_timing_days", F.lit(0).cast("bigint"))
    )
    events = resolved_appeals(appeals, denials, claims).withColumn(
        "appeal_success", (F.col("outcome") == "WON").cast("int")
    )
    rated = with_asof_rates(
        rows, APPEAL_RATE_KEYS, "denial_date", "appeal_success", MIN_OBSERVATIONS, APPEAL_RATE_PRIOR,
        events=events, event_ts="appeal_date",
    )
    full = with_lines(with_dimensions(rated, payers, providers), lines)
    return full.select(
        "claim_id", "denial_id", "payer_id", "denial_date", *APPEAL_CATEGORICAL, *APPEAL_NUMERIC
    )


def with_group_baselines(df: DataFrame, keys: dict[str, str], value: str, of: DataFrame | None = None) -> DataFrame:
    """For every (prefix, key): share of rows with that key and mean `value` of that key.

    The per-key tables are aggregates with map-side combine over the rows of `of` (else `df`), written
    and joined back; a window over the key would put a hot key into one task.
    """
    given = df if of is None else of
    rows = given.count()
    for prefix, key in keys.items():
        table = given.groupBy(key).agg(
            (F.count(F.lit(1)) / F.lit(float(max(rows, 1)))).alias(f"{prefix}_frequency"),
            (F.sum(money(F.col(value))).cast("double") / F.count(value)).alias(f"{prefix}_average"),
        )
        df = df.join(small_side(materialize(table, f"{prefix}-baseline")), key, "left")
    return df


def near_duplicates(df: DataFrame, group: list[str], amount: str, key: str) -> DataFrame:
    """Per row: size of its group and number of group rows within 5 % of its amount.

    The band is `abs(other - own) <= 0.05 * max(own, 1)` in exact decimals. Instead of
    pairing rows, each distinct amount asks how many group rows lie at or below its
    upper bound and how many below its lower bound; both are running counts in one
    global order. Groups of one row never enter it.
    """
    value = money(F.col(amount))
    rows = df.select(key, *group, value.alias("_amt"))
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"))
    sized = rows.join(sizes, group)
    distinct = sized.filter(F.col("group_size") > 1).groupBy(*group, "_amt").agg(F.count(F.lit(1)).alias("n"))
    tolerance = (F.lit("0.05").cast("decimal(3,2)") * F.greatest(F.col("_amt"), F.lit(1).cast("decimal(18,4)"))).cast(
        "decimal(20,6)"
    )
    at = F.col("_amt").cast("decimal(22,6)")
    points = F.array(
        F.struct((at - tolerance).cast("decimal(22,6)").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("n")),
        F.struct(at.alias("at"), F.lit(1).alias("kind"), F.col("n").alias("n")),
        F.struct((at + tolerance).cast("decimal(22,6)").alias("at"), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("n")),
    )
    stream = distinct.select(*group, "_amt", F.explode(points).alias("p")).select(*group, "_amt", "p.*")
    counted = ordered_prefix(stream, ["at", "kind", "_amt"], ["n"], group)
    close = counted.groupBy(*group, "_amt").agg(
        (
            F.max(F.when(F.col("kind") == 2, F.col("cum_n"))) - F.max(F.when(F.col("kind") == 0, F.col("cum_n")))
        ).alias("close_count")
    )
    joined = sized.join(close, [*group, "_amt"], "left")
    return joined.select(
        key, "group_size", F.coalesce("close_count", F.lit(1).cast("bigint")).alias("close_count")
    )


def duplicate_score() -> Column:
    close = (F.col("close_count") - 1) / F.lit(3.0)
    return F.when(F.col("group_size") <= 1, 0.0).otherwise(F.least(F.lit(1.0), close))


def anomaly_features(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """13-column anomaly matrix, one row per claim."""
    days = F.coalesce(whole_days(F.col("submission_date"), F.col("service_date")), F.lit(0).cast("bigint"))
    base = with_lines(claims, lines).select(
        "claim_id",
        "payer_id",
        "provider_id",
        "service_date",
        F.col("claim_amount").cast("double").alias("claim_amount"),
        F.greatest("procedure_count", F.lit(1).cast("bigint")).alias("procedure_count"),
        F.greatest("diagnosis_count", F.lit(1).cast("bigint")).alias("diagnosis_count"),
        "modifier_count",
        days.alias("days_to_submission"),
        "procedure_code",
        F.coalesce("line_amount_variance", F.lit(0.0)).alias("claim_line_amount_variance"),
    )
    # Ranks, baselines and duplicate counts all read this table; the line aggregate runs once.
    base = materialize(base, "anomaly-base")
    ranked = average_pct_rank(base, "claim_amount", "claim_amount_percentile")
    keyed = with_group_baselines(
        ranked, {"provider": "provider_id", "payer": "payer_id", "procedure": "procedure_code"}, "claim_amount", base
    )
    close = near_duplicates(base, ["provider_id", "procedure_code", "service_date"], "claim_amount", "claim_id")
    scored = keyed.join(close, "claim_id", "left").withColumn(
        "duplicate_similarity_score", F.coalesce(duplicate_score(), F.lit(0.0))
    )
    renamed = scored.select(
        "*",
        F.col("provider_frequency").alias("provider_claim_frequency"),
        F.col("payer_frequency").alias("payer_claim_frequency"),
        F.col("provider_average").alias("provider_average_claim_amount"),
        F.col("payer_average").alias("payer_average_claim_amount"),
    )
    return renamed.select("claim_id", "payer_id", "provider_id", *ANOMALY_FEATURES)
