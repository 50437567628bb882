"""Claim rules as pure column expressions.

Each function takes the columns of a joined claim row by their model names and
returns one column (or a struct). Nothing here triggers a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.numbers import band, constant_map, flag, half_up

# Denial reason codes.
DENIAL_REASONS = [
    "MISSING_AUTHORIZATION",
    "ELIGIBILITY_ISSUE",
    "CODING_MISMATCH",
    "DUPLICATE_CLAIM",
    "MISSING_DOCUMENTATION",
    "TIMELY_FILING",
    "MEDICAL_NECESSITY",
    "OTHER",
]

# Appealability prior by denial reason.
APPEAL_PRIOR = {
    "MISSING_AUTHORIZATION": 0.75,
    "ELIGIBILITY_ISSUE": 0.55,
    "CODING_MISMATCH": 0.65,
    "DUPLICATE_CLAIM": 0.10,
    "MISSING_DOCUMENTATION": 0.70,
    "TIMELY_FILING": 0.15,
    "MEDICAL_NECESSITY": 0.45,
    "OTHER": 0.30,
}
UNKNOWN_PRIOR = 0.30
PAYMENT_PROBABILITY = 0.90
PROCESSING_COST = 250.0
APPEAL_WINDOW_DAYS = 60
QUEUE_EFFORT_MINUTES = 30.0

# Reasons whose denials could have been prevented before submission.
PREVENTABLE_REASONS = ["MISSING_AUTHORIZATION", "ELIGIBILITY_ISSUE", "MISSING_DOCUMENTATION", "CODING_MISMATCH"]

# Staff minutes per action.
ACTION_MINUTES = {
    "OBTAIN_AUTHORIZATION": 20,
    "VERIFY_ELIGIBILITY": 10,
    "REQUEST_DOCUMENTATION": 15,
    "CORRECT_CODING": 25,
    "APPEAL": 45,
    "CONTACT_PAYER": 20,
    "ESCALATE": 30,
    "STOP_RECOVERY": 5,
    "RESUBMIT": 15,
}
DEFAULT_ACTION_MINUTES = 20

# Explanation shown with each action.
ACTION_REASONS = {
    "OBTAIN_AUTHORIZATION": "Claim is missing prior authorization; obtaining it is the highest-leverage fix.",
    "VERIFY_ELIGIBILITY": "Eligibility could not be verified; confirm coverage before further action.",
    "REQUEST_DOCUMENTATION": "Documentation completeness is below threshold; request supporting records.",
    "CORRECT_CODING": "Coding pattern suggests a procedure/diagnosis mismatch; review and correct coding.",
    "STOP_RECOVERY": "Expected recovery value is negative or negligible; further work is not cost-justified.",
    "APPEAL": "Appeal success probability and expected recovery both support pursuing an appeal.",
    "CONTACT_PAYER": "Ambiguous denial; contact payer for clarification before committing further effort.",
}

# Band ladders, highest bound first.
DENIAL_RISK_BANDS = [(0.75, "CRITICAL"), (0.50, "HIGH"), (0.25, "MEDIUM")]
APPEAL_BANDS = [(0.65, "HIGH_RECOVERY_POTENTIAL"), (0.35, "MODERATE_RECOVERY_POTENTIAL")]
APPEAL_PRIORITY_BANDS = [(5000.0, "HIGH"), (0.0, "MEDIUM")]
PRIORITY_TIERS = [(200.0, "CRITICAL"), (80.0, "HIGH"), (20.0, "MEDIUM")]
SEVERITY_BANDS = [(80.0, "HIGH"), (55.0, "MEDIUM"), (30.0, "LOW")]
DRIFT_BANDS = [(0.25, "CRITICAL"), (0.10, "WARNING")]

# Validator messages.
CHECK_MESSAGES = {
    "eligibility": "Eligibility not verified for this claim.",
    "authorization": "Authorization is missing; verify whether this service requires prior auth.",
    "coding": "One or more claim lines is missing a procedure or diagnosis code.",
    "timely_filing": "Submission date is after the timely filing deadline.",
    "required_fields": "One or more required claim fields is missing.",
}
NO_DEADLINE_MESSAGE = "No filing deadline risk detected."

# Evidence items in report order.
EVIDENCE_ITEMS = [
    "claim_record",
    "denial_reason",
    "procedure_information",
    "authorization_status",
    "supporting_documentation",
    "payer_policy_retrieved",
]
EVIDENCE_THRESHOLD = 60


def risk_band(p: Column) -> Column:
    return band(p, DENIAL_RISK_BANDS, "LOW")


def appeal_band(p: Column) -> Column:
    return band(p, APPEAL_BANDS, "LOW_RECOVERY_POTENTIAL")


def appeal_priority(expected: Column) -> Column:
    return band(expected, APPEAL_PRIORITY_BANDS, "LOW", strict=True)


def priority_tier(score: Column) -> Column:
    return band(score, PRIORITY_TIERS, "LOW", strict=True)


def severity(score: Column) -> Column:
    return band(score, SEVERITY_BANDS, "NORMAL")


def drift_status(psi: Column, warning: float = 0.10, critical: float = 0.25) -> Column:
    return band(psi, [(critical, "CRITICAL"), (warning, "WARNING")], "NORMAL")


def filing_breach() -> Column:
    return F.coalesce(F.col("submission_date") > F.col("timely_filing_deadline"), F.lit(False))


def plain_number(value: Column) -> Column:
    """Two-decimal value as text, without the second decimal when it is zero (`12.5`, `12.0`, `12.25`)."""
    text = half_up(value, 2).cast("decimal(14,2)").cast("string")
    return F.regexp_replace(text, r"(\.\d)0$", "$1")


def validation(lines_coded: Column) -> Column:
    """Six pre-submission checks: struct(checks, errors, warnings, readiness_score, passed_checks, total_checks).

    `lines_coded` is true when the claim has at least one line and every line carries
    a procedure and a diagnosis code; null counts as false.
    """
    doc = F.col("documentation_completeness").cast("double")
    doc_message = F.concat(F.lit("Documentation completeness is "), plain_number(doc), F.lit("% (recommended >= 80%)."))
    has_deadline = F.col("timely_filing_deadline").isNotNull() & F.col("submission_date").isNotNull()
    filled = (
        (F.coalesce(F.col("claim_number"), F.lit("")) != "")
        & F.col("provider_id").isNotNull()
        & F.col("payer_id").isNotNull()
        & (F.coalesce(F.col("claim_amount"), F.lit(0)) != 0)
    )
    messages = {name: F.lit(text) for name, text in CHECK_MESSAGES.items()} | {"documentation": doc_message}
    tests = [
        ("eligibility", F.col("eligibility_status") == "VERIFIED", "ERROR"),
        ("authorization", F.col("authorization_status") == "PRESENT", "WARNING"),
        ("documentation", doc >= 80, "WARNING"),
        ("coding", lines_coded, "ERROR"),
        ("timely_filing", ~filing_breach(), "ERROR"),
        ("required_fields", filled, "ERROR"),
    ]
    checks = []
    for name, passed, level in tests:
        ok = F.coalesce(passed, F.lit(False))
        good = F.lit(f"{name.replace('_', ' ').title()} OK.")
        if name == "timely_filing":
            good = F.when(has_deadline, good).otherwise(NO_DEADLINE_MESSAGE)
        checks.append(
            F.struct(
                F.lit(name).alias("name"),
                F.when(ok, "PASS").otherwise(level).alias("status"),
                F.when(ok, good).otherwise(messages[name]).alias("message"),
            )
        )
    all_checks = F.array(*checks)

    def having(status: str) -> Column:
        return F.transform(F.filter(all_checks, lambda c: c["status"] == status), lambda c: c["message"])

    errors, warnings = having("ERROR"), having("WARNING")
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - 25 * F.size(errors) - 10 * F.size(warnings)))
    return F.struct(
        all_checks.alias("checks"),
        errors.alias("errors"),
        warnings.alias("warnings"),
        F.transform(F.filter(all_checks, lambda c: c["status"] != "PASS"), lambda c: c["message"]).alias(
            "recommended_corrections"
        ),
        score.alias("readiness_score"),
        F.size(F.filter(all_checks, lambda c: c["status"] == "PASS")).alias("passed_checks"),
        F.lit(len(tests)).alias("total_checks"),
    )


def rule_reason() -> Column:
    """Denial reason that is a known fact, or null."""
    return (
        F.when(F.col("authorization_status") == "MISSING", "MISSING_AUTHORIZATION")
        .when(F.col("eligibility_status") == "FAIL", "ELIGIBILITY_ISSUE")
        .when(filing_breach(), "TIMELY_FILING")
        .when(F.col("documentation_completeness") < 60, "MISSING_DOCUMENTATION")
    )


def residual_reasons() -> Column:
    """Heuristic candidates as array<struct(reason, confidence)>, most likely first."""
    coding = F.lit(0.15) + F.when(F.col("documentation_completeness") < 85, 0.3).otherwise(0.0)
    scores = [
        ("CODING_MISMATCH", coding),
        ("MEDICAL_NECESSITY", F.lit(0.15)),
        ("DUPLICATE_CLAIM", F.lit(0.05)),
        ("OTHER", F.lit(0.10)),
    ]
    total = coding + 0.15 + 0.05 + 0.10
    ranked = F.array_sort(
        F.array(
            *[
                F.struct((-score).alias("neg"), F.lit(i).alias("ord"), F.lit(reason).alias("reason"))
                for i, (reason, score) in enumerate(scores)
            ]
        )
    )
    return F.transform(
        ranked, lambda c: F.struct(c["reason"].alias("reason"), half_up(-c["neg"] / total, 4).alias("confidence"))
    )


def denial_reason(model: Column | None = None) -> Column:
    """Rule, then model (struct of the same shape, may be null), then heuristic."""
    alternatives_type = "array<struct<reason:string,confidence:double>>"
    rule = rule_reason()
    ranked = residual_reasons()

    def shaped(reason: Column, confidence: Column, source: str, alternatives: Column, version: Column) -> Column:
        return F.struct(
            reason.alias("predicted_reason"),
            confidence.cast("double").alias("confidence"),
            F.lit(source).alias("source"),
            alternatives.cast(alternatives_type).alias("alternatives"),
            version.cast("string").alias("model_version"),
        )

    by_rule = F.when(rule.isNotNull(), shaped(rule, F.lit(1.0), "rule", F.array(), F.lit(None)))
    first = F.element_at(ranked, 1)
    heuristic = shaped(first["reason"], first["confidence"], "heuristic", F.slice(ranked, 2, 3), F.lit(None))
    return F.coalesce(*([by_rule] + ([model] if model is not None else []) + [heuristic]))


def appeal_probability_heuristic(reason: Column) -> Column:
    """Unrounded documented baseline; a null reason counts as OTHER."""
    prior = F.coalesce(
        F.element_at(constant_map(APPEAL_PRIOR), F.coalesce(reason, F.lit("OTHER"))), F.lit(UNKNOWN_PRIOR)
    )
    doc = F.col("documentation_completeness").cast("double") / 100.0
    return F.greatest(F.lit(0.02), F.least(F.lit(0.97), prior * (0.5 + 0.5 * doc)))


def appeal_probability(reason: Column, model_probability: Column | None = None) -> Column:
    """Model probability where there is one, otherwise the baseline; 4 decimals."""
    baseline = appeal_probability_heuristic(reason)
    return half_up(baseline if model_probability is None else F.coalesce(model_probability, baseline), 4)


def expected_recovery(
    amount: Column,
    probability: Column,
    payment_probability: float = PAYMENT_PROBABILITY,
    processing_cost: float = PROCESSING_COST,
) -> Column:
    return half_up(amount.cast("double") * probability * payment_probability - processing_cost, 2)


def urgency(days_since_denial: Column, window_days: int = APPEAL_WINDOW_DAYS) -> Column:
    remaining = F.greatest(F.lit(window_days) - days_since_denial, F.lit(1))
    return half_up(1.0 + (window_days - remaining) / float(window_days), 4)


def priority_score(
    expected: Column, urgency_factor: Column, recoverability: Column, effort_minutes: Column | float
) -> Column:
    effort = F.greatest(F.lit(effort_minutes) if not isinstance(effort_minutes, Column) else effort_minutes, F.lit(1.0))
    return half_up(expected * urgency_factor * recoverability / effort, 4)


def next_action(reason: Column, expected: Column, probability: Column) -> Column:
    return (
        F.when(F.col("authorization_status") == "MISSING", "OBTAIN_AUTHORIZATION")
        .when(F.col("eligibility_status") == "FAIL", "VERIFY_ELIGIBILITY")
        .when(F.col("documentation_completeness") < 70, "REQUEST_DOCUMENTATION")
        .when(reason == "CODING_MISMATCH", "CORRECT_CODING")
        .when(expected <= 0, "STOP_RECOVERY")
        .when(probability >= 0.5, "APPEAL")
        .otherwise("CONTACT_PAYER")
    )


def action_minutes(action: Column) -> Column:
    minutes = F.element_at(constant_map(ACTION_MINUTES), action)
    return F.coalesce(minutes, F.lit(DEFAULT_ACTION_MINUTES))


def action_reason(action: Column) -> Column:
    return F.element_at(constant_map(ACTION_REASONS), action)


def evidence(has_denial: Column, has_lines: Column, retrieved_chunks: Column) -> Column:
    """Evidence gate: struct(readiness_percent, missing_evidence, generation_allowed)."""
    present = [
        F.lit(True),
        has_denial,
        has_lines,
        F.col("authorization_status").isNotNull(),
        F.col("documentation_completeness") >= 70,
        retrieved_chunks > 0,
    ]
    present = [F.coalesce(p, F.lit(False)) for p in present]
    held = F.filter(
        F.array(*[F.when(p, F.lit(name)) for name, p in zip(EVIDENCE_ITEMS, present)]), lambda x: x.isNotNull()
    )
    required = F.array(*[F.lit(name) for name in EVIDENCE_ITEMS])
    missing = F.array_except(required, held)
    readiness = half_up(100.0 * F.size(held) / len(EVIDENCE_ITEMS), 0).cast("int")
    return F.struct(
        readiness.alias("readiness_percent"),
        missing.alias("missing_evidence"),
        ((readiness >= EVIDENCE_THRESHOLD) & present[1]).alias("generation_allowed"),
    )


def claim_flags() -> dict[str, Column]:
    return {
        "auth_missing": flag(F.col("authorization_status") == "MISSING"),
        "eligibility_fail": flag(F.col("eligibility_status") == "FAIL"),
        "timely_filing_breach": filing_breach().cast("int"),
    }
