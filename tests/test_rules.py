from datetime import datetime

import pytest
from pyspark.sql import functions as F

from claimloom.functions import rules
from claimloom.functions.numbers import band, half_up, whole_days

CLAIM = {
    "claim_number": "C-1",
    "provider_id": 1,
    "payer_id": 1,
    "claim_amount": 100.0,
    "authorization_status": "PRESENT",
    "eligibility_status": "VERIFIED",
    "documentation_completeness": 95.0,
    "submission_date": datetime(2020, 1, 5),
    "timely_filing_deadline": datetime(2020, 2, 1),
}
SCHEMA = (
    "claim_number string, provider_id int, payer_id int, claim_amount double, authorization_status string, "
    "eligibility_status string, documentation_completeness double, submission_date timestamp, timely_filing_deadline timestamp"
)


def evaluate(spark, column, **changes):
    return spark.createDataFrame([{**CLAIM, **changes}], SCHEMA).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "changes,reason",
    [
        ({"authorization_status": "MISSING"}, "MISSING_AUTHORIZATION"),
        ({"eligibility_status": "FAIL"}, "ELIGIBILITY_ISSUE"),
        ({"submission_date": datetime(2020, 3, 1)}, "TIMELY_FILING"),
        ({"documentation_completeness": 40.0}, "MISSING_DOCUMENTATION"),
    ],
)
def test_rule_reasons_are_certain(spark, changes, reason):
    got = evaluate(spark, rules.denial_reason(), **changes)
    assert (got["predicted_reason"], got["confidence"], got["source"]) == (reason, 1.0, "rule")


def test_clean_claim_falls_to_the_heuristic(spark):
    got = evaluate(spark, rules.denial_reason())
    assert got["source"] == "heuristic"
    assert got["predicted_reason"] == "CODING_MISMATCH" and got["confidence"] == pytest.approx(0.3333)
    assert [a["reason"] for a in got["alternatives"]] == ["MEDICAL_NECESSITY", "OTHER", "DUPLICATE_CLAIM"]


def test_model_goes_between_rule_and_heuristic(spark):
    kind = "struct<predicted_reason:string,confidence:double,source:string,alternatives:array<struct<reason:string,confidence:double>>,model_version:string>"
    model = F.struct(
        F.lit("OTHER"), F.lit(0.5), F.lit("ml"), F.array(), F.lit("m-1")
    ).cast(kind)
    assert evaluate(spark, rules.denial_reason(model))["source"] == "ml"
    assert evaluate(spark, rules.denial_reason(model), eligibility_status="FAIL")["source"] == "rule"
    assert evaluate(spark, rules.denial_reason(F.lit(None).cast(kind)))["source"] == "heuristic"


def test_validator(spark):
    clean = evaluate(spark, rules.validation(F.lit(True)))
    assert clean["readiness_score"] == 100 and clean["errors"] == [] and clean["passed_checks"] == 6
    missing = evaluate(spark, rules.validation(F.lit(True)), authorization_status="MISSING")
    assert missing["readiness_score"] == 90 and len(missing["warnings"]) == 1
    bad = evaluate(spark, rules.validation(F.lit(None).cast("boolean")), eligibility_status="FAIL", claim_amount=0.0)
    assert bad["readiness_score"] == 25 and len(bad["errors"]) == 3
    no_deadline = evaluate(spark, rules.validation(F.lit(True)), timely_filing_deadline=None)
    assert no_deadline["checks"][4]["message"] == "No filing deadline risk detected."


def test_bands(spark):
    severities = [evaluate(spark, rules.severity(F.lit(x))) for x in (95.0, 60.0, 35.0, 5.0)]
    assert severities == ["HIGH", "MEDIUM", "LOW", "NORMAL"]
    drift = [evaluate(spark, rules.drift_status(F.lit(x))) for x in (0.02, 0.15, 0.30)]
    assert drift == ["NORMAL", "WARNING", "CRITICAL"]
    assert evaluate(spark, band(F.lit(200.0), rules.PRIORITY_TIERS, "LOW", strict=True)) == "HIGH"


def test_probability_orders_reasons_and_is_clamped(spark):
    auth = evaluate(spark, rules.appeal_probability(F.lit("MISSING_AUTHORIZATION")))
    duplicate = evaluate(spark, rules.appeal_probability(F.lit("DUPLICATE_CLAIM")))
    assert auth > duplicate
    assert evaluate(spark, rules.appeal_probability(F.lit("new"))) == pytest.approx(0.2925)
    assert evaluate(spark, rules.appeal_probability(F.lit(None).cast("string"))) == pytest.approx(0.2925)


def test_recovery_numbers(spark):
    assert evaluate(spark, rules.expected_recovery(F.lit(1000.0), F.lit(0.5))) == 200.0
    assert evaluate(spark, rules.urgency(F.lit(0))) == 1.0
    assert evaluate(spark, rules.urgency(F.lit(400))) == pytest.approx(1.9833)
    assert evaluate(spark, rules.priority_score(F.lit(300.0), F.lit(1.5), F.lit(0.5), 0.0)) == 225.0


@pytest.mark.parametrize(
    "changes,reason,expected,p,action",
    [
        ({"authorization_status": "MISSING"}, "OTHER", 1.0, 0.9, "OBTAIN_AUTHORIZATION"),
        ({"eligibility_status": "FAIL"}, "OTHER", 1.0, 0.9, "VERIFY_ELIGIBILITY"),
        ({"documentation_completeness": 69.0}, "OTHER", 1.0, 0.9, "REQUEST_DOCUMENTATION"),
        ({}, "CODING_MISMATCH", 1.0, 0.9, "CORRECT_CODING"),
        ({}, "OTHER", 0.0, 0.9, "STOP_RECOVERY"),
        ({}, "OTHER", 1.0, 0.5, "APPEAL"),
        ({}, "OTHER", 1.0, 0.4, "CONTACT_PAYER"),
    ],
)
def test_next_action(spark, changes, reason, expected, p, action):
    column = rules.next_action(F.lit(reason), F.lit(expected), F.lit(p))
    assert evaluate(spark, column, **changes) == action


def test_evidence_gate(spark):
    full = evaluate(spark, rules.evidence(F.lit(True), F.lit(True), F.lit(5)))
    assert full["readiness_percent"] == 100 and full["generation_allowed"] and full["missing_evidence"] == []
    without = evaluate(spark, rules.evidence(F.lit(False), F.lit(True), F.lit(5)))
    assert not without["generation_allowed"] and without["missing_evidence"] == ["denial_reason"]


def test_days_floor_downward(spark):
    column = whole_days(F.lit(datetime(2020, 1, 1, 1)), F.lit(datetime(2020, 1, 2)))
    assert evaluate(spark, column) == -1


@pytest.mark.parametrize("x,digits,want", [(1.005, 2, 1.01), (-1.005, 2, -1.01), (0.12344, 4, 0.1234), (-0.00001, 2, 0.0), (0.124999995, 2, 0.12), (0.125, 2, 0.13), (1e9 + 0.005, 2, 1000000000.01)])
def test_half_up(spark, x, digits, want):
    assert evaluate(spark, half_up(F.lit(x), digits)) == want
