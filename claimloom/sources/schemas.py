"""Input and output table schemas."""

from __future__ import annotations

POLICY_DOCUMENT = "title string, source_type string, version string, text string"

CLAIM_LINE_INPUT = "struct<procedure_code:string,diagnosis_code:string,modifiers:string,line_amount:decimal(12,2),units:int>"

CLAIM_INPUT = (
    "claim_number string, provider_id string, payer_id string, patient_ref string, claim_amount decimal(12,2), "
    "claim_type string, place_of_service string, eligibility_status string, authorization_status string, "
    "documentation_completeness decimal(5,2), service_date timestamp, submission_date timestamp, "
    f"lines array<{CLAIM_LINE_INPUT}>"
)

# Defaults of an incoming claim or policy document.
CLAIM_DEFAULTS = {
    "claim_type": "professional",
    "place_of_service": "11",
    "eligibility_status": "VERIFIED",
    "authorization_status": "PRESENT",
    "documentation_completeness": 100,
}
DOCUMENT_DEFAULTS = {"source_type": "payer_policy", "version": "1.0"}

DRIFT_METRIC = (
    "metric_type string, metric_name string, feature_name string, baseline_value double, current_value double, "
    "drift_score double, status string, is_drift_detected boolean"
)

MODEL_VERSION = (
    "version_id string, model_name string, model_type string, version_tag string, artifact_path string, "
    "metrics map<string,double>, feature_names array<string>, params map<string,string>, dataset_version string, "
    "calibration_status string, trained_at timestamp"
)

PROMOTION = "model_type string, version_id string, promoted_at timestamp"

JOB_RUN = (
    "model_type string, status string, error string, champion string, started_at timestamp, finished_at timestamp"
)
