"""SQL counterparts of the queries in stored.py."""

from __future__ import annotations

from claimloom.plans import oracle_claims, oracle_documents, oracle_streams
from claimloom.plans.sql import rnd, with_ctes

_RANKED = oracle_claims.ORACLE["ranking_metrics"]
_NAMES = [f"{m}_at_{k}" for m in ("precision", "ndcg", "recovery_captured") for k in (5, 10, 20)]

_ITEMS = f"(SELECT r.claim_id, anomaly_score, is_anomaly, severity, payer_id, provider_id FROM ({oracle_streams.ORACLE['anomaly_report_proxy']}) r JOIN ({with_ctes(['claims'], 'SELECT claim_id, payer_id, provider_id FROM claims')}) c USING (claim_id))"

ORACLE: dict[str, str] = {
    "claim_lookup": with_ctes(["claims"], "SELECT claim_id, claim_number, status FROM claims WHERE claim_id IN (SELECT event_id * 7 FROM events)"),
    "claim_lookup_missing": with_ctes(
        ["claims"], "SELECT DISTINCT event_id * 7 AS claim_id, 'not found' AS error FROM events WHERE event_id * 7 NOT IN (SELECT claim_id FROM claims)"
    ),
    "claims_by_month": with_ctes(
        ["claims"],
        "SELECT strftime(submission_date, '%Y-%m') AS month, count(*) AS claims, max(claim_amount) AS largest "
        "FROM claims WHERE submission_date IS NOT NULL GROUP BY 1",
    ),
    "ranking_metric_log": "SELECT 'appeal_success-baseline' AS model_version_id, 'ranking_' || metric_name AS metric_name, metric_value FROM ("
    f"UNPIVOT (SELECT {', '.join(f'cast({n} AS DOUBLE) AS {n}' for n in _NAMES)} FROM ({_RANKED}) WHERE strategy = 'model_expected_value') "
    f"ON {', '.join(_NAMES)} INTO NAME metric_name VALUE metric_value)",
    "prediction_log": with_ctes(
        ["claims"],
        "SELECT claim_id, p AS probability, CASE WHEN p >= 0.75 THEN 'CRITICAL' WHEN p >= 0.5 THEN 'HIGH' WHEN p >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_category, "
        "NULL::VARCHAR AS error, 'appeal_success-baseline' AS model_version, 0 AS \"commit\" FROM (SELECT claim_id, documentation_completeness / 100.0::DOUBLE AS p FROM claims "
        "WHERE claim_id IN (SELECT event_id * 7 FROM events)) "
        "UNION ALL SELECT DISTINCT event_id * 7, NULL::DOUBLE, NULL::VARCHAR, 'not found', 'appeal_success-baseline', 0 FROM events WHERE event_id * 7 NOT IN (SELECT claim_id FROM claims)",
    ),
    "registry_log": f"SELECT model_type, champion_version, champion_name, pr_auc FROM ({oracle_documents.ORACLE['model_registry_champion']})",
    "anomaly_items_proxy": f"SELECT * FROM {_ITEMS} WHERE severity = 'MEDIUM' AND payer_id = 7",
    "anomaly_summary_proxy": "SELECT count(*) AS total_claims_scored, count(*) FILTER (is_anomaly) AS anomaly_count, "
    f"{rnd('100.0::DOUBLE * (count(*) FILTER (is_anomaly)) / count(*)', 2)} AS anomaly_percentage, "
    + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in ("HIGH", "MEDIUM", "LOW", "NORMAL"))
    + f" FROM {_ITEMS}",
    "stored_summary": with_ctes(
        ["all_scored"],
        "SELECT 'portfolio' AS name, 'computed' AS state, count(*) AS total_claims, count(denial_reason_code) AS claims_at_risk FROM all_scored "
        "UNION ALL SELECT 'never', 'not computed', NULL, NULL",
    ),
}
