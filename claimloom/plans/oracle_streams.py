"""Batch SQL twins of the streaming queries, and of the given-decision anomaly report."""

from __future__ import annotations

from claimloom.plans.oracle_claims import ORACLE as CLAIMS
from claimloom.plans.oracle_claims import edges_ctes, term
from claimloom.plans.oracle_documents import ORACLE as DOCUMENTS
from claimloom.plans.sql import register, rnd, with_ctes

ORACLE: dict[str, str] = {
    "stream_claim_dedupe": "SELECT DISTINCT 'CLM-' || l_orderkey AS claim_number FROM lineitem",
    "stream_validation": (
        f"SELECT v.claim_id, v.readiness_score, r.predicted_reason, r.confidence FROM ({CLAIMS['claim_validation']}) v "
        f"JOIN ({CLAIMS['denial_reason_rules']}) r USING (claim_id)"
    ),
    "stream_audit_chain": DOCUMENTS["audit_chain_build"],
}

# Accepted events: walk each user's events, carrying the accepted times.
register(
    "visits",
    "SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events",
    [],
)
_recent = "list_filter(w.kept, lambda x: v.us - x < 86400000000)"
register(
    "visit_walk",
    "SELECT event_id, user_id, seq, true AS accepted, [us] AS kept FROM visits WHERE seq = 1 UNION ALL "
    f"SELECT v.event_id, v.user_id, v.seq, len({_recent}) < 2, CASE WHEN len({_recent}) < 2 THEN list_append({_recent}, v.us) ELSE {_recent} END "
    "FROM visit_walk w JOIN visits v ON v.user_id = w.user_id AND v.seq = w.seq + 1",
    ["visits"],
)
ORACLE["velocity_flags"] = with_ctes(
    ["visit_walk"], "SELECT event_id, user_id AS client_id, accepted FROM visit_walk", True
)

register("ev_long", "SELECT 'value' AS feature_name, value, ts, true AS is_ref FROM events", [])
edges_ctes("ev_long", "feature_name", "ev")
register(
    "ev_ref",
    "SELECT b.bin, b.lo, b.hi, b.m, count(v.value) AS rc FROM ev_bins b LEFT JOIN ev_long v ON v.value >= b.lo AND "
    "(v.value < b.hi OR (b.bin = b.m - 1 AND v.value = b.hi)) WHERE b.hi IS NOT NULL GROUP BY ALL",
    ["ev_bins", "ev_long"],
)
ORACLE["stream_daily_drift"] = with_ctes(
    ["ev_ref", "ev_long"],
    "SELECT strftime(day, '%Y-%m-%d') AS day, cast(rows AS BIGINT) AS rows, psi, CASE WHEN psi >= 0.25 THEN 'CRITICAL' WHEN psi >= 0.10 THEN 'WARNING' "
    f"ELSE 'NORMAL' END AS status FROM (SELECT day, max(rows) AS rows, {rnd('sum(' + term('rc / total::DOUBLE', 'n / rows::DOUBLE') + ')', 6)} AS psi FROM ("
    "SELECT *, sum(rc) OVER (PARTITION BY day) AS total, sum(n) OVER (PARTITION BY day) AS rows FROM (SELECT d.day, r.bin, r.rc, count(v.value) AS n "
    "FROM (SELECT DISTINCT date_trunc('day', ts) AS day FROM events) d CROSS JOIN ev_ref r LEFT JOIN ev_long v ON date_trunc('day', v.ts) = d.day "
    "AND v.value >= r.lo AND (v.value < r.hi OR (r.bin = r.m - 1 AND v.value = r.hi)) "
    "GROUP BY ALL)) GROUP BY day)",
)

# Anomaly report from a decision SQL can compute.
_names = ["claim_amount", "days_to_submission", "modifier_count", "procedure_count"]
_z = ", ".join(f"abs(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_samp({c}) OVER (), 0), 1)) AS z{i}" for i, c in enumerate(_names))
_items = ", ".join(f"{{'z': -z{i}, 'o': {i}, 'f': '{c}'}}" for i, c in enumerate(_names))
ORACLE["anomaly_report_proxy"] = (
    "SELECT claim_id, anomaly_score, decision < 0 OR anomaly_score >= 55 AS is_anomaly, CASE WHEN anomaly_score >= 80 THEN 'HIGH' "
    "WHEN anomaly_score >= 55 THEN 'MEDIUM' WHEN anomaly_score >= 30 THEN 'LOW' ELSE 'NORMAL' END AS severity, "
    f"array_to_string(list_transform(list_filter(list_sort([{_items}]), lambda x: -x.z > 1.0), lambda x: x.f), '|') AS contributing FROM ("
    f"SELECT *, {rnd('100.0::DOUBLE / (1.0 + exp(6.0::DOUBLE * decision))', 1)} AS anomaly_score FROM (SELECT *, {_z}, "
    f"{rnd('0.4::DOUBLE - pct * 0.5::DOUBLE - dup * 0.3::DOUBLE', 6)} AS decision FROM ("
    "SELECT a.*, p.pct, CASE WHEN n.group_size <= 1 THEN 0.0 ELSE least(1.0, (n.close_count - 1) / 3::DOUBLE) END AS dup FROM a "
    "JOIN p USING (claim_id) JOIN near n USING (claim_id))))"
)
register(
    "a",
    "SELECT claim_id, claim_amount, greatest(procedure_count, 1) AS procedure_count, modifier_count, "
    "coalesce(cast(floor((epoch_us(submission_date) - epoch_us(service_date)) / 86400000000.0) AS BIGINT), 0) AS days_to_submission FROM wide",
    ["wide"],
)
register(
    "p",
    "SELECT claim_id, (rank() OVER (ORDER BY claim_amount) + (count(*) OVER (PARTITION BY claim_amount) - 1) / 2::DOUBLE) / count(*) OVER () AS pct FROM wide",
    ["wide"],
)
ORACLE["anomaly_report_proxy"] = with_ctes(["a", "p", "near"], ORACLE["anomaly_report_proxy"])
