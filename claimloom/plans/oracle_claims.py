"""SQL counterparts of the queries in `claims.py`."""

from __future__ import annotations

from claimloom.functions.rules import CHECK_MESSAGES, NO_DEADLINE_MESSAGE, PREVENTABLE_REASONS
from claimloom.operators.features import (
    ANOMALY_FEATURES,
    APPEAL_CATEGORICAL,
    DENIAL_CATEGORICAL,
    DENIAL_NUMERIC,
)
from claimloom.operators.recovery import STRATEGIES
from claimloom.plans.sql import (
    ACTION_TEXT,
    BREACH,
    RULE,
    asof,
    days,
    money,
    rate,
    register,
    rnd,
    scored,
    with_ctes,
)
from claimloom.sources.fixtures import AS_OF

ORACLE: dict[str, str] = {}


def add(name: str, ctes: list[str], body: str) -> None:
    ORACLE[name] = with_ctes(ctes, body)


# Recovery -----------------------------------------------------------------

_days = days(f"TIMESTAMP '{AS_OF}'", "denial_date")
_urgency = rnd("1.0 + (60 - greatest(60 - days, 1)) / 60.0", 4)
register(
    "queue",
    "SELECT claim_id, claim_number, claim_amount, denial_reason_code AS denial_reason, payer_id, "
    "days AS days_since_denial, p AS appeal_success_probability, er AS expected_recovery, ps AS priority_score, "
    "CASE WHEN ps > 200 THEN 'CRITICAL' WHEN ps > 80 THEN 'HIGH' WHEN ps > 20 THEN 'MEDIUM' ELSE 'LOW' END "
    "AS priority_tier, action AS recommended_action FROM ("
    f"SELECT *, {rnd('er * urg * p / cast(30 AS DOUBLE)', 4)} AS ps FROM (SELECT *, {_urgency} AS urg FROM "
    f"(SELECT *, {_days} AS days FROM open_denials)))",
    ["open_denials"],
)
add("recovery_queue_topk", ["queue"], "SELECT * FROM queue ORDER BY priority_score DESC, claim_id LIMIT 50")
add("recovery_queue_all", ["queue"], "SELECT * FROM queue")
add(
    "recovery_queue_payer_tier",
    ["queue"],
    "SELECT * FROM queue WHERE payer_id = 7 AND priority_tier = 'HIGH' "
    "ORDER BY expected_recovery DESC, claim_id LIMIT 20 OFFSET 2",
)

_msg = {k: "'" + v + "'" for k, v in CHECK_MESSAGES.items()}
_doc2 = f"regexp_replace(cast(cast({rnd('documentation_completeness', 2)} AS DECIMAL(14,2)) AS VARCHAR), '(\\.\\d)0$', '\\1')"
_checks = [
    ("eligibility", "eligibility_status = 'VERIFIED'", "ERROR", _msg["eligibility"]),
    ("authorization", "authorization_status = 'PRESENT'", "WARNING", _msg["authorization"]),
    (
        "documentation",
        "documentation_completeness >= 80",
        "WARNING",
        f"'Documentation completeness is ' || {_doc2} || '% (recommended >= 80%).'",
    ),
    ("coding", "coalesce(lines_coded, false)", "ERROR", _msg["coding"]),
    ("timely_filing", f"NOT {BREACH}", "ERROR", _msg["timely_filing"]),
    (
        "required_fields",
        "claim_number <> '' AND provider_id IS NOT NULL AND payer_id IS NOT NULL AND claim_amount <> 0",
        "ERROR",
        _msg["required_fields"],
    ),
]
_err = " + ".join(f"(CASE WHEN {c} THEN 0 ELSE 1 END)" for _, c, l, _m in _checks if l == "ERROR")
_warn = " + ".join(f"(CASE WHEN {c} THEN 0 ELSE 1 END)" for _, c, l, _m in _checks if l == "WARNING")
_status = ", ".join(f"'{n}=' || CASE WHEN {c} THEN 'PASS' ELSE '{l}' END" for n, c, l, _m in _checks)
_fix = ", ".join(f"CASE WHEN {c} THEN NULL ELSE {m} END" for _n, c, _l, m in _checks)
add(
    "claim_validation",
    ["claims", "line_features"],
    "SELECT claim_id, cast(greatest(0, 100 - 25 * e - 10 * w) AS BIGINT) AS readiness_score, "
    "cast(6 - e - w AS BIGINT) AS passed_checks, cast(6 AS BIGINT) AS total_checks, cast(e AS BIGINT) AS n_errors, "
    "cast(w AS BIGINT) AS n_warnings, checks, corrections FROM ("
    f"SELECT claim_id, {_err} AS e, {_warn} AS w, concat_ws('|', {_status}) AS checks, "
    f"concat_ws('|', {_fix}) AS corrections FROM claims LEFT JOIN line_features USING (claim_id))",
)

_coding = "(CASE WHEN documentation_completeness < 85 THEN 0.15::DOUBLE + 0.3::DOUBLE ELSE 0.15::DOUBLE END)"
_total = f"({_coding} + 0.15::DOUBLE + 0.05::DOUBLE + 0.10::DOUBLE)"


def _share(x: str) -> str:
    return rnd(f"{x} / {_total}", 4)


_alt = " || '|' || ".join(
    f"'{r}:' || format('{{:.4f}}', {_share(s)})"
    for r, s in (("MEDICAL_NECESSITY", "0.15::DOUBLE"), ("OTHER", "0.10::DOUBLE"), ("DUPLICATE_CLAIM", "0.05::DOUBLE"))
)
add(
    "denial_reason_rules",
    ["claims"],
    "SELECT claim_id, coalesce(rule, 'CODING_MISMATCH') AS predicted_reason, "
    "CASE WHEN rule IS NULL THEN conf ELSE 1.0 END AS confidence, "
    "CASE WHEN rule IS NULL THEN 'heuristic' ELSE 'rule' END AS source, "
    "CASE WHEN rule IS NULL THEN alt ELSE '' END AS alternatives FROM ("
    f"SELECT claim_id, {RULE} AS rule, {_share(_coding)} AS conf, {_alt} AS alt FROM claims)",
)
_denied_scored = scored("denied")
add(
    "appeal_probability_heuristic",
    ["denied"],
    "SELECT claim_id, p AS appeal_success_probability, CASE WHEN p >= 0.65 THEN 'HIGH_RECOVERY_POTENTIAL' "
    f"WHEN p >= 0.35 THEN 'MODERATE_RECOVERY_POTENTIAL' ELSE 'LOW_RECOVERY_POTENTIAL' END AS appeal_band FROM ({_denied_scored})",
)
add(
    "expected_recovery",
    ["denied"],
    "SELECT claim_id, er AS expected_recovery, CASE WHEN er > 5000 THEN 'HIGH' WHEN er > 0 THEN 'MEDIUM' ELSE 'LOW' END "
    f"AS appeal_priority FROM ({_denied_scored})",
)
add(
    "next_best_action",
    ["denied"],
    "SELECT claim_id, action AS recommended_action, cast(minutes AS BIGINT) AS estimated_effort_minutes, "
    f"{ACTION_TEXT} AS action_reason FROM ({_denied_scored})",
)

# Analytics ----------------------------------------------------------------

_prev = "denial_reason_code IN (" + ", ".join(f"'{r}'" for r in PREVENTABLE_REASONS) + ")"


def _total_of(expr: str, condition: str = "true") -> str:
    return rnd(f"coalesce(sum({money(expr)}) FILTER ({condition}), 0)", 2)


_d = "denial_reason_code IS NOT NULL"
_rate = f"cast(count(*) FILTER ({_d}) AS DOUBLE) / count(*)"
add(
    "dashboard_totals",
    ["all_scored"],
    f"SELECT count(*) AS total_claims, {_total_of('claim_amount')} AS total_billed, count(*) FILTER ({_d}) AS claims_at_risk, "
    f"{_total_of('claim_amount', _d)} AS revenue_at_risk, {_total_of('claim_amount', _prev)} AS preventable_revenue, "
    f"{_total_of('claim_amount', f'{_d} AND NOT {_prev}')} AS recoverable_revenue, {_total_of('er', _d)} AS expected_recovery, "
    f"count(*) FILTER ({_d} AND claim_amount > 5000) AS high_priority_claims, {rnd(_rate, 4)} AS denial_rate, "
    f"{rnd(f'1 - {_rate}', 4)} AS clean_claim_rate, count(*) FILTER ({_d} AND claim_id % 10 <> 0) AS pending_human_review FROM all_scored",
)
_den, _exp = _total_of("claim_amount", _d), _total_of("er", f"{_d} AND er > 0")
add(
    "revenue_funnel",
    ["all_scored"],
    f"SELECT *, {rnd('denied - expected', 2)} AS write_off FROM (SELECT {_total_of('claim_amount')} AS billed, {_den} AS denied, "
    f"{_total_of('claim_amount', _prev)} AS preventable, {_total_of('claim_amount', f'{_d} AND NOT {_prev}')} AS non_preventable, "
    f"{_total_of('claim_amount', f'{_d} AND er > 0')} AS recoverable, {_exp} AS expected FROM all_scored)",
)
for _name, _key, _dim in (("payer_intelligence", "payer_id", "payers"), ("provider_intelligence", "provider_id", "providers")):
    _vol_rate = f"cast(count(*) FILTER ({_d}) AS DOUBLE) / count(*)"
    add(
        _name,
        ["base", _dim],
        f"SELECT v.{_key}, coalesce(name, 'Unknown') AS name, claim_volume, denial_rate, "
        f"coalesce(top, '') AS top_denial_reasons, revenue_at_risk FROM (SELECT {_key}, count(*) AS claim_volume, "
        f"{rnd(_vol_rate, 4)} AS denial_rate, {_total_of('claim_amount', _d)} AS revenue_at_risk FROM base GROUP BY {_key}) v "
        f"LEFT JOIN (SELECT {_key}, string_agg(denial_reason_code || ':' || n, '|' ORDER BY r) AS top FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY {_key} ORDER BY n DESC, denial_reason_code) AS r FROM ("
        f"SELECT {_key}, denial_reason_code, count(*) AS n FROM base WHERE {_d} GROUP BY ALL)) WHERE r <= 3 GROUP BY {_key}) t "
        f"USING ({_key}) LEFT JOIN {_dim} USING ({_key})",
    )
add(
    "denial_root_causes",
    ["denials"],
    "SELECT denial_reason_code AS reason, count(*) AS count, "
    f"{rnd('cast(100 AS DOUBLE) * count(*) / sum(count(*)) OVER ()', 1)} AS percent FROM denials GROUP BY 1",
)
add(
    "denial_rollup",
    ["denied"],
    "SELECT payer_id, provider_id, denial_reason_code, "
    "cast(grouping(payer_id, provider_id, denial_reason_code) AS BIGINT) AS level, count(*) AS denials, "
    f"{_total_of('claim_amount')} AS amount FROM denied GROUP BY ROLLUP (payer_id, provider_id, denial_reason_code)",
)
_won = f"CASE WHEN outcome = 'WON' THEN {money('claim_amount')} ELSE 0 END"
_rec = f"cast(sum({_won}) AS DOUBLE)"
add(
    "business_kpis",
    ["appealed"],
    f"SELECT count(*) AS resolved_appeals, {rnd('cast(count(*) FILTER (outcome = $$WON$$) AS DOUBLE) / count(*)', 4)} AS appeal_success_rate, "
    f"{rnd(_rec, 2)} AS recovered, {rnd(_rec + f' / cast(sum({money('claim_amount')}) AS DOUBLE)', 4)} AS recovery_yield, "
    f"{rnd(_rec + ' / 2000.0', 2)} AS recovery_per_staff_hour, "
    f"{rnd('avg((epoch_us(decision_date) - epoch_us(denial_date)) / 86400000000.0)', 4)} AS average_resolution_days FROM appealed",
)

# Features -----------------------------------------------------------------

add(
    "claim_line_features",
    ["line_features"],
    "SELECT claim_id, line_count, procedure_count, diagnosis_count, modifier_count, first_procedure, lines_coded, "
    f"{rnd('line_amount_variance', 4)} AS line_amount_variance FROM line_features",
)
_dkeys = {"payer_historical_denial_rate": "payer_id", "provider_historical_denial_rate": "provider_id"}
add(
    "asof_denial_rate",
    ["submitted"],
    f"SELECT claim_id, {', '.join(f'{rate(k, '0.15', 8)} AS {o}' for o, k in _dkeys.items())} FROM ("
    f"SELECT claim_id, {', '.join(asof(k, 'submission_date', 'is_denied') for k in _dkeys.values())} FROM submitted)",
)


def _known(key: str) -> str:
    """Correlated form: claims submitted before, of these the ones whose denial was known before."""
    return (
        f"SELECT c.claim_id, count(e.claim_id) AS n_{key}, count(e.claim_id) FILTER (e.denial_date < c.submission_date "
        f"AND e.denial_reason_code IS NOT NULL) AS x_{key} FROM submitted c LEFT JOIN submitted e ON e.{key} = c.{key} "
        "AND e.submission_date < c.submission_date GROUP BY c.claim_id"
    )


add(
    "asof_denial_rate_known",
    ["submitted"],
    f"SELECT claim_id, {', '.join(f'{rate(k, '0.15', 8)} AS {o}' for o, k in _dkeys.items())} FROM ({_known('payer_id')}) "
    f"JOIN ({_known('provider_id')}) USING (claim_id)",
)
_akeys = {"historical_payer_appeal_rate": "payer_id", "historical_reason_appeal_rate": "denial_reason_code"}
_appeal_asof = ", ".join(asof(k, "appeal_date", "appeal_success") for k in _akeys.values())
_appeal_rows = "(SELECT *, CASE WHEN outcome = 'WON' THEN 1 ELSE 0 END AS appeal_success FROM appealed)"
add(
    "asof_appeal_rate",
    ["appealed"],
    f"SELECT claim_id AS appeal_id, {', '.join(f'{rate(k, '0.40', 8)} AS {o}' for o, k in _akeys.items())} FROM ("
    f"SELECT claim_id, {_appeal_asof} FROM {_appeal_rows})",
)


def _lookup(probes: str, events: str, key: str, cutoff: str, ts: str, label: str) -> str:
    return (
        f"SELECT c.claim_id, count(e.claim_id) AS n_{key}, coalesce(sum(e.{label}), 0) AS x_{key} FROM {probes} c "
        f"LEFT JOIN {events} e ON e.{key} = c.{key} AND e.{ts} < {cutoff} GROUP BY c.claim_id"
    )


add(
    "asof_lookup",
    ["base", "submitted"],
    f"SELECT claim_id, {rate('payer_id', '0.15', 8)} AS payer_rate FROM "
    f"({_lookup('base', 'submitted', 'payer_id', 'c.service_date', 'submission_date', 'is_denied')})",
)


def _mixed(names: list[str], floats: list[str], digits: int = 6) -> str:
    return ", ".join(f"{rnd(n, digits)} AS {n}" if n in floats else n for n in names)


_dfloats = ["claim_amount", "documentation_completeness", *_dkeys]
add(
    "denial_features",
    ["denial_matrix"],
    f"SELECT claim_id, payer_id, provider_id, {_mixed(DENIAL_CATEGORICAL + DENIAL_NUMERIC, _dfloats)}, is_denied, "
    "denial_reason_code FROM denial_matrix",
)
_cut = "coalesce(c.submission_date, c.service_date)"
add(
    "denial_features_serving",
    ["base", "submitted"],
    f"SELECT claim_id, coalesce({days('submission_date', 'service_date')}, 0) AS days_to_submission, "
    f"{', '.join(f'{rate(k, '0.15', 8)} AS {o}' for o, k in _dkeys.items())} FROM base "
    f"JOIN ({_lookup('base', 'submitted', 'payer_id', _cut, 'submission_date', 'is_denied')}) USING (claim_id) "
    f"JOIN ({_lookup('base', 'submitted', 'provider_id', _cut, 'submission_date', 'is_denied')}) USING (claim_id)",
)
_anum = (
    "auth_missing AS authorization_missing, eligibility_fail, "
    f"CASE WHEN {BREACH} THEN 1 ELSE 0 END AS timely_filing_breach, "
    f"greatest({days('appeal_date', 'denial_date')}, 0) AS appeal_timing_days, "
)
_acat = ", ".join(c for c in APPEAL_CATEGORICAL if c != "denial_reason")
add(
    "appeal_features",
    ["wide"],
    "SELECT claim_id AS appeal_id, claim_id, payer_id, denial_reason_code AS denial_reason, "
    f"{_acat}, {rnd('claim_amount', 6)} AS claim_amount, {rnd('documentation_completeness', 6)} AS documentation_completeness, "
    f"{_anum} {', '.join(f'{rate(k, '0.40', 6)} AS {o}' for o, k in _akeys.items())}, appeal_success FROM ("
    f"SELECT *, {_appeal_asof} FROM (SELECT *, CASE WHEN outcome = 'WON' THEN 1 ELSE 0 END AS appeal_success FROM wide "
    "WHERE outcome IS NOT NULL))",
)
_aev = "(SELECT *, CASE WHEN outcome = 'WON' THEN 1 ELSE 0 END AS appeal_success FROM appealed)"
add(
    "appeal_features_serving",
    ["denied", "appealed"],
    "SELECT claim_id, denial_reason_code AS denial_reason, cast(0 AS BIGINT) AS appeal_timing_days, "
    f"{', '.join(f'{rate(k, '0.40', 8)} AS {o}' for o, k in _akeys.items())} FROM denied "
    f"JOIN ({_lookup('denied', _aev, 'payer_id', 'c.denial_date', 'appeal_date', 'appeal_success')}) USING (claim_id) "
    f"JOIN ({_lookup('denied', _aev, 'denial_reason_code', 'c.denial_date', 'appeal_date', 'appeal_success')}) USING (claim_id)",
)
register(
    "near",
    "SELECT a.claim_id, count(*) AS group_size, count(*) FILTER (abs(b.amt - a.amt) <= "
    "cast(0.05 AS DECIMAL(3,2)) * greatest(a.amt, cast(1 AS DECIMAL(18,4)))) AS close_count "
    f"FROM (SELECT *, {money('claim_amount')} AS amt FROM wide) a JOIN (SELECT *, {money('claim_amount')} AS amt FROM wide) b "
    "ON a.provider_id = b.provider_id AND a.procedure_code = b.procedure_code AND a.service_date = b.service_date "
    "GROUP BY a.claim_id",
    ["wide"],
)
add("near_duplicate_claims", ["near"], "SELECT * FROM near WHERE group_size > 1")
_pct = "(rank() OVER (ORDER BY claim_amount) + (count(*) OVER (PARTITION BY claim_amount) - 1) / cast(2 AS DOUBLE)) / count(*) OVER ()"
add("amount_percentile", ["base"], f"SELECT claim_id, {rnd(_pct, 8)} AS percentile FROM base")


def _base_of(key: str, prefix: str) -> str:
    return (
        f"cast(count(*) OVER (PARTITION BY {key}) AS DOUBLE) / count(*) OVER () AS {prefix}_f, "
        f"cast(sum({money('claim_amount')}) OVER (PARTITION BY {key}) AS DOUBLE) / count(*) OVER (PARTITION BY {key}) AS {prefix}_a"
    )


_af = {
    "claim_amount": rnd("claim_amount", 4),
    "claim_amount_percentile": rnd("pct", 4),
    "procedure_count": "greatest(procedure_count, 1)",
    "diagnosis_count": "greatest(diagnosis_count, 1)",
    "modifier_count": "modifier_count",
    "days_to_submission": f"coalesce({days('submission_date', 'service_date')}, 0)",
    "provider_claim_frequency": rnd("pv_f", 4),
    "payer_claim_frequency": rnd("py_f", 4),
    "procedure_frequency": rnd("pr_f", 4),
    "provider_average_claim_amount": rnd("pv_a", 4),
    "payer_average_claim_amount": rnd("py_a", 4),
    "claim_line_amount_variance": rnd("line_variance", 4),
    "duplicate_similarity_score": rnd(
        "CASE WHEN group_size <= 1 THEN 0.0 ELSE least(1.0, (close_count - 1) / cast(3 AS DOUBLE)) END", 4
    ),
}
add(
    "anomaly_features",
    ["wide", "near"],
    f"SELECT claim_id, payer_id, provider_id, {', '.join(f'{_af[c]} AS {c}' for c in ANOMALY_FEATURES)} FROM ("
    f"SELECT *, {_pct} AS pct, {_base_of('provider_id', 'pv')}, {_base_of('payer_id', 'py')}, {_base_of('procedure_code', 'pr')} "
    "FROM wide) JOIN near USING (claim_id)",
)

# Splits and drift ---------------------------------------------------------

register(
    "positions",
    "SELECT claim_id, row_number() OVER (ORDER BY submission_date, claim_id) AS pos, count(*) OVER () AS n FROM submitted",
    ["submitted"],
)
_cutpos = "cast(floor(n * cast(0.8 AS DOUBLE)) AS BIGINT)"
add("chrono_split_sizes", ["positions"], f"SELECT claim_id, CASE WHEN pos <= {_cutpos} THEN 'train' ELSE 'test' END AS part FROM positions")
register(
    "parts",
    f"SELECT claim_id, CASE WHEN pos <= {_cutpos} THEN 'reference' WHEN pos > greatest({_cutpos}, n - 500) THEN 'current' END AS part FROM positions",
    ["positions"],
)
add("reference_current_rows", ["parts"], "SELECT * FROM parts WHERE part IS NOT NULL")
register(
    "drift_rows",
    "SELECT *, part = 'reference' AS is_ref FROM denial_matrix JOIN parts USING (claim_id) WHERE part IS NOT NULL",
    ["denial_matrix", "parts"],
)
_union_num = " UNION ALL ".join(f"SELECT '{f}' AS feature_name, is_ref, cast({f} AS DOUBLE) AS value FROM drift_rows" for f in DENIAL_NUMERIC)
register("drift_long", _union_num, ["drift_rows"])
_union_cat = " UNION ALL ".join(f"SELECT '{f}' AS feature_name, is_ref, {f} AS category FROM drift_rows" for f in DENIAL_CATEGORICAL)
register("drift_cat", _union_cat, ["drift_rows"])


def edges_ctes(source: str, group: str, prefix: str) -> None:
    """Reference decile edges: order the values, interpolate between the two neighbours."""
    register(
        f"{prefix}_sorted",
        f"SELECT {group}, value, row_number() OVER (PARTITION BY {group} ORDER BY value) - 1 AS i, "
        f"count(*) OVER (PARTITION BY {group}) AS n FROM {source} WHERE is_ref AND value IS NOT NULL",
        [source],
    )
    register(
        f"{prefix}_edges",
        f"SELECT DISTINCT l.{group}, l.value + (h.value - l.value) * (q.h - floor(q.h)) AS edge FROM ("
        f"SELECT DISTINCT {group}, n, (n - 1) * (step / 10::DOUBLE) AS h FROM {prefix}_sorted, range(11) t(step)) q "
        f"JOIN {prefix}_sorted l ON l.{group} = q.{group} AND l.i = floor(q.h) "
        f"JOIN {prefix}_sorted h ON h.{group} = q.{group} AND h.i = least(floor(q.h) + 1, q.n - 1)",
        [f"{prefix}_sorted"],
    )
    register(
        f"{prefix}_bins",
        f"SELECT {group}, edge AS lo, lead(edge) OVER w AS hi, row_number() OVER w AS bin, "
        f"count(*) OVER (PARTITION BY {group}) AS m FROM {prefix}_edges WINDOW w AS (PARTITION BY {group} ORDER BY edge)",
        [f"{prefix}_edges"],
    )


edges_ctes("drift_long", "feature_name", "dl")


def term(r: str, c: str) -> str:
    return f"(({c} + 1e-6) - ({r} + 1e-6)) * ln(({c} + 1e-6) / ({r} + 1e-6))"


register(
    "dl_psi",
    "SELECT f.feature_name, CASE WHEN f.nr < 10 OR f.nc < 10 OR coalesce(x.m, 0) < 3 THEN 0.0 ELSE psi END AS psi FROM "
    "(SELECT feature_name, count(value) FILTER (is_ref) AS nr, count(value) FILTER (NOT is_ref) AS nc FROM drift_long GROUP BY 1) f "
    f"LEFT JOIN (SELECT feature_name, max(m) AS m, {rnd('sum(' + term('rc / greatest(rs, 1)::DOUBLE', 'cc / greatest(cs, 1)::DOUBLE') + ')', 6)} AS psi FROM ("
    "SELECT *, sum(rc) OVER (PARTITION BY feature_name) AS rs, sum(cc) OVER (PARTITION BY feature_name) AS cs FROM ("
    "SELECT b.feature_name, b.bin, b.m, count(v.value) FILTER (v.is_ref) AS rc, count(v.value) FILTER (NOT v.is_ref) AS cc FROM dl_bins b "
    "LEFT JOIN drift_long v ON v.feature_name = b.feature_name AND v.value >= b.lo AND (v.value < b.hi OR (b.bin = b.m - 1 AND v.value = b.hi)) "
    "WHERE b.hi IS NOT NULL GROUP BY ALL)) GROUP BY 1) x USING (feature_name)",
    ["dl_bins", "drift_long"],
)
add("psi_numeric", ["dl_psi"], "SELECT * FROM dl_psi")
register(
    "dc_counts",
    "SELECT *, sum(nr) OVER (PARTITION BY feature_name) AS tr, sum(nc) OVER (PARTITION BY feature_name) AS tc FROM ("
    "SELECT feature_name, category, count(*) FILTER (is_ref) AS nr, count(*) FILTER (NOT is_ref) AS nc FROM drift_cat GROUP BY ALL)",
    ["drift_cat"],
)
register(
    "dc_psi",
    f"SELECT feature_name, {rnd('sum(' + term('nr / greatest(tr, 1)::DOUBLE', 'nc / greatest(tc, 1)::DOUBLE') + ')', 6)} AS psi "
    "FROM dc_counts GROUP BY 1",
    ["dc_counts"],
)
add("psi_categorical", ["dc_psi"], "SELECT * FROM dc_psi")
add(
    "category_frequencies",
    ["dc_counts"],
    f"SELECT feature_name, category, {rnd('nr / tr::DOUBLE', 4)} AS reference_share, {rnd('nc / tc::DOUBLE', 4)} AS current_share FROM dc_counts",
)
register(
    "dl_ks",
    f"SELECT feature_name, {rnd('max(abs(cr / nr::DOUBLE - cc / nc::DOUBLE))', 6)} AS ks_statistic FROM ("
    "SELECT feature_name, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER (PARTITION BY feature_name) AS nr, "
    "sum(c) OVER (PARTITION BY feature_name) AS nc FROM (SELECT feature_name, value, count(*) FILTER (is_ref) AS r, "
    "count(*) FILTER (NOT is_ref) AS c FROM drift_long WHERE value IS NOT NULL GROUP BY ALL) "
    "WINDOW w AS (PARTITION BY feature_name ORDER BY value)) GROUP BY 1",
    ["drift_long"],
)
add("ks_statistic", ["dl_ks"], "SELECT * FROM dl_ks")
_null = [("submission", "submission_date"), ("deadline", "timely_filing_deadline")]


def _null_rate(col: str, cond: str) -> str:
    return f"1.0 - count({col}) FILTER ({cond}) / (count(*) FILTER ({cond}))::DOUBLE"


_miss = " UNION ALL ".join(
    f"SELECT '{n}' AS feature_name, {_null_rate(c, 'ref')} AS b, {_null_rate(c, 'NOT ref')} AS u FROM r" for n, c in _null
)
add(
    "missing_drift",
    ["base"],
    "SELECT feature_name, " + f"{rnd('b', 6)} AS baseline_value, {rnd('u', 6)} AS current_value, {rnd('abs(u - b)', 6)} AS drift_score, "
    "CASE WHEN abs(u - b) >= 0.10 THEN 'WARNING' ELSE 'NORMAL' END AS status, abs(u - b) >= 0.10 AS is_drift_detected FROM ("
    f"WITH r AS (SELECT *, row_number() OVER (ORDER BY service_date, claim_id) <= floor(count(*) OVER () * cast(0.8 AS DOUBLE)) AS ref FROM base) {_miss})",
)
_dec = "cast(value AS DECIMAL(28,8))"


def _mean(cond: str) -> str:
    return rnd(f"cast(sum({_dec}) FILTER ({cond}) AS DOUBLE) / count(value) FILTER ({cond})", 6)


_stat = "CASE WHEN psi >= 0.25 THEN 'CRITICAL' WHEN psi >= 0.10 THEN 'WARNING' ELSE 'NORMAL' END"
_nr, _nc = "1.0 - count(value) FILTER (is_ref) / (count(*) FILTER (is_ref))::DOUBLE", "1.0 - count(value) FILTER (NOT is_ref) / (count(*) FILTER (NOT is_ref))::DOUBLE"
add(
    "drift_report",
    ["dl_psi", "dl_ks", "dc_psi"],
    f"SELECT 'data_drift' AS metric_type, 'PSI' AS metric_name, feature_name, b AS baseline_value, u AS current_value, psi AS drift_score, {_stat} AS status, "
    "psi >= 0.10 AS is_drift_detected, ks_statistic FROM dl_psi JOIN dl_ks USING (feature_name) JOIN "
    f"(SELECT feature_name, {_mean('is_ref')} AS b, {_mean('NOT is_ref')} AS u FROM drift_long GROUP BY 1) USING (feature_name) "
    "UNION ALL SELECT 'missing_value', 'missing_rate', feature_name, " + f"{rnd('b', 6)}, {rnd('u', 6)}, {rnd('abs(u - b)', 6)}, "
    "CASE WHEN abs(u - b) >= 0.10 THEN 'WARNING' ELSE 'NORMAL' END, abs(u - b) >= 0.10, NULL "
    f"FROM (SELECT feature_name, {_nr} AS b, {_nc} AS u FROM drift_long GROUP BY 1) "
    f"UNION ALL SELECT 'data_drift', 'PSI', feature_name, 0.0, 0.0, psi, {_stat}, psi >= 0.10, NULL FROM dc_psi",
)

# Segments, ranking, capacity, metrics ---------------------------------------

register("seg_long", "SELECT 0 AS g, payer_id, score AS value, true AS is_ref FROM appeal_scores", ["appeal_scores"])
edges_ctes("seg_long", "g", "sg")
_in_bin = "v.value >= b.lo AND (v.value < b.hi OR (b.bin = b.m - 1 AND v.value = b.hi))"
add(
    "segment_scores",
    ["seg_long", "sg_bins"],
    "SELECT payer_id, rows, mean_score, median_score, psi FROM ("
    f"SELECT payer_id, count(*) AS rows, {rnd('cast(sum(cast(value AS DECIMAL(20,8))) AS DOUBLE) / count(*)', 6)} AS mean_score, "
    f"{rnd('quantile_cont(value, 0.5)', 6)} AS median_score FROM seg_long GROUP BY 1) JOIN ("
    f"SELECT payer_id, {rnd('sum(' + term('an / (SELECT count(*) FROM seg_long)::DOUBLE', 'sn / sr::DOUBLE') + ')', 6)} AS psi FROM ("
    "SELECT s.payer_id, b.bin, s.sr, count(v.value) AS an, count(v.value) FILTER (v.payer_id = s.payer_id) AS sn FROM sg_bins b "
    "CROSS JOIN (SELECT payer_id, count(*) AS sr FROM seg_long GROUP BY 1) s "
    f"LEFT JOIN seg_long v ON {_in_bin} WHERE b.hi IS NOT NULL GROUP BY ALL) GROUP BY 1) USING (payer_id)",
)
register(
    "held_out",
    "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY appeal_date, appeal_id) AS tpos, count(*) OVER () AS tn FROM appeal_scores) "
    "WHERE tpos > floor(tn * cast(0.8 AS DOUBLE))",
    ["appeal_scores"],
)
_gain = "CASE WHEN y = 1 THEN claim_amount ELSE 0.0 END"
register(
    "ranked",
    " UNION ALL ".join(
        f"SELECT '{n}' AS strategy, {i} AS ord, appeal_id, y, {_gain} AS gain, "
        f"row_number() OVER (ORDER BY {s} DESC, appeal_id) AS pos, row_number() OVER (ORDER BY {_gain} DESC, appeal_id) AS ipos FROM held_out"
        for i, (n, s) in enumerate(
            [("model_expected_value", "score * claim_amount"), ("claim_amount_only", "claim_amount"), ("appeal_probability_only", "score")]
        )
    ),
    ["held_out"],
)
_ks = (5, 10, 20)
_prec = ", ".join(f"{rnd(f'(count(*) FILTER (pos <= {k} AND y > 0))::DOUBLE / count(*) FILTER (pos <= {k})', 4)} AS precision_at_{k}" for k in _ks)
_ndcg = ", ".join(
    f"{rnd(f'coalesce(sum(gain / log2(pos + 1)) FILTER (pos <= {k}) / nullif(sum(gain / log2(ipos + 1)) FILTER (ipos <= {k}), 0), 0.0)', 4)} AS ndcg_at_{k}"
    for k in _ks
)
_capt = ", ".join(
    f"{rnd(f'cast(sum({money('gain')}) FILTER (pos <= {k}) AS DOUBLE) / nullif(cast(sum({money('gain')}) AS DOUBLE), 0)', 4)} AS recovery_captured_at_{k}"
    for k in _ks
)
add(
    "ranking_metrics",
    ["ranked"],
    f"SELECT * EXCLUDE (ord), row_number() OVER (ORDER BY recovery_captured_at_5 DESC, ord) = 1 AS is_best FROM ("
    f"SELECT strategy, ord, {_prec}, {_ndcg}, {_capt}, count(*) AS n_items FROM ranked GROUP BY ALL)",
)
_cols = {"claim_amount": "claim_amount", "appeal_success_probability": "p", "expected_recovery": "er"}
_plan = " UNION ALL ".join(
    f"SELECT '{n}' AS strategy, {i} AS ord, claim_id, er, minutes, row_number() OVER w AS pos, sum(minutes) OVER w AS used FROM open_denials "
    f"WINDOW w AS (ORDER BY {_cols[c]} DESC, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    for i, (n, c) in enumerate(STRATEGIES.items())
)
register("plan", _plan, ["open_denials"])
_pos = f"CASE WHEN er > 0 THEN {money('er')} ELSE 0 END"
for _name, _hours in (("capacity_plan", 40), ("capacity_plan_large", 400)):
    _fit = f"used <= {_hours * 60}"
    add(
        _name,
        ["plan"],
        "SELECT * EXCLUDE (ord), row_number() OVER (ORDER BY expected_recovery_captured DESC, ord) = 1 AS is_best FROM ("
        f"SELECT strategy, ord, count(*) FILTER ({_fit}) AS claims_processed, count(*) AS claims_available, "
        f"{rnd(f'coalesce(sum(minutes) FILTER ({_fit}), 0) / 60.0', 2)} AS staff_hours_used, {_hours}.0::DOUBLE AS staff_hours_budget, "
        f"{rnd(f'coalesce(sum({_pos}) FILTER ({_fit}), 0)', 2)} AS expected_recovery_captured, {rnd(f'sum({_pos})', 2)} AS total_expected_recovery, "
        f"{rnd(f'cast(coalesce(sum({_pos}) FILTER ({_fit}), 0) AS DOUBLE) / cast(sum({_pos}) AS DOUBLE)', 4)} AS recovery_yield, "
        f"coalesce(string_agg(claim_id::VARCHAR, ',' ORDER BY pos) FILTER ({_fit} AND pos <= 20), '') AS worked_claim_ids FROM plan GROUP BY ALL)",
    )
_tp = "(SELECT score AS s, sum(y) AS tp, count(*) AS n FROM appeal_scores GROUP BY 1)"
_run = (
    "SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER () AS positives, sum(n) OVER () AS all_rows "
    f"FROM {_tp} WINDOW w AS (ORDER BY s DESC)"
)
add(
    "binary_metrics",
    ["appeal_scores"],
    f"SELECT {rnd('ap / pos', 6)} AS pr_auc, {rnd('auc / (pos * (total - pos))', 6)} AS roc_auc, "
    f"{rnd('hit / called', 6)} AS precision, {rnd('hit / pos', 6)} AS recall, "
    f"{rnd('2 * (hit / called) * (hit / pos) / (hit / called + hit / pos)', 6)} AS f1, "
    f"{rnd('brier / total', 6)} AS brier_score, cast(total AS BIGINT) AS n_test, {rnd('pos / total', 6)} AS positive_rate FROM ("
    "SELECT sum(tp * ctp / cn::DOUBLE) AS ap, sum(tp * ((all_rows - positives) - (cn - ctp) + (n - tp) / 2.0::DOUBLE)) AS auc, "
    "any_value(positives)::DOUBLE AS pos, any_value(all_rows)::DOUBLE AS total, "
    "coalesce(sum(tp) FILTER (s >= 0.5), 0)::DOUBLE AS hit, coalesce(sum(n) FILTER (s >= 0.5), 0)::DOUBLE AS called, "
    f"sum(tp * (1.0::DOUBLE - s) * (1.0::DOUBLE - s) + (n - tp) * s * s) AS brier FROM ({_run}))",
)
add(
    "calibration_curve",
    ["appeal_scores"],
    "SELECT cast(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n, "
    f"{rnd('cast(sum(cast(score AS DECIMAL(12,8))) AS DOUBLE) / count(*)', 6)} AS mean_score, "
    f"{rnd('sum(y)::DOUBLE / count(*)', 6)} AS observed_rate FROM appeal_scores GROUP BY 1",
)
register("compared", f"SELECT denial_reason_code AS recorded, coalesce({RULE}, 'CODING_MISMATCH') AS predicted FROM denied", ["denied"])
register(
    "per_class",
    "SELECT label, CASE WHEN called > 0 THEN hits / called ELSE 0.0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS r, "
    "CASE WHEN hits > 0 THEN 2 * (hits / called) * (hits / support) / (hits / called + hits / support) ELSE 0.0 END AS f, hits, support FROM ("
    "SELECT label, (SELECT count(*) FROM compared WHERE recorded = label AND predicted = label)::DOUBLE AS hits, "
    "(SELECT count(*) FROM compared WHERE predicted = label)::DOUBLE AS called, (SELECT count(*) FROM compared WHERE recorded = label)::DOUBLE AS support "
    "FROM (SELECT recorded AS label FROM compared UNION SELECT predicted FROM compared))",
    ["compared"],
)
add(
    "confusion_metrics",
    ["per_class"],
    f"SELECT label, {rnd('p', 6)} AS precision, {rnd('r', 6)} AS recall, {rnd('f', 6)} AS f1, cast(support AS BIGINT) AS support FROM per_class",
)
add(
    "confusion_summary",
    ["per_class"],
    f"SELECT {rnd('avg(f)', 6)} AS macro_f1, {rnd('sum(f * support) / sum(support)', 6)} AS weighted_f1, "
    f"{rnd('sum(hits) / sum(support)', 6)} AS accuracy, cast(sum(support) AS BIGINT) AS n_test FROM per_class",
)
_scen = (
    "(VALUES ('complete_documentation', 'documentation_completeness', NULL::VARCHAR, NULL::VARCHAR, 100.0::DOUBLE, NULL::DOUBLE), "
    "('obtain_authorization', 'authorization_status', 'PRESENT', NULL, NULL, NULL), "
    "('half_amount_fixed_eligibility', 'eligibility_status,claim_amount', NULL, 'VERIFIED', NULL, 1000.0)) "
    "s(scenario, applied_overrides, a, e, d, m)"
)
_after = scored(
    "(SELECT claim_id, denial_reason_code, scenario, applied_overrides, op, oer, coalesce(a, authorization_status) AS authorization_status, "
    "coalesce(e, eligibility_status) AS eligibility_status, coalesce(d, documentation_completeness) AS documentation_completeness, "
    f"coalesce(m, claim_amount) AS claim_amount FROM (SELECT *, p AS op, er AS oer FROM ({_denied_scored})) CROSS JOIN {_scen})"
)
add(
    "what_if_heuristic",
    ["denied"],
    f"SELECT claim_id, scenario, applied_overrides, op AS original_probability, p AS simulated_probability, {rnd('p - op', 4)} AS probability_difference, "
    f"oer AS original_expected, er AS simulated_expected, action AS simulated_action FROM ({_after})",
)
