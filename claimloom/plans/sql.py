"""Shared pieces of the SQL counterparts (DuckDB dialect)."""

from __future__ import annotations

from claimloom.functions.numbers import TIE_GUARD, TIE_STEPS
from claimloom.functions.rules import (
    ACTION_MINUTES,
    ACTION_REASONS,
    APPEAL_PRIOR,
)
from claimloom.sources.fixtures import (
    LINE_COLUMNS,
    LINE_ORDER,
    PAYER_TYPES,
    SPECIALTIES,
    claims_base_sql,
    duck_add_days,
    pick,
)


def rnd(expr: str, digits: int) -> str:
    """Half away from zero with a small tie guard."""
    x, k = f"cast({expr} AS DOUBLE)", f"{10**digits}.0"
    return f"(sign({x}) * floor(abs({x}) * {k} + 0.5 + {TIE_GUARD!r} + abs({x}) * {k} * {TIE_STEPS!r}) / {k} + 0.0)"


def money(expr: str) -> str:
    return f"cast({expr} AS DECIMAL(18,4))"


def days(later: str, earlier: str) -> str:
    return f"cast(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS BIGINT)"


def case_map(expr: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items())
    return f"CASE {expr} {arms} ELSE {default} END"


PRIOR = case_map("coalesce(denial_reason_code, 'OTHER')", APPEAL_PRIOR, "0.30")
PROBABILITY = (
    f"greatest(0.02, least(0.97, cast({PRIOR} AS DOUBLE) * (cast(0.5 AS DOUBLE) + cast(0.5 AS DOUBLE) * "
    "(documentation_completeness / cast(100 AS DOUBLE)))))"
)
BREACH = "coalesce(submission_date > timely_filing_deadline, false)"
ACTION = (
    "CASE WHEN authorization_status = 'MISSING' THEN 'OBTAIN_AUTHORIZATION' "
    "WHEN eligibility_status = 'FAIL' THEN 'VERIFY_ELIGIBILITY' "
    "WHEN documentation_completeness < 70 THEN 'REQUEST_DOCUMENTATION' "
    "WHEN denial_reason_code = 'CODING_MISMATCH' THEN 'CORRECT_CODING' "
    "WHEN er <= 0 THEN 'STOP_RECOVERY' WHEN p >= 0.5 THEN 'APPEAL' ELSE 'CONTACT_PAYER' END"
)
MINUTES = case_map("action", ACTION_MINUTES, "20")
ACTION_TEXT = case_map("action", ACTION_REASONS)
RULE = (
    "CASE WHEN authorization_status = 'MISSING' THEN 'MISSING_AUTHORIZATION' "
    "WHEN eligibility_status = 'FAIL' THEN 'ELIGIBILITY_ISSUE' "
    f"WHEN {BREACH} THEN 'TIMELY_FILING' WHEN documentation_completeness < 60 THEN 'MISSING_DOCUMENTATION' END"
)


def scored(source: str) -> str:
    """Adds p, er, action and minutes to claim rows with a denial_reason_code."""
    er = rnd("claim_amount * p * cast(0.9 AS DOUBLE) - cast(250 AS DOUBLE)", 2)
    return (
        f"SELECT *, {MINUTES} AS minutes FROM (SELECT *, {ACTION} AS action FROM (SELECT *, {er} AS er FROM "
        f"(SELECT *, {rnd(PROBABILITY, 4)} AS p FROM {source})))"
    )


_lines = ", ".join(f"{e} AS {n}" for n, e in LINE_COLUMNS)
_amt = money("line_amount")
_n, _s1, _s2 = "cast(count(*) AS DOUBLE)", f"cast(sum({_amt}) AS DOUBLE)", f"cast(sum({_amt} * {_amt}) AS DOUBLE)"

CTES = {
    "base": claims_base_sql(duck_add_days),
    "claims": "SELECT * EXCLUDE (denial_reason_code, denial_date, outcome, appeal_date, decision_date, order_status) FROM base",
    "denials": "SELECT claim_id AS denial_id, claim_id, denial_reason_code, denial_date FROM base WHERE denial_reason_code IS NOT NULL",
    "denied": "SELECT * FROM base WHERE denial_reason_code IS NOT NULL",
    "open_denials": scored("(SELECT * FROM denied WHERE status = 'DENIED')"),
    "all_scored": scored("base"),
    "appealed": "SELECT * FROM base WHERE outcome IS NOT NULL",
    "payers": f"SELECT cast(n_nationkey AS BIGINT) AS payer_id, n_name AS name, {pick('n_nationkey % 3', PAYER_TYPES)} AS payer_type FROM nation",
    "providers": f"SELECT s_suppkey AS provider_id, s_name AS name, {pick('s_nationkey % 5', SPECIALTIES)} AS specialty FROM supplier",
    "lines": f"SELECT {_lines}, row({', '.join(LINE_ORDER)}) AS line_key FROM lineitem",
    "line_features": (
        "SELECT claim_id, count(*) AS line_count, count(DISTINCT procedure_code) AS procedure_count, "
        "count(DISTINCT diagnosis_code) AS diagnosis_count, count(*) FILTER (modifiers <> '') AS modifier_count, "
        "arg_min(procedure_code, line_key) AS first_procedure, "
        "bool_and(procedure_code <> '' AND diagnosis_code <> '') AS lines_coded, "
        f"CASE WHEN count(*) > 1 THEN greatest(({_n} * {_s2} - {_s1} * {_s1}) / ({_n} * {_n}), 0.0) ELSE 0.0 END "
        "AS line_amount_variance FROM lines GROUP BY claim_id"
    ),
    "submitted": (
        "SELECT *, CASE WHEN denial_reason_code IS NULL THEN 0 ELSE 1 END AS is_denied FROM base "
        "WHERE submission_date IS NOT NULL"
    ),
    "wide": (
        "SELECT b.*, coalesce(p.payer_type, 'unknown') AS payer_type, "
        "coalesce(v.specialty, 'unknown') AS provider_specialty, "
        "coalesce(l.first_procedure, 'unknown') AS procedure_code, coalesce(l.line_count, 0) AS line_count, "
        "coalesce(l.procedure_count, 0) AS procedure_count, coalesce(l.diagnosis_count, 0) AS diagnosis_count, "
        "coalesce(l.modifier_count, 0) AS modifier_count, coalesce(l.line_amount_variance, 0.0) AS line_variance, "
        "CASE WHEN authorization_status = 'MISSING' THEN 1 ELSE 0 END AS auth_missing, "
        "CASE WHEN eligibility_status = 'FAIL' THEN 1 ELSE 0 END AS eligibility_fail "
        "FROM base b LEFT JOIN payers p USING (payer_id) LEFT JOIN providers v USING (provider_id) "
        "LEFT JOIN line_features l USING (claim_id)"
    ),
}

DEPENDS = {
    "claims": ["base"],
    "denials": ["base"],
    "denied": ["base"],
    "open_denials": ["denied"],
    "all_scored": ["base"],
    "appealed": ["base"],
    "line_features": ["lines"],
    "submitted": ["base"],
    "wide": ["base", "payers", "providers", "line_features"],
}


def register(name: str, sql: str, depends: list[str]) -> None:
    CTES[name] = sql
    DEPENDS[name] = depends


def with_ctes(names: list[str], body: str, recursive: bool = False) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for d in DEPENDS.get(name, []):
            visit(d)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


def asof(key: str, ts: str, label: str) -> str:
    frame = (
        f"OVER (PARTITION BY {key} ORDER BY {ts} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"
    )
    return f"count(*) {frame} AS n_{key}, coalesce(sum({label}) {frame}, 0) AS x_{key}"


def rate(key: str, prior: str, digits: int) -> str:
    return rnd(f"CASE WHEN n_{key} >= 5 THEN cast(x_{key} AS DOUBLE) / n_{key} ELSE {prior} END", digits)


register(
    "denial_matrix",
    f"SELECT *, {days('submission_date', 'service_date')} AS days_to_submission, "
    "CASE WHEN n_payer_id >= 5 THEN cast(x_payer_id AS DOUBLE) / n_payer_id ELSE 0.15 END AS payer_historical_denial_rate, "
    "CASE WHEN n_provider_id >= 5 THEN cast(x_provider_id AS DOUBLE) / n_provider_id ELSE 0.15 END AS provider_historical_denial_rate "
    f"FROM (SELECT *, {asof('payer_id', 'submission_date', 'is_denied')}, {asof('provider_id', 'submission_date', 'is_denied')} "
    "FROM (SELECT *, CASE WHEN denial_reason_code IS NULL THEN 0 ELSE 1 END AS is_denied FROM wide "
    "WHERE submission_date IS NOT NULL))",
    ["wide"],
)
register(
    "appeal_scores",
    "SELECT claim_id AS appeal_id, claim_id, payer_id, appeal_date, claim_amount, "
    f"CASE WHEN outcome = 'WON' THEN 1 ELSE 0 END AS y, {rnd(PROBABILITY, 4)} AS score FROM appealed",
    ["appealed"],
)
