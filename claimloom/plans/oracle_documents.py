"""SQL counterparts of the queries in `documents.py`."""

from __future__ import annotations

from claimloom.operators.audit import ALLOWED_ACTIONS, BLOCKED_ACTIONS
from claimloom.operators.retrieval import EXCERPT_CHARS, POLICY_LINE_CHARS
from claimloom.plans.documents import EVENT_ACTIONS
from claimloom.plans.sql import case_map, register, rnd, with_ctes

ORACLE: dict[str, str] = {}


def add(name: str, ctes: list[str], body: str, recursive: bool = False) -> None:
    ORACLE[name] = with_ctes(ctes, body, recursive)


# Chunks: walk each text window by window.
_SPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
register(
    "clean",
    f"SELECT doc_id, t, length(t) AS n FROM (SELECT doc_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS t FROM documents) WHERE t <> ''",
    [],
)


def _cut(t: str, n: str, b: str) -> str:
    dot = rf"length(regexp_extract(substr({t}, {b} + 1, 700), '(?s)^(.*)\. ', 1))"
    return f"CASE WHEN {b} + 700 >= {n} THEN {n} WHEN {dot} > 350 THEN {b} + {dot} + 1 ELSE {b} + 700 END"


_next = "CASE WHEN w.e - 100 > w.b THEN w.e - 100 ELSE w.e END"
register(
    "walk",
    f"SELECT doc_id, 0 AS i, 0::BIGINT AS b, {_cut('t', 'n', '0')} AS e FROM clean UNION ALL "
    f"SELECT doc_id, i, b, {_cut('t', 'n', 'b')} AS e FROM (SELECT w.doc_id, w.i + 1 AS i, {_next} AS b, c.t, c.n FROM walk w JOIN clean c USING (doc_id) WHERE w.e < c.n)",
    ["clean"],
)
register(
    "chunks",
    "SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS chunk_index FROM ("
    "SELECT w.doc_id AS document_id, i, trim(substr(t, b + 1, e - b)) AS chunk_text, source || '-' || doc_id AS title, "
    "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 25 END AS payer_id FROM walk w JOIN clean USING (doc_id) JOIN documents USING (doc_id)) "
    "WHERE chunk_text <> ''",
    ["walk"],
)
add(
    "chunk_corpus",
    ["chunks"],
    "SELECT document_id, chunk_index, length(chunk_text) AS n_chars, md5(chunk_text) AS text_md5 FROM chunks",
    True,
)
add(
    "document_ingest",
    ["chunks"],
    "SELECT document_id, title, count(*) AS chunks, cast(sum(len(regexp_extract_all(lower(chunk_text), '[a-z0-9]+'))) AS BIGINT) AS tokens "
    "FROM chunks WHERE document_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL",
    True,
)

# Slot of a token: the digest read word by word, mod 768.
_word = "cast('0x' || substr(h, {}, 8) AS BIGINT)"
_m = 2**32 % 768
_slot = f"{_word.format(1)} % 768"
for _start in (9, 17, 25):
    _slot = f"(({_slot}) * {_m} + {_word.format(_start)}) % 768"


def vocabulary(name: str, source: str) -> None:
    register(
        f"{name}_tokens",
        f"SELECT k1, k2, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM ({source})",
        [],
    )
    register(
        name,
        "SELECT k1, k2, idx, cast(sum(sign) AS BIGINT) AS cnt FROM (SELECT k1, k2, slot % 384 AS idx, CASE WHEN slot < 384 THEN 1 ELSE -1 END AS sign "
        f"FROM {name}_tokens JOIN (SELECT token, {_slot} AS slot FROM (SELECT DISTINCT token, md5(token) AS h FROM {name}_tokens)) USING (token)) "
        "GROUP BY ALL HAVING sum(sign) <> 0",
        [f"{name}_tokens"],
    )
    register(f"{name}_norm", f"SELECT k1, k2, sum(cnt * cnt) AS n2 FROM {name} GROUP BY ALL", [name])


vocabulary("cv", "SELECT document_id AS k1, chunk_index AS k2, chunk_text AS text FROM chunks")
from claimloom.plans.sql import DEPENDS  # noqa: E402

DEPENDS["cv_tokens"] = ["chunks"]
add(
    "token_embedding_sparse",
    ["cv", "cv_norm"],
    f"SELECT k1 AS document_id, k2 AS chunk_index, idx, cnt AS count, {rnd('cnt / sqrt(n2::DOUBLE)', 8)} AS weight FROM cv JOIN cv_norm USING (k1, k2)",
    True,
)


def topk(name: str, source: str, scoped: bool, depends: list[str]) -> None:
    """Top 5 chunks per (k1, k2) query of `source` (k1, k2, text, payer)."""
    vocabulary(f"{name}_q", f"SELECT k1, k2, text FROM {source}")
    DEPENDS[f"{name}_q_tokens"] = depends
    scope = "WHERE c.payer_id IS NULL OR c.payer_id = q.payer" if scoped else ""
    register(
        name,
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k1, k2 ORDER BY score DESC, document_id, chunk_index) AS rank FROM ("
        "SELECT q.k1, q.k2, c.document_id, c.chunk_index, coalesce(d.dot, 0) / CASE WHEN coalesce(qn.n2, 0) * coalesce(cn.n2, 0) = 0 THEN 1.0::DOUBLE "
        f"ELSE sqrt((qn.n2 * cn.n2)::DOUBLE) END AS score FROM {source} q CROSS JOIN chunks c "
        f"LEFT JOIN (SELECT a.k1, a.k2, b.k1 AS document_id, b.k2 AS chunk_index, sum(a.cnt * b.cnt)::DOUBLE AS dot FROM {name}_q a JOIN cv b USING (idx) GROUP BY ALL) d "
        "ON d.k1 = q.k1 AND d.k2 IS NOT DISTINCT FROM q.k2 AND d.document_id = c.document_id AND d.chunk_index = c.chunk_index "
        f"LEFT JOIN {name}_q_norm qn ON qn.k1 = q.k1 AND qn.k2 IS NOT DISTINCT FROM q.k2 "
        f"LEFT JOIN cv_norm cn ON cn.k1 = c.document_id AND cn.k2 = c.chunk_index {scope})) WHERE rank <= 5",
        [*depends, f"{name}_q", f"{name}_q_norm", "cv", "cv_norm", "chunks"],
    )


register("bench_scoped", "SELECT item_id AS k1, 0 AS k2, text, item_id % 25 AS payer FROM benchmark", [])
topk("bench_hits", "bench_scoped", True, ["bench_scoped"])
topk("open_hits", "bench_scoped", False, ["bench_scoped"])
add(
    "topk_retrieval",
    ["bench_hits"],
    f"SELECT k1 AS query_id, document_id, chunk_index, rank, {rnd('score', 4)} AS similarity_score FROM bench_hits",
    True,
)
register("vec", "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings", [])
register("cent", "SELECT label, i, cast(sum(cast(x AS DECIMAL(20,10))) AS DOUBLE) / count(*) AS x FROM vec GROUP BY ALL", ["vec"])
add(
    "vector_topk",
    ["vec", "cent"],
    f"SELECT label::BIGINT AS label, id, rank, {rnd('s', 4)} AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, id) AS rank FROM ("
    "SELECT c.label, v.vec_id AS id, sum(c.x * v.x) / (sqrt(sum(c.x * c.x)) * sqrt(sum(v.x * v.x))) AS s FROM cent c JOIN vec v USING (i) GROUP BY ALL)) WHERE rank <= 5",
)
register(
    "expected",
    "SELECT item_id AS k1, min(doc_id) AS expected_document_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY 1",
    [],
)
register(
    "hit_ranks",
    "SELECT k1 AS query_id, expected_document_id, min(rank) FILTER (document_id = expected_document_id) AS r FROM expected LEFT JOIN open_hits USING (k1) GROUP BY ALL",
    ["expected", "open_hits"],
)
_hits = ", ".join(f"coalesce(r <= {k}, false) AS hit_at_{k}" for k in (1, 3, 5))
add("retrieval_recall", ["hit_ranks"], f"SELECT query_id, expected_document_id, r AS rank_of_correct_document, {_hits} FROM hit_ranks", True)
_rec = ", ".join(f"{rnd(f'avg(CASE WHEN r <= {k} THEN 1.0::DOUBLE ELSE 0.0 END)', 4)} AS recall_at_{k}" for k in (1, 3, 5))
add("retrieval_recall_summary", ["hit_ranks"], f"SELECT count(*) AS n_queries, {_rec} FROM hit_ranks", True)

# Evidence, packets, citations.
register("with_lines", "SELECT DISTINCT l_orderkey AS claim_id, true AS has_lines FROM lineitem", [])


def _gate(policy: str, denial: str) -> str:
    items = [
        ("denial_reason", denial),
        ("procedure_information", "coalesce(has_lines, false)"),
        ("authorization_status", "authorization_status IS NOT NULL"),
        ("supporting_documentation", "documentation_completeness >= 70"),
        ("payer_policy_retrieved", policy),
    ]
    held = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, c in items)
    missing = ", ".join(f"CASE WHEN {c} THEN NULL ELSE '{n}' END" for n, c in items)
    return f"cast({rnd(f'100.0 * (1 + {held}) / 6', 0)} AS BIGINT) AS readiness_percent, concat_ws(',', {missing}) AS missing_evidence"


add(
    "evidence_gate",
    ["base", "with_lines"],
    "SELECT *, readiness_percent >= 60 AND NOT contains(missing_evidence, 'denial_reason') AS generation_allowed FROM ("
    f"SELECT claim_id, {_gate('false', 'denial_reason_code IS NOT NULL')} FROM base LEFT JOIN with_lines USING (claim_id))",
)
register("opened", "SELECT * FROM base WHERE status = 'DENIED'", ["base"])
register(
    "policy_q",
    "SELECT DISTINCT denial_reason_code AS k1, payer_id AS k2, denial_reason_code || ' appeal policy' AS text, payer_id AS payer FROM opened",
    ["opened"],
)
topk("policy_hits", "policy_q", True, ["policy_q"])
register(
    "cited",
    f"SELECT h.*, c.title, c.chunk_text, substr(c.chunk_text, 1, {EXCERPT_CHARS}) AS excerpt, substr(c.chunk_text, 1, {POLICY_LINE_CHARS}) AS line "
    "FROM policy_hits h JOIN chunks c USING (document_id, chunk_index)",
    ["policy_hits", "chunks"],
)
register(
    "bundle",
    "SELECT k1, k2, count(*) AS n, string_agg('- ' || title || ': ' || line || '...', chr(10) ORDER BY rank) AS lines FROM cited GROUP BY ALL",
    ["cited"],
)


def _plain(x: str) -> str:
    return rf"regexp_replace(cast(cast({rnd(x, 2)} AS DECIMAL(14,2)) AS VARCHAR), '(\.\d)0$', '\1')"


_letter = (
    "'DRAFT APPEAL - synthetic data, not to be sent before a person has approved it' || chr(10) || chr(10) || 'Claim ' || claim_number || "
    "', denied as ' || denial_reason_code || chr(10) || chr(10) || 'On record:' || chr(10) || '* amount billed: ' || "
    f"{_plain('claim_amount')} || chr(10) || '* date of service: ' || strftime(service_date, '%Y-%m-%d %H:%M:%S') || chr(10) || "
    f"'* documents complete, percent: ' || {_plain('documentation_completeness')} || chr(10) || '* authorization: ' || authorization_status || "
    "chr(10) || chr(10) || 'Policies found:' || chr(10) || coalesce(lines, '- none') || chr(10) || chr(10) || "
    "'We ask for a new decision on ' || denial_reason_code || '. The request rests on the record and the policies quoted above alone.' || chr(10) || "
    "CASE WHEN missing_evidence <> '' THEN 'Still to be supplied: ' || replace(missing_evidence, ',', ', ') || chr(10) ELSE '' END"
)
register(
    "packets",
    f"SELECT *, CASE WHEN blocked THEN NULL ELSE {_letter} END AS draft FROM (SELECT *, readiness_percent < 60 AS blocked FROM ("
    f"SELECT o.*, b.n, b.lines, {_gate('coalesce(n, 0) > 0', 'true')} FROM opened o LEFT JOIN with_lines USING (claim_id) "
    "LEFT JOIN bundle b ON b.k1 = o.denial_reason_code AND b.k2 = o.payer_id))",
    ["opened", "with_lines", "bundle"],
)
add(
    "appeal_packets",
    ["packets"],
    "SELECT claim_id, blocked, readiness_percent, missing_evidence, CASE WHEN blocked THEN 0 ELSE coalesce(n, 0) END AS citations, "
    "length(draft) AS draft_chars, md5(draft) AS draft_md5, CASE WHEN blocked THEN NULL ELSE 'PENDING_APPROVAL' END AS status FROM packets",
    True,
)
register(
    "checked",
    "SELECT x.claim_id, x.document_id, x.chunk_index, k.chunk_text IS NOT NULL AS chunk_exists, "
    "coalesce(k.chunk_text IS NOT NULL AND q <> '' AND contains(k.chunk_text, q), false) AS faithful, h.rank IS NOT NULL AS was_retrieved FROM ("
    "SELECT *, trim(rtrim(excerpt, '.')) AS q FROM (SELECT p.claim_id, p.denial_reason_code, p.payer_id, c.document_id, "
    "c.chunk_index + CASE WHEN p.claim_id % 15 = 0 THEN 1000000 ELSE 0 END AS chunk_index, "
    "CASE WHEN p.claim_id % 10 = 0 THEN 'An invented sentence.' ELSE c.excerpt END AS excerpt "
    "FROM packets p JOIN cited c ON c.k1 = p.denial_reason_code AND c.k2 = p.payer_id WHERE NOT p.blocked)) x "
    "LEFT JOIN chunks k ON k.document_id = x.document_id AND k.chunk_index = x.chunk_index "
    "LEFT JOIN policy_hits h ON h.k1 = x.denial_reason_code AND h.k2 = x.payer_id AND h.document_id = x.document_id AND h.chunk_index = x.chunk_index",
    ["packets", "cited", "chunks", "policy_hits"],
)
add("citation_check", ["checked"], "SELECT * FROM checked", True)


def _share(cond: str) -> str:
    return rnd(f"(count(*) FILTER ({cond}))::DOUBLE / count(*)", 4)


add(
    "citation_summary",
    ["checked"],
    f"SELECT count(*) AS total_citations, {_share('chunk_exists')} AS referential_integrity_rate, {_share('faithful')} AS excerpt_fidelity_rate, "
    f"{_share('was_retrieved')} AS retrieved_rate, {rnd('1.0::DOUBLE - (count(*) FILTER (chunk_exists))::DOUBLE / count(*)', 4)} AS unsupported_citation_rate FROM checked",
    True,
)

# Audit chains: a recursive walk per entity.
_start = """'{"actor_type": "user", "event_type": "' || event_type || '", "payload": ' || props || ', "prev_hash": "'"""
_digest = "sha256(concat_ws('|', event_id, user_id, 'user', event_type, props, epoch_us(ts)))"
register(
    "seqs",
    f"SELECT *, {_start} AS m, {_digest} AS digest, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events",
    [],
)
register(
    "chain",
    """SELECT user_id, seq, event_id, '' AS prev_hash, sha256(m || '"}') AS hash FROM seqs WHERE seq = 1 UNION ALL """
    """SELECT s.user_id, s.seq, s.event_id, c.hash, sha256(s.m || c.hash || '"}') FROM chain c JOIN seqs s ON s.user_id = c.user_id AND s.seq = c.seq + 1""",
    ["seqs"],
)
add("audit_chain_build", ["chain"], "SELECT event_id, user_id AS entity_id, seq, prev_hash, hash FROM chain", True)
# seal: of all whole segments before the record's own; rolled: of its segment's contents up to the record.
_fresh = "c.seq % 25 = 0"
_seal = f"CASE WHEN {_fresh} THEN sha256(c.seal || c.rolled) ELSE c.seal END"
_prev = f"CASE WHEN {_fresh} THEN sha256(c.seal || c.rolled) ELSE c.hash END"
register(
    "segchain",
    """SELECT user_id, seq, event_id, '' AS prev_hash, sha256(m || '"}') AS hash, '' AS seal, sha256(digest) AS rolled FROM seqs WHERE seq = 1 UNION ALL """
    f"""SELECT s.user_id, s.seq, s.event_id, {_prev}, sha256(s.m || {_prev} || '"}}'), {_seal}, sha256(CASE WHEN {_fresh} THEN '' ELSE c.rolled END || s.digest) """
    "FROM segchain c JOIN seqs s ON s.user_id = c.user_id AND s.seq = c.seq + 1",
    ["seqs"],
)
add("audit_chain_segments", ["segchain"], "SELECT event_id, user_id AS entity_id, (seq - 1) // 25 AS segment, seq, prev_hash, hash FROM segchain", True)
add(
    "audit_chain_verify",
    ["seqs"],
    "SELECT user_id AS entity_id, count(*) AS records, count(*) FILTER (event_id % 997 = 5) = 0 AS valid, "
    "min(seq) FILTER (event_id % 997 = 5) AS first_bad_seq, arg_min(event_id, seq) FILTER (event_id % 997 = 5) AS first_bad_event FROM seqs GROUP BY 1",
)
_action = case_map("event_type", EVENT_ACTIONS)
_allowed = ", ".join(f"'{a}'" for a in ALLOWED_ACTIONS)
_blocked = ", ".join(f"'{a}'" for a in BLOCKED_ACTIONS)
register("acts", f"SELECT event_id, user_id, {_action} AS action FROM events", [])
add(
    "policy_compliance",
    ["acts"],
    f"SELECT *, CASE WHEN action IN ({_blocked}) THEN 'blocked' ELSE 'unknown' END AS violation FROM acts WHERE action NOT IN ({_allowed})",
)
add(
    "policy_compliance_summary",
    ["acts"],
    f"SELECT count(*) AS actions, count(*) FILTER (action NOT IN ({_allowed})) AS violations, "
    f"{rnd(f'(count(*) FILTER (action NOT IN ({_allowed})))::DOUBLE / count(*)', 6)} AS violation_rate FROM acts",
)
add(
    "workflow_decisions",
    ["open_denials"],
    "SELECT action_id, action_type, CASE WHEN ok THEN decision ELSE status END AS status, CASE WHEN ok THEN decision_id END AS decision_id, "
    "CASE WHEN ok THEN reviewer_id END AS reviewer_id FROM (SELECT *, coalesce(status = 'PENDING_APPROVAL' AND decision IN ('APPROVED', 'REJECTED'), false) AS ok FROM ("
    "SELECT claim_id AS action_id, action AS action_type, CASE WHEN claim_id % 10 = 0 THEN 'EXECUTED' ELSE 'PENDING_APPROVAL' END AS status FROM open_denials) "
    "LEFT JOIN (SELECT event_id // 2 * 3 AS action_id, arg_min(event_id, (ts, event_id)) AS decision_id, "
    "arg_min(CASE event_type WHEN 'view' THEN 'APPROVED' WHEN 'click' THEN 'REJECTED' ELSE 'HOLD' END, (ts, event_id)) AS decision, "
    "arg_min(user_id, (ts, event_id)) AS reviewer_id FROM events GROUP BY 1) USING (action_id))",
)
add("audit_listing", [], "SELECT event_id, event_type, props AS payload FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 100")
ORACLE["audit_listing"] = ORACLE["audit_listing"].removeprefix("WITH \n")

# Ingest and registry.
register(
    "msgs",
    "SELECT claim_number, arrival, message_id, min(amount) AS claim_amount FROM (SELECT 'CLM-' || l_orderkey AS claim_number, l_linenumber AS arrival, "
    "sha256(concat_ws('|', l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax)) AS message_id, l_extendedprice AS amount FROM lineitem) GROUP BY ALL",
    [],
)
register("stored", "SELECT claim_number FROM base WHERE status = 'DENIED'", ["base"])
register("numbered", "SELECT *, row_number() OVER (PARTITION BY claim_number ORDER BY arrival, message_id) AS r, claim_number IN (SELECT claim_number FROM stored) AS known FROM msgs", ["msgs", "stored"])
add(
    "claim_ingest_dedupe",
    ["numbered"],
    "SELECT claim_number, claim_amount, 'professional' AS claim_type, message_id, 1::BIGINT AS lines, false AS is_synthetic, 'api_manual_entry' AS data_source "
    "FROM numbered WHERE r = 1 AND NOT known",
)
add(
    "claim_ingest_rejects",
    ["numbered"],
    "SELECT claim_number, CASE WHEN known THEN 'claim_number already exists' ELSE 'duplicate in batch' END AS reason, count(*) AS messages "
    "FROM numbered WHERE known OR r > 1 GROUP BY ALL",
)
add(
    "model_registry_champion",
    [],
    "SELECT event_type AS model_type, count(*) AS candidates, arg_max(event_id::VARCHAR, (value, ts, event_id::VARCHAR)) AS champion_version, "
    "'model-' || arg_max(user_id % 4, (value, ts, event_id::VARCHAR)) AS champion_name, max(value) AS pr_auc FROM events WHERE event_id % 50 <> 0 GROUP BY 1",
)
ORACLE["model_registry_champion"] = ORACLE["model_registry_champion"].removeprefix("WITH \n")
