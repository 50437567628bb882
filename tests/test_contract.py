"""The registered queries and their SQL counterparts agree on real tables (a sample of cheap ones)."""

import math
import os

import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
CHEAP = [
    "recovery_queue_topk",
    "claim_validation",
    "dashboard_totals",
    "payer_intelligence",
    "asof_denial_rate",
    "near_duplicate_claims",
    "capacity_plan",
    "ks_statistic",
    "topk_retrieval",
    "citation_summary",
    "audit_chain_segments",
    "claim_ingest_dedupe",
]


def test_every_counterpart_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(CHEAP) <= set(contract.oracle_sql())


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{FOLDER}/{file}'")
    cursor = con.execute(contract.oracle_sql()[name])
    want = table([c[0] for c in cursor.description], cursor.fetchall())
    df = contract.queries()[name](spark, FOLDER)
    assert table(df.columns, df.collect()) == want
