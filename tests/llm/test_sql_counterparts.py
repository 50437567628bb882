"""Training-data queries against their SQL counterparts on small real tables."""

import os

import pytest

from claimloom.llm.oracle import ORACLE_SQL
from claimloom.llm.queries import QUERIES
from tests.test_contract import FOLDER, table


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{FOLDER}/{file}'")
    cursor = con.execute(ORACLE_SQL[name])
    want = table([c[0] for c in cursor.description], cursor.fetchall())
    df = QUERIES[name](spark, FOLDER)
    assert table(df.columns, df.collect()) == want
