"""The registered queries against their DuckDB SQL on the smallest test scale."""

import duckdb
import pytest

from shipwatch.llm.oracle import ORACLE
from shipwatch.llm.queries import QUERIES
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    rel = con.execute(ORACLE[name])
    columns = [d[0] for d in rel.description]
    want = sorted((tuple(r) for r in rel.fetchall()), key=str)
    got = QUERIES[name](spark, SF_SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == want
