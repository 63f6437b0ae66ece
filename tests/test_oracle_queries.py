"""Every registered query against its DuckDB oracle on the smallest test scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import canon  # noqa: E402
from shipwatch.sources.tables import TABLES  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402

#: the queries of this library's own operators; those of the optional subpackage have their own tests
QUERIES = {n: f for n, f in entry.queries().items() if n in entry.QUERIES}
ORACLES = {n: s for n, s in entry.oracle_sql().items() if n in entry.QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield c
    c.close()


def test_every_query_has_an_oracle_or_is_listed():
    rows_only = {"late_risk_predictions", "late_risk_prediction_head", "feature_importance", "scenario_scores", "training_run"}
    missing = set(QUERIES) - set(ORACLES) - rows_only
    assert not missing


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["market", "order_region", "shipping_mode", "orders", "sales",
                          "late_delivery_rate", "avg_days_real"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    rows, cols = df.collect(), df.columns
    rel = con.execute(ORACLES[name])
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    order = sorted(cols)
    a = sorted(tuple(canon(r[cols.index(c)]) for c in order) for r in rows)
    b = sorted(tuple(canon(r[ocols.index(c)]) for c in order) for r in orows)
    assert a == b


def test_entry_loads_by_file_path(tmp_path, monkeypatch):
    import importlib.util
    import os as _os
    monkeypatch.chdir(tmp_path)
    path = _os.path.join(_os.path.dirname(_os.path.dirname(_os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("entry_by_path", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    assert set(mod.oracle_sql()) <= set(mod.queries()) and len(mod.queries()) == len(entry.queries())
