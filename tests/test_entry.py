import importlib.util
import os

from tests.conftest import ROOT


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_contract(spark):
    m = _entry_module()
    df = m.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["gid", "name", "count", "sum", "mean", "stddev", "min", "max"]
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and set(m.catalog.QUERIES) == set(m.catalog.ORACLE) and len(m.catalog.QUERIES) >= 60
    assert all(callable(f) for f in q.values())
