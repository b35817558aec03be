import importlib.util
import os


def _entry_module():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    m = _entry_module()
    df = m.entry(spark)
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert "c_custkey" in df.columns and "value_night_diff_std" in df.columns


def test_contract_keys(spark):
    m = _entry_module()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60
