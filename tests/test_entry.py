"""Driver contract smoke tests and the fixture numbers at sf0.001."""

import __spark_entry__ as E

from conftest import SF001


def test_entry_flagship_counts(spark):
    got = {r.severity: r.anomalies for r in E.entry(spark).collect()}
    # DuckDB-computed known-good counts (sf0.001): 37 anomalies
    assert got == {"CRITICAL": 1, "HIGH": 3, "MEDIUM": 10, "LOW": 23}


def test_oracle_keys_subset_of_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 30


def test_every_query_runs_at_sf0001(spark):
    for name, fn in E.queries().items():
        df = fn(spark, SF001)
        assert df.count() >= 0, name


def test_contract_functions_need_no_session():
    """queries()/oracle_sql() must work before any SparkSession exists."""
    import subprocess
    import sys

    from conftest import ROOT

    code = "import __spark_entry__ as E; q = E.queries(); o = E.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    r = subprocess.run([sys.executable, "-c", code], cwd="/tmp", env={"PYTHONPATH": ROOT, "PATH": "/usr/bin:/bin"},
                       capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr[-2000:]


def test_checkpoint_folder_is_required_off_one_machine():
    import types

    import pytest

    from tidewatch.session import ensure_checkpoint_dir, is_local

    assert is_local("local[4]") and is_local("local") and not is_local("local-cluster[2,1,1024]") and not is_local("yarn")
    sc = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    other = types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(other)
