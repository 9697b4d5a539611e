import __spark_entry__ as E


def test_entry_runs_on_smallest_scale(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "units" in df.columns


def test_every_query_has_a_callable_and_oracles_are_subset():
    qs, os_ = E.queries(), E.oracle_sql()
    assert set(os_) <= set(qs)
    assert len(qs) >= 100


def test_registry_imports_without_a_session():
    import subprocess
    import sys
    code = ("import sys; sys.path.insert(0, '.'); import __spark_entry__ as E; "
            "assert len(E.oracle_sql()) > 100 and len(E.queries()) > 100")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
