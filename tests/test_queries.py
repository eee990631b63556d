"""Every catalogue query against its SQL, or that it gives rows."""

import pytest

from scholium.plans import catalogue
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = rows(catalogue.QUERIES[name](spark, SF).toPandas())
    if name in catalogue.ORACLE:
        assert got == rows(con.execute(catalogue.ORACLE[name]).df())
    else:
        assert got[0]


def test_entry_has_no_other_keys(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalogue.QUERIES) <= set(e.queries())


def test_entry_without_a_package_that_only_training_data_need(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    (tmp_path / "xxhash.py").write_text("raise ModuleNotFoundError(\"No module named 'xxhash'\", name='xxhash')")
    repo = str(Path(__file__).resolve().parents[1])
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {repo!r}]; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLE))] or not (Path(repo) / "corpus_pipeline.py").exists()
