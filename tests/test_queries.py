"""Every registered query against its DuckDB SQL at the smallest size, and the driver's contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from flowmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 7) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted([plain(x) for x in r] for r in df.select(*names).collect())
    result = duck.execute(registry.oracle_sql()[name])
    at = [x[0] for x in result.description]
    assert sorted(at) == names
    want = sorted([plain(r[at.index(c)]) for c in names] for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "bench.py"))


def test_nothing_else_imports_the_training_data_operators():
    root = os.path.join(os.path.dirname(entry.__file__), "flowmill")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as x:
                    assert "flowmill.llm" not in x.read(), f


def test_names_are_known_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
