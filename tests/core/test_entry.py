"""The driver's contract: queries equal their SQL, and the training-data operators are an optional part."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tessella import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def rows(table):
    plain = lambda v: round(v, 6) if isinstance(v, float) else str(v) if not isinstance(v, (int, bool, type(None))) else v
    return sorted((tuple(plain(v) for v in r) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert rows(df.select(*[f"`{c}`" for c in cols]).collect()) == rows(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_stands_alone(tmp_path):
    """With the optional part deleted, the entry still imports and offers the other queries."""
    for item in ("__spark_entry__.py", "tessella"):
        src = os.path.join(ROOT, item)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / item, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / item)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
