"""Registered queries against their SQL, and the removable part's guard."""

import subprocess
import sys

import duckdb
import pytest

from gridloom.plans.registry import QUERIES, SQL
from tools_compare import TABLES, canon

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cur = db.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert canon(df.collect(), df.columns) == canon(cur.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_kernel_query_runs_alike(spark, name):
    rows = sorted(map(str, QUERIES[name](spark, DATA).collect()))
    assert rows and rows == sorted(map(str, QUERIES[name](spark, DATA).collect()))


def test_entry_without_training_part(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('gridloom.llm'):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and len(e.queries()) > 200 and len(e.oracle_sql()) > 190\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=".")
