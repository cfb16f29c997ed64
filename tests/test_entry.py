import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from tessera.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


def normal(v):
    return round(v, 6) if isinstance(v, float) else v


def rows(found, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(normal(r[i]) for i in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, con, small, name):
    wanted = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    df = catalogue.queries()[name](spark, small)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.collect(), df.columns) == rows(wanted.fetchall(), names)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    for name in ("tessera", "__spark_entry__.py"):
        source = os.path.join(__spark_entry__.HERE, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), e.llm)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(catalogue.queries()) and out[2] == "None"


@pytest.mark.parametrize("name, column, filtered", [("html_text_strip", "html", False), ("stale_runs", "ts", False), ("keyset_page", "o_orderpriority", True), ("expert_queue", "event_type", True)])
def test_scans_read_few_columns_and_take_filters(spark, small, name, column, filtered):
    plan = catalogue.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all(line.count(":", line.index("ReadSchema")) <= 7 for line in scans) and column in plan
    assert not filtered or any("PushedFilters: [" in line and "PushedFilters: []" not in line for line in scans)
