"""Every registered query of the engine against its oracle on the smallest tables; the entry point; the guards."""

import datetime
import decimal
import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from quillstone import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, oracle, name):
    df = catalogue.queries()[name](spark, SF)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(set(df.columns)) == len(df.columns)
        return
    result = oracle.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    wanted = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in rows), key=str)
    assert got == wanted


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["classification", "n", "mean_score"] and df.count() > 0


def test_catalogue_and_oracles_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalogue.oracle_sql()) >= 0.85 * len(catalogue.queries())


def test_entry_works_without_the_corpus_operators(tmp_path):
    """The entry module must import where their folder and the pipeline are gone."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in os.listdir(root):
        if name in ("quillstone", "__spark_entry__.py"):
            target = tmp_path / name
            if name == "quillstone":
                target.mkdir()
                for part in os.listdir(f"{root}/quillstone"):
                    if part not in ("llm", "__pycache__"):
                        (target / part).symlink_to(f"{root}/quillstone/{part}")
            else:
                target.symlink_to(f"{root}/{name}")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
