"""The driver's contract, with and without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tallyforge.plans import queries as plans

REPO = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert __spark_entry__.entry(spark).columns == ["user_id", "event_id", "ts"] and __spark_entry__.entry(spark).count() > 0


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_llm(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(plans.QUERIES)), str(len(plans.oracle_sql()))], out.stderr


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = plans.QUERIES[name][0](spark, SF)
    got = sorted(str([_plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    cur = db.execute(plans.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(str([_plain(r[names.index(c)]) for c in sorted(names)]) for r in cur.fetchall())


def test_signed_prices_are_run(spark):
    customers = spark.read.parquet(f"{SF}/customer.parquet")
    assert customers.where("c_acctbal < 0").count() > 0
    assert plans.QUERIES["price_to_float_signed"][0](spark, SF).count() == customers.count()
