"""The driver's contract, on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_point
from rankflow import catalog
from tests.conftest import SF

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# The slow ones, and those whose bounds need more rows than these tables have.
QUICK = [
    "exact_quantiles_by_window", "exact_quantiles_large", "dds_quantiles", "ddsc_quantiles_signed",
    "udds_quantiles", "moments_merge", "kll_quantiles", "req_quantiles", "late_count",
    "accuracy_bands", "binned_histogram", "parse_taxi_event", "gen_mixture", "window_power_udds",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r)
                   for r in rows), key=lambda r: [(v is None, str(type(v)), v) for v in r])


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, SF)
    names = sorted(df.columns)
    sql = entry_point.oracle_sql()[name]
    columns = ", ".join(f'"{c}"' for c in names)
    expect = duck.execute(f"SELECT {columns} FROM ({sql})").fetchall()
    assert plain(df.select(*names).collect()) == plain(expect)


def test_every_query_has_sql_of_the_same_columns(spark, duck):
    sql = entry_point.oracle_sql()
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(sql) <= set(entry_point.queries())
    for name, text in sql.items():
        assert duck.execute(f"DESCRIBE {text}").fetchall(), name


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns[:2] == ["window_id", "n"] and df.count() == 30


def test_the_rest_works_without_the_optional_parts(tmp_path):
    """As in a checkout from which the folders, or the pipeline as well, are deleted."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for gone in (("llm",), ("llm", "corpus_pipeline.py")):
        copy = tmp_path / str(len(gone))
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
        said = subprocess.run(
            [sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); "
             "assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q)"],
            cwd=copy, capture_output=True, text=True)
        assert said.stdout.split() == [str(len(catalog.QUERIES)), "False"], said.stderr
