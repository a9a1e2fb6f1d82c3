"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from catalog import ORACLES, QUERIES
from logweave.operators import reports

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(v[i]) for i in order) for v in values)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    expected = tables.execute(ORACLES[name])
    names = [c[0] for c in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, expected.fetchall())


def test_long_cells_are_one_row(spark, tables, monkeypatch):
    """A cell of more entries than a row takes is still one cell."""
    monkeypatch.setattr(reports, "CELL_ENTRIES", 2)
    got = QUERIES["report_counted_cells"](spark, SF).select("pick_no", "host", "service", "cell")
    expected = tables.execute(f"SELECT pick_no, host, service, cell FROM ({ORACLES['report_counted_cells']})")
    assert rows(got.columns, got.collect()) == rows(got.columns, expected.fetchall())


def test_flagship(spark):
    import importlib.util

    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() >= 5
    assert set(QUERIES) <= set(module.queries())
    assert set(ORACLES) <= set(module.oracle_sql()) <= set(module.queries())
