"""Every registered query against its SQL twin on the smallest given tables."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no given tables")


@pytest.fixture(scope="module")
def duck():
    connection = pytest.importorskip("duckdb").connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    result = duck.execute(entry.oracle_sql()[name])
    found = [item[0] for item in result.description]
    assert sorted(found) == columns
    order = [found.index(column) for column in columns]
    want = sorted((tuple(plain(row[i]) for i in order) for row in result.fetchall()), key=repr)
    got = sorted(
        (tuple(plain(v) for v in row) for row in frame.select(*[f"`{c}`" for c in columns]).collect()),
        key=repr,
    )
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_has_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 24
