"""Every registered query against its DuckDB query, values and types."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from oracle import REPORTS

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
# DuckDB interpolates quantiles with one fused rounding; the last bit can differ.
INTERPOLATED = ("profile_numeric", "profile_rides")
TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def test_every_query_has_an_oracle():
    from spokeframe.plans import QUERIES

    assert set(QUERIES) == set(REPORTS)
    assert set(REPORTS) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_equal_to_duckdb(spark, duck, name):
    table = contract.queries()[name](spark, SF_DIR)
    expected = duck.sql(contract.oracle_sql()[name])
    columns = sorted(table.columns)
    assert columns == sorted(expected.columns)
    types = {f.name: TYPES[f.dataType.simpleString()] for f in table.schema.fields}
    assert types == dict(zip(expected.columns, map(str, expected.types)))
    found = sorted((tuple(r[c] for c in columns) for r in table.collect()), key=repr)
    order = [expected.columns.index(c) for c in columns]
    wanted = sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=repr)
    if name in INTERPOLATED:
        assert [[r if isinstance(r, str) else pytest.approx(r, rel=1e-15, abs=0) for r in row] for row in wanted] == [
            list(row) for row in found
        ]
    else:
        assert found == wanted


def test_entry(spark):
    table = contract.entry(spark)
    assert table.count() == 24
    assert table.columns[:2] == ["month", "member_casual"]
