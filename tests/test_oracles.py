"""Every registered query against its SQL counterpart in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import SF_DIR, plan_of
from tallyfolio.plans import queries as registered

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES, ORACLES = registered.QUERIES, registered.ORACLES


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir)
    wanted = db.execute(ORACLES[name])
    columns = sorted(column[0] for column in wanted.description)
    assert sorted(got.columns) == columns
    order = [[c[0] for c in wanted.description].index(c) for c in columns]
    expected = sorted(repr(tuple(row[i] for i in order)) for row in wanted.fetchall())
    assert sorted(repr(tuple(row)) for row in got.select(*columns).collect()) == expected
    assert expected


def test_all_have_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows_and_a_stable_schema(spark):
    answer = contract.entry(spark)
    assert answer.columns == ["request_id", "unique_id", "name", "content", "file_path", "key_feature", "score"]
    assert answer.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_anywhere(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
