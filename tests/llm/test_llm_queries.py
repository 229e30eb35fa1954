"""Queries that have SQL, over whole small tables, and the entry point."""

import duckdb
import pytest

from lethe.llm import queries

from ..rows import rows
from .frames import DATA


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_rows_as_duckdb(spark, name):
    session = duckdb.connect()
    session.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(session.sql(queries.ORACLES[name]).df())


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())
