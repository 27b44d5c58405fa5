"""Driver queries of files, shapes and programs against their SQL."""

import os

import pytest

from strandmap import program_queries, queries

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in vars(program_queries).items() if n in queries.oracle_sql() and getattr(f, "__module__", "") == program_queries.__name__]


@pytest.fixture(scope="module")
def tables():
    con = pytest.importorskip("duckdb").connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def test_all_are_registered():
    assert len(NAMES) >= 25 and set(NAMES) <= set(queries.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, tables, name):
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(map(repr, map(tuple, got.select(*[f"`{c}`" for c in columns]).collect())))
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted(repr(r) for r in tables.execute(f"SELECT {quoted} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_quads_of_program_seven_are_counted_without_a_sort(spark):
    """A sort of all quads by predicate would spill many times the input."""
    plan = queries.queries()["program_seven"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "SortAggregate" not in above and above.count("ObjectHashAggregate") == 2
