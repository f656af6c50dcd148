"""Every registered query of the engine against its SQL, run by DuckDB on the same files."""

import math
import os

import pytest

from loomstone import plans

DATA = os.environ.get("LOOMSTONE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not there")
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return None if v is None else str(v)


def rows(table, names):
    return sorted(zip(*[[plain(v) for v in table[n].to_pylist()] for n in names], strict=True), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA).toArrow()
    if name not in ORACLES:
        assert found.num_columns
        return
    want = duck.sql(ORACLES[name]).to_arrow_table()
    names = sorted(found.column_names)
    assert names == sorted(want.column_names)
    assert rows(found, names) == rows(want, names)


COSTLY = "q_codes q_number_edges q_dates_named q_linear_algebra q_array_algebra q_random q_graphemes q_diff_lines".split()


@pytest.mark.parametrize("name", COSTLY)
def test_costly_rows_of_one_small_file_are_dealt_over_tasks(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan
