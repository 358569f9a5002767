"""Queries against their SQL on the smallest tables, and names that two of them would share."""

import ast
import glob
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from pathledger import queries

SF = "/root/testdata/sf0.001"


def against_sql(spark, name):
    """(columns of the query, of its SQL), and their rows, sorted."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    want = con.execute(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    return (got.columns, [c[0] for c in want.description]), sorted(map(tuple, got.collect()), key=str), sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("name", ["mount_tables", "descend_verdicts", "link_cap", "open_files", "top_children", "collapsed_directories", "subtree_rollup"])
def test_query_equals_its_sql(spark, name):
    (columns, named), got, want = against_sql(spark, name)
    assert columns == named and got == want and want


def test_no_constant_of_the_queries_is_set_twice():
    names = Counter(t.id for x in ast.parse(Path(queries.__file__).read_text()).body if isinstance(x, ast.Assign) for t in x.targets if isinstance(t, ast.Name))
    # FILES_SQL is built in two steps, next to each other
    assert [n for n, k in names.items() if k > 1] == ["FILES_SQL"]
