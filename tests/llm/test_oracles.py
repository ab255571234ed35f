"""Queries with an SQL form against DuckDB on the small tables."""

import pytest

from respondo.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    from tools.oracle_check import compare, compare_types, duck
    con = duck(SF)
    df = QUERIES[name](spark, SF)
    ok, why = compare_types(df, con, ORACLE[name])
    assert ok, why
    ok, why = compare(df, con.execute(ORACLE[name]))
    assert ok, why


def test_every_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
