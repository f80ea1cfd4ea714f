"""Queries of this subpackage that have SQL, against that SQL."""

import math

import duckdb
import pytest

from sievector.llm import queries

SF = "/root/testdata/sf0.001"


def normal(v):
    return round(v, 5) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in cursor.description)
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == names
    want = sorted((tuple(normal(dict(zip((d[0] for d in cursor.description), r))[c]) for c in names) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(normal(r[c]) for c in names) for r in found.collect()), key=repr) == want
