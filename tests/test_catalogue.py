import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
reference = [n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", reference)
def test_same_rows_as_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    order = sorted(got.columns)
    result = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == order
    want = [tuple(r[names.index(c)] for c in order) for r in result.fetchall()]
    assert sorted(map(repr, map(tuple, got.select(order).collect()))) == sorted(map(repr, want))
    assert want
