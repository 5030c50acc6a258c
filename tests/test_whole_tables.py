import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_components_of_all_rows(spark):
    """Against union-find."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    edges = [(r.l_orderkey, r.l_linenumber, r.l_suppkey, r.l_partkey + 1000000) for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect()]
    for _, _, f, g in edges:
        a, b = sorted((root(f), root(g)))
        up[b] = a
    want = sorted((o, n, root(f)) for o, n, f, _ in edges)
    assert sorted(map(tuple, entry.queries()["connected_components"](spark, SF).collect())) == want


@pytest.mark.parametrize("name", ["join_inner", "join_left_coalesce", "join_right", "join_full", "join_outer"])
def test_joins_of_all_customers(spark, name):
    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet'")
    got = [tuple(r) for r in entry.queries()[name](spark, folder).select("k", "bal", "c_name", "c_mktsegment").collect()]
    want = c.sql(f"SELECT k, bal, c_name, c_mktsegment FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    everyone, both = c.sql("SELECT count(*), count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer").fetchall()[0]
    assert len(got) > 150 and (len(got) == everyone if name in ("join_full", "join_outer") else both <= len(got) < everyone)
