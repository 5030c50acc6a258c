import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkpipe import col, concat_all, connected_components, describe_table, table
from sparkpipe.operators import solutions as S
from sparkpipe.operators.records import RecordSpecification
from sparkpipe.plans.arrow import Arrow
from sparkpipe.plans.expr import parse, to_source
from sparkpipe.plans.loader import load_plan
from sparkpipe.sources.frames import from_rows
from sparkpipe.sources.space import SparkSpace

SF = "/root/testdata/sf0.001"
D = table("d", ["x", "y"])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("text", ["x && y", "x || y", "! y", "~ y", "x = y", "x & y", "x | y", "x ^ y", "x != None"])
def test_forbidden(text):
    with pytest.raises(ValueError):
        D.extend({"z": text})


def test_build_errors():
    with pytest.raises(ValueError):
        D.extend({"x": "x+1", "y": "x+2"})
    with pytest.raises(NameError):
        D.extend({"z": "q"})
    with pytest.raises(ValueError):
        D.extend([("z", "x"), ("z", "y")])
    with pytest.raises(ValueError):
        D.project({"x": 1})
    with pytest.raises(KeyError):
        D.extend({"z": "x.nothing()"})
    with pytest.raises(ValueError):
        D.extend({"z": "x.std()"}, order_by=["y"])


@pytest.mark.parametrize("text", ["x + y * 2 - -3", "(x + y) * 2", "not (x > 1 and y < 2) or x == 3", "x ** -y ** 2", "x.is_in([1, 2])", "x.mapv({1: 'a'}, 'b')", "x - (y - 1)", "'it\\'s' %+% x"])
def test_source_round_trip(text):
    t = parse(text)
    assert parse(to_source(t)).is_equal(t)


def test_plan_round_trip_and_composition():
    p = D.extend({"z": "x + y"}).select_rows("z > 1").project({"n": "(1).sum()"}, group_by=["x"]).order_rows(["x"], limit=3)
    assert load_plan(p.to_python(pretty=True)) == p
    q = table("q", ["x", "n"]).extend({"m": "n * 2"})
    assert (p >> q).columns == ("x", "n", "m")
    a, b = Arrow(p), Arrow(q)
    assert (a >> b).cod() == {"x", "n", "m"}
    assert p.columns_used() == {"d": {"x", "y"}}


def test_coalescing_join(spark):
    d = from_rows(spark, {"x": [7, None, 2, 5], "y": [3, 8, None, 9]}, {"x": "double", "y": "double"})
    e = from_rows(spark, {"qq": [100, 200, 300], "y": [3, 9, 8], "x": [1, 6, 11]}, {"y": "double"})
    got = describe_table(d, "d").natural_join(describe_table(e, "e"), on="y", jointype="LEFT").ex()
    assert rows(got) == sorted([(7.0, 3.0, 100), (11.0, 8.0, 300), (2.0, None, None), (5.0, 9.0, 200)], key=repr)


def test_modulo_and_division(spark):
    d = describe_table(from_rows(spark, {"a": [5, 5, -5, -5, 1], "b": [2, -2, 2, -2, 0]}))
    got = [tuple(r) for r in d.extend({"m": "a % b", "q": "a // b", "f": "a / b"}).select_columns(["m", "q", "f"]).ex().collect()]
    assert got == [(1, 2, 2.5), (-1, -3, -2.5), (1, -3, -2.5), (-1, 2, 2.5), (None, None, math.inf)]


def test_locf_braid_components_replicate(spark):
    d = describe_table(from_rows(spark, {"v": [None, 5, None, 7, None, None], "g": list("ppqqqq"), "o": [1, 2, 3, 4, 5, 6]}, {"v": "double"}))
    got = S.last_observed_carried_forward(d, value_column="v", order_by=["o"], partition_by=["g"]).order_rows(["o"]).select_columns(["v"]).ex()
    assert [r.v for r in got.collect()] == [None, 5, None, 7, 7, 7]
    e = describe_table(from_rows(spark, {"f": [10, 12, 30, 31, 50], "g": [11, 11, 31, 32, 51]}))
    assert [r.c for r in e.extend({"c": connected_components(col("f"), col("g"))}).order_rows(["f", "g"]).ex().collect()] == [10, 10, 30, 30, 50]
    n = describe_table(from_rows(spark, {"key": list("pqr"), "n": [3, 0, 1]}))
    assert S.replicate_rows(n, count_column="n").ex().count() == 4


def test_records_both_ways(spark):
    d = from_rows(spark, {"id": [1, 2], "Sepal.Length": [5.1, 4.9], "Sepal.Width": [3.5, 3.0]})
    shape = RecordSpecification({"Part": ["L", "W"], "Value": ["Sepal.Length", "Sepal.Width"]}, ("id",), ("Part",))
    blocks = shape.map_from_rows().apply(d)
    assert blocks.count() == 4
    assert rows(shape.map_from_rows().inverse().apply(blocks, validate=True)) == rows(d)


def test_empty_and_space(spark):
    d = from_rows(spark, {"g": [], "v": []}, {"g": "string", "v": "bigint"})
    assert rows(describe_table(d).project({"n": "(1).sum()"}).ex()) == [(0,)]
    with SparkSpace(spark) as s:
        s.insert(d, key="d")
        s.execute(concat_all([s.describe("d"), s.describe("d")]), key="e")
        assert s.retrieve("e").count() == 0


MAIN = [n for n in entry.oracle_sql() if not (n.startswith("op") and n[2].isdigit())]


@pytest.mark.parametrize("name", MAIN)
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    show = lambda v: "null" if v is None else f"{v:.8g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(map(show, r)) for r in df.select(*names).collect())
    assert got == sorted(tuple(map(show, r)) for r in c.sql(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})").fetchall())
