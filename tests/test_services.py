"""Handles, spaces, files, streams, schemas, caches, arrows, compositions and the like."""

import bisect
import itertools
import pickle
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkpipe.functions.registry import register_function, unregister_function
from sparkpipe.operators import solutions as S
from sparkpipe.operators.records import RecordMap, RecordSpecification, pivot_blocks_to_rowrecs, pivot_rowrecs_to_blocks, pivot_specification, unpivot_specification
from sparkpipe.plans.arrow import Arrow, fmt_as_arrow, identity
from sparkpipe.plans.expr import call, col
from sparkpipe.plans.loader import load_plan
from sparkpipe.plans.nodes import describe_table, table
from sparkpipe.plans.schema_check import check_schema, mock_schema, non_null_types, problems, schema_checks
from sparkpipe.plans.sql import SqlFormat
from sparkpipe.sources.frames import from_pandas, from_rows, read_file, write_file
from sparkpipe.sources.result_cache import ResultCache, frame_digest
from sparkpipe.sources.scratch import stored
from sparkpipe.sources.space import SparkHandle, SparkSpace
from sparkpipe.streaming import apply_stream, streamable


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def frame(spark):
    return from_rows(spark, {"k": ["a", "b", "b", None], "v": [1, 2, 3, 4]})


def test_handle(spark, frame, tmp_path):
    with SparkHandle(spark) as h:
        d = h.insert_table(frame, "handle_rows")
        assert h.table_exists("handle_rows") and d.columns == ("k", "v") and h.read_table("handle_rows").count() == 4
        with pytest.raises(ValueError):
            h.insert_table(frame, "handle_rows")
        plan = h.describe_table("handle_rows").project({"s": "v.sum()"}, group_by=["k"])
        assert rows(h.read_query(plan)) == rows(h.read_query(h.to_sql(plan))) == [("a", 1), ("b", 5), (None, 4)]
        h.create_table(plan, "handle_sums")
        assert rows(h.execute("SELECT * FROM handle_sums")) == rows(h.read_query(plan))
        h.query_to_csv(plan, str(tmp_path / "sums"))
        assert rows(read_file(spark, str(tmp_path / "sums"), "csv")) == rows(h.read_query(plan))
        for name in ("handle_rows", "handle_sums"):
            h.drop_table(name)
        with pytest.raises(ValueError):
            h.drop_table("handle_rows", must_exist=True)


def test_space(spark, frame):
    with SparkSpace(spark) as s:
        d = s.insert(frame, key="d")
        out = s.execute(d.select_rows("v > 1"), key="big")
        assert s.keys() == ["d", "big"] and s.retrieve("big").count() == 3 and out.columns == ("k", "v")
        assert s.execute(s.describe("big").project({"n": "_size()"})).columns == ("n",)
        with pytest.raises(ValueError):
            s.insert(frame, key="d", allow_overwrite=False)
    assert s.keys() == []


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_files(spark, frame, tmp_path, fmt):
    write_file(frame, str(tmp_path / fmt), fmt)
    assert rows(read_file(spark, str(tmp_path / fmt), fmt).select("k", "v")) == rows(frame)
    with pytest.raises(ValueError):
        read_file(spark, str(tmp_path), "avro?")


def test_streams(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "in"))
    names = from_rows(spark, {"k": ["a", "b"], "name": ["A", "B"]})
    left = table("s", ["k", "v"])
    plan = left.extend({"w": "v * 2"}).select_rows("v > 1").natural_join(table("names", ["k", "name"]), on="k", jointype="LEFT")
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    out = apply_stream(plan, stream, names=names)
    query = out.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("streamed").select("k", "v", "w", "name")) == [("b", 2, 4, "B"), ("b", 3, 6, "B"), (None, 4, 8, None)]
    other = table("names", ["k", "name"])
    for kind, ok in (("INNER", True), ("LEFT", True), ("RIGHT", False), ("FULL", False), ("OUTER", False)):
        assert streamable(left.natural_join(other, on="k", jointype=kind), ("names",)) is ok
    assert streamable(other.natural_join(left, on="k", jointype="RIGHT"), ("names",)) and not streamable(other.natural_join(left, on="k", jointype="LEFT"), ("names",))
    assert streamable(left.natural_join(other.project({"n": "_size()"}, group_by=["k"]), on="k"), ("names",))
    assert streamable(left.natural_join(other, on=(), jointype="CROSS"), ("names",)) and not streamable(left.natural_join(other, on="k", jointype="LEFT"))
    for p in (left.project({"n": "_size()"}), left.order_rows(["v"], limit=1), left.extend({"n": "_row_number()"}, order_by=["v"]), left.natural_join(other, on="k", jointype="FULL")):
        with pytest.raises(ValueError):
            apply_stream(p, stream, **({"names": names} if "names" in p.tables() else {}))


def test_schema_checks(spark, frame):
    @check_schema({"d": {"k": "string", "v": {"bigint", "int"}}, "n": int}, returns={"k": "string"})
    def pick(d, n=1):
        return d.select("k") if n else d.select("v")

    assert pick(frame).columns == ["k"] and pick.schema[1] == {"k": "string"}
    for bad in (lambda: pick(frame.drop("v")), lambda: pick(frame, n="x"), lambda: pick(frame, n=0), lambda: pick(3)):
        with pytest.raises(TypeError):
            bad()
    schema_checks(False)
    try:
        assert pick(frame, n=0).columns == ["v"]
    finally:
        schema_checks(True)
    local = pd.DataFrame({"a": [1.5, None, float("nan")], "b": ["x", None, "y"], "c": [None, None, None], "d": [1, "x", 2]})
    assert non_null_types(local) == {"a": {float}, "b": {str}, "c": None, "d": {int, str}}
    assert problems(local, {"a": float, "b": {str, int}, "c": int, "d": None}) == []
    assert len(problems(local, {"a": int, "d": int, "e": None})) == 3 and problems(7, {}) == ["int is no table"]
    f = lambda d: d
    assert mock_schema({"d": {"k": "string"}}, {"z": "int"})(f) is f
    assert [tuple(r) for r in from_pandas(spark, local[["a", "b"]]).collect()] == [(1.5, "x"), (None, None), (None, "y")]


def test_result_cache(spark, frame, tmp_path):
    calls = []
    register_function("seen", lambda c: calls.append(1) or c)
    try:
        plan = table("d", ["k", "v"]).extend({"w": call("seen", col("v"))})
        cache = ResultCache(spark, str(tmp_path / "cache"))
        with pytest.raises(KeyError):
            cache.get(plan, {"d": frame})
        first = cache.evaluate(plan, {"d": frame})
        ran = len(calls)
        assert cache.dirty and rows(cache.evaluate(plan, {"d": frame.orderBy("v")})) == rows(first) and len(calls) == ran
        assert rows(cache.evaluate(plan, {"d": frame.where("v < 3")})) != rows(first) and len(cache.results) == 2
        cache.dirty = False
        cache.store(plan, frame.withColumn("w", F.col("v")), {"d": frame})
        assert not cache.dirty
    finally:
        unregister_function("seen")
    assert frame_digest(frame) == frame_digest(frame.repartition(3)) != frame_digest(frame.union(frame))
    assert frame_digest(frame) != frame_digest(frame.withColumnRenamed("v", "x"))


def test_sql_text(spark, frame):
    frame.createOrReplaceTempView("text_rows")
    d = describe_table(frame, "text_rows")
    shared = d.extend({"w": "v + 1"})
    plan = shared.natural_join(shared.project({"s": "w.sum()"}, group_by=["k"]), on="k", jointype="LEFT").order_rows(["v"], limit=3)
    text = plan.to_sql()
    assert text.count("v`") > 1 and text.count(" AS (") == len(plan.nodes()) - 1 and "-- " in text
    nested = plan.to_sql(options=SqlFormat(use_with=False, annotate=False, initial_commas=True, indent=4))
    assert "WITH" not in nested and "--" not in nested and "\n    , " in nested
    assert rows(spark.sql(text)) == rows(spark.sql(nested)) == rows(plan.ex()) == rows(spark.sql(plan.to_sql(options=SqlFormat(shared_once=False))))
    odd = describe_table(from_rows(spark, {"a b": ["it's", 'a "\\ `q`\n', None], "c`d": [1, 2, 3]}), "odd_rows")
    odd.frame.createOrReplaceTempView("odd_rows")
    quoted = odd.select_rows(call("==", col("a b"), 'a "\\ `q`\n')).rename_columns({"x y": "c`d"})
    assert rows(spark.sql(quoted.to_sql())) == rows(quoted.ex()) == [('a "\\ `q`\n', 2)]
    register_function("twice", lambda c: c * 2, sql="({0} * 2)")
    register_function("total", lambda c: F.sum(c), context="p")
    try:
        own = d.extend({"t": call("twice", col("v"))})
        with pytest.warns(UserWarning):
            assert rows(spark.sql(own.to_sql())) == rows(own.ex())
        agg = d.project({"t": call("total", col("v"))}, group_by=["k"])
        assert rows(agg.ex()) == [("a", 1), ("b", 5), (None, 4)]
        with pytest.raises(ValueError), pytest.warns(UserWarning):
            agg.to_sql()
        as_told = SqlFormat(templates={"total": "sum({0})", "exp": "pow(2, {0})"}, warn_on_user_functions=False)
        assert rows(spark.sql(agg.to_sql(options=as_told))) == rows(agg.ex())
        assert [r.e for r in spark.sql(d.extend({"e": "v.exp()"}).order_rows(["v"]).to_sql(options=as_told)).collect()] == [2, 4, 8, 16]
    finally:
        unregister_function("twice")
        unregister_function("total")
    with pytest.raises(ValueError):
        d.extend({"c": call("connected_components", col("v"), col("v"))}).to_sql()


def test_replicate_rows(spark):
    d = describe_table(from_rows(spark, {"k": ["a", "b", "c", "d"], "n": [2, 0, None, -1]}), "rep_rows")
    d.frame.createOrReplaceTempView("rep_rows")
    plan = S.replicate_rows(d, count_column="n", seq_column="i").extend({"j": "i + 1"})
    assert rows(plan.ex()) == rows(spark.sql(plan.to_sql())) == [("a", 2, 0, 1), ("a", 2, 1, 2)]
    assert load_plan(plan.to_python()) == plan and plan.columns_used() == {"rep_rows": {"k", "n"}}
    for bad in (lambda: d.replicate_rows("x"), lambda: d.replicate_rows("n", seq_column="k")):
        with pytest.raises(ValueError):
            bad()


def test_xicor_repetitions(spark):
    d = describe_table(from_rows(spark, {"i": list(range(30)), "x": [i // 3 for i in range(30)], "u": list(range(30)), "y": [(i * 7) % 30 for i in range(30)]}))
    once = {r["variable"]: r.xicor for r in S.xicor_score_variables(d, x_vars=["x", "u"], y="y", row_key="i").ex().collect()}
    many = {r["variable"]: r for r in S.xicor_score_variables(d, x_vars=["x", "u"], y="y", row_key="i", repetitions=12).ex().collect()}
    assert many["u"].xicor_mean == pytest.approx(once["u"]) and many["u"].xicor_std == pytest.approx(0)  # no ties, no chance
    assert many["x"].xicor_std > 0 and abs(many["x"].xicor_mean) <= 1


def test_components_run_in_small_tasks(spark, monkeypatch):
    """Whatever the session's sizes; they are as before when it is done."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"]
    before, seen = [spark.conf.get(k) for k in keys], []
    monkeypatch.setattr("sparkpipe.operators.components.stored", lambda df, name: (seen.append([spark.conf.get(k) for k in keys]), stored(df, name))[1])
    monkeypatch.setattr("sparkpipe.sources.scratch.TASK_ROWS", 10, raising=False)
    d = describe_table(spark.range(90).select(F.col("id").alias("f"), (F.col("id") - F.col("id") % 30).alias("g")))
    assert {(r.f, r.c) for r in d.extend({"c": call("connected_components", col("f"), col("g"))}).ex().collect()} == {(i, i - i % 30) for i in range(90)}
    assert seen[0] == ["8m", "8m", before[2]] and set(map(tuple, seen[1:])) == {("8m", "8m", "9")}
    assert [spark.conf.get(k) for k in keys] == before


def test_xicor_of_a_large_group_is_many_tasks(spark):
    """No window holds a group, and null is a group as others are; against plain Python."""
    n = 3000
    data = {"i": list(range(n)), "g": [None if i % 3 else "a" for i in range(n)], "x": [i * 31 % 50 for i in range(n)], "y": [i * 17 % 40 / 4 for i in range(n)]}
    out = S.xicor(describe_table(from_rows(spark, data)), x="x", y="y", group_by=["g"], tie_break=["i"]).ex()
    assert "windowspecdefinition(g#" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for g in (None, "a"):
        own = sorted((x, i, y) for i, h, x, y in zip(*data.values(), strict=True) if h == g)
        ys = sorted(y for _, _, y in own)
        r, m = [bisect.bisect_right(ys, y) for _, _, y in own], len(own)
        left = [m - bisect.bisect_left(ys, y) for _, _, y in own]
        want[g] = 1 - m * sum(abs(a - b) for a, b in itertools.pairwise(r)) / (2 * sum(k * (m - k) for k in left))
    assert {r.g: r.xicor for r in out.collect()} == pytest.approx(want)


def test_shifts_and_sums_across_many_ranges(spark):
    """As by one window, with steps that reach over ranges, ties, nulls and a column without a type."""
    n = 400
    frame = spark.range(n, numPartitions=5).select("id", (F.col("id") * 7 % n).alias("o"), F.when(F.col("id") % 5 > 0, F.col("id") % 9).alias("v"), F.lit(None).alias("void"))
    ops = {"a": "v.shift()", "b": "v.shift(-1)", "c": "v.shift(150)", "d": "id.shift(-399)", "e": "v.shift(1000)", "s": "v.cumsum()", "w": "void.shift()"}
    for down in ([], ["o"]):
        plan = describe_table(frame, "numbers").extend(ops, order_by=["o"], reverse=down)
        frame.createOrReplaceTempView("numbers")
        assert rows(plan.ex()) == rows(spark.sql(plan.to_sql()))
        assert not re.search(r"windowspecdefinition\(o#", plan.drop_columns(["w"]).ex()._jdf.queryExecution().optimizedPlan().toString())
    most = describe_table(from_rows(spark, {"i": [1, 2, 3], "v": [2**63 - 1, 1, None]})).extend({"s": "v.cumsum()"}, order_by=["i"])
    assert [r.s for r in most.order_rows(["i"]).ex().collect()] == [2**63 - 1, None, None]


def test_ranks_of_a_whole_table(spark):
    values = [3, None, 1, 3, 2, 2, 2, 9]
    d = describe_table(from_rows(spark, {"i": list(range(8)), "v": values, "_place": list(range(8)), "_part": list(range(8))}))
    plan = d.extend({"r": "v.rank()", "n": "_size()"}, partition_by=1)
    known = sorted(v for v in values if v is not None)
    want = {i: None if v is None else known.index(v) + (known.count(v) + 1) / 2 for i, v in enumerate(values)}
    got = plan.ex().collect()
    assert {x.i: x.r for x in got} == want and {x.n for x in got} == {8} and got[0]._place is not None
    numbered = d.extend({"a": "_row_number()", "c": "i.cumcount()", "s": "i.cumsum()"}, order_by=["i"], reverse=["i"]).ex().collect()
    assert {x.i: (x.a, x.c) for x in numbered} == {i: (8 - i, 7 - i) for i in range(8)} and {x.i: x.s for x in numbered}[0] == 28


def test_numbers_across_many_ranges(spark):
    """More rows than a sample of the ranges holds, odd names, a column without a type."""
    n = 60_000
    frame = spark.range(n, numPartitions=7).select((F.col("id") * 7919 % n).alias("a b"), F.lit(None).alias("c.d"), (F.col("id") % 1000).alias("v"))
    plan = describe_table(frame).extend({"r": "_row_number()"}, order_by=["a b"]).extend({"k": "v.rank()"}, partition_by=1).extend({"g": "_ngroup()"}, partition_by=["v"])
    out = plan.ex()
    assert out.where((F.col("r") != F.col("`a b`") + 1) | (F.col("k") != F.col("v") * 60 + 30.5) | (F.col("g") != F.col("v"))).count() == 0 and out.count() == n


def test_names_that_clash(spark):
    d = describe_table(from_rows(spark, {"_r0": [1, 2], "_0": [3, 4], "_k0": [5, 5], "_n": [6, 7], "_row": [8, 9], "_node": [1, 2], "_label": [2, 3]}))
    assert d.natural_join(d, on="_r0").ex().count() == 2 and d.extend({"s": "_0.sum()"}, partition_by=1).ex().collect()[0].s == 7
    assert sorted(r.g for r in d.extend({"g": "_ngroup()"}, partition_by=["_k0"]).ex().collect()) == [0, 0]
    assert {r.c for r in d.extend({"c": call("connected_components", col("_node"), col("_label"))}).ex().collect()} == {1}
    shape = RecordSpecification({"c": ["_0", "_n"], "value": ["_0", "_n"]}, ("_row",), ("c",))
    assert d.convert_records(shape.map_from_rows()).ex().count() == 4


def test_composition_and_arrows(spark, frame):
    a = table("d", ["k", "v"]).extend({"w": "v + 1"})
    b = table("e", ["k", "v", "w"]).project({"s": "w.sum()"}, group_by=["k"])
    both = a >> b
    assert rows(both.transform(frame)) == rows(b.transform(a.transform(frame))) == rows(frame >> a >> b) and both == b(a) == b.act_on({"e": a})
    assert rows(Arrow(b).act_on(Arrow(a)).act_on(frame)) == rows(both.transform(frame)) and (Arrow(a) >> Arrow(b)).dom() == {"k", "v"} and Arrow(b).cod() == {"k", "s"}
    assert identity(["k", "v"]).act_on(identity(["k", "v"])) == identity(["k", "v"]) and Arrow(a).required_columns() == {"k", "v"} and Arrow(a).get_feature_names() == ["k", "v", "w"]
    with pytest.raises(ValueError):
        Arrow(a).act_on(Arrow(b))
    with pytest.raises(ValueError):
        b.act_on(table("d", ["k"]))
    text = fmt_as_arrow(a)
    assert text.startswith("[ 'k', 'v'\n") and text.endswith("'k', 'v', 'w' ]") and ".extend(" in text
    assert pickle.loads(pickle.dumps(both)) == both and load_plan(both.to_python(pretty=True)) == both
    assert a.use(lambda p, name: p.drop_columns([name]), "w").columns == ("k", "v") and both.methods_used() == {("+", "e"), ("sum", "p")}
    with pytest.raises(ValueError):
        a.transform(frame.select("k"))
    with pytest.raises(ValueError):
        a.evaluate({"d": frame.withColumn("x", F.lit(1))}, strict=True)
    with pytest.raises(ValueError):
        a.natural_join(a, on=["k"], check_all_common_keys_in_equi_spec=True)
    with pytest.raises(ValueError):
        a.natural_join(table("f", ["z"]), on=[], jointype="INNER")
    for bad in ("v.first()", "v.last()"):
        with pytest.raises(ValueError):
            a.project({"x": bad})


def test_record_maps_compose(spark):
    wide = from_rows(spark, {"i": [1, 2], "a": [10, 20], "b": [1, 2]})
    down = unpivot_specification(row_keys=["i"], col_name_key="key", col_value_key="value", value_cols=["a", "b"])
    up = pivot_specification(row_keys=["i"], col_name_key="key", col_value_key="value", value_cols=["a", "b"])
    long = down.apply(wide)
    assert rows(long) == [(1, "a", 10), (1, "b", 1), (2, "a", 20), (2, "b", 2)] and rows(up.apply(long)) == rows(wide) and up == down.inverse()
    assert pivot_blocks_to_rowrecs(attribute_key_column="key", attribute_value_column="value", record_keys=["i"], record_value_columns=["a", "b"]) == up
    assert pivot_rowrecs_to_blocks(attribute_key_column="key", attribute_value_column="value", record_keys=["i"], record_value_columns=["a", "b"]) == down
    shape = RecordSpecification({"part": ["x", "y"], "v": ["a", "b"]}, ("i",), ("part",))
    both = RecordMap(blocks_in=down.blocks_out, blocks_out=shape)
    direct = both.compose(down)
    assert rows(direct.apply(wide)) == rows(both.apply(long)) == [(1, "x", 10), (1, "y", 1), (2, "x", 20), (2, "y", 2)]
    with pytest.raises(ValueError):
        up.apply(long.union(long), validate=True)
    with pytest.raises(ValueError):
        down.compose(down)
    assert down.example_input() == {"i": ["i"], "a": ["a"], "b": ["b"]} and both.as_pipeline("t").columns == ("i", "part", "v")
