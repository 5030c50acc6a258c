"""The query catalogue over the driver's tables: plans, and the SQL that DuckDB holds them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.registry import functions, register_function
from .operators import solutions as S
from .operators.records import RecordMap, RecordSpecification, pivot_specification, unpivot_specification
from .plans.expr import Lit, call, col, connected_components
from .plans.nodes import Plan, describe_table, sql_table, table
from .plans.schema_check import check_schema
from .plans.sql import SqlFormat
from .sources.frames import FORMATS, read_file, write_file
from .sources.result_cache import ResultCache
from .sources.scratch import new_path
from .sources.space import SparkHandle, SparkSpace
from .streaming import apply_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: What builds each query, a plan in most cases.
PLANS: dict[str, Callable] = {}


#: The rest of a WITH RECURSIVE over the edges e (u, v): cc has the smallest node that each node reaches.
_CC = """b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), cc(id, label) USING KEY (id) AS (SELECT DISTINCT u, u FROM b
  UNION SELECT b.v, min(c.label) FROM cc c JOIN b ON b.u = c.id JOIN recurring.cc r ON r.id = b.v WHERE c.label < r.label GROUP BY b.v)"""


class _Tables(dict):
    """Leaves for the tables of a folder, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> Plan:
        if name not in self:
            self[name] = describe_table(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"), name=name)
        return self[name]


def _q(name: str, build: Callable[[_Tables], Plan | DataFrame], sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build(_Tables(spark, sf_dir))
        return out.ex() if isinstance(out, Plan) else out

    QUERIES[name], PLANS[name] = run, build
    if sql is not None:
        ORACLES[name] = sql


def pricing_summary(t: _Tables) -> Plan:
    return (
        t.lineitem.select_rows("l_quantity < 40").extend({"rev": "l_extendedprice * (1 - l_discount)"})
        .project({"sum_rev": "rev.sum()", "avg_qty": "l_quantity.mean()", "n": "(1).sum()"}, group_by=["l_returnflag", "l_linestatus"])
        .extend({"sum_rev": "sum_rev.around(2)", "avg_qty": "avg_qty.around(6)"}).order_rows(["l_returnflag", "l_linestatus"])
    )


_q("pricing_summary", pricing_summary, """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_rev, round(avg(l_quantity), 6) AS avg_qty,
  CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity < 40 GROUP BY 1, 2""")
_q(
    "scoring_topk",
    lambda t: t.events.project({"total": "value.sum()"}, group_by=["user_id", "event_type"]).extend({"weight": "(total / 500).exp()"})
    .extend({"sum_weight": "weight.sum()"}, partition_by=["user_id"]).extend({"p": "(weight / sum_weight).around(6)"})
    .extend({"place": "_row_number()"}, partition_by=["user_id"], order_by=["p", "event_type"], reverse=["p"]).select_rows("place <= 2").select_columns(["user_id", "event_type", "p", "place"]),
    """WITH a AS (SELECT user_id, event_type, exp(sum(value) / 500) AS w FROM events GROUP BY 1, 2), b AS (SELECT *, round(w / sum(w) OVER (PARTITION BY user_id), 6) AS p FROM a),
  c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_type) AS place FROM b) SELECT user_id, event_type, p, place FROM c WHERE place <= 2""",
)
# columns
_q("select_columns", lambda t: t.nation.select_columns(["n_name", "n_nationkey"]), "SELECT n_name, n_nationkey FROM nation")
_q("drop_columns", lambda t: t.nation.drop_columns(["n_name"]), "SELECT n_nationkey, n_regionkey FROM nation")
_q("rename_swap", lambda t: t.nation.rename_columns({"n_regionkey": "n_nationkey", "n_nationkey": "n_regionkey"}), "SELECT n_nationkey AS n_regionkey, n_name, n_regionkey AS n_nationkey FROM nation")
_q("map_columns_delete", lambda t: t.part.map_columns({"p_name": "title", "p_type": None, "p_brand": None}), "SELECT p_partkey, p_name AS title, p_size, p_retailprice FROM part")
_q("select_stack", lambda t: t.part.drop_columns(["p_type"]).select_columns(["p_partkey", "p_size", "p_name"]).select_columns(["p_size", "p_partkey"]), "SELECT p_size, p_partkey FROM part")
# rows
_q("filter_and", lambda t: t.orders.select_rows("o_totalprice > 1000 and o_orderstatus == 'O'"), "SELECT * FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'O'")
_q("filter_list", lambda t: t.orders.select_rows(["o_totalprice > 1000", "o_custkey < 100"]), "SELECT * FROM orders WHERE o_totalprice > 1000 AND o_custkey < 100")
_q("filter_or_not", lambda t: t.orders.select_rows("o_orderstatus == 'F' or not (o_custkey >= 50)"), "SELECT * FROM orders WHERE o_orderstatus = 'F' OR NOT o_custkey >= 50")
_q("filter_is_in", lambda t: t.orders.select_rows("o_orderstatus.is_in(['F', 'P'])"), "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P')")


def _line(ops: dict, sql: str, name: str, table: str = "lineitem", keys: tuple = ("l_orderkey", "l_linenumber")) -> None:
    _q(name, lambda t: getattr(t, table).extend(ops).select_columns([*keys, *ops]), f"SELECT {', '.join(keys)}, {sql} FROM {table}")


_EV = {"table": "events", "keys": ("event_id",)}
_OR = {"table": "orders", "keys": ("o_orderkey",)}
_line({"a": "l_quantity + l_tax * 2 - 1", "b": "-l_discount", "c": "l_quantity * l_linenumber"}, "l_quantity + l_tax * 2 - 1 AS a, -l_discount AS b, l_quantity * l_linenumber AS c", "arith")
_line({"q": "l_suppkey // l_linenumber", "r": "l_suppkey % l_linenumber", "m": "(-l_partkey).mod(7)", "f": "(-l_quantity) % 3", "z": "l_suppkey % (l_linenumber - 1)"},
      """CAST(floor(l_suppkey / l_linenumber) AS BIGINT) AS q, l_suppkey % l_linenumber AS r, ((-l_partkey % 7) + 7) % 7 AS m,
  -l_quantity - floor(-l_quantity / 3) * 3 AS f, CASE WHEN l_linenumber > 1 THEN l_suppkey % (l_linenumber - 1) END AS z""", "int_divide_mod")  # fmt: skip
_line({"a": "(l_quantity - 25) / (l_linenumber - 2)", "b": "l_suppkey %/% 4"},
      "CASE WHEN l_linenumber <> 2 THEN (l_quantity - 25) / (l_linenumber - 2) WHEN l_quantity > 25 THEN 'inf'::DOUBLE WHEN l_quantity < 25 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS a, l_suppkey / 4 AS b", "float_divide_zero")
_line({"a": "(l_linenumber ** 2)", "b": "(l_quantity ** 0.5).around(8)"}, "CAST(pow(l_linenumber, 2) AS DOUBLE) AS a, round(pow(l_quantity, 0.5), 8) AS b", "power")
_line(
    {f: f"l_tax.{f}().around(10)" for f in "sin cos sinh cosh tanh arcsin arccos arctan arcsinh arctanh".split()} | {"arccosh": "(l_quantity + 1).arccosh().around(10)", "arctan2": "l_tax.arctan2(l_quantity).around(10)"},
    ", ".join(f"round({g}(l_tax), 10) AS {f}" for f, g in {"sin": "sin", "cos": "cos", "sinh": "sinh", "cosh": "cosh", "tanh": "tanh", "arcsin": "asin", "arccos": "acos", "arctan": "atan", "arcsinh": "asinh", "arctanh": "atanh"}.items())
    + ", round(acosh(l_quantity + 1), 10) AS arccosh, round(atan2(l_tax, l_quantity), 10) AS arctan2",
    "math_trig",
)
_line({"e": "l_tax.exp().around(10)", "e1": "l_tax.expm1().around(10)", "l": "l_tax.log()", "l10": "(l_quantity.log10()).around(10)", "l1": "l_tax.log1p().around(10)", "s": "l_quantity.sqrt().around(10)"},
      "round(exp(l_tax), 10) AS e, round(exp(l_tax) - 1, 10) AS e1, CASE WHEN l_tax > 0 THEN ln(l_tax) ELSE '-inf'::DOUBLE END AS l, round(log10(l_quantity), 10) AS l10, round(ln(1 + l_tax), 10) AS l1, round(sqrt(l_quantity), 10) AS s", "math_log")
_line({"r": "(l_quantity / 2).round()", "a": "(l_quantity / 8).around(2)"}, "round_even(l_quantity / 2, 0) AS r, round_even(l_quantity / 8, 2) AS a", "math_round")
_line({"f": "(l_tax - 0.05).floor()", "c": "(l_tax * 10).ceil()", "s": "(l_tax - 0.04).sign()", "a": "(l_tax - 0.05).abs()"},
      "floor(l_tax - 0.05::DOUBLE) AS f, ceil(l_tax * 10) AS c, CAST(sign(l_tax - 0.04::DOUBLE) AS DOUBLE) AS s, abs(l_tax - 0.05::DOUBLE) AS a", "floor_ceil_sign_abs")
_line({"a": "l_tax < l_discount", "b": "l_tax <= l_discount", "c": "l_tax == l_discount", "d": "l_tax != l_discount", "e": "l_tax > l_discount and l_quantity >= 10", "f": "not (l_tax > l_discount) or l_linenumber == 1"},
      "l_tax < l_discount AS a, l_tax <= l_discount AS b, l_tax = l_discount AS c, l_tax <> l_discount AS d, l_tax > l_discount AND l_quantity >= 10 AS e, NOT l_tax > l_discount OR l_linenumber = 1 AS f", "compare_logic")
_q("xor_objects", lambda t: t.lineitem.extend({"x": (col("l_tax") > 0.03) ^ (col("l_discount") > 0.03)}).select_columns(["l_orderkey", "l_linenumber", "x"]),
   "SELECT l_orderkey, l_linenumber, (l_tax > 0.03) <> (l_discount > 0.03) AS x FROM lineitem")


def _gaps(t: _Tables) -> Plan:
    """events with gaps: v is null for views."""
    return t.events.extend({"v": "(event_type == 'view').if_else(None, value)", "w": "(event_type == 'click').if_else(None, value * 2)"})


_GAPS = "(SELECT *, CASE WHEN event_type <> 'view' THEN value END AS v, CASE WHEN event_type <> 'click' THEN value * 2 END AS w FROM events)"


def _gap(name: str, ops: dict, sql: str) -> None:
    _q(name, lambda t: _gaps(t).extend(ops).select_columns(["event_id", *ops]), f"SELECT event_id, {sql} FROM {_GAPS}")


_gap("if_else_where", {"a": "(v > 50).if_else(1, 0)", "b": "(v > 50).where(1, 0)"}, "CAST(CASE WHEN v > 50 THEN 1 WHEN NOT v > 50 THEN 0 END AS BIGINT) AS a, CAST(CASE WHEN v > 50 THEN 1 ELSE 0 END AS BIGINT) AS b")
_gap("maximum_minimum", {"a": "v.maximum(w)", "b": "v.minimum(w)"}, "CASE WHEN v IS NOT NULL AND w IS NOT NULL THEN greatest(v, w) END AS a, CASE WHEN v IS NOT NULL AND w IS NOT NULL THEN least(v, w) END AS b")
_gap("fmax_fmin", {"a": "v.fmax(w)", "b": "v.fmin(w)"}, "greatest(v, w) AS a, least(v, w) AS b")
_gap("coalesce", {"a": "v %?% 0.0", "b": "v.coalesce(w)", "c": "v.coalesce_0()"}, "coalesce(v, 0) AS a, coalesce(v, w) AS b, coalesce(v, 0) AS c")
_gap("null_checks", {"a": "v.is_null()", "b": "v.is_nan()", "c": "(v / 0).is_inf()", "d": "(v / 0).is_bad()"}, "v IS NULL AS a, false AS b, coalesce(v <> 0, false) AS c, true AS d")
_line({"m": "event_type.mapv({'view': 1, 'click': 2}, 0)", "n": "event_type.mapv({'error': 'bad'})"}, "CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS BIGINT) AS m, CASE event_type WHEN 'error' THEN 'bad' END AS n", "mapv", **_EV)
_line({"a": "event_type %+% '_' %+% user_id", "b": "event_type.concat(event_type)"}, "event_type || '_' || user_id AS a, event_type || event_type AS b", "concat_str", **_EV)
_line({"a": "event_type.trimstr(0, 2)", "b": "event_type.trimstr(1, 4)"}, "substr(event_type, 1, 2) AS a, substr(event_type, 2, 3) AS b", "trimstr", **_EV)
_line({"a": "(-value).as_int64()", "b": "user_id.as_str()", "c": "user_id.as_str().as_int64()"}, "CAST(trunc(-value) AS BIGINT) AS a, CAST(user_id AS VARCHAR) AS b, user_id AS c", "casts", **_EV)
_line({"is_in": "user_id.is_in([1, 2, 3])"}, "user_id IN (1, 2, 3) AS is_in", "is_in", **_EV)
# dates
_line(
    {"d": "o_orderdate.datetime_to_date().as_str()", **{f: f"o_orderdate.{f}()" for f in "dayofweek dayofyear dayofmonth month quarter year".split()}},
    "CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, dayofweek(o_orderdate) + 1 AS dayofweek, dayofyear(o_orderdate) AS dayofyear, day(o_orderdate) AS dayofmonth, month(o_orderdate) AS month, quarter(o_orderdate) AS quarter, year(o_orderdate) AS year",
    "date_parts", **_OR,
)
_SUN = "CAST({0} AS DATE) - CAST(dayofweek({0}) AS INTEGER)"
_line({"s": "o_orderdate.base_Sunday().as_str()", "w": "o_orderdate.weekofyear()"},
      f"CAST(CAST({_SUN.format('o_orderdate')} AS DATE) AS VARCHAR) AS s, CAST(greatest(1, floor((CAST(o_orderdate AS DATE) - ({_SUN.format('date_trunc(' + chr(39) + 'year' + chr(39) + ', o_orderdate)')})) / 7)) AS BIGINT) AS w", "week_base_sunday", **_OR)
_q("date_diff", lambda t: t.lineitem.natural_join(t.orders, on=[("l_orderkey", "o_orderkey")]).extend({"days": "l_shipdate.date_diff(o_orderdate)", "secs": "l_shipdate.timestamp_diff(o_orderdate)"}).select_columns(["l_orderkey", "l_linenumber", "days", "secs"]),
   "SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS days, date_diff('microsecond', o_orderdate, l_shipdate) / 1e6 AS secs FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
_q("parse_format", lambda t: t.orders.extend({"s": "o_orderdate.format_date()", "f": "o_orderdate.format_datetime('%d/%m/%Y %H:%M')"}).extend({"d": "s.parse_date().as_str()", "ts": "f.parse_datetime('%d/%m/%Y %H:%M').as_str()", "bad": "f.parse_date().as_str()"}).select_columns(["o_orderkey", "s", "f", "d", "ts", "bad"]),
   "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS s, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS f, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, CAST(date_trunc('minute', o_orderdate) AS VARCHAR) AS ts, CAST(NULL AS VARCHAR) AS bad FROM orders")
# aggregates
_q("agg_basic", lambda t: t.lineitem.project({"s": "l_quantity.sum()", "m": "l_quantity.mean()", "lo": "l_tax.min()", "hi": "l_tax.max()", "c": "l_tax.count()", "n": "_size()", "z": "l_tax.size()"}, group_by=["l_returnflag"]).extend({"m": "m.around(6)"}),
   "SELECT l_returnflag, sum(l_quantity) AS s, round(avg(l_quantity), 6) AS m, min(l_tax) AS lo, max(l_tax) AS hi, count(l_tax) AS c, count(*) AS n, count(*) AS z FROM lineitem GROUP BY 1")
_q("agg_stats", lambda t: t.lineitem.project({"med": "l_quantity.median()", "sd": "l_quantity.std()", "va": "l_quantity.var()"}, group_by=["l_suppkey"]).extend({"sd": "sd.around(6)", "va": "va.around(6)"}),
   "SELECT l_suppkey, median(l_quantity) AS med, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS va FROM lineitem GROUP BY 1")
_q("agg_nunique", lambda t: t.lineitem.project({"n": "l_partkey.nunique()"}, group_by=["l_suppkey"]), "SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
_q("agg_any_all", lambda t: _gaps(t).extend({"b": "v > 5"}).project({"any_v": "b.any()", "all_v": "b.all()"}, group_by=["user_id"]), f"SELECT user_id, bool_or(coalesce(v > 5, false)) AS any_v, bool_and(coalesce(v > 5, false)) AS all_v FROM {_GAPS} GROUP BY 1")
_q("agg_any_value", lambda t: t.orders.project({"p": "o_orderpriority.any_value()"}, group_by=["o_orderkey"]), "SELECT o_orderkey, max(o_orderpriority) AS p FROM orders GROUP BY 1")
_q("agg_global", lambda t: t.orders.project({"n": "(1).sum()", "s": "o_totalprice.sum()"}).extend({"s": "s.around(2)"}), "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS s FROM orders")
_q("agg_empty", lambda t: t.orders.select_rows("o_orderkey < 0").project({"n": "(1).sum()"}), "SELECT CAST(0 AS BIGINT) AS n")
_q("distinct_keys", lambda t: t.lineitem.project(group_by=["l_returnflag", "l_linestatus"]), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
# windows without order


def _win(name: str, ops: dict, sql: str, table: str = "orders", key: str = "o_orderkey", part="o_custkey", order=None, reverse=None, after: dict | None = None) -> None:
    def build(t: _Tables) -> Plan:
        p = (_gaps(t) if table == "events" else getattr(t, table)).extend(ops, partition_by=part, order_by=order, reverse=reverse)
        return p.extend(after or {}).select_columns([key, *ops])

    _q(name, build, f"SELECT {key}, {sql} FROM {_GAPS if table == 'events' else table}")


_W = "OVER (PARTITION BY o_custkey)"
_win("win_sum_mean", {"s": "o_totalprice.sum()", "m": "o_totalprice.mean()"}, f"round(sum(o_totalprice) {_W}, 4) AS s, round(avg(o_totalprice) {_W}, 4) AS m", after={"s": "s.around(4)", "m": "m.around(4)"})
_win("win_min_max_count_size", {"lo": "o_totalprice.min()", "hi": "o_totalprice.max()", "c": "o_orderstatus.count()", "n": "_size()", "k": "_count()", "one": "(1).sum()"},
     f"min(o_totalprice) {_W} AS lo, max(o_totalprice) {_W} AS hi, count(o_orderstatus) {_W} AS c, count(*) {_W} AS n, count(*) {_W} AS k, CAST(sum(1) {_W} AS BIGINT) AS one")
_win("win_std_var_median", {"sd": "o_totalprice.std()", "va": "o_totalprice.var()", "md": "o_totalprice.median()"},
     f"round(stddev_samp(o_totalprice) {_W}, 4) AS sd, round(var_samp(o_totalprice) {_W}, 2) AS va, round(median(o_totalprice) {_W}, 6) AS md", after={"sd": "sd.around(4)", "va": "va.around(2)", "md": "md.around(6)"})
_win("win_nunique", {"n": "o_orderpriority.nunique()"}, f"count(DISTINCT o_orderpriority) {_W} AS n")
_q("win_any_all", lambda t: t.orders.extend({"b": "o_totalprice > 1000"}).extend({"a": "b.any()", "e": "b.all()", "x": "o_orderstatus.any_value()"}, partition_by=["o_custkey"]).select_columns(["o_orderkey", "a", "e", "x"]),
   f"SELECT o_orderkey, bool_or(o_totalprice > 1000) {_W} AS a, bool_and(o_totalprice > 1000) {_W} AS e, max(o_orderstatus) {_W} AS x FROM orders")
_win("win_ngroup", {"g": "_ngroup()"}, "dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS g", part="o_orderpriority")
_win("win_whole_table", {"s": "o_totalprice.sum()", "n": "_size()", "hi": "o_totalprice.max()"}, "round(sum(o_totalprice) OVER (), 2) AS s, count(*) OVER () AS n, max(o_totalprice) OVER () AS hi", part=1, after={"s": "s.around(2)"})
# windows with order
_E = {"table": "events", "key": "event_id", "part": "user_id", "order": ["ts", "event_id"]}
_O = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
_A = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_P = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_win("win_row_number", {"r": "_row_number()", "c": "_count()"}, f"row_number() {_P} AS r, row_number() {_P} AS c", **_E)
_win("win_cumsum", {"s": "v.cumsum()", "n": "(1).cumsum()"}, f"CASE WHEN v IS NOT NULL THEN round(sum(v) {_O}, 4) END AS s, CAST(sum(1) {_O} AS BIGINT) AS n", after={"s": "s.around(4)"}, **_E)
_win("win_cummax_min", {"a": "v.cummax()", "b": "v.cummin()"}, f"CASE WHEN v IS NOT NULL THEN max(v) {_O} END AS a, CASE WHEN v IS NOT NULL THEN min(v) {_O} END AS b", **_E)
_q("win_cumprod", lambda t: t.events.extend({"x": "1 + value / 1000003"}).extend({"p": "x.cumprod()"}, partition_by=["user_id"], order_by=["ts", "event_id"]).extend({"p": "p.around(6)"}).select_columns(["event_id", "p"]),
   f"SELECT event_id, round(product(1 + value / 1000003) {_O}, 6) AS p FROM events")
_win("win_cumcount", {"n": "v.cumcount()"}, f"row_number() {_P} - 1 AS n", **_E)
_win("win_shift", {"a": "v.shift()", "b": "v.shift(-2)"}, f"lag(v) {_P} AS a, lead(v, 2) {_P} AS b", **_E)
_win("win_first_last", {"a": "v.first()", "b": "v.last()"}, f"first_value(v IGNORE NULLS) {_A} AS a, last_value(v IGNORE NULLS) {_A} AS b", **_E)
_win("win_ffill_bfill", {"a": "v.ffill()", "b": "v.bfill()"}, f"last_value(v IGNORE NULLS) {_O} AS a, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b", **_E)
_win("win_rank", {"r": "p_size.rank()"}, "rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS r", table="part", key="p_partkey", part="p_brand")
_win("win_reverse", {"r": "_row_number()"}, "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r", reverse=["ts"], **_E)
_q("win_monotonic", lambda t: t.events.extend({"up": "event_id.is_monotonic_increasing()", "down": "event_id.is_monotonic_decreasing()"}, partition_by=["user_id"], order_by=["ts", "event_id"]).select_columns(["event_id", "up", "down"]),
   f"SELECT event_id, bool_and(u) OVER (PARTITION BY user_id) AS up, bool_and(d) OVER (PARTITION BY user_id) AS down FROM (SELECT event_id, user_id, coalesce(event_id >= lag(event_id) {_P}, true) AS u, coalesce(event_id <= lag(event_id) {_P}, true) AS d FROM events)")
_q("topk_per_group", lambda t: t.orders.extend({"r": "_row_number()"}, partition_by=["o_custkey"], order_by=["o_totalprice", "o_orderkey"], reverse=["o_totalprice"]).select_rows("r <= 3").select_columns(["o_custkey", "o_orderkey", "r"]),
   "SELECT o_custkey, o_orderkey, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
# order
_q("order_limit", lambda t: t.part.order_rows(["p_retailprice", "p_partkey"], reverse=["p_retailprice"], limit=10), "SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
_q("order_multi_reverse", lambda t: t.part.order_rows(["p_size", "p_partkey"], reverse=["p_partkey"], limit=20).select_columns(["p_partkey", "p_size"]), "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey DESC LIMIT 20")
# joins


# joins of all customers, whose sides share three segments of five


def _ab(t: _Tables) -> tuple[Plan, Plan]:
    a = t.customer.select_rows("c_mktsegment != 'BUILDING'").extend({"k": "c_custkey", "bal": "(c_acctbal > 5000).if_else(None, c_acctbal)"}).select_columns(["k", "bal", "c_name"])
    b = t.customer.select_rows("c_mktsegment != 'MACHINERY'").extend({"k": "c_custkey", "bal": "c_acctbal + 1"}).select_columns(["k", "bal", "c_mktsegment"])
    return a, b


_AB = """a AS (SELECT c_custkey AS k, CASE WHEN NOT c_acctbal > 5000 THEN c_acctbal END AS bal, c_name FROM customer WHERE c_mktsegment <> 'BUILDING'),
  b AS (SELECT c_custkey AS k, c_acctbal + 1 AS bal, c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY')"""
for _name, _kind in (("join_inner", "INNER"), ("join_left_coalesce", "LEFT"), ("join_right", "RIGHT"), ("join_full", "FULL"), ("join_outer", "OUTER")):
    _q(_name, lambda t, kind=_kind: (lambda a, b: a.natural_join(b, on="k", jointype=kind))(*_ab(t)),
       f"WITH {_AB} SELECT coalesce(a.k, b.k) AS k, coalesce(a.bal, b.bal) AS bal, c_name, c_mktsegment FROM a {'FULL' if _kind == 'OUTER' else _kind} JOIN b ON a.k = b.k")
_q("join_three_way", lambda t: t.orders.natural_join(t.customer, on={"o_custkey": "c_custkey"}).natural_join(t.nation, on={"c_nationkey": "n_nationkey"}).project({"n": "_size()", "s": "o_totalprice.sum()"}, group_by=["n_name"]).extend({"s": "s.around(2)"}),
   "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
_q("anti_join_idiom", lambda t: t.customer.natural_join(t.orders.select_rows("o_totalprice > 300000").project({"n": "_size()"}, group_by=["o_custkey"]).rename_columns({"c_custkey": "o_custkey"}), on="c_custkey", jointype="LEFT").select_rows("n.is_null()").select_columns(["c_custkey"]),
   "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
# sets


def _people(t: _Tables) -> tuple[Plan, Plan]:
    return t.customer.rename_columns({"key": "c_custkey", "bal": "c_acctbal"}).select_columns(["key", "bal"]), t.supplier.rename_columns({"key": "s_suppkey", "bal": "s_acctbal"}).select_columns(["bal", "key"])


_q("concat_rows_id", lambda t: (lambda a, b: a.concat_rows(b, id_column="who", a_name="c", b_name="s"))(*_people(t)), "SELECT c_custkey AS key, c_acctbal AS bal, 'c' AS who FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 's' FROM supplier")
_q("concat_distinct", lambda t: (lambda a, b: a.concat_rows(b, id_column=None).project(group_by=["key"]))(*_people(t)), "SELECT c_custkey AS key FROM customer UNION SELECT s_suppkey FROM supplier")
# records
_MEASURES = ["p_retailprice", "half", "size"]
_LONG = RecordSpecification({"measure": _MEASURES, "value": _MEASURES}, ("p_partkey",), ("measure",))
_SIZED = "(SELECT p_partkey, p_retailprice, p_retailprice / 2 AS half, p_size * 1.0::DOUBLE AS size FROM part)"


def _sized(t: _Tables) -> Plan:
    return t.part.extend({"half": "p_retailprice / 2", "size": "p_size * 1.0"}).select_columns(["p_partkey", *_MEASURES])


_q("unpivot", lambda t: _sized(t).convert_records(_LONG.map_from_rows()), " UNION ALL ".join(f"SELECT p_partkey, '{m}' AS measure, {m} AS value FROM {_SIZED}" for m in _MEASURES))
_q("pivot", lambda t: _sized(t).convert_records(_LONG.map_from_rows()).convert_records(_LONG.map_to_rows()), f"SELECT * FROM {_SIZED}")
_q("block_to_block", lambda t: _sized(t).convert_records(_LONG.map_from_rows()).convert_records(
    RecordMap(blocks_in=_LONG, blocks_out=RecordSpecification({"kind": ["price", "other"], "x": ["p_retailprice", "size"], "y": ["half", "size"]}, ("p_partkey",), ("kind",), strict=False))),
   f"SELECT p_partkey, 'price' AS kind, p_retailprice AS x, half AS y FROM {_SIZED} UNION ALL SELECT p_partkey, 'other', size, size FROM {_SIZED}")
_q("multi_value_pivot", lambda t: t.orders.project({"n": "_size()", "hi": "o_totalprice.max()"}, group_by=["o_custkey", "o_orderstatus"]).convert_records(
    RecordSpecification({"o_orderstatus": ["F", "O", "P"], "n": ["n_F", "n_O", "n_P"], "hi": ["hi_F", "hi_O", "hi_P"]}, ("o_custkey",), ("o_orderstatus",)).map_to_rows()),
   "SELECT o_custkey, " + ", ".join(f"CASE WHEN count(*) FILTER (WHERE o_orderstatus = '{s}') > 0 THEN count(*) FILTER (WHERE o_orderstatus = '{s}') END AS n_{s}, max(o_totalprice) FILTER (WHERE o_orderstatus = '{s}') AS hi_{s}" for s in "FOP") + " FROM orders GROUP BY 1")
# solutions
_q("locf", lambda t: S.last_observed_carried_forward(_gaps(t), value_column="v", order_by=["ts", "event_id"], partition_by=["user_id"]).select_columns(["event_id", "v"]), f"SELECT event_id, last_value(v IGNORE NULLS) {_O} AS v FROM {_GAPS}")


def _braid(t: _Tables) -> Plan:
    state = t.events.select_rows("event_type == 'signup'").extend({"moment": "event_id", "state": "value"}).select_columns(["user_id", "moment", "state"])
    event = t.events.select_rows("event_type == 'purchase'").extend({"moment": "event_id", "amount": "value"}).select_columns(["user_id", "moment", "amount"])
    return S.braid(state, event, order_by="moment", partition_by=["user_id"], state_columns=["state"], event_columns=["amount"], types={"state": "number", "amount": "number"})


_q("braid", _braid, """WITH u AS (SELECT user_id, event_id AS moment, value AS state, CAST(NULL AS DOUBLE) AS amount, 'state' AS record_type, 0 AS o FROM events WHERE event_type = 'signup'
  UNION ALL SELECT user_id, event_id, NULL, value, 'event', 1 FROM events WHERE event_type = 'purchase')
  SELECT user_id, moment, last_value(state IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY moment, o ROWS UNBOUNDED PRECEDING) AS state, amount, record_type FROM u""")
_q("rank_to_average", lambda t: S.rank_to_average(t.part, rank_column="r", value_column="p_retailprice", partition_by=["p_brand"]).select_columns(["p_partkey", "r"]),
   "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS r FROM part")
_q("replicate_rows", lambda t: S.replicate_rows(t.lineitem.extend({"n": "l_linenumber - 1"}).select_columns(["l_orderkey", "l_linenumber", "n"]), count_column="n"),
   "SELECT l_orderkey, l_linenumber, CAST(l_linenumber - 1 AS BIGINT) AS n, unnest(range(l_linenumber - 1)) AS seq FROM lineitem")


def _multi_map(t: _Tables) -> Plan:
    status = t.orders.project({"mapped_value": "(1).sum()"}, group_by=["o_orderstatus"]).extend({"column_name": "'o_orderstatus'"}).rename_columns({"column_value": "o_orderstatus"})
    priority = t.orders.project({"mapped_value": "(1).sum()"}, group_by=["o_orderpriority"]).extend({"column_name": "'o_orderpriority'"}).rename_columns({"column_value": "o_orderpriority"}).select_rows("column_value != '1-URGENT'")
    return S.multi_column_map(t.orders, status.concat_rows(priority, id_column=None), row_keys=["o_orderkey"], columns=["o_orderstatus", "o_orderpriority"], default=0)


_q("multi_column_map", _multi_map, """SELECT o_orderkey, s.n AS o_orderstatus, CASE WHEN o.o_orderpriority = '1-URGENT' THEN 0 ELSE p.n END AS o_orderpriority FROM orders o
  JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) s ON s.o_orderstatus = o.o_orderstatus JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) p ON p.o_orderpriority = o.o_orderpriority""")
_XI = """SELECT {g} round(1 - max(n) * sum(coalesce(abs(r - before), 0)) / (2 * sum(l * (n - l))), 8) AS xicor FROM (
  SELECT *, lag(r) OVER ({p} ORDER BY x, tie) AS before FROM (
  SELECT *, CAST(count(*) OVER ({p} ORDER BY y) AS DOUBLE) AS r, CAST(count(*) OVER ({p} ORDER BY y DESC) AS DOUBLE) AS l, count(*) OVER ({p}) AS n FROM ({s}))) {e}"""
_q("xicor", lambda t: S.xicor(t.part, x="p_size", y="p_retailprice", group_by=["p_brand"], tie_break=["p_partkey"]).extend({"xicor": "xicor.around(8)"}),
   _XI.format(g="p_brand,", p="PARTITION BY p_brand", s="SELECT p_brand, p_size AS x, p_retailprice AS y, p_partkey AS tie FROM part", e="GROUP BY p_brand"))
_q("xicor_variables", lambda t: S.xicor_score_variables(_sized(t), x_vars=["half", "size"], y="p_retailprice", row_key="p_partkey").extend({"xicor": "xicor.around(8)"}),
   _XI.format(g="variable,", p="PARTITION BY variable", s=f"SELECT 'half' AS variable, half AS x, p_retailprice AS y, p_partkey AS tie FROM {_SIZED} UNION ALL SELECT 'size', size, p_retailprice, p_partkey FROM {_SIZED}", e="GROUP BY variable"))


def _user(t: _Tables) -> Plan:
    if "shout" not in functions():
        register_function("shout", lambda c: F.upper(c))
    return t.nation.extend({"loud": "n_name.shout()"}).select_columns(["n_nationkey", "loud"])


_q("user_function", _user, "SELECT n_nationkey, upper(n_name) AS loud FROM nation")


def _sql(t: _Tables) -> DataFrame:
    t.nation.frame.createOrReplaceTempView("sparkpipe_nation")
    return sql_table("SELECT n_regionkey, count(*) AS n FROM sparkpipe_nation GROUP BY 1", ["n_regionkey", "n"]).select_rows("n > 4").ex()


_q("sql_node", _sql, "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) > 4")
_q("connected_components", lambda t: t.lineitem.extend({"f": "l_suppkey", "g": "l_partkey + 1000000"}).extend({"c": connected_components(col("f"), col("g"))}).select_columns(["l_orderkey", "l_linenumber", "c"]),
   f"""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS u, l_partkey + 1000000 AS v FROM lineitem), {_CC}
  SELECT l_orderkey, l_linenumber, label AS c FROM lineitem JOIN cc ON id = l_suppkey""")  # fmt: skip
_q("connected_components_many", lambda t: t.orders.extend({"f": "o_custkey", "g": "o_orderkey + 1000000000"}).extend({"c": connected_components(col("f"), col("g"))}).select_columns(["o_orderkey", "c"]),
   f"""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS u, o_orderkey + 1000000000 AS v FROM orders), {_CC} SELECT o_orderkey, label AS c FROM orders JOIN cc ON id = o_custkey""")
_q("co_equalizer", lambda t: t.orders.extend({"f": "o_custkey", "g": "o_orderkey + 1000000000"}).extend({"c": call("co_equalizer", col("f"), col("g"))}).project({"n": "(1).sum()"}, group_by=["c"]),
   "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1")
_q("overflow", lambda t: t.lineitem.extend({"big": "l_orderkey * 1000000000000000", "k": "l_linenumber"}).extend({"p": "big * big", "s": "big + 9223372036854775800", "d": "-9223372036854775800 - big", "n": "-l_linenumber", "q": "big // 7"})
   .select_columns(["l_orderkey", "k", "p", "s", "d", "n", "q"]),
   """WITH b AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS k, CAST(l_orderkey AS HUGEINT) * 1000000000000000 AS h FROM lineitem), c AS (SELECT *, TRY_CAST(h AS BIGINT) AS big FROM b)
  SELECT l_orderkey, k, CASE WHEN l_orderkey = 0 THEN CAST(0 AS BIGINT) END AS p, TRY_CAST(CAST(big AS HUGEINT) + 9223372036854775800 AS BIGINT) AS s, TRY_CAST(-9223372036854775800 - CAST(big AS HUGEINT) AS BIGINT) AS d,
  -k AS n, big // 7 AS q FROM c""")  # fmt: skip
_q("bad_dates", lambda t: t.orders.extend({"d": "(o_orderkey % 3 == 0).if_else('no date', '1995-02-27')"}).extend({"w": "d.dayofweek()", "y": "d.year()", "day": "d.datetime_to_date()", "k": "date_diff(d, '1995-02-25')", "p": "d.parse_date()"})
   .select_columns(["o_orderkey", "w", "y", "day", "k", "p"]),
   """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(2 AS BIGINT) END AS w, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(1995 AS BIGINT) END AS y,
  CASE WHEN o_orderkey % 3 <> 0 THEN DATE '1995-02-27' END AS day, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(2 AS BIGINT) END AS k, CASE WHEN o_orderkey % 3 <> 0 THEN DATE '1995-02-27' END AS p FROM orders""")  # fmt: skip
_q("empty_group_sum", lambda t: t.nation.select_rows("n_nationkey < 0").project({"n": "(1).sum()", "s": "n_nationkey.sum()"}), "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS s")
_q("uniform", lambda t: t.nation.extend({"u": "_uniform()"}).extend({"ok": "u >= 0 and u < 1"}).select_columns(["n_nationkey", "ok"]), "SELECT n_nationkey, true AS ok FROM nation")
_q("group_min_max", lambda t: t.events.project({"lo": "value.min()", "hi": "value.max()"}, group_by=["user_id"]), "SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
_q("duplicate_rows", lambda t: t.lineitem.select_columns(["l_suppkey", "l_quantity", "l_tax"]).extend({"n": "(1).sum()"}, partition_by=["l_suppkey", "l_quantity", "l_tax"]).select_rows("n > 1").drop_columns(["n"]),
   "SELECT l_suppkey, l_quantity, l_tax FROM (SELECT l_suppkey, l_quantity, l_tax, count(*) OVER (PARTITION BY l_suppkey, l_quantity, l_tax) AS n FROM lineitem) WHERE n > 1")


# services: the text of plans, handles, spaces, files, streams, schemas, caches


def _view(t: _Tables, *names: str) -> None:
    for name in names:
        getattr(t, name).frame.createOrReplaceTempView(name)


def _sql_text(t: _Tables) -> DataFrame:
    _view(t, "lineitem")
    return t.spark.sql(pricing_summary(t).to_sql())


def _sql_text_joined(t: _Tables) -> DataFrame:
    _view(t, "orders", "customer")
    paid = t.orders.extend({"place": "_row_number()"}, partition_by=["o_custkey"], order_by=["o_totalprice", "o_orderkey"], reverse=["o_totalprice"]).select_rows("place <= 2")
    best = paid.natural_join(t.customer.select_columns(["c_custkey", "c_mktsegment"]), on={"o_custkey": "c_custkey"}, jointype="LEFT")
    return t.spark.sql(best.project({"s": "o_totalprice.sum()", "n": "_size()"}, group_by=["c_mktsegment"]).extend({"s": "s.around(2)"}).to_sql(options=SqlFormat(use_with=False)))


def _handle(t: _Tables) -> DataFrame:
    _view(t, "supplier")
    with SparkHandle(t.spark) as h:
        return h.read_query(h.describe_table("supplier").project({"n": "_size()", "top": "s_acctbal.max()"}, group_by=["s_nationkey"]))


def _space(t: _Tables) -> DataFrame:
    with SparkSpace(t.spark) as s:
        d = s.execute(s.insert(t.part.frame, key="part").select_rows("p_size > 25"), key="large")
        return s.retrieve(s.execute(d.project({"n": "_size()"}, group_by=["p_brand"]), key="counted").name)


def _files(t: _Tables) -> DataFrame:
    out = None
    for fmt in FORMATS:
        path = new_path(t.spark, f"nation-{fmt}")
        write_file(t.nation.select_columns(["n_nationkey", "n_name"]).ex(), path, fmt)
        plan = describe_table(read_file(t.spark, path, fmt), fmt).extend({"fmt": Lit(fmt), "n_nationkey": "n_nationkey.as_int64()"}).select_columns(["fmt", "n_nationkey", "n_name"])
        out = plan if out is None else out.concat_rows(plan, id_column=None)
    return out.ex()


def _stream(t: _Tables) -> DataFrame:
    """events as a stream, through a stateless plan and a join with a static table, to a table of files."""
    source, path = new_path(t.spark, "events"), new_path(t.spark, "streamed")
    frame = t.events.select_columns(["event_id", "user_id", "value"]).ex()
    frame.write.parquet(source)
    users = t.events.project({"total": "value.sum()"}, group_by=["user_id"])
    plan = table("events", frame.columns).select_rows("value > 50").extend({"twice": "value * 2"}).natural_join(table("users", users.columns), on="user_id", jointype="LEFT")
    stream = apply_stream(plan, t.spark.readStream.schema(frame.schema).parquet(source), users=users.ex())
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(path).select("event_id", F.round("twice", 6).alias("twice"), F.round("total", 4).alias("total"))


@check_schema({"d": {"c_custkey": {"bigint", "int"}, "c_acctbal": {"double", "decimal(12,2)"}}}, returns={"rich": "boolean"})
def _checked(d: DataFrame) -> DataFrame:
    return describe_table(d).extend({"rich": "c_acctbal > 5000"}).select_columns(["c_custkey", "rich"]).ex()


def _cached(t: _Tables) -> DataFrame:
    plan, cache = t.region.extend({"u": "r_regionkey + 1"}).select_columns(["r_regionkey", "u"]), ResultCache(t.spark)
    cache.evaluate(plan)
    return cache.get(plan)


def _user_aggregate(t: _Tables) -> DataFrame:
    register_function("spread", lambda c: F.max(c) - F.min(c), context="p", sql="(max({0}) - min({0}))")
    return t.supplier.project({"s": call("spread", col("s_acctbal"))}, group_by=["s_nationkey"]).extend({"s": "s.around(4)"}).ex()


_PRICING = ORACLES["pricing_summary"]
_q("sql_text", _sql_text, _PRICING)
_q("sql_text_joined", _sql_text_joined, """WITH p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
  SELECT c_mktsegment, round(sum(o_totalprice), 2) AS s, count(*) AS n FROM p LEFT JOIN customer ON o_custkey = c_custkey WHERE place <= 2 GROUP BY 1""")
_q("handle_query", _handle, "SELECT s_nationkey, count(*) AS n, max(s_acctbal) AS top FROM supplier GROUP BY 1")
_q("space_execute", _space, "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1")
_q("file_formats", _files, "SELECT fmt, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation, (VALUES ('parquet'), ('csv'), ('json'), ('orc')) v(fmt)")
_q("stream_stateless", _stream, """WITH u AS (SELECT user_id, round(sum(value), 4) AS total FROM events GROUP BY 1)
  SELECT event_id, round(value * 2, 6) AS twice, total FROM events e JOIN u ON e.user_id = u.user_id WHERE value > 50""")
_q("schema_checked", lambda t: _checked(t.customer.frame), "SELECT c_custkey, c_acctbal > 5000 AS rich FROM customer")
_q("result_cache", _cached, "SELECT r_regionkey, CAST(r_regionkey + 1 AS BIGINT) AS u FROM region")
_q("user_aggregate", _user_aggregate, "SELECT s_nationkey, round(max(s_acctbal) - min(s_acctbal), 4) AS s FROM supplier GROUP BY 1")
_q("win_ordered_aggregates", lambda t: t.orders.extend({"m": "o_totalprice.mean()", "d": "o_totalprice.median()", "k": "o_orderpriority.nunique()", "n": "o_orderkey.size()", "a": "o_orderstatus.any_value()"}, partition_by=["o_custkey"], order_by=["o_orderkey"])
   .extend({"m": "m.around(6)", "d": "d.around(6)"}).select_columns(["o_orderkey", "m", "d", "k", "n", "a"]),
   """SELECT o_orderkey, round(avg(o_totalprice) OVER w, 6) AS m, round(median(o_totalprice) OVER w, 6) AS d, k, count(*) OVER w AS n, max(o_orderstatus) OVER w AS a
  FROM orders JOIN (SELECT o_custkey AS c, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1) ON c = o_custkey WINDOW w AS (PARTITION BY o_custkey)""")  # fmt: skip
_q("rank_whole_table", lambda t: t.orders.extend({"r": "o_custkey.rank()"}, partition_by=1).extend({"n": "_row_number()"}, order_by=["o_orderkey"], reverse=["o_orderkey"]).select_columns(["o_orderkey", "r", "n"]),
   "SELECT o_orderkey, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS r, row_number() OVER (ORDER BY o_orderkey DESC) AS n FROM orders")
_q("use_macro", lambda t: t.part.use(lambda p, size: p.select_rows(f"p_size >= {size}"), 45).project({"n": "_size()"}, group_by=["p_size"]), "SELECT p_size, count(*) AS n FROM part WHERE p_size >= 45 GROUP BY 1")
_q("pivot_constructors", lambda t: t.supplier.select_columns(["s_suppkey", "s_nationkey", "s_acctbal"]).extend({"s_nationkey": "s_nationkey * 1.0"})
   .convert_records(unpivot_specification(row_keys=["s_suppkey"], col_name_key="what", col_value_key="value", value_cols=["s_nationkey", "s_acctbal"])).extend({"value": "value * 2"})
   .convert_records(pivot_specification(row_keys=["s_suppkey"], col_name_key="what", col_value_key="value", value_cols=["s_nationkey", "s_acctbal"])),
   "SELECT s_suppkey, s_nationkey * 2.0::DOUBLE AS s_nationkey, s_acctbal * 2 AS s_acctbal FROM supplier")
_q("xicor_repetitions", lambda t: S.xicor_score_variables(t.part, x_vars=["p_size"], y="p_retailprice", row_key="p_partkey", repetitions=5).extend({"ok": "xicor_std >= 0"}).select_columns(["variable", "ok"]), "SELECT 'p_size' AS variable, true AS ok")
__all__ = ["ORACLES", "QUERIES", "Lit", "call", "pricing_summary"]
