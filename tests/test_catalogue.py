"""One case for each function of the catalogue and each place it may stand in, against plain Python."""

import datetime as dt
import math
import statistics

import pytest

from sparkpipe.functions.registry import functions
from sparkpipe.plans.nodes import describe_table
from sparkpipe.sources.frames import from_rows

INF, NAN = math.inf, math.nan
D, T = dt.date, dt.datetime
ROWS = [
    # row_id q x y z a b g s2 when moment text_day text_moment o
    (1, 2, 0.5, 2.5, 1.5, True, False, "abc", "p", D(2001, 1, 7), T(2001, 1, 7, 10, 0, 0, 500000), "2001-02-03", "2001-02-03 04:05:06", 5),
    (2, 3, -1.5, 0.4, None, False, False, "b", "q", D(2024, 2, 29), T(2024, 2, 29, 23, 59, 59), "nonsense", "2001-02-03", 4),
    (3, 2, 2.0, -2.5, NAN, True, True, "abc", None, D(1999, 12, 31), T(1999, 12, 31), None, None, 3),
    (4, -2, 0.25, 1.5, -2.5, None, True, "c", "r", None, None, "2001-02-30", "1970-01-01 00:00:00", 2),
    (5, 0, 0.5, 3.5, 0.0, False, None, None, "s", D(2000, 3, 5), T(2000, 3, 5, 12), "1970-01-01", "x", 1),
]
NAMES = "row_id q x y z a b g s2 day0 moment0 text_day text_moment o".split()
TYPES = "bigint bigint double double double boolean boolean string string date timestamp_ntz string string bigint".split()
FIRST_DAY, FIRST_MOMENT = D(2000, 1, 1), T(2000, 1, 1)


class Row:
    def __init__(self, values):
        self.__dict__.update(zip(NAMES, values, strict=True))


ALL = [Row(r) for r in ROWS]


def known(*values):
    return not any(v is None for v in values)


def clean(v):
    return None if v is None or isinstance(v, float) and v != v else v


def divide(a, b):
    if not known(a, b):
        return None
    return a / b if b else NAN if a == 0 or a != a else INF if a > 0 else -INF


def bankers(v, digits=0):
    return None if v is None else v if v != v else round(v, digits) * 1.0


def sunday(d):
    return None if d is None else d - dt.timedelta(days=(d.weekday() + 1) % 7)


def real(f, column="x"):
    def run(r):
        v = getattr(r, column)
        try:
            return None if v is None else f(v)
        except ValueError:
            return NAN

    return run


def day(text, fmt):
    try:
        return None if text is None else T.strptime(text, fmt)
    except ValueError:
        return None


def extreme(f):
    return lambda a, b: (clean(a) if clean(b) is None else b if clean(a) is None else f(a, b))


SCALAR = {
    "x != y": lambda r: r.x != r.y, "row_id % q": lambda r: r.row_id % r.q if r.q else None, "x %/% y": lambda r: divide(r.x, r.y), "x * y": lambda r: r.x * r.y,
    "y ** 2": lambda r: r.y**2, "x + y": lambda r: r.x + r.y, "-x": lambda r: -r.x, "-row_id": lambda r: -r.row_id, "x - y": lambda r: r.x - r.y, "x / q": lambda r: divide(r.x, r.q),
    "row_id // q": lambda r: r.row_id // r.q if r.q else None, "x // y": lambda r: float(r.x // r.y), "x < y": lambda r: r.x < r.y, "x <= y": lambda r: r.x <= r.y,
    "not a": lambda r: None if r.a is None else not r.a, "x == y": lambda r: r.x == r.y, "x > y": lambda r: r.x > r.y, "x >= y": lambda r: r.x >= r.y,
    "x.abs()": lambda r: abs(r.x), "q.abs()": lambda r: abs(r.q), "a and b": lambda r: False if r.a is False or r.b is False else None if not known(r.a, r.b) else True,
    "a or b": lambda r: True if r.a or r.b else None if not known(r.a, r.b) else False, "a ^ b": None,
    "x.arccos()": real(math.acos), "y.arccosh()": real(math.acosh, "y"), "x.arcsin()": real(math.asin), "x.arcsinh()": real(math.asinh), "x.arctan()": real(math.atan),
    "x.arctan2(y)": lambda r: math.atan2(r.x, r.y), "x.arctanh()": real(math.atanh), "y.around(0)": lambda r: bankers(r.y), "y.as_int64()": lambda r: int(r.y), "row_id.as_str()": lambda r: str(r.row_id),
    "day0.base_Sunday()": lambda r: sunday(r.day0), "y.ceil()": lambda r: float(math.ceil(r.y)), "y.floor()": lambda r: float(math.floor(r.y)), "y.round()": lambda r: bankers(r.y),
    "z %?% 2": lambda r: 2.0 if clean(r.z) is None else r.z, "z.coalesce(2)": lambda r: 2.0 if clean(r.z) is None else r.z, "z.coalesce_0()": lambda r: 0.0 if clean(r.z) is None else r.z,
    "g %+% '_' %+% s2": lambda r: f"{r.g}_{r.s2}" if known(r.g, r.s2) else None, "g.concat(s2)": lambda r: r.g + r.s2 if known(r.g, r.s2) else None,
    "x.cos()": real(math.cos), "x.cosh()": real(math.cosh), "x.sin()": real(math.sin), "x.sinh()": real(math.sinh), "x.tanh()": real(math.tanh), "x.exp()": real(math.exp), "x.expm1()": real(math.expm1),
    "day0.date_diff(first_day)": lambda r: (r.day0 - FIRST_DAY).days if r.day0 else None, "moment0.datetime_to_date()": lambda r: r.moment0.date() if r.moment0 else None,
    "day0.dayofmonth()": lambda r: r.day0.day if r.day0 else None, "day0.dayofweek()": lambda r: r.day0.isoweekday() % 7 + 1 if r.day0 else None, "day0.dayofyear()": lambda r: r.day0.timetuple().tm_yday if r.day0 else None,
    "day0.month()": lambda r: r.day0.month if r.day0 else None, "day0.quarter()": lambda r: (r.day0.month + 2) // 3 if r.day0 else None, "day0.year()": lambda r: r.day0.year if r.day0 else None,
    "day0.weekofyear()": lambda r: max(1, (r.day0 - sunday(D(r.day0.year, 1, 1))).days // 7) if r.day0 else None,
    "text_day.year()": lambda r: d.year if (d := day(r.text_day, "%Y-%m-%d")) else None, "row_id.fmax(z)": lambda r: extreme(max)(float(r.row_id), r.z), "row_id.fmin(z)": lambda r: extreme(min)(float(r.row_id), r.z),
    "row_id.maximum(z)": lambda r: None if r.z is None else NAN if r.z != r.z else max(float(r.row_id), r.z), "row_id.minimum(z)": lambda r: None if r.z is None else NAN if r.z != r.z else min(float(r.row_id), r.z),
    "day0.format_date()": lambda r: str(r.day0) if r.day0 else None, "moment0.format_datetime()": lambda r: r.moment0.strftime("%Y-%m-%d %H:%M:%S") if r.moment0 else None,
    "a.if_else(x, y)": lambda r: None if r.a is None else r.x if r.a else r.y, "a.where(x, y)": lambda r: r.x if r.a else r.y, "z.is_bad()": lambda r: clean(r.z) is None,
    "row_id.is_in([1, 3])": lambda r: r.row_id in (1, 3), "(x / q).is_inf()": lambda r: r.q == 0, "z.is_nan()": lambda r: r.z is not None and r.z != r.z, "z.is_null()": lambda r: r.z is None,
    "x.log()": lambda r: math.log(r.x) if r.x > 0 else NAN, "x.log10()": lambda r: math.log10(r.x) if r.x > 0 else NAN, "x.log1p()": lambda r: math.log1p(r.x) if r.x > -1 else NAN,
    "g.mapv({'abc': 1, 'b': 2}, 0)": lambda r: {"abc": 1, "b": 2}.get(r.g, 0), "row_id.mod(2)": lambda r: r.row_id % 2, "row_id.remainder(2)": lambda r: r.row_id % 2, "(-row_id).mod(3)": lambda r: -r.row_id % 3,
    "text_day.parse_date()": lambda r: d.date() if (d := day(r.text_day, "%Y-%m-%d")) else None, "text_moment.parse_datetime()": lambda r: day(r.text_moment, "%Y-%m-%d %H:%M:%S"),
    "q.sign()": lambda r: float((r.q > 0) - (r.q < 0)), "y.sqrt()": lambda r: math.sqrt(r.y) if r.y >= 0 else NAN, "x.float_divide(q)": lambda r: divide(r.x, r.q),
    "moment0.timestamp_diff(first_moment)": lambda r: (r.moment0 - FIRST_MOMENT).total_seconds() if r.moment0 else None, "g.trimstr(0, 2)": lambda r: r.g[:2] if r.g else None,
    "row_id * 4611686018427387904": lambda r: r.row_id * 2**62 if r.row_id < 2 else None,
}
SCALAR.pop("a ^ b")  # refused in text, allowed on objects
Z = [clean(r.z) for r in ALL]
X = [r.x for r in ALL]
AGGREGATES = {
    "_size()": 5, "_count()": 5, "x.size()": 5, "(1).sum()": 5, "x.sum()": sum(X), "row_id.sum()": 15, "g.count()": 4, "x.mean()": sum(X) / 5, "x.median()": 0.5, "x.min()": -1.5, "x.max()": 2.0, "z.min()": -2.5, "z.max()": 1.5,
    "g.nunique()": 3, "x.std()": statistics.stdev(X), "x.var()": statistics.variance(X), "a.any()": True, "a.all()": False, "g.any_value()": "c",
}
#: Windows in the order of o, which is that of the rows backwards.
BACK = ALL[::-1]


def running(values, f):
    out, now = [], None
    for v in values:
        if v is not None:
            now = v if now is None else f(now, v)
        out.append(now if v is not None else None)
    return out


def filled(values):
    out, now = [], None
    for v in values:
        now = v if v is not None else now
        out.append(now)
    return out


BX, BG = [r.x for r in BACK], [r.g for r in BACK]
WINDOWS = {
    "_row_number()": [1, 2, 3, 4, 5], "x.cumcount()": [0, 1, 2, 3, 4], "x.cummax()": running(BX, max), "x.cummin()": running(BX, min), "x.cumprod()": running(BX, lambda a, b: a * b),
    "x.cumsum()": running(BX, lambda a, b: a + b), "row_id.cumsum()": [5, 9, 12, 14, 15], "g.ffill()": filled(BG), "g.bfill()": filled(BG[::-1])[::-1], "g.first()": ["c"] * 5, "g.last()": ["abc"] * 5,
    "x.shift()": [None, *BX[:-1]], "x.shift(2)": [None, None, *BX[:-2]], "x.rank()": [3.5, 2.0, 5.0, 1.0, 3.5], "row_id.is_monotonic_increasing()": [False] * 5, "row_id.is_monotonic_decreasing()": [True] * 5,
}
REFUSED = [
    "text_day + 1", "text_day * x", "text_day.sqrt()", "text_day < 1", "text_day.mean()", "row_id.is_in(['a'])", "a.if_else(x, g)", "g.coalesce(1)", "g.maximum(1)", "g.mapv({1: 2}, 0)",
]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(ROWS, ", ".join(f"{n} {t}" for n, t in zip(NAMES, TYPES, strict=True)))
    from pyspark.sql import functions as F

    df = df.withColumns({"first_day": F.lit(FIRST_DAY), "first_moment": F.lit(FIRST_MOMENT).cast("timestamp_ntz"), "whole": F.lit(1)})
    df.createOrReplaceTempView("catalogue_rows")
    return describe_table(df, "catalogue_rows")


@pytest.fixture(scope="module")
def results(spark, table):
    """Every case's values, by the DataFrame and by the SQL text."""
    out = {}
    for kind, cases, made in (("e", SCALAR, lambda ops: table.extend(ops)), ("w", WINDOWS, lambda ops: table.extend(ops, partition_by=["whole"], order_by=["o"])), ("v", WINDOWS, lambda ops: table.extend(ops, order_by=["o"])),
                              ("g", AGGREGATES, lambda ops: table.extend(ops, partition_by=["whole"])), ("G", AGGREGATES, lambda ops: table.extend(ops, partition_by=1)), ("p", AGGREGATES, lambda ops: table.project(ops, group_by=["whole"])), ("P", AGGREGATES, lambda ops: table.project(ops))):
        ops = {f"c{i}": text for i, text in enumerate(cases)}
        plan = made(ops)
        for way, df in (("frame", plan.ex()), ("text", spark.sql(plan.to_sql()))):
            rows = df.collect()
            rows = sorted(rows, key=lambda r: r["row_id"]) if kind in "ewvgG" else rows
            out[kind, way] = {text: [r[c] for r in rows] for c, text in ops.items()}
    return out


def same(got, want):
    if isinstance(want, float) and isinstance(got, (int, float)) and not isinstance(got, bool):
        return got != got if want != want else got == pytest.approx(want, rel=1e-12, abs=1e-12)
    return got == want and isinstance(got, bool) == isinstance(want, bool)


def check(got, want, text):
    assert len(got) == len(want) and all(same(g, w) for g, w in zip(got, want, strict=True)), (text, got, want)


@pytest.mark.parametrize("way", ["frame", "text"])
@pytest.mark.parametrize("text", SCALAR)
def test_scalar(results, text, way):
    check(results["e", way][text], [SCALAR[text](r) for r in ALL], text)


@pytest.mark.parametrize("way", ["frame", "text"])
@pytest.mark.parametrize("kind", ["g", "G", "p", "P"])
@pytest.mark.parametrize("text", AGGREGATES)
def test_aggregate(results, text, kind, way):
    check(results[kind, way][text], [AGGREGATES[text]] * (5 if kind in "gG" else 1), text)


@pytest.mark.parametrize("way", ["frame", "text"])
@pytest.mark.parametrize("kind", ["w", "v"])
@pytest.mark.parametrize("text", WINDOWS)
def test_window(results, text, kind, way):
    check(results[kind, way][text], WINDOWS[text][::-1], text)


def test_every_function_has_a_case(table):
    plan_ops = set()
    for cases, make in ((SCALAR, lambda ops: table.extend(ops)), (WINDOWS, lambda ops: table.extend(ops, order_by=["o"])), (AGGREGATES, lambda ops: table.project(ops))):
        plan_ops |= {op for op, _ in make({f"c{i}": t for i, t in enumerate(cases)}).methods_used()}
    # tested by tests of their own: objects only, chance, numbering of keys, graphs
    assert {n for n, f in functions().items() if not f.user} - plan_ops <= {"^", "_uniform", "_ngroup", "connected_components", "co_equalizer"}


@pytest.mark.parametrize("text", REFUSED)
def test_types_are_refused_before_running(table, text):
    with pytest.raises((TypeError, ValueError)):
        (table.project({"c": text}) if "mean" in text else table.extend({"c": text})).ex()


def test_ngroup_and_uniform(spark, table):
    got = {r.row_id: (r.n, r.u) for r in table.extend({"n": "_ngroup()"}, partition_by=["g"]).extend({"u": "_uniform()"}).ex().collect()}
    assert [got[i][0] for i in range(1, 6)] == [0, 1, 0, 2, 3] and all(0 <= u < 1 for _, u in got.values())
    sql = table.extend({"n": "_ngroup()"}, partition_by=["g"]).to_sql()
    assert [r.n for r in sorted(spark.sql(sql).collect(), key=lambda r: r.row_id)] == [0, 1, 0, 2, 3]


def test_exclusive_or_on_objects(table):
    from sparkpipe.plans.expr import col

    assert [r.c for r in table.extend({"c": col("a") ^ col("b")}).order_rows(["row_id"]).ex().collect()] == [True, False, False, None, None]


def test_null_columns_and_no_rows(spark):
    nothing = describe_table(from_rows(spark, {"v": [None, None], "k": ["a", "a"]}, {"v": "double"}))
    (row,) = nothing.project({"s": "v.sum()", "n": "v.count()", "m": "v.mean()", "d": "v.nunique()"}, group_by=["k"]).ex().collect()
    assert tuple(row) == ("a", None, 0, None, 0)
    empty = nothing.select_rows("k == 'b'")
    assert [tuple(r) for r in empty.project({"n": "(1).sum()", "s": "v.sum()"}).ex().collect()] == [(0, None)]
    assert empty.extend({"r": "v.rank()"}, partition_by=1).ex().collect() == []
