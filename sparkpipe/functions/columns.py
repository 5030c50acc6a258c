"""Expressions to Spark columns, or to their SQL.

Results are total: where a value has no result (a bigint overflows, text is no date) it is null, so that no input row
makes a query fail under ANSI mode; types that don't go together are refused while the plan is compiled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans.expr import Call, Col, DictArg, ListArg, Lit, Term
from .registry import lookup
from .sqltext import Sql, SqlFunctions, SqlWindow, quote_identifier

INF, NAN = float("inf"), float("nan")
#: strftime letters as Java patterns (fixed values).
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "I": "hh", "p": "a", "f": "SSSSSS"}


def java_pattern(fmt: str) -> str:
    """A strftime format as a Java one; other letters are quoted, unknown directives are errors."""
    out, i = "", 0
    while i < len(fmt):
        c = fmt[i]
        if c == "%":
            i += 1
            if i == len(fmt) or fmt[i] != "%" and fmt[i] not in STRFTIME:
                raise ValueError(f"unknown date directive in {fmt!r}")
            out += "%" if fmt[i] == "%" else STRFTIME[fmt[i]]
        elif c == "'":
            out += "''"
        else:
            out += f"'{c}'" if c.isalpha() else c
        i += 1
    return out


def kind_of(t: T.DataType) -> str:
    """int, float, bool, str, date, datetime, null or other."""
    for kinds, name in (
        ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"), ((T.FloatType, T.DoubleType, T.DecimalType), "float"), ((T.BooleanType,), "bool"), ((T.StringType,), "str"),
        ((T.DateType,), "date"), ((T.TimestampType, T.TimestampNTZType), "datetime"), ((T.NullType,), "null"),
    ):
        if isinstance(t, kinds):
            return name
    return "other"


def compatible(a: T.DataType, b: T.DataType) -> bool:
    x, y = kind_of(a), kind_of(b)
    return "null" in (x, y) or x == y and (x != "other" or a == b) or {x, y} == {"int", "float"}


def quoted(name: str) -> Column:
    return functions.col(quote_identifier(name))


def divided(e: Expressions, a: Column, b: Column) -> Column:
    """IEEE division of doubles."""
    F = e.F
    a, b = e.double(a), e.double(b)
    return F.when(b != 0, F.try_divide(a, b)).when(b.isNull() | a.isNull(), None).when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)


class Expressions:
    """Compiles expressions against a DataFrame's schema, to columns or, with text, to Spark SQL.

    F and W are pyspark's functions and windows, or what writes their SQL.
    """

    def __init__(self, df: DataFrame, *, text: bool = False, templates: dict[str, str] | None = None):
        self.df, self.text, self.templates = df, text, templates or {}
        self.F, self.W = (SqlFunctions(), SqlWindow()) if text else (functions, Window)
        self._types: dict[str, T.DataType] | None = None  # asked for when a kind is
        self._kinds: dict[int, tuple[object, str]] = {}
        self._named: dict[int, tuple[object, str]] = {}

    def known(self, c: Column, kind: str) -> Column:
        """c, whose kind needs no analysis from now on."""
        self._kinds[id(c)] = (c, kind)
        return c

    def type_of(self, c: Column) -> T.DataType:
        return self.df.select(functions.expr(c.text) if self.text else c).schema[0].dataType

    def kind(self, c: Column) -> str:
        if id(c) not in self._kinds:
            if self._types is None:
                self._types = {f.name: f.dataType for f in self.df.schema}
            name = self._named.get(id(c), (c, None))[1]
            self.known(c, kind_of(self._types[name] if name in self._types else self.type_of(c)))
        return self._kinds[id(c)][1]

    def name(self, column: str) -> Column:
        return self.F.col(quote_identifier(column))

    def clean(self, c: Column) -> Column:
        """NaN as null, for floats."""
        return self.known(self.F.nanvl(c.cast("double"), self.F.lit(None).cast("double")), "float") if self.kind(c) == "float" else c

    def double(self, c: Column) -> Column:
        """c as a double; text, dates and the like are no numbers."""
        self.numbers(c)
        return self.known(c.cast("double"), "float")

    def numbers(self, *cs: Column) -> None:
        for c in cs:
            if self.kind(c) not in ("int", "float", "bool", "null"):
                raise TypeError(f"{self.kind(c)} is no number")

    def alike(self, *cs: Column) -> None:
        kinds = {self.kind(c) for c in cs} - {"null"}
        if len(kinds) > 1 and kinds != {"int", "float"}:
            raise TypeError(f"{' and '.join(sorted(kinds))} don't compare")

    def value(self, v) -> Column:
        kind = {bool: "bool", int: "int", float: "float", str: "str"}.get(type(v), "null")
        return self.known(self.F.lit(v).cast("bigint") if type(v) is int else self.F.lit(v), kind)

    def day(self, c: Column) -> Column:
        """c as a date; text that is none is null."""
        return c.try_cast("date") if self.kind(c) == "str" else c

    def moment(self, c: Column) -> Column:
        return c.try_cast("timestamp_ntz") if self.kind(c) == "str" else c

    def column(self, t: Term) -> Column:
        if isinstance(t, Col):
            c = self.name(t.name)
            self._named[id(c)] = (c, t.name)
            return c
        if isinstance(t, Lit):
            return self.value(t.value)
        if not isinstance(t, Call):
            raise ValueError(f"{t} is no value")
        spec = lookup(t.op)
        if "e" not in spec.contexts and t.op != "_uniform":
            raise ValueError(f"{t.op} must be the outermost function of its assignment")
        if spec.user or t.op in self.templates:
            return self.user(t, spec)
        if t.op == "_uniform":
            return self.F.rand()
        special = getattr(self, f"do_{t.op}", None)
        if special is not None:
            return special(t)
        args = [self.column(a) for a in t.args]
        if t.op in ("+", "*", "and", "or"):
            out = args[0]
            for a in args[1:]:
                out = _SIMPLE[t.op](self, out, a)
            return out
        return _SIMPLE[t.op](self, *args)

    def user(self, t: Call, spec) -> Column:
        args = [self.column(a) for a in t.args]
        if not self.text:
            return spec.build(*args)
        template = self.templates.get(t.op, spec.sql)
        if template is None:
            raise ValueError(f"{t.op} was registered without SQL text")
        return Sql(template.format(*(a.text for a in args)))

    def do_is_in(self, t: Call) -> Column:
        x, values = self.column(t.args[0]), [self.value(v) for v in t.args[1].values]
        self.alike(x, *values)
        return self.known(self.F.coalesce(x.isin(*values), self.F.lit(False)), "bool")

    def do_mapv(self, t: Call) -> Column:
        F = self.F
        x, default = self.column(t.args[0]), self.column(t.args[2]) if len(t.args) > 2 else F.lit(None)
        items: tuple = t.args[1].items if isinstance(t.args[1], DictArg) else ()
        self.alike(x, *(self.value(k) for k, _ in items))
        self.alike(default, *(self.value(v) for _, v in items))
        if len(items) > 50:
            table = F.create_map(*[self.value(v) for pair in items for v in pair])
            return F.coalesce(F.try_element_at(table, x), default)
        out = None
        for k, v in items:
            out = (F if out is None else out).when(x == self.value(k), self.value(v))
        return default if out is None else out.otherwise(default)

    def do_around(self, t: Call) -> Column:
        x = self.column(t.args[0])
        self.numbers(x)
        return self.F.bround(x, t.args[1].value)

    def do_trimstr(self, t: Call) -> Column:
        start, stop = (a.value for a in t.args[1:])
        return self.F.substring(self.column(t.args[0]), start + 1, max(0, stop - start))

    def _format(self, t: Call, default: str) -> str:
        return java_pattern(t.args[1].value if len(t.args) > 1 else default)

    def do_parse_date(self, t: Call) -> Column:
        return self.F.try_to_timestamp(self.column(t.args[0]), self.F.lit(self._format(t, "%Y-%m-%d"))).cast("date")

    def do_parse_datetime(self, t: Call) -> Column:
        return self.F.try_to_timestamp(self.column(t.args[0]), self.F.lit(self._format(t, "%Y-%m-%d %H:%M:%S"))).cast("timestamp_ntz")

    def do_format_date(self, t: Call) -> Column:
        return self.F.date_format(self.moment(self.column(t.args[0])), self._format(t, "%Y-%m-%d"))

    def do_format_datetime(self, t: Call) -> Column:
        return self.F.date_format(self.moment(self.column(t.args[0])), self._format(t, "%Y-%m-%d %H:%M:%S"))

    # aggregates: over a group, or over a window's partition

    def aggregate(self, t: Call) -> Column:
        F, spec = self.F, lookup(t.op)
        if spec.user or t.op in self.templates:
            return self.user(t, spec)
        if t.op in ("_count", "_size", "size"):
            return F.count(F.lit(1))
        x = self.column(t.args[0])
        if t.op in ("min", "max", "any_value"):
            return (F.min if t.op == "min" else F.max)(self.clean(x))
        if t.op in ("any", "all"):
            return (F.bool_or if t.op == "any" else F.bool_and)(F.coalesce(x.try_cast("boolean"), F.lit(False)))
        if t.op == "sum":
            return self.total(x)
        if t.op in ("count", "nunique"):
            return F.count(x) if t.op == "count" else F.count_distinct(x)
        return {"mean": F.avg, "median": F.median, "std": F.stddev_samp, "var": F.var_samp}[t.op](self.double(x))

    def total(self, x: Column) -> Column:
        """A sum; one of whole numbers that no bigint holds is null."""
        self.numbers(x)
        return self.F.try_sum(x.cast("bigint")) if self.kind(x) in ("int", "bool") else self.F.sum(self.double(x))

    def windowed(self, t: Call, partition: list[str], order: list[Column]) -> Column:
        F, W = self.F, self.W
        part = W.partitionBy(*[self.name(p) for p in partition])
        full = part.orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing) if order else part
        x = self.column(t.args[0]) if t.args else None
        if t.op == "rank":
            own = part.orderBy(x.asc_nulls_last())
            ties = F.count(F.lit(1)).over(part.partitionBy(*[self.name(p) for p in partition], x))
            return F.when(x.isNotNull(), F.rank().over(own) + (ties - 1) / 2.0)
        if t.op == "nunique":
            return F.size(F.collect_set(x).over(part)).cast("bigint")
        if t.op == "_row_number" or t.op == "_count" and order:
            return F.row_number().over(part.orderBy(*order)).cast("bigint")
        if t.op == "cumcount":
            return (F.row_number().over(part.orderBy(*order)) - 1).cast("bigint")
        if t.op == "shift":
            return F.lag(x, t.args[1].value if len(t.args) > 1 else 1).over(part.orderBy(*order))
        if t.op in ("first", "last"):
            return (F.first if t.op == "first" else F.last)(x, True).over(full)
        running = part.orderBy(*order).rowsBetween(W.unboundedPreceding, 0) if order else part
        if t.op == "ffill":
            return F.last(x, True).over(running)
        if t.op == "bfill":
            return F.first(x, True).over(part.orderBy(*order).rowsBetween(0, W.unboundedFollowing))
        if t.op.startswith("is_monotonic"):
            raise ValueError(f"{t.op} is compiled in two steps")
        if t.op in ("cumsum", "cumprod", "cummax", "cummin"):
            y = {"cumsum": self.total, "cumprod": lambda c: F.product(self.double(c)), "cummax": lambda c: F.max(self.clean(c)), "cummin": lambda c: F.min(self.clean(c))}[t.op](x)
            return F.when(x.isNotNull(), y.over(running))
        return self.aggregate(t).over(part)


def _arithmetic(name: str, plain):
    """Sums, differences and products: of whole numbers as bigint, null where that overflows; else of doubles."""

    def build(e: Expressions, a: Column, b: Column) -> Column:
        e.numbers(a, b)
        if e.kind(a) in ("int", "bool", "null") and e.kind(b) in ("int", "bool", "null"):
            return e.known(getattr(e.F, name)(a.cast("bigint"), b.cast("bigint")), "int")
        return e.known(plain(e.double(a), e.double(b)), "float")

    return build


_plus, _minus, _times = _arithmetic("try_add", lambda a, b: a + b), _arithmetic("try_subtract", lambda a, b: a - b), _arithmetic("try_multiply", lambda a, b: a * b)


def _negative(e: Expressions, a: Column) -> Column:
    return _minus(e, e.value(0), a) if e.kind(a) in ("int", "bool") else e.known(-e.double(a), "float")


def _absolute(e: Expressions, a: Column) -> Column:
    e.numbers(a)
    return e.known(e.F.when(a >= 0, a.cast("bigint")).otherwise(_negative(e, a)), "int") if e.kind(a) == "int" else e.known(e.F.abs(e.double(a)), "float")


def _modulo(e: Expressions, a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; by zero: NaN for floats, null for whole numbers."""
    F = e.F
    e.numbers(a, b)
    if "float" in (e.kind(a), e.kind(b)):
        a, b = e.double(a), e.double(b)
        return e.known(F.when(b != 0, a - F.floor(F.try_divide(a, b)) * b).when(a.isNotNull() & b.isNotNull(), NAN), "float")
    b = b.cast("bigint")
    r = F.try_mod(a.cast("bigint"), b)
    return e.known(F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r), "int")


def _floor_divided(e: Expressions, a: Column, b: Column) -> Column:
    F = e.F
    e.numbers(a, b)
    if "float" in (e.kind(a), e.kind(b)):
        q = divided(e, a, b)
        return F.when(F.isnan(q) | (F.abs(q) == INF), q).otherwise(F.floor(q).cast("double"))
    a, b = a.cast("bigint"), b.cast("bigint")
    whole = F.call_function("div", a - _modulo(e, a, b), b)  # towards zero, of a multiple of b
    return e.known(F.when(b == -1, _negative(e, e.known(a, "int"))).when(b != 0, F.when((a < 0) == (b < 0), F.call_function("div", a, b)).otherwise(whole)), "int")


def _logarithm(name: str):
    def build(e, x):
        x = e.double(x)
        at = x + 1 if name == "log1p" else x
        return e.known(e.F.when(at > 0, getattr(e.F, name)(x)).when(at == 0, -INF).when(at < 0, NAN), "float")

    return build


def _floor_like(name: str):
    def build(e, x):
        if e.kind(x) == "int":
            return x
        x = e.double(x)
        return e.F.when(e.F.isnan(x) | (e.F.abs(x) == INF), x).otherwise(getattr(e.F, name)(x).cast("double"))

    return build


def _rounded(e, x):
    return x if e.kind(x) == "int" else e.F.rint(e.double(x))


def _is_nan(e, x):
    return e.known(e.F.coalesce(e.F.isnan(x), e.F.lit(False)) if e.kind(x) == "float" else e.F.lit(False), "bool")


def _is_inf(e, x):
    return e.known(e.F.coalesce(e.F.abs(x) == INF, e.F.lit(False)) if e.kind(x) == "float" else e.F.lit(False), "bool")


def _as_int(e, x):
    k = e.kind(x)
    if k == "float":
        x = e.double(x)
        return e.F.when(~(e.F.isnan(x) | (e.F.abs(x) >= 2.0**63)), x).try_cast("bigint")
    return e.F.coalesce(x.try_cast("bigint"), x.try_cast("double").try_cast("bigint")) if k == "str" else x.try_cast("bigint")


def _coalesce(e, x, y):
    e.alike(x, y)
    return e.F.coalesce(e.clean(x), y)


def _extreme(name: str):
    def build(e, a, b):
        e.alike(a, b)
        return getattr(e.F, name)(e.clean(a), e.clean(b))

    return build


def _strict_extreme(name: str):
    def build(e, a, b):
        e.alike(a, b)
        out = getattr(e.F, name)(a, b)
        for n in [e.F.isnan(x) for x in (a, b) if e.kind(x) == "float"]:
            out = e.F.when(n, NAN).otherwise(out)
        return e.F.when(a.isNotNull() & b.isNotNull(), out)

    return build


def _compared(test):
    """Days and moments compare with each other, and with text that stands for one."""

    def build(e, a, b):
        kinds = {e.kind(a), e.kind(b)}
        if len(kinds) == 2 and kinds <= {"date", "datetime", "str"}:
            a, b = (e.day(a), e.day(b)) if "datetime" not in kinds else (e.moment(a).cast("timestamp_ntz"), e.moment(b).cast("timestamp_ntz"))
        else:
            e.alike(a, b)
        return e.known(test(a, b), "bool")

    return build


def _chosen(strict: bool):
    def build(e, c, a, b):
        e.alike(a, b)
        return e.F.when(c, a).when(~c, b) if strict else e.F.when(c, a).otherwise(b)

    return build


def _sunday(e, d: Column) -> Column:
    d = e.day(d)
    return e.F.date_sub(d, e.F.dayofweek(d) - 1)


def _week(e, d):
    d = e.day(d)
    return e.F.when(d.isNotNull(), e.F.greatest(e.F.lit(1), e.F.floor(e.F.datediff(d, _sunday(e, e.F.trunc(d, "year"))) / 7)).cast("bigint"))


def _date_part(name: str):
    return lambda e, d: e.known(getattr(e.F, name)(e.day(d)).cast("bigint"), "int")


def _real(name: str):
    return lambda e, *args: e.known(getattr(e.F, name)(*[e.double(a) for a in args]), "float")


_SIMPLE = {
    "+": _plus, "-": _minus, "*": _times, "neg": _negative, "and": lambda e, a, b: e.known(a & b, "bool"), "or": lambda e, a, b: e.known(a | b, "bool"),
    "/": divided, "%/%": divided, "float_divide": divided, "//": _floor_divided, "%": _modulo, "mod": _modulo, "remainder": _modulo, "**": _real("pow"),
    "^": _compared(lambda a, b: a != b), "==": _compared(lambda a, b: a == b), "!=": _compared(lambda a, b: ~(a == b)), "<": _compared(lambda a, b: a < b),
    "<=": _compared(lambda a, b: a <= b), ">": _compared(lambda a, b: a > b), ">=": _compared(lambda a, b: a >= b), "abs": _absolute, "sign": _real("signum"),
    **{n: _real(n) for n in ("sqrt", "exp", "expm1", "sin", "cos", "sinh", "cosh", "tanh")}, **{n: _logarithm(n) for n in ("log", "log10", "log1p")},
    **{"arc" + n: _real("a" + n) for n in ("sin", "cos", "tan", "sinh", "cosh", "tanh")}, "arctan2": _real("atan2"), "floor": _floor_like("floor"), "ceil": _floor_like("ceil"), "round": _rounded,
    "as_int64": _as_int, "as_str": lambda e, x: e.known(x.cast("string"), "str"), "is_null": lambda e, x: e.known(x.isNull(), "bool"), "is_nan": _is_nan, "is_inf": _is_inf,
    "is_bad": lambda e, x: e.known(x.isNull() | _is_nan(e, x) | _is_inf(e, x), "bool"), "coalesce": _coalesce, "coalesce_0": lambda e, x: _coalesce(e, x, e.value(0)),
    "maximum": _strict_extreme("greatest"), "minimum": _strict_extreme("least"), "fmax": _extreme("greatest"), "fmin": _extreme("least"),
    "concat": lambda e, a, b: e.known(e.F.concat(a.cast("string"), b.cast("string")), "str"), "if_else": _chosen(True), "where": _chosen(False),
    "datetime_to_date": lambda e, d: e.day(d) if e.kind(d) == "str" else e.F.to_date(d), **{n: _date_part(n) for n in ("dayofweek", "dayofyear", "dayofmonth", "month", "quarter", "year")},
    "weekofyear": _week, "base_Sunday": _sunday, "timestamp_diff": lambda e, a, b: e.F.timestamp_diff("MICROSECOND", e.moment(b), e.moment(a)) / e.F.lit(1e6),
    "date_diff": lambda e, a, b: e.F.datediff(e.day(a), e.day(b)).cast("bigint"),
}

__all__ = ["Expressions", "ListArg", "compatible", "divided", "java_pattern", "kind_of", "quoted"]
