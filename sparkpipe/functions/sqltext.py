"""Spark SQL text where the expression compiler has columns: the same calls, each of which writes its SQL."""

from __future__ import annotations

import math

#: Functions whose SQL name is another one (fixed values).
_NAMES = {"log": "ln", "create_map": "map"}


def quote_identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_string(text: str) -> str:
    """A Spark literal, in which a backslash escapes and so is doubled."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else "double('NaN')" if math.isnan(value) else f"double('{'-' if value < 0 else ''}Infinity')"
    return quote_string(value) if isinstance(value, str) else str(value)


def _text(value) -> str:
    return value.text if isinstance(value, Sql) else literal(value)


class Sql:
    """A piece of SQL that can stand anywhere in a larger one."""

    def __init__(self, text: str):
        self.text = text

    def __repr__(self) -> str:
        return self.text

    def cast(self, kind: str) -> Sql:
        return Sql(f"CAST({self.text} AS {kind.upper()})")

    def try_cast(self, kind: str) -> Sql:
        return Sql(f"TRY_CAST({self.text} AS {kind.upper()})")

    def isNull(self) -> Sql:  # noqa: N802
        return Sql(f"({self.text} IS NULL)")

    def isNotNull(self) -> Sql:  # noqa: N802
        return Sql(f"({self.text} IS NOT NULL)")

    def isin(self, *values) -> Sql:
        return Sql(f"({self.text} IN ({', '.join(map(_text, values))}))")

    def alias(self, name: str) -> Sql:
        return Sql(f"{self.text} AS {quote_identifier(name)}")

    def asc_nulls_last(self) -> Sql:
        return Sql(f"{self.text} ASC NULLS LAST")

    def desc_nulls_last(self) -> Sql:
        return Sql(f"{self.text} DESC NULLS LAST")

    def over(self, window: SqlWindow) -> Sql:
        return Sql(f"{self.text} OVER ({window.text()})")

    def __neg__(self) -> Sql:
        return Sql(f"(- {self.text})")

    def __invert__(self) -> Sql:
        return Sql(f"(NOT {self.text})")

    __hash__ = None


def _infix(spelling: str, swapped: bool = False):
    def build(self, other) -> Sql:
        a, b = (_text(other), self.text) if swapped else (self.text, _text(other))
        return Sql(f"({a} {spelling} {b})")

    return build


for _method, _spelling in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "and": "AND", "or": "OR"}.items():
    setattr(Sql, f"__{_method}__", _infix(_spelling))
    setattr(Sql, f"__r{_method}__", _infix(_spelling, True))
for _method, _spelling in {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    setattr(Sql, f"__{_method}__", _infix(_spelling))


class _Case(Sql):
    def __init__(self, branches: tuple[tuple[str, str], ...]):
        self.branches = branches
        super().__init__(self._with(""))

    def _with(self, last: str) -> str:
        return "CASE" + "".join(f" WHEN {c} THEN {v}" for c, v in self.branches) + last + " END"

    def when(self, condition, value) -> _Case:
        return _Case((*self.branches, (_text(condition), _text(value))))

    def otherwise(self, value) -> Sql:
        return Sql(self._with(f" ELSE {_text(value)}"))


class SqlWindow:
    """The window specification of the same calls."""

    unboundedPreceding, unboundedFollowing, currentRow = -(1 << 63), (1 << 63) - 1, 0  # noqa: N815

    def __init__(self, partition: tuple = (), order: tuple = (), frame: str = ""):
        self.partition, self.order, self.frame = partition, order, frame

    def partitionBy(self, *by) -> SqlWindow:  # noqa: N802
        return SqlWindow(by, self.order, self.frame)

    def orderBy(self, *by) -> SqlWindow:  # noqa: N802
        return SqlWindow(self.partition, by, self.frame)

    def rowsBetween(self, start: int, stop: int) -> SqlWindow:  # noqa: N802
        edge = {self.unboundedPreceding: "UNBOUNDED PRECEDING", self.unboundedFollowing: "UNBOUNDED FOLLOWING", 0: "CURRENT ROW"}
        return SqlWindow(self.partition, self.order, f"ROWS BETWEEN {edge[start]} AND {edge[stop]}")

    def text(self) -> str:
        parts = [f"PARTITION BY {', '.join(map(_text, self.partition))}" if self.partition else "", f"ORDER BY {', '.join(map(_text, self.order))}" if self.order else "", self.frame]
        return " ".join(p for p in parts if p)


class SqlFunctions:
    """pyspark.sql.functions as far as the compiler calls them."""

    def col(self, name: str) -> Sql:
        return Sql(name)

    def lit(self, value) -> Sql:
        return value if isinstance(value, Sql) else Sql(literal(value))

    def when(self, condition, value) -> _Case:
        return _Case(((_text(condition), _text(value)),))

    def count_distinct(self, x) -> Sql:
        return Sql(f"count(DISTINCT {_text(x)})")

    def timestamp_diff(self, unit: str, a, b) -> Sql:
        return Sql(f"timestampdiff({unit}, {_text(a)}, {_text(b)})")

    def call_function(self, name: str, *args) -> Sql:
        return Sql(f"({_text(args[0])} {name} {_text(args[1])})") if name == "div" else getattr(self, name)(*args)

    def product(self, x) -> Sql:
        return _Product(f"aggregate(collect_list({_text(x)}), 1D, (a, b) -> a * b)", _text(x))

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return lambda *args: Sql(f"{_NAMES.get(name, name)}({', '.join(map(_text, args))})")


class _Product(Sql):
    """SQL has no product: the window goes on the list of the factors."""

    def __init__(self, text: str, x: str):
        super().__init__(text)
        self.x = x

    def over(self, window: SqlWindow) -> Sql:
        return Sql(f"aggregate(collect_list({self.x}) OVER ({window.text()}), 1D, (a, b) -> a * b)")
