"""One entry per function: its arguments, where it may stand, and its Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

#: Contexts: e row by row, g window without order, w window with order, p project, u without arguments.
CONTEXTS = frozenset("egwpu")


@dataclass(frozen=True)
class Function:
    name: str
    contexts: frozenset[str]
    least: int = 1
    most: int = 1
    build: Callable | None = field(default=None, compare=False)
    user: bool = False
    sql: str | None = None


_FUNCTIONS: dict[str, Function] = {}


def _names(text: str, contexts: str, least: int = 1, most: int | None = None) -> None:
    for name in text.split():
        _FUNCTIONS[name] = Function(name, frozenset(contexts), least, least if most is None else most)


_names("+ * and or", "e", 2, 999)
_names("- / // % ** == != < <= > >= ^ %/% float_divide mod remainder maximum minimum fmax fmin concat coalesce is_in arctan2 timestamp_diff date_diff", "e", 2)
_names(
    "neg abs sign sqrt exp expm1 log log10 log1p sin cos sinh cosh tanh arcsin arccos arctan arcsinh arccosh arctanh floor ceil round as_int64 as_str is_null is_nan is_inf is_bad "
    "coalesce_0 datetime_to_date dayofweek dayofyear dayofmonth weekofyear month quarter year base_Sunday",
    "e",
)
_names("if_else where trimstr", "e", 3)
_names("mapv", "e", 2, 3)
_names("around", "e", 2)
_names("parse_date parse_datetime format_date format_datetime", "e", 1, 2)
_names("sum count size mean median min max nunique std var any all any_value", "gp")
_names("cumsum cumprod cummax cummin cumcount ffill bfill first last", "w")
_names("is_monotonic_increasing is_monotonic_decreasing", "w")
_names("shift", "w", 1, 2)
_names("rank", "gw")
_names("_count _size", "gp", 0)
_names("_row_number", "w", 0)
_names("_ngroup", "g", 0)
_names("_uniform", "u", 0)
_names("connected_components co_equalizer", "u", 2)

#: Windows that need an order, and those that must not have one.
NEED_ORDER = frozenset("cumsum cumprod cummax cummin cumcount shift _row_number ffill bfill first last is_monotonic_increasing is_monotonic_decreasing".split())
NO_ORDER = frozenset("count max min sum std var".split())
WINDOWED = frozenset(n for n, f in _FUNCTIONS.items() if f.contexts & {"g", "w"})


def lookup(name: str) -> Function:
    if name not in _FUNCTIONS:
        raise KeyError(f"unknown function {name!r}")
    return _FUNCTIONS[name]


def functions() -> dict[str, Function]:
    """The catalogue: every function by name."""
    return dict(_FUNCTIONS)


def register_function(name: str, build: Callable, *, least: int = 1, most: int | None = None, context: str = "e", sql: str | None = None) -> None:
    """Makes build(*columns) -> Column, a Spark or pandas UDF among others, callable as `name` (context e or p).

    sql is its text for plans that are written as SQL, with {0}, {1} ... for the arguments.
    """
    if name in _FUNCTIONS and not _FUNCTIONS[name].user:
        raise ValueError(f"{name} is built in")
    _FUNCTIONS[name] = Function(name, frozenset(context), least, most or least, build, True, sql)


def unregister_function(name: str) -> None:
    if name in _FUNCTIONS and _FUNCTIONS[name].user:
        del _FUNCTIONS[name]
