"""Schemas of functions on DataFrames, checked by names and types alone: no data is read."""

from __future__ import annotations

import functools
import inspect

from pyspark.sql import DataFrame

_state = {"on": True}


def schema_checks(on: bool | None = None) -> bool:
    """Whether checks run; sets it if asked to."""
    if on is not None:
        _state["on"] = on
    return _state["on"]


def non_null_types(frame) -> dict[str, set[type] | None]:
    """The Python types of each column's values in a local (pandas) table, without missing ones; None where all are missing."""
    out = {}
    for name in frame.columns:
        kinds = {type(v) for v in frame[name] if not _missing(v)}
        out[name] = kinds or None
    return out


def _missing(v) -> bool:
    return v is None or type(v).__name__ in ("NAType", "NaTType") or isinstance(v, float) and v != v


def _unlike(value, want) -> str | None:
    """What keeps a value from a specification: a type, a set of them, or {column: type} of a table; None for anything."""
    if want is None:
        return None
    if isinstance(want, dict):
        return "; ".join(problems(value, want)) or None
    kinds = tuple(want) if isinstance(want, (set, frozenset)) else (want,)
    return None if isinstance(value, kinds) else f"{type(value).__name__} is not {' or '.join(sorted(k.__name__ for k in kinds))}"


def problems(df: object, want: dict) -> list[str]:
    """What a table lacks of {column: type, set of types or None}.

    Types of a DataFrame are Spark's simple names, and no data is read; those of a local table are Python's, held against
    each value that isn't missing.
    """
    if not isinstance(df, DataFrame):
        if not (hasattr(df, "columns") and hasattr(df, "iloc")):
            return [f"{type(df).__name__} is no table"]
        out = [f"column {c} is missing" for c in want if c not in set(df.columns)]
        for name, kinds in want.items():
            if kinds is not None and name in set(df.columns):
                bad = next((u for v in df[name] if not _missing(v) and (u := _unlike(v.item() if hasattr(v, "item") else v, kinds))), None)
                out += [f"column {name}: {bad}"] if bad else []
        return out
    have = dict(df.dtypes)
    out = []
    for name, kinds in want.items():
        kinds = {kinds} if isinstance(kinds, str) else kinds
        if name not in have:
            out.append(f"column {name} is missing")
        elif kinds and have[name] not in kinds:
            out.append(f"column {name} is {have[name]}, not {' or '.join(sorted(kinds))}")
    return out


def mock_schema(arguments: dict[str, dict] | None = None, returns: dict | None = None):
    """Decorator that checks nothing: the schema stands in the source, and f stays what it is."""
    return lambda f: f


def check_schema(arguments: dict[str, dict] | None = None, returns: dict | None = None):
    """Decorator: TypeError where an argument or the result lacks columns or types."""

    def wrap(f):
        signature = inspect.signature(f)

        @functools.wraps(f)
        def inner(*args, **kwargs):
            if not _state["on"]:
                return f(*args, **kwargs)
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            found = [f"{a}: {p}" for a, want in (arguments or {}).items() if (p := _unlike(bound.arguments.get(a), want))]
            if found:
                raise TypeError("; ".join(found))
            out = f(*args, **kwargs)
            if p := _unlike(out, returns):
                raise TypeError(f"result: {p}")
            return out

        inner.schema = (arguments, returns)
        return inner

    return wrap
