"""Expression trees and the parser of their string form.  No Spark here."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

#: Binary operators as (spelling, binding strength); ** binds tighter still and to the right.
BINARY = {"or": 1, "and": 2, "<": 4, ">": 4, "<=": 4, ">=": 4, "==": 4, "!=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "%+%": 6, "%?%": 6, "%/%": 6}
ALIASES = {"%+%": "concat", "%?%": "coalesce", "<>": "!="}
TYPE_GROUPS = {bool: "bool", int: "number", float: "number", str: "string"}


class Term:
    """Anything that can stand in a larger expression.  Operators build expressions; `is_equal` compares."""

    def is_equal(self, other: object) -> bool:
        return isinstance(other, Term) and self.key() == other.key()

    def key(self) -> tuple:
        raise NotImplementedError

    def columns(self) -> set[str]:
        return set()

    def calls(self) -> Iterator[Call]:
        return iter(())

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use and/or in strings, & and | on objects")

    def __hash__(self) -> int:
        return hash(self.key())

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return lambda *args: call(name, self, *args)

    def __repr__(self) -> str:
        return to_source(self)


def _operator(name: str, swapped: bool = False):
    def build(self, other):
        return call(name, other, self) if swapped else call(name, self, other)

    return build


for _method, _op in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "floordiv": "//", "mod": "%", "pow": "**", "and": "and", "or": "or", "xor": "^"}.items():
    setattr(Term, f"__{_method}__", _operator(_op))
    setattr(Term, f"__r{_method}__", _operator(_op, True))
for _method, _op in {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    setattr(Term, f"__{_method}__", _operator(_op))
Term.__neg__ = lambda self: call("neg", self)
Term.__invert__ = lambda self: call("==", self, False)


@dataclass(frozen=True, eq=False, repr=False)
class Lit(Term):
    value: bool | int | float | str | None

    def key(self):
        return ("lit", type(self.value).__name__, self.value)


@dataclass(frozen=True, eq=False, repr=False)
class Col(Term):
    name: str

    def key(self):
        return ("col", self.name)

    def columns(self):
        return {self.name}


@dataclass(frozen=True, eq=False, repr=False)
class ListArg(Term):
    values: tuple

    def key(self):
        return ("list", self.values)


@dataclass(frozen=True, eq=False, repr=False)
class DictArg(Term):
    items: tuple

    def key(self):
        return ("dict", self.items)


@dataclass(frozen=True, eq=False, repr=False)
class Call(Term):
    op: str
    args: tuple

    def key(self):
        return ("call", self.op, *(a.key() for a in self.args))

    def columns(self):
        return set().union(*(a.columns() for a in self.args))

    def calls(self):
        yield self
        for a in self.args:
            yield from a.calls()


def _same_kind(values) -> None:
    kinds = {TYPE_GROUPS.get(type(v)) for v in values}
    if None in kinds or len(kinds) != 1:
        raise ValueError(f"values must be non-null literals of one type: {list(values)!r}")


def as_term(v: object) -> Term:
    if isinstance(v, Term):
        return v
    if isinstance(v, (list, tuple, set, frozenset)):
        values = tuple(x.value if isinstance(x, Lit) else x for x in v)
        _same_kind(values)
        return ListArg(tuple(dict.fromkeys(values)))
    if isinstance(v, dict):
        items = tuple((k.value if isinstance(k, Lit) else k, x.value if isinstance(x, Lit) else x) for k, x in v.items())
        _same_kind([k for k, _ in items])
        _same_kind([x for _, x in items])
        return DictArg(items)
    if v is None or type(v) in TYPE_GROUPS:
        return Lit(v)
    raise TypeError(f"no literal: {v!r}")


def col(name: str) -> Col:
    return Col(name)


def lit(value) -> Lit:
    return Lit(value)


def one() -> Lit:
    return Lit(1)


def connected_components(f, g) -> Call:
    return call("connected_components", f, g)


#: Functions whose later arguments may be a null literal.
_NULL_OK = {"if_else", "where", "mapv"}


def call(op: str, *args) -> Term:
    """An expression of a known function, checked as far as literals go."""
    from ..functions.registry import lookup

    terms = tuple(as_term(a) for a in args)
    op = ALIASES.get(op, op)
    spec = lookup(op)
    if not spec.least <= len(terms) <= spec.most:
        raise ValueError(f"{op} takes {spec.least} to {spec.most} arguments, not {len(terms)}")
    for i, t in enumerate(terms):
        if isinstance(t, Lit) and t.value is None and not (i and op in _NULL_OK):
            raise ValueError(f"None may not be an operand of {op}")
        if isinstance(t, (ListArg, DictArg)) and (op, type(t)) not in {("is_in", ListArg), ("mapv", DictArg)}:
            raise ValueError(f"{op} takes no collection")
    if op in ("==", "!=", "<", "<=", ">", ">=") and all(isinstance(t, Lit) for t in terms) and TYPE_GROUPS[type(terms[0].value)] != TYPE_GROUPS[type(terms[1].value)]:
        raise TypeError(f"{terms[0]} and {terms[1]} don't compare")
    if op == "neg" and isinstance(terms[0], Lit) and type(terms[0].value) in (int, float):
        return Lit(-terms[0].value)
    if op == "**" and isinstance(terms[1], Lit) and terms[1].value == 1 and type(terms[1].value) is int:
        return terms[0]
    if op == "mapv" and not isinstance(terms[1], DictArg) or op == "is_in" and not isinstance(terms[1], ListArg):
        raise ValueError(f"{op} needs a literal collection")
    if op in ("shift", "around", "trimstr", "mapv", "parse_date", "parse_datetime", "format_date", "format_datetime") and not all(isinstance(t, (Lit, DictArg)) for t in terms[1:]):
        raise ValueError(f"{op} takes literals after its first argument")
    if op == "shift" and len(terms) > 1 and (type(terms[1].value) is not int or terms[1].value == 0):
        raise ValueError("shift takes a whole number other than 0")
    if op in ("+", "*", "and", "or"):  # one flat node for a chain
        terms = tuple(x for t in terms for x in (t.args if isinstance(t, Call) and t.op == op else (t,)))
    return Call(op, terms)


_TOKEN = re.compile(
    r"""\s*(?:(?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?(?![\w.]))|(?P<name>[^\W\d]\w*)|(?P<quoted>`[^`]+`)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""
    r"""|(?P<op>%\+%|%\?%|%/%|\*\*|//|<=|>=|==|!=|<>|[-+*/%<>()\[\]{},.:]))"""
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


class _Parser:
    def __init__(self, text: str, columns):
        self.columns, self.at, self.tokens = columns, 0, []
        i, text = 0, text.rstrip()
        while i < len(text):
            m = _TOKEN.match(text, i)
            if not m:
                raise ValueError(f"not in the expression language at {text[i:i + 10]!r} of {text!r} (use and, or, not, ==)")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            i = m.end()
        self.tokens.append(("end", ""))

    @property
    def now(self) -> str:
        return self.tokens[self.at][1] if self.tokens[self.at][0] in ("op", "name", "end") else ""

    def take(self, want: str | None = None) -> tuple[str, str]:
        kind, text = self.tokens[self.at]
        if want is not None and self.now != want:
            raise ValueError(f"expected {want!r}, found {text!r}")
        self.at += 1
        return kind, text

    def whole(self) -> Term:
        out = self.binary(1)
        if self.tokens[self.at][0] != "end":
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def binary(self, least: int) -> Term:
        if least == 3 and self.now == "not":
            self.take()
            return call("==", self.binary(3), False)
        if least > 6:
            return self.unary()
        left = self.binary(least + 1)
        while (op := ALIASES.get(self.now, self.now) if self.now == "<>" else self.now) and BINARY.get(op) == least:
            self.take()
            left = call(op, left, self.binary(least + 1))
        return left

    def unary(self) -> Term:
        if self.now in ("-", "+"):
            sign = self.take()[1]
            inner = self.unary()
            return call("neg", inner) if sign == "-" else inner
        base = self.atom()
        if self.now == "**":
            self.take()
            return call("**", base, self.unary())
        return base

    def arguments(self, close: str) -> list:
        out = []
        while self.now != close:
            out.append(self.binary(1))
            if self.now != close:
                self.take(",")
        self.take(close)
        return out

    def atom(self) -> Term:
        kind, text = self.take()
        if kind == "num":
            out: Term = Lit(float(text) if re.search(r"[.eE]", text) else int(text))
        elif kind == "str":
            out = Lit(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        elif kind == "quoted":
            out = self.column(text[1:-1])
        elif kind == "name" and text in ("True", "False", "None"):
            out = Lit({"True": True, "False": False, "None": None}[text])
        elif kind == "name" and self.now == "(" and text not in BINARY and text != "not":
            self.take("(")
            out = call(text, *self.arguments(")"))
        elif kind == "name" and text not in BINARY and text != "not":
            out = self.column(text)
        elif text == "(":
            inside = self.arguments(")")
            if not inside:
                raise ValueError("empty parentheses")
            out = inside[0] if len(inside) == 1 else self.collection(inside)
        elif text == "[":
            out = self.collection(self.arguments("]"))
        elif text == "{":
            out = self.braces()
        else:
            raise ValueError(f"unexpected {text or 'end'!r}")
        while self.now == ".":
            self.take()
            name = self.take()[1]
            self.take("(")
            out = call(name, out, *self.arguments(")"))
        return out

    def column(self, name: str) -> Col:
        if self.columns is not None and name not in self.columns:
            raise NameError(f"unknown column {name!r}")
        return Col(name)

    def collection(self, values: list) -> Term:
        if not values or not all(isinstance(v, Lit) for v in values):
            raise ValueError("collections hold literals only")
        return as_term([v.value for v in values])

    def braces(self) -> Term:
        first = self.binary(1)
        if self.now != ":":
            if self.now == ",":
                self.take()
            return self.collection([first, *self.arguments("}")])
        items, key = {}, first
        while True:
            self.take(":")
            items[key.value] = self.binary(1).value
            if self.now == "}":
                break
            self.take(",")
            if self.now == "}":
                break
            key = self.binary(1)
        self.take("}")
        return as_term(items)


def parse(text: str, columns=None) -> Term:
    """The expression of a string; names are columns, and with `columns` given they must be among these."""
    return _Parser(text, columns).whole()


def parse_assignments(ops, columns) -> dict[str, Term]:
    """{name: expression} of a dict or list of pairs; no assignment may read what another one makes."""
    pairs = list(ops.items()) if isinstance(ops, dict) else [tuple(p) for p in ops]
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("a column is assigned twice")
    out = {}
    for name, v in pairs:
        t = parse(v, set(columns)) if isinstance(v, str) else as_term(v)
        if unknown := t.columns() - set(columns):
            raise NameError(f"unknown columns {sorted(unknown)}")
        out[name] = t
    for name, t in out.items():
        if clash := (t.columns() & out.keys()) - {name}:
            raise ValueError(f"{name} reads {sorted(clash)}, which the same step assigns")
    return out


def _quote(name: str) -> str:
    return name if re.fullmatch(r"[^\W\d]\w*", name) and name not in {*BINARY, "not", "True", "False", "None"} else f"`{name}`"


def to_source(t: Term, strength: int = 0) -> str:
    """A string that parses to the same tree."""
    if isinstance(t, Col):
        return _quote(t.name)
    if isinstance(t, Lit):
        text = repr(t.value)
        return f"({text})" if strength and text.startswith("-") else text
    if isinstance(t, ListArg):
        return "[" + ", ".join(map(repr, t.values)) + "]"
    if isinstance(t, DictArg):
        return "{" + ", ".join(f"{k!r}: {v!r}" for k, v in t.items) + "}"
    if t.op in BINARY:
        own = BINARY[t.op]
        text = f" {t.op} ".join(to_source(a, own + (i > 0)) for i, a in enumerate(t.args))
        return f"({text})" if own < strength else text
    if t.op == "**":
        return f"({to_source(t.args[0], 9)} ** {to_source(t.args[1], 9)})"
    if t.op == "neg":
        return f"(-{to_source(t.args[0], 8)})"
    if not t.args or t.op == "connected_components":
        return f"{t.op}({', '.join(map(to_source, t.args))})"
    first = t.args[0]
    head = to_source(first, 9) if isinstance(first, (Col, Call)) else f"({to_source(first)})"
    return f"{head}.{t.op}({', '.join(to_source(a) for a in t.args[1:])})"
