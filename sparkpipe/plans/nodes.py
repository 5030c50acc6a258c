"""Operator nodes: immutable, validated while they are built, compiled to one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from .expr import Call, Col, Lit, Term, parse, parse_assignments, to_source

JOINS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "OUTER": "full", "FULL": "full", "CROSS": "cross"}


def _listed(names) -> tuple[str, ...]:
    return (names,) if isinstance(names, str) else tuple(names or ())


def _known(names: Iterable[str], columns: Iterable[str], error: type[Exception] = KeyError) -> None:
    if missing := [n for n in names if n not in set(columns)]:
        raise error(f"unknown columns {missing}")


def _text(v) -> str:
    return repr(list(v) if isinstance(v, tuple) else v)


class Plan:
    """A pipeline.  Builder methods give a new plan; `transform` and `evaluate` give a DataFrame."""

    columns: tuple[str, ...]
    sources: tuple[Plan, ...] = ()

    # building

    def _bare(self) -> Plan:
        """Without an order that the next step would lose anyway."""
        return self.source if isinstance(self, OrderRows) and self.limit is None else self

    def extend(self, ops, *, partition_by=None, order_by=None, reverse=None) -> Plan:
        """Adds or replaces columns, row by row or over windows; partition_by=1 is one partition of all rows."""
        src = self._bare()
        whole = type(partition_by) is int and partition_by == 1
        made = parse_assignments(ops, src.columns)
        if not made:
            return src
        part, order = () if whole else _listed(partition_by), _listed(order_by)
        node = Extend(src, tuple(made.items()), part, order, _listed(reverse), whole)
        if isinstance(src, Extend) and not node.windowed and not src.windowed and "connected_components" not in str(node.ops):
            before, now = dict(src.ops), dict(node.ops)
            if not any(t.columns() & before.keys() for t in now.values()) and not any(t.columns() & now.keys() for k, t in before.items() if k not in now):
                return Extend(src.source, tuple({**before, **now}.items()), (), (), (), False)
        return node

    def project(self, ops=None, *, group_by=None) -> Plan:
        """One row per group: keys, then aggregates; distinct keys without ops; one row without keys."""
        src = self._bare()
        return Project(src, tuple(parse_assignments(ops or {}, src.columns).items()), _listed(group_by))

    def select_rows(self, expr) -> Plan:
        if expr is None or isinstance(expr, (list, tuple)) and not expr:
            return self
        src, terms = self._bare(), list(expr) if isinstance(expr, (list, tuple)) else [expr]
        out: Term | None = None
        for t in terms:
            t = parse(t, set(src.columns)) if isinstance(t, str) else t
            out = t if out is None else out & t
        return SelectRows(src, out)

    def select_columns(self, columns) -> Plan:
        names = _listed(columns)
        if names == self.columns:
            return self
        src = self._bare()
        if isinstance(src, (SelectColumns, DropColumns)):
            _known(names, src.columns)
            src = src.source
        return SelectColumns(src, names)

    def drop_columns(self, columns) -> Plan:
        return DropColumns(self._bare(), _listed(columns)) if _listed(columns) else self

    def rename_columns(self, mapping: dict[str, str]) -> Plan:
        """{new: old}, all at once."""
        return RenameColumns(self._bare(), tuple(mapping.items())) if mapping else self

    def map_columns(self, mapping: dict[str, str | None]) -> Plan:
        """{old: new}, None deletes."""
        return MapColumns(self._bare(), tuple(mapping.items())) if mapping else self

    def order_rows(self, columns=(), *, reverse=None, limit: int | None = None) -> Plan:
        if not _listed(columns) and limit is None:
            return self
        return OrderRows(self._bare(), _listed(columns), _listed(reverse), limit)

    def natural_join(self, b: Plan, *, on=(), jointype: str = "INNER", check_all_common_keys_in_equi_spec: bool = False, hint: str | None = None) -> Plan:
        """Equi or cross join; columns of both sides are coalesced, left first."""
        if isinstance(on, str):
            pairs = ((on, on),)
        elif isinstance(on, dict):
            pairs = tuple(on.items())
        else:
            pairs = tuple((p, p) if isinstance(p, str) else tuple(p) for p in on or ())
        a, b = self._bare(), b._bare()
        if check_all_common_keys_in_equi_spec and (free := set(a.columns) & set(b.columns) - {x for x, y in pairs if x == y}):
            raise ValueError(f"shared columns {sorted(free)} are no keys")
        return NaturalJoin(a, b, pairs, jointype.upper(), hint)

    def concat_rows(self, b: Plan, *, id_column: str | None = "source_name", a_name: str = "a", b_name: str = "b") -> Plan:
        return ConcatRows(self._bare(), b._bare(), id_column, a_name, b_name)

    def convert_records(self, record_map, *, validate: bool = False) -> Plan:
        return ConvertRecords(self._bare(), record_map, validate)

    def map_records(self, *, blocks_in=None, blocks_out=None, strict: bool = True, validate: bool = False) -> Plan:
        from ..operators.records import RecordMap

        return self.convert_records(RecordMap(blocks_in=blocks_in, blocks_out=blocks_out, strict=strict), validate=validate)

    def replicate_rows(self, count_column: str, *, seq_column: str = "seq") -> Plan:
        """Each row as often as its count says, numbered from 0; none for null or less than 1."""
        return ReplicateRows(self._bare(), count_column, seq_column)

    def use(self, f: Callable, *args, **kwargs):
        return f(self, *args, **kwargs)

    # running

    def evaluate(self, tables: dict | None = None, *, strict: bool = False):
        """The lazy DataFrame of the plan over tables by name (a bound DataFrame serves where none is given)."""
        return evaluate(self, tables, strict=strict)

    def transform(self, df, *, strict: bool = False):
        """The plan of one table over df."""
        names = list(self.tables())
        if len(names) != 1:
            raise ValueError(f"transform needs a plan of one table, not {names}")
        return evaluate(self, {names[0]: df}, strict=strict)

    def ex(self):
        """The plan over the DataFrames bound to its tables."""
        return evaluate(self, None)

    def __rrshift__(self, other):
        return self.act_on(other)

    def __rshift__(self, other):
        if hasattr(other, "act_on"):
            return other.act_on(self)
        return other(self)

    def __call__(self, other):
        return self.act_on(other)

    def act_on(self, other):
        """On a plan or a dict of plans: the composed plan.  On DataFrames: the result."""
        if isinstance(other, dict):
            if other and all(isinstance(v, Plan) for v in other.values()):
                return self.replace_leaves(other)
            return self.evaluate(other)
        if not isinstance(other, Plan):
            return self.transform(other)
        names = list(self.tables())
        if len(names) != 1:
            raise ValueError("composition needs a plan of one table")
        return self.replace_leaves({names[0]: other})

    def replace_leaves(self, leaves: dict[str, Plan]) -> Plan:
        """The plan with tables replaced by plans of exactly their columns, rebuilt by the builders."""
        memo: dict[int, Plan] = {}

        def go(p: Plan) -> Plan:
            if id(p) not in memo:
                if isinstance(p, Table) and p.name in leaves:
                    new = leaves[p.name]
                    if set(new.columns) != set(p.columns):
                        raise ValueError(f"{p.name} has columns {sorted(p.columns)}, not {sorted(new.columns)}")
                    memo[id(p)] = new
                else:
                    memo[id(p)] = p.rebuilt([go(s) for s in p.sources]) if p.sources else p
            return memo[id(p)]

        return go(self)

    # looking

    def tables(self) -> dict[str, Table]:
        out: dict[str, Table] = {}
        for s in self.sources:
            for name, t in s.tables().items():
                if name in out and out[name].columns != t.columns:
                    raise ValueError(f"table {name} stands for two things")
                out[name] = t
        return out

    def nodes(self) -> list[Plan]:
        seen: dict[int, Plan] = {}

        def go(p: Plan) -> None:
            if id(p) not in seen:
                for s in p.sources:
                    go(s)
                seen[id(p)] = p

        go(self)
        return list(seen.values())

    def needs(self, using: set[str]) -> list[set[str]]:
        """For each source, the columns that the columns `using` of this node need."""
        return [set(s.columns) for s in self.sources]

    def columns_used(self, using: Iterable[str] | None = None) -> dict[str, set[str]]:
        """Columns of each table that the result hangs on."""
        out: dict[str, set[str]] = {}

        def go(p: Plan, want: set[str]) -> None:
            if isinstance(p, Table):
                out.setdefault(p.name, set()).update(want & set(p.columns))
            for s, w in zip(p.sources, p.needs(want), strict=True):
                go(s, w)

        go(self, set(self.columns if using is None else using))
        return out

    def columns_produced(self) -> list[str]:
        return list(self.columns)

    def methods_used(self) -> set[tuple[str, str]]:
        """(function, context): e, g, w or p."""
        out = set()
        for n in self.nodes():
            if isinstance(n, (Extend, Project)):
                where = "p" if isinstance(n, Project) else ("w" if n.order_by else "g") if n.windowed else "e"
                for _, t in n.ops:
                    out |= {(c.op, where if c is t else "e") for c in t.calls()}
            elif isinstance(n, SelectRows):
                out |= {(c.op, "e") for c in n.expr.calls()}
        return out

    def as_table(self, name: str = "data_frame") -> Table:
        return Table(name, tuple(self.columns))

    def to_sql(self, tables: dict | None = None, options=None) -> str:
        """The plan as Spark SQL over its tables by name; options: a sparkpipe.plans.sql.SqlFormat."""
        from .sql import to_sql

        return to_sql(self, tables, options)

    def to_python(self, pretty: bool = False) -> str:
        """Source that `sparkpipe.plans.loader.load_plan` turns into an equal plan."""
        return self.source_text("\n    " if pretty else "")

    def __repr__(self) -> str:
        return self.to_python()

    def same(self) -> tuple:
        return (type(self).__name__, self.to_python())

    def __eq__(self, other) -> bool:
        return isinstance(other, Plan) and self.same() == other.same()

    def __hash__(self) -> int:
        return hash(self.same())

    def source_text(self, gap: str) -> str:
        raise NotImplementedError

    def rebuilt(self, sources: list[Plan]) -> Plan:
        raise NotImplementedError


def _checked(columns: Iterable[str]) -> tuple[str, ...]:
    columns = tuple(columns)
    if not columns:
        raise ValueError("a plan needs columns")
    if len({c.lower() for c in columns}) != len(columns):
        raise ValueError(f"columns repeat, or differ in case only: {columns}")
    return columns


@dataclass(frozen=True, eq=False, repr=False)
class Table(Plan):
    name: str
    columns: tuple[str, ...]
    frame: object = field(default=None, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "columns", _checked(self.columns))

    def tables(self):
        return {self.name: self}

    def source_text(self, gap):
        return f"table({self.name!r}, {list(self.columns)!r})"


@dataclass(frozen=True, eq=False, repr=False)
class SqlTable(Plan):
    """Rows of a Spark SQL text."""

    sql: str
    columns: tuple[str, ...]
    name: str = "sql"

    def __post_init__(self):
        object.__setattr__(self, "columns", _checked(self.columns))

    def source_text(self, gap):
        return f"sql_table({self.sql!r}, {list(self.columns)!r})"


@dataclass(frozen=True, eq=False, repr=False)
class _Unary(Plan):
    source: Plan

    @property
    def sources(self):
        return (self.source,)

    def rebuilt(self, sources):
        return replace(self, source=sources[0]._bare())


@dataclass(frozen=True, eq=False, repr=False)
class Extend(_Unary):
    ops: tuple[tuple[str, Term], ...]
    partition_by: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    reverse: tuple[str, ...] = ()
    whole: bool = False

    def __post_init__(self):
        from ..functions.registry import NEED_ORDER, NO_ORDER, WINDOWED, lookup

        columns, made = self.source.columns, dict(self.ops)
        _known((*self.partition_by, *self.order_by), columns, ValueError)
        if set(self.partition_by) & set(self.order_by) or set(self.reverse) - set(self.order_by):
            raise ValueError("partition and order columns must differ, and reversed ones be among the order's")
        if clash := set(made) & {*self.partition_by, *self.order_by}:
            raise ValueError(f"window columns {sorted(clash)} may not be assigned")
        tops = {t.op for t in made.values() if isinstance(t, Call)}
        windowed = bool(self.whole or self.partition_by or self.order_by or tops & WINDOWED)
        object.__setattr__(self, "windowed", windowed)
        graph = tops & {"connected_components", "co_equalizer"}
        if graph and (windowed or not all(isinstance(t, Call) and t.op in graph for t in made.values())):
            raise ValueError("graph functions stand alone in an extend without windows")
        for name, t in made.items():
            inner = [c.op for c in t.calls() if c is not t]
            if bad := [op for op in inner if "e" not in lookup(op).contexts and op != "_uniform"]:
                raise ValueError(f"{name}: {bad[0]} must be the outermost function")
            if not windowed:
                continue
            if not isinstance(t, Call) or inner or not (lookup(t.op).contexts & {"g", "w", "u"}) or not all(isinstance(a, (Col, Lit)) for a in t.args):
                raise ValueError(f"{name}: in a window each expression is one function of a column or literals")
            if self.order_by and t.op in NO_ORDER:
                raise ValueError(f"{name}: {t.op} takes no order")
            if not self.order_by and t.op in NEED_ORDER:
                raise ValueError(f"{name}: {t.op} needs order_by")
        object.__setattr__(self, "columns", _checked((*columns, *(k for k in made if k not in columns))))

    def needs(self, using):
        made = dict(self.ops)
        live = {k: t for k, t in made.items() if k in using}
        need = (using - made.keys()).union({*self.partition_by, *self.order_by} if live else (), *(t.columns() for t in live.values()))
        return [need or {self.source.columns[0]}]

    def source_text(self, gap):
        extra = f", partition_by={1 if self.whole else list(self.partition_by)!r}" if self.whole or self.partition_by else ""
        extra += f", order_by={list(self.order_by)!r}" if self.order_by else ""
        extra += f", reverse={list(self.reverse)!r}" if self.reverse else ""
        return f"{self.source.source_text(gap)}{gap}.extend({ {k: to_source(t) for k, t in self.ops}!r}{extra})"

    def rebuilt(self, sources):
        return sources[0].extend(dict(self.ops), partition_by=1 if self.whole else self.partition_by, order_by=self.order_by, reverse=self.reverse)


@dataclass(frozen=True, eq=False, repr=False)
class Project(_Unary):
    ops: tuple[tuple[str, Term], ...]
    group_by: tuple[str, ...] = ()

    def __post_init__(self):
        from ..functions.registry import lookup

        if not self.ops and not self.group_by:
            raise ValueError("project needs ops or group_by")
        _known(self.group_by, self.source.columns, ValueError)
        for name, t in self.ops:
            if name in self.group_by:
                raise ValueError(f"group column {name} may not be assigned")
            if not isinstance(t, Call) or "p" not in lookup(t.op).contexts or not all(isinstance(a, (Col, Lit)) for a in t.args):
                raise ValueError(f"{name}: project takes aggregates of one column or literal")
        object.__setattr__(self, "columns", _checked((*self.group_by, *(k for k, _ in self.ops))))

    def needs(self, using):
        return [set(self.group_by).union(*(t.columns() for k, t in self.ops if k in using)) or {self.source.columns[0]}]

    def source_text(self, gap):
        extra = f", group_by={list(self.group_by)!r}" if self.group_by else ""
        return f"{self.source.source_text(gap)}{gap}.project({ {k: to_source(t) for k, t in self.ops}!r}{extra})"


@dataclass(frozen=True, eq=False, repr=False)
class SelectRows(_Unary):
    expr: Term

    def __post_init__(self):
        _known(self.expr.columns(), self.source.columns, NameError)
        object.__setattr__(self, "columns", self.source.columns)

    def needs(self, using):
        return [using | self.expr.columns()]

    def source_text(self, gap):
        return f"{self.source.source_text(gap)}{gap}.select_rows({to_source(self.expr)!r})"


@dataclass(frozen=True, eq=False, repr=False)
class SelectColumns(_Unary):
    names: tuple[str, ...]

    def __post_init__(self):
        _known(self.names, self.source.columns)
        object.__setattr__(self, "columns", _checked(self.names))

    def needs(self, using):
        return [using]

    def source_text(self, gap):
        return f"{self.source.source_text(gap)}{gap}.select_columns({_text(self.names)})"


@dataclass(frozen=True, eq=False, repr=False)
class DropColumns(_Unary):
    names: tuple[str, ...]

    def __post_init__(self):
        _known(self.names, self.source.columns)
        object.__setattr__(self, "columns", _checked(c for c in self.source.columns if c not in self.names))

    def needs(self, using):
        return [using]

    def source_text(self, gap):
        return f"{self.source.source_text(gap)}{gap}.drop_columns({_text(self.names)})"


@dataclass(frozen=True, eq=False, repr=False)
class RenameColumns(_Unary):
    mapping: tuple[tuple[str, str], ...]

    def __post_init__(self):
        to = {old: new for new, old in self.mapping}
        _known(to, self.source.columns)
        if len(to) != len(self.mapping):
            raise ValueError("a column is renamed twice")
        object.__setattr__(self, "columns", _checked(to.get(c, c) for c in self.source.columns))

    def pairs(self):
        return list(zip(self.source.columns, self.columns, strict=True))

    def needs(self, using):
        return [{old for old, new in self.pairs() if new in using}]

    def source_text(self, gap):
        return f"{self.source.source_text(gap)}{gap}.rename_columns({dict(self.mapping)!r})"


@dataclass(frozen=True, eq=False, repr=False)
class MapColumns(_Unary):
    mapping: tuple[tuple[str, str | None], ...]

    def __post_init__(self):
        to = dict(self.mapping)
        _known(to, self.source.columns)
        object.__setattr__(self, "columns", _checked(to.get(c, c) for c in self.source.columns if to.get(c, c) is not None))

    def pairs(self):
        to = dict(self.mapping)
        return [(c, to.get(c, c)) for c in self.source.columns if to.get(c, c) is not None]

    def needs(self, using):
        return [{old for old, new in self.pairs() if new in using}]

    def source_text(self, gap):
        return f"{self.source.source_text(gap)}{gap}.map_columns({dict(self.mapping)!r})"


@dataclass(frozen=True, eq=False, repr=False)
class OrderRows(_Unary):
    by: tuple[str, ...]
    reverse: tuple[str, ...] = ()
    limit: int | None = None

    def __post_init__(self):
        _known(self.by, self.source.columns, ValueError)
        if set(self.reverse) - set(self.by) or self.limit is not None and self.limit < 0:
            raise ValueError("reversed columns must be among the order's, and the limit not negative")
        object.__setattr__(self, "columns", self.source.columns)

    def needs(self, using):
        return [using | set(self.by)]

    def source_text(self, gap):
        extra = f", reverse={list(self.reverse)!r}" if self.reverse else ""
        extra += f", limit={self.limit}" if self.limit is not None else ""
        return f"{self.source.source_text(gap)}{gap}.order_rows({_text(self.by)}{extra})"


@dataclass(frozen=True, eq=False, repr=False)
class NaturalJoin(Plan):
    a: Plan
    b: Plan
    on: tuple[tuple[str, str], ...]
    jointype: str
    hint: str | None = None

    def __post_init__(self):
        if self.jointype not in JOINS:
            raise KeyError(f"unknown join {self.jointype}")
        if self.jointype == "CROSS" and self.on:
            raise ValueError("a cross join takes no keys")
        if self.jointype != "CROSS" and not self.on:
            raise ValueError("a join without keys is a cross join: say CROSS")
        _known([x for x, _ in self.on], self.a.columns, ValueError)
        _known([y for _, y in self.on], self.b.columns, ValueError)
        object.__setattr__(self, "columns", _checked((*self.a.columns, *(c for c in self.b.columns if c not in self.a.columns))))
        self.tables()

    @property
    def sources(self):
        return (self.a, self.b)

    def needs(self, using):
        return [using & set(self.a.columns) | {x for x, _ in self.on} or {self.a.columns[0]}, using & set(self.b.columns) | {y for _, y in self.on} or {self.b.columns[0]}]

    def source_text(self, gap):
        on = [x if x == y else (x, y) for x, y in self.on]
        hint = f", hint={self.hint!r}" if self.hint else ""
        return f"{self.a.source_text(gap)}{gap}.natural_join({self.b.source_text('')}, on={on!r}, jointype={self.jointype!r}{hint})"

    def rebuilt(self, sources):
        return replace(self, a=sources[0]._bare(), b=sources[1]._bare())


@dataclass(frozen=True, eq=False, repr=False)
class ConcatRows(Plan):
    a: Plan
    b: Plan
    id_column: str | None
    a_name: str
    b_name: str

    def __post_init__(self):
        if set(self.a.columns) != set(self.b.columns):
            raise ValueError("both sides need the same columns")
        if self.id_column in self.a.columns:
            raise ValueError(f"{self.id_column} is a column already")
        object.__setattr__(self, "columns", _checked((*self.a.columns, *([self.id_column] if self.id_column is not None else []))))

    @property
    def sources(self):
        return (self.a, self.b)

    def needs(self, using):
        need = using & set(self.a.columns) or {self.a.columns[0]}
        return [need, set(need)]

    def source_text(self, gap):
        return f"{self.a.source_text(gap)}{gap}.concat_rows({self.b.source_text('')}, id_column={self.id_column!r}, a_name={self.a_name!r}, b_name={self.b_name!r})"

    def rebuilt(self, sources):
        return replace(self, a=sources[0]._bare(), b=sources[1]._bare())


@dataclass(frozen=True, eq=False, repr=False)
class ConvertRecords(_Unary):
    record_map: object
    validate: bool = False

    def __post_init__(self):
        _known(self.record_map.columns_needed, self.source.columns, ValueError)
        object.__setattr__(self, "columns", _checked(self.record_map.columns_produced))

    def needs(self, using):
        return [set(self.record_map.columns_needed)]

    def source_text(self, gap):
        return f"{self.source.source_text(gap)}{gap}.convert_records({self.record_map!r})"


@dataclass(frozen=True, eq=False, repr=False)
class ReplicateRows(_Unary):
    count_column: str
    seq_column: str

    def __post_init__(self):
        _known([self.count_column], self.source.columns, ValueError)
        if self.seq_column in self.source.columns:
            raise ValueError(f"{self.seq_column} is a column already")
        object.__setattr__(self, "columns", _checked((*self.source.columns, self.seq_column)))

    def needs(self, using):
        return [using - {self.seq_column} | {self.count_column}]

    def source_text(self, gap):
        return f"{self.source.source_text(gap)}{gap}.replicate_rows({self.count_column!r}, seq_column={self.seq_column!r})"


def table(name: str, columns: Iterable[str]) -> Table:
    return Table(name, tuple(columns))


def sql_table(sql: str, columns: Iterable[str]) -> SqlTable:
    return SqlTable(sql, tuple(columns))


def describe_table(frame, name: str = "data_frame") -> Table:
    """A leaf for a DataFrame, which stays bound to it; a string names a table of the session."""
    if isinstance(frame, str):
        from pyspark.sql import SparkSession

        name, frame = frame, SparkSession.active().table(frame)
    return Table(name, tuple(frame.columns), frame)


def concat_all(plans: list[Plan]) -> Plan:
    out = plans[0]
    for p in plans[1:]:
        out = out.concat_rows(p, id_column=None)
    return out


def evaluate(plan: Plan, tables: dict | None = None, *, strict: bool = False):
    from .compiler import compile_plan

    return compile_plan(plan, tables or {}, strict=strict)
