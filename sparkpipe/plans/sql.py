"""Plans as Spark SQL text: one common table expression a node, from the same compiler of expressions."""

from __future__ import annotations

import textwrap
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.columns import Expressions, kind_of
from ..functions.registry import lookup
from ..functions.sqltext import Sql, literal, quote_identifier, quote_string
from . import nodes as N
from .compiler import compiled_nodes
from .expr import Call, Lit


@dataclass(frozen=True)
class SqlFormat:
    """How the text looks: WITH or nested queries, the node beside its query, line layout; what is warned of.

    templates: SQL that stands in for a function, with {0}, {1} ... for its arguments, by the function's name.
    """

    use_with: bool = True
    annotate: bool = True
    indent: int = 2
    initial_commas: bool = False
    shared_once: bool = True
    warn_on_user_functions: bool = True
    templates: dict[str, str] = field(default_factory=dict, hash=False)


def to_sql(plan: N.Plan, tables: dict[str, DataFrame] | None = None, options: SqlFormat | None = None) -> str:
    """The plan as one query over its tables by name.  Column types come from tables, bound frames or the session.

    ValueError where a step has no SQL: graph components, and user functions that were registered without it.
    """
    options = options or SqlFormat()
    frames = compiled_nodes(plan, tables or {}, types_only=True)
    if options.warn_on_user_functions and (own := sorted({op for op, _ in plan.methods_used() if lookup(op).user})):
        warnings.warn(f"the text needs functions of the session: {own}", stacklevel=2)
    names: dict[int, str] = {}
    steps: list[tuple[str, str, N.Plan]] = []

    def source(p: N.Plan) -> str:
        if not options.use_with or not options.shared_once:
            return f"(\n{_inside(step(p), options)}\n)"
        if id(p) not in names:
            text = step(p)
            names[id(p)] = f"s{len(steps)}"
            steps.append((names[id(p)], text, p))
        return quote_identifier(names[id(p)])

    def step(p: N.Plan) -> str:
        text = _STEPS[type(p)](p, [frames[id(s)] for s in p.sources], [source(s) for s in p.sources], options)
        return f"{_note(p)}{text}" if options.annotate and not options.use_with else text

    last = step(plan)
    if not steps:
        return last
    comma = ",\n"
    with_ = comma.join(f"{_note(p) if options.annotate else ''}{quote_identifier(n)} AS (\n{_inside(t, options)}\n)" for n, t, p in steps)
    return f"WITH\n{with_}\n{_note(plan) if options.annotate else ''}{last}"


def _inside(text: str, options: SqlFormat) -> str:
    return textwrap.indent(text, " " * options.indent)


def _note(p: N.Plan) -> str:
    own = p.to_python()
    for s in p.sources:
        own = own.replace(s.to_python(), "..." if s is p.sources[0] else "_", 1)
    return f"-- {own}\n".replace("\n", " ", own.count("\n"))


def _select(items: list[str], rest: str, options: SqlFormat, distinct: bool = False) -> str:
    pad = " " * options.indent
    lines = f"\n{pad}, ".join(items) if options.initial_commas else f",\n{pad}".join(items)
    return f"SELECT{' DISTINCT' if distinct else ''}\n{pad}{'  ' if options.initial_commas else ''}{lines}\n{rest}"


def _assigned(columns, made: dict[str, Sql]) -> list[str]:
    return [made[c].alias(c).text if c in made else quote_identifier(c) for c in columns]


def _table(p: N.Table, frames, sources, options) -> str:
    return _select([quote_identifier(c) for c in p.columns], f"FROM {'.'.join(map(quote_identifier, p.name.split('.')))}", options)


def _sql_table(p: N.SqlTable, frames, sources, options) -> str:
    return _select([quote_identifier(c) for c in p.columns], f"FROM (\n{_inside(p.sql, options)}\n)", options)


def _order_of(e: Expressions, by, reverse) -> list[Sql]:
    return [e.name(c).desc_nulls_last() if c in reverse else e.name(c).asc_nulls_last() for c in by]


def _extend(p: N.Extend, frames, sources, options) -> str:
    (df,), (source,) = frames, sources
    e = Expressions(df, text=True, templates=options.templates)
    if any(isinstance(t, Call) and t.op in ("connected_components", "co_equalizer") for _, t in p.ops):
        raise ValueError("graph components have no SQL text")
    if not p.windowed:
        return _select(_assigned(p.columns, {k: e.column(t) for k, t in p.ops}), f"FROM {source}", options)
    order, made, steps = _order_of(e, p.order_by, p.reverse), {}, {}
    part = e.W.partitionBy(*map(e.name, p.partition_by))
    for k, t in p.ops:
        if t.op.startswith("is_monotonic"):
            x = e.column(t.args[0])
            before = e.F.lag(x).over(part.orderBy(*order))
            steps[k] = x >= before if t.op.endswith("increasing") else x <= before
        elif t.op == "_ngroup":
            by = [e.name(k).asc_nulls_last() for k in p.partition_by]
            made[k] = (e.F.dense_rank().over(e.W.orderBy(*by)) - 1).cast("bigint") if by else e.F.lit(0).cast("bigint")
        else:
            made[k] = e.windowed(t, list(p.partition_by), order)
    if steps:  # a window over a window takes a query of its own
        inner = _select([*(quote_identifier(c) for c in df.columns if c not in {**made, **steps}), *_assigned([*made, *steps], made | steps)], f"FROM {source}", options)
        made = {k: e.F.bool_and(e.F.coalesce(e.name(k), e.F.lit(True))).over(part) for k in steps}
        source = f"(\n{_inside(inner, options)}\n)"
    return _select(_assigned(p.columns, made), f"FROM {source}", options)


def _project(p: N.Project, frames, sources, options) -> str:
    keys = [quote_identifier(k) for k in p.group_by]
    if not p.ops:
        return _select(keys, f"FROM {sources[0]}", options, distinct=True)
    e, made = Expressions(frames[0], text=True, templates=options.templates), {}
    for name, t in p.ops:
        made[name] = e.aggregate(t)
        if t.op == "sum" and isinstance(t.args[0], Lit) and not keys:
            made[name] = e.F.coalesce(made[name], e.F.lit(0).cast("bigint"))
    return _select(_assigned(p.columns, made), f"FROM {sources[0]}" + (f"\nGROUP BY {', '.join(keys)}" if keys else ""), options)


def _select_rows(p: N.SelectRows, frames, sources, options) -> str:
    where = Expressions(frames[0], text=True, templates=options.templates).column(p.expr)
    return _select([quote_identifier(c) for c in p.columns], f"FROM {sources[0]}\nWHERE {where.text}", options)


def _select_columns(p, frames, sources, options) -> str:
    return _select([quote_identifier(c) for c in p.columns], f"FROM {sources[0]}", options)


def _renamed(p, frames, sources, options) -> str:
    return _select([f"{quote_identifier(old)} AS {quote_identifier(new)}" for old, new in p.pairs()], f"FROM {sources[0]}", options)


def _order(p: N.OrderRows, frames, sources, options) -> str:
    e = Expressions(frames[0], text=True, templates=options.templates)
    rest = f"\nORDER BY {', '.join(o.text for o in _order_of(e, p.by, p.reverse))}" if p.by else ""
    rest += f"\nLIMIT {p.limit}" if p.limit is not None else ""
    return _select([quote_identifier(c) for c in p.columns], f"FROM {sources[0]}{rest}", options)


def _join(p: N.NaturalJoin, frames, sources, options) -> str:
    a, b = ("`l`.", "`r`.")
    items = []
    for c in p.columns:
        q = quote_identifier(c)
        items.append(f"coalesce({a}{q}, {b}{q}) AS {q}" if c in p.a.columns and c in p.b.columns else f"{a if c in p.a.columns else b}{q}")
    kind = {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "full": "FULL", "cross": "CROSS"}[N.JOINS[p.jointype]]
    on = " AND ".join(f"{a}{quote_identifier(x)} = {b}{quote_identifier(y)}" for x, y in p.on)
    hint = f"/*+ {p.hint.upper()}(r) */ " if p.hint else ""
    text = _select(items, f"FROM {sources[0]} AS `l`\n{kind} JOIN {sources[1]} AS `r`" + (f"\nON {on}" if on else ""), options)
    return text.replace("SELECT", f"SELECT {hint}".rstrip(), 1)


def _concat(p: N.ConcatRows, frames, sources, options) -> str:
    sides = []
    for source, name in zip(sources, (p.a_name, p.b_name), strict=True):
        own = [f"{quote_string(name)} AS {quote_identifier(p.id_column)}"] if p.id_column is not None else []
        sides.append(_select([*(quote_identifier(c) for c in p.a.columns), *own], f"FROM {source}", options))
    return "\nUNION ALL\n".join(sides)


def _records(p: N.ConvertRecords, frames, sources, options) -> str:
    m, source, df = p.record_map, sources[0], frames[0]
    text = None
    if m.blocks_in is not None:
        spec, items = m.blocks_in, []
        for i in range(spec.n_rows):
            match = " AND ".join(f"CAST({quote_identifier(k)} AS STRING) = {quote_string(str(spec.control_table[k][i]))}" for k in spec.control_table_keys) or "TRUE"
            items += [f"max(CASE WHEN {match} THEN {quote_identifier(c)} END) AS {quote_identifier(spec.control_table[c][i])}" for c in spec.value_columns]
        keys = [quote_identifier(k) for k in spec.record_keys]
        text = _select([*keys, *items], f"FROM {source}" + (f"\nGROUP BY {', '.join(keys)}" if keys else ""), options)
        if m.blocks_out is None:
            return _select([quote_identifier(c) for c in p.columns], f"FROM (\n{_inside(text, options)}\n)", options)
        from ..operators.records import rows_of_blocks

        source, df = f"(\n{_inside(text, options)}\n)", rows_of_blocks(df, spec)
    spec, types = m.blocks_out, dict(zip(df.columns, df.schema, strict=True))
    from ..operators.records import common_types

    common = common_types(types, spec)
    cells = [
        literal(v[i]) if c in spec.control_table_keys else f"CAST({quote_identifier(v[i])} AS {common[c]})" for i in range(spec.n_rows) for c, v in spec.control_table.items()
    ]
    names = ", ".join(map(quote_identifier, spec.control_table))
    return _select([*map(quote_identifier, spec.record_keys), f"stack({spec.n_rows}, {', '.join(cells)}) AS ({names})"], f"FROM {source}", options)


def _replicate(p: N.ReplicateRows, frames, sources, options) -> str:
    n = f"CAST({quote_identifier(p.count_column)} AS BIGINT)"
    seq = f"explode(CASE WHEN {n} > 0 THEN sequence(0L, {n} - 1) END) AS {quote_identifier(p.seq_column)}"
    return _select([*map(quote_identifier, p.source.columns), seq], f"FROM {sources[0]}", options)


_STEPS = {
    N.Table: _table, N.SqlTable: _sql_table, N.Extend: _extend, N.Project: _project, N.SelectRows: _select_rows, N.SelectColumns: _select_columns, N.DropColumns: _select_columns,
    N.RenameColumns: _renamed, N.MapColumns: _renamed, N.OrderRows: _order, N.NaturalJoin: _join, N.ConcatRows: _concat, N.ConvertRecords: _records, N.ReplicateRows: _replicate,
}
__all__ = ["SqlFormat", "kind_of", "to_sql"]
