"""Ready-made plans."""

from __future__ import annotations

from ..plans.expr import Lit, call, col
from ..plans.nodes import Plan, table
from .records import RecordSpecification


def last_observed_carried_forward(plan: Plan, *, value_column: str, order_by, partition_by=(), bad_values: str | None = None) -> Plan:
    """Missing values take the last one before them; bad_values is an expression of what else counts as missing."""
    if bad_values is not None:
        plan = plan.extend({value_column: f"({bad_values}).where(None, `{value_column}`)"})
    return plan.extend({value_column: col(value_column).ffill()}, partition_by=partition_by, order_by=order_by)


def braid(state: Plan, event: Plan, *, order_by: str, partition_by=(), state_columns, event_columns, source_column: str = "record_type", types: dict[str, str]) -> Plan:
    """State and event rows in one order; each event carries the state before it, state rows at one time come first.

    types: "number" or "string" for each state and event column, for the nulls of the other side.
    """
    parts, lead = [partition_by] if isinstance(partition_by, str) else list(partition_by), f"_{source_column}_at"
    null = {"number": "0.0", "string": "''"}
    keep = [*parts, order_by, *state_columns, *event_columns]
    empty = lambda names: {c: f"(1 == 0).where({null[types[c]]}, None)" for c in names}
    a = state.extend(empty(event_columns)).select_columns(keep).extend({lead: Lit(0)})
    b = event.extend(empty(state_columns)).select_columns(keep).extend({lead: Lit(1)})
    both = a.concat_rows(b, id_column=source_column, a_name="state", b_name="event")
    return both.extend({c: col(c).ffill() for c in state_columns}, partition_by=parts or 1, order_by=[order_by, lead]).drop_columns([lead])


def rank_to_average(plan: Plan, *, rank_column: str, value_column: str, partition_by=()) -> Plan:
    """Average rank of a column's values; ties share the mean of their places."""
    return plan.extend({rank_column: col(value_column).rank()}, partition_by=partition_by or 1)


def replicate_rows(plan: Plan, *, count_column: str, seq_column: str = "seq") -> Plan:
    """Each row as often as its count says, numbered from 0; none for null or less than 1."""
    return plan.replicate_rows(count_column, seq_column=seq_column)


def multi_column_map(d: Plan, mapping: Plan, *, row_keys, columns, name_key: str = "column_name", value_key: str = "column_value", mapped_key: str = "mapped_value", default=None) -> Plan:
    """Maps columns of d through one (column, value) -> mapped table: unpivot, left join, pivot."""
    shape = RecordSpecification({name_key: list(columns), value_key: list(columns)}, tuple(row_keys), (name_key,))
    out = RecordSpecification({name_key: list(columns), mapped_key: list(columns)}, tuple(row_keys), (name_key,))
    joined = d.select_columns([*row_keys, *columns]).convert_records(shape.map_from_rows()).natural_join(mapping, on=[name_key, value_key], jointype="LEFT")
    if default is not None:
        joined = joined.extend({mapped_key: call("coalesce", col(mapped_key), default)})
    return joined.select_columns([*row_keys, name_key, mapped_key]).convert_records(out.map_to_rows())


def xicor(plan: Plan, *, x: str, y: str, group_by=(), tie_break=(), result: str = "xicor") -> Plan:
    """Chatterjee's rank correlation of y on x per group.  Ties of x go by tie_break, a total order in place of chance.

    Groups are numbered, and places and steps are those of the whole table in the groups' order, so that a group of any
    size is many tasks' work.
    """
    group = [group_by] if isinstance(group_by, str) else list(group_by)
    ties = [tie_break] if isinstance(tie_break, str) else list(tie_break)
    p = plan.select_columns(list(dict.fromkeys([*group, x, y, *ties]))).select_rows(f"not (`{x}`.is_null() or `{y}`.is_null())")
    p = p.extend({"_group": "_ngroup()"}, partition_by=group) if group else p.extend({"_group": Lit(0)})
    # the largest place of a tie, counted on through the groups
    places = p.project({"_same": Lit(1).sum()}, group_by=["_group", y]).extend({"_place": col("_same").cumsum()}, order_by=["_group", y])
    ends = places.project({"_n": col("_same").sum(), "_end": col("_place").max()}, group_by=["_group"])
    p = p.natural_join(places.natural_join(ends, on=["_group"], jointype="INNER"), on=["_group", y], jointype="INNER", hint="merge")
    p = p.extend({"_before": col("_place").shift()}, order_by=["_group", x, *ties])
    p = p.extend({"_l": "(_end - _place + _same) * 1.0"})  # places from above
    p = p.extend({"_step": "(_before > _end - _n).where((_place - _before).abs() * 1.0, 0.0)", "_width": "_l * (_n - _l)"})
    p = p.project({"_n": col("_n").max(), "_steps": col("_step").sum(), "_widths": col("_width").sum()}, group_by=group)
    return p.extend({result: "1 - _n * _steps / (2 * _widths)"}).select_columns([*group, result])


def xicor_score_variables(plan: Plan, *, x_vars, y: str, row_key: str, variable: str = "variable", result: str = "xicor", repetitions: int | None = None) -> Plan:
    """xicor of y on each of several variables, by one unpivot.

    Ties of a variable go by row_key, once; or, with repetitions, by chance, that many times: the result then has their
    mean and standard deviation per variable, `<result>_mean` and `<result>_std`.
    """
    shape = RecordSpecification({variable: list(x_vars), "_x": list(x_vars)}, (row_key, y), (variable,))
    long = plan.select_columns([row_key, y, *x_vars]).convert_records(shape.map_from_rows())
    if repetitions is None:
        return xicor(long, x="_x", y=y, group_by=[variable], tie_break=[row_key], result=result)
    many = long.extend({"_times": Lit(int(repetitions))}).replicate_rows("_times", seq_column="_rep").extend({"_chance": "_uniform()"})
    each = xicor(many, x="_x", y=y, group_by=[variable, "_rep"], tie_break=["_chance", row_key], result=result)
    return each.project({f"{result}_mean": col(result).mean(), f"{result}_std": col(result).std()}, group_by=[variable])


__all__ = ["braid", "last_observed_carried_forward", "multi_column_map", "rank_to_average", "replicate_rows", "table", "xicor", "xicor_score_variables"]
