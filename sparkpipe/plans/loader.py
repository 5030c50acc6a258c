"""Plans back from their printed form, without running any of it as Python."""

from __future__ import annotations

import ast

from .nodes import Plan, sql_table, table

_METHODS = frozenset("extend project select_rows select_columns drop_columns rename_columns map_columns order_rows natural_join concat_rows convert_records replicate_rows".split())


def load_plan(text: str) -> Plan:
    """The plan that `to_python` printed.  Only the builders, record shapes and literals are known; else ValueError."""
    return _build(ast.parse(text.strip().replace("\n", " "), mode="eval").body)


def _build(node: ast.AST):
    if isinstance(node, ast.Call):
        from ..operators.records import RecordMap, RecordSpecification

        args = [_build(a) for a in node.args]
        named = {k.arg: _build(k.value) for k in node.keywords}
        if isinstance(node.func, ast.Name):
            known = {"table": table, "sql_table": sql_table, "RecordMap": RecordMap, "RecordSpecification": RecordSpecification}
            if node.func.id in known:
                return known[node.func.id](*args, **named)
        elif isinstance(node.func, ast.Attribute) and node.func.attr in _METHODS:
            source = _build(node.func.value)
            if isinstance(source, Plan):
                return getattr(source, node.func.attr)(*args, **named)
        raise ValueError(f"not part of a plan: {ast.unparse(node.func)}")
    return ast.literal_eval(node)
