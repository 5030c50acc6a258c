"""Relational pipelines as data, compiled to lazy Spark DataFrames."""

from .plans.expr import col, connected_components, lit, one
from .plans.nodes import Plan, concat_all, describe_table, evaluate, sql_table, table

__all__ = ["Plan", "col", "concat_all", "connected_components", "describe_table", "evaluate", "lit", "one", "sql_table", "table"]
__version__ = "0.1.0"
