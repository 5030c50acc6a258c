"""Expressions and operator nodes: the logical plan."""
