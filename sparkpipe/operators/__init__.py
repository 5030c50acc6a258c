"""Operators above the plan nodes: record maps, canned solutions, graph components."""
