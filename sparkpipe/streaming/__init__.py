"""Plans over streams: the stateless part of a plan runs on a streaming DataFrame as it stands."""

from __future__ import annotations

from ..plans import nodes as N


def streamable(plan: N.Plan, static: tuple[str, ...] = ()) -> bool:
    """Whether no step needs all rows of a stream: no windows, orders, distinct keys or record blocks to rows above one.

    static: tables that don't stream.  A stream joins these by inner and cross joins, and by outer ones that keep its own
    rows only; two streams meet by inner joins.  Steps over static tables alone are free.
    """
    flows: dict[int, bool] = {}
    for n in plan.nodes():
        flows[id(n)] = any(flows[id(s)] for s in n.sources) if n.sources else isinstance(n, N.SqlTable) is False and n.name not in static
        if not flows[id(n)]:
            continue
        if isinstance(n, N.Extend) and (n.windowed or any(c.op in ("connected_components", "co_equalizer") for _, t in n.ops for c in t.calls())):
            return False
        if isinstance(n, (N.Project, N.OrderRows)) or isinstance(n, N.ConvertRecords) and n.record_map.blocks_in is not None:
            return False
        if isinstance(n, N.ConcatRows) and not all(flows[id(s)] for s in n.sources):
            return False
        if isinstance(n, N.NaturalJoin):
            kind, left, right = N.JOINS[n.jointype], flows[id(n.a)], flows[id(n.b)]
            if kind == "full" or kind == "left" and not (left and not right) or kind == "right" and not (right and not left) or kind == "cross" and left and right:
                return False
    return True


def apply_stream(plan: N.Plan, frame, **static):
    """The plan of one streaming table, and static ones by name, as a streaming DataFrame; ValueError if it can't stream."""
    names = [t for t in plan.tables() if t not in static]
    if len(names) != 1:
        raise ValueError(f"one table must stream, not {names}")
    if not streamable(plan, tuple(static)):
        raise ValueError("the plan needs all rows of a stream, or joins it in a way that Spark can't")
    return plan.evaluate({names[0]: frame, **static})
