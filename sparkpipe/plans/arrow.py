"""Plans as arrows between column sets."""

from __future__ import annotations

from .nodes import Plan, Table


class Arrow:
    """A plan of one table, composed only where columns match exactly."""

    def __init__(self, plan: Plan):
        tables = plan.tables()
        if len(tables) != 1:
            raise ValueError(f"an arrow has one table, not {list(tables)}")
        self.plan, (self.name, leaf) = plan, next(iter(tables.items()))
        self._dom = tuple(leaf.columns)

    def dom(self) -> set[str]:
        return set(self._dom)

    def cod(self) -> set[str]:
        return set(self.plan.columns)

    def required_columns(self) -> set[str]:
        return self.plan.columns_used()[self.name]

    def dom_as_table(self) -> Table:
        return Table(self.name, self._dom)

    def cod_as_table(self) -> Table:
        return Table(self.name, self.plan.columns)

    def get_feature_names(self) -> list[str]:
        return list(self.plan.columns)

    def act_on(self, other):
        if isinstance(other, Arrow):
            if other.cod() != self.dom():
                raise ValueError(f"{sorted(other.cod())} don't meet {sorted(self.dom())}")
            return Arrow(self.plan.replace_leaves({self.name: other.plan}))
        return self.plan.act_on(other)

    transform = act_on

    def __rshift__(self, other):
        return other.act_on(self)

    def __rrshift__(self, other):
        return self.act_on(other)

    def __eq__(self, other):
        return isinstance(other, Arrow) and self.plan == other.plan

    def __hash__(self):
        return hash(self.plan)

    def __repr__(self):
        return f"[{sorted(self.dom())!r} -> {sorted(self.cod())!r}] {self.plan!r}"


def identity(columns, name: str = "data_frame") -> Arrow:
    return Arrow(Table(name, tuple(columns)))


def fmt_as_arrow(plan: Plan) -> str:
    """A plan of one table as the arrow that it is: its columns, the steps, and the columns that come out."""
    arrow = Arrow(plan)
    steps = plan.to_python(pretty=True).split("\n")
    return "\n".join([f"[ {', '.join(map(repr, sorted(arrow.dom())))}", "  ->", *(f"  {x}" for x in steps), "  ->", f"  {', '.join(map(repr, sorted(arrow.cod())))} ]"])
